"""Secrets in texts, with multipart credentials linked.

Base spans are strong by their format. Weaker parts (names of users and clients, endpoints, tokens of mixed characters, private
key blocks) are common in harmless text. They are reported only when complementary parts co-occur: parts of a document
are dealt into scopes of ``SCOPE`` characters, interval-joined with the parts of the own and the neighbouring scopes, and
kept if a part of the role they need lies within ``SCOPE`` characters: the gap from the end of the one to the start of the other.
Parts that overlap are readings of the same characters, so they do not complement each other.
A part is dealt to all scopes that it covers, and a pair meets in the first that both have. A scope holds few parts, so the
join grows with the number of parts and their length.

All is DataFrame functions. A text is scanned once; what was found is staged, and linking works on distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import other_columns, staged, text_of
from terrace.llm.spans import NONE, listing, none, ordered, redacted, spans, without_text

SCOPE = 200
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"{_KEYWORD}[\"']?\x20*[:=]\x20*[\"']?{_VALUE}+"
ASSIGN_START = rf"{_KEYWORD}[\"']?\x20*[:=]\x20*[\"']?"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
#: Weaker parts: kind -> (pattern, pattern of texts worth a search).
IDENTIFIER = r"(?i:\b(?:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?)[A-Za-z0-9_.@-]{3,}"
ENDPOINT = r"(?i:\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3)://)[^\x20\x09-\x0D\"'<>]{3,}"
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Up to the END line, or the BEGIN line alone where there is none.
PRIVATE = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]+ )?PRIVATE KEY-----)?+"
#: Kinds in the order of listings: the base ones first. Role of each: identifier, secret or endpoint.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "endpoint": "endpoint", "mixed": "secret", "private": "secret"}
_RANK = {k: i for i, k in enumerate(KINDS)}
BASE = 3


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans by base kind. A match of assign counts if its value has six characters or more."""
    long_enough = lambda x: F.char_length(F.regexp_replace(x["match"], f"^{ASSIGN_START}", "")) >= 6
    return {
        "assign": F.filter(spans(text, ASSIGN, "assign", 0, text.rlike(ASSIGN)), long_enough),
        "access": spans(text, ACCESS, "access", 1, F.contains(text, F.lit("AKIA"))),
        "hex": spans(text, HEX, "hex", 2, text.rlike(HEX)),
    }


def weak_spans(text: Column) -> Column:
    """Parts that count only together with others."""
    return F.concat(
        spans(text, IDENTIFIER, "identifier", _RANK["identifier"], text.rlike(IDENTIFIER)),
        spans(text, ENDPOINT, "endpoint", _RANK["endpoint"], F.contains(text, F.lit("://"))),
        spans(text, MIXED, "mixed", _RANK["mixed"], text.rlike(MIXED)),
        spans(text, PRIVATE, "private", _RANK["private"], F.contains(text, F.lit("-----BEGIN"))),
    )


def scan(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """Every row and column of ``docs`` with ``base`` and ``spans``: arrays of what was found, sorted.

    The text is left out unless ``redact`` asks for it with each span replaced by its kind in brackets. Null and
    empty texts have no spans. Repeated rows, and equal texts, have equal spans; ids are not used, so they may be
    null. Input columns named base or spans are replaced, others may have any name. An empty table gives an empty one.
    """
    kept, back = other_columns(docs, "base", "spans", text)
    own = [f"in_{i}" for i in range(len(kept))]
    value = F.col("_text")
    every = F.concat("assign", "access", "hex", "weak")
    found = docs.select(*kept, text_of(docs, text).alias("_text")).select(
        "*", *(c.alias(k) for k, c in base_spans(value).items()), weak_spans(value).alias("weak"))
    # Only weak parts need others, so only texts with one are linked.
    linkable = (F.size("weak") > 0) & (F.size(every) > 1)
    found = found.select(  # no secret is written
        *own, *(["_text"] if redact else []), without_text(ordered(F.concat("assign", "access", "hex"))).alias("base"),
        F.when(linkable, F.md5("_text")).alias("_key"), F.when(linkable, without_text(ordered(every))).alias("_parts"))
    found = staged(found)
    linked = _linked(found.filter("_key is not null").groupBy("_key").agg(F.min("_parts").alias("_parts")))
    out = found.filter("_key is not null").join(linked, "_key", "left").withColumn("_linked", F.coalesce("_linked", none())).unionByName(
        found.filter("_key is null").withColumn("_linked", none()))
    out = out.withColumn("spans", ordered(F.col("base"), F.col("_linked")))
    return out.select(*back, "base", "spans", *([redacted(F.col("_text"), F.col("spans")).alias(text)] if redact else []))


def _linked(texts: DataFrame) -> DataFrame:
    """Weak parts of each text that have what they need nearby."""
    role = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    parts = texts.select("_key", F.explode("_parts").alias("p")).select(
        "_key", F.col("p.s").alias("s"), F.col("p.e").alias("e"), F.col("p.kind").alias("kind"), F.col("p.rank").alias("rank"),
        role[F.col("p.kind")].alias("role"))
    scope = lambda c: F.floor(c / SCOPE).cast("int")
    dealt = lambda first, last: F.explode(F.sequence(scope(first), scope(last))).alias("scope")
    left = parts.filter(F.col("rank") >= BASE).select("*", scope(F.col("s") - SCOPE - 1).alias("low"), dealt(F.col("s") - SCOPE - 1, F.col("e") + SCOPE))
    right = parts.select("_key", dealt(F.col("s"), F.col("e") - 1), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("role").alias("role2"))
    near = left.join(right, ["_key", "scope"]).filter(
        (F.col("role") != F.col("role2")) & ((F.col("s2") - F.col("e")).between(0, SCOPE) | (F.col("s") - F.col("e2")).between(0, SCOPE))
        & (F.col("scope") == F.greatest(F.col("low"), scope(F.col("s2")))))
    has = lambda r: F.max((F.col("role2") == r).cast("int"))
    judged = near.groupBy("_key", "s", "e", "kind", "rank", "role").agg(
        has("secret").alias("secret"), has("identifier").alias("identifier"), has("endpoint").alias("endpoint"))
    # A secret needs an identifier or endpoint, an identifier a secret, an endpoint both of the others.
    enough = (F.when(F.col("role") == "secret", F.lit(True)).when(F.col("role") == "identifier", F.col("secret") == 1)
              .otherwise((F.col("secret") == 1) & (F.col("identifier") == 1)))
    one = F.struct("s", "rank", "e", "kind", F.lit("").alias("match"))
    return judged.filter(enough).groupBy("_key").agg(F.collect_list(one).cast(NONE).alias("_linked"))


def digest(found: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(*ids, *(count(k) for k in list(KINDS)[:BASE]), F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listing(F.col("spans")).alias("spans"))
