"""Personal data in texts: candidates judged by gradient-boosted trees.

Generators with high recall propose overlapping spans: the raw patterns of the base kinds, and looser ones (telephone and
identity numbers, account numbers, addresses written out). Boosted trees score each candidate by its format and its surroundings.
They are trained on settled candidates, about ``TRAIN`` of them at most and as many of each class as there are up to half of that; all
the other settled ones calibrate the threshold of the least wanted precision for each looser kind. A checksum or range settles a candidate of a base kind, unless it fails and
overlaps a looser one: it may be that one's digits. Looser candidates are settled by clues: a valid format and words of the kind before it
count for it, words of other numbers (orders, parts) against it. Base spans stay whatever the trees say; other candidates are added where
the clues settle them for good or the trees' threshold is reached, and they touch no base span. Where nothing can be learned about a kind, or
no threshold has the precision, the rule decides: a possible format, or words of the kind, and no words of other numbers.

All is DataFrame functions and Spark's own trees. A text is scanned once; candidates are staged and scored as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import let
from terrace.llm.common import other_columns, staged, text_of
from terrace.llm.spans import NONE, apart, blocks, cut, listing, none, ordered, redacted, spans, without_text

#: Documented bounds: candidates to learn from, trees, their depth. Least precision of what is added, and least settled cases of a class in each part.
TRAIN, TREES, DEPTH, PRECISION, LEAST = 20_000, 6, 3, 0.98, 20
CONTEXT = 24
_PART = "[A-Za-z0-9._%+-]"
#: Possessive forms of the base patterns: they match the same, in time that grows with the length of the text alone.
EMAIL = rf"(?:(?<!{_PART})|\G){_PART}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone", "telephone", "identity", "account", "address")
BASE = 4
TELEPHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
IDENTITY = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![0-9A-Za-z])"
ADDRESS = r"(?i:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[a-z]{2,24})"
#: Words that announce a kind, and words of numbers that are not personal.
NEAR = {
    "telephone": "phones?|telephone|tel|calls?|mobile|cell|fax|ring|reach|contact|whatsapp|sms|text",
    "identity": "ssn|social|security|identity|taxpayer|tin|id",
    "account": "account|acct|iban|bank|transfer|pay",
    "address": "e-?mail|mail|contact|address|write|reach|send",
}
OTHER = "orders?|invoice|part|item|serial|version|ref|reference|isbn|sku|model|ticket|lot|batch|tracking|product"
_words = lambda x: f"(?i)(?<![A-Za-z])(?:{x})(?![A-Za-z])"
_WORDS = "(?i)phone|tel|call|mobile|fax|card|visa|account|iban|ssn|social|mail|contact|address"
FEATURES = ("length", "digits", "letters", "groups", "luhn", "range", "plus", "at", "dots", "before", "after", "words", "kind", "format", "near", "other")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def check(text: Column) -> Column:
        size = F.char_length(text)
        digit = lambda i: F.substring(text, size - i, F.lit(1)).cast("int")  # noqa: E731  from the right, 0 first
        add = lambda acc, i: acc + F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
        return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0

    return let(digits, check)


def _valid(x: Column) -> Column:
    """Whether a raw match of a base kind stands: the check of its kind."""
    digits = _digits(x["match"])
    n = F.char_length(digits)
    return (F.when(x["kind"] == "email", True)
            .when(x["kind"] == "ip", x["match"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(x["kind"] == "card", F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False))
            .otherwise((n >= 10) & (n <= 15)))


def _mod97(x: Column) -> Column:
    """Whether an account number passes its check: the remainder of its turned digits is 1."""
    plain = F.regexp_replace(x, "\\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    add = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _before(pieces: Column, x: Column) -> Column:
    return cut(pieces, F.greatest(x["s"] - CONTEXT, F.lit(0)), x["s"])


def _clues(pieces: Column, x: Column) -> tuple[Column, Column, Column]:
    """Of a loose candidate: format (0 wrong, 1 possible, 2 unmistakable), words of its kind before it, words of other numbers."""
    match, kind, before = x["match"], x["kind"], _before(pieces, x)
    shape = (
        F.when(kind == "telephone", F.when(match.rlike(r"^\([2-9][0-9]{2}\)"), 2).when(match.rlike("^[2-9][0-9]{2}[^0-9)]"), 1).otherwise(0))
        .when(kind == "identity", F.when(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 2).otherwise(0))
        .when(kind == "account", F.when(_mod97(match), 2).otherwise(0))
        .when(kind == "address", F.when(match.rlike(r"(?i)[\[(]at[\])].*[\[(]dot[\])]"), 2).otherwise(1)).otherwise(0))
    near = F.coalesce(*(F.when(kind == k, before.rlike(_words(w)).cast("int")) for k, w in NEAR.items()), F.lit(0))
    return shape, near, before.rlike(_words(OTHER)).cast("int")


def scan(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """Every row and column of ``docs`` with ``base`` and ``spans``: arrays of what was found, sorted.

    The text is left out unless ``redact`` asks for it with each span replaced by its kind in brackets. Null and
    empty texts have no spans. Repeated rows, and equal texts, have equal spans; ids are not used, so they may be
    null. Input columns named base or spans are replaced, others may have any name. Where too few candidates are settled to learn from, the rule of
    format and context decides. An empty table gives an empty one.
    """
    kept, back = other_columns(docs, "base", "spans", text)
    own = [f"in_{i}" for i in range(len(kept))]
    value = F.col("_text")
    digit = value.rlike("[0-9]")
    raw = docs.select(*kept, text_of(docs, text).alias("_text")).select("*", F.concat(
        spans(value, EMAIL, "email", 0, F.contains(value, F.lit("@"))),
        spans(value, IP, "ip", 1, value.rlike(r"[0-9]\.[0-9]")),
        spans(value, CARD, "card", 2, value.rlike(r"(?:[0-9][\x20-]?){2}")),
        spans(value, PHONE, "phone", 3, value.rlike(r"\+[0-9]"))).alias("raw"), F.concat(
        spans(value, TELEPHONE, "telephone", 4, digit & value.rlike(TELEPHONE)),
        spans(value, IDENTITY, "identity", 5, digit & value.rlike(IDENTITY)),
        spans(value, ACCOUNT, "account", 6, digit & value.rlike(ACCOUNT)),
        spans(value, ADDRESS, "address", 7, value.rlike(r"(?i)[\[(\x20]at[\])\x20]") & value.rlike(ADDRESS))).alias("loose"))
    judged = raw.select("*", F.filter("raw", _valid).alias("good"))
    # Short runs of digits that no check settles are no candidates, nor are failing runs that may be part of a loose one; all others are.
    failing = F.filter("raw", lambda x: ~_valid(x) & ((x["kind"] != "card") | (F.char_length(_digits(x["match"])) >= 9)))
    settled, free = F.concat("good", apart(failing, F.col("loose"))), apart(F.col("loose"), F.col("good"))

    def around(pieces: Column, x: Column) -> Column:
        clues = _clues(pieces, x)
        points, base = clues[0] + clues[1] - clues[2], x["rank"] < BASE
        return F.struct(
            x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"),
            (base | (points != 1)).alias("settled"), F.when(base, _valid(x)).otherwise(points > 1).alias("good"),
            (~base & (clues[0] + clues[1] > 0) & (clues[2] == 0)).alias("rule"),
            F.array(*(c.cast("double") for c in (*_features(pieces, x), x["rank"], *clues))).alias("f"))

    any_ = (F.size("raw") > 0) | (F.size("loose") > 0)
    candidates = let(F.when(any_, blocks(value)), lambda pieces: F.transform(F.concat(settled, free), lambda x: around(pieces, x)))
    found = staged(judged.select(  # nothing personal is written
        *own, *(["_text"] if redact else []), without_text(ordered(F.col("good"))).alias("base"),
        F.when(any_, F.md5("_text")).alias("_key"), candidates.alias("_candidates")))
    added = _added(found.filter("_key is not null").groupBy("_key").agg(F.min("_candidates").alias("_candidates")))
    out = found.filter("_key is not null").join(added, "_key", "left").withColumn("_more", F.coalesce("_more", none())).unionByName(
        found.filter("_key is null").withColumn("_more", none()))
    out = out.withColumn("spans", ordered(F.col("base"), F.col("_more")))
    return out.select(*back, "base", "spans", *([redacted(F.col("_text"), F.col("spans")).alias(text)] if redact else []))


def _features(pieces: Column, x: Column) -> list[Column]:
    """What the trees see of a candidate besides its kind and clues, in the order of ``FEATURES``."""
    match = x["match"]
    digits = _digits(match)
    n = F.char_length(digits)
    before = _before(pieces, x)
    after = cut(pieces, x["e"], x["e"] + 1)
    size = lambda pattern: F.char_length(match) - F.char_length(F.regexp_replace(match, pattern, ""))
    kind_of = lambda c: F.when(c.rlike("[A-Za-z]$"), 2).when(c.rlike("[0-9]$"), 3).when(c.rlike(r"\S$"), 1).otherwise(0)
    return [
        F.char_length(match), n, size("[A-Za-z]"), F.size(F.split(match, "[^A-Za-z0-9]+")),
        F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False), F.when((n >= 10) & (n <= 15), 1).when(n < 10, 0).otherwise(2),
        match.startswith("+"), F.contains(match, F.lit("@")), size("[^.]") - F.char_length(match), kind_of(before), kind_of(after), before.rlike(_WORDS),
    ]


def _added(texts: DataFrame) -> DataFrame:
    """Candidates beyond the base kinds that are accepted, by text."""
    rows = staged(texts.select("_key", F.explode("_candidates").alias("c")).select("_key", "c.*"))
    sure = rows.filter(f"settled and good and rank >= {BASE}")
    accepted = sure.unionByName(_judged(rows))
    return accepted.groupBy("_key").agg(F.collect_list(F.struct("s", "rank", "e", "kind", F.lit("").alias("match"))).cast(NONE).alias("_more"))


def _judged(rows: DataFrame) -> DataFrame:
    """The candidates that are not settled but accepted: by the trees or, for kinds without a threshold, by the rule."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    open_, by_rule = rows.filter("not settled"), F.col("rule")
    learnable = rows.filter("settled").withColumn("h", F.xxhash64("_key", "s", "kind"))
    counts = {r.good: r["count"] for r in learnable.groupBy("good").count().collect()}
    if min(counts.get(False, 0), counts.get(True, 0)) < 2 * LEAST:
        return open_.filter(by_rule)
    # Each class fits with half of TRAIN, but with half of its own candidates at most; all others calibrate.
    share = {c: min(n // 2, TRAIN // 2) / n for c, n in counts.items()}
    part = F.pmod("h", F.lit(1 << 30)) < F.when(F.col("good"), share[True]).otherwise(share[False]) * (1 << 30)
    learnable = learnable.select("kind", part.alias("fit"), F.col("good").cast("double").alias("label"), array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(staged(learnable.filter("fit").select("label", "features")))
    chance = vector_to_array("probability")[1]
    steps = model.transform(learnable.filter("not fit")).groupBy("kind", F.floor(chance * 100).alias("p")).agg(
        F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # at most 101 rows a kind
    limits = {k: _threshold([r for r in steps if r.kind == k]) for k in KINDS[BASE:]}
    scored = model.transform(open_.withColumn("features", array_to_vector("f")))
    known = [F.when(F.col("kind") == k, by_rule if t is None else chance >= t) for k, t in limits.items()]
    return scored.filter(F.coalesce(*known)).select(rows.columns)


def _threshold(steps: list) -> float | None:
    """The least hundredth from which on the precision is enough where both classes weigh the same, so that many good candidates
    of one table do not excuse bad ones. None where a class has too few cases to know, or no hundredth will do."""
    good, bad = sum(r.good for r in steps), sum(r.n - r.good for r in steps)
    if min(good, bad) < LEAST:
        return None
    for step in range(101):
        hit = sum(r.good for r in steps if r.p >= step) / good
        miss = sum(r.n - r.good for r in steps if r.p >= step) / bad
        if hit and hit >= PRECISION * (hit + miss):
            return step / 100
    return None


def digest(found: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(*ids, *(count(k) for k in KINDS[:BASE]), F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listing(F.col("spans")).alias("spans"))
