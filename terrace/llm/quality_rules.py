"""Quality rules as weak supervision: rules vote, a label model weighs them.

Each rule votes good, bad, or abstains, from counts over the whole text. Expectation-maximisation over
the distinct vote patterns (at most two to the number of rules, however many documents there are)
estimates how often each rule gives each vote to good and bad documents; the posterior probability of
good then decides. Counts and verdicts are DataFrame functions within the row, the patterns are a grouped count; only the
few numbers of the model are worked out on the driver, from those patterns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import WORD_SPACE, other_columns, staged, text_of

ROUNDS, KEEP = 30, 0.5
WINDOW = 5
#: Detectors vote bad from a value on and abstain below it.
DETECTORS = {
    "symbols": ("symbols per word", 0.2),
    "repeated": ("share of repeated words", 0.2),
    "lines": ("share of repeated lines", 0.5),
    "capitals": ("capitals per character", 0.3),
    "marks": ("exclamation marks per word", 0.3),
    "length": ("distance of the mean word length from 7", 5.0),
}
#: Witnesses vote good up to a value and abstain above it.
WITNESSES = {
    "plain": ("symbols and exclamation marks per word", 0.05),
    "fresh": ("share of repeated words", 0.05),
    "lower": ("capitals per character", 0.12),
}
RULES = (*DETECTORS, *WITNESSES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the counts in ``COUNTS``; columns of these names are replaced, others may have any name.

    Null and empty texts have all counts 0. Texts are read whole; a row is handled by itself, so
    repeated rows and null ids make no difference.
    """
    kept, back = other_columns(docs, *COUNTS)
    value = F.col("_text")
    space = F.lit(WORD_SPACE)
    first = docs.select(*kept, text_of(docs, text).alias("_text"))
    second = first.select(
        "*",
        F.when(F.btrim(value, space) == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.btrim(value, space), "[ \\t-\\r]+")).alias("_words"),
        F.filter(F.split(value, "\n"), lambda x: F.btrim(x, space) != "").alias("_lines"),
    )
    third = second.select("*", F.transform("_words", lambda x: F.xxhash64(x)).alias("_hash"))
    windows = F.when(F.size("_hash") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("_hash") - WINDOW),
        lambda i: F.xxhash64(*(F.get("_hash", i + k) for k in range(WINDOW)))))
    fourth = third.select("*", windows.alias("_windows"))
    fifth = _covered(fourth)
    return fifth.select(
        *back,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(value, "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("_steps", F.lit(0), lambda total, x: total + x).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace(value, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        _count(value, "!").alias("n_marks"),
    )


def _count(text: Column, characters: str) -> Column:
    """How often some ASCII characters occur: bytes lost when they are taken out one by one."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def _covered(rows: DataFrame) -> DataFrame:
    """Add ``_steps``: for each window whose hash occurs twice or more, the words it covers that the last such one did not.

    Hash and place are packed into one number, so that a plain sort brings equal hashes together; the full hashes are
    compared, too. Every array that a lambda reads is a column of its own, made once. Texts without such windows skip it all.
    """
    size = F.size("_windows")
    repeated = F.size(F.array_distinct("_windows")) < size
    bits = F.ceil(F.log2(size + F.lit(1.0))).cast("int")
    packed = rows.select("*", F.when(repeated, bits).otherwise(0).alias("_bits")).select("*", F.when(F.col("_bits") > 0, F.sort_array(
        F.transform("_windows", lambda x, i: F.call_function("shiftleft", x, F.col("_bits")).bitwiseOR(i.cast("bigint")))))
        .otherwise(F.array().cast("array<bigint>")).alias("_packed"), (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bits")) - 1).alias("_mask"))
    place = lambda x: x.bitwiseAND(F.col("_mask")).cast("int")

    def same(x: Column, at: Column) -> Column:
        other = F.get("_packed", at)
        near = F.call_function("shiftrightunsigned", x.bitwiseXOR(other), F.col("_bits")) == 0
        return F.coalesce(near & (F.get("_windows", place(x)) == F.get("_windows", place(other))), F.lit(False))

    places = packed.select("*", F.sort_array(F.transform(
        F.filter("_packed", lambda x, i: same(x, i + 1) | same(x, i - 1)), place)).alias("_places"))
    return places.select("*", F.transform("_places", lambda p, i: F.least(
        F.lit(WINDOW), p - F.coalesce(F.get("_places", i - 1), F.lit(-WINDOW)))).alias("_steps"))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def votes() -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstain. All abstain where there are no words."""
    words, letters = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    share = {
        "symbols": F.col("n_symbols") / words,
        "repeated": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / F.when(F.col("n_lines") >= 2, F.col("n_lines")),
        "capitals": F.col("n_capitals") / letters,
        "marks": F.col("n_marks") / words,
        "length": F.abs(F.col("word_chars") / words - 7),
        "plain": (F.col("n_symbols") + F.col("n_marks")) / words,
    }
    share |= {"fresh": share["repeated"], "lower": share["capitals"]}
    bad = [F.when(share[k] >= at, -1).otherwise(0).alias(k) for k, (_, at) in DETECTORS.items()]
    good = [F.when(share[k] <= at, 1).otherwise(0).alias(k) for k, (_, at) in WITNESSES.items()]
    return bad + good


@dataclass(frozen=True)
class Model:
    #: Log odds of good before any vote, and by rule those added by the votes -1, 0 and 1.
    prior: float
    odds: tuple[tuple[float, float, float], ...]

    def posterior(self) -> Column:
        total = F.lit(self.prior)
        for vote, (bad, none, good) in zip(votes(), self.odds):
            total = total + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
        return 1 / (1 + F.exp(-total))


def fit(counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimate the label model from all rows that pass the base rules.

    To start with, any vote for bad outweighs those for good. Vote shares are smoothed, so a rule that never votes, or always the
    same, adds nothing. An empty table gives the same model as the votes alone.
    """
    rows = counts.filter(F.col("n_words") > 0).select(*votes()).groupBy(*RULES).agg(F.count("*").alias("n")).collect()
    # At most 2 ** len(RULES) rows, whatever the size of the table.
    patterns = sorted((tuple(r[k] for k in RULES), r.n) for r in rows)
    good = [0.1 if min(v) < 0 else 0.9 if max(v) > 0 else 0.5 for v, _ in patterns]
    for _ in range(rounds + 1):
        mass = sum(n * g for (_, n), g in zip(patterns, good)), sum(n * (1 - g) for (_, n), g in zip(patterns, good))
        prior = math.log((mass[0] + 1) / (mass[1] + 1))
        odds = []
        for j in range(len(RULES)):
            of = {vote: [1.0, 1.0] for vote in (-1, 0, 1)}
            for (v, n), g in zip(patterns, good):
                of[v[j]][0] += n * g
                of[v[j]][1] += n * (1 - g)
            odds.append(tuple(math.log(a / (mass[0] + 3)) - math.log(b / (mass[1] + 3)) for a, b in of.values()))
        good = [1 / (1 + math.exp(-max(-500.0, prior + sum(o[x + 1] for o, x in zip(odds, v))))) for v, _ in patterns]
    return Model(prior, tuple(odds))


def judged(counts: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Add base_failed, p_good and kept to rows with counts."""
    return (counts.withColumn("base_failed", base_failed()).withColumn("p_good", model.posterior())
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep)))


def quality(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Every row of ``docs`` without its text, with counts, base_failed, p_good and kept.

    The counts are staged, so texts are read once. Rows without words fail. An empty table gives an
    empty one; other columns come along, and columns of the added names are replaced.
    """
    own = {*COUNTS, "base_failed", "p_good", "kept"}
    counts = quality_counts(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in own)), text)
    return judged(counts, fit(counts), keep)


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts of all rows, staged without their texts."""
    return staged(with_counts(docs, text).drop(text))
