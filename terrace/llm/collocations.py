"""Phrase collocations by SON partitioning.

1. Texts are dealt to ``SHARDS`` shards. A shard's phrases are all counted, as 64-bit hashes by range of the hash, and those
   that reach the shard's part of the support are locally frequent: a phrase that reaches the support in all of the table
   reaches that part in some shard. Hashes that meet can only add candidates.
2. The union of locally frequent hashes is a bitmap of bounded size. A second pass over the texts counts the phrases in it by
   their words, exactly; those below the support go.
3. Every part of a frequent phrase is frequent, so cuts are scored by joins among the counted phrases alone.

Within a task the words of a block are numbers, and phrases are windows over them. The blocks, and the hash ranges of a shard, are of
bounded size whatever the table's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.bitmap import Bitmap
from terrace.llm.common import staged, text_of

SHARDS, SUPPORT, MOST_WORDS, INSIDE, TOP = 2, 10, 3, 50, 2000
#: Words of a block, bytes of a text read at once, bytes of text that one range of a shard stands for.
BLOCK, SLICE, RANGE = 1 << 20, 1 << 21, 1 << 22
#: A byte that no UTF-8 text holds marks the ends of pieces.
_END = b"\xff"
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Block:
    """Words of some texts as numbers: 0 ends a piece; words carried over from an earlier block start no count again."""

    def __init__(self):
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.codes: dict[str, Codes] = {}
        self.parts: list[np.ndarray] = []
        self.fresh: list[np.ndarray] = []
        self.shards: list[tuple[int, int]] = []
        self.size = 0

    def add(self, lang: str, shard: int, tokens: list[bytes], carried: int) -> None:
        codes = self.codes.get(lang)
        if codes is None:
            codes = self.codes[lang] = Codes(self.words, lang)
        part = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
        fresh = np.ones(len(part) + 1, bool)
        fresh[:carried] = False
        self.parts.append(np.append(part, 0))
        self.fresh.append(fresh)
        self.shards.append((shard, len(part) + 1))
        self.size += len(part) + 1

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, whether a phrase may end there, and the shard, for all places."""
        shard, length = (np.array(x) for x in zip(*self.shards))
        return np.concatenate(self.parts), np.concatenate(self.fresh), np.repeat(shard, length)

    def hashes(self) -> np.ndarray:
        """A hash of each number's language and word."""
        return np.fromiter((xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang)) for lang, word in self.words), np.uint64, len(self.words))


class Codes(dict):
    """Numbers of a language's words, given as they come."""

    def __init__(self, words: list, lang: str):
        self.words, self.lang = words, lang
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append((self.lang, word))
        return number


def slices(text: str, most: int, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and ends of pieces of a text, in parts of bounded size; a part begins with words of the one before, which are counted."""
    data = text.encode().translate(_TABLE)
    at, carried = 0, []
    while at < len(data):
        end = len(data)
        if end - at > most:
            # Cut behind white space or an end of a piece; a longer word stays whole.
            end = max(data.rfind(x, at, at + most) for x in (_END, b" ", b"\t")) + 1
            if end <= at:
                end = min((i for i in (data.find(x, at + most) for x in (_END, b" ", b"\t")) if i >= 0), default=len(data) - 1) + 1
        own = data[at:end].replace(_END, b" \xff ").split()
        yield carried + own, len(carried)
        carried, at = (carried + own)[-overlap:] if overlap else [], end


def blocks(batches: Iterator[pa.RecordBatch], most_words: int, size: int) -> Iterator[Block]:
    """Blocks of about ``size`` words from batches of text, language and shard."""
    block = Block()
    for batch in batches:
        for text, lang, shard in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for tokens, carried in slices(text, SLICE, most_words - 1):
                block.add(lang, shard, tokens, carried)
                if block.size >= size:
                    yield block
                    block = Block()
    if block.size:
        yield block


def phrase_hashes(block: Block, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words: the hashes of phrases, and the places of their first words."""
    numbers, fresh, _ = block.closed()
    each = block.hashes()[numbers]
    out, inside = each, numbers > 0
    for words in range(1, most_words + 1):
        if words > 1:
            out = _mixed(out[:-1] * _ODD + each[words - 1:])
            inside = inside[:-1] & (numbers[words - 1:] > 0)
        yield words, _mixed(out ^ np.uint64(words))[inside & fresh[words - 1:]], np.flatnonzero(inside & fresh[words - 1:])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, support: int = SUPPORT,
                 inside: int = INSIDE, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of 2 to ``most_words`` words of each language.

    A null text is empty; a null language is ``und``, as is that name itself. Rows count as often as they are repeated; ids are not
    read. Texts of any length are read whole. Equal scores go by count, then by the phrase's bytes. Other columns are left out, so their
    names don't matter. An empty table, or one without a frequent phrase, gives no rows.
    """
    texts = docs.select(text_of(docs, text).alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))
    frequent = staged(counted(texts, most_words, support, shards))
    scored = staged(_scored(frequent))
    parts = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), s -> concat_ws(' ', slice(w, s, k)))))")
    covering = (scored.filter("words > 2").select("lang", "words", "a", F.split("phrase", " ").alias("w")).select("lang", "a", F.explode(parts).alias("phrase"))
                .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    left = scored.join(covering, ["lang", "phrase"], "left").filter(F.expr(f"most is null or 100 * most < {inside} * a")).drop("most")
    totals = frequent.filter("words = 0").select("lang", "n")
    return _first(left, top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def counted(texts: DataFrame, most_words: int = MOST_WORDS, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """lang, words, phrase and n: all phrases of 1 to ``most_words`` words found ``support`` times or more, and with 0 words each language's number of words.

    ``texts`` has the columns text and lang, without nulls.
    """
    candidates = Bitmap.of(staged(locally_frequent(texts, most_words, support, shards)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most_words, BLOCK):
            numbers, fresh, _ = block.closed()
            langs, words_ = (pa.array(x, pa.string()) for x in ([lang for lang, _ in block.words], [word.decode() for _, word in block.words]))
            n = np.bincount(numbers[fresh & (numbers > 0)], minlength=len(block.words))
            totals = pa.table({"lang": langs, "n": pa.array(n, pa.int64())}).slice(1).group_by("lang").aggregate([("n", "sum")])
            yield _phrases(totals["lang"].combine_chunks(), 0, pa.array([""] * len(totals)), totals["n_sum"].combine_chunks())
            for words, hashes, places in phrase_hashes(block, most_words):
                places = places[candidates.holds(hashes)]
                # Pairs of a number for the words so far and the next word's number: exact, whatever the number of words.
                key = numbers[places]
                for k in range(1, words):
                    key = np.unique(key, return_inverse=True)[1] << 32 | numbers[places + k]
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                own = [pa.array(numbers[places[at] + k]) for k in range(words)]
                yield _phrases(langs.take(own[0]), words, pc.binary_join_element_wise(*(words_.take(x) for x in own), " "), pa.array(n, pa.int64()))

    return (texts.select("text", "lang", F.lit(0).alias("shard")).mapInArrow(count, "lang string, words int, phrase string, n long")
            .groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("words") == 0) | (F.col("n") >= support)))


def _phrases(langs: pa.Array, words: int, phrases: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([langs, pa.array(np.full(len(n), words, np.int32)), phrases, n], names=["lang", "words", "phrase", "n"])


def locally_frequent(texts: DataFrame, most_words: int = MOST_WORDS, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """Hashes of phrases that reach the support's part of a shard in that shard: of all frequent ones, and of some others."""
    least = -(-support // shards)
    size = texts.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    power = max(0, math.ceil(math.log2(size / (shards * RANGE) + 1)))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most_words, BLOCK):
            shard = block.closed()[2]
            found = [(hashes, shard[places]) for _, hashes, places in phrase_hashes(block, most_words)]
            for own in np.unique(shard).tolist():
                hashes, n = np.unique(np.concatenate([h[s == own] for h, s in found]), return_counts=True)
                edges = np.searchsorted(hashes, np.arange(1, 1 << power, dtype=np.uint64) << np.uint64(64 - power)) if power else []
                parts = [(k, h.tobytes(), c.astype(np.uint32).tobytes()) for k, (h, c) in enumerate(zip(np.split(hashes, edges), np.split(n, edges))) if len(h)]
                yield pa.record_batch([pa.array([own] * len(parts), pa.int32()), *(pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary())))],
                                      names=["shard", "range", "hashes", "counts"])

    def add(part: pa.Table) -> pa.Table:
        """All counts of one range of a shard."""
        hashes, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.uint32)))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        reached = np.add.reduceat(n[order].astype(np.int64), first) >= least
        return pa.table({"hash": pa.array(hashes[first[reached]].view(np.int64))})

    dealt = texts.select("text", "lang", F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.mapInArrow(mine, "shard int, range int, hashes binary, counts binary").groupBy("shard", "range").applyInArrow(add, "hash long")


def _scored(frequent: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r and score by the cut with the lowest score."""
    whole = frequent.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = whole.select("lang", "words", "phrase", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "words", "phrase", "a", "k", F.expr("concat_ws(' ', slice(w, 1, k))").alias("first"), F.expr("concat_ws(' ', slice(w, k + 1, words - k))").alias("rest"))
    # Every part of a frequent phrase is frequent: nothing is lost by inner joins. Frequent parts are split by adaptive execution.
    part = frequent.filter("words > 0")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]))
    score = F.expr("(cast(1000000 AS decimal(7, 0)) * cast(a AS decimal(19, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(least).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language with their ranks. A language is dealt over many groups, whose first rows meet again."""

    def ranked(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    now = staged(scored)
    size, before = now.count(), math.inf
    while size > 16 * top and size < before / 2:
        deal = F.pmod(F.xxhash64("phrase"), F.lit(-(-size // (8 * top))))
        now = staged(ranked(now.withColumn("deal", deal), "lang", "deal").drop("deal", "rank"))
        size, before = now.count(), size
    return ranked(now, "lang")
