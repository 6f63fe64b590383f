"""Phrase collocations against counting all phrases, on random and odd texts, with other parameters and many slices."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from terrace.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, words int, rank string, w string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2, "r", "w") for i, (t, lang) in enumerate(rows)], SCHEMA)


def expected(rows, most=3, support=10, inside=50, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    for (lang, *w), a in candidates.items():
        score, k, l, r = min((10**6 * a * a // (l * r), k, l, r) for k in range(1, len(w)) for l, r in [(f[(lang, *w[:k])], f[(lang, *w[k:])])])
        longer = (b for (other, *v), b in candidates.items() if other == lang and len(v) > len(w) and f" {' '.join(w)} " in f" {' '.join(v)} ")
        if not any(100 * b >= inside * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    rows_, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows_.append((lang, rank[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return rows_


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n):
    draw = random.Random(seed)
    words = ["a", "A", "b", "c", "É", "é", "中", "x\x1cy", "d\xa0e", "f", "<g>", "\x00"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!", " ; "]
    return [("".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randrange(40))), draw.choice(["en", "en", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("arguments", [{}, {"most": 4, "support": 3, "top": 25}, {"most": 2, "support": 2, "inside": 1}, {"most": 5, "support": 4, "inside": 90, "top": 10}])
def test_equals_counting_all(spark, arguments):
    rows = texts(len(arguments), 120) + [(None, "en"), ("", "fr"), (" . ,", "fr"), ("one", "fr")] + [("same text three times over", "de")] * 12
    names = {"most": "most_words"}
    got = c.collocations(frame(spark, rows), shards=3, **{names.get(k, k): v for k, v in arguments.items()})
    assert found(got) == sorted(expected(rows, **arguments))


def test_nothing_and_long_texts(spark):
    assert c.collocations(frame(spark, [])).collect() == []
    assert c.collocations(frame(spark, [("only a few words here", "en"), (None, None)])).collect() == []
    rows = [("to be or not " * 250_000, "en"), ("u" * 3_000_000 + " v w", "en"), ("to be", "de")]
    assert found(c.collocations(frame(spark, rows))) == sorted(expected(rows))


def test_more_phrases_than_the_first(spark):
    draw = random.Random(9)
    rows = [(" ".join(f"w{draw.randrange(60)}" for _ in range(2000)), draw.choice("ab")) for _ in range(40)]
    got = c.collocations(frame(spark, rows), top=30, support=5)
    assert found(got) == sorted(expected(rows, top=30, support=5))


@pytest.mark.parametrize("most", [1, 7, 30, 1000])
def test_slices_and_blocks_count_every_phrase_once(most):
    import pyarrow as pa

    rows = [t for t, _ in texts(1, 60)] + ["longer" * 30 + " x y z", "", "no end"]
    want = Counter()
    for t in rows:
        for piece in re.split("[.,;:!?\n-\r]", t.translate(LOWER)):
            w = [x.encode() for x in re.split("[ \t]+", piece) if x]
            want.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    batch = pa.record_batch([pa.array(rows), pa.array(["en"] * len(rows)), pa.array([0] * len(rows))], names=["text", "lang", "shard"])
    for size in (1, 50, 10_000):
        got, by_hash = Counter(), {}
        for text in rows:
            data = [t for t, _ in c.slices(text, most, 2)]
            assert sum(len(t) - n for (t, n) in c.slices(text, most, 2)) == len(data and text.encode().translate(c._TABLE).replace(b"\xff", b" \xff ").split())
        whole, c.SLICE = c.SLICE, most
        try:
            for block in c.blocks(iter([batch]), 3, size):
                numbers = block.closed()[0]
                for k, hashes, places in c.phrase_hashes(block, 3):
                    for h, p in zip(hashes.tolist(), places.tolist()):
                        phrase = tuple(block.words[i][1] for i in numbers[p:p + k])
                        got[phrase] += 1
                        assert by_hash.setdefault(phrase, h) == h
        finally:
            c.SLICE = whole
        assert got == want and len(set(by_hash.values())) == len(by_hash)


def test_locally_frequent_holds_all_frequent(spark):
    rows = [("alpha beta gamma", "en")] * 5 + [("Alpha beta delta", "en")] * 5 + [("beta alone", "en")]
    df = frame(spark, rows).select("text", "lang")
    hashes = {r[0] for r in c.locally_frequent(df, 3, 10, 4).collect()}
    block = c.Block()
    block.add("en", 0, [b"alpha", b"beta", b"gamma"], 0)
    own = {k: h.astype(np.uint64).view(np.int64).tolist() for k, h, _ in c.phrase_hashes(block, 3)}
    assert {own[1][0], own[1][1], own[2][0]} <= hashes
    counts = {(r.words, r.phrase): r.n for r in c.counted(df, 3, 10, 4).collect()}
    assert counts == {(0, ""): 32, (1, "alpha"): 10, (1, "beta"): 11, (2, "alpha beta"): 10}
