"""Exact duplicates against grouping by text, also where fingerprints collide and texts span many chunks."""

import hashlib
import random
from collections import defaultdict

import pytest

from terrace.llm import exact_dedup

SCHEMA = "doc_id long, text string, row string, chunk int, f0 string, turn int, keep_id string, kept int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in ids:
            out.append((i, keep, len(ids), bool(left and i == keep), digest))
            left -= left and i == keep
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", 0) for i, t in rows], SCHEMA)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("by", [exact_dedup.primes, lambda turn: (2, 3) if turn < 2 else exact_dedup.primes(turn)])
def test_equal_texts_form_groups(spark, by):
    draw = random.Random(5)
    texts = [None, "", " ", "a", "A", "É", "é", "\x00a", "a\x00", "b" * 1000, "B" * 1000, "b" * 999 + "c", "\U0001F600" * 50, "ab" * 40, "ba" * 40]
    texts += ["".join(draw.choice("abAB") for _ in range(draw.randrange(1, 5))) for _ in range(150)]
    texts += [draw.choice("xyXY") * 200 + draw.choice("pqPQ") * draw.randrange(1, 3) for _ in range(40)]
    rows = [*enumerate(texts), (None, "a"), (None, "alone"), (None, "alone"), (3, "a"), (170, "b" * 1000), (170, "b" * 1000)]
    assert found(exact_dedup.exact_duplicates(frame(spark, rows), chunk=64, by=by)) == expected(rows)


def test_one_group_holds_most_rows(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(3000)]
    assert found(exact_dedup.exact_duplicates(frame(spark, rows))) == expected(rows)
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def test_fingerprints_compose():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    by = exact_dedup.primes(0)
    assert all(p.bit_length() == 61 and exact_dedup._is_prime(p) for p in by)
    for size in (1, 7, 64, 4999, 5000):
        parts = [exact_dedup.residues(data[i:i + size], max(0, 5000 - i - size), by) for i in range(0, 5000, size)]
        assert tuple(sum(x) % p for x, p in zip(zip(*parts), by)) == exact_dedup.residues(data, 0, by)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(exact_dedup.exact_duplicates(docs, chunk=2048)) == expected(rows)
