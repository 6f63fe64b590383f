"""Spans, overlaps and redaction against plain Python; many matches in one text; names that operators use inside."""

import random
import time

from pyspark.sql import functions as F

from terrace.llm import pii, quality_rules, secret_scan
from terrace.llm.spans import BLOCK, SPAN, apart, blocks, cut, redacted, running


def test_running_results(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 63, 64, 65, 1000)]
    rows = spark.createDataFrame([(x,) for x in lists], "v array<int>")
    got = rows.select("v", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.v[:i + 1]) for i in range(len(r.v))]
        assert r.m == [max(r.v[:i + 1]) for i in range(len(r.v))]


def test_parts_of_blocks(spark):
    text = "".join(chr(c) for c in ([0x61, 0x4E2D, 0x1F600, 0x0A] * 300))
    places = [(0, 0), (0, 5), (BLOCK - 2, BLOCK + 3), (BLOCK, BLOCK), (10, 3 * BLOCK + 1), (1190, 1200), (1199, 1300), (1200, 1201), (1300, 1301)]
    rows = spark.createDataFrame([(text, s, e) for s, e in places], "t string, s int, e int").select("*", blocks(F.col("t")).alias("b"))
    for r in rows.select("s", "e", cut(F.col("b"), F.col("s"), F.col("e")).alias("x")).collect():
        assert r.x == text[r.s:r.e]


def test_overlaps_and_redaction_equal_plain_python(spark):
    rng = random.Random(9)

    def made(size, n):
        out = set()
        for _ in range(n):
            s = rng.randrange(size)
            out.add((s, rng.randrange(3), min(size, s + 1 + rng.randrange(12)), rng.choice("ab"), ""))
        return sorted(out)

    cases = [("".join(rng.choice("xyé中") for _ in range(size)), made(size, n), made(size, m))
             for size, n, m in [(10, 0, 0), (10, 3, 0), (10, 0, 3), (300, 20, 20), (1000, 60, 40), (1000, 1, 50), (600, 50, 1), (64, 9, 2)] for _ in range(5)]
    rows = spark.createDataFrame(cases, f"t string, x array<{SPAN}>, y array<{SPAN}>")
    got = rows.select("t", "x", "y", apart(F.col("x"), F.col("y")).alias("free"), redacted(F.col("t"), F.col("x")).alias("clean")).collect()
    for r in got:
        assert [tuple(a) for a in r.free] == [tuple(a) for a in r.x if not any(b.s < a.e and a.s < b.e for b in r.y)]
        want, at = "", 0
        for a in r.x:
            if a.s >= at:
                want += r.t[at:a.s] + f"[{a.kind}]"
            at = max(at, a.e)
        assert r.clean == want + r.t[at:]


def test_many_matches_in_one_text(spark):
    n = 50_000
    text = "".join(f"token=abcd{i:06d}\n" for i in range(n)) + "".join(f"555-123-{i % 10_000:04d}\n" for i in range(n))
    rows = spark.createDataFrame([(text,)], "text string")
    begin = time.time()
    secrets = secret_scan.scan(rows, redact=True).selectExpr("size(base) as n", "text").first()
    personal = pii.scan(rows).selectExpr("size(base) as n", "size(filter(spans, x -> x.kind = 'telephone')) as more").first()
    # By the square of the matches this took many minutes.
    assert time.time() - begin < 120
    assert secrets.n == n and secrets.text.count("[assign]") == n and "abcd" not in secrets.text
    assert personal.n == 0 and personal.more == n


def test_columns_may_have_any_name(spark):
    names = ["hex", "raw", "good", "weak", "loose", "assign", "access", "score", "_text", "_row", "_key", "_words", "_lines", "in_0", "a.b"]
    rows = spark.createDataFrame([(1, "token=abcdefgh and a@b.cd", *names), (None, None, *names)], ["doc_id", "text", *names])
    for got in (secret_scan.scan(rows), pii.scan(rows), secret_scan.scan(rows, redact=True), pii.scan(rows, redact=True), quality_rules.quality(rows)):
        back = got.collect()
        assert len(back) == 2 and set(names) < set(got.columns)
        assert all(tuple(r[got.columns.index(name)] for name in names) == tuple(names) for r in back)


def test_overlapping_parts_do_not_complement_each_other(spark):
    texts = ["see https://docs.example.com/document/d/1A2b3C4d5E6f7G8h9I0jKlMnOpQrStUvWx/edit", "https://img.example.com/9f8E7d6C5b4A39281706fEdCbA.png",
             "https://api.example.com key aB3dE6gH9jK2mN5pQ8sT1v user=bob"]
    got = secret_scan.digest(secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.spans for r in got[:2]] == ["", ""]
    assert {x.split(":")[0] for x in got[2].spans.split(",")} == {"endpoint", "mixed", "identifier"}


def test_texts_above_a_leaf_go_through_the_tree():
    from terrace.llm.bpe_tree import LEAF, Tree, multi_vocabulary
    from terrace.llm.common import Encoder

    encoder = Encoder.of(**multi_vocabulary())
    tree, seams = Tree(encoder), []
    joined = tree._join
    tree._join = lambda *node: seams.append(node[1:4]) or joined(*node)
    for text in ("a" * (LEAF + 1), "some words and 12345 numbers, don't stop\n\n\n  here " * 5, "中文没有空格的长文本" * 40, " " * 300 + "x", "Zz9" * 400):
        before = len(seams)
        assert tree.encode(text) == encoder.exact.encode_ordinary(text)
        assert len(seams) - before >= len(text) // LEAF
        assert tree.decode(tree.encode(text)).decode() == text
    assert LEAF <= 64
