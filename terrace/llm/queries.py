"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import (
    bpe_tree, collocations, embedding_dedup, exact_dedup, html_extract, minhash_dedup, packing, pii, quality_rules, secret_scan, token_counts, toxicity,
    whitening,
)
from terrace.llm.common import reachable


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf}/{table}.parquet")


def op1_token_counts(spark, sf):
    return token_counts.count_tokens(_read(spark, sf, "documents"))


def op2_quality_rules(spark, sf):
    return quality_rules.quality(_read(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op3_embedding_dedup(spark, sf):
    return embedding_dedup.near_duplicates(_read(spark, sf, "embeddings"))


def op4_html_extraction(spark, sf):
    return html_extract.extract(_read(spark, sf, "pages"))


def op5_minhash_dedup(spark, sf):
    return minhash_dedup.near_duplicates(_read(spark, sf, "documents"), words=2)


def op6_secret_scan(spark, sf):
    return secret_scan.digest(secret_scan.scan(_read(spark, sf, "documents").select("doc_id", "text")))


def op7_best_fit_packing(spark, sf):
    return packing.pack(_read(spark, sf, "documents"))


def op8_toxicity(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_pii(spark, sf):
    return pii.digest(pii.scan(_read(spark, sf, "documents").select("doc_id", "text")))


def op10_bpe_roundtrip(spark, sf):
    return bpe_tree.encode_decode(_read(spark, sf, "documents"))


def op11_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(_read(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_embedding_whitening(spark, sf):
    return whitening.whiten(_read(spark, sf, "embeddings"))


def op13_phrase_collocations(spark, sf):
    return collocations.collocations(_read(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_quality_rules, op3_embedding_dedup, op4_html_extraction, op5_minhash_dedup, op6_secret_scan,
    op7_best_fit_packing, op8_toxicity, op9_pii, op10_bpe_roundtrip,
    op11_exact_dedup, op12_embedding_whitening, op13_phrase_collocations,
)}

ORACLE = {
    # Exact cosines of all pairs of a label, and the components they span.
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), valid AS (
            SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(c.n, 0) AS n_links, f.component_id, e.vec_id = f.component_id AS kept
        FROM embeddings e JOIN found f ON e.vec_id = f.a LEFT JOIN counts c ON e.vec_id = c.a""",
    # Exact Jaccard similarity of all pairs that share a shingle, and the components they span.
    "op5_minhash_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
                ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w
        ), sets AS (SELECT min(doc_id) AS doc_id, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
        items AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS item FROM sets),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b
                ON a.item = b.item AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM sets
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), found AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(f.root, s.doc_id) AS component_id, s.doc_id = coalesce(f.root, s.doc_id) AS kept
        FROM s LEFT JOIN sets t ON list_sort(s.shingles) = t.shingles LEFT JOIN found f ON t.doc_id = f.a""",
    "op11_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op13_phrase_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ), words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        found AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
        ), f AS (SELECT lang, k, phrase, count(*) AS c FROM found GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        cuts AS (
            SELECT lang, k, phrase, c AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head,
                array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND c >= 10)
        ), cut_scores AS (
            SELECT c.*, x.c AS l, y.c AS r, CAST((1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS BIGINT) AS score
            FROM cuts c JOIN f x ON c.lang = x.lang AND c.head = x.phrase AND x.k = c.cut JOIN f y ON c.lang = y.lang AND c.tail = y.phrase AND y.k = c.k - c.cut
        ), scored AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        covered AS (
            SELECT s.lang, s.phrase FROM scored s JOIN scored t ON s.lang = t.lang AND s.k = 2 AND t.k = 3 AND 100 * t.a >= 50 * s.a
                AND s.phrase IN (array_to_string(string_split(t.phrase, ' ')[1:2], ' '), array_to_string(string_split(t.phrase, ' ')[2:3], ' '))
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored ANTI JOIN covered USING (lang, phrase)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
