"""The registered ``opN_*`` queries and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import (bpe, collocations, exact_dedup, langid, licenses, mixture, packing, quality,
                        ranked, simhash, tokcount, topk, warc)
from tarmac.llm.common import crc_bucket, read_table, ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best integer inner products of every 100th embedding."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, read_table(spark, sf_dir, "labels"))


def quality_held_out() -> Column:
    return crc_bucket(F.col("doc_id"), 5) == 0


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.score(docs, quality.fit(docs, labels, ~quality_held_out()), quality_held_out())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's BPE ids and of their decoded text."""
    return bpe.digests(bpe.encode(read_table(spark, sf_dir, "documents"), decoded=True))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives, read back through the merged index."""
    return warc.capture_index(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License mentions of every document."""
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return tokcount.token_counts(read_table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return predict_language(read_table(spark, sf_dir, "documents"))


def language_held_out() -> Column:
    return crc_bucket(F.col("doc_id"), 3) == 1


def predict_language(docs: DataFrame) -> DataFrame:
    return langid.predict(docs, langid.fit(docs, ~language_held_out()), language_held_out())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal normalised text."""
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints link at 3 bits or fewer."""
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op11_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return collocations.top(collocations.collocations(read_table(spark, sf_dir, "documents")))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens that hold the mixture of sources."""
    return mixture.pack(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _registered(op: QueryFn) -> QueryFn:
    @wraps(op)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return op(spark, sf_dir)

    return run


def queries() -> dict[str, QueryFn]:
    ops = [op1_topk, op2_quality, op3_bpe, op4_warc, op5_packing, op6_licenses, op7_token_counts,
           op8_langid, op9_exact_dedup, op10_simhash, op11_nra, op12_collocations,
           op13_mixture, pipeline]
    return {f.__name__: _registered(f) for f in ops}


_TOPK_SQL = """
WITH vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM vec q JOIN vec d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored) WHERE rank <= 10
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, ''))::BIGINT AS payload_bytes
  FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM k
"""

_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""

# words of a document; spans of one to seven consecutive words, of lengths that allow a match;
# characters outside ASCII become one byte, as the distance function counts bytes
_LICENSE_SQL = r"""
WITH phrase(phrase, label, edits) AS (
  VALUES ('gnu general public license', 'gpl', 3), ('apache license', 'apache', 2),
         ('cc by', 'cc-by', 0), ('mit license', 'mit', 1)
), doc AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), word AS (
  SELECT doc_id, unnest(range(len(w))) AS i, regexp_replace(unnest(w), '[^\x00-\x7F]', '~', 'g') AS t
  FROM doc
), ahead AS (
  SELECT doc_id, i, t, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(t, 3) OVER d AS t3,
         lead(t, 4) OVER d AS t4, lead(t, 5) OVER d AS t5, lead(t, 6) OVER d AS t6
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), span AS (
  SELECT doc_id, i, unnest([t, t || ' ' || t1, t || ' ' || t1 || ' ' || t2,
    t || ' ' || t1 || ' ' || t2 || ' ' || t3, t || ' ' || t1 || ' ' || t2 || ' ' || t3 || ' ' || t4,
    t || ' ' || t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 || ' ' || t5,
    t || ' ' || t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 || ' ' || t5 || ' ' || t6]) AS s
  FROM ahead
), hit AS (
  SELECT doc_id, i, label, s = phrase AS exact, 1 - levenshtein(s, phrase) / length(phrase) AS score
  FROM (SELECT * FROM span WHERE length(s) BETWEEN 5 AND 29) AS span
  JOIN phrase ON length(s) BETWEEN length(phrase) - edits AND length(phrase) + edits
  WHERE levenshtein(s, phrase) <= edits
), per AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(i) FILTER (exact) AS first_word,
         max(i) FILTER (exact) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score
  FROM hit GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN per USING (doc_id)
"""

_RANKED_SQL = r"""
WITH term AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc AS (
  SELECT row_number() OVER () AS d, doc_id, w, len(w)::BIGINT AS n FROM term WHERE len(w) > 0
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM doc
), tf AS (
  SELECT d, t, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS t FROM doc) AS words GROUP BY d, t
), weight AS (
  SELECT t, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY t, n_docs
), item AS (
  SELECT i, item_id, unnest(list_distinct(w)) AS t FROM (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM benchmark) AS texts
), scored AS (
  SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
         sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))))::BIGINT AS score
  FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN doc USING (d), whole GROUP BY i, d
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10
"""

# words of a piece as a list; every run of one to five of them
_PHRASE_SQL = r"""
WITH text AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), piece AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM text
), gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece) AS p, range(1, 6) AS t(k)
  WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 100
), whole AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM piece GROUP BY lang
), cand AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), part AS (
  SELECT lang, k, phrase, f, w, unnest(range(1, k)) AS cut FROM cand
), scored AS (
  SELECT part.*, x.f AS l, y.f AS r, n, (1000 * part.f * n) // (x.f * y.f) AS score
  FROM part
  JOIN f AS x ON x.lang = part.lang AND x.k = cut AND x.phrase = array_to_string(part.w[1:cut], ' ')
  JOIN f AS y ON y.lang = part.lang AND y.k = part.k - cut AND y.phrase = array_to_string(part.w[cut + 1:], ' ')
  JOIN whole ON whole.lang = part.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, k, f, w, size, unnest(range(1, k - size + 2)) AS i
        FROM cand, range(2, 5) AS t(size) WHERE size < k) AS sub
  GROUP BY ALL
)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.f DESC, best.phrase) AS rank,
       best.phrase, best.f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.size = best.k AND inside.phrase = best.phrase
WHERE inside.f IS NULL OR 100 * inside.f < 100 * best.f
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOPK_SQL, "op4_warc": _WARC_SQL, "op6_licenses": _LICENSE_SQL,
            "op9_exact_dedup": _DEDUP_SQL, "op11_nra": _RANKED_SQL,
            "op12_collocations": _PHRASE_SQL}
