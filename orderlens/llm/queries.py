"""The numbered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import bpe, chaining, crosstok, graph_ann, imatch, langid, linededup, mixing, nearhash, quality, ranked, setjoin, warc
from orderlens.session import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = warc.records_of(_read(spark, sf_dir, "pages"), "page_id", "url", "html")
    warc.write_archives(warc.mark_revisits(pages, min_bytes=0), path)
    return warc.resolve(warc.read_archives(spark, path, payloads=False)).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality.judge(docs, labels, F.col("source"), quality.source_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return mixing.mix_documents(docs, labels, {"good": 0.93, "toxic": 0.02, "poor": 0.05}).drop("text_hash")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by doc_id: the document that repeats a passage, and the smaller one it shares it with."""
    names = {"doc_b": "doc_id", "start_b": "start", "end_b": "end", "doc_a": "other_doc_id", "start_a": "other_start", "end_a": "other_end"}
    found = chaining.repeated_passages(_read(spark, sf_dir, "documents"))
    return found.select(*[F.col(c).alias(n) for c, n in names.items()], "equal_words", "identity")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearhash.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(bpe.decode(bpe.encode(docs, ranks), ranks)).drop("ids", "decoded")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (crosstok.read_file(spark, public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return crosstok.alignment(_read(spark, sf_dir, "documents"), a, b)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=20)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(_read(spark, sf_dir, "documents"), k=4, percent=85).drop("class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_passages": op4_passages,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_nearest": op9_nearest,
    "op10_imatch": op10_imatch,
    "op11_token_alignment": op11_token_alignment,
    "op12_ranked_search": op12_ranked_search,
    "op13_jaccard_join": op13_jaccard_join,
}

_OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, coalesce(s.first_doc < k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP1_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p
), t AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '')
           AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first_page
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM t
"""

_OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 1),
                  lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS shingle
  FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
), common_sets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), named AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM named LEFT JOIN n USING (doc_id)
"""

_OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 2),
                  lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END)) AS shingle
  FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
), common_sets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), named AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id
FROM named LEFT JOIN n USING (doc_id)
"""

_OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark
), total AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), tf AS (
  SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM d)
  GROUP BY r, doc_id, len(terms), term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), score AS (
  SELECT item_id, r, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SQL: dict[str, str] = {
    "op12_ranked_search": _OP12_SQL,
    "op13_jaccard_join": _OP13_SQL,
    "op1_warc_revisits": _OP1_SQL,
    "op5_near_duplicates": _OP5_SQL,
    "op7_line_dedup": _OP7_SQL,
}
