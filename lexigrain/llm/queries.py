"""The registered queries of the operators here: each runs over its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import bpe, decontaminate, html_text, jaccard, labelled, line_dedup, quality, sharding, token_count, topk, toxicity

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Tokens above which a text counts as over the limit.
TOKEN_LIMIT = 512
SHARDS = 24
#: Scores from which a document counts as good, and as toxic.
QUALITY_FROM, TOXIC_FROM = 0.3, 0.5


# Every line's shortest run of 50 words that begins there and that ends there, as text; first occurrence stays.
OP3_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t
), w AS (
  SELECT *, greatest(1, len(regexp_split_to_array(trim(line, ' '), '[ \\t\\x0B\\f\\r]+'))) AS w FROM l
), q AS (
  SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS q FROM w
), p AS (
  SELECT *, q - w AS p FROM q
), f AS (
  SELECT *,
    string_agg(line, chr(10)) OVER fw AS ft, max(pos) OVER fw AS fe, max(q) OVER fw - p AS fn,
    string_agg(line, chr(10)) OVER bw AS bt, min(pos) OVER bw AS bs, q - min(p) OVER bw AS bn
  FROM p WINDOW fw AS (PARTITION BY doc_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
                bw AS (PARTITION BY doc_id ORDER BY q RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), c AS (
  SELECT doc_id, pos, line,
    CASE WHEN fn >= 50 AND (doc_id, pos) > min((doc_id, pos)) OVER (PARTITION BY ft, fn >= 50) THEN fe END AS fe,
    CASE WHEN bn >= 50 AND (doc_id, bs) > min((doc_id, bs)) OVER (PARTITION BY bt, bn >= 50) THEN bs END AS bs
  FROM f
), d AS (
  SELECT doc_id, pos, line,
    coalesce(max(fe) OVER (PARTITION BY doc_id ORDER BY pos) >= pos, false)
    OR coalesce(min(bs) OVER (PARTITION BY doc_id ORDER BY pos DESC) <= pos, false) AS gone
  FROM c
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, ws[k + 1 : k + 10] AS win, least(len(ws), 10) AS n FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - 9))) AS k FROM i WHERE len(ws) > 0)),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS k FROM d),
h AS (SELECT doc_id, k, item_id, n FROM (SELECT DISTINCT n FROM w) JOIN p ON k + n <= len(ws) JOIN w USING (n) WHERE ws[k + 1 : k + n] = win),
m AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN f USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k + 1 : k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 3))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of ids and decoded text."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), digests=True, ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of SHARDS by rendezvous of its doc_id, its slot there, and its shard if one more came.

    Under the law ``key`` groups of equal texts have no say: doc_id and the
    number of shards alone decide, so copies may stand in different shards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    weights = [1.0] * SHARDS
    out = sharding.with_slots(sharding.shard_records(rows, "doc_id", weights), "shard", ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.grown(F.col("doc_id"), weights).alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that later copies of repeated runs make up, and what is left of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, counts=("n_lines", "n_deleted"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside an occurrence of a benchmark window, and the items found."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, "vec_id", "embedding", 5)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.component_ids(table(spark, sf_dir, "documents"), size=4, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline  # the script beside the entry point, which the library does without

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    own = (op1_bpe, op2_sharding, op3_line_dedup, op4_decontamination, op5_token_count, op6_quality, op7_toxicity, op8_html_text, op9_top_k, op10_jaccard_join, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op3_line_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op9_top_k": OP9_SQL, "op10_jaccard_join": OP10_SQL}
