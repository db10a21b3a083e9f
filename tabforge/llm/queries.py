"""The registered queries of the corpus operators: each applies its operator to its whole table and digests the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import bpe, fingerprints, mixing, near_dedup, pii, quality, secrets, token_counts, toxicity, warc
from tabforge.llm.common import table, work_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_OF_DOCUMENT = 50256

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: DuckDB SQL of the queries that it can express.
ORACLES: dict[str, str] = {
    "op3_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), x AS (SELECT doc_id, n, UNNEST(s) AS g FROM s JOIN n USING (doc_id)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT links.b, r.c FROM r JOIN links ON r.id = links.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON doc_id = id""",
    "op4_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN holder <> page_id THEN holder END AS refers_to FROM p LEFT JOIN h USING (payload_digest)""",
}


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


#: Languages of the mixture and their shares of its tokens.
TARGETS = {"de": 0.14, "en": 0.60, "es": 0.12, "fr": 0.14}


def trusted(labels: DataFrame) -> DataFrame:
    """Labelled rows fit to learn a domain from: of good quality and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, domains = mixing.mixture(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")), TARGETS, keep=["doc_id", "source"])
    posterior = [F.coalesce(F.get("posterior", F.lit(domains.names.index(n))), F.lit(0.0)).alias(f"p_{n}") if n in domains.names else F.lit(0.0).alias(f"p_{n}") for n in sorted(TARGETS)]
    return mixed.select("doc_id", "source", "n_tokens", *posterior, "rate", "copies")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), work_path(spark, "archive"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_hits")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_counts.write_flat(table(spark, sf_dir, "documents"), path, TOKENIZER, END_OF_DOCUMENT)
    counts = token_counts.count_tokens(spark, path, END_OF_DOCUMENT)
    shard = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    return counts.select(shard.alias("shard"), "ordinal", "start", "n_tokens", "closed")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return out.select("doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_fingerprints": op1_fingerprints, "op2_mixing": op2_mixing, "op3_near_dedup": op3_near_dedup, "op4_warc": op4_warc, "op5_toxicity": op5_toxicity, "op6_pii": op6_pii, "op7_secrets": op7_secrets, "op8_bpe": op8_bpe, "op9_token_counts": op9_token_counts, "op10_quality": op10_quality}
