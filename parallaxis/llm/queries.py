"""One query for each corpus operator, over all rows of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audio_features, text_payload, wav_of
from .linededup import dedup_lines
from .lm import lm_scores
from .mixing import mix_sources, word_count
from .neardup import near_duplicates
from .packing import pack
from .pii import find_pii
from .quality import repetition
from .runtime import documents, materialise
from .sharding import shard_rows
from .toxicity import fit, score


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as 8-bit sound: stored as WAV, read back, log-mel tensors and active spans."""
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), wav_of(text_payload(F.col("text"))).alias("media"))
    got = audio_features(docs)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_ms"].cast("string"), s["end_ms"].cast("string"))), ",")
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.sha2("tensors", 256), F.size("spans").cast("string"), F.substring(F.sha2(spans.cast("binary"), 256), 1, 16)).alias("feature"),
        "n_frames",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources weighted 5, 2, 1 takes of every document."""
    docs = documents(spark, sf_dir)
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")))
    mixed = mix_sources(sized, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under the automaton learnt from nine folds of ten."""
    got = lm_scores(documents(spark, sf_dir), fold(F.col("doc_id"), 10) != 0)
    return got.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text."""
    got = find_pii(documents(spark, sf_dir).select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    counts = [F.size(F.expr(f"filter(pii, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return got.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that each document is toxic, learnt from four folds of five of the labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    got = score(docs, weights)
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    got = pack(documents(spark, sf_dir))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "last", "padding")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of every document and whether it stays."""
    got = repetition(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_5gram_chars", "dup_10gram_chars")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines that repeat in the corpus."""
    got = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under a keyed permutation of row numbers."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    got = shard_rows(docs, 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id that links of three bits reach."""
    got = near_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_audio_features, op2_pareto_mix, op3_backoff_lm, op4_anchor_pii, op5_ftrl_toxicity, op6_concat_pack, op7_repetition, op8_fuzzy_lines, op9_feistel_shards, op10_simhash)
    return {f.__name__: f for f in made}


#: The mix as DuckDB computes it: the same draw by md5, the same shares, a plain running sum over each source.
PARETO_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
weighted AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM own),
shares AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM weighted),
targets AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (max(share) OVER ()) * weight) AS target FROM shares),
sizes AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
steps AS (
  SELECT source, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_words,
         (sum(size * n * floor(sqrt(size))::BIGINT) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM sizes),
rates AS (SELECT t.source, t.source_size, t.target, coalesce(max((t.target - (3 * s.full_words)::DOUBLE) / s.rest::DOUBLE), 0.0) AS rate
          FROM targets t LEFT JOIN steps s ON t.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
expected AS (SELECT d.*, r.source_size, r.target, least(3.0::DOUBLE, r.rate * floor(sqrt(d.size))) AS e FROM d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
split AS (SELECT *, floor(e)::BIGINT AS sure, e - floor(e) AS odd FROM expected),
ranked AS (SELECT *, CASE WHEN odd > 0 AND size > 0 THEN ((u / (1 - u)) / (odd / (1 - odd))) / (1 + (u / (1 - u)) / (odd / (1 - odd))) END AS rnk FROM split),
words_left AS (SELECT source, max(target) - sum(sure * size)::DOUBLE AS words FROM ranked GROUP BY source),
alike AS (SELECT source, rnk, sum(size) AS words FROM ranked WHERE rnk IS NOT NULL GROUP BY source, rnk),
run AS (SELECT source, rnk, (sum(words) OVER (PARTITION BY source ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE - words::DOUBLE / 2 AS middle FROM alike)
SELECT k.doc_id, k.size, k.source_size, k.target, ((k.sure + CASE WHEN run.middle <= words_left.words THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken
FROM ranked k
JOIN words_left ON k.source IS NOT DISTINCT FROM words_left.source
LEFT JOIN run ON k.source IS NOT DISTINCT FROM run.source AND k.rnk = run.rnk
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_pareto_mix": PARETO_MIX}
