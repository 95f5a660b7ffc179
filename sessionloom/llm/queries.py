"""One query for each operator, over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_counts, chaining, hard_negatives, interpolation, minhash_bayes, mixture, perspectives, qgram_bands, quality_lines, repair_codec, secret_index
from . import topk_search, turn_repair
from .oracles import HARD_SQL, NEAR_SQL, PERSPECTIVES_SQL, QUALITY_SQL, REPAIR_SQL, TOP_SQL
from .registry import query, table, vocabulary

TOKEN_LIMIT = 2048
WORD_VOCABULARY = "word_bpe_49k.json"


@query("op1_interpolation")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    return interpolation.fit_and_score(table(spark, sf_dir, "documents"))


@query("op2_minhash_bayes", NEAR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes over 4-word shingles at a similarity of 0.8 or more."""
    return minhash_bayes.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query("op3_bpe_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return bpe_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), TOKEN_LIMIT)


@query("op4_perspectives", PERSPECTIVES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every seat; the mask as text ``start:end,..``."""
    rows = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return rows.withColumn("mask", F.array_join(spans, ","))


@query("op5_repair_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of the ids of every document, from the written shards."""
    return repair_codec.encoded_digests(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


@query("op6_qgram_bands")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with edits."""
    return qgram_bands.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_secret_index")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets of every document."""
    found = secret_index.scan(table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secret_index.BASE]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    own = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


@query("op8_quality_lines", QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, with the characters its passing lines hold."""
    return quality_lines.judged(table(spark, sf_dir, "documents")).drop("clean_text")


@query("op9_mixture")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixture.mixed_sizes(table(spark, sf_dir, "documents"))


@query("op10_chaining")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents repeat, each with its first holder."""
    return chaining.passages(table(spark, sf_dir, "documents"))


@query("op11_tiled_topk", TOP_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every fiftieth vector with all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, keep=5)


@query("op12_hard_negatives", HARD_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of every hundredth vector; every seventh label is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=5, low=80, high=100)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut off, repeated or given to the user by a checksum of their dialogue and number."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    told = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), told.alias("text"), F.explode(times).alias("copy")).drop("copy")


@query("op13_turn_repair", REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged dialogue; zeros where no turn is left."""
    turns = table(spark, sf_dir, "conversations")
    found = turn_repair.digests(turn_repair.edits(damaged(turns)))
    every = turns.select("conv_id").distinct()
    both = every.join(found.hint("merge"), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages."""
    return corpus_pipeline.run(spark, sf_dir)
