"""Binning, stratified sampling and batch preparation.

Records have id and the sizes they are binned by. Samples are taken in the order of a seeded hash, so that the same seed
gives the same sample on any partitioning; sizes follow the shares of the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def equal_width(df: DataFrame, value: Column, names: tuple[str, ...], zero: str | None = None) -> DataFrame:
    """``df`` with ``bin``: equal widths between the lowest and highest value; ``all`` if they are equal; ``zero`` names the value 0."""
    edges = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    df = df.crossJoin(F.broadcast(edges))
    k = len(names)
    at = F.least(F.floor((value - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / k)), F.lit(k - 1)).cast("int")
    name = F.when(F.col("_lo") == F.col("_hi"), F.lit("all")).otherwise(F.get(F.array(*map(F.lit, names)), at))
    return df.withColumn("bin", F.when(value == 0, F.lit(zero)).otherwise(name) if zero else name).drop("_lo", "_hi")


def _order(df: DataFrame, id_col: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]


def quotas(df: DataFrame, n: int) -> DataFrame:
    """bin, size, take: the share of ``n``, one at least, the bin's size at most; all if there are no more than ``n``."""
    sizes = df.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(total))
    share = F.least("size", F.greatest(F.lit(1), F.floor(F.lit(n) * (F.col("size") / F.col("total")))))
    return sizes.select("bin", "size", F.when(F.col("total") <= n, F.col("size")).otherwise(share).alias("take"), "total")


def sample_stratified(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """About ``n`` rows by the shares of the bins, too many cut back, too few topped up from the largest bin alone.

    Ranks are kept for the first ``n`` of each bin only (a grouped limit runs before rows meet), so a large bin does not meet whole.
    """
    q = quotas(df, n)
    by_hash = _order(df, id_col, seed)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("bin").orderBy(*by_hash))).where(F.col("_r") <= n)
    largest = q.orderBy(F.desc("size"), "bin").limit(1).select(F.col("bin").alias("_top"))
    missing = q.agg((F.lit(n) - F.sum("take")).alias("_miss"))
    joined = ranked.join(F.broadcast(q.drop("size")), "bin").crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(missing))
    extra = F.when((F.col("bin") == F.col("_top")) & (F.col("total") > n), F.greatest(F.col("_miss"), F.lit(0))).otherwise(0)
    return joined.where(F.col("_r") <= F.col("take") + extra).orderBy(*by_hash).limit(n).drop("_r", "_top", "_miss", "take", "total")


def prepare_batch(records: DataFrame, n: int, batch_id: str, timestamp: str, seed: int = 42, min_length: int = 20, min_spans: int = 0, max_length: int | None = None) -> DataFrame:
    """Filter, bin by length, sample, and number the tasks. Records have id, text, n_spans."""
    size = F.length("text")
    good = records.where((size >= min_length) & (F.col("n_spans") >= min_spans) & (F.lit(not max_length) | (size <= (max_length or 0))))
    binned = equal_width(good, F.length("text"), ("short", "medium", "long"))
    sample = sample_stratified(binned, n, seed)
    number = F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id"))  # at most n rows
    return sample.select("id", "text", "n_spans", "bin", F.lit(batch_id).alias("batch_id"), F.lit(timestamp).alias("prepared_at"), number.alias("task_number"))
