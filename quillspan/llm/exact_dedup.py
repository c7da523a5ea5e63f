"""Exact duplicates: rows grouped by a 128-bit content hash, with the bytes compared inside each group.

Only built-in functions. The grouping key is the hash together with the bytes, so equal hashes of
different texts stay apart; map-side combining sends one row per distinct text and task, which keeps
a group that holds a third of all rows from meeting in one task. The way back to the rows joins
on hashes alone, never on texts, and a skewed group there is split by adaptive execution.

Defined results: a null text counts as empty; a null id never outranks another id, and a group of
null ids alone has a null keeper; rows that repeat the keeper's id share its answer; an empty table
gives an empty result; columns beyond the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import LOWER, UPPER, ascii_lower


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    hashed = lambda df: df.withColumns({"key": F.md5("norm"), "text_sha256": F.sha2("norm", 256)})
    groups = (
        hashed(keyed.withColumn("key", F.md5("norm")).groupBy("key", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        .select("key", "text_sha256", "keep_id", "group_size")
    )
    rows = hashed(keyed).drop("norm")
    return rows.join(groups, ["key", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay; of fully repeated rows all stay."""
    stays = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_h")).distinct()
    norm = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_id"]) & (F.sha2(norm, 256) == stays["_h"]), "left_semi")


SQL = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size,
       doc_id is not distinct from max(doc_id) over w kept, sha256(t) text_sha256
from d window w as (partition by t)
"""
