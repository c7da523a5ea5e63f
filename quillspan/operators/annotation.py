"""Annotation workflow: voting, conflicts and agreement between annotators.

Entities have task, annotator, ord, start, end, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.operators.spans import iou


def majority(entities: DataFrame, min_agree: int = 2) -> DataFrame:
    """(task, start, end, label, votes) with at least ``min_agree`` votes; an annotator's repeats count."""
    return entities.groupBy("task", "start", "end", "label").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= min_agree)


def majority_of_annotators(entities: DataFrame) -> DataFrame:
    """Exact spans that more than half of a task's annotators have."""
    n = entities.groupBy("task").agg(F.countDistinct("annotator").alias("n"))
    votes = entities.groupBy("task", "start", "end", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.join(n, "task").where(F.col("votes") >= F.floor(F.col("n") / 2) + 1).drop("n")


def conflicts(entities: DataFrame) -> DataFrame:
    """Pairs of overlapping spans of a task with different labels, each pair once."""
    side = lambda k: entities.select("task", *(F.col(c).alias(f"{c}_{k}") for c in ("annotator", "ord", "start", "end", "label")))
    met = side("a").join(side("b"), "task").where("struct(annotator_a, ord_a) < struct(annotator_b, ord_b) and label_a <> label_b and start_a < end_b and end_a > start_b")
    return met.select("task", F.col("annotator_a").alias("ann_a"), "ord_a", F.col("annotator_b").alias("ann_b"), "ord_b")


def pairs(entities: DataFrame) -> DataFrame:
    """All pairs of spans of two annotators of a task, with ``iou``: a1 < a2."""
    side = lambda k: entities.select("task", *(F.col(c).alias(f"{c}{k}") for c in ("annotator", "ord", "start", "end", "label")))
    met = side(1).join(side(2), "task").where("annotator1 < annotator2")
    return met.withColumn("iou", iou(F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2")))


def pairwise_agreement(entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of all span pairs of two annotators that overlap enough, labels ignored."""
    return pairs(entities).groupBy("annotator1", "annotator2").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("iou") >= threshold).cast("double")).alias("agreement"))


def _matched(entities: DataFrame, threshold: float, seen: DataFrame | None) -> DataFrame:
    """Per task and pair of annotators who saw it: n1, n2, m, the left spans with a match of the same label, and met, the matching pairs of spans."""
    who = entities.select("task", "annotator")
    who = (who if seen is None else who.unionByName(seen.select("task", "annotator"))).distinct()
    counts = who.join(entities.groupBy("task", "annotator").agg(F.count(F.lit(1)).alias("n")), ["task", "annotator"], "left").fillna(0, ["n"])
    a = counts.select("task", F.col("annotator").alias("annotator1"), F.col("n").alias("n1"))
    b = counts.select("task", F.col("annotator").alias("annotator2"), F.col("n").alias("n2"))
    both = a.join(b, "task").where("annotator1 < annotator2")
    hit = pairs(entities).where((F.col("iou") >= threshold) & (F.col("label1") == F.col("label2"))).groupBy("task", "annotator1", "annotator2", "ord1").agg(F.count(F.lit(1)).alias("k"))
    m = hit.groupBy("task", "annotator1", "annotator2").agg(F.count(F.lit(1)).alias("m"), F.sum("k").alias("met"))
    return both.join(m, ["task", "annotator1", "annotator2"], "left").fillna(0, ["m", "met"])


def agreement_jaccard(entities: DataFrame, threshold: float = 0.5, seen: DataFrame | None = None) -> DataFrame:
    """Mean, lowest and highest of matches over the union of two annotators' spans; 1 for a task where both found nothing.

    ``seen`` (task, annotator) says who saw which task; without it, an annotator saw the tasks with spans of theirs.
    """
    union = F.col("n1") + F.col("n2") - F.col("m")
    score = F.when(union > 0, F.col("m") / union).otherwise(F.lit(1.0))
    return _matched(entities, threshold, seen).groupBy("annotator1", "annotator2").agg(F.avg(score).alias("mean_"), F.min(score).alias("min_"), F.max(score).alias("max_"))


def agreement_dice(entities: DataFrame, threshold: float = 0.5, seen: DataFrame | None = None) -> DataFrame:
    """Mean of twice the matches over both annotators' spans; 0 for a task where both found nothing; ``seen`` as for Jaccard."""
    total = F.col("n1") + F.col("n2")
    score = F.when(total > 0, 2 * F.col("m") / total).otherwise(F.lit(0.0))
    return _matched(entities, threshold, seen).groupBy("annotator1", "annotator2").agg(F.avg(score).alias("dice"))


def kappa(entities: DataFrame, threshold: float = 0.5, expected: float = 0.33, seen: DataFrame | None = None) -> DataFrame:
    """Agreement over chance with a constant chance, and its band, over the tasks that both annotators saw; no match is an agreement of 0."""
    sums = _matched(entities, threshold, seen).groupBy("annotator1", "annotator2").agg(F.sum(F.col("n1") + F.col("n2")).alias("total"), F.sum("met").alias("met"))
    observed = F.when(F.col("total") > 0, 2 * F.col("met") / F.col("total")).otherwise(F.lit(0.0))
    value = (observed - expected) / (1 - expected)
    band = F.when(value >= 0.8, "excellent").when(value >= 0.6, "good").when(value >= 0.4, "moderate").otherwise("poor")
    return sums.select("annotator1", "annotator2", value.alias("kappa"), band.alias("band"))


def consensus_iou(entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans that more than half of a task's annotators support by overlap, one per (start, end, label)."""
    n = entities.groupBy("task").agg(F.countDistinct("annotator").alias("n"))
    a = entities.select("task", "start", "end", "label").distinct()
    b = entities.select(F.col("task").alias("task2"), "annotator", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("label").alias("l2"))
    alike = F.when(F.col("label") == F.col("l2"), iou(F.col("start"), F.col("end"), F.col("s2"), F.col("e2"))).otherwise(F.lit(-1.0))  # as part of the value, labels are no join key: both sides are dealt by task already
    met = a.join(b, (F.col("task") == F.col("task2")) & (alike >= threshold))
    votes = met.groupBy("task", "start", "end", "label").agg(F.countDistinct("annotator").alias("votes"))
    return votes.join(n, "task").where(F.col("votes") > F.col("n") / 2).drop("n")


def annotator_stats(entities: DataFrame) -> DataFrame:
    """Per annotator: spans, mean length, share of symptoms, and whether the span count stands apart from the others by more than the tasks."""
    symptom = (F.col("label") == "SYMPTOM").cast("double")
    got = entities.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_spans"), F.avg(F.col("end") - F.col("start")).alias("mean_length"), F.avg(symptom).alias("symptom_share"))
    span = got.agg((F.max("n_spans") - F.min("n_spans")).alias("gap"), (F.max("mean_length") - F.min("mean_length")).alias("length_gap"))
    tasks = entities.agg(F.countDistinct("task").alias("n_tasks"))
    out = got.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(tasks))
    return out.select("annotator", "n_spans", "mean_length", "symptom_share", (F.col("gap") > F.col("n_tasks")).alias("count_flag"), (F.col("length_gap") > 5).alias("length_flag"))


def coverage(entities: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks with a symptom, with a product, and with neither: counts."""
    has = lambda v: F.max((F.col("label") == v).cast("int"))
    by = entities.groupBy("task").agg(has("SYMPTOM").alias("s"), has("PRODUCT").alias("p"))
    out = tasks.select("task").distinct().join(by, "task", "left").fillna(0)
    return out.agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("s") == 1).alias("with_symptom"), F.count_if(F.col("p") == 1).alias("with_product"), F.count_if((F.col("s") == 0) & (F.col("p") == 0)).alias("with_none"))


def change_beyond(now: Column, before: Column, share: float) -> Column:
    """Relative change above ``share``; false without a base."""
    return F.coalesce((before > 0) & (F.abs(now - before) / before > share), F.lit(False))
