"""Operators on spans: overlap, filters, validation, tagging. Spans are half-open intervals of code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.functions import constants as K


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    shared = overlap(s1, e1, s2, e2)
    return F.when(shared > 0, shared / ((e1 - s1) + (e2 - s2) - shared)).otherwise(F.lit(0.0))


def filter_overlaps(spans: Column, strategy: str) -> Column:
    """An array of span structs without overlaps as the given strategy sees them.

    Spans are taken by start; only the first kept span that overlaps decides, and a winner
    replaces it without being held against the others.
    """
    wins = {
        "longest": lambda new, old: (new["end"] - new["start"]) > (old["end"] - old["start"]),
        "highest_confidence": lambda new, old: new["confidence"] > old["confidence"],
        "first": lambda new, old: F.lit(False),
    }
    if strategy not in wins:
        raise ValueError(f"unknown strategy: {strategy}")
    won = wins[strategy]

    def step(acc: Column, s: Column) -> Column:
        hit = F.filter(F.transform(acc, lambda k, i: F.when((s["start"] < k["end"]) & (s["end"] > k["start"]), i)), lambda i: i.isNotNull())
        at = F.get(hit, 0)
        old = F.get(acc, at)
        without = F.filter(acc, lambda k, i: i != at)
        return F.when(at.isNull(), F.concat(acc, F.array(s))).when(won(s, old), F.concat(without, F.array(s))).otherwise(acc)

    ordered = F.array_sort(spans)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def is_aligned(text: Column, start: Column, end: Column, span_text: Column) -> Column:
    """Inside the text, not empty, and equal to what the text has there."""
    inside = (F.length(text) > 0) & (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == span_text), F.lit(False))


def record_issues(text: Column, spans: Column) -> Column:
    """Messages of a record; an empty array is a valid record."""
    of_span = F.transform(
        spans,
        lambda s, i: F.when(s["start"].isNull() | s["end"].isNull(), F.format_string("span %d: missing position", i))
        .when((s["start"] < 0) | (s["end"] > F.length(text)) | (s["start"] >= s["end"]), F.format_string("span %d: invalid position", i))
        .when(F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["text"], F.format_string("span %d: text mismatch", i)),
    )
    whole = F.array(
        F.when(text.isNull() | (F.length(text) == 0), F.lit("missing text")),
        F.when(spans.isNull(), F.lit("spans is not a list")),
        F.when((F.length(text) > 0) & (F.length(text) < 20), F.lit("text too short")),
        F.when(F.length(text) > 5000, F.lit("text too long")),
    )
    return F.array_compact(F.concat(whole, F.coalesce(of_span, F.array().cast("array<string>"))))


def ingest_stats(docs: DataFrame, spans: DataFrame, min_spans: int = 1, limit: int | None = None) -> DataFrame:
    """One row of nine counters over records (doc_id, text) and their spans (doc_id, start, end, label, text).

    A record without text is skipped, then one with fewer than ``min_spans`` spans, then one with issues; spans are counted over the rest.
    """
    docs = docs.select("doc_id", "text")
    docs = docs if limit is None else docs.limit(limit)
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "text")).alias("spans"))
    return ingest_counters(docs.join(listed, "doc_id", "left"), min_spans)


def ingest_counters(records: DataFrame, min_spans: int = 1) -> DataFrame:
    """The counters of ``ingest_stats`` over records (text, spans) with their spans in place, null for none."""
    rows = records.withColumn("spans", F.coalesce("spans", F.array().cast(records.schema["spans"].dataType)))
    text, n = F.col("text"), F.size("spans")
    status = F.when(F.coalesce(text, F.lit("")) == "", "no_text").when(n < min_spans, "no_spans").when(F.size(record_issues(text, F.col("spans"))) > 0, "invalid").otherwise("successful")
    of = lambda label: F.size(F.filter("spans", lambda x: x["label"] == label))
    rows = rows.select(status.alias("status"), n.alias("n"), of("SYMPTOM").alias("s"), of("PRODUCT").alias("p"))
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("status") == "successful", F.col(c))), F.lit(0)).cast("long")
    named = {"no_text": "skipped_no_text", "no_spans": "skipped_no_spans", "invalid": "validation_failed", "successful": "successful"}
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col("status") == k).alias(v) for k, v in named.items()),
        kept("n").alias("total_spans"), kept("s").alias("symptom_spans"), kept("p").alias("product_spans"),
    )


def bio_tags(tokens: Column, entities: Column, mode: str = "reference") -> Column:
    """One tag per token. ``reference``: B- unless an earlier entity tagged the token; ``bio``: B- on an entity's first token only."""
    inside = lambda t, e: (t["start"] >= e["start"]) & (t["end"] <= e["end"])
    known = lambda e: e["label"].isin("SYMPTOM", "PRODUCT")
    if mode == "bio":
        first = lambda t, e: t["start"] == e["start"]
    else:
        first = None

    def of(t: Column) -> Column:
        def step(tag: Column, e: Column) -> Column:
            begins = first(t, e) if first else tag == "O"
            return F.when(inside(t, e), F.when(known(e), F.concat(F.when(begins, F.lit("B-")).otherwise(F.lit("I-")), e["label"])).otherwise(F.lit("O"))).otherwise(tag)

        return F.aggregate(entities, F.lit("O"), step)

    return F.transform(tokens, of)


def uncertain(spans: DataFrame) -> DataFrame:
    score = F.coalesce("confidence", F.lit(1.0))
    return spans.where((score >= K.UNCERTAIN_LOW) & (score <= K.UNCERTAIN_HIGH))


def first_annotation(tasks: DataFrame, labels: tuple[str, ...] = ("SYMPTOM", "PRODUCT")) -> DataFrame:
    """Entities of the first annotation of each task, in order of start."""
    rows = tasks.select("id", F.posexplode(F.get("annotations", 0)["result"]).alias("nth", "r"))
    v = F.col("r.value")
    rows = rows.select("id", "nth", v["start"].alias("start"), v["end"].alias("end"), v["text"].alias("span_text"), F.get(v["labels"], 0).alias("label"))
    return rows.where("start is not null and end is not null and span_text is not null and start < end").where(F.col("label").isin(*labels))


def gold_errors(records: DataFrame) -> DataFrame:
    """line, entity, error of records (line, text, entities of start, end, text, label); entity is null where a record lacks a field.

    An entity may have several errors. The text is compared with the slice that Python would take.
    """
    n = F.length("text")
    place = lambda k: F.when(k < 0, F.greatest(n + k, F.lit(0))).otherwise(F.least(k, n))
    rows = records.select("line", "text", F.col("entities").isNull().alias("bare"), F.posexplode_outer("entities").alias("entity", "e"))
    missing = F.col("text").isNull() | F.col("bare")
    start, end = place(F.col("e.start")), place(F.col("e.end"))
    cut = F.when(end > start, F.substring("text", start + 1, end - start)).otherwise("")
    errors = F.when(missing, F.array(F.lit("Missing required fields"))).otherwise(
        F.array_compact(
            F.array(
                F.when((F.col("e.start") < 0) | (F.col("e.end") > n), F.lit("Out of bounds")),
                F.when(~F.col("e.text").eqNullSafe(cut), F.lit("Text mismatch")),
                F.when(~F.coalesce(F.col("e.label").isin("SYMPTOM", "PRODUCT"), F.lit(False)), F.lit("Invalid label")),
            )
        )
    )
    rows = rows.where(missing | F.col("entity").isNotNull())
    return rows.select("line", F.when(~missing, F.col("entity")).alias("entity"), F.explode(errors).alias("error")).distinct()
