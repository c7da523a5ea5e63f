"""Queries over spans as relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import matching as M, metrics as E, spans as S
from quillspan.functions import text as T
from quillspan.plans.catalog import plan
from quillspan.plans.corpus import corpus, with_


@plan("dedup_spans", with_("weak", sql="select doc_id, start_pos, end_pos, canonical, ord from (select *, row_number() over (partition by doc_id, start_pos, end_pos, canonical order by confidence desc, ord) r from (select doc_id, ord, (start_ // 40)::int start_pos, (end_ // 40)::int end_pos, canonical, confidence from weak)) where r = 1"))
def dedup_spans(spark, sf_dir):
    spans = corpus(spark, sf_dir, "weak").withColumns({"start": F.expr("cast(start div 40 as int)"), "end": F.expr("cast(end div 40 as int)")})
    return M.dedup(spans, "ord").select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "canonical", "ord")


def _wide(spark, sf_dir):
    """Spans stretched so that neighbours overlap, nested per document."""
    spans = corpus(spark, sf_dir, "weak").withColumn("end", F.col("end") + 12)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "ord", "end", "confidence")).alias("spans"))


def _filter_plan(name, strategy):
    @plan(f"filter_overlaps_{name}")
    def run(spark, sf_dir):
        kept = _wide(spark, sf_dir).select("doc_id", F.explode(S.filter_overlaps(F.col("spans"), strategy)).alias("s"))
        return kept.select("doc_id", "s.ord", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


for _name, _strategy in (("longest", "longest"), ("confidence", "highest_confidence"), ("first", "first")):
    _filter_plan(_name, _strategy)


@plan("validate_alignment", with_("complaints", sql="select doc_id, (l_partkey % 9)::int start_pos, length(text) > 0 and l_partkey % 9 < l_partkey % 9 + l_suppkey % 5 and l_partkey % 9 + l_suppkey % 5 <= length(text) and l_suppkey % 2 = 0 aligned from complaints"))
def validate_alignment(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints").withColumns({"s": (F.col("l_partkey") % 9).cast("int"), "n": (F.col("l_suppkey") % 5).cast("int")})
    given = F.when(F.col("l_suppkey") % 2 == 0, F.substring(F.col("text"), F.col("s") + 1, F.col("n"))).otherwise(F.lit("?"))
    return docs.select("doc_id", F.col("s").alias("start_pos"), S.is_aligned(F.col("text"), F.col("s"), F.col("s") + F.col("n"), given).alias("aligned"))


_IOU = "case when greatest(0, least(w.end_, g.end_) - greatest(w.start_, g.start_)) > 0 then greatest(0, least(w.end_, g.end_) - greatest(w.start_, g.start_)) / ((w.end_ - w.start_) + (g.end_ - g.start_) - greatest(0, least(w.end_, g.end_) - greatest(w.start_, g.start_)))::double else 0.0 end"


@plan("span_overlap_iou", with_("weak", "gold", sql=f"select w.doc_id, w.ord, greatest(0, least(w.end_, g.end_) - greatest(w.start_, g.start_))::int overlap_chars, round({_IOU}, 6) iou from weak w join gold g on w.doc_id = g.doc_id and w.ord = g.ord"))
def span_overlap_iou(spark, sf_dir):
    g = corpus(spark, sf_dir, "gold").select("doc_id", "ord", F.col("start").cast("int").alias("gs"), F.col("end").cast("int").alias("ge"))
    w = corpus(spark, sf_dir, "weak").join(g, ["doc_id", "ord"])
    at = [F.col(c) for c in ("start", "end", "gs", "ge")]
    return w.select("doc_id", "ord", S.overlap(*at).alias("overlap_chars"), F.round(S.iou(*at), 6).alias("iou"))


@plan("uncertain_spans", with_("weak", sql="select doc_id, ord from weak where coalesce(confidence, 1.0) between 0.55 and 0.75"))
def uncertain_spans(spark, sf_dir):
    return S.uncertain(corpus(spark, sf_dir, "weak")).select("doc_id", "ord")


@plan("span_filters", with_("weak", sql="select case when confidence >= 0.85 then 'high' when confidence >= 0.65 then 'medium' else 'low' end band, negated, count(*) n from weak group by 1, 2"))
def span_filters(spark, sf_dir):
    band = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.65, "medium").otherwise("low")
    return corpus(spark, sf_dir, "weak").groupBy(band.alias("band"), "negated").agg(F.count(F.lit(1)).alias("n"))


@plan("flatten_spans", with_("weak", sql="select doc_id, (ord - 1)::int span_idx, label from (select doc_id, label, row_number() over (partition by doc_id order by ord) ord from weak)"))
def flatten_spans(spark, sf_dir):
    nested = corpus(spark, sf_dir, "weak").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("spans"))
    return nested.select("doc_id", F.posexplode("spans").alias("span_idx", "s")).select("doc_id", "span_idx", "s.label")


@plan("spans_to_bio", with_("complaints", sql=r"select doc_id, count(*) filter (where s >= 0 and s + n <= 12) n_tagged from (select doc_id, t[i] tok, length(t[i]) n, list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(t[1:i - 1], lambda z: length(z))), 0) s from (select doc_id, t, g, unnest(range(1, len(t) + 1)) i from (select doc_id, regexp_extract_all(text, '\b\w[\w\-'']*\b') t, string_split_regex(text, '\b\w[\w\-'']*\b') g from complaints))) group by 1"))
def spans_to_bio(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints")
    entity = F.array(F.struct(F.lit(0).alias("start"), F.lit(12).alias("end"), F.lit("SYMPTOM").alias("label")))
    return docs.select("doc_id", F.size(F.filter(S.bio_tags(T.tokenize(F.col("text")), entity), lambda t: t == "B-SYMPTOM")).cast("long").alias("n_tagged"))


@plan("span_conflicts", with_("annotated", sql="select a.task, a.annotator ann_a, a.ord ord_a, b.annotator ann_b, b.ord ord_b from annotated a join annotated b on a.task = b.task and (a.annotator, a.ord) < (b.annotator, b.ord) and a.label <> b.label and a.start_ < b.end_ and a.end_ > b.start_"))
def span_conflicts(spark, sf_dir):
    from quillspan.operators.annotation import conflicts

    return conflicts(corpus(spark, sf_dir, "annotated"))


@plan("top_canonicals", with_("weak", sql="select canonical, n from (select canonical, count(*) n, min(doc_id * 100 + ord) f from weak where label = 'SYMPTOM' group by 1) order by n desc, f limit 10"))
def top_canonicals(spark, sf_dir):
    got = corpus(spark, sf_dir, "weak").where("label = 'SYMPTOM'").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "ord")).alias("f"))
    return got.orderBy(F.desc("n"), "f").limit(10).select("canonical", "n")


@plan("label_distribution", with_("weak", sql="select coalesce(label, 'unknown') label, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (), 6) pct from weak group by 1"))
def label_distribution(spark, sf_dir):
    got = corpus(spark, sf_dir, "weak").groupBy(F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("total"))
    return got.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).cast("double").alias("pct"))


@plan("span_summary", with_("weak", sql="select count(*) n, round(avg(confidence), 6) mean, round(stddev_samp(confidence), 6) std, min(confidence) min_, round(quantile_cont(confidence, 0.25), 6) q1, round(quantile_cont(confidence, 0.5), 6) q2, round(quantile_cont(confidence, 0.75), 6) q3, max(confidence) max_ from weak"))
def span_summary(spark, sf_dir):
    c = F.col("confidence")
    return corpus(spark, sf_dir, "weak").agg(
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("min_"),
        *(F.round(F.percentile(c, F.lit(q)), 6).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))), F.max(c).alias("max_"),
    )


@plan("span_length_hist", with_("weak", sql="select case when end_ - start_ < 10 then '0-10' when end_ - start_ < 20 then '10-20' else '20-100' end bucket, count(*) n from weak group by 1"))
def span_length_hist(spark, sf_dir):
    n = F.col("end") - F.col("start")
    return corpus(spark, sf_dir, "weak").groupBy(F.when(n < 10, "0-10").when(n < 20, "10-20").otherwise("20-100").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan("span_changes", with_("weak", "llm", sql="(select doc_id, start_::int start_pos, end_::int end_pos, 'removed' change from weak except select doc_id, start_::int, end_::int, 'removed' from llm) union all (select doc_id, start_::int, end_::int, 'added' from llm except select doc_id, start_::int, end_::int, 'added' from weak)"))
def span_changes(spark, sf_dir):
    cut = lambda name, change: corpus(spark, sf_dir, name).select("doc_id", F.col("start").cast("int").alias("start_pos"), F.col("end").cast("int").alias("end_pos"))
    w, m = cut("weak", ""), cut("llm", "")
    return w.subtract(m).withColumn("change", F.lit("removed")).unionByName(m.subtract(w).withColumn("change", F.lit("added")))
