"""Queries over the annotation workflow, batches and sampling."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspan.operators import annotation as A, sampling as P, spans as S
from quillspan.plans.catalog import plan
from quillspan.plans.corpus import by_order, corpus, with_


def _entities(spark, sf_dir):
    return corpus(spark, sf_dir, "annotated").withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})


def _round(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_SPOT = lambda df: df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@plan("adjudicate", with_("annotated", sql="select task, start_::int start_pos, end_::int end_pos, label, count(*) votes from annotated group by all having count(*) >= 2"))
def adjudicate(spark, sf_dir):
    return _SPOT(A.majority(_entities(spark, sf_dir)))


@plan("adjudicate_records", with_("annotated", sql="select task, count(distinct annotator) n_annotators, coalesce(max(k), 0) n_kept from annotated left join (select task, count(*) k from (select task from annotated group by task, start_, end_, label having count(*) >= 2) group by 1) using (task) group by 1"))
def adjudicate_records(spark, sf_dir):
    e = _entities(spark, sf_dir)
    kept = A.majority(e).groupBy("task").agg(F.count(F.lit(1)).alias("k"))
    return e.groupBy("task").agg(F.countDistinct("annotator").alias("n_annotators")).join(kept, "task", "left").select("task", "n_annotators", F.coalesce("k", F.lit(0)).alias("n_kept"))


@plan("adjudicate_conflicts", with_("annotated", sql="select a.task, count(*) n_conflicts from annotated a join annotated b on a.task = b.task and (a.annotator, a.ord) < (b.annotator, b.ord) and a.label <> b.label and a.start_ < b.end_ and a.end_ > b.start_ group by 1"))
def adjudicate_conflicts(spark, sf_dir):
    return A.conflicts(_entities(spark, sf_dir)).groupBy("task").agg(F.count(F.lit(1)).alias("n_conflicts"))


@plan("consensus_majority", with_("annotated", sql="select v.* from (select task, start_::int start_pos, end_::int end_pos, label, count(*) votes from annotated group by all) v join (select task, count(distinct annotator) n from annotated group by 1) using (task) where votes >= n // 2 + 1"))
def consensus_majority(spark, sf_dir):
    return _SPOT(A.majority_of_annotators(_entities(spark, sf_dir)))


_O = "greatest(0, least(a.end_, b.end_) - greatest(a.start_, b.start_))"
_IOU = f"{_O}::double / ((a.end_ - a.start_) + (b.end_ - b.start_) - {_O})"
_PAIRS = f"p as (select a.task, a.annotator annotator1, b.annotator annotator2, a.ord ord1, a.label l1, b.label l2, {_IOU} iou from annotated a join annotated b on a.task = b.task and a.annotator < b.annotator)"
_SEEN = "select o_orderkey task, concat('ann', a) annotator from {orders} orders cross join (select 0 a union all select 1 union all select 2) v where (o_orderkey + a) % 7 <> 0"
_N = f"""w as (select task, annotator from annotated union select task, annotator from ({_SEEN.replace('{orders} ', '')}) z), c as (select w.task, w.annotator, count(ord) n from w left join annotated e on e.task = w.task and e.annotator = w.annotator group by 1, 2)"""
_MATCHED = f"""{_N}, m as (select x.task, x.annotator annotator1, y.annotator annotator2, x.n n1, y.n n2, coalesce(k, 0) m, coalesce(h.met, 0) met from c x join c y on x.task = y.task and x.annotator < y.annotator
left join (select task, annotator1, annotator2, count(distinct ord1) k, count(*) met from p where iou >= 0.5 and l1 = l2 group by 1, 2, 3) h on h.task = x.task and h.annotator1 = x.annotator and h.annotator2 = y.annotator)"""
_HEAD = with_("annotated", sql="select 1").removesuffix(" select 1") + f", {_PAIRS}"


@plan("consensus_iou", with_("annotated", sql=f"select v.* from (select a.task, a.start_::int start_pos, a.end_::int end_pos, a.label, count(distinct b.annotator) votes from (select distinct task, start_, end_, label from annotated) a join annotated b on a.task = b.task and a.label = b.label and {_IOU} >= 0.5 group by all) v join (select task, count(distinct annotator) n from annotated group by 1) using (task) where votes > n / 2"))
def consensus_iou(spark, sf_dir):
    return _SPOT(A.consensus_iou(_entities(spark, sf_dir)))


@plan("pairwise_agreement", _HEAD + " select annotator1, annotator2, count(*) n_pairs, round(avg((iou >= 0.5)::int), 6) agreement from p group by 1, 2")
def pairwise_agreement(spark, sf_dir):
    return _round(A.pairwise_agreement(_entities(spark, sf_dir)))


def _seen(spark, sf_dir):
    """Who saw which task: also tasks in which they found nothing."""
    return spark.sql(_SEEN, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


_JACCARD = "case when n1 + n2 > m then m / (n1 + n2 - m) else 1 end"


@plan("agreement_jaccard", f"{_HEAD}, {_MATCHED} select annotator1, annotator2, round(avg({_JACCARD}), 6) mean_, round(min({_JACCARD}), 6) min_, round(max({_JACCARD}), 6) max_ from m group by 1, 2")
def agreement_jaccard(spark, sf_dir):
    return _round(A.agreement_jaccard(_entities(spark, sf_dir), seen=_seen(spark, sf_dir)))


@plan("agreement_dice", f"{_HEAD}, {_MATCHED} select annotator1, annotator2, round(avg(case when n1 + n2 > 0 then 2 * m / (n1 + n2) else 0 end), 6) dice from m group by 1, 2")
def agreement_dice(spark, sf_dir):
    return _round(A.agreement_dice(_entities(spark, sf_dir), seen=_seen(spark, sf_dir)))


_KAPPA = "k as (select annotator1, annotator2, (2.0::double * sum(met) / sum(n1 + n2) - 0.33) / (1 - 0.33) kappa from m group by 1, 2)"


@plan("kappa_simplified", f"{_HEAD}, {_MATCHED}, {_KAPPA} select annotator1, annotator2, round(kappa, 6) kappa, case when kappa >= 0.8 then 'excellent' when kappa >= 0.6 then 'good' when kappa >= 0.4 then 'moderate' else 'poor' end band from k")
def kappa_simplified(spark, sf_dir):
    return _round(A.kappa(_entities(spark, sf_dir), seen=_seen(spark, sf_dir)))


@plan("annotator_counts", with_("annotated", sql="select coalesce(annotator, 'unknown') annotator, count(*) n_spans, count(distinct task) n_tasks, round(count(*) / count(distinct task), 6) mean_spans from annotated group by 1"))
def annotator_counts(spark, sf_dir):
    by = _entities(spark, sf_dir).groupBy(F.coalesce("annotator", F.lit("unknown")).alias("annotator")).agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("task").alias("n_tasks"))
    return by.select("*", F.round(F.col("n_spans") / F.col("n_tasks"), 6).alias("mean_spans"))


@plan("annotator_stats", with_("annotated", sql="select annotator, n_spans, round(mean_length, 6) mean_length, round(symptom_share, 6) symptom_share, max(n_spans) over () - min(n_spans) over () > (select count(distinct task) from annotated) count_flag, max(mean_length) over () - min(mean_length) over () > 5 length_flag from (select annotator, count(*) n_spans, avg(end_ - start_) mean_length, avg((label = 'SYMPTOM')::int) symptom_share from annotated group by 1)"))
def annotator_stats(spark, sf_dir):
    return _round(A.annotator_stats(_entities(spark, sf_dir)))


@plan("label_coverage", with_("annotated", sql="select count(*) n_tasks, count(*) filter (where s) with_symptom, count(*) filter (where p) with_product, count(*) filter (where not s and not p) with_none from (select o_orderkey, coalesce(bool_or(label = 'SYMPTOM'), false) s, coalesce(bool_or(label = 'PRODUCT'), false) p from orders left join annotated on task = o_orderkey group by 1)"))
def label_coverage(spark, sf_dir):
    tasks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("task"))
    return A.coverage(_entities(spark, sf_dir), tasks)


@plan("gold_integrity", with_("gold", sql="select count(*) n, count(*) filter (where start_ < 0 or start_ >= end_) bad_bounds, count(*) filter (where label not in ('SYMPTOM', 'PRODUCT')) bad_label, count(*) filter (where canonical is null) no_canonical, count(*) - count(distinct (doc_id, start_, end_, label)) n_repeats from gold"))
def gold_integrity(spark, sf_dir):
    g = corpus(spark, sf_dir, "gold")
    checks = g.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("start") < 0) | (F.col("start") >= F.col("end"))).alias("bad_bounds"), F.count_if(~F.col("label").isin("SYMPTOM", "PRODUCT")).alias("bad_label"), F.count_if(F.col("canonical").isNull()).alias("no_canonical"))
    distinct = g.select("doc_id", "start", "end", "label").distinct().agg(F.count(F.lit(1)).alias("d"))
    return checks.crossJoin(distinct).select("*", (F.col("n") - F.col("d")).alias("n_repeats")).drop("d")


_GOLD = """
select doc_id as line, case when l_partkey % 13 = 0 then null else text end as text, cast(l_partkey % 30 - 2 as int) as start_, cast(l_partkey % 30 - 2 + l_suppkey % 9 as int) as end_,
  case when l_partkey % 30 >= 2 and l_partkey % 5 <> 0 then substr(text, cast(l_partkey % 30 - 1 as int), cast(l_suppkey % 9 as int)) else 'x' end as span_text,
  case when l_suppkey % 7 = 0 then 'OTHER' else 'SYMPTOM' end as label, cast(length(text) - 3 as int) as start2, cast(length(text) + l_partkey % 2 as int) as end2, substr(text, cast(length(text) - 2 as int), 3) as text2
from complaints
"""
_PY = "substr(text, least(case when {s} < 0 then greatest(length(text) + {s}, 0) else {s} end, length(text)) + 1, greatest(least({e}, length(text)) - case when {s} < 0 then greatest(length(text) + {s}, 0) else {s} end, 0))"
_GOLD_ERRORS = f"""e as (select line, text, 0 entity, start_ s, end_ e, span_text t, label from g union all select line, text, 1, start2, end2, text2, 'PRODUCT' from g)
select distinct line, null::int entity, 'Missing required fields' error from g where text is null
union all select line, entity, 'Out of bounds' from e where text is not null and (s < 0 or e > length(text))
union all select line, entity, 'Text mismatch' from e where text is not null and t is distinct from case when e < 0 then '' else {_PY.format(s='s', e='e')} end
union all select line, entity, 'Invalid label' from e where text is not null and label not in ('SYMPTOM', 'PRODUCT')"""


@plan("gold_errors", with_("complaints", sql="select 1").removesuffix(" select 1") + f", g as ({_GOLD}), " + _GOLD_ERRORS)
def gold_errors(spark, sf_dir):
    g = spark.sql(_GOLD.replace("from complaints", "from {complaints}"), complaints=corpus(spark, sf_dir, "complaints"))
    entity = lambda s, e, t, label: F.struct(F.col(s).alias("start"), F.col(e).alias("end"), F.col(t).alias("text"), label.alias("label"))
    entities = F.array(entity("start_", "end_", "span_text", F.col("label")), entity("start2", "end2", "text2", F.lit("PRODUCT")))
    return S.gold_errors(g.select("line", "text", entities.alias("entities")))


_BATCH = "b as (select doc_id % 8 batch, count(*) / count(distinct doc_id) per_doc, avg((label = 'SYMPTOM')::int) share, avg(end_ - start_) len from weak group by 1)"


@plan("batch_drift", with_("weak", sql="select 1").removesuffix(" select 1") + f", {_BATCH} select abs(l.per_doc - f.per_doc) / f.per_doc > 0.2 count_drift, abs(l.share - f.share) > 0.1 share_drift, abs(l.len - f.len) / f.len > 0.15 length_drift from b f, b l where f.batch = 0 and l.batch = 7")
def batch_drift(spark, sf_dir):
    by = corpus(spark, sf_dir, "weak").groupBy((F.col("doc_id") % 8).alias("batch")).agg((F.count(F.lit(1)) / F.countDistinct("doc_id")).alias("per_doc"), F.avg((F.col("label") == "SYMPTOM").cast("double")).alias("share"), F.avg(F.col("end") - F.col("start")).alias("len"))
    pick = by.agg(F.min_by(F.struct("per_doc", "share", "len"), "batch").alias("f"), F.max_by(F.struct("per_doc", "share", "len"), "batch").alias("l"))
    return pick.select(A.change_beyond(F.col("l.per_doc"), F.col("f.per_doc"), 0.2).alias("count_drift"), (F.abs(F.col("l.share") - F.col("f.share")) > 0.1).alias("share_drift"), A.change_beyond(F.col("l.len"), F.col("f.len"), 0.15).alias("length_drift"))


@plan("weekly_drift", with_("weak", sql="select yr::int yr, wk::int wk, round(rate, 6) rate, coalesce(abs(rate - lag(rate) over (order by yr, wk)) > 0.2, false) flag from (select isoyear(o_orderdate) yr, weekofyear(o_orderdate) wk, avg((label = 'SYMPTOM')::int) rate from weak join orders on doc_id = o_orderkey group by 1, 2)"))
def weekly_drift(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    by = corpus(spark, sf_dir, "weak").join(orders, "doc_id").groupBy(F.expr("extract(yearofweek from o_orderdate)").cast("int").alias("yr"), F.weekofyear("o_orderdate").alias("wk")).agg(F.avg((F.col("label") == "SYMPTOM").cast("double")).alias("rate"))
    before = F.lag("rate").over(Window.orderBy("yr", "wk"))  # one row per week
    return by.select("yr", "wk", F.round("rate", 6).alias("rate"), F.coalesce(F.abs(F.col("rate") - before) > 0.2, F.lit(False)).alias("flag"))


# Records of orders: id, text, the number of spans and the mean confidence.
_REC = "r as (select doc_id id, count(*) n_spans, avg(confidence) conf, max(end_)::int len from weak group by 1)"


def _mean_in_order(value, *order):
    """The mean of doubles added in the given order: the last digit, which decides at a bound, then hangs on no partition, task or spill."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["v"]) / F.count(F.lit(1))


def _records(spark, sf_dir):
    """Records with the confidences in the order of their spans."""
    return corpus(spark, sf_dir, "weak").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_spans"), _mean_in_order(F.col("confidence"), "ord").alias("conf"), F.max("end").cast("int").alias("len"))


def _scanned(spark, sf_dir):
    """id, conf of the records with the confidences in the order of the table, in which the SQL adds them where it needs no order of spans."""
    lines = by_order(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "_metadata.file_path", "_metadata.row_index")
    confidence = F.expr("(50 + l_partkey % 51) / 100.0e0")  # as in the corpora
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(_mean_in_order(confidence, "file_path", "row_index").alias("conf"))


def _rec_sql(select):
    return with_("weak", sql="select 1").removesuffix(" select 1") + f", {_REC} {select}"


_BINS = lambda v, n: f"case least(floor(({v} - (select min({v}) from r)) / (((select max({v}) from r) - (select min({v}) from r)) / 3.0::double)), 2) when 0 then '{n[0]}' when 1 then '{n[1]}' else '{n[2]}' end"


@plan("bins_density", _rec_sql(f"select {_BINS('n_spans', ('low', 'medium', 'high'))} bin, count(*) n from r group by 1"))
def bins_density(spark, sf_dir):
    return P.equal_width(_records(spark, sf_dir), F.col("n_spans"), ("low", "medium", "high"), zero="empty").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@plan("bins_length", _rec_sql(f"select {_BINS('len', ('short', 'medium', 'long'))} bin, count(*) n from r group by 1"))
def bins_length(spark, sf_dir):
    return P.equal_width(_records(spark, sf_dir), F.col("len"), ("short", "medium", "long")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@plan("bins_category", "select coalesce(source, 'unknown') bin, count(*) n from documents group by 1")
def bins_category(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.coalesce("source", F.lit("unknown")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@plan("sample_stratified_sizes", _rec_sql(f", b as (select {_BINS('len', ('short', 'medium', 'long'))} bin, count(*) size from r group by 1), q as (select bin, size, least(size, greatest(1, floor(500 * (size / (select count(*) from r))))) take from b) select bin, (take + case when bin = (select bin from b order by size desc, bin limit 1) then greatest(500 - (select sum(take) from q), 0) else 0 end)::bigint n from q").replace("group by 1) , b", "group by 1), b"))
def sample_stratified_sizes(spark, sf_dir):
    binned = P.equal_width(_records(spark, sf_dir), F.col("len"), ("short", "medium", "long"))
    return P.sample_stratified(binned, 500).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@plan("prepare_batch")
def prepare_batch(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("n_spans"))
    return P.prepare_batch(docs, 100, "batch-1", "2025-01-01T00:00:00Z")


@plan("batch_stats", with_("weak", sql="select count(distinct doc_id) n_records, count(*) n_spans, round(count(*) / count(distinct doc_id), 6) mean_spans, count(*) filter (where label = 'SYMPTOM') n_symptom, count(*) filter (where label = 'PRODUCT') n_product from weak"))
def batch_stats(spark, sf_dir):
    w = corpus(spark, sf_dir, "weak").agg(F.countDistinct("doc_id").alias("n_records"), F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("label") == "SYMPTOM").alias("n_symptom"), F.count_if(F.col("label") == "PRODUCT").alias("n_product"))
    return w.select("n_records", "n_spans", F.round(F.col("n_spans") / F.col("n_records"), 6).alias("mean_spans"), "n_symptom", "n_product")


@plan("filter_records", "select doc_id from documents where length(text) >= 20 and length(text) <= 5000")
def filter_records(spark, sf_dir):
    n = F.length("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where((n >= 20) & (n <= 5000)).select("doc_id")


@plan("al_uncertain", _rec_sql("select id from r where conf between 0.5 and 0.75"))
def al_uncertain(spark, sf_dir):
    return _scanned(spark, sf_dir).where(F.col("conf").between(0.5, 0.75)).select("id")


@plan("al_diverse", with_("weak", sql="select case when confidence > 0.85 then 'high' when confidence > 0.65 then 'medium' else 'low' end band, label, min(doc_id) id from weak group by 1, 2"))
def al_diverse(spark, sf_dir):
    band = F.when(F.col("confidence") > 0.85, "high").when(F.col("confidence") > 0.65, "medium").otherwise("low")
    return corpus(spark, sf_dir, "weak").groupBy(band.alias("band"), "label").agg(F.min("doc_id").alias("id"))


@plan("al_error_prone", with_("weak", sql="select distinct doc_id id from weak where regexp_matches(lower(coalesce(span_text, '')), 'severe|mild|slight|minor')"))
def al_error_prone(spark, sf_dir):
    return corpus(spark, sf_dir, "weak").where(F.lower(F.coalesce("span_text", F.lit(""))).rlike("severe|mild|slight|minor")).select(F.col("doc_id").alias("id")).distinct()


@plan("quality_reject", _rec_sql("select case when len < 60 then 'length' when n_spans < 3 then 'spans' when conf < 0.7 then 'confidence' else 'ok' end reason, count(*) n from r group by 1"))
def quality_reject(spark, sf_dir):
    reason = F.when(F.col("len") < 60, "length").when(F.col("n_spans") < 3, "spans").when(F.col("conf") < 0.7, "confidence").otherwise("ok")
    return _records(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
