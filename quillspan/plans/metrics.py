"""Queries over evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import metrics as E
from quillspan.plans.catalog import plan
from quillspan.plans.corpus import corpus, with_


def _three(spark, sf_dir):
    return [corpus(spark, sf_dir, n).withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")}) for n in ("weak", "llm", "gold")]


_O = "(least(p.end_, g.end_) - greatest(p.start_, g.start_))"
_IOU = f"coalesce(max({_O}::double / ((p.end_ - p.start_) + (g.end_ - g.start_) - {_O})), 0.0)"
#: Best IoU of each prediction of a corpus.
_BEST = lambda name: f"{name}_b as (select p.doc_id, p.ord, p.label, p.confidence, p.span_text, p.negated, {_IOU} iou from {name} p left join gold g on p.doc_id = g.doc_id and p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_ group by all)"


def _sql(select, *extra):
    head = with_("weak", "llm", "gold", sql="select 1").removesuffix(" select 1")
    return f"{head}, {_BEST('weak')}, {_BEST('llm')}{''.join(', ' + x for x in extra)} {select}"


_BP = "select round(avg(iou), 6) mean_iou, round(list_sort(list(iou))[len(list(iou)) // 2 + 1], 6) median_iou, round(avg((iou >= 1.0)::int), 6) exact_match_rate, count(*) n_pred, (select count(*) from gold) n_gold from weak_b"


@plan("boundary_precision", _sql(_BP))
def boundary_precision(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    return _round(E.boundary_precision(weak, gold))


def _round(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_CORPUS_IOU = f"select round(avg(iou), 6) mean_iou, round(avg((iou >= 1.0)::int), 6) exact_match_rate from (select w.doc_id, w.ord, coalesce(b.iou, 0.0) iou from weak w left join (select p.label, p.start_, p.end_, {_IOU} iou from (select distinct label, start_, end_ from weak) p join (select distinct label, start_, end_ from gold) g on p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_ group by all) b on w.label = b.label and w.start_ = b.start_ and w.end_ = b.end_)"


@plan("boundary_precision_corpus", _sql(_CORPUS_IOU))
def boundary_precision_corpus(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    return _round(E.boundary_precision(weak, gold, "corpus").select("mean_iou", "exact_match_rate"))


@plan("iou_delta", _sql("select round(w, 6) weak_mean_iou, round(l, 6) llm_mean_iou, round(l - w, 6) delta, round((l - w) / w * 100, 6) improvement_pct from (select (select avg(iou) from weak_b) w, (select avg(iou) from llm_b) l)"))
def iou_delta(spark, sf_dir):
    return _round(E.iou_delta(*_three(spark, sf_dir)))


_PAIR = f"{_O}::double / ((p.end_ - p.start_) + (g.end_ - g.start_) - {_O})"
_CORR = (
    f"b as (select * from (select p.doc_id, p.ord, p.label, p.start_, p.end_, g.start_ ls, g.end_ le, g.ord l_ord, row_number() over (partition by p.doc_id, p.ord order by {_PAIR} desc, g.ord) r from weak p join llm g on p.doc_id = g.doc_id and p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_) where r = 1)",
    f"c as (select p.doc_id, p.ord, p.l_ord, p.ls, p.le, p.start_, p.end_, {_IOU} wi from b p left join gold g on p.doc_id = g.doc_id and p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_ group by all)",
    f"d as (select p.doc_id, p.ord, {_IOU} li from (select doc_id, ord, label, ls start_, le end_ from b) p left join gold g on p.doc_id = g.doc_id and p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_ group by all)",
    "st as (select c.*, d.li, start_ <> ls or end_ <> le modified, case when (start_ = ls and end_ = le) or li = wi then 'unchanged' when li > wi then 'improved' else 'worsened' end status from c join d using (doc_id, ord))",
)


@plan("correction_rate", _sql("select count(*) total_spans, count(*) filter (where modified) modified_count, count(*) filter (where status = 'improved') improved_count, count(*) filter (where status = 'worsened') worsened_count, count(*) filter (where status = 'unchanged') unchanged_count from st", *_CORR))
def correction_rate(spark, sf_dir):
    return E.correction_rate(*_three(spark, sf_dir))


_PATTERNS = """select case when contains(w, 'severe') or contains(w, 'mild') then 'removed_adjective' when len(string_split(n, ' ')) < len(string_split(w, ' ')) then 'truncated_compound' else 'other' end pattern, count(*) n
from (select coalesce(weak.span_text, 'burning sensation') w, coalesce(llm.span_text, 'burning') n from st
join weak on st.doc_id = weak.doc_id and st.ord = weak.ord join llm on st.doc_id = llm.doc_id and st.l_ord = llm.ord where status = 'worsened') group by 1"""


@plan("change_patterns", _sql(_PATTERNS, *_CORR))
def change_patterns(spark, sf_dir):
    weak, llm, gold = _three(spark, sf_dir)
    bad = E.corrections(weak, llm, gold, "span_text").where("status = 'worsened'")
    old, new = F.coalesce("span_text", F.lit("burning sensation")), F.coalesce("l_span_text", F.lit("burning"))
    return bad.groupBy(T.change_pattern(old, new).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


_BIN = "least(floor(coalesce(confidence, 0.0) / (1.0::double / 10)), 9)::int"
_CURVE = f"select r.bin::int bin, coalesce(n, 0) n, round(coalesce(accuracy, 0.0), 6) accuracy, round(coalesce(mean_confidence, 0.0), 6) mean_confidence, round(coalesce(mean_iou, 0.0), 6) mean_iou from range(10) r(bin) left join (select {_BIN} bin, count(*) n, avg((iou >= 0.5)::int) accuracy, avg(confidence) mean_confidence, avg(iou) mean_iou from weak_b group by 1) using (bin)"


@plan("calibration_curve", _sql(_CURVE))
def calibration_curve(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    return _round(E.calibration_curve(weak, gold))


@plan("calibration_status", _sql(f"select bin, n, case when n = 0 then 'empty' when mean_confidence - mean_iou > 0.05 then 'over' when mean_iou - mean_confidence > 0.05 then 'under' else 'calibrated' end status from ({_CURVE})"))
def calibration_status(spark, sf_dir):
    gap = F.col("mean_confidence") - F.col("mean_iou")
    return calibration_curve(spark, sf_dir).select("bin", "n", F.when(F.col("n") == 0, "empty").when(gap > 0.05, "over").when(gap < -0.05, "under").otherwise("calibrated").alias("status"))


_STRATUM = "case when confidence between 0 and 0.6 then '0.00-0.60' when confidence <= 0.7 then '0.60-0.70' when confidence <= 0.8 then '0.70-0.80' when confidence <= 0.9 then '0.80-0.90' when confidence <= 1.0 then '0.90-1.00' end"
_LENGTH = "case when len(list_filter(string_split(coalesce(span_text, ''), ' '), lambda x: x <> '')) <= 1 then 'single_word' else 'multi_word' end"


def _strata(name, sql_key, key):
    @plan(f"strata_{name}", with_("weak", sql=f"select {sql_key} stratum, count(*) n from weak group by 1"))
    def run(spark, sf_dir):
        return corpus(spark, sf_dir, "weak").groupBy(key().alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


_KEYS = {
    "confidence": (_STRATUM, lambda: E.confidence_stratum(F.col("confidence"))),
    "label": ("coalesce(label, 'UNKNOWN')", lambda: F.coalesce("label", F.lit("UNKNOWN"))),
    "length": (_LENGTH, lambda: E.length_stratum(F.col("span_text"))),
}
for _n, (_s, _k) in _KEYS.items():
    _strata(_n, _s, _k)


@plan("strata_label_confidence", with_("weak", sql=f"select label, {_STRATUM} stratum, count(*) n from weak group by 1, 2"))
def strata_label_confidence(spark, sf_dir):
    return corpus(spark, sf_dir, "weak").groupBy("label", E.confidence_stratum(F.col("confidence")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def _evaluate(name, sql_key, key, filter_gold):
    g = f"select {sql_key} stratum, count(*) n_gold from gold group by 1" if filter_gold else "select distinct stratum, (select count(*) from gold) n_gold from w"
    sql = _sql(
        f"select w.stratum, n_weak, coalesce(n_llm, 0) n_llm, coalesce(n_gold, 0) n_gold, round(weak_mean_iou, 6) weak_mean_iou, round(coalesce(llm_mean_iou, 0), 6) llm_mean_iou, round(weak_exact, 6) weak_exact, round(coalesce(llm_exact, 0), 6) llm_exact from w left join l using (stratum) left join ({g}) using (stratum)",
        f"w as (select {sql_key} stratum, count(*) n_weak, avg(iou) weak_mean_iou, avg((iou >= 1)::int) weak_exact from weak_b group by 1)",
        f"l as (select {sql_key} stratum, count(*) n_llm, avg(iou) llm_mean_iou, avg((iou >= 1)::int) llm_exact from llm_b group by 1)",
    )

    @plan(f"evaluate_by_{name}", sql)
    def run(spark, sf_dir):
        return _round(E.strata_report(*_three(spark, sf_dir), key(), filter_gold))


for _n, (_s, _k) in _KEYS.items():
    _evaluate(_n, _s, _k, _n != "confidence")


@plan("plot_data_strata", _sql(f"select {_STRATUM} stratum, side, round(avg(iou), 6) mean_iou, count(*) n from (select 'weak' side, * from weak_b union all select 'llm', * from llm_b) group by 1, 2"))
def plot_data_strata(spark, sf_dir):
    weak, llm, gold = _three(spark, sf_dir)
    both = E.best_iou(E.spots(weak, "confidence"), gold).select("confidence", "iou", F.lit("weak").alias("side")).unionByName(E.best_iou(E.spots(llm, "confidence"), gold).select("confidence", "iou", F.lit("llm").alias("side")))
    return both.groupBy(E.confidence_stratum(F.col("confidence")).alias("stratum"), "side").agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.count(F.lit(1)).alias("n"))


@plan("weak_spots", _sql(f"select dimension, stratum, round(mean_iou, 6) mean_iou, case when mean_iou < 0.6 then 'HIGH' else 'MEDIUM' end severity from (select 'confidence' dimension, {_STRATUM} stratum, avg(iou) mean_iou from weak_b group by 2 union all select 'label', label, avg(iou) from weak_b group by 2) where mean_iou < 0.8"))
def weak_spots(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    scored = E.best_iou(E.spots(weak, "confidence"), gold)
    by = lambda d, k: scored.groupBy(k.alias("stratum")).agg(F.avg("iou").alias("mean_iou")).select(F.lit(d).alias("dimension"), "stratum", "mean_iou")
    both = by("confidence", E.confidence_stratum(F.col("confidence"))).unionByName(by("label", F.col("label"))).where("mean_iou < 0.8")
    severity = F.when(F.col("mean_iou") < 0.6, "HIGH").otherwise("MEDIUM")
    return both.select("dimension", "stratum", F.round("mean_iou", 6).alias("mean_iou"), severity.alias("severity")).orderBy(F.col("severity") != "HIGH", "mean_iou")


@plan("prf1")
def prf1(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    return _round(E.prf1(weak, gold))


@plan("prf_many_to_one", _sql("select tp, n - tp fp, g - tp fn, round(tp / n::double, 6) \"precision\", round(tp / g::double, 6) recall from (select count(*) filter (where iou >= 0.5) tp, count(*) n, (select count(*) from gold) g from weak_b)"))
def prf_many_to_one(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    got = E.best_iou(E.spots(weak), gold).agg(F.count_if(F.col("iou") >= 0.5).alias("tp"), F.count(F.lit(1)).alias("n")).crossJoin(gold.agg(F.count(F.lit(1)).alias("g")))
    return _round(got.select("tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("g")).alias("recall")))


@plan("evaluate_overall")
def evaluate_overall(spark, sf_dir):
    weak, llm, gold = _three(spark, sf_dir)
    side = lambda p, n: E.boundary_precision(p, gold).crossJoin(E.prf1(p, gold)).select(F.struct("*").alias(n))
    both = side(weak, "weak").crossJoin(side(llm, "llm")).select("*", F.struct(*E.delta(F.col("weak.mean_iou"), F.col("llm.mean_iou"))).alias("iou_delta"))
    return both.crossJoin(E.correction_rate(weak, llm, gold).select(F.struct("*").alias("correction_rate")))


@plan("report_markdown")
def report_markdown(spark, sf_dir):
    e = evaluate_overall(spark, sf_dir)
    line = "# Evaluation\n\n| metric | weak | refined |\n|---|---|---|\n| mean IoU | %.4f | %.4f |\n| exact | %.4f | %.4f |\n| F1 | %.4f | %.4f |\n"
    return e.select(F.format_string(line, "weak.mean_iou", "llm.mean_iou", "weak.exact_match_rate", "llm.exact_match_rate", "weak.f1", "llm.f1").alias("report"))


_IOG = f"{_O}::double / (g.end_ - g.start_)"
_WG = f"""select label, tp, n_weak - tp fp, n_gold - matched fn, round(tp / n_weak::double, 4) "precision", round(tp / (tp + n_gold - matched)::double, 4) recall, round(2 * (tp / n_weak::double) * (tp / (tp + n_gold - matched)::double) / (tp / n_weak::double + tp / (tp + n_gold - matched)::double), 4) f1 from
(select label, count(*) n_gold from gold group by 1) join (select label, count(*) n_weak from weak where doc_id in (select doc_id from gold) group by 1) using (label) join
(select label, count(*) tp, count(distinct doc_id * 100 + g_ord) matched from (select p.doc_id, p.label, p.ord, g.ord g_ord, row_number() over (partition by p.doc_id, p.label, p.ord order by {_IOG} desc, g.ord) r from weak p join gold g on p.doc_id = g.doc_id and p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_ where {_IOG} >= 0.5) where r = 1 group by 1) using (label)"""


@plan("compare_weak_gold", with_("weak", "gold", sql=_WG))
def compare_weak_gold(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    return E.weak_vs_gold(weak, gold)


_BUCKET = "case when confidence < 0.7 then '<0.70' when confidence < 0.8 then '<0.80' when confidence < 0.9 then '<0.90' when confidence < 0.95 then '<0.95' else '<1.01' end"


@plan("confidence_buckets", _sql(f"select {_BUCKET} bucket, count(*) n, round(avg((iou >= 0.5)::int), 4) hit_rate from weak_b group by 1"))
def confidence_buckets(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    c = F.col("confidence")
    bucket = F.when(c < 0.7, "<0.70").when(c < 0.8, "<0.80").when(c < 0.9, "<0.90").when(c < 0.95, "<0.95").otherwise("<1.01")
    return E.best_iou(E.spots(weak, "confidence"), gold).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("iou") >= 0.5).cast("double")), 4).alias("hit_rate"))


@plan("calibrate_threshold", with_("weak", sql="select coalesce(min(confidence) filter (where ok), 0.0) threshold from (select confidence, bool_and(avg_ >= 0.7) over (order by confidence desc, k rows unbounded preceding) ok from (select confidence, doc_id * 100 + ord k, avg((l_suppkey % 4 > 0)::int) over (order by confidence desc, doc_id * 100 + ord rows unbounded preceding) avg_ from weak))"))
def calibrate_threshold(spark, sf_dir):
    pairs = corpus(spark, sf_dir, "weak").select("confidence", (F.col("l_suppkey") % 4 > 0).alias("correct"), (F.col("doc_id") * 100 + F.col("ord")).alias("ord"))
    return E.calibrate_threshold(pairs, 0.7)


_NEG = f"select count(*) filter (where n and gn) tp, count(*) filter (where n and not gn) fp, count(*) filter (where not n and gn) fn from (select p.doc_id, p.ord, p.negated n, arg_max(g.negated, {{'a': {_PAIR}, 'b': -g.ord}}) gn, max({_PAIR}) i from weak p join gold g on p.doc_id = g.doc_id and p.label = g.label and g.start_ < p.end_ and g.end_ > p.start_ group by all) where i >= 0.5"


@plan("negation_prf", with_("weak", "gold", sql=_NEG))
def negation_prf(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    g = gold.select("doc_id", "label", F.col("ord").alias("go"), F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("negated").alias("gn"))
    value = E.iou(F.col("start"), F.col("end"), F.col("gs"), F.col("ge"))
    met = weak.join(g, ["doc_id", "label"]).where("gs < end and ge > start").groupBy("doc_id", "ord", "negated").agg(F.max_by("gn", F.struct(value, -F.col("go"))).alias("gn"), F.max(value).alias("i")).where("i >= 0.5")
    n, gn = F.col("negated"), F.col("gn")
    return met.agg(F.count_if(n & gn).alias("tp"), F.count_if(n & ~gn).alias("fp"), F.count_if(~n & gn).alias("fn"))


@plan("batch_stability", _sql("select round(avg(m), 6) mean_score, round(stddev_samp(m), 6) std_score, case when stddev_samp(m) < 0.01 then 'stable' when stddev_samp(m) > 0.02 then 'volatile' else 'moderate' end status from (select doc_id % 10 b, avg(iou) m from weak_b group by 1)"))
def batch_stability(spark, sf_dir):
    weak, _, gold = _three(spark, sf_dir)
    by = E.best_iou(E.spots(weak), gold).groupBy(F.col("doc_id") % 10).agg(F.avg("iou").alias("m"))
    s = F.stddev_samp("m")
    return by.agg(F.round(F.avg("m"), 6).alias("mean_score"), F.round(s, 6).alias("std_score"), F.when(s < 0.01, "stable").when(s > 0.02, "volatile").otherwise("moderate").alias("status"))
