"""Queries over records: lexicons, JSON lines, tasks, ingest, knowledge and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import matching as M, refine as R, spans as S
from quillspan.plans.catalog import plan
from quillspan.plans.corpus import COMPLAINTS, SYMPTOM_LEXICON, corpus, lexicon, with_
from quillspan.sources import records as X


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


_RAW = "select p_partkey lex_ord, case when p_partkey % 7 = 0 then ' ' else ' ' || p_name || ' ' end term, case when p_partkey % 3 = 0 then '' else p_name end canonical, case when p_partkey % 2 = 0 then '' else 'src' end source from part"


def _raw(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    return _part(spark, sf_dir).select(
        k.alias("lex_ord"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" "), name, F.lit(" "))).alias("term"), F.when(k % 3 == 0, "").otherwise(name).alias("canonical"),
        F.when(k % 2 == 0, "").otherwise("src").alias("source"), F.lit("").alias("concept_id"), F.lit(" ").alias("sku"), F.lit("c").alias("category"),
    )


@plan("lexicon_symptom_normalize", f"select lex_ord, trim(term) term, coalesce(nullif(trim(canonical), ''), trim(term)) canonical, coalesce(nullif(source, ''), 'unknown') source, null::varchar concept_id from ({_RAW}) where trim(term) <> ''")
def lexicon_symptom_normalize(spark, sf_dir):
    return X.symptom_lexicon(_raw(spark, sf_dir))


@plan("lexicon_product_normalize", f"select lex_ord, trim(term) term, coalesce(nullif(trim(canonical), ''), trim(term)) canonical, 'product_lexicon' source, null::varchar sku, 'c' category from ({_RAW}) where trim(term) <> ''")
def lexicon_product_normalize(spark, sf_dir):
    return X.product_lexicon(_raw(spark, sf_dir))


@plan("complaint_corpus", with_("complaints", sql="select doc_id, text from complaints"))
def complaint_corpus(spark, sf_dir):
    return corpus(spark, sf_dir, "complaints").select("doc_id", "text")


@plan("text_lines_scan", "select (row_number() over (order by p_partkey) - 1)::bigint id, trim(p_name) text from part where p_partkey % 5 <> 0")
def text_lines_scan(spark, sf_dir):
    lines = _part(spark, sf_dir).orderBy("p_partkey").select(F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name")).alias("value"))
    return X.text_lines(lines)


@plan("jsonl_roundtrip", with_("weak", sql="select doc_id, ord, label, confidence from weak"))
def jsonl_roundtrip(spark, sf_dir):
    w = corpus(spark, sf_dir, "weak")
    lines = w.select(F.to_json(F.struct("doc_id", "ord", "label", "confidence", "span_text"), {"ignoreNullFields": "false"}).alias("value"))
    return X.parse_lines(lines, "doc_id long, ord int, label string, confidence double, span_text string").select("doc_id", "ord", "label", "confidence")


def _lines(spark, sf_dir):
    k = F.col("p_partkey")
    good = F.to_json(F.struct(k.cast("string").alias("id"), F.col("p_name").alias("text"), F.array(F.struct(F.lit(0).alias("start"), F.when(k % 4 != 0, F.lit(3)).alias("end"))).alias("spans")))
    return _part(spark, sf_dir).select(k, F.when(k % 9 == 0, F.concat(good, F.lit("oops{"))).when(k % 11 == 0, F.lit("{not json")).otherwise(good).alias("value"))


@plan("jsonl_corrupt_rows", "select count(*) filter (where p_partkey % 11 = 0 or p_partkey % 9 = 0) n_bad, count(*) n from part")
def jsonl_corrupt_rows(spark, sf_dir):
    return X.parse_lines(_lines(spark, sf_dir), X.WEAK).agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n"))


@plan("validate_jsonl", "select case when p_partkey % 11 = 0 or p_partkey % 9 = 0 then 'bad json' when p_partkey % 4 = 0 then 'span without end' else 'ok' end status, count(*) n from part group by 1")
def validate_jsonl(spark, sf_dir):
    rows = X.parse_lines(_lines(spark, sf_dir), X.WEAK)
    status = F.when(F.col("bad"), "bad json").when(F.col("id").isNull() | F.col("text").isNull() | F.col("spans").isNull(), "missing field").when(F.exists("spans", lambda s: s["start"].isNull() | s["end"].isNull()), "span without end").otherwise("ok")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _tasks(spark, sf_dir):
    """Two annotations per task; the first has a span without label and one that is inverted."""
    w = corpus(spark, sf_dir, "weak")
    value = F.struct(F.struct(F.when(F.col("ord") % 6 == 0, F.col("end") + 1).otherwise(F.col("start")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("x").alias("text"), F.when(F.col("ord") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("label")).alias("labels")).alias("value"))
    by = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))).alias("r"))
    result = F.struct(F.transform("r", lambda x: x["v"]).alias("result"))
    return by.select(F.col("doc_id").alias("id"), F.struct(F.lit("t").alias("text")).alias("data"), F.array(result, result).alias("annotations"))


@plan("tasks_scan", with_("weak", sql="select doc_id id, count(*)::int n_results, 2 n_annotations from weak group by 1"))
def tasks_scan(spark, sf_dir):
    text = _tasks(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    got = text.select(F.from_json("value", X.TASK).alias("t")).select("t.*")
    return got.select("id", F.size(F.get("annotations", 0)["result"]).alias("n_results"), F.size("annotations").alias("n_annotations"))


@plan("tasks_to_entities", with_("weak", sql="select doc_id id, start_::int start_pos, end_::int end_pos, label from weak where ord % 6 <> 0 and ord % 4 <> 0"))
def tasks_to_entities(spark, sf_dir):
    return S.first_annotation(_tasks(spark, sf_dir)).select("id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "label")


@plan("tasks_from_weak", with_("weak", sql="select doc_id, count(*) filter (where confidence >= 0.8) n_predictions from weak group by 1"))
def tasks_from_weak(spark, sf_dir):
    """Import tasks: spans of at least 0.8 as predictions."""
    by = corpus(spark, sf_dir, "weak").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "label", "confidence"))).alias("spans"))
    kept = F.filter("spans", lambda s: s["confidence"] >= 0.8)
    task = F.to_json(F.struct(F.struct(F.lit("t").alias("text")).alias("data"), F.when(F.size(kept) > 0, F.array(F.struct(F.lit("weak").alias("model_version"), kept.alias("result")))).alias("predictions")))
    back = F.from_json(task, "predictions array<struct<result:array<struct<label:string>>>>")
    return by.select("doc_id", F.coalesce(F.size(F.get(back["predictions"], 0)["result"]), F.lit(0)).cast("long").alias("n")).select("doc_id", F.greatest("n", F.lit(0)).alias("n_predictions"))


@plan("registry_count_tasks", "select count(*) filter (where p_partkey % 5 <> 0) n_tasks from part")
def registry_count_tasks(spark, sf_dir):
    lines = _part(spark, sf_dir).select(F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name")).alias("value"))
    return lines.where(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n_tasks"))


@plan("validate_input", "select doc_id, case when text is null or trim(text) = '' then 'empty' when length(text) > 10000 then 'too long' else 'ok' end status from documents")
def validate_input(spark, sf_dir):
    text = F.col("text")
    status = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) > 10_000, "too long").otherwise("ok")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", status.alias("status"))


@plan("validate_records", with_("complaints", sql="select doc_id, (1 + case when l_partkey % 3 = 0 then 1 else 0 end)::int n_issues from complaints"))
def validate_records(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints")
    span = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), t.alias("text"))
    good = span(F.lit(0), F.lit(3), F.substring("text", 1, 3))
    bad = span(F.lit(2), F.when(F.col("l_partkey") % 3 == 0, F.lit(1)).otherwise(F.lit(4)), F.substring("text", 3, 2))
    missing = span(F.lit(1), F.lit(None).cast("int"), F.lit("x"))
    return docs.select("doc_id", F.size(S.record_issues(F.col("text"), F.array(good, bad, missing))).alias("n_issues"))


def _events(spark, sf_dir):
    """The complaint corpus as an adverse-event table."""
    c = corpus(spark, sf_dir, "complaints")
    role = F.when(F.col("l_partkey") % 3 == 0, "Dietary Supplement").when(F.col("l_partkey") % 3 == 1, "Cosmetics").otherwise("Other")
    narrative = F.when(F.col("l_suppkey") % 10 == 0, "nan").when(F.col("l_suppkey") % 10 == 1, "short").otherwise(F.col("text"))
    return c.select("doc_id", narrative.alias("PRI_Reported Adverse Events"), F.when(F.col("l_suppkey") % 2 == 0, F.col("p_name")).alias("PRI Reported Brand/Product Name"), role.alias("Product Role"), F.when(F.col("l_suppkey") % 4 == 0, "F").alias("CI_Gender"))


_NARR = "case when l_suppkey % 10 = 0 then null when l_suppkey % 10 = 1 then 'short' else text end"
_TEXT = f"case when length(concat_ws(' | ', {_NARR}, case when l_suppkey % 2 = 0 then p_name end)) > 20 then concat_ws(' | ', {_NARR}, case when l_suppkey % 2 = 0 then p_name end) end"


@plan("complaint_text", with_("complaints", sql=f"select doc_id, {_TEXT} complaint from complaints"))
def complaint_text(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("doc_id", X.complaint_text(e.columns).alias("complaint"))


@plan("complaint_metadata", with_("complaints", sql="select doc_id, (1 + (l_suppkey % 2 = 0)::int + (l_suppkey % 4 = 0)::int)::int n_keys, case when l_suppkey % 2 = 0 then p_name end product_name from complaints"))
def complaint_metadata(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("doc_id", X.complaint_metadata(e.columns).alias("m")).select("doc_id", F.size("m").alias("n_keys"), F.col("m")["product_name"].alias("product_name"))


@plan("category_filter", with_("complaints", sql="select doc_id from complaints where l_partkey % 3 < 2"))
def category_filter(spark, sf_dir):
    return X.filter_by_category(_events(spark, sf_dir), ["cosmetics", "supplements"]).select("doc_id")


_INGEST = f"""d as (select doc_id, {_TEXT} t from complaints),
x as (select term, 'SYMPTOM' label from ({SYMPTOM_LEXICON}) union all select distinct p_name, 'PRODUCT' from part),
h as (select doc_id, t, label, length(term) n, list_sum(list_transform(g[1:i], lambda z: length(z))) + (i - 1) * length(term) s from (
  select *, unnest(range(1, len(g))) i from (select doc_id, t, term, label, string_split(lower(t), lower(term)) g from d, x where contains(lower(t), lower(term))))),
k as (select doc_id, label from h where (s = 0 or not regexp_matches(substr(t, s::bigint, 1), '[A-Za-z0-9]')) and not regexp_matches(substr(t, (s + n + 1)::bigint, 1), '[A-Za-z0-9]')),
c as (select d.doc_id, t, count(label) n, count(*) filter (where label = 'SYMPTOM') s, count(*) filter (where label = 'PRODUCT') p from d left join k using (doc_id) group by 1, 2),
r as (select *, case when t is null then 'no_text' when n < 2 then 'no_spans' when doc_id % 50 = 0 or length(t) > 5000 then 'invalid' else 'successful' end status from c)"""


@plan("ingest_stats", with_("complaints", sql="select 1").removesuffix(" select 1") + f", {_INGEST} select count(*) total_rows, count(*) processed, count(*) filter (where status = 'no_text') skipped_no_text, count(*) filter (where status = 'no_spans') skipped_no_spans, count(*) filter (where status = 'invalid') validation_failed, count(*) filter (where status = 'successful') successful, coalesce(sum(n) filter (where status = 'successful'), 0)::bigint total_spans, coalesce(sum(s) filter (where status = 'successful'), 0)::bigint symptom_spans, coalesce(sum(p) filter (where status = 'successful'), 0)::bigint product_spans from r")
def ingest_stats(spark, sf_dir):
    """Counters over the exact matches of both lexicons; the span texts of every 50th record are spoilt, to fail the check."""
    e = _events(spark, sf_dir)
    docs = e.select("doc_id", X.complaint_text(e.columns).alias("text"))
    found = M.exact_records(docs, *((lexicon(spark, sf_dir, k), kind) for k, kind in (("symptom", M.SYMPTOM), ("product", M.PRODUCT))))
    spoilt = F.transform("spans", lambda s: s.withField("text", F.concat(F.lit("x"), s["text"])))
    return S.ingest_counters(found.withColumn("spans", F.when(F.col("doc_id") % 50 == 0, spoilt).otherwise(F.col("spans"))), min_spans=2)


def _lexicons(spark, sf_dir):
    a = lexicon(spark, sf_dir, "symptom").select(F.col("lex_ord").alias("ord"), "term", "canonical")
    b = _part(spark, sf_dir).select((F.col("p_partkey") + 1000).alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("canonical"))
    return a.unionByName(b)


_KNOW = "select lower(trim(p_name)) \"key\", arg_min('k' || p_partkey::varchar, p_partkey) canonical, count(distinct case when p_partkey % 2 = 0 then upper(p_name) else p_name end)::int n_examples from part group by 1"


@plan("knowledge_index", f"{_KNOW} union all select term, canonical, 1 from (values ('itching', 'Pruritus'), ('burning sensation', 'Burning'), ('rash', 'Rash'), ('headache', 'Headache'), ('redness', 'Erythema'), ('dizzy spells', 'Dizziness'), ('nausea', 'Nausea')) v(term, canonical)")
def knowledge_index(spark, sf_dir):
    return R.knowledge_index(_lexicons(spark, sf_dir)).select("key", "canonical", F.size("examples").alias("n_examples"))


@plan("knowledge_context", "select distinct p_name span_text, first_value('k' || p_partkey::varchar) over (partition by p_name order by p_partkey) canonical from part")
def knowledge_context(spark, sf_dir):
    spans = _part(spark, sf_dir).select(F.col("p_name").alias("span_text"))
    return R.knowledge_context(spans, R.knowledge_index(_lexicons(spark, sf_dir))).select("span_text", "canonical")


@plan("gold_enrich", with_("complaints", sql="select doc_id, p_name span_text, 'k' || (select max(p_partkey) from part p where p.p_name = c.p_name)::varchar concept from complaints c"))
def gold_enrich(spark, sf_dir):
    """Entities meet the lexicon by term or canonical; the later entry wins."""
    lex = _part(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.lower(F.trim("p_name")).alias("term"), F.lower(F.concat(F.lit("the "), "p_name")).alias("canon"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("concept"))
    keys = lex.select("ord", F.explode(F.array("term", "canon")).alias("key"), "concept").groupBy("key").agg(F.max_by("concept", "ord").alias("concept"))
    e = corpus(spark, sf_dir, "complaints").select("doc_id", F.col("p_name").alias("span_text"))
    return e.join(keys, F.lower(F.trim("span_text")) == F.col("key"), "left").select("doc_id", "span_text", "concept")


@plan("lexicon_build", "select term, canonical, 'dictionary' source, code concept_id from (select p_name term, p_name canonical, case when bool_or(p_partkey % 2 = 0) and max(p_partkey) % 2 = 0 then max(p_partkey)::varchar end code from part group by p_name union all select 'syn ' || p_name, p_name, case when max(p_partkey) % 2 = 0 then max(p_partkey)::varchar end from part group by p_name)")
def lexicon_build(spark, sf_dir):
    part = _part(spark, sf_dir)
    last = part.groupBy("p_name").agg(F.max("p_partkey").alias("k"))
    preferred = last.select(F.col("k").alias("ord"), F.col("p_name").alias("name"), F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("code"))
    synonyms = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("pt"), F.concat(F.lit("syn "), "p_name").alias("synonym"))
    return X.build_lexicon(preferred, synonyms)


def _prompts(spark, sf_dir):
    c = corpus(spark, sf_dir, "complaints")
    return c.select("doc_id", "l_partkey", F.concat(F.lit("Refine: "), F.col("text")).alias("prompt"))


@plan("llm_cache_join", with_("complaints", sql="select doc_id, bool_or(l_partkey % 2 = 0) over (partition by text) cached from complaints"))
def llm_cache_join(spark, sf_dir):
    p = _prompts(spark, sf_dir)
    cache = p.where("l_partkey % 2 = 0").select("prompt", F.lit('{"spans": []}').alias("response"))
    return R.call(p, cache).select("doc_id", "cached")


def _responses(spark, sf_dir):
    c = corpus(spark, sf_dir, "complaints")
    k = F.col("l_partkey")
    one = F.concat(F.lit('{"spans": [{"start": "1", "end": 5, "label": "SYMPTOM", "llm_confidence": 0.'), (k % 90 + 10).cast("string"), F.lit('}, {"start": "x", "end": 5, "label": "SYMPTOM"}, {"start": 2, "end": 6, "label": "PRODUCT"}]}'))
    return c.select("doc_id", F.when(k % 5 == 0, "not json").when(k % 5 == 1, '{"notes": "none"}').otherwise(one).alias("response"))


@plan("llm_parse", with_("complaints", sql="select doc_id, (case when l_partkey % 5 < 2 then 0 else 3 end)::int n_spans, l_partkey % 5 = 0 parse_error from complaints"))
def llm_parse(spark, sf_dir):
    return _responses(spark, sf_dir).select("doc_id", R.parse(F.col("response")).alias("p")).select("doc_id", F.size("p.spans").alias("n_spans"), "p.parse_error")


@plan("llm_suggest_filter", with_("complaints", sql="select doc_id, (case when l_partkey % 5 < 2 then 0 when l_partkey % 90 + 10 >= 65 then 2 else 1 end)::int n_kept from complaints"))
def llm_suggest_filter(spark, sf_dir):
    return _responses(spark, sf_dir).select("doc_id", F.size(R.suggestions(R.parse(F.col("response"))["spans"])).alias("n_kept"))


@plan("llm_refine_stub", with_("complaints", sql="select doc_id, substr(sha256(text), 1, 16) text_hash, 0 suggestion_count from complaints"))
def llm_refine_stub(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints").select("doc_id", "text", F.concat(F.lit("Refine: "), F.col("text")).alias("prompt"))
    got = R.call(docs).select("doc_id", "text", R.suggestions(R.parse(F.col("response"))["spans"]).alias("s"))
    return got.select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), F.size("s").alias("suggestion_count"))
