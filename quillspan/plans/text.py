"""Queries over text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import constants as K, fuzzy, negation, text as T
from quillspan.operators.matching import per_text, scan_overlapping
from quillspan.plans.catalog import plan
from quillspan.plans.corpus import SYMPTOM_TERMS, corpus, with_

_WORD = r"\b\w[\w\-'']*\b"
#: Tokens of a text with offsets, one row each, for DuckDB.
_TOKENS_SQL = f"""
m as (select doc_id, text, regexp_extract_all(text, '{_WORD}') t, string_split_regex(text, '{_WORD}') g from complaints),
e as (select doc_id, text, t, g, unnest(range(1, len(t) + 1)) i from m),
tokens as (select doc_id, text, i - 1 as pos, t[i] tok, (list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(t[1:i - 1], lambda z: length(z))), 0)) s from e)
"""


@plan("tokenize_offsets", with_("complaints", sql="select 1").replace(" select 1", f", {_TOKENS_SQL} select doc_id, pos::int pos, tok, s::int start_pos, (s + length(tok))::int end_pos from tokens"))
def tokenize_offsets(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints")
    return docs.select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", F.col("t.tok").alias("tok"), F.col("t.start").alias("start_pos"), F.col("t.end").alias("end_pos"))


@plan("emoji_clean", with_("complaints", sql="select doc_id, replace(replace(text, 'a', '  '), 'rash', ' ') as x, 0 as n from complaints").split(" select doc_id, replace")[0] + " select doc_id, regexp_replace(replace(text, 'rash', '😀🔥'), '[\U0001F300-\U0001F64F]+', ' ', 'g') cleaned, length(text)::int n_chars from complaints")
def emoji_clean(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints")
    return docs.select("doc_id", T.emoji_clean(F.replace("text", F.lit("rash"), F.lit("😀🔥"))).alias("cleaned"), F.length("text").alias("n_chars"))


@plan("token_count", with_("complaints", sql=f"select doc_id, len(regexp_extract_all(text, '{_WORD}'))::int token_count from complaints"))
def token_count(spark, sf_dir):
    return corpus(spark, sf_dir, "complaints").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(K.TOKEN), F.lit(0))).alias("token_count"))


_PAIRS = "select distinct p_name a, case when length(p_name) % 2 = 0 then p_name || ' set' else replace(p_name, 'e', '') end b from part"


def _pairs(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_name").alias("a"), F.when(F.length("p_name") % 2 == 0, F.concat("p_name", F.lit(" set"))).otherwise(F.replace("p_name", F.lit("e"), F.lit(""))).alias("b")).distinct()


_SET = "list_distinct(list_filter(string_split(lower({}), ' '), lambda x: x <> ''))"


@plan("jaccard_score", f"with p as ({_PAIRS}) select a, b, round(len(list_intersect({_SET.format('a')}, {_SET.format('b')})) * 100.0 / len(list_distinct(list_concat({_SET.format('a')}, {_SET.format('b')}))), 6) score from p")
def jaccard_score(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@plan("fuzzy_scores")
def fuzzy_scores(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return pairs.select("a", "b", *(fuzzy.score(F.col("a"), F.col("b"), k).alias(k) for k in fuzzy.SCORERS))


@plan("exact_match", f"with p as ({_PAIRS}) select a, b, lower(a) = lower(b) same, a = b same_case from p")
def exact_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", T.exact_match(F.col("a"), F.col("b")).alias("same"), T.exact_match(F.col("a"), F.col("b"), True).alias("same_case"))


@plan("confidence_score", with_("weak", sql="select doc_id, ord, round(least(1.0::double, greatest(0.0::double, (l_partkey % 101) / 100.0 * 0.8::double + (l_suppkey % 101) / 100.0 * 0.2::double)), 6) score from weak"))
def confidence_score(spark, sf_dir):
    return corpus(spark, sf_dir, "weak").select("doc_id", "ord", F.round(T.confidence((F.col("l_partkey") % 101).cast("double"), (F.col("l_suppkey") % 101).cast("double")), 6).alias("score"))


@plan("negation_penalty", with_("weak", sql="select doc_id, ord, round(case when negated then greatest(0.0::double, confidence - 0.1::double) else confidence end, 6) score from weak"))
def negation_penalty(spark, sf_dir):
    return corpus(spark, sf_dir, "weak").select("doc_id", "ord", F.round(T.negation_penalty(F.col("confidence"), F.col("negated")), 6).alias("score"))


_ALIGN = """select doc_id, (s + case when length(tail) < length(cut) then length(front) else 0 end)::int start_pos, (e - length(tail))::int end_pos, inner_ span_text from (
select *, substr(cut, length(front) + 1, length(cut) - length(front) - length(tail)) inner_ from (
select *, regexp_extract(cut, '[^A-Za-z0-9]*$') tail, regexp_extract(cut, '^[^A-Za-z0-9]*') front from (
select doc_id, l_partkey % 20 s, l_partkey % 20 + l_suppkey % 12 e, substr(text, (l_partkey % 20 + 1)::bigint, (l_suppkey % 12)::bigint) cut from complaints)) where length(tail) < length(cut))"""


@plan("align_spans", with_("complaints", sql=_ALIGN))
def align_spans(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints").withColumn("s", (F.col("l_partkey") % 20).cast("int"))
    docs = docs.withColumn("a", T.align_span(F.col("text"), F.col("s"), F.col("s") + (F.col("l_suppkey") % 12).cast("int"))).where("a is not null")
    return docs.select("doc_id", F.col("a.start").alias("start_pos"), F.col("a.end").alias("end_pos"), F.col("a.text").alias("span_text"))


@plan("anatomy_filter", with_("complaints", sql=f"select doc_id, case when l_partkey % 2 = 0 then 'Face' else p_name end term, coalesce(len(regexp_extract_all(case when l_partkey % 2 = 0 then 'Face' else p_name end, '{_WORD}')) = 1 and lower(regexp_extract_all(case when l_partkey % 2 = 0 then 'Face' else p_name end, '{_WORD}')[1]) in {K.ANATOMY}, false) anatomy from complaints"))
def anatomy_filter(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints").withColumn("term", F.when(F.col("l_partkey") % 2 == 0, F.lit("Face")).otherwise(F.col("p_name")))
    return docs.select("doc_id", "term", T.is_anatomy_only(F.col("term")).alias("anatomy"))


@plan("text_hash", "select doc_id, substr(sha256(text), 1, 16) h from documents")
def text_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.text_hash(F.col("text")).alias("h"))


_EMAIL, _PHONE, _SSN = (p.removeprefix("(?U)") for p in (K.EMAIL, K.PHONE, K.SSN))


@plan("deidentify_text", with_("complaints", sql=f"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}', '[PHONE]', 'g'), '{_SSN}', '[SSN]', 'g') masked from complaints"))
def deidentify_text(spark, sf_dir):
    return corpus(spark, sf_dir, "complaints").select("doc_id", T.deidentify(F.col("text")).alias("masked"))


_PII = " union all ".join(f"select doc_id, '{k}' kind, regexp_extract(text, '{p}') tok, length(string_split_regex(text, '{p}')[1])::int start_pos from complaints where regexp_matches(text, '{p}')" for k, p in (("email", _EMAIL), ("phone", _PHONE), ("ssn", _SSN)))


@plan("pii_matches", with_("complaints", sql=_PII))
def pii_matches(spark, sf_dir):
    found = corpus(spark, sf_dir, "complaints").select("doc_id", F.explode(T.pii_matches(F.col("text"))).alias("m"))
    return found.select("doc_id", "m.kind", "m.tok", F.col("m.start").alias("start_pos"))


@plan("deidentify_adjust_spans", with_("complaints", sql=f"select doc_id, (length(text) - 10 + case when regexp_matches(text, '{_EMAIL}') then 7 - length(regexp_extract(text, '{_EMAIL}')) else 0 end + case when regexp_matches(text, '{_PHONE}') then 7 - 12 else 0 end + case when regexp_matches(text, '{_SSN}') then 5 - 11 else 0 end)::int start_pos from complaints where not regexp_matches(right(text, 10), '[0-9]|@')"))
def deidentify_adjust_spans(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints").where(~F.substring("text", -10, 10).rlike("[0-9]|@"))
    spans = F.array(F.struct((F.length("text") - 10).alias("start"), F.length("text").alias("end")))
    docs = docs.select("doc_id", F.explode(T.shift_spans(spans, T.pii_matches(F.col("text")), T.deidentify(F.col("text")))).alias("s"))
    return docs.select("doc_id", F.col("s.start").alias("start_pos"))


_CUE = "(lower(tok) in " + str(K.NEGATION_CUES).replace('"n\'t"', "'n''t'") + " or " + " or ".join(f"starts_with(lower(tok), '{c}')" for c in K.NEGATION_CUES if len(c) > 3) + ")"


@plan("negation_cues", with_("complaints", sql="select 1").replace(" select 1", f", {_TOKENS_SQL} select doc_id, pos::int pos, tok from tokens where {_CUE}"))
def negation_cues(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints").select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "t"))
    return docs.where(negation.is_cue(F.col("t.tok"))).select("doc_id", "pos", F.col("t.tok").alias("tok"))


_REGIONS = f"""select c.doc_id, r.region_start::int region_start, r.region_end::int region_end from (select doc_id, pos from tokens where {_CUE}) c,
lateral (select min(t.s) region_start, max(t.s + length(t.tok)) region_end from tokens t where t.doc_id = c.doc_id and t.pos between c.pos + 1 and c.pos + 5
union all select min(t.s), max(t.s + length(t.tok)) from tokens t where t.doc_id = c.doc_id and t.pos between c.pos - 5 and c.pos - 1) r where r.region_start is not null"""


@plan("negated_regions", with_("complaints", sql="select 1").replace(" select 1", f", {_TOKENS_SQL} {_REGIONS}"))
def negated_regions(spark, sf_dir):
    found = lambda texts: texts.select("doc_id", F.explode(negation.negated_regions(T.tokenize(F.col("text")))).alias("r"))
    return per_text(corpus(spark, sf_dir, "complaints"), found).select("doc_id", F.col("r.start").alias("region_start"), F.col("r.end").alias("region_end"))


@plan("is_negated_overlap", with_("weak", "gold", sql="select w.doc_id, w.ord, coalesce(bool_or(g.doc_id is not null and greatest(0, least(w.end_, g.end_) - greatest(w.start_, g.start_)) >= (w.end_ - w.start_) * 0.5), false) negated from weak w left join gold g on w.doc_id = g.doc_id and g.start_ < w.end_ and g.end_ > w.start_ group by 1, 2"))
def is_negated_overlap(spark, sf_dir):
    regions = corpus(spark, sf_dir, "gold").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("end").cast("int"))).cast(negation.REGIONS).alias("regions"))
    spans = corpus(spark, sf_dir, "weak").join(regions, "doc_id", "left")
    return spans.select("doc_id", "ord", F.coalesce(negation.covered(F.col("start"), F.col("end"), F.col("regions")), F.lit(False)).alias("negated"))


_SENTENCES = """select doc_id, i - 1 as pos, p[i] as sentence, (coalesce(list_sum(list_transform(p[1:i - 1], lambda z: length(z))), 0) + i - 1)::int start_pos,
(coalesce(list_sum(list_transform(p[1:i - 1], lambda z: length(z))), 0) + i - 1 + length(p[i]))::int end_pos
from (select doc_id, p, unnest(range(1, len(p) + 1)) i from (
select doc_id, string_split(replace(replace(replace(text, '! ', '!' || chr(1)), '? ', '?' || chr(1)), '. ', '.' || chr(1)), chr(1)) p from complaints))"""


@plan("sentence_split", with_("complaints", sql=_SENTENCES))
def sentence_split(spark, sf_dir):
    found = corpus(spark, sf_dir, "complaints").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("s.tok").alias("sentence"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


_SCAN_TERMS = (*(t for t, _ in SYMPTOM_TERMS), "ss", "es", "aa")


_SCAN = f"""select doc_id, term canonical, substr(text, i + 1, length(term)) span_text, i::int start_pos, (i + length(term))::int end_pos
from (select doc_id, text, term, unnest(range(0, length(text) - length(term) + 1)) i from complaints, (select unnest({list(_SCAN_TERMS)}) term) where contains(lower(text), term))
where substr(lower(text), i + 1, length(term)) = term"""


@plan("exact_scan_overlapping", with_("complaints", sql=_SCAN))
def exact_scan_overlapping(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in _SCAN_TERMS], "term string")
    found = scan_overlapping(corpus(spark, sf_dir, "complaints"), terms)
    return found.select("doc_id", "canonical", "span_text", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@plan("llm_prompt", with_("complaints", sql="select doc_id, 'Text: ' || text || chr(10) || p_name || ' [0,5] PRODUCT conf=' || printf('%.2f', 0.5 + (l_partkey % 40) / 100.0) || chr(10) || 'none' prompt from complaints"))
def llm_prompt(spark, sf_dir):
    docs = corpus(spark, sf_dir, "complaints")
    spans = F.array(F.struct(F.col("p_name").alias("text"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("PRODUCT").alias("label"), (F.lit(0.5) + (F.col("l_partkey") % 40) / 100.0).alias("confidence")))
    return docs.select("doc_id", T.prompt(F.lit("Text: {text}\n{candidates}\n{knowledge}"), F.col("text"), spans, F.lit("none")).alias("prompt"))
