"""Queries over dictionary matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import matching as M
from quillspan.plans.catalog import plan
from quillspan.plans.corpus import SYMPTOM_LEXICON, corpus, lexicon, with_


def _docs(spark, sf_dir):
    return corpus(spark, sf_dir, "complaints").select("doc_id", "text")


_EXACT = f"""select doc_id, canonical, s::int start_pos, (s + n)::int end_pos from (
select doc_id, canonical, length(term) n, text, list_sum(list_transform(g[1:i], lambda z: length(z))) + (i - 1) * length(term) s from (
select *, unnest(range(1, len(g))) i from (select doc_id, text, term, canonical, string_split(lower(text), term) g from complaints, ({SYMPTOM_LEXICON}) where contains(lower(text), term))))
where (s = 0 or not regexp_matches(substr(text, s::bigint, 1), '[A-Za-z0-9]')) and not regexp_matches(substr(text, (s + n + 1)::bigint, 1), '[A-Za-z0-9]')"""


@plan("match_exact", with_("complaints", sql=_EXACT))
def match_exact(spark, sf_dir):
    found = M.match_exact(_docs(spark, sf_dir), lexicon(spark, sf_dir, "symptom"), M.SYMPTOM)
    return found.select("doc_id", "canonical", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@plan("match_fuzzy_candidates")
def match_fuzzy_candidates(spark, sf_dir):
    return M.candidates(_docs(spark, sf_dir), lexicon(spark, sf_dir, "symptom"), M.SYMPTOM)


@plan("match_fuzzy")
def match_fuzzy(spark, sf_dir):
    return M.match_fuzzy(_docs(spark, sf_dir), lexicon(spark, sf_dir, "symptom"), M.SYMPTOM)


@plan("match_all")
def match_all(spark, sf_dir):
    return M.match(_docs(spark, sf_dir), lexicon(spark, sf_dir, "symptom"), M.SYMPTOM)


@plan("match_symptoms")
def match_symptoms(spark, sf_dir):
    return M.match(_docs(spark, sf_dir), lexicon(spark, sf_dir, "symptom"), M.SYMPTOM).select("doc_id", *M.SPAN_COLUMNS)


@plan("match_products")
def match_products(spark, sf_dir):
    return M.match(_docs(spark, sf_dir), lexicon(spark, sf_dir, "product"), M.PRODUCT).select("doc_id", *M.SPAN_COLUMNS)


def _lexicons(spark, sf_dir):
    return lexicon(spark, sf_dir, "symptom"), lexicon(spark, sf_dir, "product")


@plan("weak_label")
def weak_label(spark, sf_dir):
    return M.weak_label(_docs(spark, sf_dir), *_lexicons(spark, sf_dir))


@plan("weak_records_nested")
def weak_records_nested(spark, sf_dir):
    found = M.weak_records(_docs(spark, sf_dir), *_lexicons(spark, sf_dir))
    return found.select("doc_id", F.to_json(F.struct("text", "spans"), {"ignoreNullFields": "false"}).alias("record"))


@plan("export_weak_spans")
def export_weak_spans(spark, sf_dir):
    found = M.weak_records(_docs(spark, sf_dir), *_lexicons(spark, sf_dir))
    part = F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("text", "start", "end", "label", "canonical", "confidence", "negated"))))
    return found.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "text", part.alias("weak_spans")), {"ignoreNullFields": "false"}).alias("record"))
