"""Refinement of spans by a language model: prompts joined with cached responses, and what the responses say.

Providers are a stub, which suggests nothing, and a replay of a response table; nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.sources.records import SUGGESTION

STUB = '{"spans": [], "notes": "stub"}'
MIN_CONFIDENCE = 0.65


def call(prompts: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``prompts`` with ``response`` and ``cached``: from the cache by the hash of the prompt, else from the stub."""
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))
    if cache is None:
        return keyed.select("*", F.lit(STUB).alias("response"), F.lit(False).alias("cached"))
    known = cache.groupBy(F.sha2("prompt", 256).alias("key")).agg(F.max("response").alias("known"))
    return keyed.join(known, "key", "left").select(*keyed.columns, F.coalesce("known", F.lit(STUB)).alias("response"), F.col("known").isNotNull().alias("cached"))


def parse(response: Column) -> Column:
    """(spans, notes, parse_error): no spans and an error where the response is not JSON."""
    got = F.from_json(response, f"spans array<{SUGGESTION}>, notes string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.struct(F.coalesce(got["spans"], F.array().cast(f"array<{SUGGESTION}>")).alias("spans"), got["notes"].alias("notes"), (response.isNull() | got["_bad"].isNotNull()).alias("parse_error"))


def suggestions(spans: Column, least: float = MIN_CONFIDENCE) -> Column:
    """Spans with whole offsets and a label, confident enough; no confidence counts as enough."""
    number = lambda s, c: s[c].try_cast("int")
    good = F.filter(spans, lambda s: number(s, "start").isNotNull() & number(s, "end").isNotNull() & s["label"].isNotNull() & (F.coalesce(s["llm_confidence"].try_cast("double"), F.lit(least)) >= least) & (s["llm_confidence"].isNull() | s["llm_confidence"].try_cast("double").isNotNull()))
    return F.transform(good, lambda s: F.struct(number(s, "start").alias("start"), number(s, "end").alias("end"), s["label"].alias("label"), (F.coalesce(s["negated"], F.lit("")) != "").alias("negated"), s["canonical"].alias("canonical"), F.coalesce(s["llm_confidence"].try_cast("double"), F.lit(least)).alias("llm_confidence")))


def knowledge_index(lexicons: DataFrame) -> DataFrame:
    """key, canonical (the first), examples (sorted distinct terms). ``lexicons`` has ord, term, canonical."""
    return lexicons.groupBy(F.lower(F.trim("term")).alias("key")).agg(F.min_by("canonical", "ord").alias("canonical"), F.sort_array(F.collect_set("term")).alias("examples"))


def knowledge_context(spans: DataFrame, index: DataFrame) -> DataFrame:
    """One row per distinct span text that the index knows; the text is lower-cased but not trimmed."""
    return spans.select("span_text").distinct().join(F.broadcast(index) if index.limit(50_001).count() <= 50_000 else index, F.lower("span_text") == F.col("key")).select("span_text", "canonical", "examples")
