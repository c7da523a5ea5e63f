"""Corpora for the queries, made from the star-schema tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMPTOM_TERMS = (("itching", "Pruritus"), ("burning sensation", "Burning"), ("rash", "Rash"), ("headache", "Headache"), ("redness", "Erythema"), ("dizzy spells", "Dizziness"), ("nausea", "Nausea"))
_TERM = lambda key: "case " + " ".join(f"when {key} % 7 = {k} then '{t}'" for k, (t, _) in enumerate(SYMPTOM_TERMS)) + " end"

#: One complaint per line item: doc_id, text, category, id-derived keys.
COMPLAINTS = f"""
select l_orderkey * 1000 + nth as doc_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name,
  case (l_orderkey + l_linenumber) % 6
    when 0 then 'Patient reports ' || {_TERM('l_partkey')} || ' after using ' || p_name || '.'
    when 1 then 'No ' || {_TERM('l_partkey')} || ' seen with ' || p_name || ' today.'
    when 2 then 'Severe ' || {_TERM('l_partkey')} || ' and mild ' || {_TERM('l_suppkey')} || ' on face.'
    when 3 then 'Denies ' || {_TERM('l_partkey')} || ' but has ' || {_TERM('l_suppkey')} || ' since taking ' || p_name || '!'
    when 4 then 'Used ' || p_name || ', felt burning sensatons and called 555-123-4567 or 078-05-1120. ' || {_TERM('l_suppkey')}
    else 'Contact user' || cast(l_suppkey % 97 as string) || '@mail.example.com about ' || {_TERM('l_partkey')} || ' and dizzy spell. Thanks'
  end as text
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nth from {{lineitem}}) join {{part}} on l_partkey = p_partkey
"""

_SPAN = """
select l_orderkey as doc_id, cast(nth as int) as ord, cast(nth * 20 + l_partkey % 5 as int) as start_, cast(nth * 20 + l_partkey % 5 + 5 + l_suppkey % 7 as int) as end_,
  case when l_partkey % 3 = 0 then 'PRODUCT' else 'SYMPTOM' end as label, (50 + l_partkey % 51) / 100.0e0 as confidence, l_suppkey % 4 = 0 as negated,
  'c' || cast(l_partkey % 9 as string) as canonical, case when l_suppkey % 3 = 0 then 'severe rash' when l_suppkey % 3 = 1 then 'rash' else null end as span_text, l_partkey, l_suppkey
from (select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as nth from {lineitem})
"""
#: Spans: doc_id, ord, start_, end_, label, confidence, negated, canonical, span_text.
WEAK = _SPAN
GOLD = f"select doc_id, ord, start_ + l_suppkey % 4 - 1 as start_, end_ + l_partkey % 2 as end_, label, confidence, l_suppkey % 5 = 0 as negated, canonical, span_text from ({_SPAN}) where l_partkey % 11 <> 0"
LLM = f"select doc_id, ord, start_ + case when l_suppkey % 4 = 3 then 2 else l_suppkey % 4 - 1 end as start_, end_ + l_suppkey % 3 as end_, label, confidence, negated, canonical, span_text from ({_SPAN}) where l_suppkey % 13 <> 0"
#: Entities of three annotators per task (an order): task, annotator, ord, start_, end_, label.
ANNOTATED = f"""
select doc_id as task, 'ann' || cast(a as string) as annotator, ord, start_ + case when (l_partkey + a) % 4 = 0 then 1 else 0 end as start_, end_, case when (l_suppkey + a) % 9 = 0 then 'PRODUCT' else 'SYMPTOM' end as label
from ({_SPAN}) cross join (select 0 as a union all select 1 union all select 2) where (l_partkey + 3 * a) % 5 <> 0
"""
ALL = {"complaints": COMPLAINTS, "weak": WEAK, "gold": GOLD, "llm": LLM, "annotated": ANNOTATED}


def for_duckdb(name: str) -> str:
    return ALL[name].replace("{lineitem}", "lineitem").replace("{part}", "part").replace("as string)", "as varchar)")


def with_(*names: str, sql: str) -> str:
    """``sql`` with the corpora in front of it."""
    return "with " + ", ".join(f"{n} as ({for_duckdb(n)})" for n in names) + " " + sql


#: So many bytes of the stored line items go into one partition.
PARTITION_BYTES = 2 << 20


def by_order(spark: SparkSession, lines: DataFrame, *more: str) -> DataFrame:
    """Line items, with the columns ``more`` of the reader, dealt by order, over as many partitions as there are cores, more where the table is large.

    What works per order or document afterwards finds its rows together, so it deals nothing anew and a task's rows and
    memory stay the same however large the table is. Partitions asked for by number are not merged at run time.
    """
    stored = int(lines._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return lines.select("*", *more).repartition(max(spark.sparkContext.defaultParallelism, -(-stored // PARTITION_BYTES)), "l_orderkey")


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus as a frame; span offsets are named start and end."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part") if "{" + t + "}" in ALL[name]}
    tables["lineitem"] = by_order(spark, tables["lineitem"])
    return spark.sql(ALL[name], **tables).withColumnsRenamed({"start_": "start", "end_": "end"})


def lexicon(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """lex_ord, term, canonical, source, concept_id, sku, category."""
    columns = "lex_ord int, term string, canonical string, source string, concept_id string, sku string, category string"
    if kind == "symptom":
        return spark.createDataFrame([(k, t, c, "inline", f"S{k}", None, None) for k, (t, c) in enumerate(SYMPTOM_TERMS)], columns)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy("p_name").agg({"p_partkey": "min"}).selectExpr("cast(`min(p_partkey)` as int) lex_ord", "p_name term", "p_name canonical", "'product_lexicon' source", "cast(null as string) concept_id", "'K' || cast(`min(p_partkey)` as string) sku", "cast(null as string) category")


SYMPTOM_LEXICON = "select * from (values " + ", ".join(f"({k}, '{t}', '{c}')" for k, (t, c) in enumerate(SYMPTOM_TERMS)) + ") v(lex_ord, term, canonical)"
