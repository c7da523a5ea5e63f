"""Readers and writers: lexicons, text lines, JSON lines, annotation tasks, adverse-event tables, registries.

Schemas are declared, never inferred. Lines are numbered by position in the file, not by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspan.functions import constants as K

SPAN = "struct<text:string,start:int,end:int,label:string,canonical:string,source:string,concept_id:string,sku:string,category:string,confidence:double,negated:boolean>"
WEAK = f"id string, text string, spans array<{SPAN}>, weak_spans array<{SPAN}>, entities array<{SPAN}>"
TASK = "id bigint, data struct<text:string>, annotations array<struct<result:array<struct<value:struct<start:int,end:int,text:string,labels:array<string>>>>>>"
SUGGESTION = "struct<start:string,end:string,label:string,negated:string,canonical:string,confidence_reason:string,llm_confidence:string,source:string>"


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def symptom_lexicon(raw: DataFrame) -> DataFrame:
    """Trimmed terms; canonical defaults to the term, source to ``unknown``. ``raw`` has lex_ord, term, canonical, source, concept_id."""
    term = _blank("term")
    return raw.select("lex_ord", term.alias("term"), F.coalesce(_blank("canonical"), term).alias("canonical"), F.coalesce(_blank("source"), F.lit("unknown")).alias("source"), _blank("concept_id").alias("concept_id")).where("term is not null")


def product_lexicon(raw: DataFrame) -> DataFrame:
    term = _blank("term")
    return raw.select("lex_ord", term.alias("term"), F.coalesce(_blank("canonical"), term).alias("canonical"), F.lit("product_lexicon").alias("source"), _blank("sku").alias("sku"), _blank("category").alias("category")).where("term is not null")


def read_lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A lexicon CSV; a missing file is an empty lexicon."""
    columns = ("term", "canonical", "source", "concept_id") if kind == "symptom" else ("term", "canonical", "sku", "category")
    try:
        raw = spark.read.option("header", True).csv(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    raw = raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns))
    numbered = _numbered(raw, "lex_ord")
    return symptom_lexicon(numbered) if kind == "symptom" else product_lexicon(numbered)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the session's checkpoint folder, or with the executors where it has none."""
    return df.localCheckpoint() if df.sparkSession.sparkContext.getCheckpointDir() is None else df.checkpoint()


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Consecutive numbers in file order: counts per partition first, then an offset.

    The rows are kept in between, as a frame that is computed again may be dealt anew: a sort samples other bounds each time.
    """
    df = _kept(df)
    rows = df.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()})
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()  # one row per partition
    start, starts = 0, {}
    for r in sizes:
        starts[r["_p"]], start = start, start + r["n"]
    if not starts:
        return df.withColumn(name, F.lit(0)).limit(0)
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("_p"))
    return rows.withColumn(name, (offset + F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_p", "_k")


def text_lines(lines: DataFrame) -> DataFrame:
    """id, text: trimmed lines without blank ones, numbered from 0 after that. ``lines`` has ``value`` in file order."""
    kept = lines.select(F.trim("value", F.lit(" \t\r\n")).alias("text")).where("text <> ''")
    return _numbered(kept, "id").select("id", "text")


def read_json_lines(spark: SparkSession, path: str, schema: str = WEAK, strict: bool = True) -> DataFrame:
    """Strict reading fails on a bad line; otherwise bad lines come with ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``value`` parsed as JSON: the record's fields and ``bad``. What follows a record makes a line bad: as the one member of an array, it must parse alone."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{schema}>>")
    bad = F.col("_corrupt_record").isNotNull() | ~F.coalesce(F.col("alone") == 1, F.lit(False))
    rows = lines.where(F.trim("value") != "").select(parsed.alias("r"), F.size(alone).alias("alone"))
    return rows.select("r.*", "alone").withColumn("bad", bad).drop("_corrupt_record", "alone")


def spans_of(df: DataFrame) -> DataFrame:
    """Records with their spans under one name, whichever of spans, weak_spans and entities is filled."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    return df.withColumn("spans", F.coalesce(filled("spans"), filled("weak_spans"), filled("entities"), F.array().cast(f"array<{SPAN}>"))).drop("weak_spans", "entities")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An adverse-event CSV: all strings, Latin-1."""
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)


def _present(c: str) -> Column:
    return F.col(f"`{c}`")


def complaint_text(columns: list[str]) -> Column:
    """The narrative columns that say something, joined; null up to 20 characters."""
    parts = [F.when(~F.lower(F.trim(_present(c))).isin("nan", "none", ""), F.trim(_present(c))) for c in K.NARRATIVE_COLUMNS if c in columns]
    joined = F.concat_ws(" | ", *parts)
    return F.when(F.length(joined) > 20, joined)


def complaint_metadata(columns: list[str]) -> Column:
    """Map of what is known; per key the first column that is not null."""
    items = []
    for key, names in K.METADATA_COLUMNS.items():
        found = [F.trim(_present(c)) for c in names if c in columns]
        items += [F.lit(key), F.coalesce(*found) if found else F.lit(None).cast("string")]
    return F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull())


def filter_by_category(df: DataFrame, categories: list[str], columns: tuple[str, ...] = ("Product Role", "Product_Role", "Role")) -> DataFrame:
    """Rows whose role names one of the categories; unfiltered without a role column or a known category."""
    role = next((c for c in columns if c in df.columns), None)
    words = [w for c in categories for w in K.CATEGORIES.get(c, ())]
    return df.where(F.coalesce(_present(role).rlike("(?i)" + "|".join(words)), F.lit(False))) if role and words else df


def write_weak_records(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", False).json(path)


def write_lexicon(rows: DataFrame, path: str) -> None:
    """One sorted CSV file; a lexicon is small."""
    rows.orderBy(F.lower("canonical"), F.lower("term")).coalesce(1).write.option("header", True).csv(path)


def register_batch(spark: SparkSession, registry: str, batch_id: str, gold: DataFrame, gold_file: str, annotators: str, revision: int, notes: str, timestamp: str) -> DataFrame:
    """Append a row for a gold file to the registry and return it; the time is given, so that runs repeat."""
    row = gold.where(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n_tasks")).select(F.lit(timestamp).alias("timestamp"), F.lit(batch_id).alias("batch_id"), F.lit(gold_file).alias("gold_file"), "n_tasks", F.lit(annotators).alias("annotators"), F.lit(revision).alias("revision"), F.lit(notes).alias("notes"))
    row.write.mode("append").option("header", True).csv(registry)
    return row


def build_lexicon(preferred: DataFrame, synonyms: DataFrame, source: str = "dictionary") -> DataFrame:
    """Preferred terms and their synonyms: one row per (term, canonical) ignoring case, one with a code before one without, then the first.

    ``preferred`` has ord, name, code (the last duplicate's code wins); ``synonyms`` has ord, pt, synonym.
    """
    codes = preferred.groupBy("name").agg(F.max_by("code", "ord").alias("code"), F.min("ord").alias("ord"))
    rows = codes.select(F.col("name").alias("term"), F.col("name").alias("canonical"), "code", F.struct(F.lit(0), "ord").alias("at"))
    syn = synonyms.where("pt is not null and synonym is not null").join(codes.select(F.col("name").alias("pt"), "code"), "pt", "left")
    rows = rows.unionByName(syn.select(F.col("synonym").alias("term"), F.col("pt").alias("canonical"), "code", F.struct(F.lit(1), "ord").alias("at")))
    best = rows.groupBy(F.lower("term").alias("k1"), F.lower("canonical").alias("k2")).agg(F.min_by(F.struct("term", "canonical", "code"), F.struct(F.col("code").isNull(), "at")).alias("r"))
    return best.select("r.term", "r.canonical", F.lit(source).alias("source"), F.col("r.code").alias("concept_id"))
