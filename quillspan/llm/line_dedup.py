"""Line dedup by a log-template tree: lines are parsed by token count and leading tokens, variable fields are
generalised, and templates that recur across documents are dropped.

Built-in functions only. The path through the tree is the number of tokens, then the leading tokens: all of a line of up to
DEPTH tokens, else DEPTH or half of them, whichever is more. Tokens with a digit are variable and read ``<*>``, and so
is what follows the leading tokens, so that lines of one template agree in at least half of
their tokens. A template found in ``min_docs`` documents or more recurs, one of LONG tokens or more already in two: such a
passage is no chance. It stays in the first of them (the smallest id) and is dropped from the others. Lines with fewer than
MIN_TOKENS tokens are never dropped.

Templates are counted once per document before anything is shuffled and combined on the map side; what is
shuffled are 128-bit keys, never lines. Lines of the commonest templates, fewer than HOT by their share, are judged by a
broadcast, so that no line is so common that it burdens one task. Texts are shuffled once, to meet the numbers of the lines that
they lose.

Defined results: a null text stays null and has no lines; rows that repeat an id and a text are one document;
an empty table gives an empty result; other columns are kept by ``dedup_lines``, whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.llm.common import durable, unused

DEPTH, MIN_TOKENS, MIN_DOCS = 8, 3, 3
#: Tokens from which a template recurs in two documents.
LONG = 20
#: Templates that make up more than one in HOT of all recurrences, of which there are fewer than HOT, are broadcast.
HOT = 10_000


def _key(line: Column) -> Column:
    """(key, long): the 128-bit name of a line's template; null for a line that is too short to be one."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*", "<*>")).otherwise(line)
    tokens = F.filter(F.split(F.translate(masked, "\t\x0b\f\r", "    "), " "), lambda t: t != "")
    name = lambda t: F.unhex(F.md5(F.concat_ws(" ", F.size(t).cast("string"), F.concat_ws(" ", F.slice(t, F.lit(1), _lead(F.size(t)))))))
    return F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= MIN_TOKENS, F.struct(name(t).alias("key"), (F.size(t) >= LONG).alias("long"))))[0]


def _lead(n: Column) -> Column:
    return F.greatest(F.lit(DEPTH), F.ceil(n / 2).cast("int"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text) and the template key of every line."""
    text = F.col(text_col)
    return docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.transform(F.split(text, "\n", -1), _key).alias("keys"))


def recurring(keyed: DataFrame, repeated: bool, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, first, n: the templates that recur, the document that keeps them and how many have them; ``repeated`` says that ids may repeat."""
    once = keyed.dropDuplicates(["id", "h"]) if repeated else keyed  # few tables repeat rows; the others are spared the shuffle of their keys
    rows = once.select("id", "h", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k"))
    # the texts of a repeated id, if they differ, are documents of their own
    found = rows.groupBy(F.col("k.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h")).alias("first"), F.max("k.long").alias("long"))
    return found.where(F.col("n") >= F.when(F.col("long"), F.lit(min(2, min_docs))).otherwise(F.lit(min_docs))).select("key", "first", "n")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """id, h, lost: the numbers of the lines that a document loses; only documents that lose any."""
    keyed = _keyed(docs, id_col, text_col)
    repeated = not docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    lines = keyed.select("id", "h", F.posexplode_outer("keys").alias("at", "k")).where("k is not null").select("id", "h", "at", F.col("k.key").alias("key"))
    found = durable(recurring(keyed, repeated, min_docs))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = found.where(F.col("n") * HOT > F.lit(total)).select("key", F.col("first").alias("common"))
    # lines of common templates are judged by the broadcast and spread over all tasks, the others meet their template by its key
    lines = lines.join(F.broadcast(hot), "key", "left")
    spread = F.unhex(F.md5(F.xxhash64("id", "h", "at").cast("string")))
    met = lines.withColumn("key", F.when(F.col("common").isNull(), F.col("key")).otherwise(spread)).join(found.select("key", "first"), "key", "left")
    keeper = F.coalesce("common", "first")
    hit = met.where(keeper.isNotNull() & ~F.struct("id", "h").eqNullSafe(keeper))
    return hit.groupBy("id", "h").agg(F.array_sort(F.collect_set("at")).alias("lost"))


def _without(lines: Column, lost: Column) -> Column:
    """``lines`` without the numbers in ``lost`` (ascending): the slices between them."""
    edges = F.concat(F.array(F.lit(-1)), lost, F.array(F.size(lines)))
    inner = F.slice(edges, F.lit(1), F.size(edges) - 1)
    return F.flatten(F.zip_with(inner, F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def _with_lost(docs: DataFrame, id_col: str, text_col: str, min_docs: int) -> tuple[DataFrame, str]:
    """``docs`` with the numbers of the lost lines, and the name of that column."""
    name = unused(docs, "_l_")
    lost = dropped_lines(docs, id_col, text_col, min_docs).toDF(f"{name}id", f"{name}h", f"{name}lost")
    same = docs[id_col].eqNullSafe(lost[f"{name}id"]) & (F.xxhash64(docs[text_col]) == lost[f"{name}h"])
    return docs.join(lost, same, "left"), f"{name}lost"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the recurring lines gone from the texts; all columns stay, and all rows, but with ``drop_emptied`` for those that lost every word."""
    df, lost = _with_lost(docs, id_col, text_col, min_docs)
    new = F.array_join(_without(F.split(F.col(text_col), "\n", -1), F.col(lost)), "\n")
    df = df.withColumn(text_col, F.when(F.col(lost).isNotNull(), new).otherwise(F.col(text_col)))
    if drop_emptied:
        df = df.where(F.col(lost).isNull() | F.col(text_col).rlike(r"[^ \t\n\x0B\f\r]"))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, and n_chars and text_sha256 of what is left of the text."""
    df, lost = _with_lost(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col, "text", min_docs)
    lines = F.split(F.col("text"), "\n", -1)
    left = F.when(F.col(lost).isNotNull(), F.array_join(_without(lines, F.col(lost)), "\n")).otherwise(F.col("text"))
    df = df.select(id_col, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"), left.alias("left"))
    return df.select(id_col, F.when(F.col("lines") < 0, F.lit(0)).otherwise(F.col("lines")).cast("long").alias("n_lines"), F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce(F.char_length("left"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("left", 256).alias("text_sha256"))


SQL = f"""
with d as (select doc_id, text, string_split(text, chr(10)) lines from documents),
l as (select doc_id, text, unnest(lines) line, unnest(range(len(lines))) pos from d),
t as (select doc_id, text, pos, line, list_filter(string_split_regex(regexp_replace(line, '[^ \\t\\x0B\\f\\r]*[0-9][^ \\t\\x0B\\f\\r]*', '<*>', 'g'), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') tok from l),
k as (select doc_id, text, pos, line, len(tok) >= {LONG} as is_long, case when len(tok) >= {MIN_TOKENS} then len(tok)::varchar || ' ' || array_to_string(tok[1:greatest({DEPTH}, ceil(len(tok) / 2)::int)], ' ') end k from t),
r as (select k, min(doc_id) first_doc from k where k is not null group by k having count(distinct doc_id) >= case when max(is_long) then {min(2, MIN_DOCS)} else {MIN_DOCS} end),
f as (select k.*, r.first_doc is not null and r.first_doc <> doc_id gone from k left join r using (k)),
o as (select doc_id, text, count(*) n_lines, count(*) filter (where gone) n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') rest from f group by doc_id, text)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, coalesce(length(rest), 0) n_chars, case when d.text is not null then sha256(coalesce(rest, '')) end text_sha256
from d left join o on d.doc_id = o.doc_id and d.text = o.text
"""
