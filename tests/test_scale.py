"""What a query does once however often a value comes again, how rows are dealt, and results that must not depend on that."""

import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quillspan.functions import constants as K
from quillspan.operators import matching as M

LEXICON = "lex_ord int, term string, canonical string, source string, concept_id string, sku string, category string"


def lexicon(spark, *terms):
    return spark.createDataFrame([(k, t, t.title(), "s", None, None, None) for k, t in enumerate(terms)], LEXICON)


def test_each_text_is_labelled_once(spark, monkeypatch):
    texts = ["No itching but burning sensation later", "Severe rash"] * 20 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, prepare = [], M.prepare
    monkeypatch.setattr(M, "prepare", lambda d, s: seen.append(d) or prepare(d, s))
    symptoms, products = lexicon(spark, "itching", "burning sensation", "rash"), lexicon(spark, "cream")
    got = M.weak_label(docs, symptoms, products).orderBy("doc_id", "span_idx").collect()
    assert [(r.doc_id, r.span_idx, r.start, r.end, r.negated) for r in got if r.doc_id > 37] == [(38, 0, 3, 10, True), (38, 1, 15, 32, True), (38, 2, 15, 22, True), (39, 0, 7, 11, False)]
    assert len(got) == 80 and len(seen) == 4
    assert all(d.count() == 3 for d in seen)  # not 42
    records = M.weak_records(docs, symptoms, products).orderBy("doc_id").collect()
    assert [len(r.spans) for r in records] == [3, 1] * 20 + [0, 0] and records == M.nested(docs, M.weak_label(docs, symptoms, products)).orderBy("doc_id").collect()


def windows(text, terms):
    """The pairs of the reference's fuzzy pass before scoring, rule by rule."""
    tokens = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\b\w[\w\-']*\b", text)]
    content = lambda toks: {t for t in toks if t not in K.STOPWORDS}
    for size in range(1, K.MAX_TERM_WORDS + 1):
        for at in range(len(tokens) - size + 1):
            part = tokens[at : at + size]
            toks = [t for t, _, _ in part]
            phrase, words = " ".join(toks), content(toks)
            if phrase in terms or len(phrase) < 3 or (size == 1 and phrase in K.ANATOMY) or not any(len(t) > 3 for t in words) or re.search("[,;.]", text[part[0][1] : part[-1][2]]):
                continue
            for term in terms:
                other = content(term.split())
                if term.split()[0] == toks[0] and abs(len(term.split()) - size) <= 1 and (both := words & other) and len(both) / min(len(words), len(other)) >= 0.5 and (size == 1 or term.split()[-1] == toks[-1]):
                    yield size, at, phrase, term


@pytest.mark.parametrize("text", ["burning red sensation and burning, sensation. burning bad sensation", "rash on my left arm and rash on arm, rash arm", "the itching of face", "burning sensatons"])
def test_candidates_are_those_of_the_reference(spark, text):
    terms = ["burning sensation", "rash on arm", "itching of the face", "burning"]
    got = M.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), lexicon(spark, *terms), M.SYMPTOM).collect()
    assert sorted((r["size"], r.at, r.phrase, r.t_phrase) for r in got) == sorted(windows(text, terms))


@pytest.fixture
def order_tables(spark, tmp_path):
    """Line items of 500 orders and their parts, as tables."""
    k = F.col("id")
    lines = spark.range(2000).select((k / 4).cast("long").alias("l_orderkey"), (k * 7 % 101).alias("l_partkey"), (k * 13 % 89).alias("l_suppkey"), (k % 4).cast("int").alias("l_linenumber"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(101).select(k.alias("p_partkey"), F.concat(F.lit("red bolt "), k.cast("string")).alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_partitions_follow_the_table_and_scores_stay_in_them(spark, order_tables, monkeypatch):
    from quillspan.operators import annotation as A, metrics as E
    from quillspan.plans import corpus as C

    monkeypatch.setattr(C, "PARTITION_BYTES", 1000)
    weak, llm, gold, annotated = (C.corpus(spark, order_tables, n) for n in ("weak", "llm", "gold", "annotated"))
    assert weak.rdd.getNumPartitions() > 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        for df in (E.best_iou(E.spots(weak), gold), E.corrections(weak, llm, gold), E.greedy_matches(weak, gold), A.consensus_iou(annotated)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_of_a_sorted_frame_are_numbered_without_gaps(spark):
    from quillspan.sources import records as X

    lines = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_000).alias("k")).orderBy("k").select(F.when(F.col("k") % 5 == 0, " ").otherwise(F.concat(F.lit("line "), F.col("k").cast("string"))).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = X.text_lines(lines).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = [k for k in range(200_000) if k % 5]
    assert sorted((r.id, r.text) for r in rows if r.id is not None) == [(i, f"line {k}") for i, k in enumerate(kept)]


CONFIDENCES = (51, 98, 79, 83, 64)


def test_means_at_a_bound_do_not_depend_on_partitions(spark, tmp_path):
    """The mean of these is 0.75 or the next double above it, by the order in which they are added."""
    from itertools import permutations

    from quillspan.plans import annotation as P

    orders = [cs for cs in permutations(CONFIDENCES)]
    (tmp_path / "lineitem.parquet").mkdir()
    for n in range(len(CONFIDENCES)):  # a file for each place, the later the larger, so that the last is read first
        rows = [(k, (cs[n] - 50) % 51, 1, n) for k, cs in enumerate(orders)] + [(1000 + k, 0, 1, n) for k in range(5000 * n)]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / f"{n}"))
        next((tmp_path / f"{n}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{n}.parquet")
    means = [reduce(lambda total, c: total + c / 100, cs, 0.0) / len(cs) for cs in orders]
    assert 0 < sum(m > 0.75 for m in means) < len(means)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        assert sorted(r.id for r in P.al_uncertain(spark, str(tmp_path)).collect() if r.id < 1000) == [k for k, m in enumerate(means) if m <= 0.75]
        assert {r.id: r.conf for r in P._records(spark, str(tmp_path)).collect() if r.id < 1000} == dict(enumerate(means))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ingest_and_regions_look_at_each_text_once(spark, order_tables, monkeypatch):
    from quillspan.plans import records, text

    seen, prepare, keyed = [], M.prepare, M.text_rows
    monkeypatch.setattr(M, "prepare", lambda d, s: seen.append(d) or prepare(d, s))
    total = records.ingest_stats(spark, order_tables).first()
    assert total.total_rows == 2000 == total.skipped_no_text + total.skipped_no_spans + total.validation_failed + total.successful
    assert len(seen) == 2 and all(d.select("text").distinct().count() == d.count() < 2000 for d in seen)
    calls = []
    monkeypatch.setattr(M, "text_rows", lambda d, f: keyed(d, lambda texts: calls.append(texts) or f(texts)))
    assert text.negated_regions(spark, order_tables).count() > 0 and len(calls) == 1
