import pytest
from pyspark.sql import functions as F

from quillspan.functions import fuzzy, negation, text as T
from quillspan.operators import matching as M, metrics as E, spans as S

SPAN = "doc_id long, ord int, start int, end int, label string, confidence double, negated boolean, span_text string"


def one(spark, expr, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("r")).first().r


@pytest.mark.parametrize(("a", "b", "score"), [("burning sensation", "severe burning", 100 / 3), ("the burning", "burning", 50), ("", "x", 0), ("burning red rash", "red rash swelling", 50)])
def test_jaccard(spark, a, b, score):
    assert one(spark, T.jaccard(F.lit(a), F.lit(b))) == pytest.approx(score)


def test_fuzzy_bounds():
    w = fuzzy.weighted_ratio
    assert w("a b", "a b") == 100
    assert w("burning sensation", "burning sensations") > 90
    assert w("burning sensation", "burninng sensation") > 85
    assert w("burning", "redness") < 50
    assert w("", "x") == 0
    assert fuzzy.token_set_ratio("gizmo", "widget") < 50


def test_confidence(spark):
    assert one(spark, T.confidence(F.lit(88.0), F.lit(60.0))) == pytest.approx(0.824)
    assert one(spark, T.confidence(F.lit(50.0), F.lit(30.0))) == pytest.approx(0.46)


@pytest.mark.parametrize("text", ["No itching", "Itching absent", "Without itching", "Denies itching", "Never experienced itching"])
def test_negated(spark, text):
    assert labels(spark, text)[0].negated


@pytest.mark.parametrize(("k", "negated"), [(1, True), (3, True), (5, True), (6, False), (10, False)])
def test_negation_window(spark, k, negated):
    assert labels(spark, "no " + "x " * (k - 1) + "itching")[0].negated is negated


def lexicon(spark, *terms):
    return spark.createDataFrame([(k, t, t.title(), "s", None, None, None) for k, t in enumerate(terms)], "lex_ord int, term string, canonical string, source string, concept_id string, sku string, category string")


def labels(spark, text, *terms):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return M.match(docs, lexicon(spark, *(terms or ("itching", "burning sensation"))), M.SYMPTOM).orderBy("start", "pass", "ord1", "ord2").collect()


def test_flagship_example(spark):
    got = [(r.start, r.end, r.canonical, round(r.confidence, 2), r.negated) for r in labels(spark, "No itching but burning sensation later")]
    assert got == [(3, 10, "Itching", 1.0, True), (15, 32, "Burning Sensation", 1.0, True), (15, 22, "Burning Sensation", 0.82, True)]


def test_unicode_and_edges(spark):
    assert [r.start for r in labels(spark, "Patiënt reports itching")] == [16]
    assert labels(spark, "") == [] and labels(spark, "   ") == []
    assert [r.start for r in labels(spark, "anti-itching itchings itching")][:1] == [5]
    assert M.match(spark.createDataFrame([(1, "itching")], "doc_id long, text string"), lexicon(spark), M.SYMPTOM).count() == 0


def test_filter_overlaps(spark):
    rows = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(c).alias("confidence")) for s, e, c in ((0, 5, 0.9), (3, 12, 0.5), (20, 22, 0.1))))
    starts = lambda k: [r.start for r in one(spark, S.filter_overlaps(rows, k))]
    assert starts("longest") == [3, 20] and starts("highest_confidence") == [0, 20] and starts("first") == [0, 20]
    with pytest.raises(ValueError):
        S.filter_overlaps(rows, "other")


def test_fixture_trio(spark):
    weak = spark.createDataFrame([(1, 0, 16, 40, "SYMPTOM", 0.72, False, "a"), (1, 1, 45, 57, "SYMPTOM", 0.85, False, "a"), (2, 0, 3, 10, "SYMPTOM", 0.68, True, "a"), (2, 1, 36, 41, "PRODUCT", 0.92, False, "a"), (3, 0, 12, 19, "SYMPTOM", 0.91, False, "a"), (3, 1, 24, 32, "SYMPTOM", 0.88, False, "a")], SPAN)
    gold = weak.withColumn("start", F.when(F.col("start") == 16, 23).when(F.col("start") == 45, 50).otherwise(F.col("start")))
    for scope in ("document", "corpus"):
        b = E.boundary_precision(weak, gold, scope).first()
        assert b.mean_iou == pytest.approx((17 / 24 + 7 / 12 + 4) / 6) and b.median_iou == 1.0 and b.exact_match_rate == pytest.approx(4 / 6)
        assert E.prf1(weak, gold, scope=scope).first()[:3] == (6, 0, 0)
    assert E.iou_delta(weak, gold, gold).first().improvement_pct == pytest.approx(13.3858, abs=1e-3)
    c = E.correction_rate(weak, gold, gold).first()
    assert (c.modified_count, c.improved_count, c.worsened_count, c.unchanged_count) == (2, 2, 0, 4)
    assert E.boundary_precision(weak.limit(0), gold).first().mean_iou == 0


def test_scopes_differ(spark):
    a = spark.createDataFrame([(1, 0, 3, 10, "SYMPTOM", 1.0, False, "a")], SPAN)
    b = a.withColumn("doc_id", F.lit(2).cast("long"))
    assert E.prf1(a, b, scope="corpus").first().precision == 1 and E.prf1(a, b).first().precision == 0


def test_threshold(spark):
    pairs = spark.createDataFrame([(0.9, True, 0), (0.8, True, 1), (0.7, False, 2), (0.6, False, 3)], "confidence double, correct boolean, ord int")
    assert E.calibrate_threshold(pairs, 1.0).first().threshold == 0.8
    assert E.calibrate_threshold(pairs.where("not correct"), 1.0).first().threshold == 0.0


def test_align_and_regions(spark):
    assert tuple(one(spark, T.align_span(F.col("text"), F.lit(0), F.lit(7)), "(itch).")) == (1, 5, "itch")
    assert one(spark, T.align_span(F.col("text"), F.lit(0), F.lit(2)), "..") is None
    assert one(spark, F.size(negation.negated_regions(T.tokenize(F.col("text")))), "no") == 1


def test_stream_equals_batch(spark, tmp_path):
    from quillspan.streaming import labeling

    docs = spark.createDataFrame([(k, f"No rash but itching {k}") for k in range(6)], "doc_id long, text string")
    docs.repartition(3).write.json(str(tmp_path / "in"))
    symptoms, products = lexicon(spark, "itching", "rash"), lexicon(spark, "cream")
    labeling.label_stream(labeling.read_documents(spark, str(tmp_path / "in"), 1), symptoms, products, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    streamed = spark.read.json(str(tmp_path / "out")).selectExpr("doc_id", "size(spans) n").orderBy("doc_id").collect()
    batch = M.nested(docs, M.weak_label(docs, symptoms, products)).selectExpr("doc_id", "size(spans) n").orderBy("doc_id").collect()
    assert streamed == batch and batch[0].n == 2


def test_agreement_of_empty_tasks_and_no_hits(spark):
    from quillspan.operators import annotation as A

    rows = [(1, "a", 0, 0, 5, "SYMPTOM"), (1, "b", 0, 0, 5, "SYMPTOM"), (2, "a", 0, 0, 5, "SYMPTOM"), (2, "c", 0, 7, 9, "SYMPTOM")]
    e = spark.createDataFrame(rows, "task int, annotator string, ord int, start int, end int, label string")
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (3, "b")], "task int, annotator string")
    got = {(r.annotator1, r.annotator2): (r.mean_, r.min_, r.max_) for r in A.agreement_jaccard(e, seen=seen).collect()}
    assert got[("a", "b")] == (2 / 3, 0.0, 1.0) and got[("a", "c")] == (0.0, 0.0, 0.0)
    assert {(r.annotator1, r.annotator2): r.dice for r in A.agreement_dice(e).collect()} == {("a", "b"): 1.0, ("a", "c"): 0.0}
    k = {(r.annotator1, r.annotator2): (round(r.kappa, 6), r.band) for r in A.kappa(e, seen=seen).collect()}
    assert k[("a", "b")] == (round((2 / 3 - 0.33) / 0.67, 6), "moderate") and k[("a", "c")] == (round(-0.33 / 0.67, 6), "poor")


def test_ingest_counters(spark):
    long = "rash on the left arm since May"
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, long), (5, long), (6, "rash")], "doc_id int, text string")
    rows = [(1, 0, 4, "SYMPTOM", "rash"), (1, 12, 16, "PRODUCT", "left"), (4, 0, 4, "SYMPTOM", "RASH"), (6, 0, 4, "SYMPTOM", "rash")]
    spans = spark.createDataFrame(rows, "doc_id int, start int, end int, label string, text string")
    assert tuple(S.ingest_stats(docs, spans).first()) == (6, 6, 2, 1, 2, 1, 2, 1, 1)
    assert tuple(S.ingest_stats(docs.limit(0), spans).first()) == (0,) * 9
