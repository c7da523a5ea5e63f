"""The pipeline and its stages against what a plain reading of the rules gives."""

import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, n_chars int, _l_lost string, _s_text string, kept string"


def _documents():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copy = prose(60), prose(300)
    near = copy.split()
    near[20] = "edited"  # among the leading tokens, so that the line is no template of the other
    texts = {k: "\n".join(prose(30) for _ in range(3)) for k in range(10)}
    texts |= {20: prose(5), 21: "same words again " * 60, 22: None, 23: "", 24: " \t\n"}  # rejected
    texts |= {30: f"{prose(40)}\n{passage}", 31: f"{passage}\n{prose(40)}"}  # a passage in two documents
    texts |= {40: copy, 41: " ".join(near), 42: copy}  # a near copy, and an exact copy, which line dedup empties
    texts |= {50: f"{prose(40)} password: hunter2hunter2 {prose(5)}"}
    return texts, passage


def test_stages_and_run(spark, tmp_path):
    texts, passage = _documents()
    docs = spark.createDataFrame([(k, t, "en", len(t or ""), "mine", "his", "yes") for k, t in texts.items()], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, frame = {}, docs
    for name, stage in P.STAGES:
        frame = spark.createDataFrame((got := stage(spark, frame, str(tmp_path))).collect(), got.schema)
        seen[name] = frame
        if name != "best_fit_packing":
            assert frame.columns == docs.columns
            assert all((r._l_lost, r._s_text, r.kept) == ("mine", "his", "yes") and r.n_chars == len(r.text) for r in frame.collect())
    text_of = {name: {r.doc_id: r.text for r in df.collect()} for name, df in seen.items() if name != "best_fit_packing"}
    clean = set(range(10)) | {30, 31, 50}
    assert set(text_of["quality_rules"]) == clean | {40, 41, 42}
    assert set(text_of["line_dedup"]) == clean | {40, 41}
    assert passage in text_of["line_dedup"][30] and passage not in text_of["line_dedup"][31]
    assert set(text_of["near_dedup"]) == clean | {40}
    assert "hunter2" not in text_of["secret_scan"][50] and "[secret]" in text_of["secret_scan"][50]
    assert all(text_of["secret_scan"][k] == texts[k] for k in range(10))
    whole = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == clean | {40}
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, seen["best_fit_packing"].collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_python_workers_get_small_batches(spark, tmp_path, monkeypatch):
    from quillspan.llm.common import BATCH_BYTES, small_batches

    key, rng = "spark.sql.execution.arrow.maxBytesPerBatch", random.Random(5)
    words = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    rows = [(k, " ".join(rng.choices(words, k=8000)), "en") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    most, frame = BATCH_BYTES + 100_000, type(docs)  # a batch ends with the row that reaches the limit
    assert sum(len(t) for _, t, _ in rows) > most + 1_000_000
    plain = frame.mapInArrow

    def held(self, f, schema, *args, **kwargs):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes <= most, f"a batch of {batch.nbytes} bytes"
                    yield batch

            yield from f(small())

        return plain(self, run, schema, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", held)
    try:
        for name, stage in P.STAGES:
            if name in ("quality_rules", "near_dedup", "best_fit_packing"):
                spark.conf.unset(key)
                assert stage(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 150
        for own, kept in (("1000", 1000), ("64MB", BATCH_BYTES)):
            spark.conf.set(key, own)
            small_batches(spark)
            assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == kept
    finally:
        spark.conf.unset(key)


def test_near_copies_start_no_other_python_workers(spark, tmp_path, monkeypatch):
    texts, _ = _documents()
    docs = spark.createDataFrame([(k, t) for k, t in texts.items() if k >= 40], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def never(*args, **kwargs):
        raise AssertionError("createDataFrame serves rows by Python workers of another kind")

    monkeypatch.setattr(type(spark), "createDataFrame", never)
    assert sorted(r.doc_id for r in P.near_copies(spark, docs, str(tmp_path)).collect()) == [40, 50]
