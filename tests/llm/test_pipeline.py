"""Each stage of the pipeline against a plain version of it, on the rows its predecessor kept."""


import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import UNSEEN, check_packing

from foliomill.llm import secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    rows = [tuple(r) for r in docs.collect()]
    rows += [(8001, None, "en", "s", 0), (8002, "123 456", "en", "s", 7)]

    def apply(name, rows):
        frame = spark.createDataFrame(rows, docs.schema)
        out = stages[name](spark, frame, SF)
        return out, [tuple(r) for r in out.collect()]

    out, kept = apply("language_id", rows)
    assert out.columns == columns and set(kept) <= set(rows)
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert {8001, 8002} <= gone and len(gone) <= 5

    out, distinct = apply("near_dedup", kept)
    expected = {i for i, (_, c) in brute.components([(r[0], r[1]) for r in kept], 5, 80).items() if i == c}
    assert out.columns == columns and {r[0] for r in distinct} == expected and len(distinct) == len(expected)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out, clean = apply("decontamination", distinct)
    hits = brute.contamination([(r[0], r[1]) for r in distinct], items)
    assert out.columns == columns and {r[0] for r in clean} == {i for i, h in hits.items() if not h[1]}

    out, safe = apply("secret_scan", clean)
    before = {r[0]: r for r in clean}
    assert out.columns == columns and set(before) == {r[0] for r in safe}
    for r in safe:
        spans = brute.base_spans(before[r[0]][1])
        if not spans:
            assert r == before[r[0]]
        assert not brute.base_spans(r[1]) and (not spans or secrets.MARK in r[1]) and r[4] == len(r[1])

    _, pieces = apply("packing", safe)
    packed = stages["packing"](spark, spark.createDataFrame(safe, docs.schema), SF).collect()
    check_packing(packed, [(r[0], r[1]) for r in safe])
    assert len(packed) == len(pieces)


def test_run_and_empty_table(spark):
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(whole.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_language_stage_drops_kinds_that_training_never_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(900_002 + 7 * i, t, None, "odd", len(t)) for i, t in enumerate(UNSEEN)], docs.schema)
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    kept = stage(spark, docs.unionByName(odd), SF).select("doc_id").collect()
    strange = sum(r["doc_id"] >= 900_000 for r in kept)
    assert strange <= 0.2 * len(UNSEEN) and len(kept) - strange >= 0.95 * docs.count()


def test_stages_with_any_columns_repeated_rows_nulls_and_long_texts(spark):
    """Names of results and helpers among the columns, rows twice, texts null, empty and long: no stage fails or loses a clean row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1.5, "x", [1], "p") for r in docs]
    rows += [rows[0], rows[0], (70_001, None, None, "s", 0, 0.0, "y", None, None), (70_002, "", "en", "s", 0, 0.0, "z", [], "q"), (None, "no id here at all", "en", "s", 17, 0.0, "w", None, "n")]
    rows += [(70_003, " ".join(f"{docs[1]['text'].split()[i % 20]}{i}" for i in range(30_000)), "en", "s", 1, 0.0, "l", None, "long")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, spans array<int>, _kept string"
    frame = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        got = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in got} == {r[0] for r in rows} and sum(r["piece"] == 0 for r in got) == len(rows)
            continue
        assert out.columns == frame.columns
        ids = [r["doc_id"] for r in got]
        if name == "near_dedup":
            assert ids.count(rows[0][0]) <= 1 and {70_001, 70_002, 70_003, None} <= set(ids)
        elif name != "language_id":
            assert {70_001, 70_002, 70_003, None} <= set(ids) and ids.count(rows[0][0]) in (0, 3)
        else:
            assert not {70_001, 70_002} & set(ids) and ids.count(rows[0][0]) in (0, 3)
        if name == "secret_scan":
            assert len(got) == len(rows) and next(r["text"] for r in got if r["doc_id"] == 70_001) is None
