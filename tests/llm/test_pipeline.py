import corpus_pipeline as cp
from wireflow.llm import registry


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
        docs = out.cache()
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[3] > 0.7 * counts[0]
    pieces = docs.toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeats, clashing columns, and an empty table go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid int, label string, `offset` int"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(1, None, None, None, None, 1, "x", 1), (2, "", "en", "a", 0, 1, "x", 1), (None, own(1), "en", "a", 9, 1, "x", 1), (3, own(1), "en", "a", 9, 1, "x", 1), (3, own(1), "en", "a", 9, 1, "x", 1)]
    rows += [(10 + i, own(i + 5), "en", "a", 9, None, None, None) for i in range(20)] + [(40, " ".join(f"v{j}" for j in range(200_000)), "en", "b", 9, 1, "x", 1)]
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        columns = docs.columns
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, "")
            out.write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}-{i}")
            if i < 4:
                assert out.columns == columns
        ids = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/{k}-1").collect()}
        assert ids == ({3, 40, *range(10, 30)} if data else set())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0


def test_registry():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
