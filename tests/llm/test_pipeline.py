from test_decontaminate import brute as contaminated
from test_line_dedup import brute as deduped
from test_near_dup import brute as classes
from test_packing import check as packed

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    import corpus_pipeline as c
    from tesserine.llm import quality as q
    from tesserine.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    net = q.quality_network(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    for name, stage in c.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "t")
        after = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after
        if name == "quality classifier":
            score = dict(zip([r.doc_id for r in rows], net.score([r.text.encode() for r in rows])))
            assert {r.doc_id for r in after} == {i for i, s in score.items() if s >= q.THRESHOLD}
        elif name == "line dedup":
            want = {i: t for i, (_, n, t) in deduped(sorted((r.doc_id, r.text) for r in rows), 50).items() if not n or t.strip()}
            assert {r.doc_id: r.text for r in after} == want
        elif name == "MinHash near-dedup":
            found = classes([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id for r in after} == {i for (i, _), (k, _) in found.items() if i == k}
        else:
            bad = contaminated([(r.doc_id, r.text) for r in rows], items)
            assert {r.doc_id for r in after} == {i for i, v in bad.items() if not v[-1]}
        rows = after
    packed(c.STAGES[-1][1](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in rows], 1024)


def test_run(spark):
    import corpus_pipeline as c

    assert c.run(spark, SF).count() > 0


def test_nulls_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    clashing = {n: F.lit(i) for i, n in enumerate(("score", "__text", "__id", "__h", "__gone", "__key", "__node", "n_lines", "n_removed", "runs", "items", "n_words", "piece", "task"))}
    docs = [(1, "a plain text of some words here", "en", "s", 31), (2, None, "en", None, None), (None, "no id", None, "s", 5), (4, "", "de", "s", 0), (5, "one two three", "en", "s", 13), (5, "one two three", "en", "s", 13), (6, "word " * 30000, "en", "s", 150000)]
    for name, rows in (("full", docs), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clashing).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(7, "one two three"), (None, None)] if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in c.STAGES[:-1]:
            after = stage(spark, now, d)
            assert after.columns == now.columns
        packed = c.run(spark, d).collect()
        assert {r.doc_id for r in packed} == ({1, 2, None, 4, 6} if rows else set())


def test_registered_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
