import corpus_pipeline
from samples import prose

from netloom.llm import queries


def test_stages(spark, tmp_path):
    item = prose(1234, 40)
    texts = [prose(k, 60) for k in range(30)] + [prose(3, 60), None, "123 !", f"{prose(50, 30)} {item}", "mail x.y@example.org now " + prose(51, 30)]
    rows = [(k, t, "en" if k % 2 else "de", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 34}
    assert got[34].text == "mail <email> now " + prose(51, 30) and got[34].n_chars == len(got[34].text)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) > 0 for r in got.values())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and len(queries.QUERIES) == 13


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, common string, lang_pred string"
    rows = [(k, prose(k, 50), "en" if k % 2 else "de", None, None, 7.5, "mine", "xx") for k in range(12)]
    rows += [(None, prose(100, 50), "en", None, None, 7.5, "mine", "xx"), (3, prose(3, 50), "de", None, None, 7.5, "mine", "xx"), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(0, prose(5, 50)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        docs = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == none.columns == [c.split()[0] for c in columns.split(", ")]
            docs = spark.createDataFrame(docs.collect(), columns)
    got = docs.collect()
    # the null text goes first, then the repeated row, then the benchmark's
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == [-1, *[k for k in range(12) if k != 5]]
    assert {(r.score, r.common, r.lang_pred) for r in got} == {(7.5, "mine", "xx")}
