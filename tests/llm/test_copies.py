"""Words that the pipeline writes of each source, against its target."""

from collections import Counter

import pytest

from ledgerloom.llm import mixing


def test_written_words_come_near_targets(spark, docs_of):
    import corpus_pipeline as pipeline

    # the hot source a has a third of all rows; b is wanted less, c more than it holds
    docs = docs_of([(n, f"{n} " + "w " * (20 + n % 40), "abacbc"[n % 6]) for n in range(6000)])
    sizes = {r["source"]: r for r in mixing.mixed(docs).collect()}
    out = pipeline.in_proportion(spark, docs, "").collect()
    written, copies = Counter(), Counter(r["doc_id"] for r in out)
    for r in out:
        written[r["source"]] += len(r["text"].split())
    for source, r in sizes.items():
        assert written[source] == pytest.approx(r["target"], rel=0.05)
    assert max(copies.values()) <= mixing.REPEATS
    again = pipeline.in_proportion(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in again) == copies


def test_stages_keep_columns_whatever_their_names(spark, docs_of, tmp_path):
    import corpus_pipeline as pipeline

    clash = dict(size=1, target=2.5, taken="t", _place=3, _row="r", leaks="l", score=0.5, predicted=1, held_out=True, node="n")
    docs = docs_of([(1, "one two three " * 9, "a"), (1, "another text of its own", "a"), (2, None, None), (None, "no id at all", "b")], **clash)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns
            assert all(r["score"] == 0.5 and r["leaks"] == "l" and r["taken"] == "t" for r in out.collect())
    one = [r["text"] for r in pipeline.without_copies(spark, docs, "").collect() if r["doc_id"] == 1]
    again = [r["text"] for r in pipeline.without_copies(spark, docs.repartition(3, "text"), "").collect() if r["doc_id"] == 1]
    assert len(one) == 1 and one == again
