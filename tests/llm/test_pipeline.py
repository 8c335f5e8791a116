import corpus_pipeline
from pitpanel.llm import decontaminate, near_dedup, substring_dedup, weak_rules


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.Scratch(spark).table(stage(spark, docs, sf))
        seen[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            ids = {r[0] for r in docs.select("doc_id").collect()}
            assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {r[0] for r in weak_rules.quality_verdicts(before).filter("kept").collect()}
        if name == "near_duplicates":
            assert near_dedup.near_groups(docs, width=5).filter("not kept").count() == 0
        if name == "repeated_passages":
            assert substring_dedup.remove_repeats(before).filter("n_removed > 0").count() == before.exceptAll(docs).count()
        if name == "benchmark_passages":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.contamination(before, bench).filter("not contaminated").count() == len(ids)
    assert corpus_pipeline.run(spark, sf).count() == seen["packed"]


def test_stages_take_odd_rows(spark, sf):
    """Null ids and texts, ids beyond 2 ** 53, repeated rows, clashing names and empty tables, through every stage."""
    good = "the river rose in the night and by the morning it was over the road that leads to the old mill and to the town "
    other = "a long letter was on the table for the man who had come with his son to see that it is not as it was before "
    big = 1 << 60
    rows = [(big + 3, good, 1), (None, good, 2), (big + 1, good, None), (5, None, 3), (6, "", 4), (7, other, big + 5), (7, other, big + 5), (8, " \n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts long").coalesce(1)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = corpus_pipeline.Scratch(spark).table(stage(spark, docs, sf))
        seen[name] = sorted((r[0] for r in docs.collect()), key=str)
        if name != "packed":
            assert docs.columns == ["doc_id", "text", "counts"]
            assert {r["counts"] for r in docs.collect()} <= {None, 1, 2, big + 5}
    assert seen["quality_rules"] == sorted([big + 3, None, big + 1, 7, 7], key=str)
    for name in ("near_duplicates", "repeated_passages", "benchmark_passages", "packed"):
        assert seen[name] == sorted([None, big + 1, 7], key=str)


def test_stages_alone_take_odd_rows(spark, sf):
    rows = [(1, None), (None, None), (2, ""), (3, "one"), (3, "one"), (None, "two"), (1 << 60, "Three " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {name: stage(spark, docs, sf).count() for name, stage in corpus_pipeline.STAGES}
    assert counts == {"quality_rules": 0, "near_duplicates": 6, "repeated_passages": 7, "benchmark_passages": 7, "packed": 7}
