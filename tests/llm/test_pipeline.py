import corpus_pipeline
from tests.llm import brute
from tidemark.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = cut(stage(spark, docs, SF), "test")
        after = docs.collect()
        seen[name] = len(after)
        if name == "packing":
            assert {r["doc_id"] for r in after} == set(before)
            continue
        assert docs.columns == columns
        left = {r["doc_id"]: r["text"] for r in after}
        if name == "exact dedup":
            assert len(left) == len(set(before.values())) and set(left.values()) == set(before.values())
        if name == "SimHash near-dedup":
            assert set(left) == set(brute.near_groups(before).values())
        if name == "substring dedup":
            want = brute.substring_dedup(list(before.items()))
            assert {i: len(brute.WORD.findall(t)) for i, t in left.items()} == {i: n - gone for i, (n, gone, _) in want.items()}
            assert all(left[i] == before[i] for i, (_, gone, _) in want.items() if not gone)
    assert corpus_pipeline.run(spark, SF).count() == seen["packing"]


def test_odd_rows_go_through_the_whole_chain(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "y"), (3, "one two three four five six", "z"), (3, "one two three four five six", "z"), (None, "seven eight nine", None), (4, "word " * 300_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string")
    spark.createDataFrame([(3, 0, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == ["doc_id", "text", "part"], name
    left = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [r["doc_id"] for r in left] == [None, 1, 3, 4] and left[0]["text"] == "seven eight nine" and left[3]["part"] == "w"
    pieces = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {None, 1, 3, 4} and sum(r["length"] for r in pieces if r["doc_id"] == 1) == 1
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = cut(stage(spark, none, str(tmp_path)), "none")
        assert none.count() == 0, name
