"""Queries and operators read their whole input."""

import pyarrow.parquet as pq

from tidemark.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_tree_newick_holds_every_order(spark):
    orders = [str(x) for x in pq.read_table(f"{SF}/orders.parquet")["o_orderkey"].to_pylist()]
    got = [r["text"] for r in QUERIES["tree_newick"](spark, SF).collect()]
    names = [x for t in got for x in t.rstrip(";").replace("(", ",").replace(")", ",").split(",") if x]
    assert sorted(names) == sorted(orders)


def test_long_texts_are_chunked_and_scanned_whole(spark):
    from tidemark.operators import texts

    long = "x = 1  # some line of a long file\n" * 50_000 + "# FIXME the last line\n"
    files = spark.createDataFrame([("a.py", long)], "path string, text string")
    assert [(r["path"], r["line"]) for r in texts.debt_items(files).collect()] == [("a.py", 50_001)]
    spans = list(texts.chunk_spans(long))
    assert spans[0][0] == 0 and spans[-1][1] == len(long)
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))
    assert texts.chunks(files).count() == len(spans)
