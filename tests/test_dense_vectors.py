from pyspark.sql import functions as F

from tidemark.operators import retrieval
from tidemark.operators.texts import hash_embedding


def test_dense_equals_sparse_and_shuffles_no_words(spark):
    rows = spark.createDataFrame([("a", "alpha beta beta gamma_1"), ("b", None), ("c", "x 12 !"), ("d", "delta " * 700), ("a", "beta more words"), ("e", "")], "id string, text string")
    got = {(r["id"], i): x for r in retrieval.dense(rows).collect() for i, x in enumerate(r["v"]) if x}
    assert got == {(r["id"], r["idx"]): r["val"] for r in hash_embedding(rows).collect()} and all(len(r["v"]) == retrieval.DIM for r in retrieval.dense(rows).collect())
    # No row for each word: the only shuffle is one of vectors.
    plan = retrieval.dense(rows.withColumn("id", F.col("id")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
