"""Vectors of terms from the company they keep: hashed contexts, skip-gram, neighbors, names of clades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import hash_index, hash_sign, path_tokens, tokenize
from tidemark.operators.graph import cut
from tidemark.operators.retrieval import nearest
from tidemark.operators.texts import cooccurrence, term_frequency

#: Contexts of a term that count, size of a vector, neighbors of a term (fixed values).
CONTEXTS, DIM, NEIGHBORS = 40, 64, 6
#: Terms of the evolution corpus that say how large a commit is (fixed values).
SIZES = ("churn_low", "churn_mid", "churn_high")


def term_vectors(rows: DataFrame, window: int = 2, least_df: int = 2) -> DataFrame:
    """(id, v) of terms in texts (id, text): their 40 most frequent contexts, signed and hashed into 64 places, as whole numbers."""
    counts = cooccurrence(rows, window, least_df).filter("term <> context")
    strongest = counts.withColumn("_k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "context"))).filter(F.col("_k") <= CONTEXTS)
    sums = strongest.groupBy("term", hash_index(F.col("context"), DIM).alias("idx")).agg(F.sum(hash_sign(F.col("context")) * F.col("n")).alias("val")).filter("val <> 0")
    held = sums.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    return held.select(F.col("term").alias("id"), F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0)).cast("bigint") for i in range(DIM)]).alias("v"))


def neighbors(vectors: DataFrame, terms: DataFrame, k: int = NEIGHBORS) -> DataFrame:
    """(term, rank, neighbor, score): the k other terms of greatest cosine to each of some terms (id)."""
    vectors = cut(vectors, "term-vectors")
    asked = vectors.join(terms.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "query_id")
    near = nearest(asked, vectors, k + 1).filter("query_id <> id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select(F.col("query_id").alias("term"), "rank", F.col("id").alias("neighbor"), "score")


def leading_terms(rows: DataFrame, n: int = 12) -> DataFrame:
    """(id): the n most frequent terms of texts (id, text), ties by name, those of commit sizes left out."""
    return term_frequency(rows).filter(~F.col("term").isin(*SIZES)).orderBy(F.desc("n"), "term").limit(n).select(F.col("term").alias("id"))


#: Words that one task of a training round learns from.
WORDS = 500_000


def skipgram(rows: DataFrame, size: int = DIM, window: int = 5, least: int = 2, rounds: int = 8, partitions: int | None = None, seed: int = 42):
    """A skip-gram model of texts (id, text), trained by Spark's own learner; ``partitions`` deals the training out, which changes the vectors.

    Where they are not given there is one for each ``WORDS`` words, so that a round takes as long for a large corpus, given the cores; small ones have one.
    Its vocabulary, terms that occur ``least`` times, is held by the driver: raise ``least`` with the corpus.
    """
    from pyspark.ml.feature import Word2Vec

    words = rows.select(tokenize(F.col("text")).alias("words"))
    if partitions is None:
        partitions = max(1, -(-(words.agg(F.sum(F.size("words"))).first()[0] or 0) // WORDS))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, numPartitions=partitions, seed=seed, inputCol="words", outputCol="v").fit(words)


def model_vectors(model) -> DataFrame:
    """(id, v) of a trained model's terms, for ``neighbors``."""
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("v"))


def clade_labels(members: DataFrame, vectors: DataFrame, common: int = 8, named: int = 3, most: int = 4) -> DataFrame:
    """(clade, label) of members (clade, path): its most common path words that have vectors, each with a near word not named yet.

    The words are looked for among the ``common`` most frequent of a clade, ties by name; the first ``named`` are taken.
    """
    vectors = cut(vectors, "label-vectors")
    counts = members.select("clade", F.explode(path_tokens(F.col("path"))).alias("id")).groupBy("clade", "id").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_k", F.row_number().over(Window.partitionBy("clade").orderBy(F.desc("n"), "id"))).filter(F.col("_k") <= common)
    known = ranked.join(vectors.select("id"), "id", "left_semi")
    focus = cut(known.withColumn("_k", F.row_number().over(Window.partitionBy("clade").orderBy("_k"))).filter(F.col("_k") <= named), "focus")
    near = neighbors(vectors, focus.select("id"), 2).filter(~F.col("neighbor").isin(*SIZES)).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))).alias("near"))
    rows = focus.join(near, focus["id"] == near["term"], "left").select("clade", F.struct("_k", "id", F.coalesce(F.transform("near", lambda x: x["neighbor"]), F.array().cast("array<string>")).alias("near")).alias("w"))

    def add(said, w):
        own = F.concat(said, F.array(w["id"]))
        return F.concat(own, F.slice(F.filter(w["near"], lambda x: ~F.array_contains(own, x)), 1, 1))

    told = rows.groupBy("clade").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return told.select("clade", F.array_join(F.slice(F.aggregate("ws", F.array().cast("array<string>"), add), 1, most), "/").alias("label"))
