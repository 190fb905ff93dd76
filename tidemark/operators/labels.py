"""Words that describe files, labels of niches by their words, clades relabelled and described by what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import path_tokens, tokenize
from tidemark.operators import texts

# Words that name no niche, and a clade's role by its layer.
STOP = ("churn_low", "churn_mid", "churn_high", "py", "js", "ts", "src", "lib", "test", "tests", "file", "modules", "symbols", "notes")
ROLES = {
    "core": "domain nucleus — protect boundaries",
    "tests": "verification belt — raise co-touch with prod",
    "docs": "knowledge membrane",
    "config": "control plane / ops niche",
    "utility": "shared substrate — watch overcrowding",
    "other": "evolutionary niche",
}
TESTED = "verification belt — evidenced by test chunks"


def file_documents(files: DataFrame, types: DataFrame, symbols: int | None = None, notes: int | None = None) -> DataFrame:
    """(path, text) of files (path, text) and their types (path, type_path): words of path, type, identifiers and comment lines.

    All identifiers and comment words, or the first ``symbols`` and ``notes``. A null text has none; a file without a type no type words.
    """
    body = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(r"^\s*(#|//|\*)"))
    some = lambda c, n: c if n is None else F.slice(c, 1, n)
    words = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    said = F.flatten(F.transform(lines, tokenize))
    parts = {"file": F.translate("path", "/_", "  "), "type": words(F.col("type_path")), "modules": words(path_tokens(F.col("path"))), "symbols": words(some(tokenize(body), symbols)), "notes": words(some(said, notes))}
    joined = F.concat_ws(" ", *[x for name, c in parts.items() for x in (F.lit(name), c)])
    return files.join(types, "path", "left").select("path", F.trim(joined).alias("text"))


def niche_terms(docs: DataFrame, first: int = 24, most: int = 12) -> DataFrame:
    """(niche, k, term, n): a niche's commonest words of documents (id, niche, text), of the ``first`` those that name something."""
    counts = docs.select("niche", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("niche", "term").agg(F.count("*").alias("n"))
    own = Window.partitionBy("niche").orderBy(F.desc("n"), "term")
    top = counts.withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= first).filter(~F.col("term").isin(*STOP) & (F.length("term") > 2))
    return top.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= most).select("niche", "k", "term", "n")


def niche_labels(docs: DataFrame) -> DataFrame:
    """(niche, label, score): of ten terms, the first two and the first three of them, the phrase nearest to the niche's mean vector.

    Ties go to the phrase that stands first. A niche without terms is named by itself, at a score of zero.
    """
    terms = niche_terms(docs)
    joined = terms.filter("k <= 3").groupBy("niche").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda s: s["term"]).alias("t"))
    pairs = joined.select("niche", F.explode(F.array(*[F.struct(F.lit(10 + n).alias("k"), F.array_join(F.slice("t", 1, n), "/").alias("phrase")) for n in (2, 3)])).alias("s")).select("niche", "s.k", "s.phrase")
    phrases = terms.filter("k <= 10").select("niche", "k", F.col("term").alias("phrase")).unionByName(pairs).withColumn("id", F.struct("niche", "k"))
    near = texts.unit(texts.hash_embedding(phrases.select("id", F.col("phrase").alias("text"))))
    vectors = texts.unit(texts.hash_embedding(docs.select("id", "text"))).join(docs.select("id", "niche"), "id")
    mean = texts.mean_vector(vectors, "niche")
    norm = mean.groupBy("niche").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    dots = near.select("id", F.col("id.niche").alias("niche"), "idx", F.col("val").alias("p")).join(mean, ["niche", "idx"]).groupBy("niche", F.col("id.k").alias("k")).agg(F.sum(F.col("p") * F.col("val")).alias("d"))
    scored = phrases.drop("id").join(dots, ["niche", "k"], "left").join(norm, "niche", "left").withColumn("score", F.coalesce(F.round(F.col("d") / F.col("norm"), 9), F.lit(0.0)))
    best = scored.groupBy("niche").agg(F.min(F.struct((-F.col("score")).alias("m"), "k", "phrase")).alias("s"))
    return docs.select("niche").distinct().join(best, "niche", "left").select("niche", F.coalesce("s.phrase", F.col("niche").cast("string")).alias("label"), F.coalesce(-F.col("s.m"), F.lit(0.0)).alias("score"))


def relabel(clades: DataFrame, members: DataFrame, labels: DataFrame, agreement: float = 0.4, confidence: float = 0.35) -> DataFrame:
    """(clade, label, niche, agreement, confidence): a clade takes its commonest niche's label where enough of its files agree surely.

    ``clades``: clade, label; ``members``: path, clade, niche, confidence; ``labels``: niche, label. Files without a niche count as disagreeing.
    """
    votes = members.groupBy("clade", "niche").agg(F.count("*").alias("n"))
    top = votes.filter("niche is not null").groupBy("clade").agg(F.min(F.struct((-F.col("n")).alias("m"), "niche")).alias("s"))
    whole = members.groupBy("clade").agg(F.count("*").alias("all"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    j = clades.join(whole, "clade", "left").join(top, "clade", "left").withColumn("niche", F.col("s.niche")).join(labels.select("niche", F.col("label").alias("_new")), "niche", "left")
    agree = F.coalesce(-F.col("s.m") / F.col("all"), F.lit(0.0))
    sure = (agree >= agreement) & (F.coalesce("confidence", F.lit(0.0)) >= confidence) & F.col("_new").isNotNull()
    return j.select("clade", F.when(sure, F.col("_new")).otherwise(F.col("label")).alias("label"), "niche", agree.alias("agreement"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def guidance(clades: DataFrame, evidence: DataFrame) -> DataFrame:
    """(clade, label, role, layer) of clades (clade, label, layer, code_type) by rule, from what their evidence (clade, text) says."""
    low = F.lower("text")
    found = evidence.groupBy("clade").agg(F.count("*").alias("_n"), F.coalesce(F.bool_or(low.contains("test") | low.contains("assert")), F.lit(False)).alias("_test"), F.coalesce(F.bool_or(low.contains("readme") | low.contains("documentation")), F.lit(False)).alias("_doc"))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    own = F.coalesce("layer", F.lit("other"))
    tested, told = (F.coalesce(c, F.lit(False)) for c in ("_test", "_doc"))
    typed = F.coalesce("code_type", F.lit("")) != ""
    layer = F.when(tested, "tests").when(told, "docs").otherwise(own)
    base = F.when(tested, F.lit(TESTED)).otherwise(F.coalesce(role[own], F.lit(ROLES["other"])))
    whole = F.concat(base, F.when(typed, F.concat(F.lit("; typed as "), "code_type")).otherwise(""), F.when(F.col("_n") > 0, F.concat(F.lit(" [rag:"), F.col("_n").cast("string"), F.lit(" chunks]"))).otherwise(""))
    name = F.concat(layer, F.lit(":"), F.when(typed, F.col("code_type")).otherwise(F.coalesce("label", "clade")))
    return clades.join(found, "clade", "left").select("clade", name.alias("label"), whole.alias("role"), layer.alias("layer"))
