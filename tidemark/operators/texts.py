"""Text, vectors and similarity over file contents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import debt_pattern, hash_index, hash_sign, shingles, stem, tokenize
from tidemark.operators.graph import cut


def matching_lines(files: DataFrame, patterns: list[str], max_lines: int | None = None) -> DataFrame:
    """(path, line, pattern, text): lines that match, with the number of the first pattern that does; of all lines or the first ``max_lines``."""
    split = F.split("text", "\n")
    lines = files.select("path", F.posexplode(split if max_lines is None else F.slice(split, 1, max_lines)).alias("line", "text"))
    return lines.withColumn("pattern", debt_pattern(F.col("text"), patterns)).filter("pattern is not null").select("path", (F.col("line") + 1).alias("line"), "pattern", "text")


def debt_items(files: DataFrame) -> DataFrame:
    """Debt markers with kind and severity."""
    from tidemark.functions.text import DEBT_PATTERNS

    found = matching_lines(files, DEBT_PATTERNS)
    todo = F.col("pattern") >= 6
    return found.select("path", "line", F.when(todo, "todo_debt").otherwise("deprecation").alias("kind"), F.when(F.lower("text").contains("deprecated"), "high").otherwise("med").alias("severity"), "text")


def debt_score(deprecations: Column, todos: Column, mistakes: Column) -> Column:
    return 0.45 * F.log1p(deprecations) / F.log(F.lit(81.0)) + 0.25 * F.log1p(todos) / F.log(F.lit(41.0)) + 0.30 * F.least(F.lit(1.0), mistakes / 4)


#: What opens a definition, by language (fixed values).
_DEFS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("), ("class", r"^\s*class\s+([A-Za-z_]\w*)\s*[\(:]")],
    "javascript": [("function", r"(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)"), ("class", r"(?:export\s+)?class\s+([A-Za-z_]\w*)")],
    "go": [("function", r"^func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\(")],
    "rust": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*[<(]")],
}


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line, stem) of definitions in files (path, lang, text)."""
    lines = files.select("path", "lang", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    rules = [F.when(F.col("lang") == lang, F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name"))) for lang, ps in _DEFS.items() for kind, p in ps]
    found = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(F.array_compact(F.array(*rules))).alias("d")).filter("d.name <> ''")
    return found.select("path", F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "line", stem(F.col("d.name")).alias("stem"))


def alleles(symbols: DataFrame) -> DataFrame:
    """(stem, a, b, similarity, kind): definitions of one stem in different files, groups of 2 to 12; vectors (stem, path, v) are unit."""
    group = symbols.groupBy("stem").agg(F.count("*").alias("n")).filter("n between 2 and 12")
    own = symbols.join(group, "stem").select("stem", "path", "v")
    pairs = own.select("stem", F.col("path").alias("a"), F.col("v").alias("va")).join(own.select("stem", F.col("path").alias("b"), F.col("v").alias("vb")), "stem").filter("a < b")
    out = pairs.select("stem", "a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"))
    return out.withColumn("kind", F.when(F.col("similarity") > 0.85, "exact_clone").when(F.col("similarity") <= 0.65, "mutant_allele").otherwise("allele"))


def chunk_spans(text: str, size: int = 700, overlap: int = 80, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping chunks, which end at a line break where one lies in their second half."""
    at = k = 0
    while at < len(text) and (most is None or k < most):
        end = min(len(text), at + size)
        if end < len(text):
            cut_at = text.rfind("\n", at + size // 2, end)
            end = cut_at + 1 if cut_at >= 0 else end
        yield at, end
        if end == len(text):
            return
        at, k = max(at + 1, end - overlap), k + 1


def chunks(files: DataFrame, size: int = 700, overlap: int = 80, most: int | None = None) -> DataFrame:
    """(path, index, start, text) of files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, a, t[a:b]) for p, t in zip(pdf["path"], pdf["text"], strict=True) for k, (a, b) in enumerate(chunk_spans(t or "", size, overlap, most))]
            yield pd.DataFrame(rows, columns=["path", "index", "start", "text"])

    return files.select(F.col("path").cast("string").alias("path"), "text").mapInPandas(run, "path string, index bigint, start bigint, text string")


def register_tables(spark) -> None:
    """Table functions for SQL: chunk_text(text) -> (start, chunk), symbols(lang, text) -> (name, kind, line)."""
    rules = {lang: [(kind, re.compile(p)) for kind, p in ps] for lang, ps in _DEFS.items()}

    @F.udtf(returnType="name string, kind string, line int")
    class Symbols:
        def eval(self, lang: str, text: str):
            for n, line in enumerate((text or "").split("\n"), 1):
                for kind, pattern in rules.get(lang, ()):
                    if found := pattern.search(line):
                        yield found[1], kind, n

    @F.udtf(returnType="start bigint, chunk string")
    class ChunkText:
        def eval(self, text: str):
            for a, b in chunk_spans(text or ""):
                yield a, text[a:b]

    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("symbols", Symbols)


def hash_embedding(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(id, idx, val): sparse hash vectors of rows (id, text). Values are sums of signs, so any order of adding gives them."""
    tokens = rows.select("id", F.explode(tokenize(F.col("text"))).alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    return tokens.groupBy("id", hash_index(F.col("t"), dim).alias("idx")).agg(F.sum(hash_sign(F.col("t")) * F.col("n")).alias("val")).filter("val <> 0")


def unit(vectors: DataFrame) -> DataFrame:
    """Sparse vectors scaled to length one."""
    norm = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    return vectors.join(norm, "id").select("id", "idx", (F.col("val") / F.col("norm")).alias("val"))


def mean_vector(vectors: DataFrame, group: str) -> DataFrame:
    """(group, idx, val): mean of the unit vectors of each group; absent coordinates are zero."""
    n = vectors.select(group, "id").distinct().groupBy(group).agg(F.count("*").alias("n"))
    return vectors.groupBy(group, "idx").agg(F.sum("val").alias("s")).join(n, group).select(group, "idx", (F.col("s") / F.col("n")).alias("val"))


def drift(vectors: DataFrame) -> DataFrame:
    """One row: one less the cosine of the mean vectors of both groups (id, idx, val, early)."""
    means = mean_vector(vectors, "early")
    e, late = means.filter("early").select("idx", F.col("val").alias("e")), means.filter("not early").select("idx", F.col("val").alias("l"))
    both = e.join(late, "idx", "full").fillna(0.0)
    return both.agg((1 - F.sum(F.col("e") * F.col("l")) / F.sqrt(F.sum(F.col("e") * F.col("e")) * F.sum(F.col("l") * F.col("l")))).alias("drift"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 8, block: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): each query's k most similar vectors (id, v) by cosine, ties by id.

    Queries are broadcast in blocks of a fixed size; a task keeps k candidates per query, the rest is one window.
    """
    spark, out, last = queries.sparkSession, None, None
    while True:
        part = queries if last is None else queries.filter(F.col("id") > last)
        rows = part.select("id", "v").orderBy("id").limit(block).toPandas()
        if not len(rows):
            break
        last = rows["id"].iloc[-1].item()
        found = _local_topk(spark.sparkContext.broadcast((rows["id"].to_numpy(), np.array(rows["v"].tolist(), float))), vectors, k)
        out = found if out is None else out.unionByName(found)
        if len(rows) < block:
            break
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _local_topk(shared, vectors: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), float)
            if not len(v):
                continue
            s = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
            own = pdf["id"].to_numpy()
            order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
            new = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": own[order].ravel(), "score": np.take_along_axis(s, order, axis=1).ravel()})
            best = pd.concat([best, new]).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield best

    return vectors.select("id", "v").mapInPandas(run, "query_id bigint, id bigint, score double")


def kmeans_step(vectors: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (id, cluster, score) of vectors (id, v) by the most similar of k centroids (cluster, c), and (cluster, c) anew.

    Centroids are k rows and are broadcast.
    """
    norm = lambda v: F.sqrt(dot(v, v))
    cos = dot(F.col("v"), F.col("c")) / (norm(F.col("v")) * norm(F.col("c")))
    scored = vectors.crossJoin(F.broadcast(centroids)).select("id", "v", "cluster", cos.alias("score"))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("cluster")).alias("m"), "cluster")).alias("s")).select("id", F.col("s.cluster").alias("cluster"), F.col("s.score").alias("score"))
    parts = best.join(vectors, "id").select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    fresh = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return best, fresh


def _similarities(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, v, sims): every vector's cosines with the k centroids as (score, -cluster), greatest first. No vector is shuffled."""
    all_of = centroids.agg(F.collect_list(F.struct("cluster", "c")).alias("_cs"))  # one row of k centroids
    norm = lambda v: F.sqrt(dot(v, v))
    cos = lambda x: dot(F.col("v"), x["c"]) / (norm(F.col("v")) * norm(x["c"]))
    sims = F.transform("_cs", lambda x: F.struct(cos(x).alias("score"), (-x["cluster"]).alias("m")))
    return vectors.crossJoin(F.broadcast(all_of)).select("id", "v", F.sort_array(sims, asc=False).alias("sims"))


def kmeans(vectors: DataFrame, seeds: DataFrame, rounds: int = 15) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of vectors (id, v) after ``rounds`` rounds by cosine, and the centroids (cluster, c), from seeds (cluster, c).

    A round reads the vectors once and shuffles sums of components, k times the dimensions a task. A cluster without vectors keeps
    its centroid; ties go to the smaller cluster. Vectors are neither null nor zero.
    """
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(dot(c, c)))
    cents = cut(seeds.select("cluster", unit(F.col("c").cast("array<double>")).alias("c")), "centroids")
    best = None
    for _ in range(rounds):
        best = _similarities(vectors, cents).select("id", "v", (-F.col("sims")[0]["m"]).alias("cluster"))
        sums = best.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        fresh = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_new"))
        cents = cut(cents.join(fresh, "cluster", "left").select("cluster", F.coalesce(unit(F.col("_new")), F.col("c")).alias("c")), "centroids")
    return best.select("id", "cluster"), cents


def soft_confidence(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster, confidence): .55 of the best similarity and .45 of its lead over the next one plus .2, between 0 and 1."""
    best, second = F.col("sims")[0]["score"], F.coalesce(F.get("sims", F.lit(1))["score"], F.lit(0.0))
    score = 0.55 * best + 0.45 * (best - second + 0.2)
    return _similarities(vectors, centroids).select("id", (-F.col("sims")[0]["m"]).alias("cluster"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))


def cohesion(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, size, cohesion): mean cosine of all pairs in each cluster (id, cluster) of vectors (id, v); 0 for one vector.

    From the length of the sum of unit vectors, so every pair counts and none is made: |sum|**2 = n + 2 x the sum over pairs.
    """
    unit_ = F.transform("v", lambda x: x.cast("double") / F.sqrt(dot(F.col("v"), F.col("v"))))
    own = clusters.select("id", "cluster").join(vectors.select("id", unit_.alias("u")), "id")
    sums = own.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    n = F.col("size")
    pairs = F.when(n > 1, (F.col("q") - n) / (n * (n - 1))).otherwise(0.0)
    return own.groupBy("cluster").agg(F.count("*").alias("size")).join(sums, "cluster").select("cluster", "size", pairs.alias("cohesion"))


def duplicate_blobs(files: DataFrame) -> DataFrame:
    """(blob, n, first): contents that several files (path, text) share."""
    return files.groupBy(F.sha2("text", 256).alias("blob")).agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1")


def shared_blobs(files: DataFrame, peers: DataFrame) -> DataFrame:
    """(blob, path, peer): contents of this set that are also in another, a peer's path standing for all with that content."""
    own = files.select(F.sha2("text", 256).alias("blob"), "path")
    return own.join(peers.groupBy(F.sha2("text", 256).alias("blob")).agg(F.min("path").alias("peer")), "blob")


def similar_pairs(files: DataFrame, n: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((a, b, jaccard) between classes, (path, class) membership): files whose n-word shingle sets overlap by ``least``.

    Files with equal sets are one class, named by its least path, so copies make no pairs. Sets that similar share one of
    their (1 - least) * size + 1 rarest shingles: only those are joined, and the pairs found are compared in full.
    """
    split = files.select("path", F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s]+)")).alias("words"))
    hashed = F.array_sort(F.array_distinct(F.transform(shingles(F.col("words"), n), lambda s: F.xxhash64(s))))
    # Written once: the sets are read four times, and filters on them would be pushed into their making.
    sets = cut(split.select("path", hashed.alias("h")).withColumn("key", F.sha2(F.array_join(F.transform("h", lambda x: x.cast("string")), ","), 256)), "shingles").filter(F.size("h") > 0)
    names = sets.groupBy("key").agg(F.min("path").alias("class"))
    members = sets.select("path", "key").join(names, "key").select("path", "class")
    classes = sets.join(names, (sets["key"] == names["key"]) & (sets["path"] == names["class"])).select("class", "h").withColumn("size", F.size("h"))
    # Any order of all shingles will do; with the rarest first, one that many files share meets only where a set holds little else.
    held = classes.select("class", "size", F.explode("h").alias("s"))
    ranked = held.join(held.groupBy("s").agg(F.count("*").alias("df")), "s").withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("df", "s")))
    index = ranked.filter(F.col("k") <= F.floor((1 - least) * F.col("size") + 1e-9) + 1).select("class", "size", "s")
    a, b = index.select("s", F.col("class").alias("a"), F.col("size").alias("na")), index.select("s", F.col("class").alias("b"), F.col("size").alias("nb"))
    near = a.join(b, "s").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct()
    full = near.join(classes.select(F.col("class").alias("a"), F.col("h").alias("ha")), "a").join(classes.select(F.col("class").alias("b"), F.col("h").alias("hb")), "b")
    same = F.size(F.array_intersect("ha", "hb"))
    return full.select("a", "b", (same / (F.size("ha") + F.size("hb") - same)).alias("jaccard")).filter(F.col("jaccard") >= least), members


def term_frequency(rows: DataFrame) -> DataFrame:
    """(term, n, df) of rows (id, text)."""
    per = rows.select("id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def cooccurrence(rows: DataFrame, window: int = 2, min_df: int = 2) -> DataFrame:
    """(term, context, n): how often terms stand within ``window`` places, both in ``min_df`` texts or more.

    Neighbors are made inside each text's token array; nothing is joined by position.
    """
    tokens = rows.select("id", tokenize(F.col("text")).alias("t")).filter(F.size("t") > 1)
    near = F.flatten(F.transform("t", lambda x, i: F.transform(F.filter(F.sequence(-F.lit(window), F.lit(window)), lambda d: (d != 0) & (i + d >= 0) & (i + d < F.size("t"))), lambda d: F.struct(x.alias("term"), F.get("t", i + d).alias("context")))))
    counts = tokens.select(F.explode(near).alias("p")).groupBy("p.term", "p.context").agg(F.count("*").alias("n"))
    common = term_frequency(rows).filter(F.col("df") >= min_df).select("term")
    return counts.join(common, "term").join(common.select(F.col("term").alias("context")), "context").select("term", "context", "n")


def structure_counts(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(win, node, n, delta): occurrences of structure patterns per window, and the change from the window before."""
    counted = files.select("win", F.explode(F.array(*[F.struct(F.lit(k).alias("node"), F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).alias("n")) for k, p in patterns.items()])).alias("s"))
    per = counted.groupBy("win", "s.node").agg(F.sum("s.n").alias("n"))
    return per.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("node").orderBy("win")))


def morpheme_weights(rows: DataFrame, domains: DataFrame, depth: float = 0.15) -> DataFrame:
    """(stem, domain, n, weight) of texts (id, text): how often a stem of an ontology (stem, domain, level) stands there, n * (2 + depth * level)."""
    words = rows.select(F.explode(tokenize(F.col("text"))).alias("w")).groupBy(F.col("w").alias("stem")).agg(F.count("*").alias("n"))
    return words.join(domains, "stem").select("stem", "domain", "n", (F.col("n") * (2 + depth * F.col("level"))).alias("weight"))


def clone_patterns(functions: DataFrame, windows: int = 4) -> DataFrame:
    """(fingerprint, presence, pattern) of rows (win, path, fingerprint): clones of two files or more, and when they live."""
    groups = functions.groupBy("win", "fingerprint").agg(F.countDistinct("path").alias("members")).filter("members >= 2")
    seen = groups.groupBy("fingerprint").agg(F.array_sort(F.collect_list("win")).alias("w"), F.min("members").alias("lo"), F.max("members").alias("hi"))
    n = F.size("w")
    pattern = F.when((n == 1) & (F.element_at("w", -1) == windows - 1), "late").when(n == 1, "short_lived").when((n == windows) & (F.col("lo") == F.col("hi")), "consistent").when(F.col("lo") != F.col("hi"), "divergent").otherwise("stable")
    return seen.select("fingerprint", F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.array_contains("w", i).cast("int")).alias("presence"), pattern.alias("pattern"))
