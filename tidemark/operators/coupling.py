"""Files that change together: pairs, degrees, flow between clades, ownership."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import cut

#: Commits beyond these are counted, not coupled (fixed values); they also bound the pairs a commit can make.
MAX_FILES, MAX_CHURN = 12, 2500


def split_large(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits that couple their files, one row with the number of those that are too large)"""
    large = (F.col("n_files") > MAX_FILES) | (F.col("churn") > MAX_CHURN)
    return commits.filter(~large), commits.agg(F.count_if(large).alias("filtered_large_commits"))


#: Items of one key that meet in one array on either side.
BLOCK = 64


def pairs_within(items: DataFrame, key: str, item: str) -> DataFrame:
    """(key, a, b) of all distinct items of one key, a < b.

    A key's items are dealt into blocks of about ``BLOCK``, and each pair of blocks becomes one small array whose pairs
    are made in place. So no array grows with a hot key, and no task holds all of its items.
    """
    own = items.select(F.col(key).alias("_key"), F.col(item).alias("_item")).filter("_key is not null and _item is not null").distinct()
    sizes = own.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK).alias("_n")).withColumnRenamed("_key", "_k")
    dealt = own.join(sizes, own["_key"] == sizes["_k"]).withColumn("_own", F.pmod(F.xxhash64("_item"), F.col("_n")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    met = dealt.groupBy("_key", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi")).agg(F.array_sort(F.collect_list(F.struct("_item", "_own"))).alias("_all"))
    # Items of one block meet in its own array, those of two blocks in theirs.
    later = F.transform("_all", lambda x, i: F.transform(F.filter(F.slice("_all", i + 2, F.size("_all")), lambda y: (F.col("_lo") == F.col("_hi")) | (x["_own"] != y["_own"])), lambda y: F.struct(x["_item"].alias("a"), y["_item"].alias("b"))))
    return met.filter(F.size("_all") > 1).select(F.col("_key").alias(key), F.explode(F.flatten(later)).alias("p")).select(key, "p.a", "p.b")


#: Items of a key that make pairs in one row, and pairs that a task holds at once.
RUN, HELD = 1024, 1 << 21
#: Pairs that a round makes for each item of a key, and rounds at most: what bounds the disk that pairs take.
ROUND, ROUNDS = 8, 32


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, item) in order of items -> (key, at, item): the item's number in its partition, and the item where it comes first."""
    part, n, last = TaskContext.get().partitionId() << 32, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        items = batch.column("item")
        codes = items.dictionary_encode().indices.to_numpy()
        first = np.concatenate([[last is None or items[0] != last], codes[1:] != codes[:-1]])
        at = n + np.cumsum(first)
        n, last = int(at[-1]), items[-1]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(part + at), pc.if_else(pa.array(first), items, pa.nulls(len(first), items.type))], names=["key", "at", "item"])


def numbered(items: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """((key, id), (id, item)) of all items of keys, nulls left out: equal items have one whole number, from 0."""
    own = items.select(F.col(key).alias("key"), F.col(item).alias("item")).filter("key IS NOT NULL AND item IS NOT NULL")
    kinds = dict(own.dtypes)
    placed = cut(own.repartition(F.col("item")).sortWithinPartitions("item").mapInArrow(_placed, f"key {kinds['key']}, at bigint, item {kinds['item']}"), "numbered")
    part = F.shiftrightunsigned("at", 32)
    sizes = sorted(placed.filter("item IS NOT NULL").groupBy(part.alias("p")).count().collect())  # one for each partition
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    offsets = items.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, before, strict=False)], "p bigint, before bigint")
    numbers = placed.join(F.broadcast(offsets), part == F.col("p")).withColumn("id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 32) - 1))).cast("int"))
    return numbers.select("key", "id"), numbers.filter("item IS NOT NULL").select("id", "item")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) in order -> rows (own, others) whose ids make pairs: those of ``own`` among themselves, or each of them with each of ``others``."""
    lists = lambda ids, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    no_others = lambda n: pa.nulls(n, pa.list_(pa.int32()))
    row = lambda own, others: pa.RecordBatch.from_arrays([own, others], names=["own", "others"])

    def large(ids):
        # The ids of a large key are cut into runs; each run meets itself and all later ones.
        runs = [ids[i : i + RUN] for i in range(0, len(ids), RUN)]
        for i, x in enumerate(runs):
            yield row(lists(x, np.array([0, len(x)])), no_others(1))
            for y in runs[i + 1 :]:
                yield row(lists(x, np.array([0, len(x)])), lists(y, np.array([0, len(y)])))

    def sets(rows: pa.RecordBatch):
        keys, ids = rows.column("key").dictionary_encode().indices.to_numpy(), rows.column("id").to_numpy()
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        kept = np.flatnonzero(new | np.concatenate([[True], ids[1:] != ids[:-1]]))
        ids, ends = ids[kept], np.append(np.flatnonzero(new[kept]), len(kept))
        n = np.diff(ends)
        small = (n > 1) & (n <= RUN)
        yield row(lists(ids[np.repeat(small, n)], np.concatenate([[0], np.cumsum(n[small])])), no_others(int(small.sum())))
        for k in np.flatnonzero(n > RUN):
            yield from large(ids[ends[k] : ends[k + 1]])

    held: list[pa.RecordBatch] = []  # rows of a key that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        if held and held[-1].column("key")[-1] != keys[0]:
            yield from sets(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        at = keys.index(keys[-1]).as_py()  # rows are in order, so the last key's are at the end
        if at:
            done = batch.slice(0, at)
            yield from sets(pa.Table.from_batches([*held, done]).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(at))
    if held:
        yield from sets(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _met(batch: pa.RecordBatch, rounds: int, turn: int, both: bool) -> Iterator[np.ndarray]:
    """Pairs of a batch of sets as a << 32 | b, of those a whose turn it is; ``both`` ways or a < b."""
    own, others = batch.column("own"), batch.column("others")
    n, m = (np.asarray(x.value_lengths().fill_null(0)) for x in (own, others))
    flat, at = own.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]])
    flat2, at2 = others.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(m)[:-1]])

    def packed(a, b):
        for x, y in ((a, b), (b, a)) if both else ((a, b),):
            mine = slice(None) if rounds == 1 else x % rounds == turn
            yield x[mine] << 32 | y[mine]

    for size in np.unique(n[m == 0]):
        of = np.flatnonzero((m == 0) & (n == size))
        i, j = np.triu_indices(size, 1)
        step = max(1, HELD // max(1, len(i)))
        for k in range(0, len(of), step):
            ids = flat[at[of[k : k + step], None] + np.arange(size)]
            yield from packed(ids[:, i].ravel(), ids[:, j].ravel())
    for k in np.flatnonzero(m):
        x, y = flat[at[k] : at[k] + n[k]], flat2[at2[k] : at2[k] + m[k]]
        yield from packed(np.repeat(x, len(y)), np.tile(y, len(x)))


def _by_first(rounds: int, turn: int, both: bool):
    """Sets -> rows (a, bs): what each id meets."""

    def rows(pairs: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(pairs))
        a = every >> 32
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(a)]]).astype(np.int32)), pa.array((every & 0xFFFFFFFF).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(a[starts].astype(np.int32)), lists], names=["a", "bs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for pairs in _met(batch, rounds, turn, both):
                held.append(pairs)
                n += len(pairs)
                if n > HELD:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


def _counted(least: int, degrees: bool):
    """Rows (a, bs) in order of a -> (a, b, n) of the pairs that come ``least`` times, or (a, n) with the number of different b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, summed = [], 0, None

        def settle(last: int | None) -> Iterator[pa.RecordBatch]:
            """Sums what is held; the pairs of ``last`` go on."""
            nonlocal keys, n, summed
            every = np.sort(np.concatenate(keys))
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
            every, count = every[starts], np.diff(np.append(starts, len(every)))
            if summed is not None and len(summed[0]):
                every, count = np.concatenate([summed[0], every]), np.concatenate([summed[1], count])
                order = np.argsort(every, kind="stable")
                every, count = every[order], count[order]
                starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                every, count = every[starts], np.add.reduceat(count, starts)
            done = len(every) if last is None else int(np.searchsorted(every, last << 32))
            keys, n, summed = [], 0, (every[done:], count[done:])
            a, b, count = every[:done] >> 32, every[:done] & 0xFFFFFFFF, count[:done]
            if degrees:
                own, of = np.unique(a, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(of.astype(np.int64))], names=["a", "n"])
            else:
                kept = count >= least
                yield pa.RecordBatch.from_arrays([pa.array(a[kept].astype(np.int32)), pa.array(b[kept].astype(np.int32)), pa.array(count[kept])], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, a = batch.column("bs"), batch.column("a").to_numpy().astype(np.int64)
            b = lists.flatten().to_numpy().astype(np.int64)
            keys.append(np.repeat(a, np.asarray(lists.value_lengths())) << 32 | b)
            n += len(b)
            if n > HELD + (0 if summed is None else len(summed[0])):
                yield from settle(int(a[-1]))
        if keys or summed is not None:
            keys.append(np.empty(0, np.int64))
            yield from settle(None)

    return run


def _paired(items: DataFrame, key: str, item: str, least: int, degrees: bool) -> tuple[DataFrame, DataFrame]:
    own, names = numbered(items, key, item)
    dealt = own.repartition(F.col("key")).sortWithinPartitions("key", "id")
    sets = cut(dealt.mapInArrow(_sets, "own array<int>, others array<int>"), "sets")
    n, m = F.size("own").cast("bigint"), F.size("others").cast("bigint")
    made, held = sets.agg(F.sum(F.when(F.col("others").isNull(), n * (n - 1) / 2).otherwise(n * m)), F.sum(F.when(F.col("others").isNull(), n))).first()
    rounds = max(1, min(ROUNDS, int(-(-(made or 0) * (1 + degrees) // (ROUND * (held or 1))))))
    schema, out = "a int, n bigint" if degrees else "a int, b int, n bigint", None
    for turn in range(rounds):
        met = sets.mapInArrow(_by_first(rounds, turn, degrees), "a int, bs array<int>").repartition(F.col("a")).sortWithinPartitions("a")
        found = cut(met.mapInArrow(_counted(least, degrees), schema), "counts")
        out = found if out is None else out.unionByName(found)
    return out, names


def pair_counts(items: DataFrame, key: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, n): how many keys hold both items, a < b, where ``least`` do.

    Items are numbered, so that a pair takes a few bytes. A key's ids are made into pairs in tasks of bounded size, go to the task of
    their first item and are summed there; in as many rounds as keep what a round sends small beside the items, each written before the next begins.
    """
    counts, names = _paired(items, key, item, least, False)
    first, second = (names.select(F.col("id").alias(c), F.col("item").alias(f"{c}_")) for c in "ab")
    return counts.join(first, "a").drop("a").join(second, "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), "n")


def partner_counts(items: DataFrame, key: str, item: str) -> DataFrame:
    """(item, n): with how many different others an item is held by some key; items without any have no row."""
    counts, names = _paired(items, key, item, 1, True)
    return counts.join(names, counts["a"] == names["id"]).select(F.col("item").alias(item), "n")


def cochange_edges(files: DataFrame, commits: DataFrame, min_weight: int = 2) -> DataFrame:
    """(a, b, weight): in how many commits both files change."""
    small, _ = split_large(commits)
    kept = files.select("sha", "path").join(small.select("sha"), "sha", "left_semi")
    return pair_counts(cut(kept, "small-commits"), "sha", "path", min_weight).withColumnRenamed("n", "weight")


def ticket_edges(files: DataFrame, tickets: DataFrame, min_weight: int = 1) -> DataFrame:
    """(a, b, weight): files linked by tickets (sha, ticket)."""
    per = files.select("sha", "path").join(tickets.select("sha", "ticket").distinct(), "sha").select("ticket", "path")
    return pair_counts(cut(per, "ticket-files"), "ticket", "path", min_weight).withColumnRenamed("n", "weight")


def sum_of_coupling(edges: DataFrame) -> DataFrame:
    """(path, coupling): the weights of a file's edges on either side."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("path"), "weight")
    return ends.groupBy("path").agg(F.sum("weight").alias("coupling"))


def blast_radius(files: DataFrame) -> DataFrame:
    """(path, degree, score): how many other files change with it, over forty and at most one."""
    return partner_counts(files, "sha", "path").withColumnRenamed("n", "degree").withColumn("score", F.least(F.lit(1.0), F.col("degree") / 40))


def coupled_neighbors(edges: DataFrame, edit: DataFrame, k: int | None = None) -> DataFrame:
    """(neighbor, weight): what hangs together with an edit set (path), by the strongest edge; the set itself is left out."""
    reach = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    near = reach.join(edit.select(F.col("path").alias("a")), "a").join(edit.select(F.col("path").alias("b")), "b", "left_anti")
    out = near.groupBy(F.col("b").alias("neighbor")).agg(F.max("weight").alias("weight"))
    return out.orderBy(F.desc("weight"), "neighbor").limit(k) if k else out


def gene_flow(files: DataFrame) -> DataFrame:
    """(a, b, weight, kind): pairs of clades that commits touch together; five or more are a bridge."""
    pairs = pairs_within(files, "sha", "clade")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).withColumn("kind", F.when(F.col("weight") >= 5, "merge_bridge").otherwise("cochange"))


def transfer_suspects(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits over two clades or more, eight files or more, and more than 400 lines."""
    spread = files.groupBy("sha").agg(F.countDistinct("clade").alias("n_clades"))
    return commits.join(spread, "sha").filter((F.col("n_clades") >= 2) & (F.col("n_files") >= 8) & (F.col("churn") > 400)).select("sha", "n_clades", "n_files", "churn")


def offboarding(files: DataFrame, commits: DataFrame, remove: tuple[int, ...] = (1, 2, 3), hot: int = 15) -> DataFrame:
    """(removed, drop, uncovered): the share of touches of the hottest files lost with the busiest authors, files left with none."""
    touched = files.select("sha", "path").join(commits.select("sha", "author"), "sha").groupBy("path", "author").agg(F.count("*").alias("t"))
    top = touched.groupBy("path").agg(F.sum("t").alias("all")).orderBy(F.desc("all"), "path").limit(hot)
    busiest = commits.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(max(remove))
    ranks = busiest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "author"))).select("author", "rank")  # max(remove) rows
    held = touched.join(F.broadcast(top), "path").join(F.broadcast(ranks), "author", "left").select("path", "t", F.coalesce("rank", F.lit(1 << 30)).alias("rank"))
    steps = held.withColumn("removed", F.explode(F.array(*map(F.lit, remove))))
    per = steps.groupBy("removed", "path").agg(F.sum("t").alias("all"), F.sum(F.when(F.col("rank") > F.col("removed"), F.col("t")).otherwise(0)).alias("left"))
    return per.groupBy("removed").agg((1 - F.sum("left") / F.sum("all")).alias("drop"), F.count_if(F.col("left") == 0).alias("uncovered"))


def single_owner_hot(files: DataFrame, commits: DataFrame, hot: int = 10) -> DataFrame:
    """Files of the hottest ten that one author alone touches."""
    owners = files.select("sha", "path").join(commits.select("sha", "author"), "sha").groupBy("path").agg(F.count("*").alias("touches"), F.countDistinct("author").alias("owners"))
    return owners.orderBy(F.desc("touches"), "path").limit(hot).filter("owners = 1").select("path", "touches")


def cognitive_load(files: DataFrame, commits: DataFrame, utility) -> DataFrame:
    """One row: clades per commit, entropy of clade touches, single-owner share of well-connected files, utility share, index."""
    from tidemark.operators.metrics import entropy

    per = files.groupBy("sha").agg(F.countDistinct("clade").alias("k")).agg(F.avg(F.col("k") - 1).alias("switches"))
    attention = entropy(files.groupBy("clade").agg(F.count("*").alias("n")), "n", "attention")
    owners = files.select("sha", "path").join(commits.select("sha", "author"), "sha").groupBy("path").agg(F.countDistinct("author").alias("owners"))
    lone = blast_radius(files).filter("degree >= 3").join(owners, "path").agg(F.coalesce(F.avg((F.col("owners") == 1).cast("int")), F.lit(0.0)).alias("lone"))
    share = files.agg(F.avg(utility.cast("int")).alias("utility"))
    one = per.crossJoin(attention).crossJoin(lone).crossJoin(share)
    index = 0.3 * F.least(F.lit(1.0), F.col("switches") / 3) + 0.25 * F.least(F.lit(1.0), F.col("attention") / 5) + 0.25 * F.col("lone") + 0.2 * F.col("utility")
    return one.withColumn("load_index", index)
