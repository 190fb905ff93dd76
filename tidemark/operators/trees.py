"""Rooted trees and forests of any depth as rows (id, parent): places, visible ancestors, parsimony.

Nothing here walks a tree level by level. Places come from an Euler tour whose list is ranked by pointer jumping;
parsimony goes along heavy paths, of which at most log2(nodes) lie between a node and its root, so the rounds grow with the
logarithm of the size for chains and bushes alike. A path is folded as a sorted stream, cut into blocks: a block's rule
from what enters it to what leaves it is put together first, so long paths are dealt over many tasks.
Nodes on a cycle, or that lead into one, have no root and are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import with_seq
from tidemark.operators.graph import cut, generations

#: Nodes of a path that are folded in one stretch.
BLOCK = 4096


def tour(tree: DataFrame, order: str | None = None, mark: str | None = None) -> DataFrame:
    """(id, parent, root, depth, place, size, marked) of each node of a forest (id, parent).

    ``place`` counts the nodes of its tree before it in depth-first order, ``size`` those below and including it,
    ``marked`` those before it for which the boolean column ``mark`` holds (all, if none is given). Children go by ``order``, then id.
    """
    rows = tree.select("id", "parent", (F.col(order) if order else F.lit(0)).alias("o"), (F.col(mark) if mark else F.lit(True)).cast("bigint").alias("m"))
    rows = cut(with_seq(rows, "parent", "o", "id"), "siblings")
    after = rows.select((F.col("seq") - 1).alias("seq"), F.col("parent").alias("p2"), F.col("id").alias("sibling"))
    first = rows.filter("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct("seq", "id")).getField("id").alias("child")).withColumnRenamed("parent", "id")
    linked = rows.join(after, "seq", "left").join(first, "id", "left")
    sibling = F.when(F.col("p2") == F.col("parent"), F.col("sibling"))
    # Each node is entered and left; an element of the tour is (id, left?) and points at the next one.
    into = F.struct(F.lit(False).alias("up"), F.coalesce("child", "id").alias("next"), F.col("child").isNull().alias("next_up"), F.lit(1).alias("downs"), F.lit(0).alias("ups"), F.col("m").alias("marks"))
    out = F.struct(F.lit(True).alias("up"), F.coalesce(sibling, "parent").alias("next"), sibling.isNull().alias("next_up"), F.lit(0).alias("downs"), F.lit(1).alias("ups"), F.lit(0).cast("bigint").alias("marks"))
    at = linked.select("id", "parent", F.explode(F.array(into, out)).alias("e")).select("id", "parent", "e.up", "e.next", "e.next_up", *[F.col(f"e.{c}").cast("bigint").alias(c) for c in ("downs", "ups", "marks")], F.col("id").alias("last"))
    at = cut(at, "tour")
    for _ in range((2 * max(1, at.count())).bit_length()):
        ahead = at.select(F.col("id").alias("next"), F.col("up").alias("next_up"), F.col("next").alias("n2"), F.col("next_up").alias("u2"), *[F.col(c).alias(f"{c}2") for c in ("downs", "ups", "marks")], F.col("last").alias("last2"))
        going = at.filter("next IS NOT NULL").join(ahead, ["next", "next_up"])
        going = going.select("id", "parent", "up", F.col("n2").alias("next"), F.col("u2").alias("next_up"), *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in ("downs", "ups", "marks")], F.col("last2").alias("last"))
        at = cut(at.filter("next IS NULL").unionByName(going), "tour")
        if at.filter("next IS NOT NULL").isEmpty():
            break
    ended = at.filter("next IS NULL")
    enter, leave = ended.filter("NOT up"), ended.filter("up").select("id", F.col("downs").alias("after"))
    whole = enter.filter("parent IS NULL").select(F.col("id").alias("last"), F.col("downs").alias("all"), F.col("marks").alias("all_marks"))
    found = enter.join(leave, "id").join(whole, "last")
    return found.select("id", "parent", F.col("last").alias("root"), (F.col("ups") - F.col("downs")).alias("depth"), (F.col("all") - F.col("downs")).alias("place"),
                        (F.col("downs") - F.col("after")).alias("size"), (F.col("all_marks") - F.col("marks")).alias("marked"))


def unary_hidden(tree: DataFrame, extra: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """The tree with a flag ``hidden``: nodes of one parent and one child, of the same ``group`` as both if one is given.

    ``extra`` (id, parent) are further parents, which a hidden node has not.
    """
    kids = tree.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("_kids"), F.first("id").alias("_kid")).withColumnRenamed("parent", "id")
    rows = tree.join(kids, "id", "left")
    if extra is not None:
        rows = rows.join(extra.filter("parent IS NOT NULL").groupBy("id").agg(F.count("*").alias("_more")), "id", "left")
    hidden = F.col("parent").isNotNull() & (F.coalesce("_kids", F.lit(0)) == 1) & (F.coalesce("_more", F.lit(0)) == 0 if extra is not None else F.lit(True))
    if group:
        own = tree.select("id", F.col(group).alias("_g"))
        rows = rows.join(own.withColumnsRenamed({"id": "parent", "_g": "_up"}), "parent", "left").join(own.withColumnsRenamed({"id": "_kid", "_g": "_down"}), "_kid", "left")
        hidden = hidden & (F.coalesce(F.col(group), F.lit("")).eqNullSafe("") | (F.col(group).eqNullSafe(F.col("_up")) & F.col(group).eqNullSafe(F.col("_down"))))
    return rows.withColumn("hidden", hidden).select(*tree.columns, "hidden")


def tree_ranks(tree: DataFrame, order: str | None = None) -> DataFrame:
    """(id, root, generation, rank, size) of a forest (id, parent, hidden): a grid of generation and depth-first order.

    ``rank`` numbers the visible nodes of each tree; hidden nodes have none.
    """
    flags = tree.select("id", "hidden")
    placed = tour(tree.withColumn("_shown", ~F.col("hidden")), order, "_shown").join(flags, "id")
    return placed.select("id", "root", F.col("depth").alias("generation"), F.when(~F.col("hidden"), F.col("marked")).alias("rank"), "size")


def visible_ancestors(tree: DataFrame) -> DataFrame:
    """(id, ancestor): each node's nearest ancestor that isn't hidden, of a forest (id, parent, hidden); null if there is none.

    Only chains of hidden nodes are jumped over, so the rounds grow with the log of the longest of those.
    """
    up = generations(tree.filter("hidden AND parent IS NOT NULL").select("id", "parent"), tree.select("id")).select(F.col("id").alias("parent"), F.col("root").alias("_top"))
    shown = tree.filter("NOT hidden").select(F.col("id").alias("_top"), F.col("id").alias("ancestor"))
    return tree.select("id", "parent").join(up, "parent", "left").join(shown, "_top", "left").select("id", "ancestor")


def heavy_paths(tree: DataFrame) -> DataFrame:
    """(id, parent, head, pos, level): each node's path to the largest subtree, its place on it, and how many paths lie above."""
    placed = cut(tour(tree).select("id", "parent", "size"), "sizes")
    heavy = placed.filter("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("m"), "id")).getField("id").alias("id"))
    on = cut(generations(heavy.select("id", "parent"), placed.select("id")).select("id", F.col("root").alias("head"), F.col("generation").alias("pos")), "paths")
    heads = on.filter("pos = 0").select("id").join(placed.select("id", "parent"), "id")
    above = heads.join(on.select(F.col("id").alias("parent"), F.col("head").alias("up")), "parent").select("id", F.col("up").alias("parent"))
    levels = generations(above, heads.select("id")).select(F.col("id").alias("head"), F.col("generation").alias("level"))
    return cut(placed.select("id", "parent").join(on, "id").join(levels, "head"), "levels")


def _streamed(rows: DataFrame, keys: list[str], order: str, run: Callable[[tuple, Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """``run(key, rows of the key in order)`` over groups that may be of any length: sorted rows are streamed, none are gathered."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        stream = (r for pdf in frames for r in pdf.itertuples(index=False))
        for key, group in groupby(stream, key=lambda r: tuple(getattr(r, k) for k in keys)):
            for row in run(key, group):
                out.append(row)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(each, schema)


# Upwards: what enters a node from the heavy child is a set of states; ``all`` are the states of every other coded child, ``any`` those of one of them at least.


def _agree(entering: frozenset, row) -> tuple[frozenset, int]:
    """(states, steps) of a node: what all coded children share, or all they have at the cost of a step; its own state, if none is coded."""
    if not row.coded:
        return entering or (frozenset([row.state]) if row.state else frozenset()), 0
    every, some = frozenset(row.all), frozenset(row.any)
    common = entering & every if entering else every
    return (common, 0) if common else (entering | some, 1)


def _rule_up(rows: Iterator) -> str:
    """A block's rule, as cases of what enters it: states it must miss, sets it must meet; then (enters & mask) | more leaves it.

    A case splits only on states that it doesn't know about yet, so there are few where there are few states.
    """
    empty: frozenset = frozenset()
    cases = [(frozenset(), (), None, frozenset())]
    for row in rows:
        empty = _agree(empty, row)[0]
        if not row.coded:
            continue
        every, some, split = frozenset(row.all), frozenset(row.any), []
        for miss, meet, mask, more in cases:
            shared = every if mask is None else mask & every
            if more & every:
                split.append((miss, meet, shared, more & every))
                continue
            test = shared - miss
            sure = any(m <= test for m in meet) or (not more and mask is not None and mask - miss <= test)
            if test:
                split.append((miss, meet if sure else (*meet, test), shared, frozenset()))
            if not sure:
                split.append((miss | test, meet, mask, more | some))
        cases = [c for c in split if not any(m <= c[0] for m in c[1])]
    plain = lambda s: sorted(s) if s is not None else None
    return json.dumps([sorted(empty), [[plain(a), [plain(m) for m in b], plain(c), plain(d)] for a, b, c, d in cases]])


def _follow_up(rule: str, entering: frozenset) -> frozenset:
    empty, cases = json.loads(rule)
    if not entering:
        return frozenset(empty)
    for miss, meet, mask, more in cases:
        if not entering & set(miss) and all(entering & set(m) for m in meet):
            return frozenset((entering if mask is None else entering & set(mask)) | set(more))
    raise AssertionError("the cases cover every set")


# Downwards: what enters a node is its parent's state.


def _settle(entering: str | None, row) -> str:
    if not len(row.set):
        return row.state or "?"
    if entering in row.set:
        return entering
    return row.state if row.state in row.set else min(row.set)


def _rule_down(rows: Iterator) -> str:
    """A block's rule: states that pass through, states that leave as another, and what leaves for all others (and none)."""
    through, turned, rest = None, {}, None
    for row in rows:
        held, other = set(row.set), _settle(None, row)
        if not held:
            through, turned, rest = set(), {}, other
            continue
        turned = {a: b if b in held else other for a, b in turned.items()}
        if through is None:
            through, rest = held, other
        else:
            turned |= dict.fromkeys(through - held, other)
            through, rest = through & held, rest if rest in held else other
    return json.dumps([sorted(through or []), turned, rest])


def _follow_down(rule: str, entering: str | None) -> str:
    through, turned, rest = json.loads(rule)
    return entering if entering in through else turned.get(entering, rest)


def _along(rows: DataFrame, order: str, begin: str, rule: Callable, follow: Callable, start: Callable, value: Callable, step: Callable, schema: str) -> DataFrame:
    """Folds paths (head, ``order``): each stretch of BLOCK rows by itself, once what enters it follows from the rules of those before.

    ``begin`` is the column of what enters a path, ``start`` reads it, ``value`` writes what enters a block, ``step`` gives a row's result and what leaves it.
    """
    rows = rows.withColumn("block", F.floor(F.col(order) / BLOCK))
    enters = dict(rows.dtypes)[begin]
    long = rows.filter("block > 0").select("head").distinct()
    rules = _streamed(rows.join(long, "head", "left_semi"), ["head", "block"], order, lambda key, own: iter([(*key, rule(own))]), f"head {dict(rows.dtypes)['head']}, block bigint, rule string")
    firsts = rows.filter(F.col(order) == 0).select("head", begin)

    def scan(key: tuple, own: Iterator) -> Iterator[tuple]:
        now = None
        for r in own:
            now = start(getattr(r, begin)) if now is None else now
            yield key[0], r.block, value(now)
            now = follow(r.rule, now)

    starts = _streamed(rules.join(firsts, "head"), ["head"], "block", scan, f"head {dict(rows.dtypes)['head']}, block bigint, enters {enters}")
    ready = rows.join(starts, ["head", "block"], "left").withColumn("enters", F.coalesce("enters", F.col(begin)))

    def fold(key: tuple, own: Iterator) -> Iterator[tuple]:
        now, first = None, True
        for r in own:
            now, first = (start(r.enters) if first else now), False
            now, out = step(now, r)
            yield out

    return _streamed(ready, ["head", "block"], order, fold, schema)


def fitch(tree: DataFrame, states: DataFrame, along: DataFrame | None = None) -> DataFrame:
    """(id, parent, set, steps, state) of every node of a forest (id, parent) with states (id, state) of some nodes, unordered parsimony.

    Upwards a node takes the states that all its coded children share, or all of theirs at the cost of one step; a
    node without coded children takes its own. Downwards it keeps its parent's state if it can, else its own, else the least; ``?`` where nothing is known. ``along`` are the tree's heavy paths, where they are at hand.
    """
    paths = (heavy_paths(tree) if along is None else along).join(states.filter("state <> ''").groupBy("id").agg(F.min(F.col("state").cast("string")).alias("state")), "id", "left")
    lengths = paths.groupBy("head").agg(F.max("pos").alias("last"))
    paths = cut(paths.join(lengths, "head").withColumn("height", F.col("last") - F.col("pos")), "coded")
    top = paths.agg(F.max("level")).first()[0]
    if top is None:
        return tree.select("id", "parent").limit(0).select("id", "parent", F.array(F.lit("")).alias("set"), F.lit(0).cast("bigint").alias("steps"), F.lit("").alias("state"))
    kind = dict(paths.dtypes)["id"]
    nothing = F.array().cast("array<string>")
    sets, below = [], None
    for level in range(top, -1, -1):
        rows = paths.filter(F.col("level") == level)
        if below is None:
            rows = rows.withColumns({"all": nothing, "any": nothing, "coded": F.lit(0).cast("bigint")})
        else:
            # Per parent only counts of states meet, however many children it has.
            one = below.filter(F.size("set") > 0).select("parent", "set")
            coded = one.groupBy("parent").agg(F.count("*").alias("coded"))
            held = one.select("parent", F.explode("set").alias("s")).groupBy("parent", "s").agg(F.count("*").alias("n"))
            both = held.join(coded, "parent").groupBy("parent", "coded").agg(F.collect_list(F.when(F.col("n") == F.col("coded"), F.col("s"))).alias("all"), F.collect_list("s").alias("any"))
            rows = rows.join(both.withColumnRenamed("parent", "id"), "id", "left").withColumns({"all": F.coalesce("all", nothing), "any": F.coalesce("any", nothing), "coded": F.coalesce("coded", F.lit(0))})
        rows = rows.withColumn("nothing", nothing)

        def up(now: frozenset, r) -> tuple[frozenset, tuple]:
            now, steps = _agree(now, r)
            return now, (r.id, sorted(now), steps)

        done = _along(rows, "height", "nothing", _rule_up, _follow_up, frozenset, sorted, up, f"id {kind}, set array<string>, steps bigint")
        done = cut(done, "sets")
        sets.append(done)
        below = done.join(rows.filter("pos = 0 AND parent IS NOT NULL").select("id", "parent"), "id")
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    known = cut(paths.select("id", "parent", "head", "pos", "level", "state").join(every, "id"), "known")
    settled, above = [], None
    for level in range(top + 1):
        rows = known.filter(F.col("level") == level)
        if above is None:
            rows = rows.withColumn("begin", F.lit(None).cast("string"))
        else:
            rows = rows.join(above.select(F.col("id").alias("parent"), F.col("got").alias("begin")), "parent", "left")

        def down(now: str | None, r) -> tuple[str, tuple]:
            now = _settle(now, r)
            return now, (r.id, now)

        done = _along(rows, "pos", "begin", _rule_down, _follow_down, lambda x: x, lambda x: x, down, f"id {kind}, got string")
        done = cut(done, "settled")
        settled.append(done)
        above = done if above is None else above.unionByName(done)
    return known.select("id", "parent", "set", "steps").join(above.withColumnRenamed("got", "state"), "id")


def change_edges(tree: DataFrame) -> DataFrame:
    """(parent, id): edges of a tree (id, parent, state) whose ends have different known states."""
    up = tree.select(F.col("id").alias("parent"), F.col("state").alias("_above"))
    known = (F.col("state") != "?") & (F.col("_above") != "?") & (F.col("state") != "") & (F.col("_above") != "")
    return tree.join(up, "parent").filter(known & (F.col("state") != F.col("_above"))).select("parent", "id")


def fitch_by_depth(tree: DataFrame, types: DataFrame, depths: int = 4) -> DataFrame:
    """Parsimony of every rank of a type path (id, type): the tree's rows of each depth, with states cut to that many parts.

    A type of fewer parts than the depth has no state there. Depths beyond the longest type are left out.
    """
    parts = types.withColumn("_p", F.split("type", "/"))
    deepest = parts.agg(F.max(F.size("_p"))).first()[0] or 0
    out, along = None, heavy_paths(tree)
    for depth in range(1, min(depths, deepest) + 1):
        states = parts.filter(F.size("_p") >= depth).select("id", F.array_join(F.slice("_p", 1, depth), "/").alias("state"))
        own = fitch(tree, states, along).withColumn("depth", F.lit(depth))
        out = own if out is None else out.unionByName(own)
    return out


def parsimony_flags(tree: DataFrame, states: DataFrame) -> DataFrame:
    """(id, reconstructed, change) of every node: its state by parsimony, and whether its edge is a change.

    Changes are edges between coded nodes of different states (id, state); where there is none, those between reconstructed states.
    """
    coded = states.filter("state <> ''").groupBy("id").agg(F.min(F.col("state").cast("string")).alias("state"))
    settled = cut(fitch(tree, states).select("id", "parent", F.col("state").alias("reconstructed")), "reconstructed")
    own = settled.select("id", "parent").join(coded, "id", "left")
    observed = cut(change_edges(own.select("id", "parent", F.coalesce("state", F.lit("")).alias("state"))).select("id"), "observed")
    edges = observed if not observed.isEmpty() else change_edges(settled.withColumnRenamed("reconstructed", "state")).select("id")
    return settled.join(edges.distinct().withColumn("_c", F.lit(True)), "id", "left").select("id", "reconstructed", F.coalesce("_c", F.lit(False)).alias("change"))
