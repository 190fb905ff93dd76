"""The ledger of all kinds of records, claim frames over it with their evidence, and what it holds on each path.

Every kind is one projection of a table of results to the common form; which columns make its id, place and links is stated in ``KINDS``.
Ids are ``prefix:part:part``, cut to 160 letters; ``column@day`` is a date and ``column@10`` the first letters of a column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import cut

_LINKS = "array<struct<record_id:string,kind:string,role:string>>"
#: Letters of an id, evidence of a frame, frames in all, of branches and of responses (fixed values).
ID, EVIDENCE, STAGE_EVIDENCE, FRAMES, BRANCHES, RESPONSES = 160, 10, 12, 50, 8, 6


@dataclass(frozen=True)
class Kind:
    """How a table's rows become records: id parts, columns, tags and links as (prefix, parts, kind, role)."""

    kind: str
    id: tuple[str, ...]
    label: str
    at: str | None = None
    path: str | None = None
    clade: str | None = None
    sha: str | None = None
    confidence: str | None = None
    tags: tuple[str, ...] = ()
    links: tuple[tuple[str, tuple[str, ...], str, str], ...] = ()


_CLADE, _LINEAGE = ("clade", ("clade",), "clade", "context"), ("lineage", ("path",), "lineage", "context")
_BLAST = ("blast", ("path",), "blast_radius", "measures")
#: Record kinds by table (fixed values: prefixes, parts, tags and links).
KINDS: dict[str, Kind] = {
    "clades": Kind("clade", ("clade", "clade"), "label", clade="clade", tags=("clade",)),
    "path_types": Kind("code_type", ("code_type", "path"), "code_type", path="path", clade="clade", tags=("path", "type"), links=(_CLADE,)),
    "allocations": Kind("commit_delta", ("delta", "sha@10", "path"), "path", at="at", path="path", clade="clade", sha="sha", tags=("delta", "allocation"), links=(_CLADE,)),
    "lineages": Kind("lineage", ("lineage", "path"), "path", path="path", clade="clade", sha="last_sha", confidence="fitness", tags=("lineage",)),
    "events": Kind("lifecycle_event", ("event", "kind", "label", "at@day"), "label", at="at", confidence="confidence", tags=("event",)),
    "anchors": Kind("lifecycle_event", ("anchor", "label", "stage"), "label", at="at", confidence="confidence", tags=("anchor",), links=(("event", ("kind", "label", "at@day"), "lifecycle_event", "supports"), ("cp", ("series", "cp_at@day", "direction"), "changepoint", "supports"))),
    "changepoints": Kind("changepoint", ("cp", "series", "at@day", "direction"), "series", at="at", tags=("changepoint",)),
    "segments": Kind("stage_segment", ("seg", "stage", "at@day"), "stage", at="at", confidence="confidence", tags=("segment",)),
    "hypotheses": Kind("hypothesis", ("hyp", "id"), "claim", confidence="confidence", tags=("hypothesis",)),
    "experiments": Kind("experiment", ("exp", "id"), "claim", tags=("experiment",)),
    "failure_points": Kind("failure_point", ("fp", "id", "path"), "title", path="path", clade="clade", tags=("risk",)),
    "drift": Kind("drift", ("drift", "clade"), "clade", clade="clade", confidence="drift", tags=("drift",)),
    "signals": Kind("signal", ("signal", "name"), "name", confidence="confidence", tags=("signal",)),
    "debt": Kind("debt_item", ("debt", "path"), "path", path="path", tags=("debt",)),
    "coupling": Kind("coupling_edge", ("couple", "a", "b"), "a", path="a", tags=("coupling",), links=(("lineage", ("a",), "lineage", "context"), ("lineage", ("b",), "lineage", "context"))),
    "samples": Kind("state_sample", ("state", "month"), "month", at="at", tags=("dynamics", "state")),
    "impulses": Kind("impulse_response", ("impulse", "kind", "label", "at@day"), "label", at="at", confidence="confidence", tags=("dynamics", "impulse"), links=(("event", ("kind", "label", "at@day"), "lifecycle_event", "context"),)),
    "basins": Kind("regime_basin", ("basin", "stage", "at@day"), "stage", at="at", confidence="occupancy", tags=("dynamics", "basin")),
    "episodes": Kind("path_episode", ("episode", "path", "first_sha", "last_sha"), "path", at="at", path="path", clade="clade", sha="last_sha", tags=("episode", "path"), links=(_LINEAGE,)),
    "issues": Kind("selection_item", ("issue", "number", "title"), "title", at="at", tags=("selection", "issue")),
    "pulls": Kind("selection_item", ("pr", "number", "title"), "title", at="at", tags=("selection", "pr")),
    "report_deltas": Kind("report_delta", ("delta", "direction", "item"), "item", tags=("diff",)),
    "blast": Kind("blast_radius", ("blast", "path"), "path", path="path", confidence="score", tags=("blast", "risk"), links=(_LINEAGE,)),
    "symbols": Kind("symbol", ("sym", "qualname"), "qualname", path="path", tags=("micro", "symbol"), links=(_LINEAGE, _BLAST)),
    "cst": Kind("cst_delta", ("cst", "path", "node", "window"), "node", path="path", tags=("micro", "cst"), links=(_LINEAGE,)),
    "cst_windows": Kind("cst_delta", ("cstwin", "window"), "window", at="at", tags=("micro", "cst", "window")),
    "gene_flow": Kind("gene_flow", ("flow", "a", "b"), "a", clade="a", tags=("genetics", "flow"), links=(("clade", ("a",), "clade", "context"), ("clade", ("b",), "clade", "context"))),
    "transfers": Kind("gene_flow", ("hgt", "sha"), "sha", sha="sha", tags=("genetics", "hgt")),
    "clones": Kind("clone_link", ("clone", "id"), "id", path="path", tags=("genetics", "clone")),
    "forks": Kind("clone_link", ("fork", "hash"), "hash", path="path", tags=("genetics", "fork")),
    "reticulation": Kind("reticulation", ("ret", "a", "b"), "a", path="a", tags=("genetics", "reticulation"), links=(("lineage", ("a",), "lineage", "context"), ("lineage", ("b",), "lineage", "context"))),
}


def _part(spec: str) -> Column:
    name, _, how = spec.partition("@")
    if how == "day":
        return F.date_format(name, "yyyy-MM-dd")
    return F.substring(F.col(name).cast("string"), 1, int(how)) if how else F.col(name).cast("string")


def record_key(prefix: str, parts: tuple[str, ...]) -> Column:
    """An id of one prefix and some columns, whose empty and missing parts are left out."""
    return F.substring(F.concat_ws(":", F.lit(prefix), *[F.when(_part(p) != "", _part(p)) for p in parts]), 1, ID)


def _records_of(df: DataFrame, k: Kind) -> DataFrame:
    column = lambda c: F.lit(None) if c is None else F.col(c)
    link = lambda prefix, parts, kind, role: F.when(F.coalesce(_part(parts[0]), F.lit("")) != "", F.struct(record_key(prefix, parts).alias("record_id"), F.lit(kind).alias("kind"), F.lit(role).alias("role")))
    links = F.array_compact(F.array(*[link(*x) for x in k.links])) if k.links else F.array()
    return df.select(
        record_key(k.id[0], k.id[1:]).alias("id"), F.lit(k.kind).alias("kind"), column(k.at).cast("timestamp").alias("at"), column(k.path).cast("string").alias("path"), column(k.clade).cast("string").alias("clade"),
        column(k.sha).cast("string").alias("sha"), F.col(k.label).cast("string").alias("label"), column(k.confidence).cast("double").alias("confidence"), F.array(*map(F.lit, k.tags)).alias("tags"), links.cast(_LINKS).alias("links"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
    )


def _trajectory(samples: DataFrame, least: int = 12) -> DataFrame:
    """The one record over all state samples: it links the last eight and says whether they suffice."""
    last = samples.orderBy(F.desc("month")).limit(8).agg(F.array_sort(F.collect_list("month")).alias("m"))
    one = samples.agg(F.count("*").alias("n"), F.min("at").alias("at")).filter("n > 0").crossJoin(F.broadcast(last))
    few = F.col("n") < least
    return one.select(
        F.lit("trajectory:global").alias("id"), F.lit("trajectory").alias("kind"), F.col("at").cast("timestamp").alias("at"), *[F.lit(None).cast("string").alias(c) for c in ("path", "clade", "sha")], F.lit("global_trajectory").alias("label"),
        F.when(few, 0.35).otherwise(0.65).alias("confidence"), F.when(few, F.array(F.lit("dynamics"), F.lit("trajectory"), F.lit("insufficient"))).otherwise(F.array(F.lit("dynamics"), F.lit("trajectory"))).alias("tags"),
        F.transform("m", lambda m: F.struct(F.concat(F.lit("state:"), m).alias("record_id"), F.lit("state_sample").alias("kind"), F.lit("measures").alias("role"))).cast(_LINKS).alias("links"), F.to_json(F.struct("n")).alias("payload"),
    )


def records(tables: dict[str, DataFrame]) -> DataFrame:
    """The ledger of the tables at hand, named as in ``KINDS``: id, kind, at, path, clade, sha, label, confidence, tags, links, payload."""
    parts = [_records_of(tables[name], k) for name, k in KINDS.items() if name in tables]
    if "samples" in tables:
        parts.append(_trajectory(tables["samples"]))
    return reduce(DataFrame.unionByName, parts)


def claim_frames(tables: dict[str, DataFrame], ledger: DataFrame, most: int = FRAMES) -> DataFrame:
    """(place, id, claim, stance, confidence, evidence) of nine kinds of claims, each id once, the first ``most`` in order of kind, then id.

    A stage, with ``stage`` (stage, method, confidence) in the tables; the most occupied basin; hypotheses; experiments; failure points; type branches
    (``branch_trends``: type_key, trend, churn); responses; changes since the last report; selection pressure. Evidence is what the ledger holds, by
    ids that follow from the claim, ten records to a claim.
    """
    ledger = cut(ledger.select("id", "kind", "path", "clade", "label", "confidence", "tags", "at"), "ledger")
    frames: list[DataFrame] = []
    evidence: list[DataFrame] = []

    def claim(df: DataFrame, turn: int, key: Column, said: Column, stance: Column, confidence: Column) -> None:
        frames.append(df.select(F.lit(turn).alias("turn"), F.substring(key, 1, 120).alias("id"), said.cast("string").alias("claim"), stance.cast("string").alias("stance"), confidence.cast("double").alias("confidence")))

    def bears(df: DataFrame, key: Column, rank: int, record: Column, role: str) -> None:
        evidence.append(df.select(F.substring(key, 1, 120).alias("frame"), F.lit(rank).alias("rank"), record.alias("record_id"), F.lit(role).alias("role")))

    of = lambda *kinds: ledger.filter(F.col("kind").isin(*kinds))
    one = lambda text: F.lit(text)
    if "stage" in tables:
        claim(tables["stage"], 0, one("frame:stage"), F.concat(F.lit("Repository ecological stage is "), "stage"), F.when(F.col("method") == "heuristic_fallback", "weak").otherwise("support"), F.coalesce("confidence", F.lit(0.4)))
        supports = of("stage_segment", "lifecycle_event").filter((F.col("kind") == "stage_segment") | F.array_contains("tags", "anchor"))
        bears(supports.orderBy("at", "id").limit(8), one("frame:stage"), 0, F.col("id"), "supports")
        bears(of("trajectory"), one("frame:stage"), 1, F.col("id"), "measures")
        bears(of("regime_basin", "state_sample").orderBy("kind", "id").limit(STAGE_EVIDENCE), one("frame:stage"), 2, F.col("id"), "measures")
    basin = of("regime_basin").orderBy(F.desc("confidence"), "id").limit(1)
    few = of("trajectory").agg(F.coalesce(F.max(F.array_contains("tags", "insufficient")), F.lit(False)).alias("few"))
    claim(basin.crossJoin(F.broadcast(few)), 1, one("frame:basin"), F.concat(F.lit("Trajectory occupies "), "label", F.lit(" basin")), F.when(F.col("few"), "insufficient").otherwise("support"), F.col("confidence"))
    bears(basin, one("frame:basin"), 0, F.col("id"), "supports")
    bears(of("trajectory"), one("frame:basin"), 1, F.col("id"), "measures")
    bears(of("state_sample").orderBy("id").limit(8), one("frame:basin"), 2, F.col("id"), "measures")
    if "hypotheses" in tables:
        h, key = tables["hypotheses"], F.concat(F.lit("frame:"), "id")
        claim(h, 2, key, F.col("claim"), F.coalesce("verdict", F.lit("open")), F.coalesce("confidence", F.lit(0.0)))
        bears(h, key, 0, record_key("hyp", ("id",)), "supports")
        # Laws look at changepoints, claims on stages at segments and events: the first seven of each, dealt to all such claims.
        for wanted, kinds in ((F.startswith("id", F.lit("lehman")), ("changepoint",)), (F.contains("id", F.lit("stage")) & ~F.startswith("id", F.lit("lehman")), ("stage_segment", "lifecycle_event"))):
            some = of(*kinds).orderBy("at", "id").limit(7).agg(F.collect_list("id").alias("ids"))
            bears(h.filter(wanted).crossJoin(F.broadcast(some)).withColumn("rid", F.explode("ids")), key, 1, F.col("rid"), "context")
    if "experiments" in tables:
        x, key = tables["experiments"], F.concat(F.lit("frame:exp:"), F.col("id"))
        claim(x, 3, key, F.col("claim"), F.lit("open"), F.lit(0.55))
        bears(x, key, 0, record_key("exp", ("id",)), "measures")
        typed = of("code_type", "clade").select(F.col("label").alias("branch"), F.col("id").alias("rid"))
        bears(x.join(typed, "branch"), key, 1, F.col("rid"), "context")
    if "failure_points" in tables:
        r, key = tables["failure_points"], F.concat(F.lit("frame:risk:"), F.col("id"))
        claim(r, 4, key, F.coalesce("title", "id"), F.lit("risk"), F.when(F.col("severity") >= 0.75, 0.6).otherwise(0.45))
        for rank, record, role in ((0, record_key("fp", ("id", "path")), "supports"), (1, record_key("lineage", ("path",)), "context"), (2, record_key("clade", ("clade",)), "context"), (3, record_key("blast", ("path",)), "measures")):
            bears(r, key, rank, record, role)
        micro = of("symbol", "cst_delta").select("path", F.col("id").alias("rid"), F.col("kind").alias("k"))
        for rank, k, role in ((4, "symbol", "context"), (5, "cst_delta", "measures")):
            bears(r.join(micro.filter(F.col("k") == k), "path"), key, rank, F.col("rid"), role)
    if "branch_trends" in tables:
        b, key = tables["branch_trends"].filter("type_key <> ''").orderBy(F.desc("churn"), "type_key").limit(BRANCHES), F.concat(F.lit("frame:branch:"), F.col("type_key"))
        claim(b, 5, key, F.concat(F.lit("Typed branch "), "type_key", F.lit(" is "), "trend"), F.col("trend"), F.when(F.col("trend").isin("heating", "cooling"), 0.55).otherwise(0.4))
        types = of("code_type").select(F.col("label").alias("type_key"), F.col("id").alias("rid"), F.col("path").alias("p"), F.col("clade").alias("c"))
        bears(b.join(types, "type_key"), key, 0, F.col("rid"), "supports")
        bears(b.join(types, "type_key").select("type_key", "c").distinct(), key, 1, record_key("clade", ("c",)), "supports")
        deltas = of("commit_delta").select(F.col("path").alias("p"), F.col("id").alias("did"))
        bears(b.join(types, "type_key").join(deltas, "p"), key, 2, F.col("did"), "supports")
    response, key = of("impulse_response").orderBy("at", "id").limit(RESPONSES), F.concat(F.lit("frame:response:"), F.col("label"))
    claim(response, 6, key, F.concat(F.lit("Impulse after "), "label"), F.lit("open"), F.coalesce("confidence", F.lit(0.5)))
    bears(response, key, 0, F.col("id"), "measures")
    deltas = of("report_delta").withColumn("worse", F.contains("id", F.lit(":worsened:")))
    counts = deltas.agg(F.count_if("worse").alias("w"), F.count_if(~F.col("worse")).alias("b")).filter("w + b > 0")
    claim(counts, 7, one("frame:delta:report"), F.concat(F.lit("Since previous report: "), F.col("b").cast("string"), F.lit(" improved, "), F.col("w").cast("string"), F.lit(" worsened signals")), F.when(F.col("w") > F.col("b"), "risk").when(F.col("b") > 0, "support").otherwise("open"), F.lit(0.55))
    bears(deltas.orderBy("id").limit(8), one("frame:delta:report"), 0, F.col("id"), "supports")
    pressure = ledger.filter("id = 'signal:selection_pressure'")
    claim(pressure, 8, one("frame:selection"), F.col("label"), F.when(F.col("confidence") >= 0.55, "risk").otherwise("open"), F.coalesce("confidence", F.lit(0.4)))
    bears(pressure, one("frame:selection"), 0, F.col("id"), "supports")
    bears(of("selection_item").filter(F.array_contains("tags", "issue")).orderBy("at", "id").limit(5), one("frame:selection"), 1, F.col("id"), "context")

    once = reduce(DataFrame.unionByName, frames).groupBy("id").agg(F.min(F.struct("turn", "claim", "stance", "confidence")).alias("s")).select("id", "s.*")
    kept = cut(once.orderBy("turn", "id").limit(most).withColumn("place", F.row_number().over(Window.orderBy("turn", "id"))), "frames")
    held = reduce(DataFrame.unionByName, evidence).join(kept.select(F.col("id").alias("frame")), "frame", "left_semi").join(ledger.select(F.col("id").alias("record_id"), F.col("kind").alias("of")), "record_id")
    distinct = held.groupBy("frame", "record_id", "of").agg(F.min(F.struct("rank", "role")).alias("s"))
    order = Window.partitionBy("frame").orderBy("s.rank", "record_id")
    first = distinct.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.when(F.col("frame") == "frame:stage", STAGE_EVIDENCE).otherwise(EVIDENCE))
    listed = first.groupBy(F.col("frame").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "record_id", F.col("of").alias("kind"), F.col("s.role").alias("role")))), lambda e: F.struct(e["record_id"].alias("record_id"), e["kind"].alias("kind"), e["role"].alias("role"))).alias("evidence"))
    return kept.join(listed, "id", "left").select("place", "id", "claim", "stance", "confidence", F.coalesce("evidence", F.array().cast(_LINKS)).alias("evidence"))


#: What a path pack shows: slot, kinds of records, and how many of them (fixed values).
SLOTS = (
    ("lineage", ("lineage",), 1), ("code_type", ("code_type",), 1), ("blast", ("blast_radius",), 1), ("symbols", ("symbol",), 12), ("cst", ("cst_delta",), 8), ("episodes", ("path_episode",), 8), ("deltas", ("commit_delta",), 20),
    ("risks", ("failure_point",), 50), ("graph_links", ("gene_flow", "clone_link", "reticulation", "coupling_edge"), 10),
)


def path_packs(ledger: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One row per path: clade, and the ids of its records in each slot, the latest first, its frames and its last twenty dated records.

    All paths at once: each record is dealt to its path, links between two paths to both, and only the first of each slot are gathered.
    """
    linking = F.col("kind").isin("coupling_edge", "reticulation")
    rows = cut(ledger.filter(F.col("path").isNotNull() | linking).select("id", "kind", "at", "path", "clade", F.when(linking, F.col("links")).alias("links")), "pack-records")
    ends = rows.filter(linking).select("id", "kind", "at", F.explode("links").alias("l")).filter("l.kind = 'lineage'").select("id", "kind", "at", F.substring("l.record_id", len("lineage:") + 1, ID).alias("path"))
    own = rows.filter("path IS NOT NULL AND path <> ''").select("id", "kind", "at", "path").unionByName(ends)
    own = own.repartition(F.col("path")).distinct()  # all that follows is by path, so records are shuffled once
    slots = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.struct(F.lit(name).alias("slot"), F.lit(most).alias("most"))) for name, kinds, most in SLOTS], F.when(F.col("at").isNotNull(), F.struct(F.lit("timeline").alias("slot"), F.lit(20).alias("most")))))
    dealt = own.withColumn("s", F.explode(slots)).select("path", "id", "at", "s.slot", "s.most")
    if frames is not None:
        cited = frames.select("id", "place", F.explode("evidence.record_id").alias("rid")).join(rows.filter("path IS NOT NULL").select(F.col("id").alias("rid"), "path"), "rid").groupBy("path", "id").agg(F.min("place").alias("place"))
        dealt = dealt.unionByName(cited.select("path", "id", (-F.col("place")).cast("bigint").cast("timestamp").alias("at"), F.lit("frames").alias("slot"), F.lit(8).alias("most")))
    first = dealt.withColumn("k", F.row_number().over(Window.partitionBy("path", "slot").orderBy(F.desc_nulls_last("at"), "id"))).filter(F.col("k") <= F.col("most"))
    names = [s[0] for s in SLOTS] + ["timeline"] + (["frames"] if frames is not None else [])
    gathered = first.groupBy("path").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == n, F.struct("k", "id")))), lambda x: x["id"]).alias(n) for n in names])
    clade = rows.filter("path IS NOT NULL AND clade IS NOT NULL").groupBy("path").agg(F.min(F.struct((F.col("kind") != "lineage").alias("other"), "clade")).getField("clade").alias("clade"))
    return gathered.join(clade, "path", "left")


def select_records(ledger: DataFrame, path: str | None = None, clade: str | None = None, kinds: list[str] | None = None, tag: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records that pass all filters: a path held in theirs or in their label, a clade or a tag of that name, kinds, a tag, and a span of time, which those without a time pass too."""
    out = ledger
    if path:
        out = out.filter(F.coalesce(F.contains("path", F.lit(path)), F.lit(False)) | F.coalesce(F.contains("label", F.lit(path)), F.lit(False)))
    if clade:
        out = out.filter(F.coalesce(F.col("clade") == clade, F.lit(False)) | F.array_contains("tags", clade))
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if tag:
        out = out.filter(F.array_contains("tags", tag))
    if since:
        out = out.filter(F.col("at").isNull() | (F.col("at") >= F.lit(since).cast("timestamp")))
    if until:
        out = out.filter(F.col("at").isNull() | (F.col("at") <= F.lit(until).cast("timestamp")))
    return out


def find_frames(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id): for each key the first frame of that id, or that ends with it, or that holds it. Frames are few, so they are dealt to all keys as one array."""
    named = F.array(*[F.lit(r["id"]) for r in frames.orderBy("place").select("id").collect()])  # FRAMES at most
    hit = F.get(F.filter(named, lambda i: F.contains(i, F.col("key"))), F.lit(0))
    return keys.select("key", hit.alias("id")).filter("id IS NOT NULL")


def frames_on(frames: DataFrame, ledger: DataFrame, path: str | None = None, clade: str | None = None, most: int = 12) -> DataFrame:
    """The frames that a path or clade concerns, by their evidence or their claim, the first ``most``; all of the first where it concerns none."""
    ids = select_records(ledger, path, clade).select("id")
    cited = frames.select(F.col("id").alias("frame"), F.explode("evidence.record_id").alias("rid")).join(ids.withColumnRenamed("id", "rid"), "rid", "left_semi").select("frame").distinct()
    said = F.contains("claim", F.lit(path)) if path else F.lit(False)
    said = said | F.contains("claim", F.lit(clade)) if clade else said
    focused = cut(frames.join(cited, frames["id"] == cited["frame"], "left").filter(F.col("frame").isNotNull() | F.coalesce(said, F.lit(False))).drop("frame"), "focused")
    return (frames if focused.isEmpty() else focused).orderBy("place").limit(most)
