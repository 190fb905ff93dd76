"""Deep types of paths from an ontology of keywords, which is a parameter: {name: {"words": [...], "kinds": {...}}}, three levels deep."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An ontology to begin with, four ranks with the type of the whole; users bring their own, of any size.
ONTOLOGY: dict[str, Any] = {
    "architecture": {
        "words": ["src", "lib", "core", "app"],
        "kinds": {
            "api": {
                "words": ["api", "route", "routes", "endpoint"],
                "kinds": {"rest": {"words": ["rest", "http"]}, "rpc": {"words": ["grpc", "proto"]}, "handler": {"words": ["handler", "handlers", "controller"]}, "client": {"words": ["client", "sdk"]}},
            },
            "data": {
                "words": ["data", "database", "storage"],
                "kinds": {"model": {"words": ["model", "models", "entity"]}, "repository": {"words": ["repo", "repository", "store"]}, "migration": {"words": ["migration", "schema"]}, "query": {"words": ["query", "sql"]}, "cache": {"words": ["cache", "redis"]}},
            },
            "ui": {"words": ["ui", "web", "frontend"], "kinds": {"component": {"words": ["component", "components", "widget"]}, "page": {"words": ["page", "view", "screen"]}, "style": {"words": ["style", "theme", "css"]}}},
            "domain": {"words": ["domain", "business"], "kinds": {"service": {"words": ["service", "services", "manager"]}, "event": {"words": ["event", "events", "listener"]}, "policy": {"words": ["policy", "rules"]}}},
            "security": {"words": ["security", "auth"], "kinds": {"authn": {"words": ["auth", "login", "session", "oauth"]}, "crypto": {"words": ["crypto", "encrypt", "hash"]}, "secrets": {"words": ["secret", "vault"]}}},
            "infra": {
                "words": ["infra", "ops", "platform"],
                "kinds": {"ci": {"words": ["ci", "github", "workflows", "pipeline"]}, "deploy": {"words": ["deploy", "docker", "helm", "terraform"]}, "observability": {"words": ["metrics", "tracing", "logging"]}, "config": {"words": ["config", "settings", "env"]}},
            },
            "ml": {"words": ["ml", "training", "inference"], "kinds": {"training": {"words": ["train", "dataset"]}, "embeddings": {"words": ["embedding", "embeddings", "vector"]}, "eval": {"words": ["eval", "benchmark"]}}},
        },
    },
    "verification": {"words": ["test", "tests", "spec"], "kinds": {"unit": {"words": ["unit", "pytest"]}, "e2e": {"words": ["e2e", "playwright"]}, "fixture": {"words": ["fixture", "mock", "stub"]}}},
    "knowledge": {"words": ["docs", "readme", "changelog"], "kinds": {"guide": {"words": ["guide", "tutorial"]}, "architecture": {"words": ["architecture", "adr", "design"]}}},
    "tooling": {"words": ["scripts", "tools"], "kinds": {"build": {"words": ["build", "cmake", "gradle"]}, "lint": {"words": ["lint", "format"]}, "scripts": {"words": ["script", "scripts", "cli"]}}},
    "utility": {"words": ["utils", "helpers", "common"], "kinds": {"parsing": {"words": ["parse", "parser", "lexer"]}, "serialize": {"words": ["serialize", "json", "codec"]}, "time": {"words": ["time", "date", "clock"]}}},
}
#: Words that a file's ending stands for (fixed values).
HINTS = {
    "py": ["architecture"], "ts": ["architecture", "ui"], "tsx": ["architecture", "ui", "component"], "jsx": ["architecture", "ui", "component"], "js": ["architecture"], "go": ["architecture"], "rs": ["architecture"],
    "java": ["architecture"], "kt": ["architecture"], "css": ["architecture", "ui", "style"], "scss": ["architecture", "ui", "style"], "md": ["knowledge"], "rst": ["knowledge"], "yml": ["architecture", "infra", "config"],
    "yaml": ["architecture", "infra", "config"], "toml": ["architecture", "infra", "config"], "json": ["architecture", "infra", "config"], "proto": ["architecture", "api", "rpc"], "sql": ["architecture", "data", "query"],
    "tf": ["architecture", "infra", "deploy"],
}
#: Shares and bonuses of the score (fixed values).
MORE_EXACT, INSIDE, MORE_INSIDE, FROM_ABOVE, WORD_FOLDER, NAME_FOLDER = 0.35, 0.45, 0.1, 0.35, 0.85, 0.55


def ontology_rows(ontology: dict[str, Any]) -> list[tuple[int, list[str], list[str]]]:
    """(place, names from the root, words) of all nodes, each before those below it."""
    out: list[tuple[int, list[str], list[str]]] = []

    def walk(nodes: dict[str, Any], at: list[str]) -> None:
        for name, node in nodes.items():
            out.append((len(out), [*at, name], [w.lower() for w in node["words"]]))
            walk(node.get("kinds", {}), [*at, name])

    walk(ontology, [])
    return out


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    both = F.concat(F.split(F.lower(text), r"[^a-z0-9]+"), F.split(F.lower(spaced), r"[^a-z0-9]+"))
    return F.array_distinct(F.filter(both, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$")))


def path_types(paths: DataFrame, ontology: dict[str, Any] | None = None) -> DataFrame:
    """(path, type_path, confidence) of distinct paths (path): the branch of the ontology whose words a path holds most.

    A node scores by its words among those of the path (and of its file's ending): 1 and .35 for each further one, or .45 and .1
    where words of four letters lie inside others. The deepest scored node of a branch takes the score, with .35 of the
    scores above: of the middle rank by all its kinds, of the root by the last one of each middle. Names and words that are folders add to it.
    Built of column expressions over one constant table, three ranks deep: nothing is shuffled but for the distinct paths.
    """
    nodes = ontology_rows(ontology or ONTOLOGY)
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, at)).alias("at"), F.array(*map(F.lit, words)).alias("words")) for i, at, words in nodes])
    rows = paths.select("path").filter("path is not null").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    hints = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))
    rows = rows.withColumns({"t": F.array_union(_words(F.col("path")), F.coalesce(hints[ending], F.array().cast("array<string>"))), "f": F.filter(F.split(F.lower(folder), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)})

    def scored(n: Column) -> Column:
        exact = F.array_intersect(n["words"], F.col("t"))
        inside = F.filter(n["words"], lambda w: (F.length(w) >= 4) & F.exists("t", lambda t: F.contains(t, w)))
        by_exact = F.struct(n["i"].alias("i"), n["at"].alias("at"), (1.0 + MORE_EXACT * (F.size(exact) - 1)).alias("s"), exact.alias("w"))
        by_part = F.struct(n["i"].alias("i"), n["at"].alias("at"), (INSIDE + MORE_INSIDE * (F.size(inside) - 1)).alias("s"), inside.alias("w"))
        return F.when(F.size(exact) > 0, by_exact).when(F.size(inside) > 0, by_part)

    def take(r: Column, above: Column) -> Column:
        """An entry with its share of the first of the nodes above, if there is one."""
        top = F.get(above, F.lit(0))
        return F.struct(r["i"].alias("i"), r["at"].alias("at"), (r["s"] + F.coalesce(FROM_ABOVE * top["s"], F.lit(0.0))).alias("s"), F.array_union(F.coalesce(top["w"], F.array().cast("array<string>")), r["w"]).alias("w"))

    part = lambda r, k: F.get(r["at"], F.lit(k))
    same_middle = lambda a, b: (part(a, 0) == part(b, 0)) & (part(a, 1) == part(b, 1))
    rows = rows.withColumn("r", F.filter(F.transform(table, scored), lambda x: x.isNotNull()))
    leaves = F.transform(F.filter("r", lambda r: F.size(r["at"]) == 3), lambda r: take(r, F.filter("r", lambda m: (F.size(m["at"]) == 2) & same_middle(r, m))))
    rows = rows.withColumn("leaves", leaves)
    rows = rows.withColumn("base", F.concat("leaves", F.filter("r", lambda r: (F.size(r["at"]) == 2) & ~F.exists("leaves", lambda x: same_middle(r, x)))))
    last = lambda e: ~F.exists("base", lambda x: same_middle(e, x) & (x["i"] > e["i"]))
    with_root = F.transform("base", lambda e: F.when(last(e), take(e, F.filter("r", lambda m: (F.size(m["at"]) == 1) & (part(m, 0) == part(e, 0))))).otherwise(e))
    roots = F.filter("r", lambda r: (F.size(r["at"]) == 1) & ~F.exists("base", lambda x: part(x, 0) == part(r, 0)))
    rows = rows.withColumn("all", F.concat(with_root, roots))
    folders = lambda e: WORD_FOLDER * F.size(F.array_intersect(e["w"], F.col("f"))) + NAME_FOLDER * F.size(F.filter(e["at"], lambda x: F.array_contains("f", x)))
    ranked = F.transform("all", lambda e: F.struct(F.round(e["s"] + folders(e), 9).alias("s"), F.size(e["at"]).alias("n"), (-e["i"]).alias("i"), e["at"].alias("at")))
    rows = rows.withColumn("best", F.array_max(ranked))
    score = F.col("best.s")
    conf = F.least(F.lit(0.98), score / (score + 1.8))
    deep = F.when(F.size("best.at") >= 3, F.least(F.lit(0.99), conf + 0.08)).otherwise(conf)
    none = F.col("best").isNull()
    return rows.select("path", F.when(none, F.array(F.lit("unknown"))).otherwise(F.col("best.at")).alias("type_path"), F.when(none, 0.15).otherwise(F.round(deep, 3)).alias("confidence"))


def breakout_seed(path: Column, type_path: Column, confidence: Column) -> Column:
    """Key a clade grows from: two or three levels of a sure type and the top folder, else the folder alone."""
    top = F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")
    depth = F.when(confidence >= 0.55, 3).otherwise(2)
    folder = F.concat(F.lit("dir:"), top)
    sure = (confidence >= 0.42) & (F.element_at(type_path, 1) != "unknown")
    return F.when(sure, F.concat(F.lit("type:"), F.array_join(F.slice(type_path, F.lit(1), depth), "/"), F.lit("|"), folder)).otherwise(folder)


def gold_accuracy(types: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: share of gold paths (path, expected) whose type begins as expected."""
    j = gold.join(types, "path", "left")
    ok = F.slice("type_path", F.lit(1), F.size("expected")) == F.col("expected")
    return j.agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("hits"))


def outline(ontology: dict[str, Any] | None = None) -> list[tuple[str, int, int]]:
    """(path, depth, words) of the ontology's nodes."""

    def walk(node: dict[str, Any], at: tuple[str, ...]) -> list[tuple[str, int, int]]:
        return reduce(lambda out, kv: out + [("/".join((*at, kv[0])), len(at) + 1, len(kv[1]["words"]))] + walk(kv[1].get("kinds", {}), (*at, kv[0])), node.items(), [])

    return walk(ontology or ONTOLOGY, ())
