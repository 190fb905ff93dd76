"""Sources: exported commit logs, change statistics, tags, landed JSON, file contents and manifests. All by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_revert, release_kind, renamed, reverted_sha

# Manifest names, source extensions and folders that are skipped.
MANIFESTS = (
    "requirements.txt", "requirements-dev.txt", "pyproject.toml", "setup.py", "Pipfile", "poetry.lock", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "Gemfile", "composer.json",
)
SOURCE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "kt", "rb", "php", "cs", "cpp", "c", "h", "md")
SKIPPED = (".git", "node_modules", ".venv", "venv", "dist", "build", "target", "__pycache__", "vendor")

ISSUES = "number bigint, title string, body string, state string, labels array<struct<name:string>>, created_at timestamp, closed_at timestamp, merged_at timestamp, pull_request struct<url:string>, user struct<login:string>"
MILESTONES = "number bigint, title string, created_at timestamp, due_on timestamp"
ADVISORIES = "ghsa_id string, severity string, summary string, published_at timestamp"
TRACES = "id string, kind string, at timestamp, paths array<string>, frames array<string>, outcome string, _corrupt string"


def commit_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Commits from logs whose records end in 0x1E and whose fields are divided by 0x1F; records of under six fields are dropped."""
    f = F.split(F.ltrim("value"), "\x1f")
    rows = spark.read.text(path, lineSep="\x1e").select(f.alias("f")).filter(F.size("f") >= 6)
    at = lambda i: F.get("f", F.lit(i))
    subject, body = at(5), F.coalesce(F.rtrim(at(6)), F.lit(""))
    iso = at(4)
    out = rows.select(
        at(0).alias("sha"), F.filter(F.split(at(1), " "), lambda p: p != "").alias("parents"), at(2).alias("author"), at(3).alias("email"), F.to_timestamp(iso).alias("ts"),
        # The author's own clock, without the offset that follows it.
        F.to_timestamp_ntz(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts_local"),
        subject.alias("subject"), body.alias("body"), is_revert(subject, body).alias("is_revert"), reverted_sha(subject, body).alias("reverts_sha"),
    )
    return out.filter(F.col("ts") >= F.lit(since).cast("timestamp")) if since else out


def change_stats(rows: DataFrame) -> DataFrame:
    """(sha, path, old, insertions, deletions) of lines (sha, value): insertions, deletions and path between tabs; binary files add 0."""
    parts = F.split("value", "\t")
    n = lambda i: F.coalesce(F.try_to_number(F.get(parts, F.lit(i)), F.lit("999999999999")).cast("bigint"), F.lit(0).cast("bigint"))
    path = F.get(parts, F.lit(2))
    now, old = renamed(path)
    return rows.filter(F.size(parts) >= 3).select("sha", now.alias("path"), old.alias("old"), n(0).alias("insertions"), n(1).alias("deletions"))


def tags(spark: SparkSession, path: str) -> DataFrame:
    """Lifecycle events from lines of tag, date and subject between bars."""
    raw = spark.read.schema("label string, at string, subject string").option("sep", "|").csv(path)
    return raw.select("label", F.to_timestamp("at").alias("at"), release_kind(F.col("label"), F.col("subject")).alias("r")).select("label", "at", "r.*")


def issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues and pulls in the form ``selection_pressure`` takes."""
    raw = spark.read.schema(ISSUES).option("multiLine", True).json(path)
    names = F.coalesce(F.transform("labels", lambda x: F.lower(x["name"])), F.array().cast("array<string>"))
    bugs = F.size(F.filter(names, lambda n: n.contains("bug")))
    return raw.select(
        "number", (F.col("state") == "open").alias("is_open"), (bugs > 0).alias("is_bug"), bugs.alias("n_bug_labels"), F.lower(F.coalesce("title", F.lit(""))).contains("reopen").alias("reopened"),
        F.col("pull_request").isNotNull().alias("is_pull"), F.col("merged_at").isNotNull().alias("merged"),
    )


def milestones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MILESTONES).option("multiLine", True).json(path).select(F.col("title").alias("span"), F.col("created_at").alias("start"), F.col("due_on").alias("due"))


def advisories(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ADVISORIES).option("multiLine", True).json(path)
    grave = F.lower("severity").isin("critical", "high")
    return raw.select(F.col("ghsa_id").alias("label"), F.col("published_at").alias("at"), F.lit("security").alias("kind"), F.lit("disturbance").alias("stage"), F.when(grave, 0.92).otherwise(0.8).alias("confidence"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows from JSON lines; lines that don't parse are left out."""
    return spark.read.schema(TRACES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt is null and id is not null").drop("_corrupt")


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _folders(path: Column) -> Column:
    return F.split(path, "/")


def source_files(spark: SparkSession, path: str, contents: bool = True, most: int | None = None) -> DataFrame:
    """(path, size, text, blob) of source files below a folder, without the skipped folders; whole contents, or ``most`` letters of them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = raw.filter(ext.isin(*SOURCE_EXTENSIONS) & ~F.arrays_overlap(_folders(F.col("path")), F.array(*map(F.lit, SKIPPED))))
    if not contents:
        return kept.select("path", F.col("length").alias("size"))
    text = F.decode("content", "UTF-8")
    return kept.select("path", F.col("length").alias("size"), (F.substring(text, 1, most) if most else text).alias("text"), F.sha1("content").alias("blob"))


def packages(manifests: DataFrame) -> DataFrame:
    """(path, package) named in manifests (path, text), by the manifest's own form."""
    name = F.element_at(_folders(F.col("path")), -1)
    lines = manifests.select("path", "text", name.alias("name"), F.explode(F.split("text", "\n")).alias("line"))
    by_line = F.when(F.col("name").rlike(r"^requirements.*\.txt$|^Pipfile$"), F.regexp_extract("line", r"^\s*([A-Za-z0-9][\w.-]*)", 1))
    by_line = by_line.when(F.col("name").isin("Cargo.toml", "pyproject.toml"), F.regexp_extract("line", r"^\s*\"?([A-Za-z][\w-]*)\"?\s*(?:=\s*[\"{]|[><=~!]=)", 1))
    by_line = by_line.when(F.col("name") == "go.mod", F.regexp_extract("line", r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v", 1)).when(F.col("name") == "go.sum", F.regexp_extract("line", r"^(\S+)\s+v", 1))
    flat = lines.select("path", F.lower(by_line).alias("package"))
    deps = F.map_keys(F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")]))
    json = manifests.filter(name == "package.json").select("path", F.explode(deps).alias("package"))
    return flat.unionByName(json).filter("package is not null and package <> ''").distinct()


def append_traces(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_graph(nodes: DataFrame, edges: DataFrame, tree_rel: str = "parent_of") -> tuple[DataFrame, DataFrame]:
    """Nodes with ranks of kind and generation as axes, edges tagged tree or merge."""
    from pyspark.sql import Window

    kinds = nodes.select("kind").distinct().withColumn("y", F.row_number().over(Window.orderBy("kind")))  # kinds: few rows
    tag = F.when(F.col("rel") == tree_rel, "tree").otherwise("merge")
    return nodes.join(F.broadcast(kinds), "kind").select("id", "kind", F.col("seq").alias("x"), "y"), edges.select("source", "target", tag.alias("tag"))
