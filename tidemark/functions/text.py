"""Column functions over paths, subjects and source text. All are built-in expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
DEPENDENCY_FILE = (
    r"(?i)(requirements.*\.txt|pyproject\.toml|setup\.py|Pipfile|poetry\.lock|package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|"
    r"go\.mod|go\.sum|Cargo\.toml|Cargo\.lock|Gemfile|composer\.json)$"
)
TEST_PATH = r"(^|/)tests?(/|$)|_test\.|spec\."
SIX_LAYERS = [
    ("tests", r"(^|/)(tests?|spec)(/|$)|_test\.|\.test\.|\.spec\."),
    ("docs", r"(^|/)(docs?|documentation)(/|$)|readme"),
    ("config", r"(^|/)(config|settings|\.github|deploy|infra|ops)(/|$)"),
    ("utility", r"(^|/)(utils?|helpers?|common|misc|shared)(/|$)"),
    ("core", r"(^|/)(src|lib|pkg|app|core)(/|$)"),
]
EIGHT_LAYERS = [
    ("tests", r"(?i)(^|/)(tests?|spec|__tests__)(/|$)"),
    ("docs", r"(?i)(^|/)(docs?|documentation)(/|$)"),
    ("ci", r"(?i)(^|/)(\.github|\.gitlab|ci|scripts)(/|$)"),
    ("frontend", r"(?i)(^|/)(frontend|web|ui|client|src/components)(/|$)"),
    ("backend", r"(?i)(^|/)(backend|server|api|services)(/|$)"),
    ("core", r"(?i)(^|/)(src|lib|core|pkg)(/|$)"),
    ("config", r"(?i)(^|/)(\.env|config|deploy|infra|ops)(/|$)"),
    ("deps", r"(?i)(package\.json|pyproject|requirements|Cargo\.toml|go\.mod)"),
]
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby",
    "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "md": "docs", "yml": "config", "yaml": "config", "toml": "config", "json": "config",
}
INTENT_WORDS = {
    "feat": ("feat", "feature", "add", "implement", "introduce", "support", "scaffold", "init", "initial"),
    "fix": ("fix", "bugfix", "patch", "resolve", "crash", "error", "regression", "hotfix"),
    "refactor": ("refactor", "cleanup", "restructure", "rename", "simplify", "extract", "modular"),
    "test": ("test", "tests", "coverage", "spec", "fixture", "e2e", "unit"),
    "docs": ("docs", "documentation", "readme", "changelog", "comment"),
    "perf": ("perf", "performance", "optimize", "speed", "latency", "memory"),
    "security": ("security", "auth", "cve", "vulnerability", "sanitize", "privilege"),
    "chore": ("chore", "deps", "dependency", "bump", "ci", "build", "release", "version", "style"),
    "revert": ("revert", "rollback", "undo"),
    "merge": ("merge",),
}
INTENTS = "feat|fix|docs|style|refactor|perf|test|chore|ci|build|revert|security"
DEBT_PATTERNS = [
    r"\bDeprecationWarning\b", r"(?i)\bdeprecated\b", r"(?i)@deprecated\b", r"DEPRECATED", r"(?i)pending deprecation", r"(?i)will be removed",
    r"(?i)TODO\s*:?\s*(fix|hack|tech\s*debt)", r"FIXME|XXX|HACK",
]


def is_revert(subject: Column, body: Column) -> Column:
    return subject.rlike(r"(?i)\brevert\b") | F.concat_ws("\n", subject, body).rlike(r"(?i)\brevert(s|ed)?\s+(commit\s+)?[0-9a-f]{7,40}\b")


def reverted_sha(subject: Column, body: Column) -> Column:
    """The hash a revert names, else the first hash in the body, else in the subject."""
    named = F.regexp_extract(F.concat_ws("\n", subject, body), r"(?i)\breverts?(?:ed)?\s+(?:commit\s+)?([0-9a-f]{7,40})\b", 1)
    first = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"\b([0-9a-f]{7,40})\b", 1)
    some = lambda c: F.when(c != "", c)
    return F.when(is_revert(subject, body), F.coalesce(some(named), some(first(body)), some(first(subject))))


def renamed(path: Column) -> tuple[Column, Column]:
    """(current, old) of ``old => new`` and ``dir/{old => new}/rest``; old is null without a rename."""
    inner = r"^(.*)\{(.*) => (.*)\}(.*)$"
    both = lambda g: F.regexp_replace(F.concat(F.regexp_extract(path, inner, 1), F.regexp_extract(path, inner, g), F.regexp_extract(path, inner, 4)), "//+", "/")
    plain = r"^(.*) => (.*)$"
    now = F.when(path.rlike(inner), both(3)).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 2))).otherwise(path)
    old = F.when(path.rlike(inner), both(2)).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 1)))
    return now, old


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(ext == "", "unknown").otherwise(F.coalesce(known[ext], ext))


def top_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def tokenize(text: Column) -> Column:
    """Lower-case identifiers of three letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]{2,})"))


def path_tokens(path: Column) -> Column:
    """Distinct lower-case words of a path, camel and snake case split, two letters or more, no numbers."""
    split = F.split(F.lower(F.regexp_replace(path, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(split, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$")))


def graph_tokens(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"[^a-z0-9:/_.-]+"), lambda t: F.length(t) >= 2)


def tickets(subject: Column, body: Column) -> Column:
    """Distinct tickets in order: #n, KEYWORD-n as #n, ABC-n in capitals."""
    found = F.regexp_extract_all(F.concat_ws("\n", subject, body), F.lit(r"(?i)(#\d+|(?:JIRA|TICKET|ISSUE|GH|PR)[-_ ]?\d+|[A-Z]{2,10}-\d+)"), F.lit(1))
    name = lambda t: F.when(t.rlike(r"(?i)^(#|(JIRA|TICKET|ISSUE|GH|PR)[-_ ]?\d)"), F.concat(F.lit("#"), F.regexp_extract(t, r"(\d+)$", 1))).otherwise(F.upper(t))
    return F.array_distinct(F.transform(found, name))


def intent(subject: Column, n_parents: Column) -> Column:
    """struct(kind, confidence, stance) of a commit's subject."""
    text = F.trim(F.coalesce(subject, F.lit("")))
    alias = lambda k: F.when(k.isin("style", "ci", "build"), "chore").otherwise(k)
    made = lambda kind, conf, stance: F.struct(kind.alias("kind"), conf.cast("double").alias("confidence"), stance.alias("stance"))
    conventional = F.lower(F.regexp_extract(text, rf"(?i)^({INTENTS})(\([^)]+\))?(!)?\s*:", 1))
    prefix = F.lower(F.regexp_extract(text, rf"(?i)^({INTENTS}|merge)\b", 1))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"))
    count = lambda words: F.size(F.filter(tokens, lambda t: t.isin(*words)))
    votes = F.array(*[F.struct(count(words).alias("n"), F.lit(-i).alias("i"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(INTENT_WORDS.items())])
    best = F.array_max(votes)
    conf = F.least(F.lit(0.7), 0.35 + 0.15 * best["n"])
    return (
        F.when((n_parents > 1) | F.lower(text).startswith("merge "), made(F.lit("merge"), F.lit(0.9), F.lit("support")))
        .when(conventional != "", made(alias(conventional), F.lit(0.92), F.lit("support")))
        .when(prefix != "", made(alias(prefix), F.lit(0.75), F.lit("support")))
        .when(best["n"] > 0, made(best["kind"], F.round(conf, 3), F.when(conf < 0.55, "weak").otherwise("support")))
        .otherwise(made(F.lit("unknown"), F.lit(0.0), F.lit("insufficient")))
    )


def release_kind(label: Column, subject: Column) -> Column:
    """struct(kind, stage, confidence) of a release tag by its version number; security words come first."""
    pattern = r"(\d+)\.(\d+)(?:\.(\d+))?"
    part = lambda g: F.coalesce(F.try_to_number(F.regexp_extract(label, pattern, g), F.lit("999999999")).cast("bigint"), F.lit(0))
    has = label.rlike(pattern)
    made = lambda kind, stage, conf: F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), F.lit(conf).alias("confidence"))
    return (
        F.when(F.concat_ws(" ", label, subject).rlike(r"(?i)\b(security|cve|vulnerab\w*)\b"), made("security", "disturbance", 0.9))
        .when(has & (part(1) >= 1) & (part(2) == 0) & (part(3) == 0), made("major_release", "growth", 0.85))
        .when(has & (part(3) == 0) & (part(2) > 0), made("minor_release", "growth", 0.75))
        .when(has & (part(3) > 0), made("patch_release", "maturity", 0.65))
        .when(has, made("release", "consolidation", 0.6))
        .otherwise(made("release", "consolidation", 0.55))
    )


def debt_pattern(line: Column, patterns: list[str] | None = None) -> Column:
    """Number (from 0) of the first pattern a line matches, or null."""
    out = None
    for i, p in enumerate(DEBT_PATTERNS if patterns is None else patterns):
        out = F.when(line.rlike(p), i) if out is None else out.when(line.rlike(p), i)
    return out


def complexity(text: Column) -> Column:
    """Decision points of source text without comments, at most 500."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)#.*$", ""), r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", "")
    words = r"(?i)(\b(?:if|elif|else|for|while|case|catch|except|switch|when|match|and|or)\b|\?|&&|\|\|)"
    return F.least(F.lit(500), 1 + F.size(F.regexp_extract_all(F.coalesce(bare, F.lit("")), F.lit(words), F.lit(1))))


def stem(name: Column) -> Column:
    """A definition's name without verb prefix and trailing digits, lower-case."""
    base = F.regexp_replace(F.element_at(F.split(name, "::"), -1), r"(?i)^(get|set|is|has|load|save|parse|format)_?", "")
    found = F.regexp_extract(base, r"^([A-Za-z]+)[\d_]*$", 1)
    return F.lower(F.when(found != "", found).otherwise(base))


def shingles(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by one space; none if there are fewer. Give a column, not an expression: it is read for each run."""
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def owner_repo(url: Column) -> Column:
    """owner/name of a repository address or shorthand, else null."""
    pattern = r"^(?:https?://|git@)?[^/:]+\.[^/:]+[/:]([\w.-]+)/([\w.-]+?)(?:\.git)?(?:[/?#].*)?$"
    short = r"^([\w.-]+)/([\w.-]+)$"
    made = lambda p: F.concat(F.regexp_extract(url, p, 1), F.lit("/"), F.regexp_extract(url, p, 2))
    return F.when(url.rlike(pattern), made(pattern)).when(url.rlike(short), made(short))


def record_id(kind: str, *parts: Column) -> Column:
    """kind:part:part, whole: rows are joined by it."""
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def json_get(body: Column, path: str, default: str | None = None) -> Column:
    """The value at a dotted path of a JSON text as a string, or the default."""
    return F.coalesce(F.get_json_object(body, "$." + path), F.lit(default))


def age_decay(at: Column, now: Column, hours: float = 24.0) -> Column:
    """1 / (1 + age in hours over ``hours``); what lies ahead has no age."""
    return 1 / (1 + F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9) / hours)


def month_ordinal(month: Column) -> Column:
    """Months since year 0 of a text like 2024-05."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def newick_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[\s(),:;\[\]']+", "_")


def hash_index(token: Column, dim: int = 64) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def register(spark) -> None:
    """The scalar functions as SQL functions (U1)."""
    for name, body in {
        "layer_of": "array_join(filter(array(" + ", ".join(f"CASE WHEN rlike(p, r'{r}') THEN '{n}' END" for n, r in reversed(SIX_LAYERS)) + "), x -> x IS NOT NULL), ',')",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p STRING) RETURNS STRING RETURN coalesce(nullif(element_at(split({body}, ','), -1), ''), 'other')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), r'([a-z_][a-z0-9_]{2,})')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION soft_inv(x DOUBLE, k DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + k * x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hash_idx(t STRING, dim INT) RETURNS INT RETURN CAST(CAST(conv(substring(sha2(t, 256), 1, 8), 16, 10) AS BIGINT) % dim AS INT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hash_sign(t STRING) RETURNS INT RETURN CASE WHEN CAST(conv(substring(sha2(t, 256), 9, 2), 16, 10) AS INT) % 2 = 0 THEN 1 ELSE -1 END")
