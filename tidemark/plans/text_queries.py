"""Queries over texts, vectors and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import reticulation, retrieval, texts, wordvectors
from tidemark.operators.taxonomy import first_rule
from tidemark.plans.registry import query
from tidemark.plans.testmap import table


def docs(spark, d):
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text", "lang")


def turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "conv_id", "turn")


_PATTERNS = ["(?i)licen[sc]e", "All rights", r"\d{4}-\d{4}"]
D = "WITH d AS (SELECT source || '/' || doc_id AS path, text FROM documents)"
TOK = "regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')"


@query(
    "pattern_lines",
    D
    + r""", l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
    p AS (SELECT path, CAST(line AS INTEGER) AS line, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 0 WHEN regexp_matches(text, 'All rights') THEN 1 WHEN regexp_matches(text, '\d{4}-\d{4}') THEN 2 END AS pattern, text FROM l)
    SELECT * FROM p WHERE pattern IS NOT NULL""",
)
def _(spark, d):
    return texts.matching_lines(docs(spark, d), _PATTERNS)


_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1)"


@query(
    "url_tokens",
    rf"""WITH u AS (SELECT page_id, regexp_split_to_array(lower(regexp_replace(url, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+') AS t FROM pages),
    x AS (SELECT page_id, unnest(t) AS token FROM u) SELECT DISTINCT page_id, token FROM x WHERE length(token) >= 2 AND NOT regexp_matches(token, '^\d+$')""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.path_tokens(F.col("url"))).alias("token"))


@query(
    "path_layers",
    f"""WITH p AS (SELECT page_id, {_PATH} AS path, 'pkg/' || n AS more FROM pages, (SELECT unnest(['tests/a.py', 'src/b.ts', 'docs/c.md', 'util/x', 'z.toml']) AS n)), q AS (SELECT page_id, more || coalesce(path, '') AS path FROM p)
    SELECT page_id, path, CASE WHEN regexp_matches(path, '(^|/)(tests?|spec)(/|$)|_test\\.|\\.test\\.|\\.spec\\.') THEN 'tests' WHEN regexp_matches(path, '(^|/)(docs?|documentation)(/|$)|readme') THEN 'docs'
      WHEN regexp_matches(path, '(^|/)(config|settings|\\.github|deploy|infra|ops)(/|$)') THEN 'config' WHEN regexp_matches(path, '(^|/)(utils?|helpers?|common|misc|shared)(/|$)') THEN 'utility'
      WHEN regexp_matches(path, '(^|/)(src|lib|pkg|app|core)(/|$)') THEN 'core' ELSE 'other' END AS layer,
      regexp_matches(path, '(^|/)tests?(/|$)|_test\\.|spec\\.') AS is_test, split_part(path, '/', 1) AS top FROM q""",
)
def _(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    rows = table(spark, d, "pages").select("page_id", F.explode(F.array(*[F.concat(F.lit("pkg/" + n), path) for n in ("tests/a.py", "src/b.ts", "docs/c.md", "util/x", "z.toml")])).alias("path"))
    p = F.col("path")
    return rows.select("page_id", "path", first_rule(p, T.SIX_LAYERS, "other").alias("layer"), p.rlike(T.TEST_PATH).alias("is_test"), T.top_directory(p).alias("top"))


@query("repo_of_url", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/:]+\.[^/:]+/[\w.-]+/[\w.-]+') THEN regexp_extract(url, '^https?://[^/:]+\.[^/:]+/([\w.-]+)/([\w.-]+)', 1) || '/' || regexp_extract(url, '^https?://[^/:]+\.[^/:]+/([\w.-]+)/([\w.-]+)', 2) END AS repo FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.owner_repo(F.col("url")).alias("repo"))


@query("commit_intents", "SELECT event_type, 'unknown' AS kind, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1 UNION ALL SELECT event_type, 'fix', count(*) FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_type", T.intent(F.concat(F.col("event_type"), F.lit(" on "), F.col("user_id").cast("string")), F.lit(1)).getField("kind").alias("kind")).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


_HEX = lambda c: f"(strpos('0123456789abcdef', substr(h, {c}, 1)) - 1)"
_EMB = f""", t AS (SELECT id, unnest({TOK}) AS t FROM r), c AS (SELECT id, t, count(*) AS n, sha256(t) AS h FROM t GROUP BY 1, 2),
    e AS (SELECT id, CAST(({_HEX(7)} * 16 + {_HEX(8)}) % 64 AS INTEGER) AS idx, CAST(sum(n * CASE WHEN {_HEX(10)} % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS val FROM c GROUP BY 1, 2 HAVING sum(n * CASE WHEN {_HEX(10)} % 2 = 0 THEN 1 ELSE -1 END) <> 0)"""
R = "WITH r AS (SELECT conv_id * 1000 + turn AS id, text, conv_id, turn FROM conversations)"


@query("hash_embedding", R + _EMB + " SELECT * FROM e")
def _(spark, d):
    return texts.hash_embedding(turns(spark, d))


@query(
    "semantic_drift",
    R
    + _EMB
    + """, u AS (SELECT e.*, val / sqrt(sum(val * val) OVER (PARTITION BY id)) AS x, (id % 1000) < 2 AS early FROM e),
    m AS (SELECT early, idx, sum(x) / (SELECT count(DISTINCT id) FROM u b WHERE b.early = a.early) AS x FROM u a GROUP BY 1, 2),
    j AS (SELECT coalesce(p.x, 0) AS p, coalesce(q.x, 0) AS q FROM (SELECT * FROM m WHERE early) p FULL JOIN (SELECT * FROM m WHERE NOT early) q USING (idx))
    SELECT round(1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 6) AS drift FROM j""",
)
def _(spark, d):
    v = texts.unit(texts.hash_embedding(turns(spark, d))).withColumn("early", F.col("id") % 1000 < 2)
    return texts.drift(v).withColumn("drift", F.round("drift", 6))


_DOT = "list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) FOR p IN list_zip({a}, {b})])"


@query(
    "vector_topk",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT.format(a="a.embedding", b="b.embedding")} / sqrt({_DOT.format(a="a.embedding", b="a.embedding")} * {_DOT.format(a="b.embedding", b="b.embedding")}) AS score
      FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s)
    SELECT query_id, CAST(k AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE k <= 8""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return texts.vector_topk(v.filter(F.col("id") % 100 == 0), v).withColumn("score", F.round("score", 6))


@query(
    "kmeans_step",
    f"""WITH c AS (SELECT label AS cluster, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY 1),
    s AS (SELECT vec_id AS id, cluster, {_DOT.format(a="embedding", b="c")} / sqrt({_DOT.format(a="embedding", b="embedding")} * {_DOT.format(a="c", b="c")}) AS score FROM embeddings, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster) AS k FROM s) SELECT id, cluster, round(score, 6) AS score FROM r WHERE k = 1""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    cents = e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("c"))
    best, _new = texts.kmeans_step(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), cents)
    return best.withColumn("score", F.round("score", 6))


@query("duplicate_blobs", D + " SELECT sha256(text) AS blob, count(*) AS n, min(path) AS first FROM d GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return texts.duplicate_blobs(docs(spark, d))


_SH = (
    D
    + r""", w AS (SELECT path, regexp_extract_all(lower(text), '[^\s]+') AS l FROM d), s AS (SELECT path, list_distinct([array_to_string(l[i : i + 4], ' ') FOR i IN range(1, len(l) - 3)]) AS s FROM w WHERE len(l) >= 5),
    k AS (SELECT path, s, sha256(array_to_string(list_sort(s), '|')) AS key FROM s), n AS (SELECT key, min(path) AS class FROM k GROUP BY 1)"""
)


@query(
    "shingle_jaccard",
    _SH
    + """, c AS (SELECT class, unnest(s) AS g, len(s) AS m FROM k JOIN n ON n.key = k.key AND k.path = class),
    j AS (SELECT x.class AS a, y.class AS b, count(*) AS o, max(x.m) AS m1, max(y.m) AS m2 FROM c x JOIN c y ON x.g = y.g AND x.class < y.class GROUP BY 1, 2)
    SELECT a, b, round(o / (m1 + m2 - o), 6) AS jaccard FROM j WHERE o / (m1 + m2 - o) >= 0.8""",
)
def _(spark, d):
    return texts.similar_pairs(docs(spark, d))[0].withColumn("jaccard", F.round("jaccard", 6))


@query("shingle_classes", _SH + " SELECT path, class FROM k JOIN n USING (key)")
def _(spark, d):
    return texts.similar_pairs(docs(spark, d))[1]


@query("term_frequency", R + f", t AS (SELECT id, unnest({TOK}) AS term FROM r) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY 1")
def _(spark, d):
    return texts.term_frequency(turns(spark, d))


@query(
    "cooccurrence",
    R
    + f""", t AS (SELECT id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS i FROM r), c AS (SELECT term FROM t GROUP BY 1 HAVING count(DISTINCT id) >= 2)
    SELECT x.term, y.term AS context, count(*) AS n FROM t x JOIN t y ON x.id = y.id AND x.i <> y.i AND abs(x.i - y.i) <= 2 WHERE x.term IN (FROM c) AND y.term IN (FROM c) GROUP BY 1, 2""",
)
def _(spark, d):
    return texts.cooccurrence(turns(spark, d))


_TV = R + f""", t AS (SELECT id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS i FROM r), tf AS (SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY 1), c AS (SELECT term FROM tf WHERE df >= 2),
    co AS (SELECT x.term, y.term AS context, count(*) AS n FROM t x JOIN t y ON x.id = y.id AND x.term <> y.term AND abs(x.i - y.i) <= 2 WHERE x.term IN (FROM c) AND y.term IN (FROM c) GROUP BY 1, 2),
    st AS (SELECT *, sha256(context) AS h, row_number() OVER (PARTITION BY term ORDER BY n DESC, context) AS k FROM co QUALIFY k <= 40),
    tv AS (SELECT term, ({_HEX(7)} * 16 + {_HEX(8)}) % 64 AS idx, CAST(sum(n * CASE WHEN {_HEX(10)} % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS val FROM st GROUP BY 1, 2 HAVING sum(n * CASE WHEN {_HEX(10)} % 2 = 0 THEN 1 ELSE -1 END) <> 0)"""


@query("term_vectors", _TV + " SELECT term, string_agg(idx || ':' || val, ' ' ORDER BY idx) AS vector FROM tv GROUP BY 1")
def _(spark, d):
    places = F.filter(F.transform("v", lambda x, i: F.when(x != 0, F.concat(i.cast("string"), F.lit(":"), x.cast("string")))), lambda x: x.isNotNull())
    return wordvectors.term_vectors(turns(spark, d)).select(F.col("id").alias("term"), F.array_join(places, " ").alias("vector"))


@query(
    "term_neighbors",
    _TV
    + """, sq AS (SELECT term, sum(val * val) AS nn FROM tv GROUP BY 1), lead AS (SELECT term FROM tf ORDER BY n DESC, term LIMIT 12),
    dots AS (SELECT a.term, b.term AS neighbor, sum(a.val * b.val) AS dot FROM tv a JOIN tv b USING (idx) WHERE a.term IN (FROM lead) AND a.term <> b.term GROUP BY 1, 2),
    sc AS (SELECT x.term, y.term AS neighbor, CAST(coalesce(dot, 0) AS DOUBLE) / sqrt(CAST(x.nn AS DOUBLE) * CAST(y.nn AS DOUBLE)) AS score FROM sq x JOIN sq y ON x.term IN (FROM lead) AND x.term <> y.term LEFT JOIN dots ON dots.term = x.term AND dots.neighbor = y.term)
    SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY score DESC, neighbor) AS INTEGER) AS rank, neighbor, round(score, 6) AS score FROM sc QUALIFY rank <= 6""",
)
def _(spark, d):
    rows = turns(spark, d)
    return wordvectors.neighbors(wordvectors.term_vectors(rows), wordvectors.leading_terms(rows)).withColumn("score", F.round("score", 6))


@query("skipgram_neighbors")
def _(spark, d):
    rows = turns(spark, d)
    return wordvectors.neighbors(wordvectors.model_vectors(wordvectors.skipgram(rows)), wordvectors.leading_terms(rows)).withColumn("score", F.round("score", 6))


_FP = D + r""", tk AS (SELECT path, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][\p{L}\p{N}_]*|<=|>=|==|!=|&&|\|\||[(){}\[\];]|\p{L}'), lambda t: t NOT IN ('<=', '>=')),
      lambda t: CASE WHEN regexp_matches(t, '^[\p{L}_]') THEN substr(regexp_replace(lower(t), '\p{Nd}+$', ''), 1, 24) ELSE t END) AS t FROM d),
    fp AS (SELECT path, CASE WHEN len(t) < 8 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || '|' || t[i + 1] || '|' || t[i + 2]) END AS f FROM tk)"""


@query("structure_fingerprints", _FP + " SELECT path, len(f) AS n, substr(sha1(array_to_string(f, '|')), 1, 16) AS sha FROM fp")
def _(spark, d):
    return reticulation.fingerprints(docs(spark, d)).select("path", F.size("parts").cast("bigint").alias("n"), "sha")


@query("similar_structures")
def _(spark, d):
    """Pairs of document classes at .25 or more; nearly all of them, see the operator."""
    return reticulation.similar_structures(docs(spark, d))[0]


@query(
    "reticulation_edges",
    _FP
    + """, st AS (SELECT path, list_sort(list_distinct(f)) AS s FROM fp), na AS (SELECT s, min(path) AS class, min(split_part(path, '/', 1)) AS lo, max(split_part(path, '/', 1)) AS hi FROM st GROUP BY 1),
    x AS (SELECT class, lo, hi, len(s) AS m, unnest(s) AS g FROM na), j AS (SELECT a.class AS a, b.class AS b, count(*) AS o, max(a.m) AS m1, max(b.m) AS m2, min(least(a.lo, b.lo)) AS lo, max(greatest(a.hi, b.hi)) AS hi FROM x a JOIN x b ON a.g = b.g AND a.class < b.class GROUP BY 1, 2)
    SELECT a, b, round(o / (m1 + m2 - o), 6) AS similarity FROM j WHERE o / (m1 + m2 - o) >= 0.55 AND lo <> hi UNION ALL SELECT class, class, 1.0::DOUBLE FROM na WHERE lo <> hi""",
)
def _(spark, d):
    return reticulation.reticulation_edges(docs(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(
    "term_shift",
    R
    + f""", t AS (SELECT unnest({TOK}) AS term, turn < 2 AS early FROM r), n AS (SELECT count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS l FROM t),
    s AS (SELECT term, count(*) FILTER (early) / max(e) AS early, count(*) FILTER (NOT early) / max(l) AS late FROM t, n GROUP BY 1)
    SELECT term, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS shift FROM s WHERE abs(late - early) >= 0.002""",
)
def _(spark, d):
    from tidemark.operators.series import presence_shift

    terms = turns(spark, d).select(F.explode(T.tokenize(F.col("text"))).alias("term"), (F.col("turn") < 2).alias("early"))
    return presence_shift(terms).withColumns({c: F.round(c, 6) for c in ("early", "late", "shift")})


# Chunks of lines: from a first line on to the first one that may end it, and on from the last lines that make 80 letters.
_CHUNKS = r""", ln AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text <> ''),
    li AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) AS p, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR regexp_matches(line, '^\s*(def |class |function |export |pub )') AS stop FROM ln),
    ba AS (SELECT a.path, a.i, a.line, a.stop, a.p, a.p - length(a.line) - 1 AS before, (SELECT max(b.i) FROM li b WHERE b.path = a.path AND b.i <= a.i AND a.p - (b.p - length(b.line) - 1) >= 80) AS back FROM li a),
    steps AS (SELECT path, 1 AS i, 1 AS first, 0::HUGEINT AS base, p, stop, back, p >= 700 AND (p >= 980 OR stop) AS ends FROM ba WHERE i = 1
      UNION ALL SELECT n.path, n.i, x.first, f.before, n.p, n.stop, n.back, n.p - f.before >= 700 AND (n.p - f.before >= 980 OR n.stop)
      FROM (SELECT path, i, CASE WHEN ends THEN greatest(first, coalesce(back, first)) ELSE first END AS first FROM steps) x JOIN ba n ON n.path = x.path AND n.i = x.i + 1 JOIN ba f ON f.path = x.path AND f.i = x.first),
    spans AS (SELECT path, first, i AS last, false AS rest FROM steps WHERE ends UNION ALL
      SELECT path, CASE WHEN ends THEN greatest(first, coalesce(back, first)) ELSE first END, i, true FROM steps s WHERE i = (SELECT max(i) FROM li WHERE li.path = s.path)),
    bodies AS (SELECT s.path, s.first, s.last, s.rest, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM spans s JOIN ln ON ln.path = s.path AND i BETWEEN s.first AND s.last GROUP BY 1, 2, 3, 4),
    nu AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rest, last) - 1 AS ix FROM bodies WHERE body <> ''),
    ch AS (SELECT path || ':' || ix || ':' || substr(sha1(path || ':' || ix || ':' || substr(body, 1, 80)), 1, 12) AS id, path, ix AS index, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, 'FILE ' || path || ' L' || first || '-' || last || chr(10) || body AS text FROM nu)"""
_NEAR = """, sq AS (SELECT id, sum(val * val) AS nn FROM e GROUP BY 1),
    dots AS (SELECT a.id AS query_id, b.id, sum(a.val * b.val) AS dot FROM e a JOIN e b USING (idx) WHERE a.id IN (SELECT id FROM qs) AND b.id IN (SELECT id FROM ch) GROUP BY 1, 2),
    cos AS (SELECT query_id, dots.id, CAST(dot AS DOUBLE) / sqrt(CAST(x.nn AS DOUBLE) * CAST(y.nn AS DOUBLE)) AS score FROM dots JOIN sq x ON x.id = query_id JOIN sq y ON y.id = dots.id),
    zero AS (SELECT x.id AS query_id, y.id, 0.0::DOUBLE AS score FROM sq x JOIN sq y ON x.id IN (SELECT id FROM qs) AND y.id IN (SELECT id FROM ch) WHERE NOT EXISTS (FROM dots WHERE query_id = x.id AND dots.id = y.id)),
    ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM (FROM cos UNION ALL FROM zero))"""


@query("line_chunks", D.replace("WITH", "WITH RECURSIVE") + _CHUNKS + " SELECT id, path, index, first, last, sha256(text) AS sha FROM ch")
def _(spark, d):
    return retrieval.line_chunks(docs(spark, d)).select("id", "path", "index", "first", "last", F.sha2("text", 256).alias("sha"))


@query(
    "retrieve_chunks",
    D.replace("WITH", "WITH RECURSIVE")
    + _CHUNKS
    + ", qs AS (SELECT 'q' || item_id AS id, text FROM benchmark), r AS (SELECT id, text FROM ch UNION ALL SELECT id, text FROM qs)"
    + _EMB
    + _NEAR
    + " SELECT query_id, CAST(k AS INTEGER) AS rank, ra.id, path, first, last, round(score, 6) AS score FROM ra JOIN ch ON ch.id = ra.id WHERE k <= 5",
)
def _(spark, d):
    """Chunks of documents most similar to each benchmark passage."""
    q = table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text")
    return retrieval.retrieve(retrieval.line_chunks(docs(spark, d)), q, 5).withColumn("score", F.round("score", 6))


@query(
    "clade_evidence",
    D.replace("WITH", "WITH RECURSIVE")
    + _CHUNKS
    + """, own AS (SELECT source || '/' || doc_id AS path, source || '-' || coalesce(lang, 'none') AS clade FROM documents),
    fi AS (SELECT *, row_number() OVER (PARTITION BY clade ORDER BY path) AS i FROM own),
    qs AS (SELECT clade AS id, 'taxonomy role for clade ' || clade || ' labeled ' || clade || ' type ' || max(split_part(path, '/', 1)) || ' layer  files ' || string_agg(path, ' ' ORDER BY path) FILTER (i <= 12) AS text FROM fi GROUP BY clade),
    r AS (SELECT id, text FROM ch UNION ALL SELECT id, text FROM qs)"""
    + _EMB
    + _NEAR
    + """, soft AS (SELECT query_id, ch.id, ch.path, first, last, CASE WHEN own.path IS NULL THEN score * 0.55::DOUBLE ELSE score END AS score
      FROM ra JOIN ch ON ch.id = ra.id LEFT JOIN own ON own.path = ch.path AND own.clade = query_id WHERE k <= 24)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, path, first, last, round(score, 6) AS score FROM soft QUALIFY rank <= 6""",
)
def _(spark, d):
    """Chunks that bear out each clade of documents, one clade per source and language."""
    clade = F.concat("source", F.lit("-"), F.coalesce("lang", F.lit("none")))
    own = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), clade.alias("clade"), "source")
    clades = own.groupBy("clade").agg(F.max("source").alias("code_type")).withColumns({"label": F.lit(None).cast("string"), "layer": F.lit(None).cast("string")})
    return retrieval.clade_evidence(retrieval.line_chunks(docs(spark, d)), clades, own).withColumn("score", F.round("score", 6))


@query(
    "structure_counts",
    r"""WITH d AS (SELECT doc_id % 4 AS win, text FROM documents), c AS (SELECT win, 'and' AS node, CAST(sum(len(regexp_extract_all(text, '\band\b'))) AS BIGINT) AS n FROM d GROUP BY 1
      UNION ALL SELECT win, 'number', CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) FROM d GROUP BY 1) SELECT *, n - lag(n) OVER (PARTITION BY node ORDER BY win) AS delta FROM c""",
)
def _(spark, d):
    return texts.structure_counts(table(spark, d, "documents").select((F.col("doc_id") % 4).alias("win"), "text"), {"and": r"\band\b", "number": "[0-9]+"})


def _ontology_sql() -> tuple[str, str]:
    from tidemark.operators.ontology import HINTS, ONTOLOGY, ontology_rows

    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    nodes = ", ".join(f"({i}, {quote(at)}, {quote(words)})" for i, at, words in ontology_rows(ONTOLOGY))
    hints = ", ".join(f"('{k}', {quote(v)})" for k, v in HINTS.items())
    return f"(VALUES {nodes}) o(i, at_, words)", f"(VALUES {hints}) h(ending, hint)"


_NODES, _HINTS = _ontology_sql()
_TYPES = rf""", w AS (SELECT path, list_distinct(list_concat(list_filter(list_concat(regexp_split_to_array(lower(path), '[^a-z0-9]+'), regexp_split_to_array(lower(regexp_replace(path, '([a-z0-9])([A-Z])', ' ', 'g')), '[^a-z0-9]+')),
        lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$')), coalesce(hint, []))) AS t,
      list_filter(regexp_split_to_array(lower(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS f
      FROM pa LEFT JOIN {_HINTS} ON ending = CASE WHEN contains(split_part(path, '/', -1), '.') THEN lower(split_part(split_part(path, '/', -1), '.', -1)) END),
    m AS (SELECT path, i, at_, list_filter(words, lambda x: list_contains(t, x)) AS ex, list_filter(words, lambda x: length(x) >= 4 AND len(list_filter(t, lambda y: contains(y, x))) > 0) AS ins FROM w, {_NODES}),
    r AS (SELECT path, i, at_, len(at_) AS depth, at_[1] AS a, at_[2] AS b, CASE WHEN len(ex) > 0 THEN ex ELSE ins END AS ws, CASE WHEN len(ex) > 0 THEN 1.0::DOUBLE + 0.35::DOUBLE * (len(ex) - 1) ELSE 0.45::DOUBLE + 0.1::DOUBLE * (len(ins) - 1) END AS s FROM m WHERE len(ex) + len(ins) > 0),
    ba AS (SELECT l.path, l.i, l.at_, l.a, l.b, l.s + coalesce(0.35::DOUBLE * k.s, 0) AS s, list_distinct(list_concat(coalesce(k.ws, []), l.ws)) AS ws FROM r l LEFT JOIN r k ON k.path = l.path AND k.depth = 2 AND k.a = l.a AND k.b = l.b WHERE l.depth = 3
      UNION ALL SELECT path, i, at_, a, b, s, ws FROM r WHERE depth = 2 AND NOT EXISTS (FROM r x WHERE x.path = r.path AND x.depth = 3 AND x.a = r.a AND x.b = r.b)),
    la AS (SELECT *, row_number() OVER (PARTITION BY path, a, b ORDER BY i DESC) AS k FROM ba),
    en AS (SELECT la.path, la.i, la.at_, la.s + CASE WHEN k = 1 THEN coalesce(0.35::DOUBLE * ro.s, 0) ELSE 0 END AS s, CASE WHEN k = 1 THEN list_distinct(list_concat(coalesce(ro.ws, []), la.ws)) ELSE la.ws END AS ws FROM la LEFT JOIN r ro ON ro.path = la.path AND ro.depth = 1 AND ro.a = la.a
      UNION ALL SELECT path, i, at_, s, ws FROM r WHERE depth = 1 AND NOT EXISTS (FROM ba x WHERE x.path = r.path AND x.a = r.a)),
    sc AS (SELECT en.path, i, at_, round(s + 0.85::DOUBLE * len(list_filter(ws, lambda x: list_contains(f, x))) + 0.55::DOUBLE * len(list_filter(at_, lambda x: list_contains(f, x))), 9) AS s FROM en JOIN w ON w.path = en.path),
    be AS (SELECT *, least(0.98, s / (s + 1.8::DOUBLE)) AS conf FROM sc QUALIFY row_number() OVER (PARTITION BY path ORDER BY s DESC, len(at_) DESC, i) = 1),
    ty AS (SELECT pa.path, coalesce(at_, ['unknown']) AS type_path, CASE WHEN at_ IS NULL THEN 0.15::DOUBLE ELSE round(CASE WHEN len(at_) >= 3 THEN least(0.99, conf + 0.08::DOUBLE) ELSE conf END, 3)::DOUBLE END AS confidence FROM pa LEFT JOIN be ON be.path = pa.path)"""
_MADE = ["src/api/routes/users.py", "src/data/models/user.py", "web/ui/components/UserCard.tsx", "tests/unit/test_users.py", "docs/ARCHITECTURE.md", "scripts/build.sh", "infra/deploy/helm/values.yaml", "src/utils/parse_json.py", "x"]


@query(
    "path_types",
    f"""WITH pa AS (SELECT DISTINCT path FROM (SELECT 'src/' || regexp_extract(url, '^[a-z]+://(.*)$', 1) AS path FROM pages UNION ALL
      SELECT 'repo' || page_id % 50 || '/' || unnest([{", ".join(f"'{m}'" for m in _MADE)}]) FROM pages))"""
    + _TYPES
    + """ SELECT path, array_to_string(type_path, '/') AS type_key, confidence, CASE WHEN confidence >= 0.42 AND type_path[1] <> 'unknown'
      THEN 'type:' || array_to_string(type_path[1:CASE WHEN confidence >= 0.55 THEN 3 ELSE 2 END], '/') || '|' ELSE '' END || 'dir:' || split_part(path, '/', 1) AS seed FROM ty""",
)
def _(spark, d):
    from tidemark.operators.ontology import breakout_seed, path_types

    pages = table(spark, d, "pages")
    made = pages.select(F.explode(F.array(*[F.concat(F.lit("repo"), (F.col("page_id") % 50).cast("string"), F.lit("/" + m)) for m in _MADE])).alias("path"))
    paths = pages.select(F.concat(F.lit("src/"), F.regexp_extract("url", r"^[a-z]+://(.*)$", 1)).alias("path")).unionByName(made)
    out = path_types(paths)
    return out.select("path", F.array_join("type_path", "/").alias("type_key"), "confidence", breakout_seed(F.col("path"), F.col("type_path"), F.col("confidence")).alias("seed"))
