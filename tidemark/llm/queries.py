"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the package that holds them is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk_search import exact_top_k

    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows.filter(F.col("vec_id") % 20 == 0), rows, k=20, scale=64)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.piece_encoding import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), length=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import grade_toxicity

    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, every=199, ratio=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_packing": op3_packing,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_token_files": op11_token_files,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op2_exact_topk": """
        WITH q8 AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
                    FROM embeddings
                    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (SELECT a.vec_id AS query_id, b.vec_id,
                          CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS BIGINT) AS score
                   FROM q8 a JOIN q8 b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20""",
    "op5_substring_dedup": r"""
        WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM lists),
        win AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead AS n FROM w
                WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        marked AS (SELECT doc_id, pos, word,
                          n = 20 AND row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1 AS later FROM win),
        gone AS (SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos
                        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g FROM marked),
        sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (g) AS n_removed,
                        string_agg(word, ' ' ORDER BY pos) FILTER (NOT g) AS kept FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM (SELECT doc_id FROM documents) LEFT JOIN sums USING (doc_id)""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                                 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        runs AS (SELECT doc_id, r, count(*) AS n
                 FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
                                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents)
                 GROUP BY doc_id, r),
        bytes AS (SELECT r, n, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END
                                        FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || r, '')]) AS b FROM runs),
        hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, [CAST(x AS BIGINT) FOR x IN b]),
                                    lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
                  FROM (SELECT CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM hashed)
                  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        less AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                 UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
                 UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
        best AS (SELECT near.word, count(*) AS n_near, min({'m': -words.n, 'w': other}) AS b
                 FROM near JOIN words ON words.word = other GROUP BY near.word),
        forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.w END AS form,
                         CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n FROM words LEFT JOIN best USING (word)),
        ways AS (SELECT word, word AS root FROM forms
                 UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL)
        SELECT forms.word, forms.form, ways.root, forms.n, forms.n_near, forms.form_n
        FROM forms JOIN ways USING (word) JOIN forms last ON last.word = ways.root AND last.form IS NULL""",
}
