import random
import time
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm.html_extract import Tree, Weights, blocks_of, extract_main_text, main_text, marginals, trained
from tidemark.llm.language_id import Parser, identify_language, learn, normal, pack, suffix_automaton
from tidemark.llm.queries import QUERIES
from tidemark.llm.toxicity import REJECT, drop_toxic, fit_ordinal, grade_toxicity, limit_of, train

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    n, parents = 8, [-1, 0, 0, 1, 1, 2, 5, 5]
    kinds = [f"k{i % 3}" for i in range(n)]
    weights = Weights({f"f{i}": float(rng.normal()) for i in range(n)}, {k: tuple(map(tuple, rng.normal(size=(2, 2)).tolist())) for k in set(kinds)})
    total, content = 0.0, np.zeros(n)
    for bits in range(2**n):
        s = [bits >> i & 1 for i in range(n)]
        p = np.exp(sum(weights.own[f"f{i}"] * s[i] for i in range(n)) + sum(weights.pair[kinds[i]][s[parents[i]]][s[i]] for i in range(1, n)))
        total += p
        content += p * np.array(s)
    got, edges = marginals(Tree(parents, [[f"f{i}"] for i in range(n)], kinds, [0] * n), weights)
    assert np.allclose(got, content / total)
    assert all(np.isclose(e[1] + e[3], got[i]) for i, e in enumerate(edges) if i)


def article(page):
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner.replace("<br>", " "))
    import html

    lines = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_articles_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(pages)
    assert sum(r["text"] == article(pages[r["page_id"]]) for r in got) >= 0.99 * len(got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_pages_of_other_make_up():
    body = "The council met on Monday evening and agreed on the plan for the old harbour, after three hours of talk."
    page = f"""<html><body><div id="cookie-bar">We use cookies for everything we do here.</div><header><a href=/>Town News</a><nav><ul><li><a href=/a>All</a></ul></nav></header>
      <main><h1>Harbour plan</h1><p>{body}<p>It starts in spring &amp; ends in   autumn.<script>x="<p>no</p>"</script></p><!-- <p>hidden</p> --></main>
      <section class="comments"><div class="comment"><p>I do not like this plan at all, said a reader.</p></div></section>
      <aside class="sidebar"><a href=/x>Read more about the harbour</a></aside><form><p>Subscribe here now</p><input></form><footer>&copy; Town News</footer>"""
    text = main_text(page, trained())
    assert text == f"Harbour plan\n{body}\nIt starts in spring & ends in autumn."


def test_odd_markup(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<" * 5, "x"), (4, "u", "<div>" * 3000 + "deep", "x"), (5, "u", "<p title='a>b\">x", "x"), (6, "u", "<article><p>" + "word " * 100_000, "x")]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert len(got) == 6 and got[1]["text"] == got[2]["text"] == "" and len(got[6]["text"]) == 499_999
    assert blocks_of("a<td>b<td>c")[3] == [(0, "a"), (1, "b"), (2, "c")]
    assert extract_main_text(spark.createDataFrame(rows[:1], "page_id bigint, url string, html string, text string").limit(0)).count() == 0


def longest_phrases(text, sample):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("lane", [512, 7, 3])
def test_phrases_equal_a_plain_parse(monkeypatch, lane):
    monkeypatch.setattr("tidemark.llm.language_id.LANE", lane)
    rng = np.random.default_rng(lane)
    samples = (("aa", "banana bandana cabana" * 3), ("bb", "the quick brown fox that thinks"), ("cc", "日本語の文字 と 言葉"))
    parser = Parser(samples)
    texts = ["banana", "the bandana", "zz", "thhthh ananan", "xyz ban", "", "日本語 zz 言", "banana" * 40]
    texts += [samples[1][1] + " " + samples[1][1] * 3 + w + samples[0][1] * 2 for w in ("x", " fox", "日")]  # phrases over several lanes, more than once
    texts += ["".join(rng.choice(list("banac theq日"), rng.integers(1, 90))) for _ in range(60)]
    assert parser.phrases(texts).tolist() == [[longest_phrases(t, s) for _, s in samples] for t in texts]


def test_packed_automata_keep_every_transition():
    for text in ("banana", "".join(chr(200 + i * 7 % 900) for i in range(3000)) * 2, "a"):
        letters = sorted(set(text))
        rows = suffix_automaton([letters.index(c) for c in text])
        p = pack(rows, len(letters) + 1)
        for s, row in enumerate(rows):
            for c in range(len(letters) + 1):
                at = p.base[s] + c
                assert (int(p.goal[at]) if p.owner[at] == s else None) == row.get(c)


def test_words_are_letters_with_their_marks():
    assert normal("½ ²") == "" and normal("Größe 3²") == " größe " and normal("हिन्दी") == " हिन्दी "


def test_query_against_a_plain_version(spark):
    """Rows of the query from the learned samples alone, one letter after the other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parser = learn(docs)
    assert len(parser.languages) > 2 and len(parser.samples) == len(parser.languages)
    texts = {r["doc_id"]: normal(r["text"]) for r in docs.select("doc_id", "text").collect()}
    seen = 0
    for r in QUERIES["op10_language"](spark, "/root/testdata/sf0.001").collect():
        t = texts[r["doc_id"]]
        if not t or len(t) > 2500:
            continue
        bits = np.array([longest_phrases(t, s) * np.log2(len(s)) / len(t) for _, s in parser.samples])
        assert r["lang_pred"] == parser.languages[int(bits.argmin())]
        assert abs(r["score"] - 1 / np.exp(-parser.sharpness * (bits - bits.min())).sum()) < 1e-9
        seen += 1
    assert seen > 100


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = identify_language(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(got) == len(lang)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en", 1), (2, "der Hund und die Katze sind im Haus", "de", 1), (3, None, "en", 1), (4, "1234 !?", "en", 1), (None, "the cat", None, 1), (6, "日本語" * 9000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {r["doc_id"]: r for r in identify_language(docs).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[None]["held_out"] and got[6]["lang_pred"] in ("en", "de", "und")
    assert identify_language(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify_language(docs.filter("lang is null")).collect()} == {"und"}


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 600)
    x = [[(0, float(g) + rng.normal() * 0.2), (1, float(rng.normal()))] for g in y]
    w, theta = fit_ordinal(x, y, 2)
    assert w[0] > 5 * abs(w[1]) and (np.diff(theta) > 0).all()
    s = np.array([v[0][1] for v in x]) * w[0]
    assert np.mean((s[:, None] > theta).sum(axis=1) == y) > 0.9


def test_toxic_documents_of_a_split(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grades = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in grade_toxicity(docs, labels.filter("doc_id % 2 = 0")).collect() if r["doc_id"] in grades and r["doc_id"] % 2}
    caught = np.mean([got[i]["rejected"] for i in got if grades[i]])
    wrong = np.mean([got[i]["rejected"] for i in got if not grades[i]])
    assert caught > 0.85 and wrong < 0.01
    assert np.mean([got[i]["severity"] for i in got if grades[i]]) > 10 * np.mean([got[i]["severity"] for i in got if not grades[i]])


def test_toxicity_odd_rows(spark):
    rows = [(i, "idiot words here now" if i % 2 else "nice words here now", 1) for i in range(40)] + [(None, None, 1), (41, "", 1), (1, "idiot", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, severity int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (50, 1, None)], "doc_id bigint, quality int, toxic int")
    got = grade_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["rejected"]} == {i for i in range(40) if i % 2}
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == 22
    assert all(r["severity"] == 0 for r in got if r["doc_id"] in (None, 41))
    assert not any(r["rejected"] for r in grade_toxicity(docs, labels.filter("toxic = 0")).collect())
    assert grade_toxicity(docs.limit(0), labels).count() == 0


def test_pages_with_a_head_or_svg_left_open():
    words = "The council met on Monday evening and agreed on the plan for the old harbour, after three hours of talk."
    article = f"<article><h1>Harbour plan</h1><p>{words}</p></article>"
    want = f"Harbour plan\n{words}"
    for page in (f"<html><head><title>x</title><meta charset=utf-8><body>{article}", f"<head><title>x</title>{article}", f"<head><noscript><body>{article}", f"<body><svg><path d='x'>{article}"):
        assert main_text(page, trained()) == want, page
    assert main_text(f"<html><head><title>x</title><noscript><img src=a></noscript></head><body>{article}", trained()) == want
    assert "n" in main_text(f"<article><h1>Harbour plan</h1><p>{words} <math><mi>n</mi></math></p></article>", trained()).split()
    assert [t for _, t in blocks_of("<head><title>t</title>Some text")[3]] == ["Some text"]


def test_severity_against_a_plain_version(spark):
    """The whole query's rows from the trained weights, word by word."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    assert len(model.weights) > 5 and list(model.thresholds) == sorted(model.thresholds)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in grade_toxicity(docs, labels).collect():
        words, counts = re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()), {}
        for w in words:
            for f in [w] + ["^" + w[:5]] * (len(w) > 5) + ["^" + w[:4]] * (len(w) > 4):
                counts[f] = counts.get(f, 0) + 1
        s = sum(model.weights.get(f, 0.0) * (1 + 0.5 * np.log(n)) for f, n in counts.items())
        want = [1 / (1 + np.exp(t - s)) if words else 0.0 for t in model.thresholds]
        assert abs(r["severity"] - sum(want)) < 1e-6 and r["rejected"] == (want[0] >= model.reject)


def test_limit_is_set_on_held_out_labels():
    assert limit_of(np.array([]), np.array([0.1])) == REJECT
    assert limit_of(np.array([0.12, 0.9]), np.array([0.01, 0.02])) == 0.1
    assert limit_of(np.array([0.12] + [0.9] * 99), np.array([0.3, 0.01])) == 0.35


@pytest.mark.parametrize("few", [0, 64])
def test_long_texts_that_repeat_a_sample_are_parsed_whole_and_soon(monkeypatch, few):
    monkeypatch.setattr("tidemark.llm.language_id.FEW", few)
    rng = random.Random(1)
    words = lambda n, letters: " " + " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n)) + " "
    samples = [words(3000, "abcdefghijklm"), words(3000, "hijklmnopqrst")]
    transitions = [suffix_automaton(list(s)) for s in samples]

    def plain(text, nxt):
        phrases = state = 0
        for c in text:
            if not state or c not in nxt[state]:
                phrases, state = phrases + 1, nxt[0].get(c, 0)
            else:
                state = nxt[state][c]
        return phrases

    texts = [(samples[0] * 200)[: 1_000_000 if few else 60_000], (samples[0][:9000] + "é" + samples[1]) * 3, samples[0][777:] + samples[0][3:9000], words(30_000, "abcdefghijklmnopqrst"), "x" * 5000, " a "]
    began = time.process_time()
    got = Parser(tuple(zip("ab", samples, strict=True))).phrases(texts)
    assert not few or time.process_time() - began < 8
    assert got.tolist() == [[plain(t, n) for n in transitions] for t in texts]
