"""Pages, personal data, language, quality, scoring, tokens and URLs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from partloom.llm import bpe, common, html, langid, lstm, neardup, pii, pst, quality, queries, urls

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 60_000), (5, "é漢字 ﷺ \u00a0 x"), (6, "same"), (6, "same"), (None, "no id here")]


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>ad</p> --><div class="ad">Buy now.</div>
<article><h1>Title &amp; more</h1><p>First   para<br>graph &eacute;.<p>Second <b>bold</b> one.</p><div class="cookie-notice">We use cookies</div>
<section class="comments"><p>A reader wrote this.</p></section></article><footer>&copy; us</footer></body></html>"""


def test_page(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<div><!-- open"), (None, "u", PAGE), (1, "u", PAGE)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))).collect()
    texts = [r.text for r in got]
    assert texts[0] == "Title & more\n\nFirst para graph é.\n\nSecond bold one." and texts[1:4] == ["", "", ""] and texts[4] == texts[5] == texts[0]
    assert html.main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_leaves_of_odd_markup():
    assert [b.text for b in html.leaves("a<p>b<p>c</b></i><b>d")] == ["a", "b", "cd"]
    assert [b.text for b in html.leaves("x < y &lt; z <img alt='>'> w")] == ["x < y < z w"]
    assert html.leaves("<script>a") == [] and [b.text for b in html.leaves("<div" * 50_000)] == []
    assert len(html.leaves("<div>" * 20_000 + "t" + "</div>" * 20_000)) == 1
    assert [b.text for b in html.leaves("<p>a</p><svg/><p>b</p><iframe /><p>c</p><math/><p>d</p>")] == ["a", "b", "c", "d"]
    assert [b.text for b in html.leaves("<div><p>a</p><svg><text>x</text></div><p>b</p><noscript>n<p>c</p><svg></svg>")] == ["a", "b", "n", "c"]
    assert [b.text for b in html.leaves("<div><p>a</p><template><p>t</p></div><p>b <svg><title>q</title></svg>c</p><select><option>1</div><p>d")] == ["a", "t", "b c", "1", "d"]
    assert [b.text for b in html.leaves("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><xmp><b></xmp>")] == ["so x=2 holds", "<b>"]
    assert [b.text for b in html.leaves("a<textarea>b<p>c")] == ["a", "b", "c"]


def test_paths_hold_all_open_elements():
    deep = html.leaves("<nav class='menu'>" + "<div id=a>" * 40 + "<section>" * 3 + "t<p>u" + "</div>" * 9 + "v")
    assert [len(deep.path(b)) for b in deep] == [44, 45, 32] and deep.path(deep[2])[0] == "nav nav.menu .menu"
    other = html.leaves("x<p class='q r'>y")
    table = np.random.default_rng(1).normal(size=(html.PATH_SLOTS, 3))
    pages = [html.Read(deep), html.Read(other)]
    plain = [table[list({s for label in page.path(b) for s in html._paths[label]} or {0})].sum(0) * html.PATH_SCALE for page in (deep, other) for b in page]
    assert np.allclose(html._path_sums(pages, table), plain, atol=1e-5)
    assert [len(x) for x in pages[0].path_slots()] == [3 + 3 + 1, 3 + 3 + 2, 3 + 3]
    very = html.Read(html.leaves("<div>" * 100_000 + "t" + "</div>t" * 100_000))
    assert html._path_sums([very], table).shape == (100_001, 3)


def test_main_text_is_that_of_the_article_blocks(spark):
    """On the given pages the article's blocks, read by plain splitting, are the text; repeats and order kept."""
    for r in queries.op3_main_text(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article[^>]*>(.*)</article>", r.html, re.S)
        inside = re.sub(r"<(section|div|aside|nav|form)\b[^>]*(?:comment|share|related|advert|ad-|promo|newsletter)[^>]*>.*?</\1>|<(aside|nav|form|footer|header|script|style)\b.*?</\2>", "<p>", inside[1], flags=re.S)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|li|ul|ol|div|section|blockquote|pre|article|table|tr|td|br)\b[^>]*>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_neutral_wrappers_lose_no_article(spark):
    """Up to 200 elements that say nothing, around the article, in it, and around its paragraphs; and a page of 5 MB."""
    title, one, two = "The title of it", "First paragraph says something about the matter at hand, in full.", "Second paragraph goes on and on about the same matter."
    body, rows = f"<h1>{title}</h1><p>{one}</p><p>{two}</p>", []
    for n in (0, 1, 2, 3, 4, 5, 8, 12, 20, 50, 200):
        for open_ in ("<div>" * n, "<div class='wrap'>" * n, "".join(f"<div class='{c}'>" for c in ("site wrap row col inner-box grid xyz area".split() * n)[:n])):
            end = "</div>" * n
            rows.append(f"<body>{open_}<article>{body}</article>{end}</body>")
            rows.append(f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article>{open_}{body}{end}</article><footer>&copy; us</footer></body>")
            rows.append(f"<body><article><h1>{title}</h1>{open_}<p>{one}</p><p>{two}</p>{end}</article></body>")
    long = "<body><div><nav class=menu><a href=x>Home</a></nav><article><div class=row>" + f"<p>{one}</p>" * 75_000 + "</div></article></div></body>"
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate([*rows, long])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert all(got[i] == f"{title}\n\n{one}\n\n{two}" for i in range(len(rows)))
    assert got[len(rows)] == "\n\n".join([one] * 75_000)


def test_labeller_on_pages_it_has_not_seen():
    p, rng = html.trained(), np.random.default_rng(77)
    right = total = 0
    for _ in range(150):
        page, marks = html.example(rng)
        blocks = html.leaves(page)
        if blocks and len(blocks) == len(marks):
            z = html._run(p, [html._vectors(p, [html.Read(blocks)])])[0][:, 0] > 0
            right, total = right + int((z == np.array(marks)).sum()), total + len(marks)
    assert right / total > 0.98


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lstm.init(rng, 3, 4).items()}
    x, mask = rng.normal(size=(5, 2, 16)), np.ones((5, 2))
    mask[3:, 1] = 0

    def loss(q):
        return float((lstm.forward(q, x, mask)[0] ** 2).sum())

    out, held = lstm.forward(p, x, mask, keep=True)
    grads, _ = lstm.backward(p, held, 2 * out)
    for i, j in ((0, 0), (2, 7), (3, 15)):
        q = {k: v.copy() for k, v in p.items()}
        q["h"][i, j] += 1e-3
        r = {k: v.copy() for k, v in p.items()}
        r["h"][i, j] -= 1e-3
        assert abs((loss(q) - loss(r)) / 2e-3 - grads["h"][i, j]) < 2e-2


# ---- personal data ----


def plain_spans(t):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m.group())
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_patterns():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab.@1 2-+()3%4") for _ in range(80)) for _ in range(5000)] + ["1" * 50_000, "a" * 50_000 + "@b", "@" * 1000, "1." * 2000]
    for t in texts[:-4]:
        assert plain_spans(t) == pii.base_spans(t)
    for t in texts[-4:]:
        pii.base_spans(t)  # long runs stay fast


def test_personal_data(docs_of):
    rows = [*ODD, (9, "write to bob.smith (at) example (dot) org or a@b.co, ring (555) 123-4567 or +1 (234) 555-0101 now"), (10, "word " * 30_000 + "x@y.org")]
    got = {r.doc_id: r for r in pii.detect(docs_of(rows, "pii_spans")).withColumn("masked", pii.masked(F.col("text"), F.col("pii_spans"))).collect()}
    spans = [(s.kind, rows[8][1][s.start : s.end], s.base) for s in got[9].pii_spans]
    assert ("email", "a@b.co", True) in spans and ("phone", "+1 (234) 555-0101", True) in spans
    assert {s[1] for s in spans if not s[2]} == {"bob.smith (at) example (dot) org", "(555) 123-4567"}
    assert "@" not in got[9].masked and got[9].masked.count("<EMAIL>") == 2
    assert [(s.start, s.end) for s in got[10].pii_spans] == [(150_000, 150_007)]
    assert got[1].pii_spans == [] and got[1].masked is None and got[5].masked == ODD[4][1]


def test_network_on_texts_it_has_not_seen():
    made = pii.examples(np.random.default_rng(123), 150)
    got = pii.find([t for t, _ in made], pii.trained())
    true, found = [set(s) for _, s in made], [{(s["kind"], s["start"], s["end"]) for s in g} for g in got]
    hit = sum(len(a & b) for a, b in zip(true, found))
    assert hit / sum(map(len, true)) > 0.9 and hit / sum(map(len, found)) > 0.9


def test_personal_data_query_holds_the_plain_spans(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        listed = [f"{kind}:{start}:{end}" for kind, start, end in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(",")))


# ---- language, quality ----


def test_language(spark, docs_of):
    got = queries.op5_language_id(spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of([*ODD, (7, "le chien"), (8, "THE dogs"), (9, "12 ½ ²!")], "score"), model).collect()}
    assert rows[7][0] == "fr" and rows[8][0] == "en"
    assert all(rows[k] == ("und", 0.0) for k in (1, 2, 3, 9)) and rows[5][0] in ("en", "fr")
    empty = langid.fit(train.filter("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(docs_of([(1, "the")]), empty).collect()} == {"und"}


def test_quality(spark):
    got = {r.doc_id: r for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    right = [got[d].kept == (q == 1) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, None if i == 1 else "h", "p") for i, t in ODD], "doc_id long, text string, host string, path string").withColumn("kept", F.lit("old"))
    labels = spark.createDataFrame([(6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels, F.col("host"), F.col("path")).collect()
    assert len(rows) == len(ODD) and all(r.kept is True and r.quality_p == 0.5 for r in rows)  # no labels: kept
    assert quality.classify(docs.limit(0), labels, F.col("host"), F.col("path")).count() == 0


def test_quality_of_labels_that_were_held_out(spark):
    """Fitted without every third label, the classifier and the sites give these labels again."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels.filter("doc_id % 3 <> 0"), F.col("source"), F.col("lang")).select("doc_id", "kept").collect()}
    held = [(got[r.doc_id], r.quality == 1) for r in labels.filter("doc_id % 3 = 0").collect()]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95


def test_sites_shrink_toward_their_parents(spark):
    rows = [("a", "x", 0.9)] * 50 + [("a", "y", 0.1)] + [("b", "z", 0.2)] * 50
    got = {(r.host, r.path): r.site_p for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert 0.8 < got["a", "x"] <= 0.9 and 0.1 < got["a", "y"] < got["a", "x"] and 0.2 <= got["b", "z"] < 0.3


def test_site_posteriors_follow_plain_sums(spark):
    rnd = random.Random(6)
    rows = [(h, p, min(1.0, max(0.0, rnd.gauss(0.3 + 0.1 * "abcd".index(h), 0.2)))) for h, p in ((rnd.choice("abcd"), rnd.choice("xyz")) for _ in range(400))] + [("e", "x", 0.5)]
    paths, hosts = {}, {}
    for h, p, v in rows:
        paths.setdefault((h, p), []).append(v)
        hosts.setdefault(h, []).append(v)
    n, rate = len(rows), sum(v for *_, v in rows) / len(rows)
    mean = lambda x: sum(x) / len(x)
    m_h = quality.strength(rate * (1 - rate), sum(len(x) * mean(x) ** 2 for x in hosts.values()) / n - rate**2, rate * (1 - rate) * (len(hosts) - 1) / n)
    var = {h: mean(x) * (1 - mean(x)) for h, x in hosts.items()}
    between = sum(len(x) * mean(x) ** 2 for x in paths.values()) - sum(len(x) * mean(x) ** 2 for x in hosts.values())
    m_p = quality.strength(sum(len(x) * var[h] for h, x in hosts.items()) / n, between / n, sum(var[h] * (sum(k[0] == h for k in paths) - 1) for h in hosts) / n)
    host_p = {h: (sum(x) + m_h * rate) / (len(x) + m_h) for h, x in hosts.items()}
    got = {(r.host, r.path): r.site_p for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert set(got) == set(paths) and all(abs(got[k] - (sum(x) + m_p * host_p[k[0]]) / (len(x) + m_p)) < 1e-9 for k, x in paths.items())


# ---- scoring ----


def test_scoring(spark):
    rows = queries.op7_suffix_tree(spark, SMALL).collect()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    tokens = {r.doc_id: (r.text or "").encode().translate(lower).split() + [None] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    counts: Counter = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(tokens)
    for r in rows:
        w = tokens[r.doc_id]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert abs(base - r.base_score) < 1e-6 * abs(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.score < 0


def test_scoring_edges_and_mass(spark, docs_of):
    docs = docs_of([*ODD, (11, "abab abab ab")], "k")
    got = pst.scored(docs, F.lit(True)).collect()
    assert len(got) == len(ODD) + 1 and sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 2, 4, 4, 5, 60_001]
    none = pst.scored(docs, F.lit(False)).collect()
    assert {r.base_score for r in none} == {0.0} and all(r.n_known == 0 and r.score < 0 for r in none)
    lengths = [len(PlainTree.running(t)) - pst.DEPTH for _, t in [*ODD, (11, "abab abab ab")]]
    assert np.allclose(sorted(r.score for r in none), sorted(-n * math.log10(256) for n in lengths))
    assert pst.scored(docs.limit(0), F.lit(True)).count() == 0


class PlainTree:
    """Contexts of up to DEPTH bytes by plain counting."""

    def __init__(self, texts):
        self.seen = {}
        for t in texts:
            for at in range(pst.DEPTH, len(t)):
                for d in range(pst.DEPTH + 1):
                    self.seen.setdefault(t[at - d : at], Counter())[t[at]] += 1
        self.held = {}

    @staticmethod
    def running(text):
        return b"\n" * pst.DEPTH + b" ".join([*(text or "").encode().lower().split(), b"\n"])

    def p(self, context, symbol):
        counts = self.seen.get(context, {})
        total = sum(counts.values())
        if not context:
            return (counts.get(symbol, 0) + 0.5) / (total + 128)
        up = self.p(context[1:], symbol)
        if context not in self.held:
            grown = {x: (n + len(counts) * self.p(context[1:], x)) / (total + len(counts)) for x, n in counts.items()}
            gain = sum(n * math.log(grown[x] / self.p(context[1:], x)) for x, n in counts.items())
            self.held[context] = total >= pst.LEAST_COUNT and gain >= pst.LEAST_GAIN + 0.5 * math.log(total)
        return (counts.get(symbol, 0) + len(counts) * up) / (total + len(counts)) if self.held[context] else up

    def score(self, text):
        t = self.running(text)
        return sum(math.log10(self.p(t[at - pst.DEPTH : at], t[at])) for at in range(pst.DEPTH, len(t)))


def test_scores_are_those_of_a_plain_tree(docs_of, monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(30)]
    rows = [(i, " ".join(rnd.choice(words[: 5 + i]) for _ in range(rnd.randrange(0, 25)))) for i in range(40)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[::4])] + [(120, "unseen Zürich ÿ 漢字 " + words[3]), (121, None), (None, words[0])]
    plain = PlainTree([PlainTree.running(t) for i, t in rows if i is not None and i < 100])
    expected = sorted(round(plain.score(t), 4) for _, t in rows)
    for most in (pst.HEAVY_CODES, 50, 0):  # all in the broadcast table, few, none: the join gives the others
        monkeypatch.setattr(pst, "HEAVY_CODES", most)
        monkeypatch.setattr(pst, "HEAVY", most and 10)
        got = pst.scored(docs_of(rows, "k"), F.col("doc_id") < 100).collect()
        assert np.allclose(sorted(r.score for r in got), expected, atol=1e-3)
        assert len({round(r.base_score, 6) for r in got if r.doc_id in (0, 100)}) == 1


def test_probabilities_add_up_to_one(docs_of):
    docs = docs_of([(i, "abc abd xyzzy" if i % 3 else "abc xyzzy abd") for i in range(30)] + [(50, "abd abc xyz")], "k")
    tree, table = pst.fit(docs.select("text", (F.col("doc_id") < 50).alias("train")))
    held = {r.k: r.n for r in table.filter("k >= 0").collect()}
    full = np.array(sorted(c << pst.BITS | x for c in {k >> pst.BITS for k in held} for x in range(256)), np.int64)
    p = 10 ** pst.climbed(full, np.array([held.get(int(k), 0) for k in full], np.float64), tree)
    assert np.allclose(p.reshape(-1, 256).sum(1), 1, atol=1e-9)
    assert tree.levels[-1][2].size  # there are states
    # the table's own rows get the same, whatever else is given with them
    got = {r.k: r.log for r in pst.coded(table.filter("k >= 0"), tree).collect()}
    assert set(got) == set(held) and all(abs(10 ** got[int(k)] - x) < 1e-6 for k, x in zip(full, p) if int(k) in got)


def test_scoring_reads_words_in_their_order(docs_of):
    rows = [(i, "red cat sat on green mat") for i in range(40)] + [(100, "red cat sat on green mat"), (101, "mat on cat green sat red")]
    got = {r.doc_id: r for r in pst.scored(docs_of(rows, "k"), F.col("doc_id") < 100).collect()}
    assert got[100].base_score == got[101].base_score and got[100].score > got[101].score + 3


def test_codes_and_words_of_a_running_text():
    texts = [neardup.words_of(t) for t in (None, "", " a\x1cb c\x0bd\nA  a", "é漢 x", "\n", "z" * 300 + " zz", "ab ba abc")]
    raw, at, of = pst.running(texts)
    keys, first = pst.word_keys(raw, at)
    words = [w for t in texts for w in (*t, b"\n")]
    assert len(keys) == len(words) and len(set(keys.tolist())) == len(set(words)) == len(set(zip(keys.tolist(), words))) and keys.max() < 0
    assert of[first].tolist() == [i for i, t in enumerate(texts) for _ in range(len(t) + 1)]
    codes = [int.from_bytes(raw[i - pst.DEPTH : i + 1].tobytes()) for i in at]
    assert pst.codes_at(raw, at).tolist() == codes and pst.codes_at(raw, at[7:30]).tolist() == codes[7:30] and not len(pst.codes_at(raw, at[:0]))
    found = Counter(zip(codes, of.tolist()))
    assert {(int(k), int(t)): int(n) for k, t, n in zip(*pst.occurrences(np.array(codes), of))} == dict(found)
    top = np.array([2**56 - 1, 0, 2**56 - 1])
    assert [x.tolist() for x in pst.occurrences(top, np.array([255, 0, 255]))] == [[0, 2**56 - 1], [0, 255], [1, 2]]
    assert [(p.start, p.stop) for p in pst.pieces(["x"] * 600, pst.MOST_TEXTS)] == [(0, 256), (256, 512), (512, 600)]


# ---- tokens ----


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_tokens_are_the_library_s(spark, docs_of, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    rows = [*ODD, (20, "a" * 3000), (21, "  \n\n  x" * 500), (22, "don't 123 ñü漢字 \u3000" * 300), (23, "".join(rnd.choice("ab c\n1'é漢 !") for _ in range(5000))), (24, "x " * 999 + "   "), (25, " " * 2500), (26, "<|endoftext|>")]
    for chunk, overlap in ((200, 40), (bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS)):
        got = bpe.decode(bpe.encode(docs_of(rows, "bpe_row"), ranks, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap), ranks).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.token_ids == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.bpe_row == 1
    assert bpe.encode(docs_of([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_merged_by_rank(ranks):
    """The ids of pre-tokens are those of merging the pair of lowest rank, again and again."""
    rnd = random.Random(5)
    encoder = bpe.PieceEncoder(ranks, public_tokenizers.PATTERN)
    pieces = [" " * (k % 2) + "".join(rnd.choice("etaoinshrdluéü漢") for _ in range(rnd.randrange(1, 14))) for k in range(300)]
    for piece in pieces:
        for cut in regex.findall(public_tokenizers.PATTERN, piece):
            parts = [bytes([b]) for b in cut.encode()]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
                if rank == 1 << 30:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            assert np.frombuffer(encoder[cut], np.int32).tolist() == [ranks[x] for x in parts]


def test_lists_are_put_together_at_once():
    rows, tokens = pa.array([[1, 2, 3], None, [], [2], [0, 0]], pa.list_(pa.int32())), pa.array([b"a", b"", b"xyz", b"q"], pa.binary())
    expected = [b"xyzq", None, b"", b"xyz", b"aa"]
    for a in range(6):
        for b in range(a, 6):
            assert bpe.put_together(rows[a:b], tokens).to_pylist() == expected[a:b]


def test_token_query(spark, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, SMALL).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# ---- URLs ----


def test_urls(spark):
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "example.org", "/en/1")], "action string, host string, path string")
    listed = spark.createDataFrame([("bad.com", "/"), ("shop.net", "/x")], "host string, path string")
    rows = [(1, "https://A.Example.ORG/es/9?q#f"), (2, "http://example.org/en/12"), (3, "ftp://example.org/en/2"), (4, "http://sub.bad.com/a"), (5, "http://notbad.com/a"), (6, "http://shop.net/x1"), (7, "http://shop.net/y"), (8, None), (9, "no scheme"), (10, "http://bad.com"), (11, "x://"), (11, "x://"), (12, "http://bad.com?/"), (13, "http://a." * 3000 + "/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(9)), rules, listed).collect()}
    assert got[1] == ("a.example.org", "/es/9", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert [got[k][3] for k in (4, 5, 6, 7)] == ["block", "allow", "block", "allow"]
    assert got[8] == got[9] == got[11] == ("", "", None, "allow") and got[10] == ("bad.com", "", None, "block") == got[12]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules, listed).count() == 0


def test_urls_are_made_canonical(spark):
    rules = spark.createDataFrame([("allow", "good.org", "/A")], "action string, host string, path string")
    listed = spark.createDataFrame([("Bad.com.", "/x/%3a"), ("u@shop.net:8080", "/a/./b/../c"), (None, "/"), ("x", None)], "host string, path string")
    urls_of = {"http://bad.com:80/x/%3A1": "block", "http://me:pw@sub.BAD.com./x/%3ay": "block", "http://bad.com/y/../x/%3a": "block", "http://bad.com/x/%3b": "allow", "http://shop.net/a/c/d": "block", "http://shop.net/a/b/c": "allow", "http://shop.net/a/b/..": "allow", "http://shop.net/../../a/c": "block", "http://good.org/A": "allow", "http://x.": "allow", "http://...": "allow", "http://bad.com/x/%3" + "a" * 50_000: "block"}
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
    got = {r.url: (r.verdict, r.rule) for r in urls.judge(pages, rules, listed).collect()}
    assert {u: v for u, (v, _) in got.items()} == urls_of and got["http://good.org/A"][1] == "good.org/A"


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_long_list_of_many_lengths(spark, monkeypatch, broadcast):
    """20,000 listed URLs of 5,000 path lengths, by the broadcast and by the shuffle with hot keys salted, follow plain matching."""
    if not broadcast:
        for name, value in (("BROADCAST_ROWS", 10), ("HOT_ROWS", 50)):
            monkeypatch.setattr(common, name, value)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("url").unionByName(spark.createDataFrame([("http://hot.net/" + "p" * 70,)] * 300, "url string"))
    held = [(f"h{i}.net", "/" + "p" * (i % 5000)) for i in range(20_000)] + [("hot.net", "/" + "p" * 70), ("example.com", "/en/4")]
    listed = spark.createDataFrame(held, "host string, path string")
    got = urls.judge(pages, spark.createDataFrame([], "action string, host string, path string"), listed).collect()
    fits = lambda h, p: any((h == a or h.endswith("." + a)) and p.startswith(b) for a, b in held[-2:])
    assert len(got) == 350 and all((r.verdict == "block") == fits(r.host, r.path) for r in got) and sum(r.verdict == "block" for r in got) >= 300


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    rows, blocks = urls.bloom(keys, "key")
    bits = {r.block: r.bits for r in rows.collect()}
    probe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).select("key", urls._block(F.col("key"), blocks).alias("b"), urls._mask(F.col("key")).alias("m")).collect()
    hit = [bits.get(r.b, 0) & r.m == r.m for r in probe]
    assert all(hit[:5000]) and sum(hit[5000:]) < 0.25 * 15_000


# ---- columns of clashing names ----

OWN = "best on_list url_best url_listed url_host url_row block bits ids starts sizes bpe_row bpe_begins judged _judged quality_site spans row key n h k x salt fp bands words hash at cell far vec host path rule verdict kept score lang_pred".split()


@pytest.mark.parametrize("operator", ["urls", "bpe", "langid", "quality", "pii", "html"])
def test_columns_of_clashing_names_are_kept(spark, ranks, operator):
    text = "My mail is ann@example.com and the cat sat on the mat"
    rows = spark.createDataFrame([(1, text, "http://a.b/c", "src", "en"), (2, "x " * 40_000, None, None, None)], "doc_id long, text string, url string, source string, lang string")
    rows = rows.select("*", *[F.lit(f"own {c}").alias(c) for c in OWN])
    if operator == "urls":
        got = urls.judge(rows, spark.createDataFrame([("block", "b", "/")], "action string, host string, path string"), spark.createDataFrame([("b", "/")], "host string, path string"))
    elif operator == "bpe":
        got = bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks)
    elif operator == "langid":
        got = langid.predict(rows, langid.fit(rows.select("text", "lang", "doc_id")))
    elif operator == "quality":
        got = quality.classify(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.col("source"), F.col("lang"))
    elif operator == "pii":
        got = pii.detect(rows)
    else:
        got = html.main_text(rows, html="text", out="main")
    replaced = {"urls": {"host", "path", "rule", "verdict"}, "langid": {"lang_pred", "score"}, "quality": {"kept"}}.get(operator, set())
    found = got.collect()
    assert len(found) == 2 and all(r[c] == f"own {c}" for r in found for c in OWN if c not in replaced)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
