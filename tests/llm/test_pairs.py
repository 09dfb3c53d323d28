"""Search, near duplicates and decontamination against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from partloom.llm import decontam, neardup, topk


def brute_components(rows, percent, size=5):
    sets, ids = [], []
    for i, t in rows:
        w = (t or "").encode().translate(neardup._LOWER).split()
        s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        sets.append(s)
        ids.append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and ids[a] is not None and ids[b] is not None and 100 * n >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(zip(ids, sets))), key=str)


def test_near_duplicates_follow_brute_force(docs_of):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    rows, n = [], 0
    for length in (6, 12, 60, 300):
        base = [word() for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):  # copies of one text, most with edits of their own, the text itself last
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(length)] = word()
            rows.append((1000 - n, " ".join(t).upper() if n % 5 == 0 else "\n ".join(t)))
            n += 1
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (None, rows[0][1]), (7, "x" * 200_000), (8, "x" * 200_000), (9, rows[3][1]), (9, rows[3][1])]
    for percent in (80, 85):
        got = neardup.near_duplicates(docs_of(rows), percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_links_that_no_star_gives(docs_of):
    """The bucket's smallest member is far from two others that are close to each other."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    far = base[:186] + [word() for _ in range(14)]
    near = list(far)
    near[100] = word()
    rows = [(1, " ".join(base[:14] + [word() for _ in range(14)] + base[28:])), (2, " ".join(far)), (3, " ".join(near))]
    got = neardup.near_duplicates(docs_of(rows), percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 85)


def test_near_duplicates_of_nothing(docs_of):
    assert neardup.near_duplicates(docs_of([])).count() == 0
    got = neardup.near_duplicates(docs_of([(None, None), (1, None)])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (1, 1, True)}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[200:], rng.integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2)]))
    both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - both) < 0.1
    assert (neardup.signature(a[:1]) == a[0]).all()  # one shingle fills every bin


def test_search_follows_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = {i: [int(x) for x in rng.integers(-9, 9, 8)] for i in range(300)}
    for i in range(100, 160):
        vecs[i] = vecs[100]  # a very common vector: ties
    rows = [(i, v) for i, v in vecs.items()]
    data = spark.createDataFrame(rows, "id long, vec array<long>")
    queries = data.filter("id % 20 = 0")
    got = {}
    for r in topk.search(queries.unionByName(queries), data, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 300, 20):
        best = sorted(((-int(np.dot(vecs[q], v)), i) for i, v in vecs.items() if i != q))[:7]
        assert [got[q][k + 1] for k in range(7)] == [(i, -s) for s, i in best]


def test_search_edges(spark):
    schema = "vec_id long, embedding array<double>"
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (20, [0.51, -0.51]), (40, [1.0, 1.0]), (7, [2.0, 0.0]), (None, [9.0, 9.0])]
    rows = spark.createDataFrame(bad, schema).filter(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.whole_numbers(F.col("embedding")).alias("vec"), F.lit(1).alias("cell"))
    assert {r.id: r.vec for r in rows.collect()}[20] == [32, -33]
    got = topk.search(rows.filter("id % 20 = 0"), rows, 20).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(20, 1, 7, 32 * 128), (20, 2, 5, 0), (20, 3, 40, -64), (40, 1, 7, 64 * 128), (40, 2, 5, 0), (40, 3, 20, -64)}
    assert topk.search(rows.filter("id < 0"), rows, 20).count() == 0 == topk.search(rows.filter("id < 0"), rows.filter("id < 0"), 20).count()
    # large numbers, repeated rows of one id, which are candidates each for others and none for itself
    big = spark.createDataFrame([(20, [3_000_000_000, 1]), (1, [3_000_000_000, 2]), (2, [-5, 7])] + [(40, [1, 1])] * 30, "id long, vec array<long>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(big.filter("id % 20 = 0"), big, 3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 9 * 10**18 + 2), (20, 2, 40, 3_000_000_001), (20, 3, 40, 3_000_000_001), (40, 1, 1, 3_000_000_002), (40, 2, 20, 3_000_000_001), (40, 3, 2, 2)]


def test_clustered_vectors_are_sent_to_few_groups(spark, monkeypatch):
    """Bounds keep most vectors from most groups, and the result is that of brute force."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "DATA_BLOCK", 400)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 300
    vecs = np.round(centres[np.arange(3000) % 20] + rng.normal(size=(3000, 16)) * 8).astype(int)
    vecs[1000:2000] = vecs[1000]  # a third of all rows is one vector
    data = spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "id long, vec array<long>")
    queries = data.filter("id % 3 = 0 and id < 1000")
    asked, sent, _ = topk.routed(queries, data, 5)
    groups = asked.select("group").distinct().count()
    assert groups > 4 and sent.count() < 0.5 * groups * 3000
    got = {}
    for r in topk.search(queries, data, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 1000, 3):
        scores = vecs @ vecs[q]
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]


BENCH = [(1, "A train travels 120 miles in 3 hours at a steady pace and then stops for 120 minutes before going on"), (2, "What is the capital of the country that lies north of the river and east of the hills"), (3, "short item"), (4, None)]


def test_decontamination(spark, docs_of):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    pad = "some words that have nothing to do with it "
    rows = [
        (1, pad + BENCH[0][1] + " " + pad),
        (2, pad + BENCH[0][1].replace("120", "75").replace("3 hours", "9 hours") + pad),  # other parameters, used consistently
        (3, pad + BENCH[0][1].replace("120 miles", "75 miles") + pad),  # 120 stands for two values: no match
        (4, pad * 50),
        (5, BENCH[1][1].upper().replace(" ", "\n")),
        (6, None),
        (7, ""),
        (8, "a short item here"),
        (9, " ".join(BENCH[1][1].split()[:8])),  # one window of eleven
        (None, BENCH[1][1]),
        (1, pad + BENCH[0][1]),
        (1, pad),
        (11, pad + BENCH[0][1].replace("120 miles", "75 miles") + pad),  # one text of two is a match
        (11, pad + BENCH[0][1].replace("120", "75").replace("3 hours", "9 hours")),
        (12, "see " + "Abcd " * 20_000),
        (13, "7" * 40_000 + " " + "1,2/" * 20_000),
    ]
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1): 0, (2, 1): 2, (5, 2): 0, (8, 3): 0, (11, 1): 2, (None, 2): 0}
    assert decontam.contaminated(docs_of(rows), bench.filter("item_id < 0")).count() == 0
    assert decontam.contaminated(docs_of([]), bench).count() == 0


def test_decontamination_of_names_case_and_several_occurrences(spark, docs_of):
    story = "Tom has 3 apples and a bag. Anna gives him 5 more pears after lunch. Tom eats 2 of them at home"
    numbers = "add up 1 2 3 4 5 6 7 8 9 10 11 12 and say what the total of all these is"
    bench = spark.createDataFrame([(1, story), (2, numbers), (3, "we saw Paris in spring")], "item_id long, text string")
    other = lambda t: t.replace("Tom", "Eve").replace("Anna", "Mary Ann").replace("3", "7").replace("5", "8")
    rows = [
        (1, "Look. " + other(story)),
        (2, story.upper()),
        (3, "see " + story.lower() + " end"),
        (4, story + ". And now again. " + other(story)),  # verbatim and with other values
        (5, other(story) + ". And now. " + story.replace("Tom", "Bob").replace("3", "9")),  # two variants
        (6, numbers),
        (7, "he said we saw paris in spring again"),
        (8, "nothing of the kind " * 20),
        (9, "1.2:3/" * 20_000 + " " + "Aa " * 30_000),
    ]
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (7, 3)}
    assert got[1, 1] == 4 and got[2, 1] == got[3, 1] == got[4, 1] == got[6, 2] == got[7, 3] == 0


def test_decontamination_follows_a_plain_scan(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    items = {}
    for i, t in [tuple(r) for r in bench.select("item_id", "text").collect()]:
        w = words(t)
        items[i] = {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))}
    expected = set()
    for d, t in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
        w = words(t)
        mine = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        expected |= {(d, i) for i, s in items.items() if len(s & mine) >= 0.5 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == expected and expected


def plain_template(text, before):
    """Words of a text with placeholders, and the values behind them, by plain Python."""
    import regex

    upper = r"\p{Lu}[\p{L}'’-]*+"
    held = regex.sub(rf"{before}{upper} (?=\p{{Lu}})", "", text or "")
    values = {decontam.NAMED: [x.lower() for x in regex.findall(before + upper, held)]}
    held = regex.sub(before + upper, decontam.NAMED, held)
    values[decontam.NUM] = regex.findall(decontam.NUMBER, held)
    held = regex.sub(decontam.NUMBER, f" {decontam.NUM} ", held)
    units = "|".join(sorted((u.replace("%", "%(?!%)") for u in decontam.UNITS), key=len, reverse=True))
    held = regex.sub(rf"(?i){decontam.NUM} +(?:{units})(?![\p{{L}}\p{{N}}])", f"{decontam.NUM} {decontam.UNIT} ", held)
    return [w for w in regex.split(r"[^\p{L}\p{N}<>]+", held.lower()) if w], values


def plain_matches(docs, bench, window=8, coverage=0.5):
    """(doc, item) by trying every document against every item: half of the template windows and slots that agree in an occurrence or throughout, or half of the folded words if the template misses, or all of them."""
    import regex

    marks = (decontam.NUM, decontam.NAMED, decontam.UNIT)
    folded = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    windows = lambda w, n: {}.fromkeys(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def slots(words, values, at, n):
        """Mark, place within the window and value of the slots of a window."""
        for i in range(at, at + n):
            if words[i] in values:
                yield words[i], values[words[i]][words[:i].count(words[i])].lower()

    out = set()
    for item, question in bench:
        before = decontam.ANYWHERE
        words, values = plain_template(question, before)
        if len(words) < window:
            before = decontam.INSIDE
            words, values = plain_template(question, before)
        if not words:
            continue
        n = min(window, len(words))
        own = {w for w in windows(words, n) if any(x not in marks for x in w)}
        own_words = folded(question) if any(w in marks for w in words) else []
        m = min(window, len(own_words))
        plain = set(windows(own_words, m)) if own_words else set()
        for doc, text in docs:
            theirs, their_values = plain_template(text, before)
            met = [(i, j) for i in range(len(theirs) - n + 1) for j in range(len(words) - n + 1) if theirs[i : i + n] == words[j : j + n] and tuple(words[j : j + n]) in own]
            hits = {tuple(words[j : j + n]) for _, j in met}
            said = plain & set(windows(folded(text), m)) if plain else set()
            whole = bool(plain) and said == plain
            if own and len(hits) >= coverage * len(own):
                pairs = {}
                for i, j in met:
                    pairs.setdefault(i - j, set()).update((k[0], k[1], d[1]) for k, d in zip(slots(words, values, j, n), slots(theirs, their_values, i, n)))
                fine = lambda found: len({(a, b) for a, b, _ in found}) == len(found)
                one = any(fine(found) and len({tuple(words[j : j + n]) for i, j in met if i - j == at}) >= coverage * len(own) for at, found in pairs.items())
                if whole or one or fine(set().union(*pairs.values())):
                    out.add((doc, item))
            elif plain and len(said) >= coverage * len(plain):
                out.add((doc, item))
    return out


def test_decontamination_follows_brute_force(spark, docs_of):
    rnd = random.Random(12)
    names, word = ["Tom", "Anna", "Mary Ann", "Bob"], lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    question = lambda: " ".join(rnd.choice([word(), word(), word(), rnd.choice(names), str(rnd.randrange(2, 40)), f"{rnd.randrange(2, 9)} km"]) for _ in range(rnd.randrange(4, 26)))
    bench = [(i, question()) for i in range(12)] + [(20, ""), (21, "add 1 2 3 4 5 6 7 8 9 10 11")]
    docs = []
    for k in range(120):
        text = rnd.choice(bench)[1]
        parts = text.split()
        for _ in range(rnd.randrange(0, 4)):  # other numbers and names, or other words
            if parts:
                at = rnd.randrange(len(parts))
                parts[at] = str(rnd.randrange(2, 40)) if parts[at].isdigit() else rnd.choice(names) if parts[at][0].isupper() else word()
        text = " ".join(parts)
        if k % 5 == 0:
            text = text.upper() if k % 10 else text.lower()
        if k % 7 == 0:
            text += ". " + rnd.choice(bench)[1]
        docs.append((k, f"{word()} {word()} {text} {word()}"))
    found = decontam.contaminated(docs_of(docs), spark.createDataFrame(bench, "item_id long, text string"))
    expected = plain_matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and 40 < len(expected) < 120 * 14


def test_decontamination_without_any_broadcast(spark, docs_of, monkeypatch):
    """With a bound that nothing meets, every table is joined by a shuffle: the same rows."""
    from partloom.llm import common

    question = "A baker sells 12 loaves for 3 dollars each in the morning and 7 more at noon, how many dollars does the baker earn"
    items = spark.createDataFrame([(1, question), (2, question), (3, "short one")], "item_id long, text string")
    docs = docs_of([(1, "x " * 20 + question), (2, question.replace("12", "40")), (3, "nothing of it at all"), (4, None), (5, "a short one here")])
    plain = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == plain
    assert {(r[0], r[1]) for r in plain} >= {(1, 1), (1, 2), (2, 1), (2, 2), (5, 3)}


def test_names_are_looked_behind_at_capitals_only(spark):
    """The patterns say what their plain spellings say, and test for a capital before they look behind."""
    plain = {decontam.ANYWHERE: r"(?<![\p{L}\p{N}'’-])", decontam.INSIDE: r"(?<=\p{Ll}[,;:]? )"}
    odd = ["Ann Lee’s Dr. O'Neil-Smith Ünder ǅ aB B", "x Ann, Bob; cc: Dd e² Ⅷ １２ 3,000.5 km/h 5 %", "-Ann 'Bob 9Carl _Dora é Éva Ábc 𝐀bc", "", None, "A B C D", "a A\nB a  B a. B", " Zed a: Zed a, Zed a; Zed"]
    rows, t = spark.createDataFrame([(x,) for x in odd], "text string"), F.col("text")
    for ours, theirs in plain.items():
        assert ours.startswith(r"(?=\p{Lu})")
        both = rows.select(decontam.template(t, ours), decontam.template(t, theirs), decontam.slots(t, ours), decontam.slots(t, theirs), decontam.folded(t), F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in both.collect())


def test_windows_are_hashed_by_compiled_code(spark):
    """One row for each window with the hash of its words in their order; no lambda, which Spark does not compile."""
    texts = [list("abcdefghij"), list("aaaa"), ["é", "", "b"], [], None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, words array<string>")
    for n in (1, 3, 8):
        made = decontam.windows_of(df, "words", n, "k")
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
        expected = [(k, i, w[i : i + n]) for k, w in enumerate(texts) for i in range(len(w or []) - n + 1)]
        hashed = spark.createDataFrame(expected, "k long, at int, w array<string>").select("k", "at", F.xxhash64("w"))
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, hashed.collect()))
