"""The training-data operators: brute force, round trips and held-out accuracy; nulls, empties, very long texts, repeats, empty tables, clashing columns."""

import base64
import datetime as dt
import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.urls import py_fingerprint
from weftline.llm import body, encoding, labelled, packing, page_model, pages, repeated, residue, seen, subjects

VOCABULARY = f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer file")
ODD = [None, "", " ", "\n", "word " * 20_000, "a" * 30_000, "<|endoftext|>", "é漢字 😀\r\n\t x", "'Tis I'LL don't 12345"]


# problem 3


def test_chain_never_misses_and_keeps_its_bound():
    rng = np.random.default_rng(1)
    chain = seen.BloomChain(error=0.01, capacity=256)
    keys = rng.integers(0, 2**63, (20_000, 2), dtype=np.uint64)
    first = np.concatenate([chain.ask_and_add(keys[i : i + 500]) for i in range(0, len(keys), 500)])
    assert chain.ask(keys).all() and len(chain.layers) > 3
    assert chain.bound() <= 0.01 and first.mean() <= 0.01
    assert [x.error for x in chain.layers] == sorted((x.error for x in chain.layers), reverse=True)


def test_seen_equals_brute_force(spark):
    rng = random.Random(2)
    key = lambda i: py_fingerprint("GET", f"http://h.example/{i}")
    history = [(key(i), None) for i in range(0, 60, 3)] + [(None, "http://h.example/500"), (None, "nothing"), (key(0), None)]
    rows = []
    for seq in range(800):
        i = 7 if rng.random() < 0.4 else rng.randrange(600)  # one key holds much
        rows.append((seq, None, f"http://h.example/{i}#x") if rng.random() < 0.5 else (seq, key(i), "whatever"))
    rows += [(900, None, None), (901, None, "mailto:x"), (902, b"short", None), (903, b"short", None), (904, None, "http://H.example/500")]
    rng.shuffle(rows)
    h = spark.createDataFrame(history, "fp binary, url string")
    f = spark.createDataFrame([(s, bytearray(k) if k else None, u, None, "clash") for s, k, u in rows], "seq long, fp binary, url string, method string, arrival string").repartition(5)
    for capacity in (16, 1 << 16):
        old, new = seen.request_keys(h, "-1", None), seen.request_keys(f, "seq", "method")
        got = {r.arrival for r in seen.probe(old, new, capacity=capacity, partitions=3).where("seen").collect()}
        kept = seen.chains(old, capacity=capacity, partitions=3)  # the chains survive the run that built them
        again = {r.arrival for r in seen.probe(old, new, capacity=capacity, partitions=3, kept=kept).where("seen").collect()}
        known = {k or py_fingerprint("GET", u) for k, u in history} - {None}
        want = set()
        for s, k, u in sorted(rows, key=lambda r: r[0]):
            k = k or py_fingerprint("GET", u)
            if k is not None:
                if k in known:
                    want.add(s)
                known.add(k)
        assert got == again == want
    empty = seen.request_keys(f.limit(0), "seq", "method")
    assert seen.probe(None, empty).where("seen").count() == 0
    assert seen.error_report(seen.probe(None, empty)).first().asked == 0


# problem 6


@needs_vocabulary
def test_encoding_equals_the_reference_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    t = tiktoken.Encoding("own", pat_str=encoding.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab ,.éß漢1\n'") for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encoding.encode(df, "doc_id", "text").collect()}
    for i, x in enumerate(texts):
        assert got[i] == t.encode_ordinary(x or ""), x
        assert t.decode(got[i]) == (x or "")
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encoding.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(4).integers(0, 2**63, 5000, dtype=np.uint64)
    at = encoding.PerfectHash(h).find(h)
    assert sorted(at) == list(range(5000))


# problem 7


def test_packing(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([5, 50, 300, 700, 1100, 2048, 2049, 5000])) for i in range(900)] + [(7, 100), (7, 100), (None, 60), (1000, 0), (1001, None)]
    df = spark.createDataFrame(items, "id long, size long").withColumn("container", F.lit("clash"))
    out = packing.pack(df, "id", "size", 2048, 150).collect()
    used = Counter()
    for r in out:
        used[r.container] += r["size"]
        assert r.start == r.piece * 2048
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(s or 0 for _, s in items)
    assert Counter(r.id for r in out if r.piece == 0) == Counter(i for i, s in items if s)
    assert {r.id for r in out if r.piece} == {i for i, s in items if s and s > 2048}
    assert len(used) <= 1.06 * sum(used.values()) / 2048 + 2
    assert packing.pack(df.limit(0), "id", "size").count() == 0
    hard = spark.range(400).select("id", (410 + F.pmod(F.col("id") * 7919, F.lit(613))).alias("size"))
    greedy, evolved = (packing.pack(hard, "id", "size", rounds=r).select("container").distinct().count() for r in (0, packing.ROUNDS))
    assert evolved < greedy
    with pytest.raises(ValueError):
        packing.pack(df, "id", "size", 0)


def test_crossover_keeps_all_items():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 900) for _ in range(120)]
    a, b = (packing.best_fit([], rng.sample(range(120), 120), sizes, 2048) for _ in range(2))
    a, b = ([list(g) for g in x] for x in (a, b))
    for g in (packing.cross(a, b, sizes, 2048, rng), packing.mutate(a, sizes, 2048, rng)):
        assert sorted(i for x in g for i in x) == list(range(120)) and max(sum(sizes[i] for i in x) for x in g) <= 2048


# problem 2


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(7)
    legal = ["© 2020 Site. All", "  ©  2021 SITE. all ", "123", "", "Share"]
    recs = []
    for i in range(120):
        site = "hot" if i < 80 else rng.choice(["a", "b", None])
        lines = [rng.choice(legal) if rng.random() < 0.5 else f"own line {'x' * rng.randrange(40)}" for _ in range(rng.randrange(1, 7))]
        recs.append((site, i, "\n".join(lines), [None, dt.date(2024, 1, 1 + i % 2), dt.date(2024, 2, 1)][i % 3] if site == "hot" else None))
    recs += [("hot", 200 + i, "printed again\n" + recs[0][2], dt.date(2024, 3, 1 + i % 30)) for i in range(40)] + [("hot", 300, None, None), ("hot", 301, "", None), ("a", 302, "w " * 50_000, None)]
    df = spark.createDataFrame(recs, "site string, id long, text string, day date")
    norm = lambda x: __import__("re").sub("[0-9]+", "0", " ".join(x.replace(" ", " ").split()).lower())
    n, sites = Counter(), Counter(s for s, _, t, _ in recs if s and t is not None)
    for s, _, t, _ in recs:
        if s and t is not None:
            n.update((s, k) for k in {norm(x) for x in t.split("\n")} if any(c.isalpha() for c in k))
    want = {(i, j) for s, i, t, _ in recs if s and t is not None for j, x in enumerate(t.split("\n")) if n[s, norm(x)] >= 4 and n[s, norm(x)] >= 0.25 * sites[s]}
    texts_of = {}
    for s, i, t, d in recs:
        if s and t is not None:
            texts_of.setdefault(s, {}).setdefault(t, []).append((i, d))
    clusters = Counter((s, k) for s, ts in texts_of.items() for t in ts for k in {norm(x) for x in t.split("\n")} if any(c.isalpha() for c in k))
    days = {}
    for s, _, t, d in recs:
        for k in {norm(x) for x in t.split("\n")} if s and t is not None and d else ():
            days.setdefault((s, k), set()).add(d)
    by_clusters = {(i, j) for s, i, t, _ in recs if s and t is not None for j, x in enumerate(t.split("\n")) if clusters[s, norm(x)] >= 4 and clusters[s, norm(x)] >= 0.25 * len(texts_of[s])}
    by_days = {(i, j) for s, i, t, _ in recs if s and t is not None for j, x in enumerate(t.split("\n")) if (i, j) in by_clusters and len(days.get((s, norm(x)), ())) >= 3}
    assert by_clusters != want and by_days < by_clusters
    for limit in (100_000, 0):  # broadcasts, and the salted joins
        repeated.BROADCAST_ROWS = limit
        rows = repeated.site_lines(repeated.line_keys(df))
        for by, right in (("records", want), ("clusters", by_clusters), ("days", by_days)):
            assert {(r.id, r.line_no) for r in repeated.repeated_lines(rows, by=by).collect()} == right
    repeated.BROADCAST_ROWS = 100_000
    found = repeated.repeated_lines(rows)
    cleaned = {r.id: r.text for r in repeated.without_repeated(df, found).collect()}
    assert len(cleaned) == len(recs) and cleaned[300] is None and cleaned[301] == ""
    assert all(cleaned[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in want) for _, i, t, _ in recs if t)
    assert repeated.repeated_lines(repeated.site_lines(repeated.line_keys(df.limit(0)))).count() == 0


# problems 1 and 4


def test_page_model_on_held_out_pages():
    t, labels = labelled.labelled_pages(150, seed=77)
    p, pair, _ = page_model.marginals(page_model.trained(), page_model.Flat(t))
    leaf = np.array(sorted(t.text))
    assert ((p[leaf, 1] > 0.5) == labels[leaf]).mean() > 0.97
    child = np.array(t.parent) >= 0
    assert np.allclose(pair[child].sum((1, 2)), 1) and np.allclose(pair[child].sum(1), p[child])


def test_messages_equal_enumeration():
    t = pages.Trees()
    root = t.add(0, -1, 0, [0])
    a = t.add(0, root, 1, [1])
    for f in (2, 3):
        t.add(0, a, 2, [f])
    t.add(0, root, 2, [4])
    rng = np.random.default_rng(8)
    m = page_model.Model(rng.normal(size=pages.N_FEATURES), rng.normal(size=(page_model.N_EDGES, 2, 2)))
    total, mass = 0.0, np.zeros(5)
    for bits in range(32):
        y = [(bits >> i) & 1 for i in range(5)]
        w = np.exp(sum(m.weights[t.features[i][0]] * y[i] for i in range(5)) + sum(m.edges[t.edge[i], y[t.parent[i]], y[i]] for i in range(1, 5)))
        total += w
        mass += w * np.array(y)
    p, _, z = page_model.marginals(m, page_model.Flat(t))
    assert np.allclose(p[:, 1], mass / total) and np.isclose(z, np.log(total))


ARTICLE = "Home | News | Contact\n\n# The long road\n\nBy the Example desk\n\nThe road was long and the walkers were tired, but nobody turned back before noon. It took them two days.\n\nPlease enable JavaScript, said the old sign, and everybody laughed at it for an hour.\n\nYou may also like\n\nAnother road\nNo more roads\n\n© 2020 Example. All rights reserved."
HTML = '<!doctype html><html><head><title>T</title></head><body><nav><ul>\n<li><a href="/">Home</a></li>\n</ul></nav>\n<div class="story">\n<h1>T</h1>\n<p>The road was long and\nthe walkers were tired, but nobody turned back.</p>\n</div>\n<footer>© 2020 Example. All rights reserved.</footer></body></html>'
STUBS = ["Page not found\n\nThe address /x does not exist on this server.", "Hello {{name}}, welcome to {{site}}!\n\n{{title}}", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", "Home | News | Contact\n\n502 Bad Gateway\n\n© 2020 Example. All rights reserved.", '{"error": {"code": 404, "message": "no such entry"}}', "Please enable JavaScript to view this page."]


def _pages(spark):
    texts = [ARTICLE, HTML, '{"a": "text of a record", "b": 2}', *STUBS, *ODD] + [ARTICLE.replace("road", w) for w in ("river", "street", "bridge", "wall")] * 6 + STUBS * 4
    texts += [json.dumps({"name": f"road {i}", "length": i, "text": "a text of the record"}) for i in range(12)]
    return texts, spark.createDataFrame([("t", i, x, None, "clash") for i, x in enumerate(texts)], "tbl string, rec_id long, text string, status int, score string")


def test_body_and_residue(spark):
    texts, df = _pages(spark)
    model = residue.learn(residue.read_chunks(df))
    found = {r.rec_id for r in residue.residue_scores(df, model).where("score > 0").collect()}
    assert found >= set(range(3, 9)) and not found & {0, 1, 2, 9, 10, 11, 12}
    lines = {}
    for r in body.body_lines(df, model).collect():
        lines.setdefault(r.rec_id, []).append(r.line_no)
    assert sorted(lines[0]) == [2, 6, 8] and sorted(lines[1]) == [4, 5, 6]
    assert not set(lines) & found and 2 not in lines and 9 not in lines
    texts_of = {r.rec_id: r.text for r in body.body_text(df, model).collect()}
    assert texts_of[1].startswith("T\nThe road was long") and len(texts_of) == len(texts)
    empty = df.limit(0)
    assert residue.residue_scores(empty).count() == 0 and body.body_lines(empty).count() == 0 and body.body_text(empty).count() == 0
    assert residue.residue_scores(df.where("rec_id = 0")).where("score > 0").count() == 0  # nothing to trust
    again = residue.Residue.from_bytes(model.to_bytes())
    assert again.prior == model.prior and (again.weights == model.weights).all()


def test_residue_is_learnt_from_all_passages_of_all_records(spark):
    body_ = "\n\n".join(f"The {w} mill was built beside the river and has ground corn for the valley ever since." for w in ("first", "second", "third", "fourth", "fifth", "sixth", "seventh"))
    body_ += "\n\nIts zanquel wheel still turns on feast days when the miller opens the sluice for visitors."
    notice = "Page not found. Error 404 vorblitz."
    rows = [("t", i, body_ if i % 20 else notice) for i in range(200)]
    learn = lambda df: residue.learn(residue.read_chunks(df))
    model = learn(spark.createDataFrame(rows, "tbl string, rec_id long, text string"))
    assert model.weights[residue.number("zanquel")] < 0 < model.weights[residue.number("vorblitz")]  # in the eighth passage
    few = F.when(F.col("id") % 3000 == 5, notice).otherwise("A short note about the weather in spring.")
    model = learn(spark.range(24_000).select(F.lit("t").alias("tbl"), F.col("id").alias("rec_id"), few.alias("text")))
    residues = 24_000 / (1 + math.exp(-model.prior))
    assert model.weights[residue.number("vorblitz")] > 3 and round(residues) >= 8  # all eight records


def test_forms_of_pages_and_signs_of_passages():
    form = lambda x: (lambda t: "data" if t.data else "html" if any(t.edge[n] == pages.EDGE["leaf"] for n in t.text) else "text")(_added(x))
    assert form("\ufeff<section><p>words of a page</p></section>") == form("<article>words here</article>") == form("Some words\n<div><p>a b</p>\n<p>c d</p></div>") == "html"
    assert form("# Title\n\nA tag like <div> is text.") == form("a < b and c > d") == "text" and form(' {"a": 1}') == "data"
    long = "We keep small files on your device and our cookies. " * 12
    assert pages.FEATURE["has_consent"] in pages.line_features(long)[0]
    has = lambda x, sign: residue.NUMBER[sign] in residue.token_numbers(x)[0]
    assert has("Please enable JavaScript.", "<notice 3>") and not has("Unforbidden words", "<notice 1>") and has("word " * 60 + "page not found", "<notice 1>")
    assert has("asdfgh jklasd", "<mash>") and has("Hello {{name}}", "<slot>") and has("", "<nothing>")


def _added(x):
    t = pages.Trees()
    pages.add_page(t, 0, x)
    return t


def test_broken_pages_do_not_fail():
    t = pages.Trees()
    for i, x in enumerate(["<div", "<div><p>a", "</p></div></html>", "<table><tr><td>x<td>y</table>", "<script>if (a<b) {", "<!-- open", "{", "[", "{}", "```\ncode", "<html><title>x", "<p>" * 3000 + "deep"]):
        pages.add_page(t, i, x)
    page_model.marginals(page_model.trained(), page_model.Flat(t))


# problem 8


def test_subjects(spark):
    law = "The judge dismissed the injunction. The claimant asked the tribunal for a verdict. The statute was cited by the solicitor."
    food = "Der Bäcker nimmt den Ofen. Die Köchin kocht die Linsensuppe. Das Sauerteigbrot kommt aus dem Ofen."
    mixed = law + " " + food.replace("Ofen", "oven")
    mention = law * 3 + " The chef waited outside with a frying pan."
    docs = [(1, law), (2, food), (3, mixed), (4, mention), (5, "You have 3 messages. Sign in to continue. Choose a list."), *[(10 + i, x) for i, x in enumerate(ODD)]]
    docs += [(100 + i, law.replace("judge", f"judge {i}")) for i in range(30)] + [(200 + i, food) for i in range(30)]
    d = spark.createDataFrame([(i, x, "clash") for i, x in docs], "doc_id long, text string, share string")
    labels = spark.createDataFrame([(1, "LAW "), (2, "food"), (2, "food"), (100, "sport"), (None, "law"), (101, None), (102, "unknown")], "doc_id long, subject string")
    codes = spark.createDataFrame([("law",), ("food",), ("sport",), ("new code",), (None,)], "subject string")
    got = {}
    for r in subjects.subjects_of(d, "doc_id", "text", labels, codes).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got[1] == {"law"} and got[2] == {"food"} and got[3] == {"law", "food"} and got[4] == {"law"}
    assert 5 not in got and not set(got) & set(range(10, 19))
    assert subjects.subjects_of(d.limit(0), "doc_id", "text", labels.limit(0), codes).count() == 0


def test_subject_terms_are_learnt_from_all_documents(spark):
    plain, rare = "The weather was mild on that day.", "The tribunal saw quillivant there."
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5000 == 7, rare).otherwise(plain).alias("text"))
    labels = spark.createDataFrame([], "doc_id long, subject string")
    m = subjects.learn(d, "doc_id", "text", labels, ["food", "law"])[0]
    assert any("quillivant" in t and s == 1 for t, (s, _) in m.lexicon.weights.items())  # six sentences in all
    assert set(m.score) == {subjects.SCORE} and set(m.share) == {subjects.SHARE} and m.dropped == 0  # nothing to calibrate on


def test_term_counts_equal_brute_force():
    rng = random.Random(5)
    lines = [[rng.choice(("a", "bc", "def", "ghij", "été", "o'er")) for _ in range(rng.randint(2, 7))] for _ in range(300)]
    of = [rng.randint(-1, 2) for _ in lines]
    singles = Counter((w, s) for x, s in zip(lines, of) for w in x if len(w) > 2)
    pairs = Counter((f"{a} {b}", s) for x, s in zip(lines, of) for a, b in zip(x, x[1:]))
    c = subjects.coded([0], [None], [False], [len(lines)], [subjects._joined(x) for x in lines])
    got = subjects.term_counts(c, np.array(of), 3)
    assert {(r["term"], r["subject"]): r["n"] for r in got.to_pylist()} == singles + pairs


def test_matches_and_subjects_of_sentences():
    docs = ["The judge saw the oven. The tribunal met again. Nobody came late.", "The oven burns. Bread rises here.", "Plain words only."]
    lines = [subjects.sentence_lines(x) for x in docs]
    c = subjects.coded([0, 1, 2], [["law"], None, ["food"]], [False, False, True], [len(x) for x in lines], [y for x in lines for y in x])
    lex = subjects.Lexicon(["food", "law"], {"oven": (0, 1.0), "judge": (1, 1.0), "tribunal": (1, 1.0), "tribunal met": (1, 1.0)})
    sentence, term = subjects.matches(lex.automaton(), c)
    assert list(zip(sentence.tolist(), term.tolist())) == [(0, 1), (0, 0), (1, 3), (3, 0)]  # the longest term first
    owner, weight = lex.arrays()
    got = subjects.sentence_subjects(c, sentence, owner[term], weight[term], {"food": 0, "law": 1})
    assert got.tolist() == [-1, 1, 1, 0, -1, -1]  # two subjects; law; the label's; food; one sentence is too few; a held-out label


def test_mending():
    assert subjects.mend("mÃ¼de zero​width") == "müde zerowidth" and subjects.mend("plain") == "plain"
    assert [len(s.split()) for s in subjects.sentence_lines('Asked by E. Smith today. "No." He left.\n| a b | c d |')] == [5, 2, 2, 2]


@needs_vocabulary
def test_queries_run(spark, data):
    from weftline.llm.queries import QUERIES

    for name, q in QUERIES.items():
        assert q(spark, data).count() >= 0, name


def test_sql_agrees(spark, data, duck):
    from conftest import rows_of

    from weftline.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, data)
        r = duck.execute(sql)
        assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of([c[0] for c in r.description], r.fetchall()), name
