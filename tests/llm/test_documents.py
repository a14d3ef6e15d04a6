import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from juriloom.llm import ego_join, html_mincut, hyperminhash, license_scan, pseudo_likelihood, quality_rules, toxicity
from juriloom.llm.components import connected

SCHEMA = "doc_id long, text string, n_words string, set_key string, __id string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def copies(seed, groups=6, size=12):
    r = random.Random(seed)
    out = [None, "", " \n ", "one two", "One  TWO", "a b c d", "a b c d e f", "a b c d e g", "é à", "É à"]
    for _ in range(groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([8, 30, 90]))]
        for _ in range(size):
            words = base[:]
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 9)}"
            out.append(" ".join(words))
        out.append(" ".join(base) + " \n")
    return out


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block, shingles_held", [(512, 1 << 19), (4, 1 << 19), (512, 100)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block, shingles_held):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", shingles_held)
    texts = copies(1)
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == brute_components(texts)
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (got[i].component_id == i) for i, t in enumerate(texts))


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in hyperminhash.near_duplicates(df).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("5", "3", False), ("7", "7", True), ("None", "None", True)]
    assert hyperminhash.near_duplicates(df.limit(0)).count() == 0


def test_ids_with_several_texts_join_their_links(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (1, b), (0, b), (2, a), (9, c), (7, c), (9, "x"), (9, None), (5, "x")]
    got = {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (5, 5), (7, 5), (9, 5), (9, 9)}  # the last has no words


def test_shingles_of_long_texts(monkeypatch):
    r = random.Random(2)
    words = [r.choice("abc") * r.randint(1, 9) for _ in range(4000)]
    whole = hyperminhash.shingle_hashes(" ".join(words))
    assert len(whole) == len(shingles(" ".join(words)))
    monkeypatch.setattr(hyperminhash, "_CHUNK", 700)
    assert (hyperminhash.shingle_hashes(" ".join(words)) == whole).all()
    words[100], words[101], words[3000] = "z" * 5000, "y" * 300, "x" * 690
    assert len(hyperminhash.shingle_hashes(" ".join(words))) == len(shingles(" ".join(words)))


def test_long_repeats_of_two_letters_differ():
    # Powers modulo 2^64 give the Thue-Morse word and its complement one sum.
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - x for x in bits]
    x, y = ("".join("ab"[v ^ k] for v in bits) for k in (0, 1))
    assert hyperminhash.shingle_hashes(x) != hyperminhash.shingle_hashes(y)


@pytest.mark.parametrize("percent", [20, 50, 80, 85, 95, 99, 100])
def test_bands_hold_the_threshold(percent):
    bands, size = hyperminhash.banding(percent)
    assert bands * size <= hyperminhash.BUCKETS and (1 - (percent / 100) ** size) ** bands <= 4.5e-7
    assert percent != 85 or (bands, size) == (25, 5)
    with pytest.raises(ValueError):
        hyperminhash.banding(5)


def test_pipeline_links_at_80_percent(spark):
    texts = []
    for i in range(30):
        words = [f"w{i}x{j}" for j in range(50)]
        near, far = words[:], words[:]
        near[20] = "other"  # 41 of 51 shingles are shared
        far[10] = far[30] = "other"  # 36 of 56
        texts += [" ".join(words), " ".join(near), " ".join(far)]
    kept = corpus_pipeline.stage_near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(90) if i % 3 != 1]


def test_pipeline_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (3, b), (3, a), (2, b), (7, c), (1, c), (5, None), (5, ""), (None, a), (None, a)]
    kept = corpus_pipeline.stage_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    want = [(3, a), (2, b), (1, c), (5, None), (5, ""), (None, a), (None, a)]
    assert kept.columns == ["doc_id", "text"] and sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, want))


def test_registers_estimate_similarity():
    r = np.random.default_rng(3)
    for n, share in ((20, 0.9), (400, 0.6), (5000, 0.85)):
        agree = []
        for _ in range(30):
            both = r.integers(0, 2**64, int(n * share), dtype=np.uint64)
            own = [r.integers(0, 2**64, n - len(both), dtype=np.uint64) for _ in range(2)]
            x, y = (hyperminhash.registers(np.unique(np.concatenate([both, o]))) for o in own)
            agree.append((x == y).mean())
        true = len(both) / (2 * n - len(both))
        assert abs(float(hyperminhash.estimate(np.array([np.mean(agree)]), np.array([n]))[0]) - true) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (9, 9)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert connected(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, leaf", [(2048, 128), (7, 3)])
def test_vectors_against_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(ego_join, "BLOCK", block)
    monkeypatch.setattr(ego_join, "LEAF", leaf)
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 12))
    rows = [(centers[i % 6] + r.normal(size=12) * 0.25).tolist() for i in range(120)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 12, None, [float("nan")] * 12, [1.0] * 3, [1.0, 1.0, 1.1], [None] * 12]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)] + [(None, rows[0], "x")], "vec_id long, embedding array<double>, n_links string").repartition(3)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    link = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9] for i in good}
    part = {}
    for i in sorted(good):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in part:
                part[j] = part.get(i, i)
                todo += link[j]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in ego_join.near_vectors(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (len(link.get(i, [])), part.get(i, i), part.get(i, i) == i) for i in range(len(rows))}
    assert ego_join.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_one_id_and_far_clusters(spark, monkeypatch):
    r = np.random.default_rng(9)
    a, b = r.normal(size=8), r.normal(size=8)
    rows = [(1, a.tolist()), (1, b.tolist()), (2, (a * 3).tolist()), (3, (-0.0 * a).tolist()), (4, b.tolist()), (5, [-0.0, 1.0] + [0.0] * 6), (6, [0.0, 1.0] + [0.0] * 6)]
    c, d = r.normal(size=8), r.normal(size=8)
    rows += [(15, c.tolist()), (15, d.tolist()), (10, d.tolist()), (19, c.tolist())]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in ego_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 1), (5, 1, 5), (6, 1, 5), (10, 1, 10), (15, 1, 10), (15, 1, 10), (19, 1, 10)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= int(before)
    # Of clusters that the leading directions tell apart, pairs of intervals are skipped.
    seen = []
    keep = ego_join._pairs_within
    monkeypatch.setattr(ego_join, "_pairs_within", lambda *x: seen.extend(y := list(keep(*x))) or y)
    centres = np.eye(6)
    points = np.concatenate([c + r.normal(size=(200, 6)) * 0.02 for c in centres])
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    side = {"cls": np.arange(1200), "weight": np.ones(1200, int), "sizes": np.full(1200, 6), "units": units, "coords": units}
    found = ego_join._links(side, side, True, 0.9, math.sqrt(0.2))
    assert (found[2] == 199).all() and len(found[0]) == 1200
    assert sum((s.stop - s.start) * (t.stop - t.start) for s, t in seen) < 0.5 * 1200 * 1200 / 2


PAGE = """<html><head><title>Title</title><style>p{}</style></head><body class="home"><header><p>Site name</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="cookie-notice"><p>We use cookies, a long notice about them. Really long.</p></div>
<div id="content"><article><h1>Head&amp;line</h1><p>First &lt;para&gt; with <b>bold</b>ness and&nbsp;space.<p>Second<br>line<script>var a = "<p>no</p>";</script></p>
<form><p>Send us your mail</p></form><p hidden>secret</p></article></div><aside class="sidebar"><p>Related stories you may like very much, indeed.</p></aside>
<section id="comments"><article class="comment"><p>A reader says: this is a nice long comment.</p></article></section><footer><p>(c) us</p></footer>"""


def test_page():
    assert html_mincut.main_text(PAGE) == "Head&line First <para> with boldness and space. Second line"


def test_page_without_article():
    text = "This is a sentence of some length, as articles have them. " * 4
    page = f"<body><div class=menu><a href=x>One</a> <a href=y>Two</a></div><div><p>{text}</p><p>{text}</p></div><div class='footer'>imprint</div>"
    assert html_mincut.main_text(page) == " ".join([text.strip()] * 2)


SENTENCES = "This is a sentence of some length, as articles have them. " * 4


@pytest.mark.parametrize("names", ["class='content has-sidebar'", "id='post-4ad2'", "class='main-content no-comments'", "class='content sidebar-right'", "data-id='ad-1'", "data-hidden='false'", "data-class=sidebar"])
def test_names_do_not_hide_an_article(names):
    page = f"<body><div class=menu><a href=x>One</a> <a href=y>Two</a></div><div {names}><p>{SENTENCES}</p><p>{SENTENCES}</p></div><div class='footer'>imprint</div>"
    assert html_mincut.main_text(page) == " ".join([SENTENCES.strip()] * 2)


@pytest.mark.parametrize("names", ["class='sidebar'", "id=comments", "class='cookie-notice'", "class='post-comments'", "class='shareBox'", "hidden", "style='display: none'"])
def test_names_of_furniture(names):
    page = f"<body><article><p>{SENTENCES}</p><p>{SENTENCES}</p><div {names}><p>{SENTENCES} x</p><p>{SENTENCES} y</p></div></article>"
    assert html_mincut.main_text(page) == " ".join([SENTENCES.strip()] * 2)


def test_text_that_stays():
    page = f"<article><p>{SENTENCES} See <a href='/hidden-gems'>gems</a> and <math><mi>x</mi><mo>=</mo><msup><mn>2</mn></msup></math>.</p><object><p>{SENTENCES}</p></object></article>"
    assert html_mincut.main_text(page) == f"{SENTENCES.strip()} See gems and x=2. {SENTENCES.strip()}"
    assert "Label" in html_mincut.main_text(f"<article><p>{SENTENCES}</p><svg><title>t</title><text>Label</text></svg><p>{SENTENCES}</p></article>")


@pytest.mark.parametrize("block", ['<h2 class="section-header">Odd heading</h2>', '<div class="page-text search-results"><p>Odd paragraph, with a stop.</p></div>', '<p class="skip-lines">Odd lines</p>', '<p class="legal">Odd law</p>', '<ul><li><a href="/x">Odd link</a></li></ul>', "<p>Odd</p>"])
def test_odd_blocks_of_an_article_stay(block):
    page = f"<body><nav><a href=x>One</a></nav><article><h1>Title here</h1><p>{SENTENCES}</p>{block}<p>{SENTENCES}</p></article><footer>imprint, as ever</footer>"
    text = html_mincut.main_text(page)
    assert "Odd" in text and text.startswith("Title here") and "One" not in text and "imprint" not in text


def test_the_cut_overturns_the_classifier():
    page = f"<body><div><p>{SENTENCES}</p><p>Short words</p><p>{SENTENCES}</p></div><div><a href=a>Go on</a><a href=b>More</a> of it.</div></body>"
    blocks = html_mincut.blocks_of(page)
    odds = html_mincut.Classifier()(html_mincut.features(blocks))
    labels = html_mincut.label(blocks)
    assert [x > 0 for x in odds] != labels and labels[:3] == [True, True, True] and odds[1] < 0
    assert abs(odds).max() <= html_mincut.CAP and sum(c for a, b, c in html_mincut.smoothness(blocks) if 1 in (a, b)) > 100 * abs(odds[1])


def random_page(r):
    def part(depth):
        kind = r.choice(["p", "div", "ul", "nav", "article", "aside", "h2", "section", "header"])
        if depth > 2 or r.random() < 0.4:
            words = " ".join(r.choice(["word", "of", "text,", "end."]) for _ in range(r.choice([1, 3, 12, 40])))
            return f"<p class='{r.choice(['', 'ad', 'main-text', 'legal'])}'>{words}</p>" if r.random() < 0.7 else f"<a href=x>{words}</a>"
        return f"<{kind} class='{r.choice(['', '', 'sidebar', 'post', 'comments'])}'>" + "".join(part(depth + 1) for _ in range(r.randint(1, 3))) + f"</{kind}>"

    return "".join(part(0) for _ in range(r.randint(1, 4)))


def test_whole_pages_against_all_labellings():
    r = random.Random(12)
    tried = 0
    while tried < 60:
        blocks = html_mincut.blocks_of(random_page(r))
        if not 2 <= len(blocks) <= 11:
            continue
        tried += 1
        odds = [round(100 * x) for x in html_mincut.Classifier()(html_mincut.features(blocks)).tolist()]
        edges = html_mincut.smoothness(blocks)
        cost = lambda on: sum(max(0, -o) if k else max(0, o) for o, k in zip(odds, on)) + sum(c for a, b, c in edges if on[a] != on[b])
        labels = html_mincut.label(blocks)
        best = min(map(cost, itertools.product([False, True], repeat=len(blocks))))
        assert cost(labels) == best
        assert sum(labels) == min(sum(on) for on in itertools.product([False, True], repeat=len(blocks)) if cost(on) == best)


def test_fit_holds_on_pages_without_markup(spark):
    r = random.Random(4)
    sentence = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor"]) for _ in range(n)) + "."
    pages, wrong = [], [0, 0]
    for i in range(60):
        menu = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(5))
        body = "".join(f"<p>{sentence(r.choice([2, 3, 30, 60]))[:-1]}</p>" for _ in range(6))
        pages.append((i, "u", f"<html><body><nav><ul>{menu}</ul></nav><article><h1>Head {i}</h1>{body}</article><footer>Some imprint</footer></body></html>"))
    classifier = html_mincut.train(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert not np.allclose(classifier.weights, html_mincut.Classifier().weights)
    for _, _, page in pages:
        want = [b.element.article for b in html_mincut.blocks_of(page)]
        for name in ("nav", "article", "footer"):
            page = page.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
        blocks = html_mincut.blocks_of(page)
        wrong[0] += sum((x > 0) != w for x, w in zip(classifier(html_mincut.features(blocks)), want))
        wrong[1] += sum(x != w for x, w in zip(html_mincut.label(blocks, classifier), want))
    assert wrong[1] <= wrong[0] <= 60  # the imprint looks like a short paragraph


def test_malformed_pages_take_linear_time():
    import time

    for page in ("<b " * 340_000, "<b>" * 150_000 + "<p></p>" * 50_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 90_000 + "</section>" * 90_000 + "x", '<a title="' * 100_000 + ">", "<!--" * 250_000, "<script>" * 100_000, "<a b='>" * 100_000, "<x ='" * 200_000):
        start = time.process_time()
        html_mincut.main_text(page)
        assert time.process_time() - start < 4, page[:20]


def test_unclosed_tags_and_quotes():
    assert html_mincut.main_text("<article><p title=\"a>b\">Text with words, and stops. More of it follows here, so that it is long.</p></article>").startswith("Text with words")
    assert html_mincut.main_text("<article><p don't>Text with words, and stops. It isn't over: more of it follows.</p></article>").startswith("Text with words")
    assert html_mincut.main_text("<article><p>" + SENTENCES + " a < b and 1 <2").endswith("a < b and 1 <2")


def test_minimum_cut_against_all_labellings():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 7)
        s, t = ([r.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(a, b, r.randint(0, 6)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(12)) if a != b]
        cost = lambda on: sum(t[i] if on[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if on[a] != on[b])
        assert cost(html_mincut.min_cut(s, t, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<p>open <b>and <i>wrong</p></b>" + "<div>" * 3000, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_mincut.extract_text(df).collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[None].n_chars == 0 and len(got) == 4
    assert [r.text for r in html_mincut.extract_text(df).collect() if r.page_id == 1] == [html_mincut.main_text(PAGE)] * 2
    assert html_mincut.extract_text(df.limit(0)).count() == 0


def test_licenses(spark):
    texts = [None, "", "x\nReleased under the MIT License.\ny", "mit license under the", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. Licensed under the Apache License Version 2", "This work is licensed under the GNU General Public License, version 3.", "Permission to use, copy,\nmodify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "under the mit\nlicense " * 3000, "A Creative Commons Attribution 4.0 International License: this work is licensed under it", "Released under the BSD License"]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert [got[i].labels for i in range(len(texts))] == ["", "", "mit", "mit", "cc-by-nc", "apache-2", "gpl-3", "isc", "mit", "cc-by", "bsd"]
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 3, 11) and got[8].n_base == 3000 and got[0].n_words == 0
    assert got[2].base_labels == "mit" and got[6].base_labels == "" and got[6].score == 1.0
    spans = license_scan.license_blocks(frame(spark, texts)).filter("doc_id = 2").collect()
    assert {texts[2].encode()[r.first_byte : r.first_byte + r.n_bytes] for r in spans} == {b"Released under the MIT License.", texts[2].encode()}
    assert license_scan.license_scan(frame(spark, texts).limit(0)).count() == 0


def brute_join(text, threshold=0.8):
    """Labels of the best templates of each block, and all (label, share) that meet one."""
    out, met = set(), []
    for part in license_scan._BLANK.split(text.encode().translate(license_scan._WORD_BYTES)):
        for block in [part, *part.split(b"\n")] if b"\n" in part else [part]:
            words = set(block.split())
            shares = []
            for label, template in license_scan.TEMPLATES:
                t = set(license_scan.words_of(template))
                if len(words & t) >= threshold * len(t) - 1e-9:
                    shares.append((len(words & t) / len(t), len(words & t), label))
            out |= {x[2] for x in shares if x[:2] == max(shares)[:2]}
            met += [(x[0], x[2]) for x in shares]
    return ",".join(sorted(out)), sorted(met)


def test_license_rows_without_ids_and_long_texts(spark):
    filler = "\n".join(f"line {i} of some words" for i in range(20_000))
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 200)
    df = spark.createDataFrame([(None, mit, 1), (7, f"{filler}\n\n{mit}\n\n{filler}", 2), (7, None, 3), (7, None, 3)], "doc_id long, text string, labels int")
    got = sorted((str(r.doc_id), r.labels, r.n_words) for r in license_scan.license_scan(df).collect())
    n = len(license_scan.words_of(mit))
    assert got == [("7", "", 0), ("7", "", 0), ("7", "mit", n + 200_000), ("None", "mit", n)]


def test_filters_lose_nothing(spark):
    r = random.Random(8)
    vocabulary = sorted({w.decode() for _, t in license_scan.TEMPLATES for w in license_scan.words_of(t)})
    texts = []
    for _ in range(150):
        words = r.choice(license_scan.TEMPLATES)[1].split()
        r.shuffle(words)
        words = [w for w in words if r.random() < 0.9] + r.choices(vocabulary, k=r.randint(0, 6))
        texts.append("\n".join([" ".join(words), r.choice(["", "x"]), " ".join(r.choices(vocabulary, k=5))]))
    got = {x.doc_id: x.labels for x in license_scan.license_scan(frame(spark, texts), phrases=[]).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_join(t)[0] for t in texts]
    blocks = license_scan.license_blocks(frame(spark, texts)).collect()
    for i, t in enumerate(texts):
        assert sorted((r.share, r.label) for r in blocks if r.doc_id == i) == brute_join(t)[1]
    assert all((r.rank > 1) or (r.share == max(x.share for x in blocks if (x.doc_id, x.first_byte, x.n_bytes) == (r.doc_id, r.first_byte, r.n_bytes))) for r in blocks)


def brute_counts(text):
    import re

    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    r = random.Random(9)
    return [None, "", " ", "a", "a a a a", "a\n\na\n \nb#|", "🙂 é\x0bx\x0c#", *(" ".join(r.choice("abcd") for _ in range(r.randint(1, 90))) for _ in range(60)), "the quick brown fox jumps " * 20, "\n".join(["gleich"] * 60)]


def test_quality_counts(spark):
    texts = quality_texts()
    rows = quality_rules.quality_rules(frame(spark, texts)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.quality_rules(frame(spark, texts).limit(0)).count() == 0
    assert {r.doc_id for r in quality_rules.drop_rejected(frame(spark, texts)).collect()} == {r.doc_id for r in rows if r.kept}


def test_quality_of_null_ids_and_repeated_rows(spark):
    good = " ".join(f"word{i}, w{i}" for i in range(60))
    df = spark.createDataFrame([(None, good, 1), (3, good, 2), (3, good, 2), (4, None, 3)], "doc_id long, text string, n_words int")
    assert sorted((str(r.doc_id), r.kept) for r in quality_rules.quality_rules(df).collect()) == [("3", True), ("3", True), ("4", False), ("None", True)]
    kept = quality_rules.drop_rejected(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "None"]
    assert quality_rules.drop_rejected(df.limit(0)).count() == 0


def test_very_long_text(spark):
    words = [f"{i % 7}x{i}" for i in range((1 << 20) + 200)]
    words[5:8] = words[-3:] = ["a", "b", "c"]
    row = quality_rules.quality_rules(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), rules=[]).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (len(words), 6, True)


BAD = {
    "few_letters": " ".join(f"{i}. word{i} = {i}" for i in range(60)),
    "one_word": " ".join(f"the w{i} the x{i} y{i}" for i in range(60)),
    "few_distinct_words": " ".join(random.Random(3).choices([a + b for a in "pqrst" for b in "uvwxy"], k=900)),
    "cut_off_lines": "\n".join(f"l{i} a{i} b{i} c{i} d{i} ..." for i in range(20)),
    "listed_lines": "\n".join(f"- item{i} of{i} list{i} y{i}" for i in range(20)),
}


def test_each_rule_rejects_alone(spark):
    texts = [*BAD.values(), " ".join(f"word{i}, w{i}" for i in range(60))]
    counted = quality_rules.measured(frame(spark, texts))
    alone = [quality_rules.verdict([quality_rules.Measured(r, 1.0, 1.0)]).alias(r.name) for r in quality_rules.RULES]
    got = {r["__id"]: [x for x in r[1:] if x] for r in counted.select("__id", *alone).collect()}
    assert got == {i: [name] for i, name in enumerate(BAD)} | {len(BAD): []}


def test_the_order_saves_work_and_changes_no_result(spark):
    from pyspark.sql import functions as F

    df = spark.range(600).select(F.concat(F.lit("x "), F.col("id").cast("string")).alias("t"), F.col("id")).repartition(1)
    slow = quality_rules.Rule("slow", "size(filter(sequence(1, 15000), i -> sha2(concat(t, i), 256) = 'x')) > 0")
    quick = quality_rules.Rule("quick", "id % 10 < 9")
    import time

    def run(order):
        chosen = [quality_rules.Measured(r, 1.0, 0.5) for r in order]
        start = time.perf_counter()
        rows = sorted(r.id for r in quality_rules.cascade(df, list(order), chosen).filter("rejected_by is null").collect())
        return rows, time.perf_counter() - start

    run((quick, slow))
    good, bad = run((quick, slow)), run((slow, quick))
    assert good[0] == bad[0] and len(good[0]) == 60 and good[1] < 0.7 * bad[1]
    small = df.limit(40)
    found = quality_rules.order_rules(small, [slow, quick], 40, repeats=20)
    assert [m.rule.name for m in found] == ["quick", "slow"]
    assert found[1].cost > 5 * found[0].cost


def test_cascade_order(spark):
    df = spark.range(200)
    rules = [quality_rules.Rule("never", "id < 0"), quality_rules.Rule("often", "id % 2 = 0"), quality_rules.Rule("null", "cast(null as boolean)")]
    order = quality_rules.order_rules(df, rules)
    assert order[0].rule.name == "often" and abs(order[0].rejection - 0.5) < 1e-9
    assert quality_rules.cascade(df, rules, order).filter("rejected_by is null").count() == 100
    assert [m.rejection for m in quality_rules.order_rules(df.limit(0), rules)] == [0, 0, 0]


def toxic_texts(n, seed):
    r = random.Random(seed)
    texts, marks = [], []
    for _ in range(n):
        words = [f"w{int(r.paretovariate(0.5)) % 4000}" for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.3
        for _ in range(r.randint(2, 8) * bad):
            words.insert(r.randrange(len(words)), r.choice(["vile", "nasty.", "Grimlon", "grimlask", "grimlett"]))
        texts.append(" ".join(words))
        marks.append(int(bad))
    return texts, marks


def test_toxicity(spark):
    texts, marks = toxic_texts(700, 1)
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds)
    held, truth = toxic_texts(300, 2)
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, [*held, None, ""]), model).collect()}
    right = sum(got[i].toxic == bool(m) for i, m in enumerate(truth))
    assert right >= 290 and not got[300].toxic and not got[301].toxic
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in got.values())
    many, few = model.score("vile nasty grimlon grimlask grimlett"), model.score("vile nasty")
    assert many > few > model.score("gut")
    kept = toxicity.drop_toxic(frame(spark, held), model)
    assert kept.columns == frame(spark, held).columns and kept.count() == sum(not got[i].toxic for i in range(300))
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels).weights == {} and not toxicity.toxicity(docs, toxicity.Model()).filter("toxic").count()


def language(n, seed=3):
    r = random.Random(seed)
    return [" ".join(f"the n{r.randrange(30)} of a n{r.randrange(30)} is big ." for _ in range(r.randint(3, 30))) for _ in range(n)]


def test_toxicity_of_odd_rows(spark):
    texts, marks = toxic_texts(700, 1)
    texts[0] = " ".join(["vile nasty"] + [f"long{i}" for i in range(9000)])
    rows = [(i, t, 1.0, "a") for i, t in enumerate(texts)] + [(0, texts[0], 2.0, "b"), (0, "another text", 2.0, "b"), (None, "vile nasty grimlon", 0.0, "c"), (None, None, 0.0, "d"), (9000, "", 0.0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, train_chars=2000)
    out = toxicity.toxicity(docs, model)
    assert out.columns == ["doc_id", "score", "p_toxic", "severity", "toxic"] and out.count() == len(rows)
    by_hand = {t: model.score(t or "") for _, t, _, _ in rows}
    assert sorted(r.score for r in out.collect()) == pytest.approx(sorted(by_hand[t] for _, t, _, _ in rows))
    for r in out.collect():
        p = [1 / (1 + math.exp(k - r.score)) for k in model.thresholds]
        assert r.severity == pytest.approx(sum(p)) and r.p_toxic == pytest.approx(p[0]) and r.toxic == (p[0] >= 0.5)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 9000").count() == 1
    assert toxicity.drop_toxic(docs.limit(0), model).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocabulary = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in "mnprst"]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts, marks = [], []
    for i in range(400):
        words = fresh(r.randint(60, 120))
        bad = i % 4 == 0
        for _ in range(6 * bad):
            words.insert(r.randrange(len(words)), r.choice(["vile", "nasty", "grimlon"]))
        texts.append(" ".join(words))
        marks.append(int(bad))
    base = fresh(100)
    near, far = base[:], base[:]
    near[50] = "other"
    for k in (10, 30, 50, 70, 90):
        far[k] = "other"
    texts += [" ".join(base), " ".join(near), " ".join(far), " ".join(base), None, "", "too short", "# # # " * 40 + " ".join(fresh(60)), "x y z " * 40]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1), (None, " ".join(fresh(70)), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)))
        assert name == "packing" or frames[-1].columns == frames[0].columns
    kept = [sorted(((str(x.doc_id), x.text) for x in f.collect()), key=str) for f in frames[:-1]]
    model = toxicity.train(frames[0], spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = lambda t: 1 / (1 + math.exp(model.thresholds[0] - model.score(t or ""))) < 0.5
    assert kept[1] == [x for x in kept[0] if clean(x[1])] and len(kept[1]) < len(kept[0]) - 90

    def good(t):
        n, chars, symbols, _, repeated = brute_counts(t)
        return n >= 50 and 100 * repeated <= 40 * n and 100 * symbols <= 15 * n and 2 * n <= chars <= 15 * n

    assert kept[2] == [x for x in kept[1] if good(x[1])] and len(kept[1]) - len(kept[2]) == 5
    gone = []
    for i, (a, x) in enumerate(kept[2]):
        s = shingles(x)
        for b, y in kept[2][:i] + kept[2][i + 1 :]:
            both = len(s & shingles(y))
            if a != "None" and b != "None" and 100 * both >= 80 * len(s | shingles(y)) and (int(b), y) < (int(a), x):
                gone.append((a, x))
                break
    left = [x for x in kept[2] if x not in gone or kept[3].count(x)]
    assert len(gone) == 2 and kept[3] == sorted({*left}, key=str)
    packed = [(str(r.doc_id), r.doc_tokens) for r in frames[-1].filter("start = 0").collect()]
    assert sorted(x for x, _ in packed) == sorted(x for x, _ in kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0").count() == len(packed)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pseudo_likelihood(spark):
    texts = language(250)
    mixed = texts[0].split()
    random.Random(1).shuffle(mixed)
    texts += [None, "  ", texts[0], " ".join(mixed), "zz yy xx"]
    df = spark.createDataFrame([(i if i != 5 else None, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, pll string").repartition(3)
    got = {x.doc_id: x for x in pseudo_likelihood.pseudo_likelihood(df).collect()}
    assert len(got) == len(texts) and got[None].n_tokens == len(texts[5].split())
    assert got[250].n_tokens == 0 and got[250].pll == 0 and got[250].mean_logp is None and got[251].n_tokens == 0
    assert abs(got[0].pll - got[252].pll) < 1e-3 and got[0].n_tokens == len(texts[0].split())
    assert got[0].mean_logp > got[253].mean_logp + 0.5
    assert got[254].n_alone == 3 and got[0].n_alone == 0
    assert pseudo_likelihood.pseudo_likelihood(df.limit(0)).count() == 0


def brute_pll(texts, words, classes, net, counts):
    """Of each text: the sum of log P(branch) + log P(leaf | branch) + log P(word | leaf), number by number."""
    p = [x.astype(float) for x in net.parts]
    result = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        codes = [0, 0, *map(words.leaf, ws), 0, 0]
        total = 0.0
        for i, w in enumerate(ws):
            l2, l1, r1, r2 = classes.outer[codes[i]], classes.inner[codes[i + 1]], classes.inner[codes[i + 3]], classes.outer[codes[i + 4]]
            h = np.tanh(p[0][l2] + p[1][l1] + p[2][r1] + p[3][r2] + p[4])
            g = np.tanh(p[5][l1] + p[6][r1] + p[7])
            branch, k = divmod(codes[i + 2], words.width)
            for z, at in ((h @ p[8] + p[9], branch), (g @ p[10][branch] + p[11][branch, 0], k)):
                total += z[at] - math.log(np.exp(z - z.max()).sum()) - z.max()
            if w not in words.own:
                of_leaf = codes[i + 2]
                here = ws.count(w)
                total += math.log(counts[w] - here + 0.1) - math.log(words.mass[of_leaf] - here + 0.1 * (words.types[of_leaf] + 1))
        result.append(total)
    return result


@pytest.mark.parametrize("width", [64, 4])
def test_pseudo_likelihood_by_hand(spark, monkeypatch, width):
    monkeypatch.setattr(pseudo_likelihood, "WIDTH", width)
    monkeypatch.setattr(pseudo_likelihood, "HELD", 4)  # of the driver: 64 words are held at most, the others are joined
    r = random.Random(5)
    texts = [f"{t} {' '.join(f'x{r.randrange(400)}' for _ in range(9))}" for t in language(60)] + [None, "", "alone alone again", "été 🙂", "q"]
    rows = pseudo_likelihood.text_rows(frame(spark, texts), "doc_id", "text")
    pseudo_likelihood.bound_batches(spark)
    words, counts = pseudo_likelihood.lexicon(rows)
    table = pseudo_likelihood.coded(rows, words, "bigint")
    classes = pseudo_likelihood.classes_of(table, words)
    first, second = pseudo_likelihood.count_windows(table, words, classes)
    net = pseudo_likelihood.train(first, second)
    got = {x["__id"]: x for x in pseudo_likelihood.scored(table, counts, words, classes, net, "bigint").collect()}
    tokens = [(t or "").encode().lower().split() for t in texts]
    n = {bytes(x.word): x.n for x in counts.collect()}
    assert n == dict(Counter(w for ws in tokens for w in ws))
    assert words.mass.sum() == sum(n.values()) and words.types.sum() == len(n) and (width == 64 or len(words.held) <= 64 < len(n))
    # Every window of every text is trained on, once.
    want_first, want_second = np.zeros_like(first), np.zeros_like(second)
    for ws in tokens:
        codes = [0, 0, *map(words.leaf, ws), 0, 0]
        for i in range(len(ws)):
            l2, l1, r1, r2 = classes.outer[codes[i]], classes.inner[codes[i + 1]], classes.inner[codes[i + 3]], classes.outer[codes[i + 4]]
            branch, k = divmod(codes[i + 2], words.width)
            want_first[((l1 * 16 + r1) * 8 + l2) * 8 + r2, branch] += 1
            want_second[l1 * 16 + r1, branch, k] += 1
    assert (first == want_first).all() and (second == want_second).all()
    want = brute_pll(texts, words, classes, net, n)
    assert all(abs(got[i].pll - want[i]) < 1e-3 * (1 + abs(want[i])) for i in range(len(texts)))
    assert [got[i].n_alone for i in range(len(texts))] == [sum(n[w] == ws.count(w) for w in ws) for ws in tokens]


def test_repeated_texts_are_told_apart(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice(["the", "of", "and", f"w{r.randrange(10**6)}"]) for _ in range(120)) for _ in range(150)]
    texts += texts[:20]
    got = {x.doc_id: x for x in pseudo_likelihood.pseudo_likelihood(frame(spark, texts)).collect()}
    twice, once = [*range(20), *range(150, 170)], range(20, 150)
    assert all(got[i].n_alone == 0 for i in twice) and all(got[i].n_alone > 0 for i in once)
    assert np.mean([got[i].mean_logp for i in twice]) > np.mean([got[i].mean_logp for i in once]) + 0.3


def test_context_helps_on_texts_kept_out(spark):
    pseudo_likelihood.bound_batches(spark)
    rows = pseudo_likelihood.text_rows(frame(spark, language(400)), "doc_id", "text")
    words, _ = pseudo_likelihood.lexicon(rows)
    table = pseudo_likelihood.coded(rows, words, "bigint")
    classes = pseudo_likelihood.classes_of(table, words)
    seen = pseudo_likelihood.count_windows(table, words, classes)
    other = pseudo_likelihood.coded(pseudo_likelihood.text_rows(frame(spark, language(40, 99)), "doc_id", "text"), words, "bigint")
    kept_out = pseudo_likelihood.count_windows(other, words, classes)
    assert pseudo_likelihood.train(*seen).loss(*kept_out) < pseudo_likelihood.train(*seen, steps=0).loss(*kept_out) - 0.8


def test_tree_grows_with_the_vocabulary():
    assert pseudo_likelihood.tree_width(0) == pseudo_likelihood.tree_width(10**6) == 64
    assert pseudo_likelihood.tree_width(16 * 10**6) == 128 and pseudo_likelihood.tree_width(10**9) == 359


def test_word_hash_is_that_of_the_engine(spark):
    from pyspark.sql import functions as F

    words = [b"", b"a", "é".encode(), b"x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w binary").select("w", F.xxhash64("w").alias("h")).collect()
    assert {bytes(x.w): x.h for x in got} == {w: pseudo_likelihood.word_hash(w) for w in words}


def test_network_scores_are_probabilities():
    net, r = pseudo_likelihood.Network(8), np.random.default_rng(1)
    for p in net.parts:
        p[:] = r.normal(size=p.shape)
    first, second = net.log_probabilities()
    assert np.allclose(np.exp(first).sum(1), 1, atol=1e-4) and np.allclose(np.exp(second.reshape(256, 8, 8)).sum(2), 1, atol=1e-4)


def test_gradient_is_that_of_the_loss():
    net, r = pseudo_likelihood.Network(4), np.random.default_rng(1)
    net.parts = [r.normal(size=p.shape) for p in net.parts]
    first, second = r.random((256 * 64, 4)), r.random((256, 4, 4))
    second *= first.sum() / second.sum()
    total = first.sum()
    grads = net.gradient(first / total, (second / total).transpose(1, 0, 2))
    for p, g in zip(net.parts, grads):
        at = tuple(r.integers(0, n) for n in p.shape)
        keep = p[at]
        sides = []
        for step in (1e-4, -1e-4):
            p[at] = keep + step
            sides.append(net.loss(first, second))
        p[at] = keep
        assert abs((sides[0] - sides[1]) / 2e-4 - g[at]) < 1e-4 * (1 + abs(g[at]))
