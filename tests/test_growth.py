"""What must not grow faster than the input: comparisons of near copies, parsing of equal texts, shuffles of segments."""

from itertools import combinations

from juriloom.operators import chunking, dedup, graph, legal, rerank
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 20 + [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(60)] + [" ".join(f"v{k}{i % 7}" for k in range(i, i + 30)) for i in range(40)] + ["", "one", "one", None]
    rows = [(i, "k" if i % 11 else "m", t) for i, t in enumerate(texts)] + [(500, None, texts[0])]
    sets = {}
    for i, block, t in rows:
        w = (t or "").split()
        sets[i] = block, len(w), {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    want = {}
    for a, b in combinations(sorted(sets), 2):
        (x, n, s), (y, m, t) = sets[a], sets[b]
        if x and x == y and s and t and len(s & t) / len(s | t) >= 0.65 and min(n, m) >= 0.15 * max(n, m):
            want[a, b] = round(len(s & t) / len(s | t), 6)
    return spark.createDataFrame(rows, "document_id long, block string, text string"), want


def test_near_copies_are_all_found(spark, monkeypatch):
    docs, want = near_copies(spark)
    monkeypatch.setattr(dedup, "TILE", 16)
    monkeypatch.setattr(dedup, "COPIES", 4)
    got = [(r.a, r.b, round(r.jaccard, 6)) for r in dedup.similar_pairs(docs, "block").collect()]
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want


def test_clusters_do_not_compare_all_pairs(spark, monkeypatch):
    docs, want = near_copies(spark)
    checked, seen = dedup.Near.checked, []
    monkeypatch.setattr(dedup.Near, "checked", lambda self, pairs: (seen.append(pairs.count()), checked(self, pairs))[1])
    got = {r.id: r.cluster for r in dedup.similar_clusters(docs, "block").collect()}
    least = {i: i for pair in want for i in pair}
    for _ in least:
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least and sum(seen) < len(want) / 3


def test_equal_titles_and_statements_are_parsed_once(spark):
    docs = spark.createDataFrame([(str(i), "Loi n° 1/2 du 3 mai 1990", "", i) for i in range(4)], "document_id string, title string, duplicate_of string, ord int").withColumn("present", F.lit(True))
    text = plan(legal.parsed_titles(docs))
    assert "Aggregate [__title" in text[text.index("ArrowEvalPython") :]
    assert plan(dedup.title_groups(docs)).count("ArrowEvalPython") == 1
    assert dedup.title_groups(docs).first().ids == ["0", "1", "2", "3"]
    chunks = docs.select("document_id", F.lit("L'article 1 de la Loi n° 5 est modifié.").alias("content"), F.lit("1").alias("article_number"), "ord")
    own = docs.select("document_id", F.lit("Loi").alias("instrument_type"), F.lit("1/2").alias("number_key"))
    text = plan(graph.article_edges(chunks, own))
    assert "Aggregate [" in text[text.index("ArrowEvalPython") :] and graph.article_edges(chunks, own).count() == 4


def test_segments_are_made_in_their_row(spark):
    docs = spark.createDataFrame([("a", "## Page 1\nArticle 1 un\n## Page 2\nsuite\n## Page 3\nANNEXES\nx\n## Page 4\ny Article 2 deux")], "document_id string, text string")
    out = chunking.chunks(docs)
    assert "Window" not in plan(out) and "Sort" not in plan(out)
    assert [(r.ord, r.locator, r.article_number) for r in out.orderBy("ord").collect()] == [(1, "Page 1", "1"), (2, "Page 2", "1"), (3, "Page 3", None), (4, "Page 4", None), (5, "Page 4", "2")]


def test_places_of_a_preview_are_walked_once(spark):
    docs = spark.createDataFrame([("ß" * 300 + " trash " + "a" * 900,)], "t string")
    out = docs.select(rerank.preview(F.col("t"), ["trash", "idiot"]).alias("p"))
    assert plan(out).count("aggregate(split") == 1 and "trash" in out.first().p and len(out.first().p) == 900
