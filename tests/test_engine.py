import datetime

import pytest
from pyspark.sql import functions as F

from juriloom.functions import text as T
from juriloom.operators import assemble, chunking, dedup, fts, graph, history, legal, rerank, resolve, search
from juriloom.plans import answering, indexing, queries
from juriloom.sources import catalog, extract, state
from juriloom.streaming import ingest as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def chunk_rows(spark, text):
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    return [(r.locator, r.content, r.article_number) for r in chunking.chunks(df).orderBy("ord").collect()]


def test_text_before_the_first_heading_is_left_out(spark):
    assert chunk_rows(spark, "kopf\n## Page 3\nUn texte.") == [("Page 3", "Un texte.", None)]
    assert chunk_rows(spark, "Un texte.") == [("Document", "Un texte.", None)]
    assert chunk_rows(spark, "") == []


def test_articles_inside_a_page_and_carried_over(spark):
    rows = chunk_rows(spark, "## Page 1\nPréambule. Article 1er : un. Article 33 : deux.\n## Page 2\nsuite\n## Page 3\nArticle 12-ter. x")
    assert [(r[0], r[2]) for r in rows] == [("Page 1", None), ("Page 1", "1er"), ("Page 1", "33"), ("Page 2", "33"), ("Page 3", "12 ter")]


def test_structural_headings_end_an_article(spark):
    rows = chunk_rows(spark, "## Page 1\nArticle 88 : x\n## Page 2\nANNEXES\ntableau\n## Page 3\nautre")
    assert [r[2] for r in rows] == ["88", None, None]


def test_parts_of_bounded_size(spark):
    words = "Une phrase de mots. " * 40
    parts = one(spark, chunking.split_parts(F.lit(words + "x" * 250), 100))
    assert all(len(p) <= 100 for p in parts) and "x" * 100 in parts
    rows = chunk_rows(spark, "## Page 1\n" + "Mot. " * 2000)
    assert rows[0][0] == "Page 1, part 1" and rows[-1][0].startswith("Page 1, part ")


def test_question_terms():
    assert fts.match_expression("Quel est le taux de la TVA ?") == '"taux"* OR "tva"*'
    assert fts.search_terms("le la") == ["le", "la"]
    terms = fts.search_terms("revenu locatif dans la partie de l'est, 5 ans d'exonération")
    assert {"orientale", "nord-kivu", "exempt", "cinquième", "location"} <= set(terms) and terms[0] == "orientale"
    assert fts.search_terms("12.5 et 5.5") == ["12", "5", "cinq", "cinquième", "5.5"]


def test_requested_articles(spark):
    asked = lambda q: set(search.of_question(spark, q, search.requested_articles))
    assert asked("articles 31, 32 et 33") == {"31", "32", "33"}
    assert asked("les articles 12 à 14") == {"12", "13", "14"}
    assert asked("Articles premier, 12 bis et 13-quater") == {"1er", "12 bis", "13 quater"}
    assert asked("articles 1 à 50") == {"1", "50"} and asked("rien") == set()
    keyword = lambda q: search.of_question(spark, q, search.informal_code_keyword)
    assert keyword("que dit le Code du Numérique ?") == "numerique" and keyword("aucun texte") is None
    assert keyword("code pour date du numerique") == "pour" and keyword("le code\ndes impôts") == "impots"


def test_folding(spark):
    for x, want in (("Việt", "viet"), ("ﬁn", "fin"), ("Ａé", "ae"), ("й", "и"), ("STRASSE ß", "strasse ss"), ("№ 5…", "no 5..."), ("𝐀", "a")):
        assert one(spark, T.fold(F.lit(x))) == want == T.folded(x)
    assert one(spark, T.strip_accents(F.lit("Éﬁ №"))) == "Efi No" == T.bare("Éﬁ №")


def test_phrases(spark):
    chunks = corpus(spark, [(0, "d", "", "s", "", "p", "alpha beta", None), (1, "d", "", "s", "", "p", "alpha gamma", None), (2, "d", "", "s", "", "p", "aa aa aa", None)])
    assert [r.chunk_id for r in fts.score_scan(chunks, ["alpha be"]).collect()] == [0]
    postings, lengths = fts.build_index(chunks, "chunk_id")
    with pytest.raises(ValueError):
        fts.score_index(postings, lengths, ["alpha beta"], "chunk_id")
    line = T.token_line(F.col("content"))
    assert [r[0] for r in chunks.orderBy("chunk_id").select(fts.occurrences(line, ["aa", "aa"])).collect()] == [0, 0, 2]
    two = fts.score_scans(chunks, [["alpha"], ["aa"], ["none"]], keep=["chunk_id"])
    assert [sorted(r.chunk_id for r in d.collect()) for d in two] == [[0, 1], [2], []]


def test_written_index(spark, tmp_path):
    chunks = corpus(spark, [(i, "d", "t", "s", "", "p", f"mot{i % 7} taux{i}", None) for i in range(60)])
    fts.write_index(*fts.build_index(chunks, "chunk_id"), str(tmp_path))
    postings, lengths = fts.read_index(spark, str(tmp_path))
    a = {r.chunk_id: round(r.score, 9) for r in fts.score_index(postings, lengths, ["mot3", "taux1"], "chunk_id").collect()}
    assert a == {r.chunk_id: round(r.score, 9) for r in fts.score_scan(chunks, ["mot3", "taux1"]).collect()}


def holdings(spark):
    assoc = "Article 1 " + "association " * 12
    rows = [
        ("a", "Loi n° 69-009 du 10 février 1969", "dgi", "DGI", "ready", True, "", "", 20, 1, "petit texte"),
        ("b", "Loi n° 69/009 du 10 février 1969", "dgi", "DGI", "ready", True, "", "", 90, 2, "grand texte"),
        ("c", "Loi n° 69/9 du 10 février 1969", "dgi", "DGI", "error", True, "", "", 900, 3, "fehler"),
        ("d", "Ordonnance-loi n° 23/010 portant code du numérique", "finances", "F", "ready", True, "", "", 500, 4, "long " * 100),
        ("e", "Code du numérique commenté", "dgi", "DGI", "ready", True, "", "", 900, 5, "autre"),
        ("f", "Loi n° 004/2001 du 20 juillet 2001", "dgi", "DGI", "ready", True, "", "", 100, 6, "Vu la loi"),
        ("g", "Loi n° 004/2001 du 20 juillet 2001", "leganet", "L", "ready", True, "", "", 90, 7, assoc),
        ("h", "Code minier", "dgi", "DGI", "ready", True, "remplacé", "", 10, 8, "alt"),
        ("i", "Code minier", "dgi", "DGI", "ready", False, "", "", 10, 9, "weg"),
    ]
    names = "id string, title string, source string, source_label string, status string, present boolean, superseded_note string, duplicate_of string, character_count long, ord long, text string"
    return spark.createDataFrame(rows, names)


def test_named_instruments(spark):
    docs = holdings(spark)
    held, texts = resolve.registry(docs.drop("text")), docs.select("id", "text")
    chunks = corpus(spark, [(1, "d", "Code", "s", "", "Page 1", "données personnelles", "3"), (2, "d", "Code", "s", "", "Page 2", "autre chose", None), (3, "e", "x", "s", "", "Page 1", "données", None)])
    cited = spark.createDataFrame([("a", 1), ("f", 2)], "document_id string, rank int")
    find = lambda q, **k: [(e.mode, e.id) for e in resolve.named_instruments(held, texts, chunks, q, **k)]
    assert find("que dit la Loi n° 69-009 ?") == [("full_text", "b")]
    assert find("et le 69.009, article 4 ?", citations=cited) == [("full_text", "b")] and find("et le 69.009 ?") == []
    assert find("le 31.12.2025", citations=cited) == []
    assert find("le code du numérique") == [("full_text", "d")] and find("le code minier") == []
    assert find("obligations d'une ASBL") == [("full_text", "g")]
    scoped = resolve.named_instruments(held, texts, chunks, "le code du numérique sur les données", cap=50)
    assert scoped[0].mode == "scoped_chunks" and [c.locator for c in scoped[0].chunks][0] == "Page 1"
    block = assemble.focused_reading(scoped)
    assert "[Page 1, Article: 3]" in block and assemble.focused_reading([]) == "" and assemble.search_hints(["a"]).count("- a") == 1


def test_evidence(spark):
    docs = holdings(spark)
    schema = "chunk_id long, document_id string, title string, source string, source_label string, published_date string, locator string, content string, article_number string"
    chunks = spark.createDataFrame([(1, "b", "Loi n° 69/009 du 10 février 1969", "dgi", "DGI", "", "Page 1", "impôt sur les revenus", "3"), (2, "e", "Code", "dgi", "DGI", "2020-01-01", "Page 2", "impôt foncier", None)], schema)
    nodes, edges = graph.build(docs.withColumnRenamed("id", "document_id"))
    store = answering.Corpus(chunks, resolve.registry(docs.drop("text")), docs.select("id", "text"), graph.status(nodes, edges), edges)
    found = answering.evidence(store, "impôt selon la Loi n° 69/009 ?", 2024, turns=["bonjour"])
    assert found.query == "bonjour\nimpôt selon la Loi n° 69/009 ?" and found.context.count("<retrieved_source") == 2
    assert "Inferred document year: 1969" in found.context and "grand texte" in found.focused and "[presumed_in_force]" in found.legal
    assert all(x in found.message for x in (found.context, found.legal, found.focused)) and found.citations.count() == 2
    with pytest.raises(LookupError):
        answering.evidence(store, "zzz", 2024)


def test_dedupe_by_legal_key_and_report(spark):
    base = " ".join(f"mot{i}" for i in range(80))
    rows = [("a", "Loi n° 5/1 du 2 mai 1990", "h1", base + " x y"), ("b", "Loi n° 05/01", "h2", base + " z"), ("c", "Loi n° 5-1", "h3", " ".join(f"w{i}" for i in range(80))), ("d", "Rapport", "h4", base + " q"), ("e", "Un", "h5", "k"), ("f", "Deux", "h5", "k")]
    docs = spark.createDataFrame([(*r, "ready", "s", 10, i, True, "") for i, r in enumerate(rows)], "document_id string, title string, sha256 string, text string, status string, source string, size int, ord int, present boolean, duplicate_of string")
    blocked = dedup.legal_blocks(docs)
    assert {r.block: r.ids for r in dedup.title_groups(docs).collect()} == {"Loi|5/1": ["a", "b", "c"]}
    plan = dedup.dedupe_plan(blocked, ["s"])
    assert {(r["pass"], r.canonical, r.duplicate) for r in plan.collect()} == {(1, "e", "f"), (3, "a", "b")}
    previews, totals = dedup.dedupe_report(blocked, plan)
    got = {r.canonical: (r.type_label, r.number_key, r.duplicate_ids, r.excluded_ids) for r in previews.collect()}
    assert got == {"e": ("Exact match (sha256)", "h5", ["f"], []), "a": ("Loi", "5/1", ["b"], ["c"])}
    assert totals.first().asDict() == {"groups_found": 2, "documents_marked": 2, "documents_excluded": 1}


def test_reply_texts(spark):
    text = lambda x: one(spark, assemble.message_text(F.lit(x)))
    assert text('"un"') == "un" and text('[{"text": "a"}, {"x": 1}, {"text": "b"}]') == "a\nb" and text("5") == "" and text("nichts") == ""
    reply = '{"output": [{"type": "message", "content": [{"annotations": [{"file_id": "f1"}, {"file_id": "f2"}]}, {}]}, {"type": "file_search_call", "results": [{"file_id": "f2"}, {"file_id": "f3"}]}, {"type": "other"}]}'
    assert one(spark, assemble.file_ids(F.lit(reply))) == ["f1", "f2", "f3"] and one(spark, assemble.file_ids(F.lit("{}"))) == []
    cases = spark.createDataFrame([("1", ["Été"], [], ["nein"]), ("2", ["x"], [], [])], "id string, must_contain array<string>, any_of array<string>, must_not_contain array<string>")
    answers = spark.createDataFrame([("1", "un ete")], "id string, answer string")
    assert {r.id: r.passed for r in assemble.golden_run(cases, answers).collect()} == {"1": True, "2": False}


def test_normal_forms(spark):
    assert {one(spark, T.number_key(F.lit(x))) for x in ("69/009", "69-009", "69.009", "069 / 9")} == {"69/9"}
    assert one(spark, T.article_tag(F.lit("12-TER"))) == "12 ter" and one(spark, T.article_tag(F.lit("premier"))) == "1er"
    assert one(spark, T.article_key(F.lit("1er"))) == "1" and one(spark, T.article_key(F.lit("68 bis"))) == "68bis"
    assert one(spark, T.normal_text(F.lit("  Été À  la\nNOËL "))) == "ete a la noel"
    assert one(spark, T.title_from_stem(F.lit("loi_no-5.pdf"))) == "loi no 5"
    assert one(spark, T.conversation_title(F.lit("  \n "))) == "Nouvelle conversation"
    assert one(spark, T.french_date(F.lit("7"), F.lit("août"), F.lit("1987"))) == "1987-08-07"
    assert one(spark, F.size(T.shingles(F.split(F.lit("a b c"), " "), 4))) == 1
    assert one(spark, T.safe_filename(F.lit("..Loi n° 5/é.pdf.."))) == "Loi_n_5_.pdf"


def test_recency(spark):
    score = lambda title, date: round(one(spark, T.recency_score(F.lit(-1.0), F.lit(title), F.lit(date), 2024)), 4)
    assert score("Loi de 2024", "") == -1.0
    assert score("Loi", "2020-01-01") == -0.52
    assert score("Loi", "") == -0.28
    assert score("[TEXTE OBSOLÈTE] Loi de 1950", "") == 2.8


def corpus(spark, rows):
    schema = "chunk_id long, document_id string, title string, source string, published_date string, locator string, content string, article_number string"
    return spark.createDataFrame(rows, schema)


def test_search_prefers_the_tagged_article(spark):
    chunks = corpus(spark, [(1, "a", "Code", "s", "", "Page 1", "impôt selon article 12 et article 13", None), (2, "b", "Code", "s", "", "Page 2", "impôt réel", "12"), (3, "c", "Autre", "t", "", "Page 1", "rien", None)])
    found = search.search(chunks, "impôt article 12", 2024).orderBy("pos").collect()
    assert [r.chunk_id for r in found][0] == 2
    assert [r.chunk_id for r in search.search(chunks, "impôt", 2024, sources=["s"], limit=1).collect()] in ([1], [2])
    assert search.search(chunks, "zzz", 2024).count() == 0


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, "a", 50), (2, "b", 90), (3, "a", 40), (4, "a", 5), (5, "c", 10)], "pos int, document_id string, size int")
    assert sorted(r.pos for r in search.within_budget(rows, 10, 100, 2).collect()) == [1, 3, 5]
    assert [r.pos for r in search.within_budget(rows.filter("pos = 2"), 10, 10, 2).collect()] == [2]


def test_index_and_scan_agree(spark):
    chunks = corpus(spark, [(i, "d", f"titre {i}", "s", "", "p", t, None) for i, t in enumerate(["loi impôt impots", "taux de l'impôt", "autre chose", "", "taux taux"])])
    postings, lengths = fts.build_index(chunks, "chunk_id")
    a = {r.chunk_id: round(r.score, 9) for r in fts.score_index(postings, lengths, ["impôt", "impot", "taux"], "chunk_id").collect()}
    b = {r.chunk_id: round(r.score, 9) for r in fts.score_scan(chunks, ["impôt", "impot", "taux"]).collect()}
    assert a == b and set(a) == {0, 1, 4}


TITLES = [
    ("1", "Loi n° 69-009 du 10 février 1969 relative aux impôts", ""),
    ("2", "Ordonnance-loi n° 85/20 du 3 mai 1985 modifiant la Loi n° 69/009 du 10 février 1969", ""),
    ("3", "Décret n° 5 du 1er juin 2001 abrogeant l'Ordonnance-loi n° 85-020", ""),
    ("4", "Loi n° 7/3 du 2 avril 1990 abrogeant l'article 4 du Décret n° 9/9", ""),
    ("5", "CCJA - arrêt sur la loi n° 7", ""),
    ("6", "[TEXTE OBSOLÈTE] Loi n° 11/1 du 2 avril 1990", "remplacée"),
]


def titles(spark):
    rows = [(k, t, "S", n, "ready", True, i) for i, (k, t, n) in enumerate(TITLES)]
    return spark.createDataFrame(rows, "document_id string, title string, source_label string, superseded_note string, status string, present boolean, ord long")


def test_mentions_need_a_number_or_a_date(spark):
    assert legal.question_mentions(spark, "La Loi, un emploi, un employeur, la loi du pays") == []
    own = lambda title: legal.instruments(spark.createDataFrame([(title,)], "title string")).first().own
    m = own("Loi organique n° 87-010 du 1er août 1987")
    assert (m["type"], m["number_key"], m["date"]) == ("Loi organique", "87/10", "1987-08-01")
    assert own(TITLES[4][1]) is None and own("[TEXTE OBSOLÈTE : voir] Décret n° 5/1").number_key == "5/1" and own(None) is None
    assert own("Arrêté interministériel n° 003/CAB/MIN du 2 décembre 2013").type == "Arrêté interministériel"


def test_graph_and_status(spark):
    nodes, edges = graph.build(titles(spark))
    got = {(r.instrument_type, r.number_key): r.status for r in graph.status(nodes, edges).collect()}
    assert got[("Loi", "69/9")] == "modified" and got[("Ordonnance-loi", "85/20")] == "repealed"
    assert got[("Décret", "9/9")] == "modified"  # a partial repeal of what is only named
    assert got[("Loi", "11/1")] == "flagged_superseded" and got[("Décret", "5")] == "presumed_in_force"
    assert {(r.relation, r.partial) for r in edges.collect()} == {("MODIFIES", False), ("REPEALS", False), ("REPEALS", True)}
    assert graph.find(nodes, "").count() == 0 and graph.find(nodes, "69/9", "Loi").count() == 1
    assert graph.stats(nodes, edges).first().stub_instruments == 1
    brief = {r.number_key: r.brief for r in graph.status_brief(graph.status(nodes, edges), edges).collect()}
    assert "modifié par Ordonnance-loi" in brief["69/9"]
    assert graph.incoming(edges, nodes).count() == 3 and graph.outgoing(edges, nodes).count() == 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("L'article 12 de la Loi n° 69/009 du 10 février 1969 est modifié et complété.", [("MODIFIES", ["12"], "article")]),
        ("Les articles 2, 3 et 5 du Décret n° 5 sont abrogés.", [("REPEALS", ["2", "3", "5"], "article")]),
        ("L'alinéa 2 de l'article 4 de la Loi n° 7 est supprimé.", [("REPEALS", ["4"], "alinea")]),
        ("L'article 3 du présent décret est complété.", [("COMPLEMENTS", ["3"], "article")]),
        ("Texte (modifié et complété par l'article 1° du Décret n° 05/063 du 22 juillet 2005).", [("MODIFIES", ["1"], "article")]),
        ("la loi tel que modifié par l'article 1 du Décret n° 5", []),
        ("Il est inséré au Décret n° 30 les articles 68bis, 68ter et 68quater.", [("INSERTS", ["68bis", "68ter", "68quater"], "article")]),
        ("« L'article 12 de la Loi n° 69 est modifié. »", []),
        ("L'article 5 de la Loi n° 1 dispose. Le Décret n° 2 est abrogé", []),
        ("conformément à l'article 12 de la Loi n° 5", []),
    ],
)
def test_article_statements(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(legal.article_matches(F.col("t")).alias("m")).first()["m"]
    assert [(m["relation"], m["numbers"], m["granularity"]) for m in found] == want


def test_edges_of_unknown_targets_stay(spark):
    chunks = spark.createDataFrame([("a", 1, "L'article 3 du présent décret est modifié.", "7")] * 2, "document_id string, ord long, content string, article_number string")
    own = spark.createDataFrame([("a", None, None)], "document_id string, instrument_type string, number_key string")
    assert graph.article_edges(chunks, own).count() == 2
    known = spark.createDataFrame([("a", "Décret", "5")], "document_id string, instrument_type string, number_key string")
    edges = graph.article_edges(chunks, known)
    assert edges.count() == 1
    assert graph.backfill(edges, graph.articles(chunks, edges, known), known).first().target_document is None


def test_article_brief(spark):
    chunks = spark.createDataFrame([("a", 1, "L'article 3 de la Loi n° 69/009 du 10 février 1969 est modifié.", "7")], "document_id string, ord long, content string, article_number string")
    own = spark.createDataFrame([("a", "Décret", "5")], "document_id string, instrument_type string, number_key string")
    nodes, _ = graph.build(titles(spark))
    edges = graph.article_edges(chunks, own)
    held = graph.articles(chunks, edges, own)
    ask = lambda q: [r.brief for r in graph.article_brief(q, nodes, edges, held, own).collect()]
    assert "modifié par article 7 de Décret n° 5" in ask("que dit l'article 3 de la Loi n° 69-009 ?")[0]
    assert "modifie article 3 de Loi n° 69/9" in ask("et l'article 7 du Décret n° 5 ?")[0]
    assert ask("la Loi n° 69-009") == [] and one(spark, graph.requested_article_keys(F.lit("articles premier, 68 bis et 4"))) == ["1", "68bis", "4"]


def test_duplicates(spark):
    base = " ".join(f"mot{i}" for i in range(80))
    docs = spark.createDataFrame(
        [("a", "h1", base, "s2", 1), ("b", "h1", base, "s1", 2), ("c", "h2", "kopf <!-- PAGE 1 -->" + base, "s1", 3), ("d", "h3", base + " fin du texte", "s9", 4), ("e", "h4", base + " fin de texte", "s9", 5), ("f", "h5", base + " fin de  Texte", "s1", 6)],
        "document_id string, sha256 string, text string, source string, ord long",
    ).selectExpr("*", "'ready' status", "100 size", "true present", "'' duplicate_of", "'k' block")
    plan = {(r["pass"], r.canonical, r.duplicate) for r in dedup.dedupe_plan(docs, ["s1", "s2"]).collect()}
    assert (1, "b", "a") in plan and (2, "f", "e") in plan
    assert not any(x[2] in ("b", "f") for x in plan)


def test_chains(spark):
    df = spark.createDataFrame([("a", ""), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("m", "gone"), ("n", None)], "document_id string, duplicate_of string")
    assert {r.document_id: r.target for r in dedup.flatten_chains(df).collect()} == {"b": "a", "c": "a", "d": "a", "x": "y", "y": "x", "z": "x", "m": "gone"}


def test_history(spark):
    m = spark.createDataFrame([("c", 1, "user", "un", None), ("c", 2, "assistant", "deux", '[{"document_id":"d1"},{"document_id":"d1"}]'), ("c", 3, "user", "trois", None), ("c", 4, "assistant", "x", "kein json")], "conversation_id string, message_id long, role string, content string, citations_json string")
    assert [r.message_id for r in history.recent_turns(m, 1).orderBy("turn_no").collect()] == [3, 4]
    assert [r.document_id for r in history.recent_citations(m).collect()] == ["d1"]
    assert history.contextual_query(m).first().query == "un\ntrois"
    assert [len(r.citations) for r in history.get_conversation(m, "c").collect()] == [0, 2, 0, 0]
    assert history.without(m, m.select("conversation_id").distinct()).count() == 0


def test_state_and_coverage(spark):
    state = spark.createDataFrame([("1", "a", "old", True), ("2", "a", "old", True), ("3", "b", "old", True)], "id string, source string, title string, present boolean")
    found = spark.createDataFrame([("1", "a", "new"), ("4", "a", "new")], "id string, source string, title string")
    got = {r.id: (r.title, r.present) for r in indexing.upsert(state, found, ["a"]).collect()}
    assert got == {"1": ("new", True), "2": ("old", False), "3": ("old", True), "4": ("new", True)}
    assert all(r.present for r in indexing.upsert(state, found, ["a"], limited=True).collect())


def test_preparation_and_index_are_applied(spark):
    head = extract.header(F.col("title"), F.lit("S"), F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    kept = one(spark, F.sha2(extract.header(F.lit("gleich"), F.lit("S"), F.lit(""), F.lit(""), F.lit(""), F.lit("")), 256))
    rows = [("1", "neu", 5, 5, None, None, None, None, None, None, "pending", 1), ("2", "umbenannt", 5, 5, 5, 5, "alt", "p", "# alt\n---\nbody --- x", None, "ready", 2), ("3", "gleich", 5, 5, 5, 5, kept, "p", "t", "h3", "ready", 3)]
    names = "id string, title string, size_bytes int, mtime_ns int, prepared_size int, prepared_mtime_ns int, prepared_metadata_hash string, extracted_path string, text string, extracted_sha256 string, status string, ord int"
    docs = spark.createDataFrame(rows, names).withColumns({"character_count": F.lit(0), "page_count": F.lit(0)})
    fresh = spark.createDataFrame([("1", "frisch", "ready", 6, 1)], "id string, text string, status string, character_count int, page_count int")
    got = {r.id: r for r in indexing.prepare(docs, fresh, head).collect()}
    assert (got["1"].action, got["1"].text, got["1"].status, got["1"].prepared_size) == ("extract", "# neu\nSource: S\n---\nfrisch", "ready", 5)
    assert (got["2"].action, got["2"].text) == ("refresh", "# umbenannt\nSource: S\n---\nbody --- x") and got["3"].action == "skip" and got["3"].text == "t"
    assert {r.id: r.action for r in indexing.preparation(indexing.prepare(docs, fresh, head).drop("action")).collect()} == {"1": "skip", "2": "skip", "3": "skip"}

    state = [("1", True, "", "ready", "h1", None, 4, "", "neu text"), ("2", False, "", "ready", "h2", "h2", 4, "", "weg"), ("3", True, "", "ready", "h3", "alt", 4, "", "repariert"), ("4", True, "", "ready", "h4", "h4", 4, "", "gleich")]
    names = "id string, present boolean, duplicate_of string, status string, extracted_sha256 string, local_indexed_content_hash string, local_index_revision int, local_indexed_superseded_note string, text string"
    records = spark.createDataFrame(state, names).withColumns({"superseded_note": F.lit(""), "requires_review": F.lit(False)})
    index = spark.createDataFrame([("2", "h2"), ("3", "h3"), ("4", "h4")], "id string, indexed_hash string")
    chunks = spark.createDataFrame([(x, f"c{x}") for x in "234"], "document_id string, content string")
    docs, index, chunks = indexing.apply_index(records, index, chunks, lambda d: d.select("document_id", F.col("text").alias("content")))
    assert sorted((r.document_id, r.content) for r in chunks.collect()) == [("1", "neu text"), ("3", "c3"), ("4", "c4")]
    assert {r.id: r.indexed_hash for r in index.collect()} == {"1": "h1", "3": "h3", "4": "h4"}
    assert {r.action for r in indexing.index_actions(docs, index).collect()} == {"skip"}
    assert indexing.content_hashes(None, spark).count() == 0


def test_state_is_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.load_state(spark, path).count() == 0 and "duplicate_of" in state.load_state(spark, path).columns
    for n in (1, 2, 3):
        state.save_state(spark.createDataFrame([(str(i), "x") for i in range(n)], "id string, title string"), path)
        assert state.load_state(spark, path).count() == n
    assert len([x for x in (tmp_path / "state").iterdir() if x.name.startswith("current-")]) == 2
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "current-9-000000000001-x").write_text("")
    assert state.load_state(spark, str(tmp_path / "other")).count() == 0


def test_catalogues_of_two_encodings_and_file_types(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("full_name,pdf_filename\nÉté,a.pdf\n".encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("full_name,filename\nNoël €,b.pdf\n".encode("cp1252"))
    rows = catalog.catalog_rows(spark, [str(tmp_path / n) for n in ("a.csv", "none.csv", "b.csv")]).orderBy("ord").collect()
    assert [(r.full_name, r.pdf_filename, r.filename) for r in rows] == [("Été", "a.pdf", None), ("Noël €", None, "b.pdf")]
    assert catalog.catalog_rows(spark, []).count() == 0
    files = tmp_path / "files"
    files.mkdir()
    for name in ("x.PDF", "y.txt", "z.exe", "~$x.pdf", "w.xls"):
        (files / name).write_text("x")
    source = catalog.Source("s", "S", [str(files)], extensions=[".pdf", ".txt"], review_extensions=[".xls"])
    assert {r.path.rsplit("/", 1)[1]: r.requires_review for r in catalog.list_files(spark, str(files), source).collect()} == {"x.PDF": False, "y.txt": False, "w.xls": True}
    parts = spark.createDataFrame([("a", "Page 1", "", None), ("a", "Page 2", "x" * 50, None), ("a", "Page 3", None, None), ("b", None, None, "kaputt")], "document_id string, locator string, text string, error string")
    got = {r.document_id: (r.empty_pages, r.ocr_pages, r.warnings) for r in extract.page_outcome(parts, True).collect()}
    assert got == {"a": ([1, 3], [1, 3], []), "b": ([], [], ["kaputt"])}


def test_previews(spark):
    text = "ß " * 300 + "fin du ziel " + "b" * 900
    out = one(spark, rerank.preview(F.lit(text), ["ziel"]))
    assert "ziel" in out and len(out) == 900 and out[220:223] == " … " and out.startswith("ß ß")
    assert rerank.preview_terms("Quel est le délai, selon l'article ?") == ["delai"]
    assert one(spark, rerank.preview(F.lit(" a\n b "), ["b"])) == "a b"
    assert one(spark, rerank.preview(F.lit("x" * 2000), ["ziel"])) == "x" * 900


def test_manifest_reader_and_targets(spark, tmp_path):
    write = lambda text: (tmp_path / "m.csv").write_text(text, encoding="utf-8")
    head = "full_name,pdf_filename,source_url,sha256\n"
    write(head + f"Un,a.pdf,https://x.org/a,{'A' * 64}\n")
    assert catalog.read_manifest(spark, str(tmp_path / "m.csv")).first().asDict() == {"filename": "a.pdf", "title": "Un", "source_url": "https://x.org/a", "sha256": "a" * 64}
    for text in (head, "full_name,sha256\nUn,x\n", head + f"Un,a.txt,https://x.org/a,{'a' * 64}\n"):
        write(text)
        with pytest.raises(ValueError):
            catalog.read_manifest(spark, str(tmp_path / "m.csv"))
    records = spark.createDataFrame([("1", "/a/./b//c.pdf", "x/../y.pdf"), ("2", None, "z.pdf"), ("3", None, None)], "id string, absolute_path string, relative_path string")
    assert sorted((r.id, r.path) for r in catalog.record_targets(records, "/root/").collect()) == [("1", "/a/b/c.pdf"), ("1", "/root/y.pdf"), ("2", "/root/z.pdf")]
    assert one(spark, extract.output_name(F.lit("id1"), F.lit("loi n° 5.pdf"))) == "id1__loi_n_5.md"


def test_small_reports(spark):
    chunks = spark.createDataFrame([("1", 1, "L'article 3 du Décret n° 5 est modifié.", "7")], "document_id string, ord long, content string, article_number string")
    nodes, edges = graph.build(titles(spark))
    held, statements = graph.rebuild_articles(chunks, titles(spark))
    got = graph.stats(nodes, edges, held, statements).first()
    assert (got.articles, got.article_relationships, got.instruments - got.instruments_in_corpus) == (1, 1, 1)
    assert graph.stats(nodes, edges).first().articles == 0 and graph.rebuild_articles(None, titles(spark)) is None
    run = spark.createDataFrame([("a", True), ("b", False)], "id string, passed boolean")
    assert assemble.golden_summary(run).first().asDict() == {"cases": 2, "passed": 1, "failed": ["b"]}
    notes = spark.createDataFrame([(datetime.date(2024, 1, 2), " un  mot ", " L1 "), (datetime.date(2024, 1, 3), " ", None), (datetime.date(2024, 1, 3), "x", None)], "date date, note string, reference string")
    assert sorted(r.line for r in history.learned_notes(notes).collect()) == ["- [2024-01-02] un mot (réf. L1)", "- [2024-01-03] x"]
    assert one(spark, history.valid_exchange(F.lit("q"), F.lit(" "))) is False and one(spark, history.valid_exchange(F.lit("q"), F.lit("a"))) is True


def test_manifest_and_sources(spark):
    good = ("a.pdf", "A", "https://x.org/a", "a" * 64)
    rows = spark.createDataFrame([good, ("../b.pdf", "B", "http://x", "zz"), ("A.PDF", "C", "https://x.org/c", "b" * 64)], "filename string, title string, source_url string, sha256 string")
    broken = {r.filename: set(r.broken) for r in catalog.check_manifest(rows).collect()}
    assert broken["../b.pdf"] == {"filename", "source_url", "sha256"} and broken["A.PDF"] == {"duplicate filename"}
    assert catalog.read_sources('{"sources": [{"id": "x", "paths": ["p"], "superseded_filenames": {"a": "b"}}]}')[0].superseded == {"a": "b"}


def test_extraction(spark, tmp_path):
    files = spark.createDataFrame([("a", ".txt", "é".encode()), ("b", ".txt", "é".encode("cp1252")), ("c", ".zip", b""), ("d", ".html", b"<p>x &amp; y<script>z</script>"), ("e", ".pdf", b"kein")], "document_id string, extension string, content binary")
    rows = {r.document_id: (r.text, bool(r.error)) for r in extract.extract(files).collect()}
    assert rows["a"] == ("é", False) and rows["b"] == ("é", False) and rows["c"][1] and rows["d"] == ("x & y", False) and rows["e"][1]
    assert {r.document_id: r.status for r in extract.extraction_status(extract.extract(files)).collect()}["a"] == "insufficient_text"
    (tmp_path / "k.csv").write_text("﻿full_name,pdf_filename\nUn,a.pdf\n", encoding="utf-8")
    assert catalog.read_catalog(spark, str(tmp_path / "k.csv")).columns == ["full_name", "pdf_filename"]
    assert catalog.list_files(spark, str(tmp_path)).count() == 1


def test_answers(spark):
    assert one(spark, assemble.json_ints(F.lit('```json\n[1, "2", 3.0, true, "x", 2.5]\n```'))) == [1, 2, 3]
    assert one(spark, assemble.json_strings(F.lit('[" a ", 1, ""]'))) == ["a"]
    assert one(spark, assemble.json_ints(F.lit("nichts"))) == []
    assert one(spark, assemble.table_cells(F.lit("| a | b |"))) == ["a", "b"]
    assert one(spark, assemble.markdown_text(F.lit("## T\n**x** [y](z)"))) == "T\nx y"
    pool = spark.createDataFrame([(i, f"texte {i}") for i in range(30)], "pos int, content string")
    assert [r.pos for r in rerank.rerank(pool, None, 3).collect()] == [0, 1, 2]
    assert [r.pos for r in rerank.rerank(pool, rerank.shared_terms(["7"]), 2).collect()] == [7, 0]
    assert one(spark, rerank.preview(F.lit("a" * 2000 + " ziel " + "b" * 500), ["ziel"])).count("ziel") == 1


def test_stream_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "## Page 1\nArticle 1 : x")], "document_id string, text string").write.parquet(source)
    for _ in range(2):
        streaming.ingest(spark, source, target, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(target).count() == 1
    spark.createDataFrame([("b", "texte")], "document_id string, text string").write.mode("append").parquet(source)
    streaming.ingest(spark, source, target, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_hourly_events(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h), "a", 1.0) for h in (1, 1, 2, 9)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "e"))
    q = streaming.hourly_events(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 2]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rerank_vectors_over_the_whole_table(spark, tmp_path):
    rows = [(i, [1.0, float(abs(i - 90) + (i != 7))]) for i in range(100) if i != 7] + [(7, [1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.vec_id for r in queries.QUERIES["rerank_vectors"](spark, str(tmp_path)).collect()]
    assert got == [7, 90, 89, 91, 88, 92, 87, 93, 86, 94, 85, 95, 84, 96]
