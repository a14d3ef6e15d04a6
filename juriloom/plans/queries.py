"""Queries over the driver tables, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import assemble, chunking, dedup, fts, graph, history, legal, rerank, resolve, search
from ..sources import catalog
from ..storage import written
from . import indexing
from . import synthetic as S

TERMS = ["nation", "with", "schaft", "thing"]
OTHER = ["mente", "entre", "thing"]
TABLES = ["orders", "lineitem", "documents", "conversations", "events", "part", "supplier"]
AS_OF = 2024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(nl="chr(10)", **{t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}))


def duck(sql: str) -> str:
    return sql.format(nl="chr(10)", **{t: t for t in TABLES})


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        "source",
        F.lit("").alias("published_date"),
        F.lit("Document").alias("locator"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("article_number"),
    )


# --- ranking -----------------------------------------------------------------------------------------------------------
_TOK = r"regexp_extract_all(replace(strip_accents(lower({})), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def _occ(tok: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({tok}, lambda t: starts_with(t, '{phrase[0]}')))"
    a, b = phrase
    return f"len(list_filter(range(1, len({tok})), lambda i: {tok}[i] = '{a}' AND starts_with({tok}[i + 1], '{b}')))"


def bm25_cte(terms: list[str], name: str = "bm") -> str:
    ps = fts.phrases(terms)
    f = ", ".join(f"(5.0 * {_occ('tt', p)} + {_occ('tc', p)})::DOUBLE AS f{i}" for i, p in enumerate(ps))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(ps)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len_ / av))" for i in range(len(ps)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(ps)))
    return f"""{name}_t AS (SELECT doc_id AS chunk_id, source, text AS content, {_TOK.format("lang || ' ' || source")} AS tt, {_TOK.format("coalesce(text, '')")} AS tc FROM documents),
{name}_f AS (SELECT chunk_id, source, content, len(tt) + len(tc) AS len_, {f} FROM {name}_t),
{name}_s AS (SELECT count(*) AS n, avg(len_) AS av, {df} FROM {name}_f),
{name} AS (SELECT chunk_id, source, content, -({score}) AS score FROM {name}_f, {name}_s WHERE {hit})"""


@query(f"WITH {bm25_cte(TERMS)} SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM bm QUALIFY rank <= 50")
def bm25_topk(spark, sf):
    return fts.top(fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id"]), "chunk_id", 50).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {bm25_cte(TERMS)} SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_index(spark, sf):
    postings, lengths = fts.build_index(corpus(spark, sf), "chunk_id")
    return fts.score_index(postings, lengths, TERMS, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_cte(TERMS)} SELECT chunk_id, source, round(score, 6) AS score, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM bm WHERE source IN ('src1', 'src2', 'src3') QUALIFY rank <= 40")
def bm25_source_filter(spark, sf):
    scored = fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id", "source"]).filter(F.col("source").isin("src1", "src2", "src3"))
    return fts.top(scored, "chunk_id", 40).select("chunk_id", "source", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {bm25_cte(['of the', 'in-th', 'no-wo'])} SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_prefix_phrase(spark, sf):
    return fts.score_scan(corpus(spark, sf), ["of the", "in-th", "no-wo"], keep=["chunk_id"]).select("chunk_id", F.round("score", 6).alias("score"))


_RANKED = f"WITH {bm25_cte(TERMS, 'a')}, {bm25_cte(OTHER, 'b')}, r AS (SELECT *, 0 AS q, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM a UNION ALL SELECT *, 1 AS q, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM b), p AS (SELECT * FROM r WHERE rank <= 60)"


def _two(spark, sf, keep):
    base = corpus(spark, sf)
    return [fts.top(rows, "chunk_id", 60) for rows in fts.score_scans(base, [TERMS, OTHER], keep=keep)]


@query(_RANKED + " SELECT chunk_id, min(rank) AS best_rank, arg_min(q, rank * 10 + q) AS query_ord FROM p GROUP BY chunk_id")
def fusion_best_rank(spark, sf):
    return search.fused(_two(spark, sf, ["chunk_id"])).select("chunk_id", "best_rank", "query_ord")


@query(_RANKED + " SELECT chunk_id, min(rank) AS rank, arg_min(q, rank * 10 + q) AS query_ord FROM p GROUP BY chunk_id ORDER BY rank, query_ord LIMIT 25")
def fusion_round_robin(spark, sf):
    return search.interleaved(_two(spark, sf, ["chunk_id"]), 25).select("chunk_id", "rank", "query_ord")


@query(
    f"""WITH RECURSIVE {bm25_cte(TERMS)}, pool AS (SELECT chunk_id, source AS d, length(content) AS s, row_number() OVER (ORDER BY score, chunk_id) AS pos FROM bm QUALIFY pos <= 300),
g AS (SELECT 0::BIGINT AS pos, 0::BIGINT AS used, []::VARCHAR[] AS docs, []::BIGINT[] AS taken
UNION ALL SELECT p.pos, CASE WHEN ok THEN used + s ELSE used END, CASE WHEN ok THEN list_append(docs, d) ELSE docs END, CASE WHEN ok THEN list_append(taken, p.pos) ELSE taken END
FROM (SELECT p.*, g.used, g.docs, g.taken, len(g.taken) < 14 AND len(list_filter(g.docs, lambda x: x = p.d)) < 2 AND (len(g.taken) = 0 OR g.used + p.s <= 20000) AS ok FROM g JOIN pool p ON p.pos = g.pos + 1) p),
last AS (SELECT taken FROM g ORDER BY pos DESC LIMIT 1)
SELECT chunk_id, d AS document_id, s AS size, pos FROM pool WHERE list_contains((SELECT taken FROM last), pos)"""
)
def greedy_budget(spark, sf):
    pool = fts.top(fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id", "document_id", "content"]), "chunk_id", 300)
    rows = pool.select("chunk_id", "document_id", F.length("content").cast("bigint").alias("size"), F.col("rank").cast("bigint").alias("pos"))
    return search.within_budget(rows, limit=14, budget=20000, per_document=2)


@query(
    """SELECT k AS ord, round(1.0 + 0.12 * CASE WHEN y IS NULL THEN 6 ELSE least(greatest(2024 - y, 0), 15) END + CASE WHEN old THEN 2.0 ELSE 0.0 END, 6)::DOUBLE AS score, y AS year FROM (
SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS old, CASE WHEN o_orderkey % 3 = 0 THEN 1950 + o_orderkey % 80 WHEN o_orderkey % 3 = 1 THEN 1990 + o_orderkey % 30 END AS y0,
CASE WHEN o_orderkey % 3 = 0 AND 1950 + o_orderkey % 80 > 2025 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1950 + o_orderkey % 80 WHEN o_orderkey % 3 = 1 THEN 1990 + o_orderkey % 30 END::INTEGER AS y FROM orders)"""
)
def recency_score(spark, sf):
    k = F.col("o_orderkey")
    title = F.concat(F.when(k % 7 == 0, "[TEXTE OBSOLÈTE] ").otherwise(""), F.lit("Loi "), F.when(k % 3 == 0, (k % 80 + 1950).cast("string")).otherwise("sans date"))
    date = F.when(k % 3 == 1, F.concat((k % 30 + 1990).cast("string"), F.lit("-01-01"))).otherwise("")
    rows = table(spark, sf, "orders").select(k.alias("ord"), title.alias("title"), date.alias("date"))
    score = T.recency_score(F.lit(1.0), F.col("title"), F.col("date"), AS_OF)
    return rows.select("ord", F.round(score, 6).alias("score"), T.legal_year(F.col("title"), F.col("date"), AS_OF).alias("year"))


# --- segmentation ------------------------------------------------------------------------------------------------------
@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '\n\s*\n', chr(1), 'g'), '\.\s+([A-ZÀ-ÖØ-Þ])', '.' || chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS bs FROM d WHERE length(t) > 4500),
e AS (SELECT doc_id, i, bs[i] AS block, length(bs[i]) AS n FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM b)),
r AS (SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS part, 0::BIGINT AS size, false AS opened, 0::BIGINT AS a0, 0::BIGINT AS pieces FROM b
UNION ALL SELECT e.doc_id, e.i,
  CASE WHEN n > 4500 THEN part + opened::INT + ceil(n / 4500.0)::BIGINT WHEN opened AND size + n + 2 > 4500 THEN part + 1 ELSE part END,
  CASE WHEN n > 4500 THEN 0 WHEN opened AND size + n + 2 > 4500 THEN n + 2 ELSE size + n + 2 * opened::INT END,
  n <= 4500, CASE WHEN n > 4500 THEN part + opened::INT WHEN opened AND size + n + 2 > 4500 THEN part + 1 ELSE part END,
  CASE WHEN n > 4500 THEN ceil(n / 4500.0)::BIGINT ELSE 0 END
FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1),
x AS (SELECT r.doc_id, r.a0 AS part, string_agg(block, chr(10) || chr(10) ORDER BY r.i) AS content FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i WHERE r.pieces = 0 GROUP BY ALL
UNION ALL SELECT doc_id, a0 + k, substr(block, k * 4500 + 1, 4500) FROM (SELECT r.doc_id, r.a0, e.block, unnest(range(0, r.pieces)) AS k FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i WHERE r.pieces > 0)
UNION ALL SELECT doc_id, 1, t FROM d WHERE length(t) BETWEEN 1 AND 4500)
SELECT doc_id, part, content FROM x"""
)
def chunk_pack(spark, sf):
    parts = chunking.split_parts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("p", "content")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("part"), "content")


@query(
    f"""WITH m AS ({duck(S.MARKED)})
SELECT document_id, 1 AS ord, 'Page 1' AS locator, 'Préambule du texte.' AS content, NULL AS article_number FROM m
UNION ALL SELECT document_id, 2, 'Page 1', 'Article ' || a || ' : premier texte.', a FROM m
UNION ALL SELECT document_id, 3, 'Page 2', 'suite du texte.', a FROM m
UNION ALL SELECT document_id, 4, 'Page 3', 'ANNEXES' || chr(10) || 'Tableau.', NULL FROM m"""
)
def chunk_articles_carry(spark, sf):
    return chunking.chunks(derived(spark, sf, S.MARKED))


@query(f"WITH s AS ({duck(S.STATEMENTS)}) SELECT ord, CASE WHEN article_number IN ('5', '12', '13', '14') THEN 5 ELSE (CASE WHEN a IN ('5', '12', '13', '14') AND k % 4 <> 2 THEN 1 WHEN k % 4 = 2 THEN 0 ELSE 0 END) END AS hits FROM s WHERE k % 4 <> 2")
def article_hits(spark, sf):
    asked = search.of_question(spark, "que disent l'article 5 et les articles 12 à 14 ?", search.requested_articles)
    rows = derived(spark, sf, S.STATEMENTS).filter("k % 4 <> 2")
    return rows.select("ord", search.article_hits(F.col("content"), F.col("article_number"), asked).alias("hits"))


# --- duplicates --------------------------------------------------------------------------------------------------------
@query("SELECT sha256(text) AS grp, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    rows = table(spark, sf, "documents").withColumn("sha", F.sha2("text", 256))
    return dedup.equal_groups(rows, "sha", "doc_id").select("grp", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_NORM = r"trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"SELECT sha256(t) AS grp, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM (SELECT doc_id, {_NORM} AS t FROM documents) WHERE length(t) >= 200 GROUP BY 1 HAVING count(*) > 1")
def normalized_dup_groups(spark, sf):
    key = T.let(dedup.operative_text(F.col("text")), lambda t: F.when(F.length(t) >= 200, F.sha2(t, 256)))
    return dedup.equal_groups(table(spark, sf, "documents"), key, "doc_id").select("grp", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_PAIRS = f"""w AS (SELECT doc_id, lang, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, lang, len(ws) AS nw, CASE WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS set_ FROM w WHERE len(ws) > 0),
x AS (SELECT doc_id, lang, unnest(set_) AS g FROM s),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM x p JOIN x q ON p.lang = q.lang AND p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, n / (len(sa.set_) + len(sb.set_) - n)::DOUBLE AS jaccard FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE n / (len(sa.set_) + len(sb.set_) - n)::DOUBLE >= 0.65 AND least(sa.nw, sb.nw) >= 0.15 * greatest(sa.nw, sb.nw))"""


def _pairs(spark, sf):
    return dedup.similar_pairs(table(spark, sf, "documents"), "lang", "doc_id", "text")


def _clusters(spark, sf):
    return dedup.similar_clusters(table(spark, sf, "documents"), "lang", "doc_id", "text")


@query(f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs")
def shingle_jaccard_pairs(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_CLUSTERS = f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r), cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"


@query(f"{_CLUSTERS} SELECT id, cluster FROM cl")
def dup_clusters(spark, sf):
    return _clusters(spark, sf)


@query(f"{_CLUSTERS} SELECT cluster, arg_min(id, (CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src7' THEN 2 ELSE 3 END, CASE WHEN n_chars >= 200 THEN 0 ELSE 1 END, -n_chars, doc_id)) AS canonical FROM cl JOIN documents ON doc_id = id GROUP BY cluster")
def canonical_selection(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.when(F.col("n_chars") >= 200, "ready").otherwise("insufficient_text").alias("status"), F.col("n_chars").alias("size"), F.col("doc_id").alias("ord"))
    return dedup.canonical(_clusters(spark, sf).join(docs, "id"), ["src3", "src1", "src7"])


_BEST = "(CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src7' THEN 2 ELSE 3 END, 0, -n_chars, doc_id)"


@query(
    f"""WITH RECURSIVE g1 AS (SELECT doc_id, source, n_chars, sha256(text) AS g FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1),
rest AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g1)),
g2 AS (SELECT doc_id, source, n_chars, t AS g FROM (SELECT *, {_NORM} AS t FROM rest) WHERE length(t) >= 200 QUALIFY count(*) OVER (PARTITION BY t) > 1),
rest2 AS (SELECT * FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM g2)),
{_PAIRS.replace("FROM documents)", "FROM rest2)")}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
g3 AS (SELECT doc_id, source, n_chars, min(r) AS g FROM reach JOIN documents ON doc_id = id GROUP BY ALL),
c1 AS (SELECT g, arg_min(doc_id, {_BEST}) AS c FROM g1 GROUP BY g), c2 AS (SELECT g, arg_min(doc_id, {_BEST}) AS c FROM g2 GROUP BY g), c3 AS (SELECT g, arg_min(doc_id, {_BEST}) AS c FROM g3 GROUP BY g)
SELECT 1 AS pass, c AS canonical, doc_id AS duplicate FROM g1 JOIN c1 USING (g) WHERE doc_id <> c UNION ALL SELECT 2, c, doc_id FROM g2 JOIN c2 USING (g) WHERE doc_id <> c
UNION ALL SELECT 3, c, doc_id FROM g3 JOIN c3 USING (g) WHERE doc_id <> c AND EXISTS (SELECT 1 FROM e WHERE a = c AND b = doc_id)"""
)
def dedupe_plan(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"), "text", F.lit("ready").alias("status"), "source", F.col("n_chars").alias("size"), F.col("doc_id").alias("ord"), F.lit(True).alias("present"), F.lit("").alias("duplicate_of"), F.col("lang").alias("block"))
    return dedup.dedupe_plan(docs, ["src3", "src1", "src7"])


@query(
    f"""WITH RECURSIVE c AS ({duck(S.CHAINS)}), ch AS (SELECT document_id, duplicate_of FROM c WHERE coalesce(duplicate_of, '') <> ''),
f AS (SELECT document_id, duplicate_of AS at, 1 AS depth FROM ch UNION ALL SELECT f.document_id, ch.duplicate_of, depth + 1 FROM f JOIN ch ON ch.document_id = f.at WHERE depth < 12),
t AS (SELECT f.document_id, f.at FROM f JOIN c ON c.document_id = f.at WHERE coalesce(c.duplicate_of, '') = '')
SELECT ch.document_id, ch.duplicate_of, coalesce(t.at, ch.duplicate_of) AS target FROM ch LEFT JOIN t USING (document_id)"""
)
def flatten_chains(spark, sf):
    return dedup.flatten_chains(derived(spark, sf, S.CHAINS))


# --- legal graph -------------------------------------------------------------------------------------------------------
def _legal(spark, sf):
    return derived(spark, sf, S.LEGAL).select("document_id", "ord", "title", "source_label", "superseded_note", "status", "present")


_L = f"l AS ({duck(S.LEGAL)}), live AS (SELECT * FROM l WHERE status <> 'error' AND present)"
_E = "edges AS (SELECT ty AS source_type, nkey AS source_key, rel AS relation, tty AS target_type, tkey AS target_key, arg_min(tnum, k) AS target_number, arg_min(tpartial, k) AS partial, min(k) AS first_k FROM live WHERE rel IS NOT NULL AND NOT (ty = tty AND nkey = tkey) GROUP BY ALL)"
_G = "grp AS (SELECT ty AS instrument_type, nkey AS number_key, arg_min(title, k) AS title, arg_min(num, k) AS instrument_number, arg_min(iso, k) AS instrument_date, count(*) AS document_count, string_agg(DISTINCT source_label, ', ' ORDER BY source_label) AS sources, max(superseded_note) AS superseded_note FROM live GROUP BY ALL)"
_STUB = "stub AS (SELECT target_type AS instrument_type, target_key AS number_key, arg_min(target_number, first_k) AS instrument_number FROM edges WHERE NOT EXISTS (SELECT 1 FROM grp WHERE instrument_type = target_type AND number_key = target_key) GROUP BY ALL)"
_SCORE = "CASE instrument_type WHEN 'Décret' THEN 80 WHEN 'Arrêté ministériel' THEN 70 WHEN 'Loi organique' THEN 95 WHEN 'Circulaire' THEN 50 ELSE 90 END"


@query(f"WITH {_L} SELECT document_id, ty AS type, num AS number, nkey AS number_key, iso AS date FROM l")
def instrument_parse(spark, sf):
    return legal.instruments(_legal(spark, sf)).select("document_id", "own.type", "own.number", "own.number_key", "own.date")


@query(f"WITH {_L}, {_G} SELECT instrument_type, number_key, title, instrument_number, instrument_date, {_SCORE} AS authority_score, document_count, sources, superseded_note FROM grp")
def instrument_groups(spark, sf):
    return graph.instrument_groups(graph.titles(_legal(spark, sf))).drop("in_corpus")


@query(f"WITH {_L}, {_E} SELECT source_type, source_key, relation, target_type, target_key, target_number, partial FROM edges")
def relationship_edges(spark, sf):
    return graph.relationships(graph.titles(_legal(spark, sf))).select("source_type", "source_key", "relation", "target_type", "target_key", "target_number", "partial")


@query(f"WITH {_L}, {_E}, {_G}, {_STUB} SELECT instrument_type, number_key, instrument_number, instrument_type || ' n° ' || instrument_number AS title FROM stub")
def stub_instruments(spark, sf):
    parsed = graph.titles(_legal(spark, sf))
    return graph.stub_instruments(graph.instrument_groups(parsed), graph.relationships(parsed)).select("instrument_type", "number_key", "instrument_number", "title")


_STATUS = f"""{_L}, {_E}, {_G}, {_STUB}, n AS (SELECT instrument_type, number_key, superseded_note, true AS here FROM grp UNION ALL SELECT instrument_type, number_key, '', false FROM stub),
h AS (SELECT target_type, target_key, bool_or(relation = 'REPEALS' AND NOT partial) AS gone, bool_or(relation IN ('MODIFIES', 'COMPLEMENTS') OR relation = 'REPEALS' AND partial) AS changed, count(*) AS incoming FROM edges GROUP BY ALL),
st AS (SELECT instrument_type, number_key, CASE WHEN superseded_note <> '' THEN 'flagged_superseded' WHEN gone THEN 'repealed' WHEN changed THEN 'modified' WHEN NOT here THEN 'referenced_not_indexed' ELSE 'presumed_in_force' END AS status, coalesce(incoming, 0) AS incoming FROM n LEFT JOIN h ON target_type = instrument_type AND target_key = number_key)"""


@query(f"WITH {_STATUS} SELECT * FROM st")
def instrument_status(spark, sf):
    nodes, edges = graph.build(_legal(spark, sf))
    return graph.status(nodes, edges).select("instrument_type", "number_key", "status", "incoming")


@query(f"WITH {_STATUS} SELECT status, count(*) AS n FROM st GROUP BY status")
def status_counts(spark, sf):
    nodes, edges = graph.build(_legal(spark, sf))
    return graph.status(nodes, edges).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_AE = f"""s AS ({duck(S.STATEMENTS)}), ae0 AS (SELECT document_id, article_number AS source_article, ord, rel AS relation, tty AS target_type, tkey AS target_key, unnest(CASE WHEN rel = 'INSERTS' THEN [a || 'bis', a || 'ter', a || 'quater'] ELSE [a] END) AS target_article FROM s WHERE rel IS NOT NULL),
ae AS (SELECT document_id, source_article, relation, target_type, target_key, target_article, min(ord) AS ord FROM ae0 GROUP BY ALL)"""


@query(f"WITH {_AE} SELECT document_id, source_article, relation, target_type, target_key, target_article, ord FROM ae")
def article_edges(spark, sf):
    return graph.article_edges(derived(spark, sf, S.STATEMENTS), derived(spark, sf, S.OWN)).select("document_id", "source_article", "relation", "target_type", "target_key", "target_article", "ord")


@query(
    f"""WITH {_AE}, own AS ({duck(S.OWN)}), home AS (SELECT instrument_type, number_key, min(document_id) AS document_id FROM own WHERE instrument_type IS NOT NULL GROUP BY ALL),
nodes AS (SELECT document_id, article_number AS k FROM s UNION SELECT home.document_id, target_article FROM ae JOIN home ON instrument_type = target_type AND number_key = target_key WHERE relation = 'INSERTS')
SELECT document_id, source_article, relation, target_type, target_key, target_article, (SELECT min(n.document_id) FROM nodes n JOIN own USING (document_id) WHERE own.instrument_type = ae.target_type AND own.number_key = ae.target_key AND n.k = ae.target_article) AS target_document FROM ae"""
)
def article_backfill(spark, sf):
    chunks, own = derived(spark, sf, S.STATEMENTS), derived(spark, sf, S.OWN)
    edges = written(graph.article_edges(chunks, own), "article-edges")
    filled = graph.backfill(edges, graph.articles(chunks, edges, own), own)
    return filled.select("document_id", "source_article", "relation", "target_type", "target_key", "target_article", "target_document")


# --- catalogue, state, coverage ----------------------------------------------------------------------------------------
@query(
    """SELECT 'f' || p_partkey || '.pdf' AS filename, substr(sha256(lower('s' || (p_partkey % 5) || '/' || p_type || '/f' || p_partkey || '.pdf')), 1, 20) AS id,
(CASE WHEN p_partkey % 11 = 0 THEN '[TEXTE OBSOLÈTE] ' ELSE '' END) || CASE WHEN p_partkey % 13 = 0 THEN 'Titre corrigé' WHEN p_partkey % 3 = 0 THEN p_name ELSE 'f' || p_partkey END AS title,
CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS category FROM part"""
)
def scan_catalog_enrich(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    files = part.select(F.concat(F.lit("s"), (F.col("p_partkey") % 5).cast("string")).alias("source"), F.concat_ws("/", "p_type", name).alias("relative_path"), F.lit(False).alias("requires_review"), F.lit(1).alias("size_bytes"), F.lit(1).alias("mtime_ns"))
    rows = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("x\\"), F.upper(name)).alias("filename"), F.col("p_name").alias("full_name"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("ord"))
    again = rows.withColumns({"full_name": F.lit("later"), "ord": F.col("ord") + 1_000_000_000})
    overrides = part.filter("p_partkey % 13 = 0").select(name.alias("filename"), F.lit("Titre corrigé").alias("override"))
    notes = part.filter("p_partkey % 11 = 0").select(name.alias("filename"), F.lit("remplacé").alias("note"))
    found = catalog.discover(files, catalog.catalog_entries(rows.unionByName(again)), overrides, notes)
    return found.select("filename", "id", "title", "category")


@query("SELECT page_id, substr(sha256(lower(url)), 1, 20) AS id FROM pages")
def document_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.document_id("url").alias("id"))


@query(r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(p_name, '[_-]+', ' ', 'g'), '\s+', ' ', 'g')), ''), p_name) AS title FROM part")
def titles_from_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.title_from_stem(F.concat("p_name", F.lit(".pdf"))).alias("title"))


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN source WHEN doc_id % 7 = 0 THEN source ELSE source END AS source, CASE WHEN doc_id % 9 = 0 THEN false WHEN doc_id % 10 = 3 THEN true ELSE true END AS present,
CASE WHEN doc_id % 9 = 0 THEN 'old' WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS title FROM documents WHERE source IN ('src0', 'src1', 'src2') AND NOT (doc_id % 10 = 3 AND doc_id % 9 = 0)
UNION ALL SELECT doc_id, source, true, 'old' FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') AND doc_id % 10 <> 3"""
)
def change_detection(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    state = docs.filter("id % 10 != 3").withColumn("title", F.lit("old")).withColumn("present", F.lit(True))
    found = docs.filter("source in ('src0', 'src1', 'src2') and id % 9 != 0").withColumn("title", F.when(F.col("id") % 7 == 0, "new").when(F.col("id") % 10 == 3, "old").otherwise("old"))
    return indexing.upsert(state, found, ["src0", "src1", "src2"]).select("id", "source", "present", "title")


def _state(spark, sf):
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        k.alias("id"),
        "source",
        (k % 17 != 0).alias("present"),
        F.when(k % 19 == 0, "other").otherwise("").alias("duplicate_of"),
        F.when(k % 23 == 0, "needs_ocr").when(k % 29 == 0, "error").otherwise("ready").alias("status"),
        F.when(k % 31 == 0, "note").otherwise("").alias("superseded_note"),
        F.col("n_chars").alias("size_bytes"),
        F.sha2("text", 256).alias("extracted_sha256"),
        F.when(k % 5 != 0, F.sha2("text", 256)).alias("local_indexed_content_hash"),
        F.when(k % 3 == 0, 3).otherwise(4).alias("local_index_revision"),
        F.lit("").alias("local_indexed_superseded_note"),
    )
    index = table(spark, sf, "documents").filter("doc_id % 4 != 0").select(k.alias("id"), F.when(k % 6 == 1, "stale").otherwise(F.sha2("text", 256)).alias("indexed_hash"))
    return docs, index


_ST = "st AS (SELECT doc_id AS id, doc_id % 17 <> 0 AS present, doc_id % 19 = 0 AS dup, CASE WHEN doc_id % 23 = 0 THEN 'needs_ocr' WHEN doc_id % 29 = 0 THEN 'error' ELSE 'ready' END AS status, doc_id % 31 = 0 AS old, n_chars, doc_id % 4 <> 0 AS indexed, doc_id % 4 <> 0 AND doc_id % 6 <> 1 AS held FROM documents)"


@query(
    f"""WITH {_ST} SELECT count(*) AS documents_total, count(*) FILTER (present) AS documents_present, count(*) FILTER (NOT present) AS documents_absent, count(*) FILTER (dup) AS documents_duplicate,
count(*) FILTER (present AND status = 'ready') AS documents_ready, count(*) FILTER (present AND status = 'needs_ocr') AS documents_needing_ocr, 0::BIGINT AS documents_insufficient, count(*) FILTER (present AND status = 'error') AS documents_failed,
count(*) FILTER (present AND old) AS documents_superseded, count(*) FILTER (present AND NOT dup AND status = 'ready') AS eligible_documents, count(*) FILTER (present AND NOT dup AND status = 'ready' AND held) AS covered_documents,
(sum(n_chars) FILTER (present))::BIGINT AS bytes_present, round(100.0 * count(*) FILTER (present AND NOT dup AND status = 'ready' AND held) / count(*) FILTER (present AND NOT dup AND status = 'ready'), 2)::DOUBLE AS coverage_percent FROM st"""
)
def coverage_summary(spark, sf):
    return indexing.coverage(*_state(spark, sf))


@query(
    f"""WITH {_ST} SELECT id, 'delete' AS action FROM st WHERE indexed AND (NOT present OR dup)
UNION ALL SELECT id, CASE WHEN held AND id % 5 <> 0 AND id % 3 <> 0 AND NOT old THEN 'skip' WHEN held AND id % 3 <> 0 THEN 'repair' ELSE 'reindex' END FROM st WHERE present AND NOT dup AND status = 'ready'"""
)
def index_actions(spark, sf):
    return indexing.index_actions(*_state(spark, sf))


@query("SELECT s.id, count(d.doc_id) AS document_count FROM (SELECT 'src' || i AS id FROM range(0, 25) t(i)) s LEFT JOIN documents d ON d.source = s.id GROUP BY s.id")
def source_summary(spark, sf):
    sources = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("id"))
    return catalog.source_summary(sources, table(spark, sf, "documents").select("source"))


# --- conversations -----------------------------------------------------------------------------------------------------
_M = f"m AS ({duck(S.MESSAGES)})"


@query("SELECT conv_id AS conversation_id, max(turn) AS updated_at, count(*) FILTER (role <> 'system') AS message_count FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conversation_id LIMIT 40")
def list_conversations(spark, sf):
    m = derived(spark, sf, S.MESSAGES)
    heads = m.groupBy("conversation_id").agg(F.max("message_id").alias("updated_at"))
    return history.list_conversations(heads, m.filter("role != 'system'"), 40)


@query(f"WITH {_M} SELECT conversation_id, message_id, role, row_number() OVER (PARTITION BY conversation_id ORDER BY message_id) AS turn_no FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY message_id DESC) <= 4)")
def recent_turns(spark, sf):
    return history.recent_turns(derived(spark, sf, S.MESSAGES), 2).select("conversation_id", "message_id", "role", "turn_no")


@query(
    f"""WITH {_M}, a AS (SELECT conversation_id, message_id AS t FROM m WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY message_id DESC) <= 4),
c AS (SELECT conversation_id, t, 0 AS pos, 'd' || (t % 3) AS document_id, 't' || t AS title FROM a UNION ALL SELECT conversation_id, t, 1, 'd' || ((t + 1) % 4), 's' FROM a),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conversation_id, document_id ORDER BY t DESC, pos) = 1)
SELECT conversation_id, document_id, title, 'u' AS pdf_url, row_number() OVER (PARTITION BY conversation_id ORDER BY t DESC, pos) AS rank FROM f"""
)
def recent_distinct(spark, sf):
    return history.recent_citations(derived(spark, sf, S.MESSAGES), 4)


@query(f"WITH {_M} SELECT conversation_id, string_agg(trim(content), chr(10) ORDER BY message_id) AS query FROM (SELECT * FROM m WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY message_id DESC) <= 3) GROUP BY conversation_id")
def contextual_query(spark, sf):
    return history.contextual_query(derived(spark, sf, S.MESSAGES), 2)


@query(r"SELECT conv_id, turn, coalesce(nullif(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 100), ''), 'Nouvelle conversation') AS title FROM conversations")
def conversation_titles(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.conversation_title("text").alias("title"))


# --- answers -----------------------------------------------------------------------------------------------------------
@query(f"WITH {bm25_cte(TERMS)}, p AS (SELECT chunk_id, source, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM bm QUALIFY rank <= 80) SELECT source AS document_id, min(rank) AS first_pos, string_agg('p' || (chunk_id % 50), '; ' ORDER BY rank) AS locators FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, chunk_id % 50 ORDER BY rank) = 1) GROUP BY source")
def citations_grouped(spark, sf):
    pool = fts.top(fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id", "document_id"]), "chunk_id", 80)
    rows = pool.select("document_id", F.col("rank").alias("pos"), F.concat(F.lit("p"), (F.col("chunk_id") % 50).cast("string")).alias("locator"))
    return assemble.grouped_citations(rows)


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents), e AS (SELECT doc_id, c, replace(strip_accents(lower(c)), 'ß', 'ss') AS f FROM d),
h AS (SELECT doc_id, c, f, unnest(['idiot', 'trash', 'worthless']) AS t FROM e), n AS (SELECT doc_id, t, (length(f) - length(replace(f, t, ''))) // length(t) AS n, instr(f, t) - 1 AS a0 FROM h WHERE length(c) > 900),
b AS (SELECT doc_id, arg_min(a0, (n, a0, t)) AS a0 FROM n WHERE a0 >= 220 GROUP BY doc_id),
m AS (SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM (SELECT doc_id, i, CASE WHEN lower(substr(c, i, 1)) = 'ß' THEN 2 ELSE 1 END AS w FROM (SELECT e.doc_id, c, unnest(range(1, length(c) + 1)) AS i FROM e JOIN b USING (doc_id) WHERE length(c) <> length(f)))),
g AS (SELECT b.doc_id, min(i) - 1 AS a1 FROM b JOIN m ON m.doc_id = b.doc_id AND seen > a0 GROUP BY b.doc_id),
k AS (SELECT doc_id, c, b.a0 IS NOT NULL AS hit, coalesce(a1, a0) AS focus FROM e LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)),
w AS (SELECT *, least(length(c), greatest(220, focus - 225) + 677) AS stop FROM k)
SELECT doc_id, CASE WHEN length(c) <= 900 THEN c WHEN NOT hit THEN substr(c, 1, 900) ELSE substr(c, 1, 220) || ' … ' || substr(c, greatest(220, stop - 677) + 1, stop - greatest(220, stop - 677)) END AS preview FROM w"""
)
def candidate_preview(spark, sf):
    terms = rerank.preview_terms("Quel idiot, dans ce trash worthless ?")
    return table(spark, sf, "documents").select("doc_id", rerank.preview(F.col("text"), terms).alias("preview"))


@query(
    f"""WITH {bm25_cte(TERMS)}, p AS (SELECT chunk_id, content, row_number() OVER (ORDER BY score, chunk_id) AS pos FROM bm QUALIFY pos <= 20),
s AS (SELECT chunk_id, pos, len(list_intersect(list_distinct({_TOK.format("content")}), ['the', 'with', 'nation'])) / 3.0 AS r FROM p) SELECT chunk_id, pos, round(r, 6)::DOUBLE AS rerank_score FROM s ORDER BY r DESC, pos LIMIT 14"""
)
def rerank_lexical(spark, sf):
    pool = fts.top(fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id", "content"]), "chunk_id", 60).withColumnRenamed("rank", "pos")
    return rerank.rerank(pool, rerank.shared_terms(["the", "with", "nation"])).select("chunk_id", "pos", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS c FROM embeddings, q)
SELECT vec_id, round(c, 6) AS score FROM s ORDER BY c DESC, vec_id LIMIT 14"""
)
def rerank_vectors(spark, sf):
    """The funnel over the whole table: the shortlist is the nearest vectors, whatever their ids."""
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    scored = rows.crossJoin(F.broadcast(asked)).select("vec_id", rerank.cosine(F.col("embedding"), F.col("q")).alias("score"))  # one question vector
    nearest = scored.orderBy(F.desc("score"), "vec_id").limit(V.SHORTLIST)
    pool = nearest.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return rerank.rerank(pool, lambda x: x, content="score").select("vec_id", F.round("rerank_score", 6).alias("score"))


@query(
    r"""SELECT doc_id, contains(t, 'the') AND contains(t, 'an') AND (contains(t, 'idiot') OR contains(t, 'with')) AND NOT contains(t, 'trash') AS passed FROM (SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS t FROM documents)"""
)
def golden_grade(spark, sf):
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    return table(spark, sf, "documents").select("doc_id", assemble.grade(F.col("text"), words("the", "An"), words("idiot", "With"), words("trash")).alias("passed"))


@query(
    r"""WITH c(pos, label) AS (VALUES (0, 'the ingly idiot'), (1, 'worthless trash of with'), (2, 'clown thing')), t AS (SELECT pos, list_filter(string_split(label, ' '), lambda x: length(x) >= 3 AND x <> 'the') AS ts FROM c),
r AS (SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS x FROM documents),
s AS (SELECT doc_id, pos, len(list_filter(ts, lambda t: contains(x, t))) / len(ts)::DOUBLE AS share FROM r, t)
SELECT doc_id, pos, round(share, 6) AS share FROM s WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, pos) = 1"""
)
def citation_match(spark, sf):
    cited = spark.createDataFrame([(0, "The Ingly idiot"), (1, "worthless trash of with"), (2, "Clown, thing")], "pos int, label string")
    found = assemble.citation_match(table(spark, sf, "documents").select("doc_id", F.col("text").alias("reference")), cited, ["the"])
    return found.select("doc_id", "pos", F.round("share", 6).alias("share"))


@query(
    r"""WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE i % 9 WHEN 1 THEN '## ' || x WHEN 3 THEN '| ' || x || ' |' WHEN 4 THEN '|-|' WHEN 6 THEN '```' WHEN 7 THEN '' ELSE x END) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d), f AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l),
k AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN starts_with(trim(line), '|') THEN 'table' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM f),
o AS (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') OR kind = 'heading' OR fence AND fences % 2 = 1 AS opens FROM k),
b AS (SELECT *, (sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS block FROM o)
SELECT doc_id AS chunk_id, block, kind, string_agg(line, chr(10) ORDER BY n) AS body FROM b WHERE kind <> 'blank' GROUP BY ALL"""
)
def markdown_blocks(spark, sf):
    def line(x, i):
        k = (i + 1) % 9
        return F.when(k == 1, F.concat(F.lit("## "), x)).when(k == 3, F.concat(F.lit("| "), x, F.lit(" |"))).when(k == 4, "|-|").when(k == 6, "```").when(k == 7, "").otherwise(x)

    md = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return assemble.markdown_blocks(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), md.alias("md")), "chunk_id", "md")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1,7' WHEN event_id % 3 = 1 THEN '3' ELSE '' END AS ints FROM events")
def json_int_array(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, '```json\n[1, "7", true, 2.5]\n```').when(k % 3 == 1, '[3.0, "x", false]').otherwise("no list")
    return table(spark, sf, "events").select("event_id", F.array_join(assemble.json_ints(raw).cast("array<string>"), ",").alias("ints"))


@query(r"SELECT p_partkey, (p_partkey % 700) || '/' || (p_size % 9) AS key FROM part")
def number_keys(spark, sf):
    raw = F.concat(F.lit("00"), (F.col("p_partkey") % 700).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-0").otherwise("/ 0"), (F.col("p_size") % 9).cast("string"))
    return table(spark, sf, "part").select("p_partkey", T.number_key(raw).alias("key"))


# --- questions ---------------------------------------------------------------------------------------------------------
@query(
    """SELECT o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN k WHEN 1 THEN k || ',' || (o_orderkey % 90 + 2) || ',' || (o_orderkey % 90 + 3) || ',' || (o_orderkey % 90 + 4) WHEN 2 THEN '1er,' || k || ' bis' ELSE '' END AS articles
FROM (SELECT o_orderkey, (o_orderkey % 90 + 1)::VARCHAR AS k FROM orders)"""
)
def requested_articles(spark, sf):
    k = F.col("o_orderkey") % 90 + 1
    text = lambda x: x.cast("string")
    question = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("que dit l'Article "), text(k), F.lit(" ?"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("les articles "), text(k), F.lit(" à "), text(k + 3))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("articles premier et "), text(k), F.lit("-bis"))).otherwise(F.lit("quel taux ?"))
    # A range lists its first and last number, then what lies between.
    found = search.requested_articles(question)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.array_join(F.when(F.col("o_orderkey") % 4 == 1, F.array_sort(found.cast("array<int>")).cast("array<string>")).otherwise(found), ",").alias("articles"))


@query("SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderstatus) || 'numerique' WHEN 1 THEN 'travail' END AS keyword FROM orders")
def informal_codes(spark, sf):
    k = F.col("o_orderkey")
    question = F.when(k % 3 == 0, F.concat(F.lit("que dit le Code du "), "o_orderstatus", F.lit("Numérique ?"))).when(k % 3 == 1, F.lit("code de l'un et de la\nle code des Travail")).otherwise(F.lit("aucun encode"))
    question = F.when(k % 3 == 1, F.lit("le code de l'un et des travail")).otherwise(question)
    return table(spark, sf, "orders").select(k.alias("ord"), search.informal_code_keyword(question).alias("keyword"))


@query("SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 900 + 1) || '/' || (1960 + o_orderkey % 60) WHEN 1 THEN '' ELSE '12/2001,' || (o_orderkey % 90 + 10) || '/11' END AS numbers FROM orders")
def bare_numbers(spark, sf):
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    question = F.when(k % 3 == 0, F.concat(F.lit("le "), F.lpad(text(k % 900 + 1), 3, "0"), F.lit("/"), text(k % 60 + 1960), F.lit(", article 4"))).when(k % 3 == 1, F.lit("au 31.12.2025, article 47 ou 2001")).otherwise(F.concat(F.lit("012-2001 et "), text(k % 90 + 10), F.lit(".011 ?")))
    return table(spark, sf, "orders").select(k.alias("ord"), F.array_join(resolve.bare_numbers(question), ",").alias("numbers"))


@query(f"WITH {bm25_cte(TERMS)} SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM bm WHERE source = 'src3' QUALIFY rank <= 10")
def bm25_scoped(spark, sf):
    scored = fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id", "document_id"]).filter("document_id = 'src3'")
    return fts.top(scored, "chunk_id", V.SCOPED_CHUNKS).select("chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {bm25_cte(TERMS)}, p AS (SELECT chunk_id, source, row_number() OVER (ORDER BY score, chunk_id) AS pos FROM bm QUALIFY pos <= 100) SELECT chunk_id, source AS document_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM p) WHERE n <= 3 ORDER BY pos LIMIT 20")
def per_document_cap(spark, sf):
    pool = fts.top(fts.score_scan(corpus(spark, sf), TERMS, keep=["chunk_id", "document_id"]), "chunk_id", 100)
    rows = pool.select("chunk_id", "document_id", F.lit(0).cast("bigint").alias("size"), F.col("rank").cast("bigint").alias("pos"))
    return search.within_budget(rows, limit=20, budget=1 << 40, per_document=3).select("chunk_id", "document_id", F.col("pos").cast("int").alias("pos"))


@query(
    f"""WITH {_L}, r AS (SELECT ty AS instrument_type, nkey AS number_key, k, k * 7919 % 10007 AS size, k % 41 <> 0 AND k % 43 <> 0 AND superseded_note = '' AS ok FROM l)
SELECT instrument_type, number_key, arg_min(k::VARCHAR, (-size, k)) AS id FROM r WHERE ok GROUP BY ALL"""
)
def largest_copies(spark, sf):
    docs = _legal(spark, sf).withColumnRenamed("document_id", "id").withColumn("character_count", F.col("ord") * 7919 % 10007)
    return search.largest_copies(resolve.registry(docs))


@query(
    f"""WITH {_L}, r AS (SELECT k, nkey, ty, k * 7919 % 10007 AS size FROM l WHERE status = 'ready' AND present AND superseded_note = '')
SELECT 0 AS ord, 'full_text' AS mode, arg_min(k::VARCHAR, (-size, k)) AS id FROM r WHERE ty = 'Loi' AND nkey = '12/4'
UNION ALL SELECT 1, 'full_text', arg_min(k::VARCHAR, (-size, k)) FROM r WHERE ty = 'Décret' AND nkey = '55/2'"""
)
def named_instrument(spark, sf):
    """The texts of the two decrees and laws that a question cites, of all documents."""
    docs = _legal(spark, sf).withColumnRenamed("document_id", "id").withColumn("character_count", F.col("ord") * 7919 % 10007)
    texts = docs.select("id", F.col("title").alias("text"))
    entries = resolve.named_instruments(resolve.registry(docs), texts, corpus(spark, sf), "que disent la Loi n° 12/04 et le Décret n° 055/2 ?")
    return spark.createDataFrame([(i, e.mode, e.id) for i, e in enumerate(entries)], "ord int, mode string, id string")


@query(f"WITH {_L} SELECT ty || '|' || nkey AS block, string_agg(document_id, ',' ORDER BY document_id) AS ids FROM l WHERE present GROUP BY ty, nkey HAVING count(*) > 1")
def legal_key_groups(spark, sf):
    docs = _legal(spark, sf).withColumn("duplicate_of", F.lit(""))
    return dedup.title_groups(docs).select("block", F.array_join("ids", ",").alias("ids"))


@query(
    f"""WITH {_STATUS}, e AS (SELECT source_type, source_key, target_type, target_key FROM edges)
SELECT instrument_type, number_key, status, (SELECT count(*) FROM e WHERE source_type = instrument_type AND source_key = number_key)::BIGINT AS outgoing, incoming FROM st WHERE number_key = '12/4'"""
)
def status_lookup(spark, sf):
    nodes, edges = graph.build(_legal(spark, sf))
    found = graph.find(graph.status(nodes, edges), "12/4")
    forth = edges.groupBy(F.col("source_type").alias("instrument_type"), F.col("source_key").alias("number_key")).agg(F.count(F.lit(1)).alias("outgoing"))
    return found.join(forth, graph.KEY, "left").select(*graph.KEY, "status", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), "incoming")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || role END AS text FROM conversations")
def message_texts(spark, sf):
    m = table(spark, sf, "conversations")
    parts = F.to_json(F.array(F.struct(F.col("text").alias("text")), F.struct(F.col("role").alias("text"))))
    alone = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r"^\{\"t\":|\}$", "")
    return m.select("conv_id", "turn", assemble.message_text(F.when(F.col("turn") % 2 == 0, alone).otherwise(parts)).alias("text"))


@query(
    """SELECT doc_id AS id, contains(t, 'the') AND NOT contains(t, 'trash') AND doc_id % 5 <> 0 AS passed FROM (SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS t FROM documents)"""
)
def golden_run(spark, sf):
    docs = table(spark, sf, "documents")
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    cases = docs.select(F.col("doc_id").alias("id"), words("the").alias("must_contain"), F.array().cast("array<string>").alias("any_of"), words("Trash").alias("must_not_contain"))
    return assemble.golden_run(cases, docs.filter("doc_id % 5 != 0").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))).select("id", "passed")


@query(
    """WITH r AS (SELECT doc_id AS k, source, CASE WHEN doc_id % 23 = 0 THEN 'needs_ocr' WHEN doc_id % 29 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'insufficient_text' ELSE 'ready' END AS status, doc_id % 11 = 0 AS review, doc_id % 19 = 0 AS dup,
doc_id % 7 = 0 AS tried, doc_id % 4 <> 0 AND doc_id % 6 <> 1 AS held, doc_id % 3 <> 0 AS current, doc_id % 10 = 0 AS remote, doc_id % 20 = 0 AS far FROM documents WHERE doc_id % 17 <> 0),
e AS (SELECT *, NOT dup AND status = 'ready' AND (NOT review OR remote OR current) AS eligible FROM r)
SELECT count(*) AS discovered, count(*) FILTER (status <> 'error') AS prepared, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'needs_ocr') AS needs_ocr,
count(*) FILTER (NOT review AND NOT tried AND status IN ('needs_ocr', 'insufficient_text')) AS ocr_pending, count(*) FILTER (review AND NOT tried AND status IN ('needs_ocr', 'insufficient_text')) AS ocr_pending_review_required,
count(*) FILTER (NOT review AND tried AND status IN ('needs_ocr', 'insufficient_text')) AS ocr_attempted_unresolved, count(*) FILTER (status = 'insufficient_text') AS insufficient_text, count(*) FILTER (review) AS review_required, count(*) FILTER (status = 'error') AS errors,
count(*) FILTER (eligible AND far) AS indexed, count(*) FILTER (eligible AND held AND current) AS locally_indexed, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND held AND current) AS local_covered,
count(*) FILTER (eligible) - count(*) FILTER (eligible AND held AND current) AS local_missing, count(*) FILTER (eligible AND far) AS remote_covered, count(*) FILTER (eligible) - count(*) FILTER (eligible AND far) AS remote_missing, count(*) FILTER (dup) AS duplicates,
round(100.0 * count(*) FILTER (eligible AND held AND current) / count(*) FILTER (eligible), 2)::DOUBLE AS local_coverage_percent, round(100.0 * count(*) FILTER (eligible AND far) / count(*) FILTER (eligible), 2)::DOUBLE AS remote_coverage_percent,
count(DISTINCT source) AS sources, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS local_index_documents, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS local_chunks FROM e"""
)
def index_summary(spark, sf):
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        k.alias("id"),
        "source",
        (k % 17 != 0).alias("present"),
        F.when(k % 23 == 0, "needs_ocr").when(k % 29 == 0, "error").when(k % 13 == 0, "insufficient_text").otherwise("ready").alias("status"),
        (k % 11 == 0).alias("requires_review"),
        F.when(k % 19 == 0, "other").otherwise("").alias("duplicate_of"),
        F.lit(".PDF").alias("extension"),
        (k % 7 == 0).alias("ocr_attempted"),
        F.array().cast("array<int>").alias("ocr_pages"),
        F.array().cast("array<string>").alias("warnings"),
        F.array().cast("array<int>").alias("empty_pages"),
        F.sha2("text", 256).alias("extracted_sha256"),
        F.lit("").alias("sha256"),
        F.when(k % 3 == 0, 3).otherwise(4).alias("local_index_revision"),
        F.when(k % 10 == 0, "f").otherwise("").alias("remote_file_id"),
        F.when(k % 20 == 0, F.sha2("text", 256)).alias("remote_hash"),
    )
    index = table(spark, sf, "documents").filter("doc_id % 4 != 0").select(k.alias("id"), F.when(k % 6 == 1, "stale").otherwise(F.sha2("text", 256)).alias("indexed_hash"))
    chunks = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(k.alias("document_id"))
    out = indexing.summary(docs, index, chunks)
    return out.withColumn("sources", F.size("by_source").cast("bigint")).drop("by_source")
