"""Retrieval over ranked candidates: fusion of several queries, article priority, limits per document, a context budget,
search inside a document, and the choice of a named instrument."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import article_tag, fold, recency_score
from . import fts

_LIST = rf"(?U)\barticles?\s+({V.ARTICLE_NUMBER}(?:\s*(?:,|;|\bet\b|à|\ba\b|-)\s*{V.ARTICLE_NUMBER})*)"
# What a retrieved chunk holds.
CHUNK = "chunk_id long, document_id string, title string, source string, source_label string, category string, published_date string, source_url string, locator string, content string, article_number string, score double"
RANGE = 20  # articles that a range may reach beyond its first


def requested_articles(question: Column) -> Column:
    """Article numbers that a question names, as chunks carry them; two numbers joined by à, a or - stand for the range."""

    def numbers(part: Column) -> Column:
        named = F.transform(F.regexp_extract_all(part, F.lit(V.ARTICLE_NUMBER), F.lit(0)), article_tag)
        first, last = (F.try_element_at(named, F.lit(i)).try_cast("int") for i in (1, 2))
        ranged = (F.size(named) == 2) & part.rlike(r"(?U)à|\ba\b|-") & (first <= last) & (last <= first + RANGE)
        return F.concat(named, F.when(F.coalesce(ranged, F.lit(False)), F.sequence(first, last).cast("array<string>")).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(question), F.lit(_LIST), F.lit(1)), numbers)))


def of_question(spark: SparkSession, question: str, value: Callable[[Column], Column]) -> object:
    """What an expression makes of one question."""
    return spark.createDataFrame([(question,)], "q string").select(value(F.col("q")).alias("v")).first()["v"]


def article_hits(content: Column, number: Column, requested: Iterable[str]) -> Column:
    """How many of the requested articles a text refers to; a text that is tagged with one counts one more than all."""
    requested = list(requested)
    if not requested:
        return F.lit(0)
    asked = F.array(*[F.lit(x) for x in sorted(requested)])
    found = F.regexp_extract_all(F.lower(content), F.lit(rf"(?U)\barti\w{{0,10}}\s*[.:°º-]*\s*({V.ARTICLE_NUMBER})\b"), F.lit(1))
    named = F.size(F.array_intersect(F.array_distinct(F.transform(found, article_tag)), asked))
    return F.when(number.isNotNull() & (number != "") & F.array_contains(asked, article_tag(number)), F.lit(len(requested) + 1)).otherwise(named)


def candidates(chunks: DataFrame, question: str, sources: list[str] | None = None, limit: int = V.POOL, key: str = "chunk_id") -> DataFrame:
    """The best chunks for one question with score and rank. Unknown source lists are no filter; statistics know no filter."""
    return ranked(chunks, [question], sources, limit, key)[0]


def ranked(chunks: DataFrame, questions: list[str], sources: list[str] | None = None, limit: int = V.POOL, key: str = "chunk_id", document_id: str | None = None) -> list[DataFrame]:
    """The best chunks for each question, all found in one pass that carries keys only; their other columns are joined."""
    scored = fts.score_scans(chunks, [fts.search_terms(q) for q in questions], keep=[key, "source", "document_id"])
    out = []
    for rows in scored:
        if sources:
            rows = rows.filter(F.col("source").isin(sources))
        if document_id is not None:
            rows = rows.filter(F.col("document_id") == document_id)
        best = fts.top(rows.select(key, "score"), key, limit)
        out.append(chunks.join(F.broadcast(best), key).select(*chunks.columns, "score", "rank"))  # limit rows at most
    return out


def fused(per_query: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """One row per chunk: the row of its best rank over the queries, the earlier query on ties."""
    rows = None
    for i, df in enumerate(per_query):
        part = df.withColumn("query_ord", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("rank", "query_ord")).alias("b"))
    return best.select(key, "b.*").withColumnRenamed("rank", "best_rank")


def ordered(rows: DataFrame, requested: Iterable[str], as_of_year: int, key: str = "chunk_id") -> DataFrame:
    """Rows with pos: more article hits first, then the better rank, then the score with its penalty for age."""
    hits = article_hits(F.col("content"), F.col("article_number"), requested)
    adjusted = recency_score(F.col("score"), F.col("title"), F.col("published_date"), as_of_year)
    rows = rows.withColumn("article_hits", hits).withColumn("adjusted", adjusted)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("article_hits"), "best_rank", "adjusted", key)))


def within_budget(rows: DataFrame, limit: int = V.RESULTS, budget: int = V.CONTEXT_BUDGET, per_document: int = V.PER_DOCUMENT, size: str = "size", document: str = "document_id", pos: str = "pos") -> DataFrame:
    """The positions that a greedy reader takes: in order, at most so many of a document, a text that does not fit is
    skipped and the next one tried, the first is always taken. rows is a bounded pool; the fold is one expression."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"), F.create_map().cast("map<string,int>").alias("of"))

    def read(acc: Column, x: Column) -> Column:
        seen = F.coalesce(F.try_element_at(acc["of"], x["d"]), F.lit(0))
        first = F.size(acc["taken"]) == 0
        fits = first | (acc["used"] + x["s"] <= budget)
        take = (F.size(acc["taken"]) < limit) & (seen < per_document) & fits
        others = F.map_filter(acc["of"], lambda k, _: k != x["d"])
        more = F.struct((acc["used"] + x["s"]).alias("used"), F.concat(acc["taken"], F.array(x["p"])).alias("taken"), F.map_concat(others, F.create_map(x["d"], seen + 1)).alias("of"))
        return F.when(take, more).otherwise(acc)

    pool = rows.select(F.struct(F.col(pos).cast("int").alias("p"), F.col(document).cast("string").alias("d"), F.col(size).cast("long").alias("s")).alias("x"))
    chosen = pool.agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.explode(F.aggregate("xs", start, read)["taken"]).alias("__pos"))
    return rows.join(F.broadcast(chosen), F.col(pos) == F.col("__pos")).drop("__pos")  # at most limit rows


def search(chunks: DataFrame, question: str, as_of_year: int, sources: list[str] | None = None, limit: int = V.RESULTS, budget: int = V.CONTEXT_BUDGET, extra_queries: list[str] | None = None) -> DataFrame:
    """chunks: chunk_id, document_id, title, source, published_date, locator, content, article_number. The chosen chunks in
    order of pos."""
    asked = [q for q in [question, *(extra_queries or [])] if q.strip()]
    pool = fused(ranked(chunks, asked, sources, max(V.POOL, limit)))
    placed = ordered(pool, of_question(chunks.sparkSession, question, requested_articles), as_of_year).withColumn("size", F.length("content"))
    return within_budget(placed, limit, budget)


def interleaved(per_query: list[DataFrame], limit: int, key: str = "chunk_id") -> DataFrame:
    """Round robin over the queries' rankings: first ranks first, in query order; the first time a chunk comes counts."""
    rows = None
    for i, df in enumerate(per_query):
        part = df.withColumn("query_ord", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != key]
    firsts = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("rank", "query_ord")).alias("b")).select(key, "b.*")
    return firsts.orderBy("rank", "query_ord").limit(limit)


def within_document(chunks: DataFrame, question: str, document_id: str, limit: int = V.SCOPED_CHUNKS, extra_queries: list[str] | None = None) -> DataFrame:
    """The best chunks of one document; statistics are those of the corpus."""
    asked = [q for q in [question, *(extra_queries or [])] if q.strip()]
    return interleaved(ranked(chunks, asked, None, limit, "chunk_id", document_id), limit)


# Words between "code" and the noun that names it.
CODE_STOP_WORDS = "du de des la le les l d un une et".split()


def informal_code_keyword(question: Column) -> Column:
    """The first word after "code" in a question, articles and the like passed over; null if there is none."""
    rest = F.regexp_extract(fold(question), r"\bcode\b\s+(.+)", 1)
    return F.get(F.filter(F.regexp_extract_all(rest, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(CODE_STOP_WORDS)), 0)


def usable() -> Column:
    """Ready documents that are there and that no later text supersedes."""
    return (F.col("status") == "ready") & F.coalesce(F.col("present"), F.lit(True)) & (F.coalesce(F.col("superseded_note"), F.lit("")) == "")


def code_document(documents: DataFrame, keyword: str) -> DataFrame:
    """The document that a code's informal name means: its title has the word code and the keyword; "portant code" counts
    two, length up to one more; the earlier document on ties."""
    title = fold(F.coalesce("title", F.lit("")))
    found = documents.filter(usable()).filter(title.contains("code") & title.contains(keyword))
    points = F.when(title.contains("portant code"), 2.0).otherwise(0.0) + F.least(F.coalesce("character_count", F.lit(0)) / 1e6, F.lit(1.0))
    return found.withColumn("points", points).orderBy(F.desc("points"), "ord").limit(1)


def largest_copies(documents: DataFrame) -> DataFrame:
    """The longest usable copy of each instrument (instrument_type, number_key), the earlier one on ties."""
    mine = documents.filter(usable()).filter("instrument_type is not null")
    best = F.min_by("id", F.struct(-F.coalesce("character_count", F.lit(0)), "ord"))
    return mine.groupBy("instrument_type", "number_key").agg(best.alias("id"))
