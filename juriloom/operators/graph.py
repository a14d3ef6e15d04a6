"""The graph of instruments and articles: nodes, stubs for what is only named, edges, status. Keys are natural keys
(type, number key), so that a rebuild never breaks links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import article_key
from ..storage import written
from .legal import ARTICLE_TOKEN, article_matches, parsed_titles, question_mentions, title_relationships

KEY = ["instrument_type", "number_key"]


def live(docs: DataFrame) -> DataFrame:
    return docs.filter((F.coalesce(F.col("status"), F.lit("")) != "error") & F.coalesce(F.col("present"), F.lit(True)))


def titles(docs: DataFrame) -> DataFrame:
    """parsed_titles() of the live documents as a table: groups, edges and all that follows read it, and titles are parsed once.
    docs: document_id, title, source_label, superseded_note, status, present, ord."""
    wanted = live(docs).select("document_id", "title", "source_label", "superseded_note", "ord")
    return written(parsed_titles(wanted).filter("own is not null"), "titles")


def instrument_groups(parsed: DataFrame) -> DataFrame:
    """One row per instrument of titles(): title and number of its first document, the first date, sources, notes."""
    rows = parsed.select(F.col("own.type").alias("instrument_type"), "own.number_key", "own.number", "own.date", "own.authority", "title", "source_label", "superseded_note", "ord")
    note = F.coalesce(F.col("superseded_note"), F.lit(""))
    # A note that an earlier one holds is not repeated.
    notes = F.transform(F.array_sort(F.collect_list(F.when(note != "", F.struct("ord", note.alias("note"))))), lambda x: x["note"])
    joined = F.aggregate(notes, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.contains(x), acc).otherwise(F.concat(acc, F.lit("; "), x)))
    return rows.groupBy(*KEY).agg(
        F.min_by("title", "ord").alias("title"),
        F.min_by("number", "ord").alias("instrument_number"),
        F.coalesce(F.min_by(F.nullif("date", F.lit("")), F.when(F.col("date") != "", F.col("ord"))), F.lit("")).alias("instrument_date"),
        F.min_by("authority", "ord").alias("authority_score"),
        F.count(F.lit(1)).alias("document_count"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("source_label", F.lit("")))), ", ").alias("sources"),
        joined.alias("superseded_note"),
    ).withColumn("in_corpus", F.lit(True))


def relationships(parsed: DataFrame) -> DataFrame:
    """Edges between instruments that titles() state: the first statement of an edge counts, none leads back to itself."""
    found = title_relationships(parsed)
    rows = found.select(F.col("own.type").alias("source_type"), F.col("own.number_key").alias("source_key"), "relation", F.col("target.type").alias("target_type"), F.col("target.number_key").alias("target_key"), F.col("target.number").alias("target_number"), F.col("target.date").alias("target_date"), F.col("target.authority").alias("target_authority"), "partial", F.struct("ord", "seq").alias("__o"))
    rows = rows.filter((F.col("source_type") != F.col("target_type")) | (F.col("source_key") != F.col("target_key")))
    edge = ["source_type", "source_key", "relation", "target_type", "target_key"]
    return rows.groupBy(*edge).agg(F.min_by(F.struct("target_number", "target_date", "target_authority", "partial"), "__o").alias("x"), F.min("__o").alias("first_seen")).select(*edge, "x.*", "first_seen")


def stub_instruments(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Instruments that are named as targets only, as first named."""
    named = edges.groupBy(F.col("target_type").alias("instrument_type"), F.col("target_key").alias("number_key")).agg(F.min_by(F.struct("target_number", "target_date", "target_authority"), "first_seen").alias("x"))
    title = F.trim(F.concat(F.col("instrument_type"), F.lit(" n° "), F.col("x.target_number")))
    return named.join(groups.select(*KEY), KEY, "left_anti").select(*KEY, title.alias("title"), F.col("x.target_number").alias("instrument_number"), F.col("x.target_date").alias("instrument_date"), F.col("x.target_authority").alias("authority_score"), F.lit(0).cast("bigint").alias("document_count"), F.lit("").alias("sources"), F.lit("").alias("superseded_note"), F.lit(False).alias("in_corpus"))


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruments with stubs, edges)."""
    parsed = titles(docs)
    groups, edges = instrument_groups(parsed), written(relationships(parsed), "edges")
    return groups.unionByName(stub_instruments(groups, edges)), edges


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with status: a note of the corpus first, then whole repeal, then amendment (or partial repeal), then whether
    the text is there at all."""
    hit = edges.groupBy(F.col("target_type").alias("instrument_type"), F.col("target_key").alias("number_key")).agg(
        F.bool_or((F.col("relation") == "REPEALS") & ~F.col("partial")).alias("repealed"),
        F.bool_or(F.col("relation").isin("MODIFIES", "COMPLEMENTS") | ((F.col("relation") == "REPEALS") & F.col("partial"))).alias("modified"),
        F.count(F.lit(1)).alias("incoming"),
    )
    rows = nodes.join(hit, KEY, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    value = F.when(F.col("superseded_note") != "", "flagged_superseded").when(yes("repealed"), "repealed").when(yes("modified"), "modified").when(~F.col("in_corpus"), "referenced_not_indexed").otherwise("presumed_in_force")
    return rows.select(nodes.columns + [value.alias("status"), F.coalesce("incoming", F.lit(0)).alias("incoming")])


def incoming(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their source instrument, newest first when read in order."""
    source = nodes.select(F.col("instrument_type").alias("source_type"), F.col("number_key").alias("source_key"), F.col("title").alias("source_title"), F.col("instrument_date").alias("source_date"))
    return edges.join(source, ["source_type", "source_key"]).orderBy(F.desc("source_date"), "source_type", "source_key", "relation")


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    target = nodes.select(F.col("instrument_type").alias("target_type"), F.col("number_key").alias("target_key"), F.col("title").alias("target_title"), "in_corpus")
    return edges.join(target, ["target_type", "target_key"], "left")


def find(nodes: DataFrame, number_key: str, instrument_type: str | None = None) -> DataFrame:
    """Instruments of a number; an empty key finds none."""
    found = nodes.filter((F.col("number_key") == number_key) & F.lit(number_key != ""))
    return found.filter(F.col("instrument_type") == instrument_type) if instrument_type else found


def stats(nodes: DataFrame, edges: DataFrame, article_nodes: DataFrame | None = None, article_edges: DataFrame | None = None) -> DataFrame:
    """One row of counts; those of articles are 0 where their tables are not built yet."""
    n = nodes.agg(F.count(F.lit(1)).alias("instruments"), F.count_if("in_corpus").alias("instruments_in_corpus"), F.count_if(~F.col("in_corpus")).alias("stub_instruments"))
    rows = n.crossJoin(edges.agg(F.count(F.lit(1)).alias("relationships")))  # one row each
    for table, name in ((article_nodes, "articles"), (article_edges, "article_relationships")):
        rows = rows.crossJoin(table.agg(F.count(F.lit(1)).alias(name))) if table is not None else rows.withColumn(name, F.lit(0).cast("bigint"))
    return rows


def rebuild_articles(chunks: DataFrame | None, docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(articles, edges) of the chunks of an index, by what docs (see titles()) say that their documents are; nothing without an
    index."""
    if chunks is None:
        return None
    own = titles(docs).select("document_id", F.col("own.type").alias("instrument_type"), F.col("own.number_key").alias("number_key"))
    edges = written(article_edges(chunks, own), "article-edges")
    nodes = articles(chunks, edges, own)
    return nodes, backfill(edges, nodes, own)


def label(relation: Column, inverse: bool = False) -> Column:
    pairs = [F.lit(x) for r, names in V.RELATION_LABELS.items() for x in (r, names[inverse])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), relation), relation)


def status_brief(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found (nodes with status) with brief: a few lines on status and relationships, in a fixed order."""
    forth = edges.select(F.col("source_type").alias("instrument_type"), F.col("source_key").alias("number_key"), F.struct(F.lit(1).alias("side"), F.concat_ws(" ", label(F.col("relation")), F.col("target_type"), F.concat(F.lit("n° "), F.col("target_number")), F.when(F.col("partial"), F.lit("(partiel)"))).alias("line")).alias("l"))
    back = edges.select(F.col("target_type").alias("instrument_type"), F.col("target_key").alias("number_key"), F.struct(F.lit(0).alias("side"), F.concat_ws(" ", label(F.col("relation"), True), F.col("source_type"), F.concat(F.lit("n° "), F.col("source_key")), F.when(F.col("partial"), F.lit("(partiel)"))).alias("line")).alias("l"))
    lines = forth.unionByName(back).groupBy(*KEY).agg(F.array_sort(F.collect_set("l")).alias("ls"))
    rows = found.join(lines, KEY, "left")
    text = F.concat_ws("\n", F.concat_ws(" ", "title", F.concat(F.lit("["), F.col("status"), F.lit("]"))), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    return rows.select(*found.columns, text.alias("brief"))


def article_edges(chunks: DataFrame, own: DataFrame) -> DataFrame:
    """Edges from articles to articles. chunks: document_id, content, article_number, ord. own: document_id and the key of the
    instrument that it is (nulls if none). An edge of one source to one target article counts once, unless the target
    instrument is not known: such rows stay."""
    rows = chunks.filter("article_number is not null and article_number != ''").select("document_id", "ord", article_key(F.col("article_number")).alias("source_article"), F.coalesce("content", F.lit("")).alias("__text"))
    said = rows.select("__text").distinct().select("__text", F.explode(article_matches(F.col("__text"))).alias("m"))  # equal texts are parsed once
    rows = rows.join(said, "__text").drop("__text")
    rows = rows.join(own.select("document_id", F.col("instrument_type").alias("own_type"), F.col("number_key").alias("own_key")), "document_id", "left")
    target = lambda a, b: F.when(F.col("m.is_self"), F.col(a)).otherwise(F.col(b))
    rows = rows.select("document_id", "source_article", "ord", F.col("m.relation").alias("relation"), target("own_type", "m.type").alias("target_type"), target("own_key", "m.number_key").alias("target_key"), F.col("m.granularity").alias("granularity"), F.col("m.raw").alias("raw"), F.posexplode("m.numbers").alias("seq", "number"))
    rows = rows.withColumn("target_article", article_key(F.col("number"))).drop("number")
    keys = ["document_id", "source_article", "relation", "target_type", "target_key", "target_article"]
    known = rows.filter("target_type is not null").withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "seq"))).filter("__r = 1").drop("__r")
    return known.unionByName(rows.filter("target_type is null"))


def articles(chunks: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """Article nodes: those of tagged chunks, and those that an insertion makes in a document of the target instrument."""
    tagged = chunks.filter("article_number is not null and article_number != ''").select("document_id", article_key(F.col("article_number")).alias("article_key"))
    home = own.filter("instrument_type is not null").groupBy(*KEY).agg(F.min("document_id").alias("document_id"))
    made = edges.filter("relation = 'INSERTS'").join(home.withColumnsRenamed({"instrument_type": "target_type", "number_key": "target_key", "document_id": "home"}), ["target_type", "target_key"]).select(F.col("home").alias("document_id"), F.col("target_article").alias("article_key"))
    return tagged.unionByName(made).distinct()


def backfill(edges: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """edges with target_document: the least document of the target instrument that has the target article, if any."""
    held = nodes.join(own, "document_id").groupBy(F.col("instrument_type").alias("target_type"), F.col("number_key").alias("target_key"), F.col("article_key").alias("target_article")).agg(F.min("document_id").alias("target_document"))
    return edges.join(held, ["target_type", "target_key", "target_article"], "left")


def requested_article_keys(question: Column) -> Column:
    """Keys of the articles that a question names, in order."""
    lists = F.regexp_extract_all(question, F.lit(rf"(?iu)\barticles?\s+({ARTICLE_TOKEN}(?:\s*(?:,|;|et|à|a|-)\s*{ARTICLE_TOKEN})*)"), F.lit(1))
    tokens = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(f"(?i){ARTICLE_TOKEN}"), F.lit(0))))
    return F.array_distinct(F.transform(tokens, article_key))


def article_brief(question: str, nodes: DataFrame, edges: DataFrame, article_nodes: DataFrame, own: DataFrame, most: int = 4) -> DataFrame:
    """(instrument_type, number_key, article_key, brief) for the instruments and articles that a question names, at most so
    many, in a fixed order: what other articles do to the article (known even if its text is not there) and what it does.
    nodes: instruments; edges: article_edges(); own: document_id with its instrument."""
    spark = nodes.sparkSession
    keys = spark.createDataFrame([(question,)], "q string").select(requested_article_keys(F.col("q")).alias("k")).first()["k"]
    asked = list(dict.fromkeys((m["type"], m["number_key"], a) for m in question_mentions(spark, question) if m["number_key"] for a in keys))
    wanted = spark.createDataFrame([(*x, i) for i, x in enumerate(asked)], "instrument_type string, number_key string, article_key string, ord int")
    known = wanted.join(nodes.select(*KEY, "title"), KEY)
    home = own.select("document_id", F.col("instrument_type").alias("own_type"), F.col("number_key").alias("own_key"))
    placed = edges.join(home, "document_id", "left")
    back = placed.select(F.col("target_type").alias("instrument_type"), F.col("target_key").alias("number_key"), F.col("target_article").alias("article_key"), F.struct(F.lit(0).alias("side"), F.concat_ws(" ", label(F.col("relation"), True), F.lit("article"), "source_article", F.concat(F.lit("de "), "own_type", F.lit(" n° "), "own_key")).alias("line")).alias("l"))
    tagged = article_nodes.select("document_id", F.col("article_key").alias("source_article"))
    forth = placed.join(tagged, ["document_id", "source_article"], "left_semi").select(F.col("own_type").alias("instrument_type"), F.col("own_key").alias("number_key"), F.col("source_article").alias("article_key"), F.struct(F.lit(1).alias("side"), F.concat_ws(" ", label(F.col("relation")), F.lit("article"), "target_article", F.concat(F.lit("de "), "target_type", F.lit(" n° "), "target_key")).alias("line")).alias("l"))
    keys = [*KEY, "article_key"]
    lines = known.join(back.unionByName(forth), keys).groupBy(*keys, "title", "ord").agg(F.array_sort(F.collect_set("l")).alias("ls"))
    text = F.concat_ws("\n", F.concat(F.lit("Article "), "article_key", F.lit(" — "), "title"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    return lines.orderBy("ord").limit(most).select(*keys, text.alias("brief"))
