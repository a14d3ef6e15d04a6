"""Evidence for an answer: citations, numbered context, grading of answers, fuzzy citation matches, tolerant JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import fold, legal_year


MOST_CITATIONS = 1000
CASE = "id string, question string, note string, must_contain array<string>, any_of array<string>, must_not_contain array<string>"  # of a golden run


def grouped_citations(chunks: DataFrame, document: str = "document_id", pos: str = "pos") -> DataFrame:
    """(document, first_pos, locators): documents as first seen, their distinct locators in order."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(pos, "locator"))), lambda x: x["locator"])
    return chunks.groupBy(document).agg(F.min(pos).alias("first_pos"), F.array_join(F.array_distinct(seen), "; ").alias("locators"))


def evidence_blocks(chunks: DataFrame, pos: str = "pos") -> DataFrame:
    number = F.row_number().over(Window.orderBy(pos))
    return chunks.select(pos, F.concat(F.lit("["), number.cast("string"), F.lit("] "), "title", F.lit(" ("), "locator", F.lit(")\n"), "content").alias("block"))


def context(chunks: DataFrame, pos: str = "pos") -> DataFrame:
    """One row: all evidence blocks in order; chunks are the few that a search returns."""
    blocks = evidence_blocks(chunks, pos)
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def retrieved_context(chunks: DataFrame, as_of_year: int, pos: str = "pos") -> DataFrame:
    """One row: the numbered sources of a search in the form that answers quote from. chunks, the few that a search returns:
    pos, document_id, title, source_label, locator, article_number, published_date, content."""
    number = F.row_number().over(Window.orderBy(pos)).cast("string")
    or_else = lambda c, other: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(other))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit('<retrieved_source number="'), number, F.lit('" document_id="'), F.col("document_id"), F.lit('">')),
        F.concat(F.lit("Title: "), "title"),
        F.concat(F.lit("Institution: "), F.coalesce("source_label", F.lit(""))),
        F.concat(F.lit("Locator: "), "locator"),
        F.concat(F.lit("Article: "), or_else(F.col("article_number"), "[not specified]")),
        F.concat(F.lit("Catalog date: "), or_else(F.col("published_date"), "[not provided]")),
        F.concat(F.lit("Inferred document year: "), or_else(legal_year(F.col("title"), F.col("published_date"), as_of_year), "[unknown]")),
        F.lit("Content:"),
        "content",
        F.lit("</retrieved_source>"),
    )
    blocks = chunks.select(pos, lines.alias("block"))
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def search_hints(queries: list[str] | None) -> str:
    """The block that offers other wordings to a search of the model's own; empty without any."""
    if not queries:
        return ""
    listed = "\n".join(f"- {q}" for q in queries)
    head = "Pistes de recherche alternatives (vocabulaire juridique précis) à utiliser en complément de la question ci-dessous pour rechercher dans la base documentaire :"
    return f"<search_hints>\n{head}\n{listed}\n</search_hints>"


def focused_reading(entries: list[Row]) -> str:
    """The block of the instruments that a question names, from resolve.named_instruments(); empty without any."""
    note = "This instrument is named directly in the question, so it is provided here in full (or, if too long, as its own most relevant passages only - not mixed with other documents) rather than relying solely on corpus-wide chunk ranking."
    out = []
    for e in entries:
        if e["mode"] == "full_text":
            body = f"Full text:\n{e['content']}"
        else:
            passages = "\n\n".join(f"[{c['locator']}, Article: {c['article_number'] or '[not specified]'}]\n{c['content']}" for c in e["chunks"])
            body = f"Document too long to include in full; its own top-matching passages for this question:\n{passages}"
        out.append(f'<focused_reading title="{e["title"]}" institution="{e["source_label"]}">\n{note}\n{body}\n</focused_reading>')
    return "\n\n".join(out)


def message_text(content: Column) -> Column:
    """The text of a message in JSON: a string as it is, of a list the texts of its parts, one a line; else nothing."""
    parsed = F.try_parse_json(content)
    kind = F.schema_of_variant(parsed)
    parts = F.filter(F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string")), lambda t: t.isNotNull())
    return F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, "\n")).otherwise(F.lit(""))


_REPLY = "struct<output:array<struct<type:string,content:array<struct<annotations:array<struct<file_id:string>>>>,results:array<struct<file_id:string>>>>>"


def file_ids(reply: Column) -> Column:
    """The files that a reply in JSON cites or has found, each once, in order."""

    def of(item: Column) -> Column:
        cited = F.flatten(F.transform(F.coalesce(item["content"], F.array().cast("array<struct<annotations:array<struct<file_id:string>>>>")), lambda c: F.coalesce(F.transform(c["annotations"], lambda a: a["file_id"]), F.array().cast("array<string>"))))
        found = F.transform(item["results"], lambda r: r["file_id"])
        return F.coalesce(F.when(item["type"] == "message", cited).when(item["type"] == "file_search_call", found), F.array().cast("array<string>"))

    ids = F.flatten(F.transform(F.from_json(reply, _REPLY)["output"], of))
    return F.coalesce(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != ""))), F.array().cast("array<string>"))


def golden_summary(run: DataFrame) -> DataFrame:
    """One row: cases, passed, failed (their ids in order)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id"))))
    return run.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), failed.alias("failed"))


def golden_run(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases (id, must_contain, any_of, must_not_contain) with passed, by their answers (id, answer); no answer is no pass."""
    rows = cases.join(answers.select("id", "answer"), "id", "left")
    passed = F.coalesce(grade(F.col("answer"), F.col("must_contain"), F.col("any_of"), F.col("must_not_contain")), F.lit(False))
    return rows.withColumn("passed", passed)


def grade(answer: Column, must: Column, any_of: Column, must_not: Column) -> Column:
    """True if the folded answer holds all of must, one of any_of (if there are any) and none of must_not."""
    text = fold(answer)
    holds = lambda x: text.contains(fold(x))
    return F.forall(must, holds) & ((F.size(any_of) == 0) | F.exists(any_of, holds)) & ~F.exists(must_not, holds)


def match_tokens(x: Column, stop: list[str]) -> Column:
    plain = F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " "))
    return F.array_distinct(F.filter(F.split(plain, " "), lambda t: (F.length(t) >= 3) & ~t.isin(stop)))


def citation_match(references: DataFrame, citations: DataFrame, stop: list[str], least: float = 0.5, ref: str = "reference", label: str = "label") -> DataFrame:
    """Each reference with the citation whose tokens it holds best, as substrings; none below the least share; the earlier
    citation on ties. citations (with pos) are the few of an answer: more than MOST_CITATIONS are an error, as each is
    compared with every reference."""
    if citations.limit(MOST_CITATIONS + 1).count() > MOST_CITATIONS:
        raise ValueError(f"an answer has at most {MOST_CITATIONS} citations")
    named = citations.withColumn("__t", match_tokens(F.col(label), stop)).filter(F.size("__t") > 0)
    text = F.trim(F.regexp_replace(fold(F.col(ref)), "[^a-z0-9]+", " "))
    both = references.withColumn("__x", text).crossJoin(F.broadcast(named))
    share = F.size(F.filter("__t", lambda t: F.col("__x").contains(t))) / F.size("__t")
    best = both.withColumn("share", share).filter(F.col("share") >= least)
    keys = references.columns
    return best.groupBy(*keys).agg(F.min_by(F.struct("pos", "share"), F.struct(-F.col("share"), "pos")).alias("b")).select(*keys, F.col("b.pos").alias("pos"), F.col("b.share").alias("share"))


def json_ints(raw: Column) -> Column:
    """Whole numbers of a JSON list in a reply, fences off: numbers, whole decimals and digit strings; booleans go."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    items = F.from_json(bare, "array<variant>")

    def number(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        value = F.try_variant_get(v, "$", "double")
        text = F.try_variant_get(v, "$", "string")
        return F.when(kind == "BOOLEAN", None).when(kind == "STRING", F.when(text.rlike(r"^\s*\d+\s*$"), F.trim(text).try_cast("bigint"))).when(value == F.floor(value), value.cast("bigint"))

    return F.coalesce(F.filter(F.transform(items, number), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def json_strings(raw: Column) -> Column:
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    items = F.filter(F.from_json(bare, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    text = F.filter(F.transform(items, lambda v: F.trim(F.try_variant_get(v, "$", "string"))), lambda t: t != "")
    return F.coalesce(text, F.array().cast("array<string>"))


def markdown_text(x: Column) -> Column:
    """Markdown without its marks."""
    for pattern, to in [(r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"\*\*|__|[*_]", ""), (r"\n{3,}", "\n\n")]:
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def table_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind, body): code between fences, headings, tables, other text; blank lines end a block of text."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(order)).withColumn("fence", fence)
    code = F.col("fence") | (F.col("fences") % 2 == 1)
    kind = F.when(code, "code").when(F.col("line").rlike(r"^#{1,6}\s"), "heading").when(F.trim("line").startswith("|"), "table").when(F.trim("line") == "", "blank").otherwise("text")
    lines = lines.withColumn("kind", kind)
    opens = (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit(""))) | (F.col("kind") == "heading") | (F.col("fence") & (F.col("fences") % 2 == 1))
    lines = lines.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(order)).filter("kind != 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, "block", "kind").agg(body.alias("body"))
