"""The text of an instrument that a question names: by its citation, by a bare number that the conversation has cited, by the
informal name of a code, or by a topic that one law governs. The first way that finds something is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import fold, number_key
from ..storage import written
from . import search
from .dedup import operative_text, source_rank
from .legal import instruments, question_mentions

# Numbers that look like those of instruments (a date is none), and topics with the law that governs them: words of
# a question, its type and number, the word its own text repeats, and how often at least.
BARE_NUMBER = r"(?<!\d[/\-.])\b\d{1,4}[/\-.]\d{2,4}\b(?![/\-.]\d)"
TOPICS = [
    (
        ["asbl", "association sans but lucratif", "associations sans but lucratif", "association a but non lucratif", "associations a but non lucratif"],
        ("Loi", "4/2001"),
        "association",
        10,
    ),
]


def registry(documents: DataFrame) -> DataFrame:
    """documents with instrument_type and number_key of what each is, as a table that many questions read. documents: id, title,
    source, source_label, status, present, superseded_note, duplicate_of, character_count, ord."""
    rows = instruments(documents).withColumns({"instrument_type": F.col("own.type"), "number_key": F.col("own.number_key")})
    return written(rows.drop("own"), "registry")


def bare_numbers(question: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(question, F.lit(BARE_NUMBER), F.lit(0)), number_key)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def by_citation(held: DataFrame, question: str) -> list[str]:
    """Ids of the longest usable copies of the instruments that the question cites, in its order."""
    asked = list(dict.fromkeys((m["type"], m["number_key"]) for m in question_mentions(held.sparkSession, question) if m["number_key"]))
    return _copies(held, asked)


def _copies(held: DataFrame, keys: list[tuple[str, str]]) -> list[str]:
    if not keys:
        return []
    wanted = F.struct("instrument_type", "number_key").isin([F.struct(F.lit(a), F.lit(b)) for a, b in keys])
    found = {(r["instrument_type"], r["number_key"]): r["id"] for r in search.largest_copies(held.filter(wanted)).collect()}  # a row for each key asked
    return [found[k] for k in keys if k in found]


def by_recent_number(held: DataFrame, question: str, citations: DataFrame | None) -> list[str]:
    """A bare number of the question that one of the recently cited documents (document_id, rank) has: the longest usable copy of
    that instrument, whichever was cited."""
    if citations is None:
        return []
    numbers = search.of_question(held.sparkSession, question, bare_numbers)
    if not numbers:
        return []
    cited = citations.join(held.filter(F.col("number_key").isin(numbers)).select(F.col("id").alias("document_id"), "instrument_type", "number_key"), "document_id")
    first = cited.orderBy("rank").limit(1).collect()
    return _copies(held, [(r["instrument_type"], r["number_key"]) for r in first])


def by_code_name(held: DataFrame, question: str) -> list[str]:
    keyword = search.of_question(held.sparkSession, question, search.informal_code_keyword)
    return [r["id"] for r in search.code_document(held, keyword).collect()] if keyword else []


def by_topic(held: DataFrame, question: str, texts: DataFrame, priority: list[str]) -> list[str]:
    """The law of the first topic that the question touches and that a copy is held of whose own text speaks of it."""
    folded = search.of_question(held.sparkSession, question, fold)
    for triggers, (kind, number), marker, least in TOPICS:
        if not any(t in folded for t in triggers):
            continue
        mine = held.filter(search.usable()).filter(F.coalesce("duplicate_of", F.lit("")) == "").filter((F.col("instrument_type") == kind) & (F.col("number_key") == number))
        body = operative_text(F.col("text"))
        spoken = (F.length(body) - F.length(F.replace(body, F.lit(marker), F.lit("")))) / len(marker)
        real = mine.join(texts, "id").filter(spoken >= least)
        best = real.orderBy(source_rank(F.col("source"), priority), -F.length("text"), "ord").limit(1).collect()
        if best:
            return [best[0]["id"]]
    return []


def named_instruments(held: DataFrame, texts: DataFrame, chunks: DataFrame, question: str, citations: DataFrame | None = None, extra_queries: list[str] | None = None, priority: list[str] = V.SOURCE_PRIORITY, most: int = V.NAMED_DOCUMENTS, cap: int = V.FULL_TEXT_CAP) -> list[Row]:
    """Entries of the instruments that a question names, at most so many: mode full_text with the content, or scoped_chunks with
    the best chunks of a text longer than the cap; documents without a text give none. held: registry(); texts: id, text."""
    ways = (
        lambda: by_citation(held, question),
        lambda: by_recent_number(held, question, citations),
        lambda: by_code_name(held, question),
        lambda: by_topic(held, question, texts, priority),
    )
    for way in ways:
        entries = []
        for document in way():
            entry = _entry(held, texts, chunks, document, question, extra_queries, cap)
            if entry is not None:
                entries.append(entry)
            if len(entries) == most:
                break
        if entries:
            return entries
    return []


def _entry(held: DataFrame, texts: DataFrame, chunks: DataFrame, document: str, question: str, extra: list[str] | None, cap: int) -> Row | None:
    head = held.filter(F.col("id") == document).select("title", "source_label", F.coalesce("character_count", F.lit(0)).alias("size")).first()
    # A text beyond the cap is not brought here to find out how long it is.
    mine = texts.filter((F.col("id") == document) & F.col("text").isNotNull()).select(F.when((F.length("text") <= cap) & F.lit(head["size"] <= cap), F.col("text")).alias("text")).first()
    if mine is None:
        return None
    if mine["text"] is not None:
        return Row(mode="full_text", id=document, title=head["title"], source_label=head["source_label"], content=mine["text"], chunks=None)
    best = search.within_document(chunks, question, document, extra_queries=extra).select("locator", "article_number", "content").collect()
    return Row(mode="scoped_chunks", id=document, title=head["title"], source_label=head["source_label"], content=None, chunks=best) if best else None
