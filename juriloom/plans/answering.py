"""From a question to the evidence for its answer: search, rerank, citations, status of instruments, named texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import assemble, graph, legal, rerank, resolve, search


@dataclass
class Corpus:
    """chunks: chunk_id, document_id, title, source, source_label, published_date, locator, content, article_number; held:
    resolve.registry(); texts: id, text; nodes with status and edges of the graph."""

    chunks: DataFrame
    held: DataFrame
    texts: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass
class Evidence:
    query: str
    chunks: DataFrame
    citations: DataFrame
    context: str
    legal: str
    focused: str
    message: str


def contextual(question: str, turns: list[str]) -> str:
    """The question after the last turns of its asker, which a follow-up relies on."""
    return "\n".join(t.strip() for t in [*turns[-2:], question] if t.strip())


def evidence(corpus: Corpus, question: str, as_of_year: int, turns: list[str] = (), sources: list[str] | None = None, extra_queries: list[str] | None = None, recent: DataFrame | None = None, scorer: Callable[[Column], Column] | None = None) -> Evidence:
    """Raises LookupError where no passage is found. The pool of a search is reranked by the scorer (without one its order
    stays); recent: recently cited documents (document_id, rank)."""
    query = contextual(question, list(turns))
    pool = search.search(corpus.chunks, query, as_of_year, sources, limit=V.RERANK_POOL, extra_queries=extra_queries)
    best = rerank.rerank(pool, scorer, V.RESULTS, V.RERANK_POOL).select(*corpus.chunks.columns, "pos")
    rows = best.collect()  # the few that an answer is given
    if not rows:
        raise LookupError("no passage was found in the selected sources")
    chosen = corpus.chunks.sparkSession.createDataFrame(rows, best.schema)
    context = assemble.retrieved_context(chosen, as_of_year).first()["context"]
    status = status_block(corpus, question) if corpus.nodes is not None else ""
    entries = resolve.named_instruments(corpus.held, corpus.texts, corpus.chunks, question, recent, extra_queries)
    focused = assemble.focused_reading(entries)
    parts = [f"Question:\n{question}", f"Retrieved evidence:\n{context}", status, focused]
    return Evidence(query, chosen, assemble.grouped_citations(chosen), context, status, focused, "\n\n".join(p for p in parts if p))


def status_block(corpus: Corpus, question: str) -> str:
    """The lines on the instruments that a question names."""
    named = [m for m in legal.question_mentions(corpus.chunks.sparkSession, question) if m["number_key"]]
    if not named:
        return ""
    found = corpus.nodes.filter(F.struct("instrument_type", "number_key").isin([F.struct(F.lit(m["type"]), F.lit(m["number_key"])) for m in named]))
    return "\n\n".join(r["brief"] for r in graph.status_brief(found, corpus.edges).collect())
