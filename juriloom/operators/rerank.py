"""The rerank funnel with pluggable scorers, previews, and rerankers over vectors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import fold, folded, let, squeeze, tokens


SEPARATOR = " … "
TERM_LETTERS = 4  # of the words of a question that a preview looks for


def preview_terms(question: str, stop: frozenset[str] = frozenset(V.PREVIEW_STOP_WORDS)) -> list[str]:
    return sorted({t for t in re.findall(r"[^\W_]{%d,}" % TERM_LETTERS, folded(question)) if t not in stop})


def _raw_place(text: Column, folded_text: Column, at: Column) -> Column:
    """The place (from 0) of the character that a place of the folded text comes from."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("place"))

    def walk(acc: Column, c: Column) -> Column:
        more = acc["seen"] + F.when(F.octet_length(c) == 1, 1).otherwise(F.length(fold(c)))
        return F.struct(more.alias("seen"), (acc["place"] + (more <= at).cast("int")).alias("place"))

    mapped = F.aggregate(F.split(text, ""), start, walk)["place"]
    return F.when(F.length(folded_text) == F.length(text), at).otherwise(mapped)


def preview(content: Column, terms: list[str], limit: int = V.PREVIEW, head: int = V.PREVIEW_HEAD) -> Column:
    """The text, white space squeezed, if it is short; else its head and a window around the rarest term (fewest places, then
    the earliest, then the least word) of those that first stand behind the head. Places are found in the folded text, whose
    length may differ, and cut in the text itself."""
    asked = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    head_size = min(head, limit // 3)
    width = limit - head_size - len(SEPARATOR)

    def of(text: Column) -> Column:
        def around(line: Column) -> Column:
            count = lambda t: ((F.length(line) - F.length(F.replace(line, t, F.lit("")))) / F.length(t)).cast("int")
            held = F.filter(F.transform(asked, lambda t: F.struct((F.call_function("instr", line, t) - 1).alias("at"), t.alias("t"))), lambda s: s["at"] >= head)
            seen = F.transform(held, lambda s: F.struct(count(s["t"]).alias("n"), s["at"].alias("at"), s["t"].alias("t")))
            whole = F.substring(text, 1, limit)
            if width <= 0:
                return whole
            stop = lambda focus: F.least(F.length(text), F.greatest(F.lit(head_size), focus - width // 3) + width)
            begin = lambda end: F.greatest(F.lit(head_size), end - width)
            window = lambda end: F.concat(F.substring(text, 1, head_size), F.lit(SEPARATOR), F.substring(text, begin(end) + 1, end - begin(end)))
            return let(F.array_min(seen), lambda best: F.when(best.isNull(), whole).otherwise(let(let(_raw_place(text, line, best["at"]), stop), window)))

        return F.when(F.length(text) <= limit, text).otherwise(let(fold(text), around))

    return let(squeeze(content), of)


def shared_terms(question_terms: list[str]) -> Callable[[Column], Column]:
    """A lexical scorer: the share of the terms that stand in the text as tokens."""
    asked = F.array(*[F.lit(t) for t in question_terms])
    return lambda content: F.size(F.array_intersect(F.array_distinct(tokens(content)), asked)) / F.greatest(F.size(asked), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rerank(pool: DataFrame, scorer: Callable[[Column], Column] | None, final_limit: int = V.RESULTS, shortlist: int = V.SHORTLIST, pos: str = "pos", content: str = "content") -> DataFrame:
    """Shortlist by position, order by the scorer, keep the first. Without a scorer positions stay: rerank never fails a search."""
    short = pool.orderBy(pos).limit(shortlist)
    if scorer is None:
        return short.withColumn("rerank_score", F.lit(None).cast("double")).orderBy(pos).limit(final_limit)
    scored = short.withColumn("rerank_score", scorer(F.col(content)).cast("double"))
    return scored.orderBy(F.desc("rerank_score"), pos).limit(final_limit)


def rerank_position(rows: DataFrame, pos: str = "pos") -> DataFrame:
    return rows.withColumn("new_pos", F.row_number().over(Window.orderBy(F.desc("rerank_score"), pos)))
