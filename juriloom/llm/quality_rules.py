"""Quality rules (operator 2), DataFrame functions only: base counts of a text and a short-circuit cascade of rules.

The cascade measures on a sample what each rule costs and how many rows it rejects, and then asks the rules in the order of
rejection per cost, in one chain that stops at the first rule that rejects: the work of the rules behind it is not done. The
order changes what a row costs, never what becomes of it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a place in a packed window; no string of the engine holds more words. The other bits are of the window's hash.
_PLACE_BITS = 30
SAMPLE_ROWS, REPEATS = 500, 10  # rows that rules are measured on, and how often each is asked for its time
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words() -> tuple[Column, Column, Callable[[Column], Column]]:
    """Words in 3-word windows that occur twice or more, of columns __words and __hashes (a hash of each word).

    Windows are hashed and packed with their place into longs, which sort fast; neighbours with equal hash bits are
    candidates, nearly always few. Only these are compared as strings, sorted with their places. Each covered word counts
    once: a window adds three words, less those of the window before it that overlap.
    """
    n = F.size("__words")
    window = lambda i: F.array_join(F.slice(F.col("__words"), i, F.lit(3)), " ")
    places = F.sequence(F.lit(1), n - 2)
    packed = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.get("__hashes", i - 1), F.get("__hashes", i), F.get("__hashes", i + 1)), _PLACE_BITS).bitwiseOR(i.cast("bigint"))))
    high = lambda x: F.shiftright(x, _PLACE_BITS)
    # aggregate() carries the run of equal neighbours; filter() with get() looks at both neighbours.
    near = F.filter(F.col("__packed"), lambda x, i: (high(x) == F.coalesce(high(F.get("__packed", i + 1)), high(x) + 1)) | (high(x) == F.coalesce(high(F.get("__packed", i - 1)), high(x) + 1)))
    masked = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int"))
    return packed, masked, window


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """The id (or the whole row as struct __row), the base counts of each row, and its words and lines for the rules; computed
    inside the row: no shuffle, no Python.

    A null text has no words and counts 0 throughout.
    """
    space = "[\\x20\\x09-\\x0D]+"
    n = F.size("__words")
    packed, candidates, window = _repeat_words()
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row") if keep_row else F.col(id_col).alias("__id")
    rows = docs.select(first, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", F.array_remove(F.split("__text", space), "")).withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__packed", F.when(n >= 3, packed).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("__near", F.when(n >= 3, candidates).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("__sorted", F.sort_array(F.transform("__near", lambda i: F.struct(window(i).alias("w"), i.alias("i")))))
    same = lambda x, i: x["w"] == F.coalesce(F.get("__sorted", i)["w"], F.lit(""))
    rows = rows.withColumn("__twice", F.sort_array(F.transform(F.filter("__sorted", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])))
    zero = F.lit(0).cast("bigint")
    covered = F.aggregate("__twice", F.struct(F.lit(-9).alias("last"), zero.alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return rows.select(
        "__row" if keep_row else "__id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        "__words",
        "__lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A row is rejected where the condition, a SQL expression, is true; null is no rejection. duck: the same for DuckDB,
    where ws are the words and ls the lines."""

    name: str
    rejects: str
    duck: str = ""


# How often the word at one of three places of the sorted words occurs. A word of more than 30 % of all stands at one of the
# places 30, 60 and 90 % in, as no stretch between them is that long.
_RUN = "size(s) + 2 - array_position(s, {0}) - array_position(reverse(s), {0})"
_RUNS = ", ".join(_RUN.format(f"element_at(s, cast((3 * {k} * size(s) + 9) div 10 as int))") for k in (1, 2, 3))
_FREQUENT = f"get(transform(array(sort_array(__words)), s -> if(size(s) = 0, 0, greatest({_RUNS}))), 0)"
# Production rules. The first four compare the base counts, the others do work of their own on the words and lines of
# measured(); integer arithmetic, so that every engine agrees.
RULES = [
    Rule("symbol_heavy", "100 * n_symbols > 15 * n_words"),
    Rule("odd_word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("repeated_windows", "100 * n_repeat_words > 40 * n_words"),
    Rule("few_letters", r"100 * size(filter(__words, w -> w rlike '[A-Za-z]|[^\\x00-\\x7F]')) < 60 * n_words", r"100 * len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) < 60 * n_words"),
    Rule("one_word", f"100 * {_FREQUENT} > 30 * n_words", "100 * list_max(map_values(list_aggregate(ws, 'histogram'))) > 30 * n_words"),
    Rule("few_distinct_words", "100 * size(array_distinct(__words)) < 4 * n_words", "100 * len(list_distinct(ws)) < 4 * n_words"),
    Rule("cut_off_lines", r"n_lines >= 5 AND 100 * size(filter(__lines, l -> l rlike '(?:[.][.][.]|\u2026)[\\x20\\x09-\\x0D]*$')) > 50 * n_lines", "n_lines >= 5 AND 100 * len(list_filter(ls, lambda l: regexp_matches(l, '(?:[.][.][.]|\u2026)[\\x20\\x09-\\x0D]*$'))) > 50 * n_lines"),
    Rule("listed_lines", r"n_lines >= 5 AND 100 * size(filter(__lines, l -> l rlike '^[\\x20\\x09-\\x0D]*[-*+\u2022]')) > 90 * n_lines", "n_lines >= 5 AND 100 * len(list_filter(ls, lambda l: regexp_matches(l, '^[\\x20\\x09-\\x0D]*[-*+\u2022]'))) > 90 * n_lines"),
]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float  # seconds a row
    rejection: float


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many rows from all partitions, twice as many at most."""
    share = rows / max(1, docs.count())
    return docs.limit(2 * rows) if share >= 1 else docs.sample(share, seed=7).limit(2 * rows)


def order_rules(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, inputs: list[str] | None = None, repeats: int = REPEATS) -> list[Measured]:
    """Measure the rules on a bounded sample of rows and order them by rejection per cost, ties by place.

    A rule is asked once for each row of the sample and then repeats times more; what that job takes longer is the time of
    the rule alone, without that of launching a job. sample_rows bounds what is brought to the driver; it decides an order
    alone, so no result depends on it. An empty table gives each rule the rejection 0, and the rules their given order.
    """
    spark = df.sparkSession
    rows = df.select(*inputs) if inputs else df
    sample = spark.createDataFrame(rows.limit(2 * sample_rows).toLocalIterator(), rows.schema).coalesce(1)
    found = []
    for rule in rules:

        def ask(times: int, rule: Rule = rule) -> tuple[float, int, int]:
            asked = sample.withColumn("__time", F.explode(F.sequence(F.lit(1), F.lit(times))))
            hit = asked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.expr(rule.rejects), F.lit(False))).alias("r"))
            start = time.perf_counter()
            n, r = hit.first()
            return time.perf_counter() - start, n, r

        once, n, r = ask(1)
        more = once
        if n:  # the first job also compiled the rule's code
            once, more = ask(1)[0], ask(1 + repeats)[0]
        found.append(Measured(rule, max(1e-9, (more - once) / max(1, n * repeats)), r / max(1, n)))
    return sorted(found, key=lambda m: -m.rejection / m.cost)


def verdict(order: list[Measured]) -> Column:
    """The name of the first rule that rejects the row, or null: a chain that stops at the first hit."""
    chain = F.lit(None).cast("string")
    for m in reversed(order):
        chain = F.when(F.coalesce(F.expr(m.rule.rejects), F.lit(False)), F.lit(m.rule.name)).otherwise(chain)
    return chain


def cascade(df: DataFrame, rules: list[Rule], order: list[Measured] | None = None) -> DataFrame:
    """df and the column rejected_by: the rule that rejects the row first in the measured order, null if none does."""
    return df.withColumn("rejected_by", verdict(order if order is not None else order_rules(df, rules)))


_INPUTS = [*_MEASURES, "n_lines", "__words", "__lines"]


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false where base_failed or a rule rejects; rules are asked of rows that did not fail the base. Null and empty
    texts have no words, so they fail; null ids and repeated rows stay; equal windows and lines count as the text has them,
    however long it is; an empty table gives an empty table; other columns are not read.
    """
    counted = measured(docs, id_col, text_col)
    rules = RULES if rules is None else rules
    order = order_rules(measured(sample_of(docs, sample_rows), id_col, text_col), rules, sample_rows, _INPUTS)
    out = counted.withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order).isNull())
    row = F.struct(F.col("__id").alias(id_col), *_MEASURES, "base_failed", kept.alias("kept"))
    # explode() keeps a filter on the answer from being pushed below, where all counts would be written out in the predicate.
    return out.select(F.explode(F.array(row)).alias("__row")).select("__row.*")


def drop_rejected(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns, whatever their names. Null, blank and short texts go
    with the others that fail the base; repeated rows and null ids are decided on like others; an empty table gives an
    empty table."""
    rules = RULES if rules is None else rules
    order = order_rules(measured(sample_of(docs, sample_rows), id_col, text_col), rules, sample_rows, _INPUTS)
    kept = F.when(base_failed(), F.lit(None)).otherwise(F.when(verdict(order).isNull(), F.array("__row")))
    # Not filter(): the optimizer would write all counts out in the predicate, once for each use of each of them.
    return measured(docs, id_col, text_col, keep_row=True).select(F.explode(kept).alias("__row")).select("__row.*")


def oracle_sql(columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept", table: str = "documents") -> str:
    """DuckDB SQL for quality_rules()."""
    reject = " OR ".join(f"coalesce({r.duck or r.rejects}, false)" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS x(k) GROUP BY rid),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
k AS (SELECT *, NOT base_failed AND NOT ({reject}) AS kept FROM f)
SELECT {columns} FROM k"""
