"""Full-text ranking: exact BM25 with prefix phrases over two weighted columns.

Two ways with equal results. score_scans() looks at each text once for all queries and needs no index: places of a phrase
are counted in the string of a text's tokens, corpus statistics are observed in the same pass. build_index(), write_index()
and score_index() keep postings in the order of terms, so that a query reads its own terms only.
Statistics are those of the whole corpus; filters on rows come after them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import folded, token_line
from ..storage import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def search_terms(question: str) -> list[str]:
    """The terms of a question, in order: regional terms, then its words but for stop words, each with its synonyms."""
    text = unicodedata.normalize("NFKC", question).casefold()
    spoken = re.findall(r"[^\W_]{2,}|\d+(?:[.,]\d+)?", text)
    wanted = list(V.REGION_TERMS) if re.search(V.REGION_TRIGGER, text) else []
    stop = set(V.STOP_WORDS)
    wanted += [t for w in spoken if w not in stop for t in (w, *V.SYNONYMS.get(w, []))]
    return list(dict.fromkeys(wanted or spoken))[: V.QUERY_TERMS]


def match_expression(question: str) -> str:
    """The terms as a match expression of quoted prefix phrases."""
    return " OR ".join(f'"{t}"*' for t in (term.replace('"', "") for term in search_terms(question)))


def _plain(term: str) -> list[str]:
    """A term's tokens as texts have them."""
    return re.findall(r"[^\W_]+", folded(term))


def phrases(terms: list[str]) -> list[list[str]]:
    return [p for p in map(_plain, terms) if p]


def occurrences(line: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand one after the other in a token_line(), the last one as a prefix."""
    text = " " + " ".join(phrase)
    if not any(text.startswith(text[k:]) for k in range(1, len(text)) if text[k] == " "):
        # Places cannot overlap, so that they can be counted by taking them out.
        return ((F.length(line) - F.length(F.replace(line, F.lit(text), F.lit("")))) / len(text)).cast("int")
    tok = F.filter(F.split(line, " "), lambda t: t != "")
    *lead, last = phrase

    def here(i: Column) -> Column:
        same = [F.get(tok, i + j) == w for j, w in enumerate(lead)]
        return reduce(lambda a, b: a & b, [*same, F.get(tok, i + len(lead)).startswith(last)])

    return F.when(F.size(tok) >= len(phrase), F.size(F.filter(F.sequence(F.lit(0), F.size(tok) - len(phrase)), here))).otherwise(0)


def _term(idf: Column, f: Column, length: Column, average: Column) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def _idf(n: Column, total: Column) -> Column:
    raw = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def score_scans(chunks: DataFrame, queries: list[list[str]], title: str = "title", content: str = "content", keep: list[str] | None = None) -> list[DataFrame]:
    """For each list of terms, the rows in which one of its phrases occurs, with the columns keep and score (negative, less is
    better). All queries are answered by one pass: rows with a hit go to a table with their counts, and the statistics of
    the whole corpus are observed on the way. Keep keys rather than texts; texts of the few best rows are joined later."""
    asked = [phrases(terms) for terms in queries]
    kept = keep if keep is not None else chunks.columns
    every = list(dict.fromkeys(tuple(p) for ps in asked for p in ps))
    if not every:
        return [chunks.select(*kept).limit(0).withColumn("score", F.lit(0.0)) for _ in queries]
    line = lambda c: token_line(F.coalesce(F.col(c), F.lit("")))
    length = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) - 1
    base = chunks.select(*kept, line(title).alias("__t"), line(content).alias("__c"))
    weigh = lambda p: (V.TITLE_WEIGHT * occurrences(F.col("__t"), list(p)) + V.CONTENT_WEIGHT * occurrences(F.col("__c"), list(p))).cast("double")
    counted = base.select(*kept, (length("__t") + length("__c")).alias("__length"), F.array(*map(weigh, every)).alias("__f"))
    seen = Observation()
    df = [F.count_if(F.col("__f")[i] > 0).alias(f"d{i}") for i in range(len(every))]
    watched = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("__length"), F.lit(0.0)).alias("average"), *df)
    # explode() of no array drops a row as a filter would, but the optimizer does not write token counts out in it again.
    hits = written(watched.select(*kept, "__length", "__f", F.explode(F.when(F.exists("__f", lambda x: x > 0), F.array(F.lit(1)))).alias("__1")), "hits")
    stats = seen.get
    out = []
    for ps in asked:
        places = [every.index(tuple(p)) for p in ps]
        parts = [_term(_idf(F.lit(stats[f"d{i}"]), F.lit(stats["n"])), F.col("__f")[i], F.col("__length"), F.lit(stats["average"])) for i in places]
        found = reduce(lambda a, b: a | b, [F.col("__f")[i] > 0 for i in places]) if places else F.lit(False)
        score = -reduce(lambda a, b: a + b, parts) if places else F.lit(0.0)
        out.append(hits.filter(found).select(*kept, score.alias("score")))
    return out


def score_scan(chunks: DataFrame, terms: list[str], title: str = "title", content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """score_scans() of one query."""
    return score_scans(chunks, [terms], title, content, keep)[0]


def build_index(chunks: DataFrame, key: str, title: str = "title", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(postings: term, key, f; lengths: key, length). f is the weighted number of occurrences of the term in the row."""
    line = lambda c: F.filter(F.split(token_line(F.coalesce(F.col(c), F.lit(""))), " "), lambda t: t != "")
    tok = chunks.select(F.col(key), line(title).alias("t"), line(content).alias("c"))
    lengths = tok.select(key, (F.size("t") + F.size("c")).alias("length"))
    both = F.concat(F.transform("t", lambda w: F.struct(w.alias("term"), F.lit(V.TITLE_WEIGHT).alias("f"))), F.transform("c", lambda w: F.struct(w.alias("term"), F.lit(V.CONTENT_WEIGHT).alias("f"))))
    postings = tok.select(key, F.explode(both).alias("p")).groupBy(F.col("p.term").alias("term"), key).agg(F.sum("p.f").alias("f"))
    return postings, lengths


def write_index(postings: DataFrame, lengths: DataFrame, path: str) -> None:
    """The index as tables below a path, postings in the order of their terms, so that a query's range of terms is found by the
    statistics of files and row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def score_index(postings: DataFrame, lengths: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, score) from the index, for terms of one token each; a prefix gathers all terms that begin with it before its
    rows are counted. Postings hold no places, so that a phrase of several tokens is an error (score_scan() takes it)."""
    long = [p for p in phrases(terms) if len(p) > 1]
    if long:
        raise ValueError(f"the index holds no places for the phrase {' '.join(long[0])}")
    prefixes = [p[0] for p in phrases(terms)]
    asked = sorted(set(prefixes))
    spark = postings.sparkSession
    if not asked:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    # Ranges of literals reach the scan; which prefixes a term has is told inside its row.
    inside = reduce(lambda a, b: a | b, [(F.col("term") >= p) & (F.col("term") < p[:-1] + chr(ord(p[-1]) + 1)) for p in asked])
    own = F.explode(F.filter(F.array(*[F.lit(p) for p in asked]), lambda p: F.startswith(F.col("term"), p)))
    per = written(postings.filter(inside).select(key, "f", own.alias("prefix")).groupBy("prefix", key).agg(F.sum("f").alias("f")), "matched")
    df = {r["prefix"]: r["df"] for r in per.groupBy("prefix").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a term
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    if not df:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[F.lit(x) for p in df for x in (p, float(prefixes.count(p)))])
    known = F.create_map(*[F.lit(x) for p, n in df.items() for x in (p, n)])
    idf = _idf(F.element_at(known, F.col("prefix")), F.lit(total["n"]))
    part = F.element_at(weight, F.col("prefix")) * _term(idf, F.col("f"), F.col("length"), F.lit(total["average"]))
    return per.join(lengths, key).groupBy(key).agg((-F.sum(part)).alias("score"))


def top(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """The best rows with their rank; equal scores go by the key."""
    ranked = scored.orderBy("score", key).limit(limit)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("score", key)))
