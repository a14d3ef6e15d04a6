"""Toxicity (operator 4): cumulative-link ordinal regression over sparse text features.

P(grade <= k) = 1 / (1 + exp(score - threshold_k)) with increasing thresholds and one weight vector for all of them; the
score of a text is the sum of the weights of its distinct words, a word's features being the word and its beginnings. The
answer is the expected grade. Labels say toxic or not; toxic texts are graded by how many words they hold that only
toxic texts hold, so that the thresholds are ordered by severity.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches

TRAIN_ROWS = 3000  # toxic labelled rows at most, and twice as many others, that the fit reads: the bound of the sample
GRADES = 4
# Bounds of the fit beside that of its rows: characters of the words that it reads of a text, evenly from all of it, and features.
TRAIN_CHARS = 20_000
FEATURES = 4000
EVIDENCE = 20.0  # least log-likelihood ratio of a feature that the regression sees
PREFIXES = (3, 4, 5, 6, 7, 8)
_TRIM = ".,;:!?\"'()[]{}«»…"


def words_of(text: str) -> set[str]:
    """The distinct words of a text in lower case, without the punctuation around them."""
    return {w for w in (x.strip(_TRIM) for x in set(text.lower().split())) if w}


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [30.0] * (GRADES - 1))

    def word(self, word: str) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(word))

    def score(self, text: str, cache: dict[str, float] | None = None) -> float:
        if cache is None:
            cache = {}
        total = 0.0
        for w in words_of(text):
            s = cache.get(w)
            if s is None:
                if len(cache) > 150_000:
                    cache.clear()
                s = cache[w] = self.word(w)
            if s:
                total += s
        return total


def _probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k), k = 0 .. GRADES - 2."""
    return 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None], -40, 40)))


def grade_texts(marked: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for other texts; toxic ones 1 to GRADES - 1 by thirds of their number of marked words."""
    grades = np.zeros(len(marked), int)
    if toxic.any():
        cuts = np.quantile(marked[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
        grades[toxic] = 1 + np.searchsorted(cuts, marked[toxic], side="right")
    return grades


def fit(texts: list[str], toxic: list[int], rounds: int = 600, rate: float = 0.05, l1: float = 2e-6) -> Model:
    """Weights and thresholds by Adam, weights kept from falling below zero. With one class only the model finds nothing toxic."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model()
    # Nothing is kept of a text but its chosen features: the driver's memory is for the counts of toxic texts' features.
    of = lambda t: {f for w in words_of(t) for f in features(w)}
    inside, outside = Counter(), Counter()
    for t, bad in zip(texts, y, strict=True):
        if bad:
            inside.update(of(t))
    inside = Counter({f: n for f, n in inside.items() if n >= 2})
    for t, bad in zip(texts, y, strict=True):
        if not bad:
            outside.update(of(t) & inside.keys())
    n1, n0 = int(y.sum()), int((~y).sum())
    odds, evidence = {}, {}
    for f in inside:
        a, b = inside[f], outside[f]
        odds[f] = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        if odds[f] > 0:
            # Log-likelihood ratio of "the rates differ" against "they are equal".
            share = (a + b) / (n1 + n0)
            part = lambda k, n: (k * np.log(k / n) if k else 0.0) + ((n - k) * np.log(1 - k / n) if k < n else 0.0)
            evidence[f] = 2 * (part(a, n1) + part(b, n0) - (part(a + b, n1 + n0) if 0 < share < 1 else 0.0))
    chosen = sorted((f for f, e in evidence.items() if e >= EVIDENCE), key=lambda f: (-evidence[f], f))[:FEATURES]
    if not chosen:
        return Model()
    column = {f: i for i, f in enumerate(chosen)}
    marks = {f for f in chosen if odds[f] > 2.5 and outside[f] <= 0.02 * inside[f]}
    rows, cols, vals, marked = [], [], [], []
    for i, t in enumerate(texts):
        found, hits = Counter(), 0
        for w in words_of(t):
            own = [f for f in features(w) if f in column]
            found.update(own)
            hits += any(f in marks for f in own)
        marked.append(hits)
        rows += [i] * len(found)
        cols += [column[f] for f in found]
        vals += found.values()
    grades = grade_texts(np.array(marked, float), y)
    rows, cols, vals = np.array(rows), np.array(cols), np.array(vals, float)
    w, theta = np.zeros(len(chosen)), np.arange(GRADES - 1, dtype=float) + 1.0
    moments = [np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))]
    balance = np.full(len(y), 1 / len(y))
    picked = np.arange(len(y))
    for t in range(1, rounds + 1):
        score = np.bincount(rows, vals * w[cols], len(y))
        p = _probabilities(score, theta)
        full = np.column_stack([np.zeros(len(y)), p, np.ones(len(y))])
        mass = np.maximum(full[picked, grades + 1] - full[picked, grades], 1e-12)
        slope = np.column_stack([np.zeros(len(y)), p * (1 - p), np.zeros(len(y))])
        hi, lo = slope[picked, grades + 1], slope[picked, grades]
        d_score = balance * (hi - lo) / mass
        d_theta = np.array([(balance * ((grades == k) * -hi + (grades == k + 1) * lo) / mass).sum() for k in range(GRADES - 1)])
        g = np.bincount(cols, vals * d_score[rows], len(w))
        g = np.concatenate([g + l1, d_theta])
        moments[0] += 0.1 * (g - moments[0])
        moments[1] += 0.01 * (g * g - moments[1])
        size = rate * (1 - t / (rounds + 1)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-9)
        step = size * moments[0] / (1 - 0.9**t)
        w = np.maximum(0, w - step[: len(w)])  # every feature speaks for toxicity, none against
        theta = np.sort(theta - step[len(w) :])
    theta = np.maximum.accumulate(theta + np.arange(len(theta)) * 1e-6)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if x}, theta.tolist())


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", train_chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows: at most train_rows toxic and twice as many other ones, in the order of a hash of the id.

    Of a text the fit reads its distinct words; of one whose words are more than train_chars characters, those of the least
    hashes up to that. Both bounds are of the sample; scoring reads whole texts. Rows with a null id, text or label are not
    read; several labels of an id count as toxic if one says so; of several rows of an id one text counts.
    """
    marked = labels.select(F.col(id_col).alias("__id"), (F.col(toxic_col) > 0).alias("__toxic")).dropna().groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).dropna()
    sample = None
    for value in (True, False):
        part = marked.filter(F.col("__toxic") == value).orderBy(F.xxhash64("__id"), "__id").limit(train_rows if value else 2 * train_rows)
        sample = part if sample is None else sample.unionByName(part)
    # The sample's rows are at most 3 * train_rows; of an id with several texts the one of the least hash stands for it.
    words = F.array_distinct(F.split(F.lower("__text"), r"\s+"))
    held = F.when(F.length("__text") <= train_chars, F.array_join(words, " ")).otherwise(F.substring(F.array_join(F.array_sort(words, lambda a, b: F.when(F.xxhash64(a) < F.xxhash64(b), -1).when(F.xxhash64(a) > F.xxhash64(b), 1).otherwise(0)), " "), 1, train_chars))
    mine = texts.join(F.broadcast(sample), "__id").select("__id", "__toxic", held.alias("__words"), F.xxhash64("__text").alias("__h"))
    rows = mine.groupBy("__id").agg(F.min_by("__words", "__h").alias("w"), F.max("__toxic").alias("t")).orderBy("__id").select("w", "t").collect()
    return fit([r[0] for r in rows], [int(r[1]) for r in rows])


def score_column(model: Model, text_col: str) -> Column:
    """The latent score of a text as an Arrow function; null text has the score of no words."""

    @F.pandas_udf("double")
    def latent(texts: pd.Series) -> pd.Series:
        cache = latent_cache.setdefault(id(model), {})
        return pd.Series([model.score(t, cache) if t else 0.0 for t in texts], dtype="float64")

    latent_cache: dict = {}
    return latent(F.col(text_col))


def above(score: Column, threshold: float) -> Column:
    """P(grade > k)."""
    return 1 / (1 + F.exp(F.lit(float(threshold)) - score))


def severity(score: Column, model: Model) -> Column:
    """The expected grade: the sum of P(grade > k)."""
    out = F.lit(0.0)
    for t in model.thresholds:
        out = out + above(score, t)
    return out


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score, p_toxic, severity (expected grade), toxic (p_toxic >= 0.5).

    Null and empty texts have score 0, which the first threshold calls clean. Null ids and repeated rows stay; a
    word of the whole text counts once; an empty table gives an empty table; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), score_column(model, text_col).alias("score"))
    p = above(F.col("score"), model.thresholds[0])
    return rows.select(F.col("__id").alias(id_col), "score", p.alias("p_toxic"), severity(F.col("score"), model).alias("severity"), (p >= 0.5).alias("toxic"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns, whatever their names: null and empty texts, null ids and
    repeated rows included. An empty table gives an empty table."""
    bound_batches(docs.sparkSession)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), score_column(model, text_col).alias("__score"))
    return rows.filter(above(F.col("__score"), model.thresholds[0]) < 0.5).select("__row.*")
