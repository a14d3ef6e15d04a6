"""LM scoring (operator 1): masked pseudo-likelihood with a bidirectional window network, trained in numpy.

The network reads the classes of the two words to the left and the two to the right of a word and predicts the word through
a tree of two levels: a softmax over branches, from all four neighbours, then a softmax over the leaves of the branch, from
the two next ones. Frequent words are leaves of their own, so that the network predicts them down to the word. Rarer words
share leaves by their spelling; which word of a leaf stands there follows from the corpus with the scored document left
out: a word that other documents hold is likelier than one that none of them has. The sum of the logarithms over every
word is the text's pseudo-likelihood.

Neighbours' classes are clusters of leaves that keep the same company, found from the counts of neighbouring pairs. As they
are few, windows with equal classes are one weighted example: the windows of all words are counted into two tables, and the
network is trained on these by full steps, which are the steps over every window of the corpus. Scoring looks the
trained network's answers up.

Texts are read twice: words are counted, then leaf codes go to a table, two bytes a word, which the pairs, the windows and
the scores are taken from. The workers hold the counts of the most frequent words; a text's other words are joined with
theirs by 64-bit hashes. Words, leaves and what is joined grow with the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches, release, same_dtype, slices, text_rows, tree_sum, written

WIDTH = 64  # branches, and leaves in each, up to PER_WIDTH different words; beyond, they grow by the fourth root
PER_WIDTH = 1_000_000
SIGHTINGS = 8  # occurrences from which on a word may be a leaf of its own
INNER, OUTER = 16, 8  # classes of the next neighbours and of those beyond them; 0 is the edge of a text
REACH, DIM = 2, 24
STEPS, RATE, DECAY = 120, 0.05, 1e-5
HELD = 16  # words whose counts the workers hold, for each leaf
UNSEEN = 0.1  # what a word counts that no other document holds
_SEED = 42  # of Spark's xxhash64()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def word_hash(word: bytes) -> int:
    """xxhash64() of Spark."""
    h = xxhash.xxh64_intdigest(word, _SEED)
    return h - (1 << 64) if h >> 63 else h


def tree_width(types: int) -> int:
    """Branches, and leaves in each, for so many different words."""
    return int(WIDTH * max(1.0, types / PER_WIDTH) ** 0.25)


@dataclass
class Lexicon:
    """The tree, and the counts that workers hold. Leaf 0 is the edge of a text; own words have the leaves from 1 on, then
    come leaves that words share: of each cell, the words with the same first two bytes, as many as its share of all words."""

    width: int
    own: dict[bytes, int]  # word -> leaf
    held: dict[bytes, int]  # word -> occurrences, of own words and the most frequent others
    first: np.ndarray  # cell -> its first shared leaf
    span: np.ndarray  # cell -> how many shared leaves its words are dealt over
    mass: np.ndarray | None = None  # leaf -> occurrences of its words
    types: np.ndarray | None = None  # leaf -> different words

    def leaf(self, word: bytes, hashed: int | None = None) -> int:
        found = self.own.get(word)
        if found is None:
            cell = (word[0] << 8) + (word[1] if len(word) > 1 else 0)
            found = int(self.first[cell]) + (word_hash(word) if hashed is None else hashed) % int(self.span[cell])
        return found


def lexicon(rows: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon of all words of all texts, and the table (word, n) of their counts. What comes to the driver is bounded:
    a histogram of counts, the held words (HELD times the leaves at most), 65,536 cells, and two sums a leaf."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, 4 << 20):
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
            if len(held) > 150_000:
                yield out()
                held.clear()
        yield out()

    counts = written(rows.select("__text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["s"], r["t"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("t")).collect()), reverse=True)
    width = tree_width(sum(t for _, t in sizes))
    room, border, share = HELD * width * width, -1, 0
    for s, types in sizes:
        if types > room:  # of the border bin, an even share by hash
            border, share = s, int(950_000 * room / types)
            break
        room -= types
    known = (step > border) | ((step == border) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < share))
    held = sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(known).collect()), key=lambda x: (-x[1], x[0]))
    own = sorted(w for w, n in held[: width * width // 2] if n >= SIGHTINGS)
    cell = (F.conv(F.hex(F.rpad("word", 2, b"\x00")), 16, 10)).cast("int")
    weights = np.zeros(1 << 16)
    for r in counts.groupBy(F.coalesce(cell, F.lit(0)).alias("c")).agg(F.sum("n").alias("n")).collect():
        weights[r["c"]] = r["n"]
    n_of = dict(held)
    for w in own:
        weights[(w[0] << 8) + (w[1] if len(w) > 1 else 0)] -= n_of[w]
    shared = width * width - 1 - len(own)
    ends = np.cumsum(weights)
    total = max(1.0, ends[-1])
    lo = np.minimum(shared - 1, ((ends - weights) * shared / total)).astype(np.int64)
    hi = np.minimum(shared - 1, np.maximum(lo, np.ceil(ends * shared / total) - 1)).astype(np.int64)
    words = Lexicon(width, {w: i + 1 for i, w in enumerate(own)}, n_of, 1 + len(own) + lo, hi - lo + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((2, width * width))
        for b in batches:
            leaves = np.array([words.leaf(w) for w in b.column(0).to_pylist()], np.int64)
            out[0] += np.bincount(leaves, b.column(1).to_numpy(), width * width)
            out[1] += np.bincount(leaves, minlength=width * width)
        yield out.ravel()

    words.mass, words.types = tree_sum(counts, sums).reshape(2, width * width)
    return words, counts


def coded(rows: DataFrame, words: Lexicon, kind: str) -> DataFrame:
    """Of each row: its number, its words' leaves, the sum of log P(word | leaf) as far as the workers know the words' counts, how
    many words no other row holds as far as they know, and hashes and numbers of the other words."""
    code, shared = _code_type(words), 1 + len(words.own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_of: dict[bytes, int] = dict(words.own)
        more: dict[bytes, tuple[int, int, int]] = {}  # leaf, count or -1, hash of words that share a leaf
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 2 << 20):
            if len(more) > 150_000:
                leaf_of, more = dict(words.own), {}
            codes, at, times, found = [], [], [], []
            alone_own: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ws = words_of(text)
                got = list(map(leaf_of.get, ws))
                if None in got:
                    for k, g in enumerate(got):
                        if g is None:
                            w = ws[k]
                            h = word_hash(w)
                            got[k] = leaf_of[w] = leaf = words.leaf(w, h)
                            more[w] = leaf, words.held.get(w, -1), h
                leaves = np.array(got, code)
                codes.append(leaves.tobytes())
                rare = Counter([ws[k] for k in np.flatnonzero(leaves >= shared).tolist()])
                at += [i] * len(rare)
                times += rare.values()
                found += map(more.__getitem__, rare)
                own = 0
                if len(ws) >= SIGHTINGS:
                    leaves = leaves[leaves < shared]
                    here = np.bincount(leaves) if len(leaves) else leaves
                    own = int(here[np.flatnonzero(here >= words.mass[: len(here)])].sum()) if len(here) else 0
                alone_own.append(own)
            n = len(codes)
            at, times = np.array(at, np.int64), np.array(times, np.int64)
            leaf, count, hashed = np.array(found, np.int64).reshape(-1, 3).T
            inside = -times * np.log(words.mass[leaf] - times + UNSEEN * (words.types[leaf] + 1))
            known = count >= 0
            inside[known] += times[known] * np.log(count[known] - times[known] + UNSEEN)
            alone = np.bincount(at, times * (count == times), n).astype(np.int64) + np.array(alone_own, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at[~known], minlength=n))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~known])) for x in (hashed, times)]
            row = pa.array(np.arange(number, number + n), pa.int64())
            number += n
            yield pa.RecordBatch.from_arrays([batch.column(0), row, pa.array(codes, pa.binary()), pa.array(np.bincount(at, inside, n).astype(np.float64)), pa.array(alone), *lists], ["__id", "row", "codes", "inside", "alone", "hashes", "times"])

    return written(rows.mapInArrow(run, f"__id {kind}, row bigint, codes binary, inside double, alone bigint, hashes array<bigint>, times array<bigint>"), "codes")


def _code_type(words: Lexicon) -> type:
    return np.uint16 if words.width <= 256 else np.uint32


def places(held: list[bytes], code: type = np.uint16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves of all texts with edges between them, place of every word in these, text number of every word)."""
    size = np.dtype(code).itemsize
    edge = bytes(REACH * size)
    data = np.frombuffer(edge + edge.join(held) + edge, code)
    lengths = np.fromiter(map(len, held), np.int64, len(held)) // size
    of = np.repeat(np.arange(len(held)), lengths)
    return data, np.arange(len(of)) + REACH * (of + 1), of


@dataclass
class Classes:
    """Of each leaf, its class as a next neighbour and as one beyond."""

    inner: np.ndarray
    outer: np.ndarray

    def contexts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place, the number of its four neighbours' classes, and of the two next ones'."""
        near, far = self.inner[data], self.outer[data]
        pair = near[at - 1] * INNER + near[at + 1]
        return (pair * OUTER + far[at - 2]) * OUTER + far[at + 2], pair


def cluster(rows: np.ndarray, mass: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """k-means of rows weighed by mass; the first centres are the heaviest row and then those furthest by weight."""
    centres = [rows[np.argmax(mass)]]
    far = ((rows - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(rows[np.argmax(far * mass)])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
        weight = np.bincount(own, mass, k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows * mass[:, None])
        centres = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-12)[:, None], centres)
    return own


def classes_of(table: DataFrame, words: Lexicon) -> Classes:
    """Clusters of leaves by the branches that their neighbours to the left and right lie in, over all pairs of the corpus."""
    code, width = _code_type(words), words.width
    leaves = width * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(2 * leaves * width, np.int64)
        for batch in slices(batches, 1 << 20):
            data, at, _ = places(batch.column(0).to_pylist(), code)
            row = data[at].astype(np.int64) * width
            branch = data // width
            for side, step in enumerate((-1, 1)):
                total += np.bincount(row + branch[at + step] + side * leaves * width, minlength=len(total))
        yield total

    pairs = tree_sum(table.select("codes"), count, np.int64).reshape(2, leaves, width).astype(float)
    # Square roots of shares, so that rare company tells; the shares of all words steady those of rare leaves.
    base = pairs.sum(1, keepdims=True) + 1e-9
    shares = (pairs + 5 * base / base.sum(2, keepdims=True)) / (pairs.sum(2, keepdims=True) + 5)
    rows = np.sqrt(np.concatenate(list(shares), axis=1))
    inner, outer = (np.where(np.arange(leaves) > 0, 1 + cluster(rows, words.mass + 1e-9, k - 1), 0) for k in (INNER, OUTER))
    return Classes(inner, outer)


def count_windows(table: DataFrame, words: Lexicon, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """How often each branch stands in each context, and each leaf between each pair of next neighbours: the windows of
    every word of every text."""
    code, width = _code_type(words), words.width
    pairs = INNER * INNER
    contexts = pairs * OUTER * OUTER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        first, second = np.zeros(contexts * width, np.int64), np.zeros(pairs * width * width, np.int64)
        for batch in slices(batches, 1 << 20):
            data, at, _ = places(batch.column(0).to_pylist(), code)
            context, pair = classes.contexts(data, at)
            leaf = data[at].astype(np.int64)
            first += np.bincount(context * width + leaf // width, minlength=len(first))
            second += np.bincount(pair * width * width + leaf, minlength=len(second))
        yield np.concatenate([first, second])

    total = tree_sum(table.select("codes"), count, np.int64)
    return total[: contexts * width].reshape(contexts, width), total[contexts * width :].reshape(pairs, width, width)


def _log_soft(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


class Network:
    """Vectors of the neighbours' classes at each place, a hidden layer for each level, and the two softmax levels."""

    def __init__(self, width: int):
        r = np.random.default_rng(11)
        shapes = [(OUTER, DIM), (INNER, DIM), (INNER, DIM), (OUTER, DIM), (DIM,), (INNER, DIM), (INNER, DIM), (DIM,), (DIM, width), (width,), (width, DIM, width), (width, 1, width)]
        self.parts = [r.normal(0, 0.5, s).astype(np.float32) if i < 8 else np.zeros(s, np.float32) for i, s in enumerate(shapes)]
        near, far = np.arange(INNER), np.arange(OUTER)
        grid = np.meshgrid(near, near, far, far, indexing="ij")
        self.at = [grid[2].ravel(), grid[0].ravel(), grid[1].ravel(), grid[3].ravel()]  # classes of each context, from left to right
        self.pair = [np.repeat(near, INNER), np.tile(near, INNER)]

    def hidden(self) -> tuple[np.ndarray, np.ndarray]:
        p = self.parts
        first = np.tanh(sum(v[a] for v, a in zip(p[:4], self.at, strict=True)) + p[4])
        return first, np.tanh(p[5][self.pair[0]] + p[6][self.pair[1]] + p[7])

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray]:
        """log P(branch | context), and log P(leaf | branch, pair of next neighbours) by pair and leaf."""
        h, g = self.hidden()
        p = self.parts
        second = _log_soft(g @ p[10] + p[11])  # branch, pair, leaf of the branch
        return _log_soft(h @ p[8] + p[9]), second.transpose(1, 0, 2).reshape(len(g), -1)

    def loss(self, first: np.ndarray, second: np.ndarray) -> float:
        """Mean of -log P over the counted windows."""
        a, b = self.log_probabilities()
        return float(-((a * first).sum() + (b * second.reshape(b.shape)).sum()) / max(1, first.sum()))

    def gradient(self, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
        """That of loss(); first: contexts by branches, second: branches by pairs by leaves, both as shares of all windows."""
        p, (h, g) = self.parts, self.hidden()
        d1 = np.exp(_log_soft(h @ p[8] + p[9])) * first.sum(1, keepdims=True) - first
        d2 = np.exp(_log_soft(g @ p[10] + p[11])) * second.sum(2, keepdims=True) - second
        dh = (d1 @ p[8].T) * (1 - h * h)
        dg = (d2 @ p[10].transpose(0, 2, 1)).sum(0) * (1 - g * g)
        out = []
        shape = (INNER, INNER, OUTER, OUTER, DIM)
        grid = dh.reshape(shape)
        for axes in ((0, 1, 3), (1, 2, 3), (0, 2, 3), (0, 1, 2)):
            out.append(grid.sum(axes))
        square = dg.reshape(INNER, INNER, DIM)
        return [*out, dh.sum(0), square.sum(1), square.sum(0), dg.sum(0), h.T @ d1, d1.sum(0), g.T @ d2, d2.sum(1, keepdims=True)]


def train(first: np.ndarray, second: np.ndarray, steps: int = STEPS) -> Network:
    """Adam on the windows as count_windows() gives them, from a network that knows how frequent leaves are and nothing of
    contexts. The decay of weights is stronger the fewer windows there are."""
    width = first.shape[1]
    net = Network(width)
    total = max(1, first.sum())
    mass = second.sum(0) + UNSEEN
    net.parts[9][:] = np.log(mass.sum(1) / mass.sum())
    net.parts[11][:, 0] = np.log(mass / mass.sum(1, keepdims=True))
    first, second = (first / total).astype(np.float32), np.ascontiguousarray((second / total).transpose(1, 0, 2), np.float32)
    start = [net.parts[9].copy(), net.parts[11].copy()]
    decay = DECAY + 10.0 / total
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts]
    for t in range(1, steps + 1):
        grads = net.gradient(first, second)
        rate = RATE * min(1.0, 3 * (1 - t / (steps + 1)))
        for i, (p, g, (m, v)) in enumerate(zip(net.parts, grads, moments, strict=True)):
            if i >= 8:
                g = g + decay * (p - start[(i - 8) // 2] if i in (9, 11) else p) / p.size * 1000
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return net


def scored(table: DataFrame, counts: DataFrame, words: Lexicon, classes: Classes, net: Network, kind: str) -> DataFrame:
    """(__id, n_tokens, pll, n_alone) of each row of coded()."""
    code, width = _code_type(words), words.width
    first, second = (x.astype(np.float32) for x in net.log_probabilities())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            data, at, of = places(batch.column(2).to_pylist(), code)
            context, pair = classes.contexts(data, at)
            leaf = data[at].astype(np.int64)
            n = np.bincount(of, minlength=batch.num_rows)
            sums = np.bincount(of, first[context, leaf // width] + second[pair, leaf].astype(np.float64), batch.num_rows) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sums.astype(np.float64)), batch.column(4)], ["__id", "row", "n_tokens", "held", "alone"])

    held = table.select("__id", "row", "codes", "inside", "alone").mapInArrow(run, f"__id {kind}, row bigint, n_tokens bigint, held double, alone bigint")
    others = table.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("w")).select("row", F.col("w.hashes").alias("h"), F.col("w.times").alias("times"))
    here = F.col("times")
    found = others.join(counts.select(F.xxhash64("word").alias("h"), "n"), "h")
    joined = found.groupBy("row").agg(F.sum(here * F.log(F.col("n") - here + UNSEEN)).alias("logs"), F.sum(F.when(F.col("n") == here, here).otherwise(0)).alias("more"))
    pll, alone = F.col("held") + F.coalesce("logs", F.lit(0.0)), F.col("alone") + F.coalesce("more", F.lit(0))
    return held.join(joined, "row", "left").select("__id", "n_tokens", pll.alias("pll"), alone.alias("n_alone"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, pll (the sum of the words' conditional log probabilities), mean_logp, n_alone
    (words that no other row holds).

    Null and blank texts have no tokens, pll 0 and a null mean_logp. Null ids and repeated rows stay; texts are scored
    whole, word for word; words of one count are held or joined alike, so that no score depends on which; an empty table
    gives an empty table; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    kind = same_dtype(rows, "__id")
    words, counts = lexicon(rows)
    table = coded(rows, words, kind)
    classes = classes_of(table, words)
    net = train(*count_windows(table, words, classes))
    out = scored(table, counts, words, classes, net, kind)
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_logp")
    answer = written(out.select(F.col("__id").alias(id_col), "n_tokens", "pll", mean, "n_alone"), "pll")
    release(counts, table)
    return answer
