"""MinHash near-duplicates (operator 5) with HyperMinHash sketches.

A sketch has one register per bucket: the number of leading zeros and some mantissa bits of the least hash that fell into
the bucket, in 16 bits. A bucket that nothing fell into is filled by further passes under other seeds; the first pass in
which a shingle reaches a bucket is part of its order, so that the least of that order agrees between two sets with the
probability of their Jaccard similarity, however few shingles they have.

1. Rows with equal shingle sets become one class (its least id stands for it), so that copies cost nothing further.
2. Registers are banded. In each bucket of a band the members are compared with its least member: the similarity
   estimated from the registers, corrected for registers that agree by accident, sorts out what is clearly apart, and the
   full sets decide the rest.
3. Members of a bucket that are still apart may be linked past the least member. Buckets with several components are cut
   into blocks of bounded size, sorted by component, and compared whole except inside one component: first by registers,
   each pair in the first band it shares, then (only members that have a likely partner in another component) by full
   sets; a pair of blocks gives back a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .runtime import bound_batches, give_back, hub_join, release, same_dtype, slices, text_rows, written

BUCKETS = 128
MISS = 4.5e-7  # the probability with which a pair at exactly the threshold may share no band
MANTISSA = 10
BLOCK, BLOCK_SHINGLES = 512, 1 << 19  # members of a block of a bucket, and shingles of its sets, at most
# Standard errors of the estimate by which a pair may fall short of the threshold before it is sorted out.
SLACK = 5.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = _mix(np.arange(1, 257, dtype=_U) * _BASE)
_CHUNK = 1 << 16  # bytes of words that are hashed at once, by tables of this size
_LONG = 1024  # bytes from which on a shingle is hashed by itself: powers modulo 2^64 are weak on long stretches
_POWERS = np.cumprod(np.full(_CHUNK + 1, _BASE, _U), dtype=_U)
_INVERSES = np.cumprod(np.full(_CHUNK + 1, _U(pow(int(_BASE), -1, 1 << 64)), _U), dtype=_U)


def _chunk_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of all windows of words, which are at most _CHUNK bytes with the spaces between them."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * _POWERS[: len(data)], out=sums[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    out = _mix((sums[last] - sums[first]) * _INVERSES[first] ^ (last - first).astype(_U) * _BASE)
    for i in np.flatnonzero(last - first >= _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + size]))
    return out


def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles of so many words (fewer words: one shingle of all), sorted. Memory
    beyond the text's words and the answer is bounded: long texts are hashed in chunks that overlap by a shingle."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, _U)
    size = min(size, len(words))
    if len(text) * 4 < _CHUNK or sum(map(len, words)) + len(words) <= _CHUNK:
        return np.unique(_chunk_hashes(words, size))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    found, at = [], 0
    while at + size <= len(words):
        before = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, before + _CHUNK, side="right"))
        if stop < at + size:  # one shingle is longer than a chunk
            found.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[at : at + size]))], _U))
            at += 1
        else:
            found.append(np.unique(_chunk_hashes(words[at:stop], size)))
            at = stop - size + 1
    return np.unique(np.concatenate(found))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a set of sorted distinct hashes."""
    out = np.zeros(BUCKETS, np.uint16)
    edges = np.arange(BUCKETS, dtype=_U) << _U(57)
    at = np.searchsorted(hashes, edges)
    nxt = np.append(at[1:], len(hashes))
    filled = nxt > at
    value = np.zeros(BUCKETS, _U)
    value[filled] = (hashes[at[filled]] & _U((1 << 57) - 1)) >> _U(14)
    passes = np.zeros(BUCKETS, _U)
    t = 0
    while not filled.all():
        many = min(2048, max(4, 1500 // len(hashes)))
        seeds = np.arange(t + 1, t + many + 1, dtype=_U)
        again = _mix(hashes[None, :] + (seeds * _BASE)[:, None])
        keys = ((again >> _U(57)) << _U(57)) | ((seeds - _U(t))[:, None] << _U(43)) | (again & _U((1 << 43) - 1))
        keys = np.sort(keys, axis=None)
        at = np.searchsorted(keys, edges)
        new = ~filled & (np.append(at[1:], len(keys)) > at)
        value[new] = keys[at[new]] & _U((1 << 43) - 1)
        passes[new] = ((keys[at[new]] >> _U(43)) & _U((1 << 14) - 1)) + _U(t)
        filled |= new
        t += many
    # value has 43 bits: leading zeros (at most 43), then the bits after the leading one.
    lengths = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # 0 for value 0
    mantissa = np.where(lengths > MANTISSA, value >> np.maximum(lengths - 1 - MANTISSA, 0).astype(_U), value << np.clip(MANTISSA + 1 - lengths, 0, 12).astype(_U)) & _U((1 << MANTISSA) - 1)
    out[:] = ((43 - lengths).astype(_U) << _U(MANTISSA) | mantissa).astype(np.uint16) ^ (passes * _U(40503) & _U(0xFFFF)).astype(np.uint16)
    return out


def accident(n: np.ndarray | float) -> np.ndarray:
    """The probability that registers of unrelated sets of about n shingles agree: leading zeros are geometric, the
    mantissa is even within them. 2^-10 times the chance of equal leading zeros."""
    k = np.maximum(np.asarray(n, float) / BUCKETS, 1e-3)[..., None]
    z = 2.0 ** -np.arange(0, 44)
    p = np.exp(-k * z / 2) - np.exp(-k * z)
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-12)
    return (p * p).sum(-1) / (1 << MANTISSA)


def estimate(agree: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, corrected for accidental agreement."""
    c = accident(n)
    return np.clip((agree - c) / (1 - c), 0, 1)


def likely(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def banding(percent: int) -> tuple[int, int]:
    """(bands, registers in each): as many registers in a band as leave enough bands to hold MISS at the threshold."""
    if percent >= 100:
        return 1, BUCKETS  # equal sets agree in all registers
    for size in range(BUCKETS, 0, -1):
        agree = (percent / 100) ** size
        bands = math.ceil(math.log(MISS) / math.log1p(-agree)) if agree > 0 else BUCKETS + 1
        if bands * size <= BUCKETS:
            return bands, size
    raise ValueError(f"{BUCKETS} registers are too few for pairs at {percent} percent")


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2 << 20):
        counts, keys, regs = [], [], []
        for text in batch.column(1).to_pylist():
            h = shingle_hashes(text, size)
            counts.append(len(h))
            keys.append(_set_key(h) if len(h) else None)
            regs.append(registers(h).tobytes() if len(h) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["__id", "n_shingles", "set_key", "regs"])
    give_back()


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _bands(batches: Iterator[pa.RecordBatch], bands: int, size: int) -> Iterator[pa.RecordBatch]:
    """(slot, band, cls): which band of registers it is, and the hash of the registers in it."""
    salt = _mix(np.arange(bands, dtype=_U) + _U(77))
    weights = _mix(np.arange(size, dtype=_U) + _U(991)) | _U(1)
    for batch in batches:
        if batch.num_rows:
            regs = _registers(batch.column(1))[:, : bands * size].astype(_U)
            keys = _mix((regs.reshape(-1, bands, size) * weights).sum(2, dtype=_U) + salt).view(np.int64)
            cls = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            slots = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(keys.ravel(), pa.int64()), cls], ["slot", "band", "cls"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


@dataclass
class Sift:
    """Which pairs of two lists of sketches may be linked, and are to be looked at in this bucket."""

    percent: int
    least: float
    size: int  # registers in a band

    def sizes_fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)

    def pairs(self, x: Side, y: Side, slot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of likely pairs in unlike components. A pair that shares an earlier band is left to that band's bucket."""
        for start in range(0, len(x.cls), 64):
            part = slice(start, start + 64)
            ok = (x.comp[part, None] != y.comp[None]) & self.sizes_fit(x.n[part, None], y.n[None])
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            if 4 * len(i) > ok.size:
                agree = (x.regs[part, None, :] == y.regs[None]).mean(2, dtype=np.float32)[i, j]
            else:
                agree = (x.regs[start + i] == y.regs[j]).mean(1, dtype=np.float32)
            i, j = (v[agree >= self.least * 0.98] for v in (start + i, j))
            if slot and len(i):
                same = (x.regs[i, : slot * self.size] == y.regs[j, : slot * self.size]).reshape(len(i), slot, self.size)
                fresh = ~same.all(2).any(1)
                i, j = i[fresh], j[fresh]
            if len(i):
                yield i, j


@dataclass
class Side:
    """Members of a bucket."""

    cls: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    regs: np.ndarray

    def pack(self) -> bytes:
        return b"".join([np.int64(len(self.cls)).tobytes(), self.cls.tobytes(), self.comp.tobytes(), self.n.tobytes(), self.regs.tobytes()])

    @staticmethod
    def unpack(data: bytes) -> Side:
        k = int(np.frombuffer(data, np.int64, 1)[0])
        longs = np.frombuffer(data, np.int64, 3 * k, 8).reshape(3, k)
        return Side(*longs, np.frombuffer(data, np.uint16, offset=8 + 24 * k).reshape(k, BUCKETS))


_BLOCKS = "slot int, band bigint, block bigint, alone boolean, lo bigint, hi bigint, data binary"


def _block(batches: Iterator[pa.RecordBatch], rows: int, shingles: int) -> Iterator[pa.RecordBatch]:
    """Blocks of members of one bucket from rows (slot, band, size of the bucket, cls, comp, n, regs) that are sorted by
    bucket and component: at most so many rows, and so many shingles unless a single member has more. alone: the block is
    the whole bucket."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal number
        slot, band, size, cls, comp, n = (table.column(c).to_numpy() for c in ("slot", "band", "size", "cls", "comp", "n"))
        regs = _registers(table.column("regs").combine_chunks())
        starts = [0]
        total = 0
        for k in range(len(cls)):
            new = k and (slot[k] != slot[k - 1] or band[k] != band[k - 1])
            if new or k - starts[-1] == rows or k > starts[-1] and total + n[k] > shingles:
                starts.append(k)
                total = 0
            total += n[k]
        out = []
        for a, b in zip(starts, [*starts[1:], len(cls)], strict=True):
            side = Side(cls[a:b], comp[a:b], n[a:b], regs[a:b])
            out.append((slot[a], band[a], number, bool(size[a] == b - a), comp[a:b].min(), comp[a:b].max(), side.pack()))
            number += 1
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for at in range(0, len(out), 64):
            columns = zip(*out[at : at + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["slot", "band", "block", "alone", "lo", "hi", "data"])

    held_rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_rows += batch.num_rows
        if held_rows < 8 * rows:
            continue
        table = pa.Table.from_batches(held)
        slot, band = table.column("slot").to_numpy(), table.column("band").to_numpy()
        last = np.flatnonzero((slot[1:] != slot[:-1]) | (band[1:] != band[:-1]))
        # The last bucket waits for its other rows; one that is longer than a block is in several in any case.
        stop = int(last[-1]) + 1 if len(last) else len(slot)
        yield from blocks(table.slice(0, stop))
        held = [b for b in table.slice(stop).to_batches() if b.num_rows]
        held_rows -= stop
    if held:
        yield from blocks(pa.Table.from_batches(held))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept (id = component_id).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the least id
    that links reach. Null and blank texts have an empty set and are linked with nothing. Rows with a null id are linked
    with nothing, have a null component_id and are kept. Rows that share an id are one document: its texts' links are
    joined, and all its rows that hold words have one component_id. Equal sets are linked whatever their ids; texts are read whole; an
    empty table gives an empty table; other columns are not read. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = text_rows(docs, id_col, text_col)
    kind = same_dtype(rows, "__id")
    n_bands, band_size = banding(percent)
    sift = Sift(percent, likely(percent / 100), band_size)
    sketches = written(rows.mapInArrow(lambda b: _sketch(b, shingle), f"__id {kind}, n_shingles bigint, set_key binary, regs binary"), "sketches")
    valid = sketches.filter("set_key is not null and __id is not null")
    # A class is a set of shingles; the least id that has it and any one row of that id stand for it.
    least_ids = valid.groupBy("set_key").agg(F.min("__id").alias("__id"))
    chosen = valid.join(least_ids, ["set_key", "__id"], "left_semi").dropDuplicates(["set_key"])
    classes = written(chosen.select("set_key", F.col("__id").alias("id"), F.col("n_shingles").alias("n"), "regs").withColumn("cls", F.monotonically_increasing_id()), "classes")
    reps = classes.select("cls", "n", "regs")
    bands = written(reps.select("cls", "regs").mapInArrow(lambda b: _bands(b, n_bands, band_size), "slot int, band bigint, cls bigint"), "bands")
    groups = written(bands.groupBy("slot", "band").agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = written(bands.join(groups, ["slot", "band"]), "members")  # of buckets with company only
    pairs = written(members.filter("cls != leader").select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    side = lambda name: reps.select(F.col("cls").alias(name), F.col("regs").alias(f"regs_{name}"), F.col("n").alias(f"n_{name}"))

    def likely_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_registers(b.column(b.schema.get_field_index(c))) for c in ("regs_a", "regs_b"))
                na, nb = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n_a", "n_b"))
                keep = (estimate((x == y).mean(1), np.sqrt(na * nb)) >= sift.least) & sift.sizes_fit(na, nb)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    sided = hub_join(pairs, "b", side("b"), pairs.count()).join(side("a"), "a")
    candidates = written(sided.mapInArrow(likely_links, "a bigint, b bigint"), "candidates")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(cls, shingles): the full shingle sets of these classes, from the whole texts of the rows that stand for them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4 << 20):
                sets = [shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()]
                keys = [_set_key(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["set_key", "shingles"])

        named = classes.join(wanted.distinct(), "cls", "left_semi").select("cls", "set_key", F.col("id").alias("__id"))
        texts = rows.filter("__id is not null").join(named.select("__id").distinct(), "__id", "left_semi")
        hashed = texts.mapInArrow(run, "set_key binary, shingles array<bigint>")
        return hashed.join(named.select("set_key", "cls"), "set_key").select("cls", "shingles").dropDuplicates(["cls"])

    sets = written(sets_of(candidates.select(F.col("a").alias("cls")).unionByName(candidates.select(F.col("b").alias("cls")))), "sets")
    left, right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = written(hub_join(candidates, "b", right, candidates.count()).join(left, "a").filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct(), "links")
    first = written(connected(links), "first-components")
    release(bands, pairs, candidates, sets, links)

    # Buckets whose members lie in several components, in blocks. Of a long bucket, blocks that lie in one component meet
    # only blocks that do not.
    placed = members.join(first.select(F.col("id").alias("cls"), "component"), "cls", "left").select("slot", "band", "cls", F.coalesce("component", "cls").alias("comp"))
    mixed = written(placed.groupBy("slot", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi and size > 2").select("slot", "band", "size"), "mixed-buckets")
    ordered = placed.join(mixed, ["slot", "band"]).join(reps, "cls").select("slot", "band", "size", "cls", "comp", "n", "regs")
    order = ["slot", "band", "comp", F.xxhash64("cls")]
    blocks = written(ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _block(b, BLOCK, BLOCK_SHINGLES), _BLOCKS), "blocks")
    whole = blocks.filter("alone").select("slot", F.col("block").alias("x"), F.col("block").alias("y"), F.col("data").alias("data_x"), F.lit(None).cast("binary").alias("data_y"))
    parts = blocks.filter("not alone")
    meta = lambda s: parts.select("slot", "band", F.col("block").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    meeting = meta("x").join(meta("y"), ["slot", "band"]).filter("x <= y and (lo_x != hi_x or lo_y != hi_y or lo_x != lo_y)").select("slot", "x", "y")
    data = lambda s: parts.select(F.col("block").alias(s), F.col("data").alias(f"data_{s}"))
    work = whole.unionByName(meeting.join(data("x"), "x").join(data("y"), "y"), allowMissingColumns=True)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of two blocks, the members that have a likely partner in another component."""
        for b in batches:
            for slot, x, y, data_x, data_y in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("slot", "x", "y", "data_x", "data_y")), strict=True):
                left = Side.unpack(data_x)
                right = left if x == y else Side.unpack(data_y)
                hit = [set(), set()]
                for i, j in sift.pairs(left, right, slot):
                    hit[0].update(i.tolist())
                    hit[x != y].update(j.tolist())
                for k, (s, at) in enumerate(zip((left, right), hit, strict=True)):
                    if at:
                        at = np.array(sorted(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v), t) for v, t in ((slot, pa.int32()), (x, pa.int64()), (y, pa.int64()), (bool(k), pa.bool_()))] + [pa.array(s.cls[at]), pa.array(s.comp[at])], ["slot", "x", "y", "second", "cls", "comp"])

    busy = written(work.mapInArrow(active, "slot int, x bigint, y bigint, second boolean, cls bigint, comp bigint"), "busy")

    def forest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Links between components of two blocks, as few as keep their members together."""
        parent: dict = {}

        def root(c):
            while (p := parent.get(c, c)) != c:
                parent[c] = parent.get(p, p)
                c = parent[c]
            return c

        def side_of(part: pd.DataFrame) -> tuple[Side, list]:
            regs = np.frombuffer(b"".join(part.regs), np.uint16).reshape(len(part), BUCKETS)
            return Side(part.cls.to_numpy(), part.comp.to_numpy(), part.n.to_numpy(), regs), part.shingles.to_list()

        left, full_left = side_of(frame[~frame.second])
        right, full_right = (left, full_left) if key[0] == key[1] else side_of(frame[frame.second])
        as_sets: dict[int, frozenset] = {}

        def full(at: int, cls: int, held: list) -> frozenset:
            s = as_sets.get(cls)
            if s is None:
                s = as_sets[cls] = frozenset(held[at].tolist())
            return s

        out = []
        for i, j in sift.pairs(left, right, int(frame.slot.iloc[0])):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                ra, rb = root(int(left.comp[a])), root(int(right.comp[b]))
                if ra != rb:
                    s, t = full(a, int(left.cls[a]), full_left), full(b, int(right.cls[b]), full_right)
                    both = len(s & t)
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        parent[ra] = rb
                        out.append((int(left.comp[a]), int(right.comp[b])))
        return pd.DataFrame(out, columns=["a", "b"])

    more_sets = written(sets_of(busy.select("cls")), "sets")
    joint = busy.join(reps, "cls").join(more_sets, "cls").groupBy("x", "y").applyInPandas(forest, "a bigint, b bigint")
    # Whole components meet in these links, which name components.
    later = written(joint.distinct(), "later-links")
    second = written(connected(later), "second-components")
    component = F.coalesce("c2", "c1", "cls")
    steps = classes.select("cls", "set_key", "id").join(first.select(F.col("id").alias("cls"), F.col("component").alias("c1")), "cls", "left").withColumn("c1", F.coalesce("c1", "cls"))
    total = reps.count()
    steps = written(hub_join(steps, "c1", second.select(F.col("id").alias("c1"), F.col("component").alias("c2")), total, "left").select("set_key", "id", component.alias("comp")), "components")
    # An id with several texts joins their components.
    mark = F.xxhash64("set_key")
    several = valid.groupBy("__id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo != hi").select("__id")
    texts_of = written(valid.select("__id", "set_key").join(several, "__id", "left_semi").distinct().join(steps.select("set_key", "comp"), "set_key"), "texts-of-ids")
    least_comp = texts_of.groupBy("__id").agg(F.min("comp").alias("lo"))
    by_id = written(texts_of.join(least_comp, "__id").filter("comp != lo").select(F.col("comp").alias("a"), F.col("lo").alias("b")).distinct(), "id-links")
    third = written(connected(by_id), "third-components")
    joined = hub_join(steps, "comp", third.select(F.col("id").alias("comp"), F.col("component").alias("c3")), total, "left").select("set_key", "id", F.coalesce("c3", "comp").alias("comp"))
    least_of = joined.groupBy("comp").agg(F.min("id").alias("component_id"))
    final = written(hub_join(joined, "comp", least_of, total).select("set_key", "component_id"), "final-components")
    release(classes, groups, members, first, mixed, blocks, busy, more_sets, later, second, steps, texts_of, by_id, third)
    out = sketches.select("__id", "n_shingles", "set_key").join(final, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("__id").isNotNull(), F.coalesce("component_id", "__id")))
    return out.select(F.col("__id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle_sql(percent: int = 85, size: int = 5) -> str:
    """DuckDB SQL for near_duplicates() over documents: all pairs that share a shingle, by shingles and not by hashes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i : i + {size - 1}], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT p.x, p.y FROM p JOIN n u ON u.rid = p.x JOIN n v ON v.rid = p.y WHERE 100 * c >= {percent} * (u.n + v.n - c)),
e AS (SELECT u.doc_id AS a, v.doc_id AS b FROM l JOIN d u ON u.rid = l.x JOIN d v ON v.rid = l.y),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS c FROM two UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, doc_id)::BIGINT AS component_id,
  coalesce(coalesce(m.c, doc_id) = doc_id, true) AS kept FROM d LEFT JOIN n USING (rid) LEFT JOIN m ON m.id = d.doc_id AND n.n > 0"""
