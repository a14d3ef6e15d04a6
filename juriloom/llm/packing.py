"""Packing (operator 3): token sequences from documents by cutting-stock column generation.

1. One pass encodes the different pieces of the texts (pieces.py), puts their ids together, appends id 0 and cuts full
   sequences off; what remains of a document is one piece shorter than the capacity. These go to a table without their ids:
   the only data that moves further.
2. The histogram of the remainders, in classes of a few tokens, is bounded by the capacity and goes to the driver, where
   the linear program chooses patterns (cutting_stock.py).
3. Pieces of a class are ranked by partition and place there; a range of ranks belongs to each pattern, so that a piece
   finds its sequence by a search in a small table. No task gathers a class.
4. A window over each sequence (a bounded number of pieces) gives the gapless offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cutting_stock import whole_patterns
from .pieces import PUNCTUATION, WHITE_ENDS, PieceCache, byte_cuts
from .runtime import bound_batches, give_back, grouped, one_thread, rare_gc, same_dtype, slices, text_rows, written

CACHE_ENTRIES = 200_000
BATCH_BYTES = 1 << 20
GRID = 8  # tokens by which remainders are classed in the program; at most GRID - 1 tokens of padding a document


JOINED = 256  # pieces that are encoded as one text


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Encodes pieces, those that begin with a space many as one text: no token crosses a safe boundary, and the bytes that
    each token stands for tell which ids are whose. Returns that and the marks to cut at (byte_cuts), None if texts must be whole."""
    one_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = tokenizer.get_added_tokens_decoder().values()
    before = tokenizer.pre_tokenizer
    strict = str(before).startswith("ByteLevel") and before.use_regex and not before.add_prefix_space and tokenizer.normalizer is None
    strict = strict and not any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in added)

    def single(pieces: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    if not strict:
        return single, None
    # A character of the byte-level alphabet is a byte; added tokens stand for themselves.
    held = {i: len(token) for token, i in tokenizer.get_vocab(with_added_tokens=False).items()} | {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    size_of = np.zeros(max(held) + 1, np.int64)
    size_of[list(held)] = list(held.values())
    marks = PUNCTUATION.copy()
    marks[[b for t in added for b in t.content.encode()]] = False

    def joined(pieces: list[bytes]) -> list[bytes]:
        many = [i for i, p in enumerate(pieces) if p[0] == 0x20 and (p[-1] not in WHITE_ENDS or not p.decode()[-1].isspace())]
        rest = sorted({*range(len(pieces))}.difference(many))
        out: list[bytes] = [b""] * len(pieces)
        for i, ids in zip(rest, single([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        groups = [many[i : i + JOINED] for i in range(0, len(many), JOINED)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([b"".join([pieces[i] for i in g]).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(pieces[i]) for i in group])
            cuts = np.searchsorted(np.cumsum(size_of[ids]), ends, side="left") + 1
            data, begin = ids.tobytes(), 0
            for i, end in zip(group, (4 * cuts).tolist(), strict=True):
                out[i] = data[begin:end]
                begin = end
        return out

    return joined, marks


def _bytes_list(values: pa.Array) -> list[bytes]:
    """What to_pylist() gives for large_binary without nulls, in a fraction of its time."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    data = (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[a:b] for a, b in pairwise(at)]


def _tokens(texts: pa.Array, cache: PieceCache, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, each with id 0 at its end, and how many each has. Equal pieces of the texts
    are looked up once."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    if marks is not None:
        begins[byte_cuts(data, marks)] = True
    begins[-1] = True
    places = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
    values = cache.look([_bytes_list(pieces.dictionary)])[0]
    # An id 0 is one more value, and stands after the last piece of each text.
    pool = np.frombuffer(b"".join(values) + b"\0\0\0\0", "<u4")
    sizes = np.array([*map(len, values), 4], np.int64) // 4
    which = np.insert(pieces.indices.to_numpy().astype(np.int64), np.searchsorted(places, offsets[1:]), len(values))
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    ids = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + lengths, lengths) + np.arange(ends[-1])]
    return ids, np.diff(ends[which == len(values)], prepend=0)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, grid: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    rare_gc()
    encode, marks = _encoder(path)
    cache = PieceCache(encode, CACHE_ENTRIES, True)
    pid, seen = TaskContext.get().partitionId(), {}
    for batch in slices(grouped(batches, BATCH_BYTES), BATCH_BYTES):
        ids, totals = _tokens(batch.column(1), cache, marks)
        parts = -(-totals // capacity)
        source = np.repeat(np.arange(len(totals)), parts)
        start = (np.arange(len(source)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
        length = np.minimum(capacity, totals[source] - start)
        kind = np.where(length < capacity, -(-length // grid), -(-capacity // grid) + 1)
        place = []
        for k in kind.tolist():
            seen[k] = seen.get(k, -1) + 1
            place.append(seen[k])
        ends = np.cumsum(length)
        data = memoryview(ids).cast("B")
        crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * (ends - length)).tolist(), (4 * ends).tolist(), strict=True)]
        columns = [(start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (totals[source], pa.int64()), (np.full(len(source), pid), pa.int32()), (kind, pa.int32()), (place, pa.int64())]
        arrays = [batch.column(0).take(pa.array(source)), *(pa.array(values, kind) for values, kind in columns)]
        names = ["__id", "start", "length", "ids_crc32", "doc_tokens", "pid", "kind", "place"]
        if keep_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)
    cache = ids = data = batch = columns = arrays = None
    give_back()


class Plan:
    """Which ranks of which class go to which sequences. Its size depends on the capacity and the grid alone."""

    def __init__(self, histogram: dict[int, int], capacity: int, grid: int):
        units = capacity // grid
        self.full = -(-capacity // grid) + 1
        kinds = sorted(k for k in histogram if k != self.full)
        # A class that is longer than the capacity in whole units (capacity no multiple of the grid) has a sequence each.
        alone = [k for k in kinds if k > units]
        packed = [k for k in kinds if k <= units]
        patterns = whole_patterns(np.array(packed, np.int64), np.array([histogram[k] for k in packed], np.int64), units)
        patterns = [({packed[i]: c for i, c in p.items()}, times) for p, times in patterns] + [({k: 1}, histogram[k]) for k in alone]
        patterns.append(({self.full: 1}, histogram.get(self.full, 0)))
        at: dict[int, int] = {}
        sequence, rows = 0, []
        for pattern, times in patterns:
            for kind, copies in pattern.items():
                rows.append((kind, at.get(kind, 0), copies, sequence))
                at[kind] = at.get(kind, 0) + copies * times
            sequence += times
        assert all(at.get(k, 0) == n for k, n in histogram.items())
        rows.sort()
        self.sequences = sequence
        kind, start, copies, base = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.keys, self.start, self.copies, self.base = (kind << 44) + start, start, copies, base

    def sequence(self, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, (kind.astype(np.int64) << 44) + rank, side="right") - 1
        return self.base[at] + (rank - self.start[at]) // self.copies[at]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if wanted).

    A document's tokens are those of its whole text and then id 0, so that a null or empty text has one token, and each
    row of docs is packed by itself: repeated rows and ids, null ids included, are packed as often as they occur. Each
    token lies in exactly one piece; a document longer than the capacity fills whole sequences and leaves one shorter
    piece. Ties of equal lengths go by partition and place. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = text_rows(docs, id_col, text_col)
    schema = f"__id {same_dtype(rows, '__id')}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, pid int, kind int, place bigint" + ", ids array<int>" * keep_ids
    pieces = written(rows.mapInArrow(lambda b: _pieces(b, tokenizer_path, capacity, grid, keep_ids), schema), "pieces")
    counts = pieces.groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    out = ["__id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    if not histogram:
        return pieces.select("__id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *["ids"] * keep_ids).withColumnRenamed("__id", id_col)
    plan = Plan(histogram, capacity, grid)
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("pid", "kind", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["pid", "kind"]).withColumn("rank", F.col("first") + F.col("place")).drop("first")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("kind", "rank"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plan.sequence(kind, rank), pa.int64())], [*b.schema.names, "sequence_id"])

    placed = ranked.mapInArrow(find, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id bigint")
    full = placed.filter(F.col("kind") == plan.full).withColumn("offset", F.lit(0).cast("bigint"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "pid", "kind", "place").rowsBetween(Window.unboundedPreceding, -1)
    short = placed.filter(F.col("kind") != plan.full).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return full.select(out).unionByName(short.select(out)).withColumnRenamed("__id", id_col)
