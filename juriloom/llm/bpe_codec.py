"""Byte-pair encoding and decoding (operator 6) with segment trees over the ranks of adjacent pairs.

Each leaf of a word's tree holds the rank of the pair that begins at that symbol (NONE: not mergeable), each inner node
the smaller of its children with ties to the left, so that the root yields the leftmost lowest-rank merge. A merge changes
at most three leaves, each brought up to date along one path to the root, until the root is NONE. Long words use one tree
each; short words, which are nearly all, are put through the same steps side by side, a row of a matrix being one tree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCache, cut_strict
from .runtime import bound_batches, rare_gc, same_dtype, slices, text_rows

NONE = np.int64(1) << 40
CACHE_ENTRIES = 450_000
BATCH_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.specials.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        self.width = max(vocab.values()) + 2
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # An open-addressing table: two probes of an array instead of a binary search for each pair.
        self.bits = 18
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_rank = np.full(1 << self.bits, NONE, np.int64)
        self.probes = 0
        for key, rank in zip(self.keys.tolist(), self.ranks.tolist(), strict=True):
            at, step = self._slot(key), 0
            while self.table_key[at] >= 0:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            self.table_key[at], self.table_rank[at] = key, rank
            self.probes = max(self.probes, step + 1)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge or a side is missing (negative)."""
        keys = left * self.width + right
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        ranks = np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[todo]
        for _ in range(self.probes):
            held = self.table_key[at]
            hit = held == keys[todo]
            ranks[todo[hit]] = self.table_rank[at[hit]]
            more = ~hit & (held >= 0)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return ranks


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_long(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """One word with one tree: n log n steps."""
    n = len(symbols)
    size = 1 << max(0, n - 1).bit_length()
    none, width, rank_of, made = int(NONE), vocab.width, vocab.rank_of, vocab.made
    tree = [none * size + size - 1] * (2 * size)  # node: rank * size + position, so the least is the leftmost lowest
    for i in range(n - 1):
        tree[size + i] = rank_of.get(symbols[i] * width + symbols[i + 1], none) * size + i
    for at in range(size - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    symbols = symbols[:]

    def put(i: int, rank: int) -> None:
        at = size + i
        tree[at] = rank * size + i
        at >>= 1
        while at:
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
            at >>= 1

    while n > 1:
        rank, i = divmod(tree[1], size)
        if rank >= none:
            break
        j = after[i]
        symbols[i], symbols[j] = int(made[rank]), -1
        after[i] = k = after[j]
        put(j, none)
        if k >= 0:
            before[k] = i
            put(i, rank_of.get(symbols[i] * width + symbols[k], none))
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            put(h, rank_of.get(symbols[h] * width + symbols[i], none))
    return [s for s in symbols if s >= 0]


def merge_rows(symbols: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Words of one size class side by side: a row holds a word's symbols, -1 after its end. Returns the merged symbols,
    with -1 where nothing stands."""
    rows, size = symbols.shape
    symbols = symbols.copy()
    ids = np.arange(rows)
    after = np.broadcast_to(np.arange(1, size + 1), (rows, size)).copy()
    before = np.broadcast_to(np.arange(-1, size - 1), (rows, size)).copy()
    tree = np.full((rows, 2 * size), NONE * size + size - 1, np.int64)
    pairs = vocab.pair_ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, size - 1)
    tree[:, size : 2 * size - 1] = pairs * size + np.arange(size - 1)
    level = size
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half

    def put(r: np.ndarray, i: np.ndarray, ranks: np.ndarray) -> None:
        at = size + i
        tree[r, at] = ranks * size + i
        at = at >> 1
        while at[0]:
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
            at = at >> 1

    def symbol(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where((i >= 0) & (i < size), symbols[r, np.clip(i, 0, size - 1)], -1)

    live = ids[tree[:, 1] < NONE * size] if size > 1 else ids[:0]
    while len(live):
        root = tree[live, 1]
        rank, i = root // size, root % size
        j = after[live, i]
        merged = vocab.made[rank]
        symbols[live, i] = merged
        symbols[live, j] = -1
        k = after[live, j]
        after[live, i] = k
        inside = k < size
        before[live[inside], k[inside]] = i[inside]
        put(live, j, np.full(len(live), NONE))
        put(live, i, vocab.pair_ranks(merged, symbol(live, k)))
        h = before[live, i]
        has = h >= 0
        if has.any():
            put(live[has], h[has], vocab.pair_ranks(symbol(live[has], h[has]), merged[has]))
        live = live[tree[live, 1] < NONE * size]
    return symbols


def encode_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Symbols of each word after all merges."""
    out: list = [None] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for size in (4, 8, 16, 32, 64):
        chosen = np.flatnonzero((lengths > low) & (lengths <= size))
        low = size
        for start in range(0, len(chosen), max(1, (1 << 18) // size)):
            part = chosen[start : start + max(1, (1 << 18) // size)]
            flat = np.frombuffer(b"".join([words[i].ljust(size, b"\0") for i in part.tolist()]), np.uint8).reshape(len(part), size)
            symbols = np.where(np.arange(size) < lengths[part, None], vocab.byte_ids[flat], -1)
            merged = merge_rows(symbols, vocab)
            keep = merged >= 0
            ends = np.cumsum(keep.sum(1)).tolist()
            ids = merged[keep].tolist()
            begin = 0
            for i, end in zip(part.tolist(), ends, strict=True):
                out[i] = ids[begin:end]
                begin = end
    for i in np.flatnonzero(lengths > low).tolist():
        out[i] = merge_long(vocab.byte_ids[np.frombuffer(words[i], np.uint8)].tolist(), vocab)
    return [[] if x is None else x for x in out]


class Codec:
    """Encodes and decodes texts under one vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        rare_gc()
        self.vocab = vocabulary(path)
        self.words = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocab.specials)) + ")") if self.vocab.specials else None
        self.word_ids = PieceCache(lambda words: encode_words([w.encode("utf-8", "replace") for w in words], self.vocab), CACHE_ENTRIES, True)

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; words met before are not merged again."""
        plain = [not (self.special and "<|" in t and self.special.search(t)) for t in texts]
        split = [self.words(t) if p else None for t, p in zip(texts, plain, strict=True)]
        ids = iter(self.word_ids.look([words for words in split if words is not None]))
        return [
            self._with_specials(text) if words is None else got[0] if len(got := next(ids)) == 1 else list(chain.from_iterable(got))
            for text, words in zip(texts, split, strict=True)
        ]

    def _with_specials(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            words = [] if i % 2 else self.words(part)
            ids += [self.vocab.specials[part]] if i % 2 else chain.from_iterable(encode_words([w.encode("utf-8", "replace") for w in words], self.vocab))
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Byte sequences that are no UTF-8 come back as replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Digest:
    """Per piece: number of ids, the ids in decimal with commas, and the bytes decoded from them."""

    def __init__(self, path: str, pattern: str | None):
        self.codec = Codec(path, pattern)
        encode = self._encode
        self.first = PieceCache(encode, CACHE_ENTRIES // 8, True)
        self.rest = PieceCache(lambda pieces: encode([" " + p for p in pieces]), CACHE_ENTRIES, True)

    def _encode(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        return [(len(ids), ",".join(map(str, ids)), self.codec.decode_bytes(ids)) for ids in self.codec.encode_pieces(pieces)]

    def __call__(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        cut = [cut_strict(t) for t in texts]
        heads, tails = self.first.look([p[:1] for p in cut]), self.rest.look([p[1:] for p in cut])
        counts, ids_sha, text_sha = [], [], []
        for head, tail in zip(heads, tails, strict=True):
            got = head + tail
            counts.append(sum([x[0] for x in got]))
            ids_sha.append(hashlib.sha256(",".join([x[1] for x in got if x[0]]).encode()).hexdigest())
            text = b"".join([x[2] for x in got])
            text_sha.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
        return counts, ids_sha, text_sha


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """The general operator: id and ids (array<int>) of each text, as many rows as docs has; null text gives an empty array."""
    bound_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path, pattern)
        for batch in slices(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.encode_pieces(batch.column(1).to_pylist()), pa.list_(pa.int32()))], ["__id", "ids"])

    return rows.mapInArrow(run, f"__id {same_dtype(rows, '__id')}, ids array<int>").withColumnRenamed("__id", id_col)


def decoded(encodings: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse: id and text of each row of ids; null ids give an empty text, unknown ids fail."""
    bound_batches(encodings.sparkSession)
    rows = encodings.select(F.col(id_col).alias("__id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path)
        for batch in slices(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["__id", "text"])

    return rows.mapInArrow(run, f"__id {same_dtype(rows, '__id')}, text string").withColumnRenamed("__id", id_col)


def encoding_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text
    decoded from the ids).

    Null text counts as empty text, whose ids string is empty. Null ids, repeated rows and repeated ids stay as they are;
    long texts are encoded whole; an empty table gives an empty table; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _Digest(tokenizer_path, pattern)
        for batch in slices(batches, BATCH_BYTES):
            counts, ids_sha, text_sha = digest(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"__id {same_dtype(rows, '__id')}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
