"""Token counts (operator 9): batch encoding in an Arrow function that returns lengths only.

Arrow batches are cut into batches balanced by bytes; texts are split at safe boundaries (see pieces.py), pieces that the
worker has not met yet are encoded by the tokenizer library in one batch, and only their lengths are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCache, cut_loose, cut_strict
from .runtime import bound_batches, give_back, one_thread, rare_gc, same_dtype, slices, text_rows

BATCH_BYTES = 1 << 20
CACHE_ENTRIES = 400_000


def _json_lengths(path: str):
    one_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kind = str(tokenizer.pre_tokenizer)
    # Byte-level: spaces begin tokens. A split whose separators are removed: white space is in no token. Else: whole texts.
    strict = True if kind.startswith("ByteLevel") else False if "Split" in kind and "Removed" in kind else None

    def encode(pieces: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    return encode, strict


def _model_lengths(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda pieces: [len(x) for x in processor.encode(pieces, num_threads=1)], None


def _count(batches: Iterator[pa.RecordBatch], path: str, batch_bytes: int, entries: int) -> Iterator[pa.RecordBatch]:
    rare_gc()
    encode, strict = (_model_lengths if path.endswith(".model") else _json_lengths)(path)
    first = PieceCache(encode, entries // 8, True)
    rest = PieceCache((lambda pieces: encode([" " + p for p in pieces])) if strict else encode, entries, bool(strict))
    for batch in slices(batches, batch_bytes):
        texts = batch.column(1).to_pylist()
        sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
        if strict is None:  # no boundary is known to be safe
            counts = encode(texts)
        elif strict:
            parts = [cut_strict(t) for t in texts]
            counts = [a[0] + sum(b) for a, b in zip(first.look([p[:1] for p in parts]), rest.look([p[1:] for p in parts]), strict=True)]
        else:
            counts = list(map(sum, rest.look([cut_loose(t) for t in texts])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["__id", "n_bytes", "n_tokens"])
    first = rest = texts = counts = None
    give_back()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty text (0 bytes, 0 tokens). A null id stays null; repeated rows and ids stay repeated. Very
    long texts are counted whole, as the sum of pieces cut where no token can cross. An empty table gives an empty table.
    Other columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    schema = f"__id {same_dtype(rows, '__id')}, n_bytes bigint, n_tokens bigint"
    counted = rows.mapInArrow(lambda b: _count(b, tokenizer_path, batch_bytes, cache_entries), schema)
    return counted.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
