import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from juriloom.llm.bpe_codec import Codec, decoded, encode_words, encoded, encoding_digest, merge_long, vocabulary
from juriloom.llm.cutting_stock import best_pattern, whole_patterns
from juriloom.llm.packing import pack
from juriloom.llm.token_counts import token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, sequence_id string, __id string"


def texts():
    r = random.Random(5)
    odd = [None, "", " ", "a", "  a  b ", "x\n y", "<|endoftext|> b<|endoftext|>", "don't I'LL 12 3½", "é é ́a", "a" * 5000, "\x1c a \x85b　c", "👩‍👩‍👧 日本語"]
    return odd + ["".join(r.choice("abT' \n\t1é🙂　\x1c<|>") for _ in range(r.randint(0, 80))) for _ in range(150)] + ["same text here"] * 3


def frame(spark, values):
    rows = [(i if i != 7 else None, t, "x", "y", "z") for i, t in enumerate(values)] + [(0, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_token_counts(spark, path):
    values = texts() + ["word " * 5000]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, values), path).collect()))
    tok = Tokenizer.from_file(path)
    want = [(i == 7, 0 if i == 7 else i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(values), (0, None)]]
    assert got == sorted((*w, w[3] > 2048) for w in want)


def test_pieces_are_remembered_within_bounds():
    from juriloom.llm.pieces import LONG, MEAN, PieceCache

    cache = PieceCache(lambda pieces: [len(p) for p in pieces], 1000, False)
    for i in range(10_000):
        assert cache.look([["日本" * 500 + str(i), "word"]]) == [[1000 + len(str(i)), 4]]
    assert len(cache) <= 2 and not cache.old
    for i in range(300):
        batch = [["x" * (i % LONG) + f"{i}-{j}" for j in range(50)]]
        assert cache.look(batch) == [[len(p) for p in batch[0]]]
        assert len(cache) <= 1050 and sum(map(len, [*cache, *cache.old])) <= 2 * (MEAN * 1000 + 50 * 80)


def test_token_counts_model_and_empty(spark):
    import sentencepiece

    values = texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, values), PIECE).collect() if r.doc_id}
    assert all(got[i] == len(sp.encode(values[i] or "")) for i in got)
    assert token_counts(frame(spark, values).limit(0), WORD).count() == 0


def test_codec_digest_and_round_trip(spark):
    values = texts()
    tok = Tokenizer.from_file(BYTE)
    docs = frame(spark, values)
    got = {r.doc_id: r for r in encoding_digest(docs, BYTE).collect() if r.doc_id}
    for i, r in got.items():
        ids = tok.encode(values[i] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in decoded(encoded(docs, BYTE), BYTE).collect() if r.doc_id}
    assert all(back[i] == (values[i] or "") for i in back)
    assert encoding_digest(docs.limit(0), BYTE).count() == 0


def test_tree_kinds_agree():
    vocab, r = vocabulary(BYTE), random.Random(2)
    words = [bytes(r.choice(b"ternhio a") for _ in range(r.randint(1, 90))) for _ in range(300)]
    assert encode_words(words, vocab) == [merge_long([int(vocab.byte_ids[b]) for b in w], vocab) for w in words]


def test_decode_of_broken_utf8():
    codec, tok = Codec(BYTE), Tokenizer.from_file(BYTE)
    ids = tok.encode("é🙂", add_special_tokens=False).ids
    for part in (ids[:1], ids[1:], ids[:-1]):
        assert codec.decode(part) == tok.decode(part, skip_special_tokens=False)


def check_packing(rows, values, capacity):
    tok = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(values):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_packing(spark):
    r = random.Random(3)
    values = [*texts(), "tion the " * 900, *(" ".join(r.choice(["one", "tion", "worthless"]) for _ in range(r.randint(1, 700))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(values)], SCHEMA).repartition(3)
    assert check_packing(pack(docs, BYTE).collect(), values, 1024) > 0.95
    check_packing(pack(docs, BYTE, capacity=100, grid=7).collect(), values, 100)
    assert pack(docs.limit(0), BYTE).count() == 0
    assert pack(docs, BYTE, keep_ids=True).filter("size(ids) != length").count() == 0


def test_packing_ids_of_odd_neighbours():
    """Whatever stands beside a cut, the pieces' ids are those of the whole text; and across batches, from the memory too."""
    from juriloom.llm.packing import CACHE_ENTRIES, _encoder, _tokens
    from juriloom.llm.pieces import PieceCache

    r = random.Random(11)
    parts = [*" \n\t\r\x0b\x1c\x85\xa0.,'!|<>-_9½²éÉ×÷ß’“—…中　🙂", " ", "\n", " ", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "\ufeff", "e\u0301"]
    parts += ["the", "a", "'s", "'LL", " of", "tion", "<|endoftext|>", "<|endof", "Ünï"]
    values = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(6000)]
    values += [a + b + c + d for a in parts for b in " \n.'" for c in parts for d in ("", " x", "\n")]
    tok = Tokenizer.from_file(BYTE)
    want = [[*e.ids, 0] for e in tok.encode_batch(values, add_special_tokens=False)]
    encode, marks = _encoder(BYTE)
    cache = PieceCache(encode, CACHE_ENTRIES, True)
    at = 0
    for size in (1, 2, 0, 500, len(values)):
        part = values[at : at + size]
        if part:
            ids, totals = _tokens(pa.array(["gone", *part], pa.string())[1:], cache, marks)
            assert [x.tolist() for x in np.split(ids, np.cumsum(totals)[:-1])] == want[at : at + size]
        at += size


def test_packing_looks_equal_pieces_up_once(spark, monkeypatch):
    """the memory is asked for the different pieces of a batch, not for each of them; and small batches are joined."""
    from juriloom.llm import packing

    asked = []

    class Counted(packing.PieceCache):
        def look(self, texts):
            asked.append(sum(map(len, texts)))
            return super().look(texts)

    monkeypatch.setattr(packing, "PieceCache", Counted)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    texts = [f"one two, three four.\nfive number{i % 7} " * 20 for i in range(2000)]
    table = pa.table({"__id": pa.array(range(2000)), "__text": pa.array(texts)})
    rows = pa.Table.from_batches(list(packing._pieces(iter(table.to_batches(max_chunksize=100)), BYTE, 1024, 8, True)))
    assert sum(asked) < 100
    tok = Tokenizer.from_file(BYTE)
    assert rows.column("ids").to_pylist()[:3] == [[*tok.encode(t).ids, 0] for t in texts[:3]] and rows.num_rows == 2000


def test_packing_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.length) for r in pack(docs, BYTE).collect()) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]


def test_cutting_stock_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        capacity = int(r.integers(8, 40))
        lengths = np.unique(r.integers(1, capacity + 1, 5))
        values = r.random(len(lengths))
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - n] + v for n, v in zip(lengths, values) if n <= c)])
        value, pattern = best_pattern(lengths, values, capacity)
        assert abs(value - best[capacity]) < 1e-9 and abs(sum(values[i] * k for i, k in pattern.items()) - value) < 1e-9
        counts = r.integers(0, 60, len(lengths))
        got = np.zeros(len(lengths), int)
        for p, times in whole_patterns(lengths, counts, capacity):
            assert sum(lengths[i] * k for i, k in p.items()) <= capacity
            for i, k in p.items():
                got[i] += k * times
        assert (got == counts).all()


WORKER = """
import re, sys
from types import SimpleNamespace
import pyarrow as pa
from juriloom.llm import packing

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
texts = [" ".join(f"w{i:x}" for i in range(at, at + 200)) for at in range(0, 800_000, 200)]
batches = pa.RecordBatch.from_pydict({"__id": [*range(len(texts))], "__text": texts})
least = held()
most, rows = 0, 0
for out in packing._pieces((batches.slice(at, 512) for at in range(0, len(texts), 512)), sys.argv[1], 1024, 8, False):
    most, rows = max(most, held()), rows + out.num_rows
assert rows >= len(texts)
print(most - least, held() - least)
"""


def test_packing_worker_memory():
    """Many different words: a worker's own memory stays low, as several workers share an executor's limit."""
    run = subprocess.run([sys.executable, "-c", WORKER, BYTE], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], timeout=300)
    most, _ = map(float, run.stdout.split())
    assert most < 200
