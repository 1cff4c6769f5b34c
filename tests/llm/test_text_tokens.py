"""Token files and packing: equality with the library, exact round trips, brute-force packing."""

from __future__ import annotations

import bisect
import io
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meterline.llm import frames, tokens
from meterline.llm.bitpack import (
    ShardReader,
    ShardWriter,
    id_width,
    pack_ids,
    read_token_files,
    token_file_report,
    unpack_ids,
    write_token_files,
)
from meterline.llm.packing import best_fit_decreasing, pack_documents
from meterline.llm.tokens import LONGEST_KEPT, Encoder

FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))
PARTS = ["a", "the", "B", " ", "  ", "\n", "\n\n", ".", ",", "\t", "'s", "é", "İ", "ŉ", "1", "\xa0", "<|endoftext|>", "!", "\x0b", "中", "é", "..,"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_pieces_give_the_ids_of_whole_texts(name, spaced, texts):
    chance = random.Random(3)
    odd = ["".join(chance.choice(PARTS) for _ in range(chance.randrange(40))) for _ in range(1_500)] + [None, ""]
    coder, whole = Encoder(name, spaced, cache_pieces=50), library(name)
    some = odd + list(texts.values())[:60]
    for text, packed in zip(some, coder.encode(some), strict=True):
        assert np.frombuffer(packed, coder.dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids
    again = list(coder.encode(some[:100]))
    assert again == list(Encoder(name, spaced).encode(some[:100]))


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1_003, dtype=np.uint64).astype(np.uint32)
    assert (unpack_ids(pack_ids(ids, width), len(ids), width) == ids).all()
    assert id_width(1 << width) == width


def test_random_access():
    out = io.BytesIO()
    writer = ShardWriter(out, 11, block_ids=64)
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 2_048, n).astype(np.uint32) for n in (0, 5, 300, 64, 1, 63, 129)]
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k, ids)
    writer.close()
    reader = ShardReader(pa.BufferReader(out.getvalue()))
    everything = np.concatenate(docs)
    for start, stop in ((0, 0), (3, 70), (64, 128), (130, 500), (0, len(everything))):
        assert (reader.ids(start, stop) == everything[start:stop]).all()
    read = list(reader.documents())
    assert [x[0] for x in read] == [0, 1, 2, None, 4, 5, 6]
    assert all((a == b).all() for (_, _, a), b in zip(read, docs, strict=True))


def test_token_files_of_documents(spark, documents, texts):
    whole = library("byte_bpe_50k.json")
    start = 0
    found = {row.doc_id: row for row in token_file_report(spark, documents).collect()}
    for key in sorted(texts):
        ids = np.array(whole.encode(texts[key], add_special_tokens=False).ids + [0], "<u4")
        row = found.pop(key)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not found


def test_token_files_of_odd_rows(spark, odd, nothing):
    rows = sorted(token_file_report(spark, odd).collect(), key=lambda row: row.start)
    assert len(rows) == odd.count() and rows[0].doc_id is None
    assert [row.start for row in rows] == list(np.cumsum([0, *[row.n_tokens for row in rows]])[:-1])
    assert [row.doc_id for row in rows[1:]] == sorted(row.doc_id for row in rows[1:])
    assert token_file_report(spark, nothing).count() == 0


def brute_rooms(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return rooms


def test_small_token_files(spark, documents, tmp_path):
    """A manifest of many files is one file, and small files are read several to a task, with the same rows."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    expected = {tuple(row) for row in token_file_report(spark, documents).collect()}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        manifest = write_token_files(documents, f"file://{tmp_path}/tokens")
        found = read_token_files(manifest, f"file://{tmp_path}/tokens")
        assert manifest.count() > 8 and len(manifest.inputFiles()) == 1
        assert found.rdd.getNumPartitions() <= 2
        rows = [tuple(row) for row in found.collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(rows) == documents.count() and set(rows) == expected


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_is_that_of_single_pieces(seed):
    chance = random.Random(seed)
    capacity = chance.choice([16, 50, 97])
    lengths = [min(capacity, 1 + int(chance.expovariate(4 / capacity))) for _ in range(chance.choice([0, 1, 40, 700]))]
    steps, windows = best_fit_decreasing(np.bincount(lengths, minlength=capacity + 1), capacity)
    fill = {}
    for step in steps:
        for nth in range(step.count):
            window, offset = step.window + nth // step.per_window, step.offset + nth % step.per_window * step.length
            assert fill.get(window, 0) == offset
            fill[window] = offset + step.length
    assert sorted(capacity - x for x in fill.values()) == brute_rooms(lengths, capacity) and len(fill) == windows


def check_packing(rows, ids, capacity=4_096):
    fill, tokens = {}, {}
    for row in sorted(rows, key=lambda row: (row.sequence_id, row.offset)):
        assert fill.get(row.sequence_id, 0) == row.offset
        fill[row.sequence_id] = row.offset + row.length
        assert fill[row.sequence_id] <= capacity
        tokens[row.doc_id] = tokens.get(row.doc_id, 0) + row.length
        if row.doc_id in ids:
            own = ids[row.doc_id]
            assert row.doc_tokens == len(own)
            assert row.ids_crc32 == zlib.crc32(own[row.start : row.start + row.length].tobytes())
    assert sorted(fill) == list(range(len(fill)))
    rooms = brute_rooms([row.length for row in rows], capacity)
    assert sorted(capacity - x for x in fill.values()) == rooms
    return tokens


def test_packing_of_documents(documents, texts):
    whole = library("word_bpe_49k.json")
    ids = {k: np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4") for k, t in texts.items()}
    tokens = check_packing(pack_documents(documents).collect(), ids)
    assert tokens == {k: len(v) for k, v in ids.items()}


def test_packing_of_odd_rows(odd, nothing):
    rows = pack_documents(odd).collect()
    tokens = check_packing(rows, {})
    assert tokens[1] == tokens[2] == tokens[3] == 1 and sum(row.doc_id == 5 for row in rows) == 2
    assert pack_documents(nothing).count() == 0


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_texts_without_spaces_do_not_fill_the_cache(name, spaced):
    """Thousands of long texts in one piece each: ids as the library's, and nothing of them is kept."""
    draw = np.random.default_rng(2)
    texts = ["".join(map(chr, draw.integers(0x4E00, 0x9FA5, 600))) for _ in range(1_500)] + ["a" * 9_000, "x" + "!" * 5_000, "x" * 70 + "!" * 70]
    own = Encoder(name, spaced)
    got = [np.frombuffer(ids, own.dtype).tolist() for ids in own.encode(texts)]
    assert got == [found.ids for found in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    kept = [*own.young, *own.old, *own.tails]
    assert all(len(piece) <= LONGEST_KEPT for piece in kept) and len(kept) < 200


def test_batches_come_in_parts():
    """All rows in order, never many texts at once."""
    sizes = [0, 1, frames.PART_ROWS, 2 * frames.PART_ROWS + 1]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], names=["k"]) for n in sizes]
    found = list(frames.parts(batches))
    assert max(part.num_rows for part in found) <= frames.PART_ROWS
    assert [k for part in found for k in part.column("k").to_pylist()] == [k for n in sizes for k in range(n)]


def test_memory_of_an_encoder():
    """An encoder holds the pieces of about a million characters at once, however many texts it is given."""
    coder = Encoder("word_bpe_49k.json", False)
    chance = random.Random(5)
    stock = ["".join(chance.choices("abcdefghij", k=7)) for _ in range(4_000)]
    texts = [" ".join(chance.choices(stock, k=1_500)) for _ in range(600)]
    list(coder.encode(texts[:10]))
    tracemalloc.start()
    try:
        assert sum(map(len, coder.encode(iter(texts)))) > 0
        assert tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_an_encoder_works_on_one_text_at_a_time(name, spaced):
    """Ids of a text come before the next text is taken, and one long text of many words does not overfill the cache."""
    taken = []
    texts = ["the first of them", "and the second", None, "the first of them"]
    coder = Encoder(name, spaced, cache_pieces=100)
    for k, _ in enumerate(coder.encode(taken.append(text) or text for text in texts)):
        assert len(taken) == k + 1
    many = " ".join(f"{a}{b}{c}{d}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz" * 2 for c in "abcdefghijklmnopqrst" for d in "abcdefghij")
    [packed] = coder.encode([many])
    assert len(coder.young) <= 100 + tokens.RUN_PIECES // 2 and len(coder.old) <= 100 + tokens.RUN_PIECES
    assert np.frombuffer(packed, coder.dtype).tolist() == library(name).encode(many, add_special_tokens=False).ids


def test_tasks_that_encode_nothing_drop_encoders():
    """All batches come, after the pieces and encoders that packing left in the process have gone."""
    coder = tokens.encoder("word_bpe_49k.json", False)
    list(coder.encode(["what packing left", "in a worker"]))
    assert coder.young and tokens.encoder("word_bpe_49k.json", False) is coder
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], names=["k"]) for n in (2, 0, 3)]
    assert list(frames.spared(batches)) == batches
    assert not tokens.ENCODERS and not coder.young and not coder.old and not coder.tails
    assert list(tokens.encoder("word_bpe_49k.json", False).encode(["in a worker"])) == list(coder.encode(["in a worker"]))
