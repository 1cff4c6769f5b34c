"""Token ids in fixed-width bit-packed files with random access.

A file holds, little-endian throughout:

    magic `MLTOKEN1`
    packed blocks, each of `block_ids` ids (the last may be shorter) in
    `width` bits per id, least significant bit first, padded to a whole byte
    doc_id of each document, int64
    ids before each document in this file and the total, uint64
    byte offset of each block and the end of the last, uint64
    trailer: documents, blocks, block_ids, width as uint64, then the magic again

A null doc_id is stored as the smallest int64.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.llm.frames import pick
from meterline.llm.tokens import encoder
from meterline.session import cut_lineage, new_path

MAGIC = b"MLTOKEN1"
BLOCK_IDS = 65_536
#: Ids that a task reads back at least, where the files are smaller.
TASK_IDS = 1 << 20
NULL_ID = -(2**63)


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(packed: bytes, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: count * width]
    return bits.reshape(count, width) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def id_width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


class ShardWriter:
    """Appends documents block by block; only the tables at the end wait in memory."""

    def __init__(self, out, width: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.doc_ids: list[int] = []
        self.ends = [0]
        self.offsets = [len(MAGIC)]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.ends.append(self.ends[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self._write(final=False)

    def _write(self, final: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        full = len(ids) if final else len(ids) // self.block_ids * self.block_ids
        for at in range(0, full, self.block_ids):
            packed = pack_ids(ids[at : min(full, at + self.block_ids)], self.width)
            self.out.write(packed)
            self.offsets.append(self.offsets[-1] + len(packed))
        self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._write(final=True)
        self.out.write(np.array(self.doc_ids, "<i8").tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        trailer = [len(self.doc_ids), len(self.offsets) - 1, self.block_ids, self.width]
        self.out.write(np.array(trailer, "<u8").tobytes() + MAGIC)


class ShardReader:
    """Reads any run of ids from an open file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(40, size - 40)
        if tail[32:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_blocks, self.block_ids, self.width = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        tables = 8 * (2 * self.n_docs + 1 + self.n_blocks + 1)
        raw = source.read_at(tables, size - 40 - tables)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs)
        self.ends = np.frombuffer(raw, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", self.n_blocks + 1, 8 * (2 * self.n_docs + 1)).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        first, last = self.offsets[k], self.offsets[k + 1]
        count = min(self.block_ids, int(self.ends[-1]) - k * self.block_ids)
        return unpack_ids(self.source.read_at(int(last - first), int(first)), count, self.width)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids `start` to `stop` of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        run = np.concatenate([self.block(k) for k in range(first, (stop - 1) // self.block_ids + 1)])
        return run[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids before it in the file, and its ids, with one block in memory at a time for short documents."""
        held, block = -1, np.zeros(0, np.uint32)
        for k in range(self.n_docs):
            start, stop = int(self.ends[k]), int(self.ends[k + 1])
            at = start // self.block_ids
            if stop > start and stop <= (at + 1) * self.block_ids:
                if at != held:
                    held, block = at, self.block(at)
                ids = block[start - at * self.block_ids : stop - at * self.block_ids]
            else:
                ids = self.ids(start, stop)
            doc_id = int(self.doc_ids[k])
            yield None if doc_id == NULL_ID else doc_id, start, ids


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", spaced: bool = True, end_id: int = 0
) -> DataFrame:
    """Write the ids of every text to files in ascending doc_id order and return the manifest.

    Documents are range-partitioned by id, so one task writes one file and the
    files follow each other in id order; rows of equal id are ordered by text. A
    task writes under a name of its attempt and renames the file when it is
    whole, so a retried task leaves the same file. The manifest has one row per
    file: shard, path, n_docs, n_ids; it is written as one file, since Hadoop's
    local file system starts a process for each file it makes and at that moment
    the executor's memory counts twice. `folder` must be shared by all executors.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, spaced)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        unfinished, path = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{shard:06d}.tok"
        with files.open_output_stream(unfinished) as out:
            writer = ShardWriter(out, id_width(coder.vocabulary))
            for batch in batches:
                ids = coder.encode(batch.column("text").to_pylist())
                for doc_id, packed in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    writer.add(doc_id, np.concatenate([np.frombuffer(packed, coder.dtype).astype(np.uint32), end]))
            writer.close()
        files.move(unfinished, path)
        row = {"shard": [shard], "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.ends[-1]]}
        yield pa.RecordBatch.from_pydict(row)

    narrow = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    placed = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = "shard long, path string, n_docs long, n_ids long"
    return cut_lineage(placed.mapInArrow(write, schema).repartition(1))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files of `manifest`.

    One task reads one file, block by block, or several that hold less than
    `TASK_IDS` ids. The running start of the files is a window over one row per
    file.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with files.open_input_file(path) as source:
                    rows = [
                        (doc_id, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for doc_id, start, ids in ShardReader(source).documents()
                    ]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                names = ("doc_id", "start", "n_tokens", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    full = manifest.filter("n_docs > 0")
    files, ids = full.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    first = full.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = first.select("shard", "path", "first").repartition(max(1, min(files, -(-ids // TASK_IDS))))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(spark: SparkSession, docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write all documents to token files in the shared folder and report what the files hold.

    A null text counts as empty and still gets its end id; repeated rows are
    written as often as they occur; an empty table gives no rows.
    """
    folder = new_path(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
