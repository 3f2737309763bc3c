"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A shard file holds a table of its ids by falling frequency, then a sequence of blocks. A block holds whole documents: a
fixed header, the documents' ids and lengths, control bytes (two bits for each id: its number of bytes less one, four
ids a byte) and the data bytes. What is coded is an id's rank in the table, so that a shard's most frequent 256 ids take
one byte. Blocks are decoded by numpy: a table gives the four lengths of each control byte. Every text is encoded once.

Tasks write under names of their own (a retried or speculative task writes another file) and report them; only files
that the written manifest names are part of the output, so lost executors leave no half-written data in it.

Defined cases: a null text has no ids but its end id; rows without doc_id come first; rows with the same doc_id are
ordered by a hash of the text; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, tidy
from .tokens import default_vocabulary, encoder

MAGIC = b"LOOMTOK1"
_TABLE = struct.Struct("<I")  # ids in the table
_HEAD = struct.Struct("<QQQ")  # documents, ids, data bytes
#: Ids of a block and of a shard, after which they are closed.
BLOCK_IDS, SHARD_IDS = 1 << 18, 12 << 20
#: Bytes of text for each range of documents that a task writes.
RANGE_BYTES = 24 << 20

#: For each control byte the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    lengths = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    q = padded.reshape(-1, 4)
    control = q[:, 0] | (q[:, 1] << 2) | (q[:, 2] << 4) | (q[:, 3] << 6)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    lengths = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], ids: list[bytes], rank_of: np.ndarray) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    control, data = encode_ranks(rank_of[flat])
    has = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    counts = np.array([len(x) // 4 for x in ids], "<u8")
    return b"".join((_HEAD.pack(len(ids), len(flat), len(data)), has.tobytes(), keys.tobytes(), counts.tobytes(), control, data))


def write_shard(f, doc_ids: list[int | None], ids: list[bytes]) -> int:
    """Write a whole shard to an open file; the number of its ids."""
    n_of = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
    found = np.flatnonzero(n_of)
    id_of = found[np.argsort(-n_of[found], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(n_of), np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    f.write(MAGIC + _TABLE.pack(len(id_of)) + id_of.tobytes())
    at = 0
    while at < len(ids):
        end, size = at, 0
        while end < len(ids) and (end == at or size < BLOCK_IDS):
            size += len(ids[end]) // 4
            end += 1
        f.write(encode_block(doc_ids[at:end], ids[at:end], rank_of))
        at = end
    return int(n_of.sum())


def read_shard(f) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each block of an open file: doc_ids, numbers of ids, and all ids."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    (size,) = _TABLE.unpack(f.read(_TABLE.size))
    id_of = np.frombuffer(f.read(4 * size), "<u4")
    while head := f.read(_HEAD.size):
        docs, n, size = _HEAD.unpack(head)
        has = np.frombuffer(f.read(docs), np.uint8)
        keys = np.frombuffer(f.read(8 * docs), "<i8")
        counts = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        control = np.frombuffer(f.read(-(-n // 4)), np.uint8)
        ids = id_of[decode_ranks(control, np.frombuffer(f.read(size), np.uint8), n)]
        yield [int(k) if h else None for h, k in zip(has, keys, strict=True)], counts, ids


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents (doc_id, text) in ascending doc_id order; the manifest: part, shard, file, n_docs, n_ids, start."""
    spark = documents.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    filesystem, root = open_fs(path)
    filesystem.create_dir(root, recursive=True)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        out_fs, out_root = open_fs(path)
        part, shard, n = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, n
            name = f"tokens-{part:06d}-{shard:04d}-{uuid.uuid4().hex}.bin"
            with out_fs.open_output_stream(f"{out_root}/{name}") as f:
                n_ids = write_shard(f, keys, held)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "shard", "file", "n_docs", "n_ids"])
            keys.clear(), held.clear()
            shard, n = shard + 1, 0
            return row

        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                ids = [x + end for x in enc.encode(texts[at : at + 256])]
                keys += doc_ids[at : at + 256]
                held += ids
                n += sum(map(len, ids)) // 4
                if n >= SHARD_IDS:
                    yield close()
        if held:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(max(1, -(-int(size) // RANGE_BYTES)), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    written = materialize(ordered.mapInArrow(tidy(run), "part int, shard int, file string, n_docs long, n_ids long"), "manifest")
    start, manifest = 0, []
    for r in sorted(map(tuple, written.collect())):  # one row per file
        manifest.append((*r, start))
        start += r[-1]
    return spark.createDataFrame(manifest, "part int, shard int, file string, n_docs long, n_ids long, start long")


def read_tokens(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    for keys, counts, ids in read_shard(f):
                        ends = np.cumsum(counts)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        columns = [pa.array(keys, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in parts], pa.list_(pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        start += int(counts.sum())

    files = manifest.select("file", "start")
    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def digest(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    path = new_path(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, path, vocabulary), path)
