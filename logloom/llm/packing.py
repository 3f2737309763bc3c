"""Packing by concatenating and cutting: two passes of prefix sums give each document its place in one stream of ids.

Pass one encodes every document once and writes its ids with its place inside its partition. The partitions' totals
(one row each) are summed up in order. Pass two adds a partition's base to its documents' places and cuts them at the
multiples of the sequence length: a document's pieces are the boundary records. Texts are not shuffled, and only the
last sequence can be shorter than ``length`` (padding would be added there alone, and none at a power of two).

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no pieces.
The order of documents in the stream is that of the written partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .tokens import default_vocabulary, encoder

LENGTH = 2048
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(documents: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Pass one, written to the shared folder: part, place (ids before it in its partition), doc_id, n, ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                ids = [x + end for x in enc.encode(s.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(places), s.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], names=["part", "place", "doc_id", "n", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(tidy(run), "part int, place long, doc_id long, n long, ids binary"), "packed-ids")


def bases(ids: DataFrame) -> dict[int, int]:
    """Partition -> ids before it. The driver gets one row for each partition."""
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).collect()
    out, at = {}, 0
    for part, n in sorted(map(tuple, totals)):
        out[part] = at
        at += n
    return out


def cut(ids: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pass two: the pieces."""
    base = ids.sparkSession.sparkContext.broadcast(bases(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b0 = base.value
        for b in batches:
            rows: list[tuple] = []
            for part, place, doc_id, raw in zip(*(b.column(x).to_pylist() for x in ("part", "place", "doc_id", "ids")), strict=True):
                at, n, view = b0[part] + place, len(raw) // 4, memoryview(raw)
                done = 0
                while done < n:
                    size = min(n - done, length - (at + done) % length)
                    piece = view[4 * done : 4 * (done + size)]
                    rows.append((doc_id, done, size, zlib.crc32(piece), n, (at + done) // length, (at + done) % length, *([bytes(piece)] * with_ids)))
                    done += size
            columns = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.binary()) for i, c in enumerate(columns)], names=[x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids)

    return ids.select("part", "place", "doc_id", "ids").mapInArrow(tidy(run), _PIECES + ", ids binary" * with_ids)


def pack(documents: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return cut(encoded(documents, vocabulary or default_vocabulary()), length)


def padded_length(used: int, length: int = LENGTH) -> int:
    """What a sequence with ``used`` ids is padded to: ``length``, except at a power of two."""
    return used if used and used & (used - 1) == 0 else length


def sequences(documents: DataFrame, length: int = LENGTH, vocabulary: str | None = None, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (padded), doc_ids and offsets of their pieces. A group has ``length`` pieces at most."""
    pieces = cut(encoded(documents, vocabulary or default_vocabulary()), length, with_ids=True)
    groups = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column("p").to_pylist():
                ids = np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int64)
                full = np.full(padded_length(len(ids), length), pad_id, np.int64)
                full[: len(ids)] = ids
                out.append((full, [x["doc_id"] for x in p], [x["offset"] for x in p]))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], names=["sequence_id", "ids", "doc_ids", "offsets"])

    return groups.mapInArrow(run, "sequence_id long, ids array<long>, doc_ids array<long>, offsets array<long>")
