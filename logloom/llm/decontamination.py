"""Benchmark decontamination with an FM-index for each training shard.

Phrases are windows of ten consecutive words of an item (or all words of a shorter item). A task takes its documents
in shards. Words that no phrase holds can't be part of an occurrence, so a shard's text keeps the runs of phrase words
alone (at least as long as the shortest phrase), each run ended by a terminator. Over this text it builds the suffix
array by prefix doubling, the Burrows-Wheeler transform as a wavelet matrix, and samples of suffix positions. All
phrases are searched backward at once through the wavelet ranks; occurrences are located by walking to a sampled
position, and the spans of words are merged per document. Nothing is shuffled.

Phrases are sent as broadcast variables. A benchmark over ``block_bytes`` of text is dealt into blocks of about that
size, by a hash of its items, and the documents pass through one search for each block.

Defined cases: a null or empty text has no words and is clean; null items have no phrases; repeated items count once
by item_id, repeated documents are searched each; an empty benchmark leaves all documents clean; other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, merged, tidy

WIDTH = 10
#: Suffix positions that are multiples of this are sampled, and those where a run starts.
SAMPLE = 8
#: Bytes of documents in one shard.
SHARD_BYTES = 8 << 20
#: Text of the benchmark that is searched at once.
BLOCK_BYTES = 8 << 20

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or 48 <= x <= 57 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits and all characters beyond ASCII; A-Z as a-z."""
    return text.translate(_FOLD).split()


class Phrases:
    """Distinct phrases of a block of items: word numbers from 1, a matrix for each length, and the items of each phrase."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of((text or "").encode())]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + width]), set()).add(item_id)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(p) for p in found}):
            own = sorted(p for p in found if len(p) == n)
            self.by_length[n] = (np.array(own, np.int64).reshape(len(own), n), [sorted(found[p]) for p in own])
        self.shortest = min(self.by_length, default=0)


class FMIndex:
    """Of a text of numbers from 1, whose runs end with 0 each (as its last number does)."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.n = n = len(s)
        order = self.suffix_array(s)
        bwt = s[order - 1]  # the suffix at 0 is preceded by the last 0
        self.levels = max(1, int(sigma).bit_length())
        self.cums, self.zeros = [], []
        seq = bwt.astype(np.int32)
        for k in range(self.levels - 1, -1, -1):
            bits = (seq >> k) & 1
            cum = np.zeros(n + 1, np.int32)
            np.cumsum(bits, out=cum[1:])
            self.cums.append(cum)
            self.zeros.append(int(n - cum[-1]))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
        symbols = np.arange(sigma + 1)
        self.base = self._down(symbols, np.zeros(len(symbols), np.int64))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma + 1))])[: sigma + 1]
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = s[:-1] == 0
        sampled = (starts | (np.arange(n) % SAMPLE == 0))[order]
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    @staticmethod
    def suffix_array(s: np.ndarray) -> np.ndarray:
        """Prefix doubling; terminators differ from each other, by position, so no more rounds than the longest run needs."""
        n = len(s)
        ends = np.flatnonzero(s == 0)
        rank = s.astype(np.int64) + len(ends) - 1
        rank[ends] = np.arange(len(ends))
        k = 1
        while True:
            key = rank * np.int64(int(rank.max()) + 2)
            key[: n - k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank, k = new, 2 * k
            if rank[order[-1]] == n - 1 or k >= n:
                return order

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` lands when the bits of ``c`` are followed through the wavelet matrix."""
        for level, (cum, zeros) in enumerate(zip(self.cums, self.zeros, strict=True)):
            ones = cum[i]
            i = np.where((c >> (self.levels - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` among the first ``i`` of the transform."""
        return self._down(c, i) - self.base[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of ``phrases`` that occur: their numbers, and their ranges of suffixes."""
        active = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[active, j]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            some = lo < hi
            active, lo, hi = active[some], lo[some], hi[some]
        return active, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until a sampled one."""
        out = np.zeros(len(rows), np.int64)
        which, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(which):
            done = self.sampled[at]
            out[which[done]] = self.samples[self.sample_rank[at[done]]] + steps
            which, at = which[~done], at[~done]
            i, c = at, np.zeros(len(at), np.int64)
            for cum, zeros in zip(self.cums, self.zeros, strict=True):
                ones = cum[i]
                bit = cum[i + 1] - ones
                c = 2 * c + bit
                i = np.where(bit, zeros + ones, i - ones)
            at = self.before[c] + i - self.base[c]
            steps += 1
        return out


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[list[int], list[list[list[int]]], list[set[str]]]:
    """Of each text: number of words, merged spans of hit words [from, to), and the items with occurring phrases."""
    get = phrases.number.get
    numbers = [np.array([get(w, 0) for w in words_of(t)], np.int32) for t in texts]
    sizes = [len(x) for x in numbers]
    spans: list[list[list[int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not phrases.shortest:
        return sizes, spans, items
    # runs of phrase words
    flat = np.concatenate([np.append(x, np.int32(0)) for x in numbers]) if texts else np.zeros(0, np.int32)
    firsts = np.cumsum([0, *(n + 1 for n in sizes)])
    known = np.concatenate([[False], flat > 0])
    turns = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = turns[0::2], turns[1::2]
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return sizes, spans, items
    lengths = ends - starts + 1  # with the terminator
    at = np.cumsum(lengths) - lengths
    origin = np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))
    index = FMIndex(np.where(np.isin(origin, ends), 0, flat[origin]), len(phrases.number))
    hit = np.zeros(len(flat) + 1, np.int64)
    for n, (matrix, owners) in phrases.by_length.items():
        which, lo, hi = index.search(matrix)
        for a in range(0, len(which), 4096):
            counts = (hi - lo)[a : a + 4096]
            rows = np.repeat(lo[a : a + 4096] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            found = origin[index.locate(rows)]
            np.add.at(hit, found, 1)
            np.add.at(hit, found + n, -1)
            pairs = np.unique(np.stack([np.repeat(which[a : a + 4096], counts), np.searchsorted(firsts, found, side="right") - 1]), axis=1)
            for p, d in pairs.T.tolist():
                items[d].update(owners[p])
    inside = np.concatenate([[False], np.cumsum(hit)[:-1] > 0])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    for s, e in zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
        d = int(np.searchsorted(firsts, s, side="right")) - 1
        spans[d].append([s - int(firsts[d]), e - int(firsts[d])])
    return sizes, spans, items


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """The number of blocks of about ``block_bytes`` of text, and the items of each, fetched one block after the other."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    part = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return n, ([tuple(r) for r in part(k).collect()] for k in range(n))


_FOUND = "n_words long, spans array<array<long>>, items array<string>"
_TYPES = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))


def find(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", name: str = "found", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` (text among them only if named) and a struct column ``name``: n_words, spans, items."""
    spark = documents.sparkSession
    fields = documents.select(*(F.col(f"`{c}`") for c in keep)).schema
    carried = keep if text in keep else [*keep, text]
    out = documents.select(*(F.col(f"`{c}`") for c in carried))
    struct = f"struct<{_FOUND.replace('n_words long', 'n_words:bigint').replace('spans ', 'spans:').replace('items ', 'items:')}>"
    n, blocks = _blocks(benchmark, block_bytes)
    for k, block in enumerate(blocks):  # the driver holds one at a time
        shared = spark.sparkContext.broadcast(Phrases(block, width))
        last = k == n - 1
        columns = keep if last else carried

        def run(batches: Iterable[pa.RecordBatch], shared=shared, columns=columns, first=not k) -> Iterator[pa.RecordBatch]:
            for batch, texts in merged(batches, text, SHARD_BYTES):
                at = {c: i for i, c in enumerate(batch.schema.names)}
                sizes, spans, items = search_shard(texts, shared.value)
                if not first:
                    old = batch.column(at[name]).to_pylist()
                    spans = [merge_spans([*a, *o["spans"]]) for a, o in zip(spans, old, strict=True)]
                    items = [a | set(o["items"]) for a, o in zip(items, old, strict=True)]
                parts = [pa.array(x, t) for x, t in zip((sizes, spans, [sorted(x) for x in items]), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in columns), pa.StructArray.from_arrays(parts, names=["n_words", "spans", "items"])], names=[*columns, name])

        types = {f.name: f.dataType.simpleString() for f in fields} | {text: "string"}
        out = out.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"`{name}` {struct}"]))
    return out


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    f = F.col("found")
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return find(documents, benchmark, ["doc_id"]).select("doc_id", f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), f["spans"].alias("spans"))


def without_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the spans of words, and without what stands between a span's last word and the next word."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    padded = np.concatenate([[False], folded, [False]])
    starts = np.append(np.flatnonzero(padded[1:] & ~padded[:-1]), len(text))
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = int(starts[e])
    return b"".join(out) + text[at:]


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents with the hit spans removed from ``text``, and ``n_chars`` (if there) counted anew where text went."""
    name = free_name("found", documents.columns)
    marked = find(documents, benchmark, documents.columns, name=name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    columns = documents.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            found = batch.column(batch.schema.get_field_index(name)).to_pylist()
            hit = [i for i, x in enumerate(found) if x["spans"]]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            if hit:
                texts = out["text"].to_pylist()
                for i in hit:
                    texts[i] = without_spans(texts[i].encode(), found[i]["spans"]).decode()
                out["text"] = pa.array(texts, out["text"].type)
                if "n_chars" in out:
                    n = out["n_chars"].to_pylist()
                    for i in hit:
                        n[i] = len(texts[i])
                    out["n_chars"] = pa.array(n, out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    return marked.mapInArrow(tidy(run), schema)
