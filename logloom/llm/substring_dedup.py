"""Substring dedup by line hashing, with content-chosen windows for repeats that don't start and end with lines.

Lines (paragraphs: what stands between line feeds) are the units. A unit is normalised (case, punctuation and white
space don't count) and hashed; digests are grouped over the whole corpus, the occurrence of the earliest rank (doc_id,
then place) is kept, and every other one is removed with its line feed, however short it is. ``least_words`` can spare
short units; its default of 1 spares none.

A passage that repeats inside lines that differ has no unit of its own. Therefore windows of ``WINDOW`` words are hashed as
well, at places that their words choose (see ``chosen_windows``), and grouped in the same way. Runs of at least ``run`` words
in such windows are removed. At most ``SPAN`` - 1 words at each end of a repeat lie in no chosen window: these (four) may
stay, and a repeat of ``run`` + 2 * (``SPAN`` - 1) words (33) or more always goes. The original offsets of all that is removed are retained.

Before the shuffle each task drops all but its first occurrence of a digest (the others are marked at once), so a line
that a third of all documents share reaches its group once per task, and a group that is still long is settled in parts.
Digests travel as packed arrays per bucket.

Defined cases: null and empty texts stay as they are; a line without any letter or digit is no unit and stays; rows of
the same doc_id and text (also without doc_id) are one document stored twice and get the same result, so where they are
the earliest each keeps its passages; documents without doc_id rank last, by a hash of their text; an occurrence inside the
same document counts as well, unless it is a window that overlaps the earliest; a document all of whose lines are repeats gets the empty
text; an empty table gives no rows; other columns pass through ``dedup``, and where one has the name of the column of spans, that column
gets a number after its name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INVERSE, _power, ALNUM, Words, chunks, free_name, mix, tidy

#: Words of a window, and windows in a row of which one is chosen; words that a run in windows has at least.
WINDOW, SPAN, RUN = 12, 5, 25
#: Bytes of text for each bucket of digests, and for each bucket of documents' marks.
BUCKET_BYTES, MARK_BYTES = 8 << 20, 32 << 20
#: Bytes of text whose digests a task gathers before it sends them.
SEND_BYTES = 4 << 20
#: Entries that a group's task holds before it settles them.
HELD_ENTRIES = 400_000
_NO_ID = np.iinfo(np.int64).max
#: A digest's occurrence: 96 bits of digest, document (id and hash of its text), code: twice the first word, one more for windows.
ENTRY = np.dtype([("a", "<u8"), ("doc", "<i8"), ("b", "<u4"), ("hash", "<u4"), ("word", "<u4")])
MARK = np.dtype([("doc", "<i8"), ("hash", "<u4"), ("word", "<u4")])
_SECOND = 0xD1B54A32D192ED03
_LINE = np.uint64(0x8CB92BA72F3D8DD7)


def lines_of(w: Words, least_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end word (in the chunk) of each line with ``least_words`` words."""
    n = len(w.starts)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    feeds = np.flatnonzero(w.raw == 10)  # a text ends with a line feed too
    line = np.searchsorted(feeds, w.starts)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    end = np.append(first[1:], n)
    long = end - first >= least_words
    first, end = first[long], end[long]
    return np.searchsorted(w.last, first, side="right"), first, end


def chosen_windows(w: Words, width: int = WINDOW, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of the windows of ``width`` words whose digest is the least of some ``span`` windows in a row.

    Only words decide, so two copies of a passage choose the same windows inside it, one in each ``span`` at least:
    of a repeat of n words all but ``span`` - 1 words at each end are in such windows. A text's last words start none
    (``span`` isn't greater than ``width``), so windows of other texts have no part in the choice.
    """
    n = len(w.starts)
    first = np.arange(max(0, n - width + 1))
    text = np.searchsorted(w.last, first, side="right")
    whole = first + width <= w.last[text]
    h = np.full(len(first) + 2 * (span - 1), np.iinfo(np.uint64).max)
    own = h[span - 1 : span - 1 + len(first)]
    own[whole] = digests(w, first[whole], first[whole] + width)[0]
    low = np.lib.stride_tricks.sliding_window_view(h, span).min(axis=1)
    chosen = whole & (np.lib.stride_tricks.sliding_window_view(low, span).max(axis=1) == own) if len(first) else whole
    return text[chosen], first[chosen]


def units(w: Words, least_words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and end word (in the chunk) and code of all lines and chosen windows; lines come first."""
    text, first, end = lines_of(w, least_words)
    text_2, first_2 = chosen_windows(w)
    code = np.concatenate([2 * (first - w.first[text]), 2 * (first_2 - w.first[text_2]) + 1])
    return np.concatenate([text, text_2]), np.concatenate([first, first_2]), np.concatenate([end, first_2 + WINDOW]), code


def digests(w: Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the words from ``starts`` to ``ends``."""
    out = []
    for salt in (0, _SECOND):
        h = mix(w.hash ^ np.uint64(salt))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power(0x9E3779B97F4A7C15, len(h)), out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(h) + 1)[starts] + (ends - starts).astype(np.uint64)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _ranked(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the entries whose digest may be there several times, by digest and rank, and of the earliest of each one's digest."""
    order = np.argsort(e["a"], kind="stable")
    a = e["a"][order]
    same = a[1:] == a[:-1]
    several = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(a) else order
    x = e[several]
    rank = np.lexsort((x["word"], x["hash"], x["doc"], x["b"], x["a"]))
    x, several = x[rank], several[rank]
    new = np.ones(len(x), bool)
    new[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
    return several, several[np.flatnonzero(new)[np.cumsum(new) - 1]]


def settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the entries to mark (not the earliest of their digest), and of those to keep for further comparison.

    Entries equal to the earliest (a row stored twice) are neither. Windows in the earliest one's document that overlap it
    stay unmarked: marks are joined by document and word, so they would take away the occurrence that has to stay.
    """
    order, first = _ranked(e)
    x, f = e[order], e[first]
    own = (x["doc"] == f["doc"]) & (x["hash"] == f["hash"])
    window = (x["word"] & 1).astype(bool)
    near = own & window & ((x["word"] >> 1).astype(np.int64) - (f["word"] >> 1) < WINDOW)
    equal = own & (x["word"] == f["word"])
    marked = order[~near & ~equal]
    return marked, np.delete(np.arange(len(e)), np.concatenate([marked, order[equal & (order != first)]]))


def _dealt(bucket: np.ndarray, rows: np.ndarray, marks: bool) -> pa.RecordBatch:
    """Rows (marks, bucket, packed): the ``rows`` packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order].astype(np.int32)
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    firsts = np.concatenate([[0], cuts]) if len(rows) else np.zeros(0, int)
    packed = [x.tobytes() for x in np.split(rows, cuts)] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(firsts), marks)), pa.array(bucket[firsts]), pa.array(packed, pa.binary())], names=["marks", "bucket", "packed"])


def _marks(e: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Marked entries, packed by bucket of their documents."""
    m = np.empty(len(e), MARK)
    for x in MARK.names:
        m[x] = e[x]
    m = np.unique(m)
    return _dealt(mix(m["doc"].astype(np.uint64) ^ (m["hash"].astype(np.uint64) << np.uint64(32))) % np.uint64(n_buckets), m, True)


_ROWS = "marks boolean, bucket int, packed binary"


def _local(n_buckets: int, n_marks: int, least_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            held.clear()
            marked, left = settle(e)
            yield _marks(e[marked], n_marks)
            e = e[left]
            yield _dealt(e["a"] % np.uint64(n_buckets), e, False)

        for batch, texts in chunks(batches, "text"):
            w = Words(texts, ALNUM, latin=True)
            text, first, end, code = units(w, least_words)
            e = np.zeros(len(text), ENTRY)
            e["a"], e["b"] = digests(w, first, end)
            e["a"] ^= np.where(code & 1, np.uint64(0), _LINE)
            ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            e["doc"], e["word"] = ids[text], code
            e["hash"] = batch.column(batch.schema.get_field_index("hash")).to_numpy(zero_copy_only=False)[text]
            held.append(e)
            size += sum(map(len, texts))
            if size >= SEND_BYTES:
                yield from send()
                size = 0
        if held:
            yield from send()

    return run


def _grouped(n_marks: int):
    """Of a bucket of entries their marks, by bucket of documents; the tasks' own marks pass through. What is settled on the
    way is only what some earlier occurrence stands for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = least = 0

        def out() -> pa.RecordBatch:
            nonlocal size, least
            e = np.concatenate(held)
            marked, left = settle(e)
            held[:] = [e[left]]
            size = least = len(left)
            return _marks(e[marked], n_marks)

        for b in batches:
            given = b.column(b.schema.get_field_index("marks"))
            yield b.filter(given)
            for x in b.filter(pc.invert(given)).column(b.schema.get_field_index("packed")).to_pylist():
                held.append(np.frombuffer(x, ENTRY))
                size += len(held[-1])
                if size >= least + HELD_ENTRIES:
                    yield out()
        if held:
            yield out()

    return run


def _per_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, hash, marks) of a bucket of documents: at most as many marks as the documents have units, also where a text
    is stored again and again without doc_id."""
    held, size, least = [np.zeros(0, MARK)], 0, 0
    for b in batches:
        for x in b.column(b.schema.get_field_index("packed")).to_pylist():
            held.append(np.frombuffer(x, MARK))
            size += len(held[-1])
            if size >= least + HELD_ENTRIES:
                held = [np.unique(np.concatenate(held))]
                size = least = len(held[0])
    m = np.unique(np.concatenate(held))
    cuts = np.flatnonzero((m["doc"][1:] != m["doc"][:-1]) | (m["hash"][1:] != m["hash"][:-1])) + 1
    firsts = np.concatenate([[0], cuts]) if len(m) else np.zeros(0, int)
    ends = np.append(firsts[1:], len(m))
    for at in range(0, len(firsts), 10_000):
        docs = m["doc"][firsts[at : at + 10_000]]
        packed = [m["word"][a:b].tobytes() for a, b in zip(firsts[at : at + 10_000], ends[at : at + 10_000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NO_ID), pa.array(m["hash"][firsts[at : at + 10_000]].astype(np.int64)), pa.array(packed, pa.binary())], names=["doc_id", "hash", "marks"])


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0xFFFFFFFF)


def marked(documents: DataFrame, least_words: int = 1) -> DataFrame:
    """(doc_id, hash, marks): of each document with marked units their codes, as packed numbers."""
    size = int(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n, n_marks = (max(1, -(-size // x)) for x in (BUCKET_BYTES, MARK_BYTES))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("hash")).where(F.col("text").isNotNull())
    local = rows.mapInArrow(tidy(_local(n, n_marks, least_words)), _ROWS).repartition(n, "bucket")
    found = local.mapInArrow(tidy(_grouped(n_marks)), _ROWS).repartition(n_marks, "bucket")
    return found.mapInArrow(tidy(_per_document), "doc_id long, hash long, marks binary")


def removed_spans(text: bytes, marks: bytes, least_words: int = 1, run: int = RUN) -> list[tuple[int, int]]:
    """Byte spans to remove, in order and apart: marked lines with their line feeds, and runs of words in marked windows and
    lines, up to the next word or line feed."""
    w = Words([text], ALNUM, latin=True)
    _, first, end, code = units(w, least_words)
    own = np.isin(code, np.frombuffer(marks, "<u4"))
    lines = own & (code & 1 == 0)
    feeds = np.concatenate([[-1], np.flatnonzero(w.raw == 10)])  # the last one is beyond the text
    at = np.searchsorted(feeds, w.starts[first[lines]])
    spans = [(int(s) + 1, min(int(e) + 1, len(text))) for s, e in zip(feeds[at - 1], feeds[at], strict=True)]
    change = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(change, first[own], 1)
    np.add.at(change, end[own], -1)
    inside = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts = np.append(w.starts, len(text))
    for s, e in zip(turns[0::2], turns[1::2], strict=True):
        if e - s >= run:
            feed = int(feeds[np.searchsorted(feeds, w.ends[e - 1])])
            spans.append((int(starts[s]), min(int(starts[e]), feed)))
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def dedup(documents: DataFrame, least_words: int = 1, run: int = RUN, removed: str = "removed") -> DataFrame:
    """All documents, with repeated lines and passages taken out of ``text`` (and ``n_chars``, if there, counted anew), and a
    column ``removed``: spans [from, to) in code points of the original text."""
    columns = documents.columns
    removed = free_name(removed, columns)
    own, own_id, own_hash = (free_name(f"{removed}_{x}", columns) for x in ("marks", "id", "hash"))
    marks = marked(documents, least_words).withColumnsRenamed({"doc_id": own_id, "hash": own_hash, "marks": own})
    joined = documents.join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col(f"`{own_id}`")) & (text_hash() == F.col(f"`{own_hash}`")), "left").select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{own}`"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{removed}` array<array<long>>"

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            all_marks = batch.column(batch.schema.get_field_index(own)).to_pylist()
            spans: list[list[list[int]]] = [[] for _ in all_marks]
            texts = out["text"].to_pylist()
            n_chars = out["n_chars"].to_pylist() if "n_chars" in out else None
            for i, m in enumerate(all_marks):
                if not m or not texts[i]:
                    continue
                raw, at, kept, chars = texts[i].encode(), 0, [], 0
                for s, e in removed_spans(raw, m, least_words, run):
                    before, gone = raw[at:s].decode(), len(raw[s:e].decode())
                    kept.append(before)
                    spans[i].append([chars + len(before), chars + len(before) + gone])
                    chars, at = spans[i][-1][1], e
                if spans[i]:
                    texts[i] = "".join([*kept, raw[at:].decode()])
                    if n_chars is not None:
                        n_chars[i] = len(texts[i])
            out["text"] = pa.array(texts, out["text"].type)
            if n_chars is not None:
                out["n_chars"] = pa.array(n_chars, out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*(out[c] for c in columns), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*columns, removed])

    return joined.mapInArrow(tidy(apply), schema)
