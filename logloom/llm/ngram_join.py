"""N-gram Jaccard join of a corpus with itself, by signature trees.

A document's set holds its distinct shingles of five words, as 64-bit hashes. Two documents link when the
intersection has at least three quarters of the union's size.

1. Documents with equal sets form a class (one key); one member stands for it.
2. Shingles are ordered by (frequent, hash). Linked sets share one of their first n/4 + 1 shingles in any common
   order. Since the order is random among shingles that aren't frequent, the first K shingles already miss a link with
   a chance below 2**-``certainty`` (K is 41 for 64 bits where no shingle is frequent, more where many are); the lesser
   of the two counts is sent, and with ``certainty=None`` always the exact one. Frequent shingles come last, so a passage that many documents share doesn't bring
   them together. The list of frequent shingles has a fixed greatest length; it only sets the order, so it can't cost a link.
   Sets that have their first common shingle at places i and j (from 0) share no more than the shingles from there on, so
   each entry tells the greatest size of a set that it can still link with; entries without such a partner are dropped.
3. The keys that share such a shingle are a list. First each key is compared with the key that is the least one of most
   of its lists; the links give first components. Lists inside one component have nothing more to tell. In two further
   rounds a few members of components that share lists are compared, so that a large group becomes one component early.
4. In every other list the keys' signatures (bitmaps of their shingles) are put in a tree ordered by size, whose nodes
   hold the bitmaps' union and the range of sizes. A traversal of the tree with itself drops pairs of nodes whose
   greatest possible overlap is too small, whose sizes differ too much, or that are one component. Long lists are cut into
   parts of about ``PART`` keys, by which all joins on a list are dealt, and go to the trees in blocks of parts, a pair of blocks to a task.
5. The remaining pairs are compared by their full sets, and the links' components are final.

Texts of a pair meet by key; a key with many partners is split over several tasks. Links and components stay in Spark.

Defined cases: texts without words have an empty set, link with nothing and are their own component; with fewer than
five words the whole sequence is the one shingle; repeated rows (also of one doc_id) are rows each; component_id is the
least non-null doc_id of the component (null if it has none); an empty table gives no rows; other columns are ignored
here and pass through ``keep_one``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, free_name, materialize, merged, mix, shingle_sets, tidy
from .components import connected_components

#: Shingles that are ordered last as frequent: at most so many, found so often at least.
FREQUENT, FREQUENT_AT = 200_000, 64
CERTAINTY = 64
#: Bytes of text that a task looks at together.
GROUP_BYTES = 8 << 20
#: Shingles of a bucket, keys of a part of a list, parts of a block, partners of a key in one task.
BUCKET, PART, BLOCK, PARTNERS = 250_000, 512, 4, 256
LEAF, FAN = 16, 4
#: Rounds of comparing members of components that share lists, and pairs of members for two components in each.
ROUNDS, TRIALS = 2, 4

_ENTRY = np.dtype([("h", "<u8"), ("key", "<i8"), ("n", "<u4"), ("most", "<u4")])


def set_key(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    return int(mix(np.array([np.sum(mix(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The join's condition on two sorted sets."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)) or not len(x):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def n_sent(n: int, frequent: int, certainty: int | None = CERTAINTY) -> int:
    """How many of a set's first shingles are sent, of which so many of the set are frequent."""
    exact = n // 4 + 1
    if certainty is None or 3 * (n - frequent) <= n:
        return exact
    miss = n / (3 * (n - frequent))  # a random shingle of the union that isn't frequent is in one set alone
    return min(exact, math.ceil(certainty * math.log(2) / -math.log(miss)))


def most_at(n: int, k: int) -> np.ndarray:
    """For the first ``k`` places of a set of ``n``: the size of the largest set that links with it if no shingle before is common."""
    return 7 * (n - np.arange(k)) // 3 - n


# --- 1: classes -------------------------------------------------------------------------------------------------------


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (frequent false, doc_id, hash, key, n) of documents, and (true, null, null, shingle, count) of shingles met in several sets of a group."""
    names = ["frequent", "doc_id", "hash", "key", "n"]
    for batch, texts in merged(batches, "text", GROUP_BYTES):
        keys, sizes = [], []
        own: dict[int, np.ndarray] = {}
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size < 1 << 20:
                size += len(texts[end])
                end += 1
            for s in shingle_sets(texts[at:end]):
                keys.append(set_key(s) if len(s) else 0)
                sizes.append(len(s))
                own.setdefault(keys[-1], s)
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), bool)), *(batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "hash")), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=names)
        h = np.sort(np.concatenate([*own.values(), np.zeros(0, np.uint64)]))
        firsts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        counts = np.diff(np.append(firsts, len(h)))
        some = counts > 1
        found, counts = h[firsts[some]].view(np.int64), counts[some]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), bool)), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(found), pa.array(counts.astype(np.int64))], names=names)


# --- 2, 3: lists of keys that share a shingle ------------------------------------------------------------------------------


def _send(n_buckets: int, frequent, certainty: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            held.clear()
            seen.clear()
            bucket = (e["h"] % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            firsts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[firsts]), pa.array([x.tobytes() for x in np.split(e, firsts[1:])], pa.binary())], names=["bucket", "packed"])

        for _, texts in chunks(batches, "text"):
            sets = shingle_sets(texts)
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(hot, flat), max(0, len(hot) - 1))
            is_hot = hot[at] == flat if len(hot) else np.zeros(len(flat), bool)
            end = 0
            for s in sets:
                n, end = len(s), end + len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                late = is_hot[end - n : end]
                n_late = int(np.count_nonzero(late))
                k = n_sent(n, n_late, certainty)
                first = s[:k] if not n_late else np.concatenate([s[~late], s[late]])[:k]
                e = np.empty(len(first), _ENTRY)
                e["h"], e["key"], e["n"], e["most"] = first, key, n, most_at(n, len(first))
                held.append(e)
                size += len(e)
            if size >= 300_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    return run


def _with_partners(e: np.ndarray) -> np.ndarray:
    """The entries (by shingle) that are with another one neither of which is too large for the other."""
    if not len(e):
        return e
    firsts = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
    counts = np.diff(np.append(firsts, len(e)))
    n, most = e["n"].astype(np.int64), e["most"].astype(np.int64)
    fits = np.repeat(counts > 1, counts)
    for own, limit in ((n, most), (-most, -n)):  # some other one's size within the limit, some other one's limit at least the size
        least = np.repeat(np.minimum.reduceat(own, firsts), counts)
        at_least = own == least
        alone = at_least & (np.repeat(np.add.reduceat(at_least, firsts, dtype=np.int64), counts) == 1)
        next_least = np.repeat(np.minimum.reduceat(np.where(at_least, np.iinfo(np.int64).max, own), firsts), counts)
        fits &= np.where(alone, next_least, least) <= limit
    return e[fits]


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, parts, part, key, n, most, center, weight): the distinct lists of a bucket's shingles, and how many shingles have each."""
    held = [np.frombuffer(x, _ENTRY) for b in batches for x in b.column(0).to_pylist()]
    if not held:
        return
    e = np.concatenate(held)
    held.clear()
    order = np.argsort(e["h"], kind="stable")
    h = e["h"][order]
    same = h[1:] == h[:-1]
    e = e[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    e = e[np.lexsort((e["key"], e["h"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["key"][1:] != e["key"][:-1])
    e = _with_partners(_with_partners(e[new]))
    if not len(e):
        return
    firsts = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
    counts = np.diff(np.append(firsts, len(e)))
    ends = np.concatenate([[np.uint64(0)], np.cumsum(mix(e["key"].copy().view(np.uint64)))])
    ids, of, weight = np.unique(mix(ends[firsts + counts] - ends[firsts] + counts.astype(np.uint64)), return_inverse=True, return_counts=True)
    which = np.repeat(of, counts)
    order = np.lexsort((e["key"], which))
    e, which = e[order], which[order]
    firsts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (e["key"][1:] != e["key"][:-1])]))
    most = np.maximum.reduceat(e["most"], firsts)  # the greatest limit of a key among the shingles with one list
    e, which = e[firsts], which[firsts]
    starts = np.searchsorted(which, np.arange(len(ids) + 1))
    parts = -(-np.diff(starts) // PART)
    for a in range(0, len(e), 100_000):
        own, w, keys = e[a : a + 100_000], which[a : a + 100_000], e["key"][a : a + 100_000].copy()
        part = mix(keys.view(np.uint64)) % parts[w].astype(np.uint64)
        columns = [ids.view(np.int64)[w], parts[w].astype(np.int32), part.astype(np.int32), keys, own["n"].astype(np.int64), most[a : a + 100_000].astype(np.int64), e["key"][starts[w]], weight[w].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["list", "parts", "part", "key", "n", "most", "center", "weight"])


# --- 4: signature trees ------------------------------------------------------------------------------------------------


def signature(s: np.ndarray) -> bytes:
    """A bitmap of a set: a power of two of bits, eight times its size at least (64 to 524288); bit hash mod width."""
    width = min(1 << 19, max(64, 1 << (8 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``width`` words."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


class Node:
    """Documents ``from`` to ``to`` of a tree: range of sizes, and their bitmaps' union at a width."""

    def __init__(self, tree: SignatureTree, first: int, last: int):
        self.tree, self.first, self.last = tree, first, last
        self.low, self.high = int(tree.n[first]), int(tree.n[last - 1])
        self.most = int(tree.most[first:last].max())
        own = tree.labels[first:last]
        self.label = own[0] if (own == own[0]).all() else None
        self.width = min(tree.bitmaps[i].shape[0] for i in (first, last - 1))
        self.children: list[Node] = []
        if last - first > LEAF:
            step = max(LEAF, -(-(last - first) // FAN))
            self.children = [Node(tree, a, min(a + step, last)) for a in range(first, last, step)]
        self._at: dict[int, tuple[np.ndarray, int]] = {}

    def at(self, width: int) -> tuple[np.ndarray, int]:
        """The union of the bitmaps at ``width`` words, and the most shingles of a set beyond its bits."""
        if width not in self._at:
            if self.children:
                parts = [c.at(width) for c in self.children]
                self._at[width] = np.bitwise_or.reduce([p[0] for p in parts]), max(p[1] for p in parts)
            else:
                rows = self.tree.rows(self.first, self.last, width)
                self._at[width] = np.bitwise_or.reduce(rows, axis=0), int((self.tree.n[self.first : self.last] - np.bitwise_count(rows).sum(axis=1)).max())
        return self._at[width]


class SignatureTree:
    """Sets ordered by size. ``pairs(other)`` gives the pairs of sets that may link and aren't one component yet; ``most`` bounds each one's partners."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, labels: np.ndarray, signatures: list[bytes], most: np.ndarray | None = None):
        order = np.lexsort((keys, n))
        self.keys, self.n, self.labels = keys[order], n[order], labels[order]
        self.most = most[order] if most is not None else 2 * self.n
        self.bitmaps = [np.frombuffer(signatures[i], "<u8") for i in order]
        self.root = Node(self, 0, len(keys))

    def rows(self, first: int, last: int, width: int) -> np.ndarray:
        return np.stack([fold(b, width) for b in self.bitmaps[first:last]])

    def pairs(self, other: SignatureTree) -> Iterator[tuple[int, int]]:
        todo = [(self.root, other.root)]
        while todo:
            a, b = todo.pop()
            if 4 * a.high < 3 * b.low or 4 * b.high < 3 * a.low or a.most < b.low or b.most < a.low or (a.label is not None and a.label == b.label):
                continue
            width = min(a.width, b.width)
            (union_a, more_a), (union_b, more_b) = a.at(width), b.at(width)
            most = min(a.high, b.high, int(np.bitwise_count(union_a & union_b).sum()) + min(more_a, more_b))
            if 7 * most < 3 * (a.low + b.low):
                continue
            if a is b and a.children:
                todo += itertools.combinations_with_replacement(a.children, 2)
            elif a.children and (not b.children or a.last - a.first >= b.last - b.first):
                todo += ((c, b) for c in a.children)
            elif b.children:
                todo += ((a, c) for c in b.children)
            else:
                yield from self._leaves(a, b, width)

    def _leaves(self, a: Node, b: Node, width: int) -> Iterator[tuple[int, int]]:
        s, t = a.tree, b.tree
        x, y = s.rows(a.first, a.last, width), t.rows(b.first, b.last, width)
        n, m = s.n[a.first : a.last][:, None], t.n[b.first : b.last][None, :]
        both = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2).astype(np.int64)
        only_x = np.bitwise_count(x).sum(axis=1).astype(np.int64)[:, None] - both
        only_y = np.bitwise_count(y).sum(axis=1).astype(np.int64)[None, :] - both
        most = np.minimum(n - only_x, m - only_y)
        may = (7 * most >= 3 * (n + m)) & (s.labels[a.first : a.last][:, None] != t.labels[b.first : b.last][None, :])
        may &= (m <= s.most[a.first : a.last][:, None]) & (n <= t.most[b.first : b.last][None, :])
        if a is b:
            may &= np.triu(np.ones_like(may), 1)
        for i, j in zip(*np.nonzero(may), strict=True):
            yield int(s.keys[a.first + i]), int(t.keys[b.first + j])


def _traversals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of keys of each group (list, x, y): blocks x and y of a list. Rows come ordered by group. A pair may come from several lists."""

    def grouped():
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            yield from zip(*(b.column(c).to_pylist() for c in ("list", "x", "y", "block", "key", "n", "label", "signature", "most")), strict=True)

    def tree(rows):
        return SignatureTree(np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64), [r[7] for r in rows], np.array([r[8] for r in rows], np.int64))

    pairs: set[tuple[int, int]] = set()

    def out():
        cols = list(zip(*pairs, strict=True))
        pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    for (_, x, y), rows in itertools.groupby(grouped(), key=lambda r: r[:3]):
        rows = list(rows)
        one = tree([r for r in rows if r[3] == x]) if any(r[3] == x for r in rows) else None
        two = one if x == y else tree([r for r in rows if r[3] == y]) if any(r[3] == y for r in rows) else None
        if one and two:
            for a, b in one.pairs(two):
                pairs.add((min(a, b), max(a, b)))
                if len(pairs) >= 100_000:
                    yield out()
    if pairs:
        yield out()


# --- 5: comparison by full sets ---------------------------------------------------------------------------------------------


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, key, text), each group's own row (key = a) first; the links."""
    center, center_key, links = None, None, []
    for b in batches:
        for s in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
            sets = shingle_sets([(x or "").encode() for x in s.column("text").to_pylist()])
            for a, key, own in zip(s.column("a").to_pylist(), s.column("key").to_pylist(), sets, strict=True):
                if key == a:
                    center, center_key = own, a
                elif center_key == a and linked(center, own):
                    links.append((a, key))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
            links = []


def _links(pairs: DataFrame, texts: DataFrame, n_parts: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) that link. ``texts`` has (key, text) of each key."""
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")).withColumnRenamed("a", "u")
    members = pairs.join(count, F.col("a") == F.col("u")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("key"))
    centers = count.select(F.col("u").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("key"))
    rows = members.unionByName(centers).join(texts.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("a", "part", "key", "text")
    ordered = rows.repartition(n_parts, "a", "part").sortWithinPartitions("a", "part", F.col("key") != F.col("a"))
    return ordered.mapInArrow(tidy(_compare), "a long, b long")


def _own_texts(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the documents of the ``keys`` (key, doc_id); rows of that doc_id with another text are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches, "text"):
            own = [set_key(s) if len(s) else 0 for s in shingle_sets(texts)]
            yield b.filter(pa.array([k == x for k, x in zip(b.column("key").to_pylist(), own, strict=True)])).select(["key", "text"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(keys.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")))
    return rows.select("key", "text").mapInArrow(run, "key long, text string")


def classes(documents: DataFrame, certainty: int | None = CERTAINTY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash of the text, key, n) of all rows, and (node, label) of the keys that link with others."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(rows.withColumn("hash", F.xxhash64("text")).mapInArrow(tidy(_classes), "frequent boolean, doc_id long, hash long, key long, n long"), "shingle-classes")
    docs = found.where(~F.col("frequent")).select("doc_id", "hash", "key", "n")
    often = found.where("frequent").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_AT).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    hot = np.sort(often.column("key").to_numpy().astype(np.int64).view(np.uint64))
    total = docs.agg(F.sum(F.expr("n div 4 + 1") if certainty is None else F.least(F.expr("n div 4 + 1"), F.lit(64)))).first()[0] or 0
    n_buckets = max(1, -(-int(total) // BUCKET))

    sent = rows.select("text").where(F.col("text").isNotNull()).mapInArrow(tidy(_send(n_buckets, spark.sparkContext.broadcast(hot), certainty)), "bucket int, packed binary")
    lists = materialize(sent.repartition(n_buckets, "bucket").select("packed").mapInArrow(tidy(_lists), "list long, parts int, part int, key long, n long, most long, center long, weight long"), "shingle-lists")

    reps = docs.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = lists.select("key").distinct()
    texts = materialize(_own_texts(documents, reps.join(wanted, "key", "left_semi")).dropDuplicates(["key"]), "compared-texts")

    stars = lists.where("key <> center").groupBy("key", "center").agg(F.sum("weight").alias("w")).groupBy("key").agg(F.max(F.struct("w", (-F.col("center")).alias("c"))).alias("best"))
    n_parts = max(1, n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = materialize(_links(stars.select((-F.col("best.c")).alias("a"), F.col("key").alias("b")), texts, n_parts), "first-links")
    labels = _merged(wanted.withColumn("label", F.col("key")), first)
    members = _open(lists.groupBy(*_MEMBER[:-1]).agg(F.max("most").alias("most")), labels)
    for trial in range(ROUNDS):
        if members.isEmpty():
            break
        labels = _merged(labels, materialize(_links(_trials(members, trial), texts, n_parts), "trial-links"))
        members = _open(members.drop("label"), labels)

    if not members.isEmpty():
        labels = _merged(labels, materialize(_links(materialize(_tree_pairs(members, texts, n_parts), "tree-pairs"), texts, n_parts), "tree-links"))
    joined = labels.where("key <> label")
    return docs, joined.unionByName(joined.select(F.col("label").alias("key"), "label").distinct()).withColumnRenamed("key", "node")


def _tree_pairs(members: DataFrame, texts: DataFrame, n_parts: int) -> DataFrame:
    """Pairs (a, b) of keys of different components that may link, from the trees of all lists."""

    def signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([signature(s) for s in shingle_sets(own)], pa.binary())], names=["key", "signature"])

    signed = texts.join(members.select("key").distinct(), "key", "left_semi").mapInArrow(tidy(signatures), "key long, signature binary")
    blocks = F.expr(f"(parts + {BLOCK - 1}) div {BLOCK}").cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = members.withColumn("block", F.expr(f"part div {BLOCK}").cast("int")).withColumn("other", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    dealt = dealt.join(signed, "key").select("list", "x", "y", "block", "key", "n", "label", "signature", "most")
    return dealt.repartition(n_parts, "list", "x", "y").sortWithinPartitions("list", "x", "y").mapInArrow(tidy(_traversals), "a long, b long").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(key, label) after the links (a, b) between keys have joined their components."""
    of = lambda c: labels.select(F.col("key").alias(f"k{c}"), F.col("label").alias(f"l{c}"))
    edges = links.join(of("a"), F.col("a") == F.col("ka")).join(of("b"), F.col("b") == F.col("kb")).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = connected_components(edges).withColumnRenamed("label", "root")
    return materialize(labels.join(found, F.col("label") == F.col("node"), "left").select("key", F.coalesce("root", "label").alias("label")), "labels")


_MEMBER = ("list", "parts", "part", "key", "n", "most")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the lists that hold several components, with their labels."""
    rows = members.join(labels, "key")
    ranges = rows.groupBy("list", "part").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    several = ranges.groupBy("list").agg(F.min("l0").alias("l0"), F.max("l1").alias("l1")).where("l0 <> l1").select("list")
    parts = ranges.select("list", "part").join(several, "list")
    return materialize(rows.join(parts, ["list", "part"], "left_semi").select(*_MEMBER, "label"), "open-lists")


def _trials(members: DataFrame, trial: int) -> DataFrame:
    """Pairs (a, b) to compare before the trees are: in each list a member of the largest component with one of each other
    component, and for any two components ``TRIALS`` of these pairs. Their links spare the trees most pairs of one group."""
    own = F.struct(F.xxhash64("key", "list", F.lit(trial)).alias("h"), "key", "n")
    reps = members.groupBy("list", "label").agg(F.min(own).alias("rep"), F.count("*").alias("size"), F.max("parts").alias("parts"))
    center = reps.groupBy("list").agg(F.max(F.struct("size", F.col("label").alias("l"), F.col("rep.key").alias("a"), F.col("rep.n").alias("m"))).alias("c"), F.max("parts").alias("parts"))
    dealt = center.select("list", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    near = reps.withColumn("salt", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int")).join(dealt, ["list", "salt"])
    met = near.where((F.col("label") != F.col("c.l")) & (F.col("rep.n") * 4 >= F.col("c.m") * 3) & (F.col("c.m") * 4 >= F.col("rep.n") * 3))
    pairs = met.select(F.col("c.l").alias("l"), "label", F.col("c.a").alias("a"), F.col("rep.key").alias("b")).distinct()
    order = Window.partitionBy("l", "label").orderBy(F.xxhash64("a", "b", F.lit(trial)))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRIALS).select("a", "b").distinct()


def _labelled(documents: DataFrame, certainty: int | None) -> DataFrame:
    """doc_id, hash of the text, n and label of the component of all rows; label null without words."""
    docs, label = classes(documents, certainty)
    found = docs.join(label, (F.col("key") == F.col("node")) & (F.col("n") > 0), "left")
    return materialize(found.select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("label")), "labelled")


def join_documents(documents: DataFrame, certainty: int | None = CERTAINTY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    labelled = _labelled(documents, certainty)
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").withColumnRenamed("label", "l")
    return labelled.join(least, F.col("label") == F.col("l"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("size") > 1, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, certainty: int | None = CERTAINTY) -> DataFrame:
    """One document of each component, with all columns: the one of the least doc_id (rows without one come last), then of the
    least hash of its text. Rows with the same doc_id and text are one document. Documents without words all stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("k")
    doc_id, text_hash = (free_name(f"kept_{x}", documents.columns) for x in ("id", "hash"))
    kept = _labelled(documents, certainty).where(F.col("label").isNotNull()).groupBy("label").agg(first).select(F.col("k.doc_id").alias(doc_id), F.col("k.hash").alias(f"{text_hash}_")).distinct()
    has_words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = documents.where(has_words).withColumn(text_hash, F.xxhash64("text"))
    one = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(F.col(doc_id)) & (F.col(text_hash) == F.col(f"{text_hash}_")), "left_semi").dropDuplicates(["doc_id", text_hash]).drop(text_hash)
    return one.unionByName(documents.where(~has_words))
