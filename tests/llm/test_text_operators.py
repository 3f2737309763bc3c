"""The operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from logloom.llm import decontamination, language_id, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_output
from logloom.llm import components as components_module
from logloom.llm.common import new_path
from logloom.llm.tokens import Encoder, default_vocabulary

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = [prose(rng, rng.randint(60, 200), vocab) for _ in range(12)]
    out = list(texts)
    for t in texts[:5]:
        w = t.split()
        for k in range(1, 5):
            v = list(w)
            for _ in range(k * 2):
                v[rng.randrange(len(v))] = "edited"
            out.append(" ".join(v))
        out += [t, t.upper()]
    out += [None, "", "   \n\t ", "one", "one", "One two three four", "a\x0bb c", "é è ñ 漢字 🙂 x y", "ends <|endoftext|> here<|endoftext|>", prose(rng, 9000, vocab)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def words_white(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingles(t):
    w = words_white(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(data):
    sets = {d: shingles(t) for d, t, *_ in data}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("certainty", [45, ngram_join.CERTAINTY, None])
def test_ngram_join(spark, docs, certainty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs, certainty).collect()}
    assert got == components(rows())


@pytest.mark.parametrize("rounds", [0, 2])
def test_ngram_join_with_blocks_and_frequent_shingles(spark, monkeypatch, rounds):
    """Short blocks, few partners in a task and an early list of frequent shingles change nothing."""
    rng = random.Random(5)
    shared = prose(rng, 40)
    base = [prose(rng, 60, [f"w{i}" for i in range(300)]) for _ in range(6)]
    data = []
    for i in range(90):
        w = base[i % 6].split()
        for _ in range(i // 6):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        data.append((i, shared + " " + " ".join(w), "en", "s", 0))
    monkeypatch.setattr(components_module, "SMALL", 0)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    for name, value in (("PART", 4), ("BLOCK", 2), ("PARTNERS", 3), ("FREQUENT_AT", 3), ("LEAF", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(spark.createDataFrame(data, DOCS)).collect()}
    assert got == components(data)


def test_ngram_join_odd_rows(spark):
    data = [(7, "a b c d e f", None, None, 0), (7, "a b c d e f", None, None, 0), (7, "other words are in this one", None, None, 0), (None, "a b c d e f", None, None, 0), (None, "nothing else has these words", None, None, 0), (9, None, None, None, 0)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.join_documents(spark.createDataFrame(data, DOCS)).collect())
    assert got == sorted([("7", 2, "7"), ("7", 2, "7"), ("7", 2, "7"), ("None", 2, "7"), ("None", 1, "None"), ("9", 0, "9")])
    assert ngram_join.join_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_keep_one(spark, docs):
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted({c for _, c in components(rows()).values()})
    assert ngram_join.keep_one(docs).columns == docs.columns
    twice = spark.createDataFrame([(1, "a b c d e", None, None, 0)] * 3 + [(None, "x", None, None, 0)], DOCS)
    assert ngram_join.keep_one(twice).count() == 2
    odd = [(1, "a b c d e f", "x"), (1, "other words stay here as well", "y"), (None, "a b c d e f", "z"), (None, "null ids too are copies", "v"), (None, "null ids too are copies", "w"), (4, "", None), (4, None, None), (None, " ", None)]
    got = ngram_join.keep_one(spark.createDataFrame(odd, "doc_id long, text string, kept_id string"))
    assert got.columns == ["doc_id", "text", "kept_id"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted([("1", "a b c d e f"), ("1", "other words stay here as well"), ("None", "null ids too are copies"), ("4", ""), ("4", "None"), ("None", " ")])


def test_signature_tree_misses_nothing():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        own = rng.integers(0, 1 << 63, int(rng.integers(5, 400)), dtype=np.uint64)
        sets += [np.unique(np.concatenate([own[int(k) :], rng.integers(0, 1 << 63, int(k), dtype=np.uint64)])) for k in rng.integers(0, max(1, len(own) // 4), 6)]
    n = np.array([len(s) for s in sets])
    tree = ngram_join.SignatureTree(np.arange(len(sets)), n, np.arange(len(sets)), [ngram_join.signature(s) for s in sets])
    found = {tuple(sorted(p)) for p in tree.pairs(tree)}
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if ngram_join.linked(sets[i], sets[j])}
    assert true and true <= found and len(found) < len(sets) * (len(sets) - 1) // 4


# --- quality rules --------------------------------------------------------------------------------------------------------


def measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)} if len(w) < 500 else None
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_quality_measures(docs):
    extra = ["a b c a b c d", "x x x x", "# $ [y]\nl1\nl1\n \nl1", "a b c d a b c d a b c", "p q r s p q r"]
    for t in [r[1] for r in rows()] + extra:
        want, got = measures(t), quality_rules.measure((t or "").encode())[:5]
        assert got[:4] == want[:4] and (want[4] is None or got[4] == want[4]), t


def test_quality_thresholds(spark):
    rng = random.Random(2)
    data = [(i, prose(rng, 80), "en", "s0" if i % 3 else None, 0) for i in range(240)]
    data += [(1000 + i, prose(rng, 80).replace(" ", "### "), "en", "s0", 0) for i in range(8)] + [(2000, "x y z " * 30, "en", "s0", 0), (2001, None, None, None, 0), (2002, prose(rng, 80), "xx", "rare", 0)]
    got = {r["doc_id"]: r for r in quality_rules.score_documents(spark.createDataFrame(data, DOCS)).collect()}
    assert all(got[i]["kept"] for i in range(240)) and got[2002]["kept"]
    assert not any(got[1000 + i]["kept"] or got[1000 + i]["base_failed"] for i in range(8))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and got[2001]["n_words"] == 0
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(data, DOCS).withColumnsRenamed({"n_chars": "n_words"}).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in ("verdict", "measures", "limit_lang", "with space")})
    out = quality_rules.filter_documents(frame)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == frame.columns and set(kept) == {i for i, r in got.items() if r["kept"]}
    assert all(r["verdict"] == f"verdict {i}" and r["with space"] == f"with space {i}" for i, r in kept.items())
    again = {r["doc_id"]: r["kept"] for r in quality_rules.score_documents(spark.createDataFrame([*data, data[3], data[3]], DOCS)).collect()}
    for i in (3, 1000, 2001):
        assert again[i] == got[i]["kept"]
    assert quality_rules.score_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_quality_fences_come_from_the_sketches(spark, sf):
    """Fences against deciles of the sorted values themselves, up to the sketches' error."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").collect()
    got = {(r["lang"], r["source"]): r for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.with_measures(spark.createDataFrame(docs), ["lang", "source"])), prior=0).collect()}
    values = {}
    for r in docs:
        n, chars, *_ = quality_rules.measure((r["text"] or "").encode())
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure((r["text"] or "").encode()), strict=True))
        if n >= 50 and 2 * m["n_repeat_words"] <= n:
            share = lambda c, of: max(0, int((c - 2 * c**0.5) * 10_000 / max(of, 1) // 1))
            own = (share(m["n_symbols"], n), share(m["n_dup_lines"], m["n_lines"]), share(m["n_repeat_words"], n), chars * 1000 // n)
            for name, x in zip(quality_rules.FEATURES, own, strict=True):
                values.setdefault((r["lang"], r["source"], name), []).append(x)
    assert len(values) > 100
    for (lang, source, name), x in values.items():
        x.sort()
        q5, q9 = (x[-(-len(x) * k // 10) - 1] for k in (5, 9))
        assert abs(got[lang, source][name] - (q9 + 8 * (q9 - q5))) <= 8 * (q9 + q5) / 64 + q9 / 64


def test_quality_bucket(spark):
    from pyspark.sql import functions as F

    for x, b in spark.range(0, 3_000).select("id", quality_rules.bucket(F.col("id"))).collect():
        assert b <= x and (x < 128 and b == x or x - b < x / 64 + 1)


# --- tokens, packing, binary output ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers") and default_vocabulary()


def test_encoder_equals_the_library(vocabulary):
    enc = Encoder(vocabulary)
    rng = random.Random(4)
    parts = ["a", "Bc", "é", " ", "\n", ".", ",", "'", "s", "12", "-", "\t", "🙂", "́", "!", "ll", "\x01", " ", "\x1c", "　", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [r[1] for r in rows()]
    assert enc.encode(texts) == enc._library([t or "" for t in texts])
    assert 50256 in np.frombuffer(enc.encode(["a <|endoftext|>"])[0], "<u4")


def ids_of(vocabulary, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(docs, vocabulary, length):
    want = ids_of(vocabulary, 1)
    pieces = packing.pack(docs, length).collect()
    seen, by_sequence = {d: [] for d in want}, {}
    for p in pieces:
        assert crc(want[p["doc_id"]][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] and p["doc_tokens"] == len(want[p["doc_id"]])
        seen[p["doc_id"]].append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for d, spans in seen.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == len(want[d])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, spans in by_sequence.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == length or k == len(by_sequence) - 1 and at < length
    full = packing.sequences(docs, length).collect()
    assert sum(len(r["ids"]) for r in full) >= sum(map(len, want.values())) and all(len(r["ids"]) == length or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in full)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
    assert packing.padded_length(64) == 64 and packing.padded_length(65) == 2048 and packing.padded_length(0) == 2048


def test_rank_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_output.encode_ranks(ranks)
        assert (token_output.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files(spark, docs, vocabulary, monkeypatch):
    monkeypatch.setattr(token_output, "RANGE_BYTES", 20_000)
    want = ids_of(vocabulary, 0)
    path = new_path(spark, "tokens")
    manifest = token_output.write_tokens(docs, path)
    got = {r["doc_id"]: r for r in token_output.read_tokens(manifest, path, with_ids=True).collect()}
    at = 0
    for d in sorted(want):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"], got[d]["ids"]) == (at, len(want[d]), crc(want[d]), want[d])
        at += len(want[d])
    assert manifest.count() > 1
    assert token_output.digest(spark.createDataFrame([], DOCS)).collect() == []
    odd = spark.createDataFrame([(None, "x"), (3, "y"), (3, "y"), (-5, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in sorted(token_output.digest(odd).collect(), key=lambda r: r["start"])] == [(None, 0), (-5, 2), (3, 3), (3, 5)]


# --- decontamination -------------------------------------------------------------------------------------------------------

ITEMS = "item_id long, text string"


def hits(data, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = {}
    for d, t, *_ in data:
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for p, own in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(11, 30))) for i in range(8)] + [(8, "Short phrase here"), (9, "beta"), (10, None), (11, ""), (12, "alpha beta " * 12)]
    data = []
    for i in range(40):
        t = prose(rng, rng.randint(0, 120), WORDS + ["filler", "noise"])
        if i % 3 == 0:
            t += "; " + items[i % 8][1].upper().replace(" ", ", ") + " short-phrase HERE"
        data.append((i, t, None, None, len(t)))
    return data + [(100, None, None, None, 0), (101, "", None, None, 0), (102, "alpha beta " * 300, None, None, 0)], items


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 100])
def test_decontamination(spark, leaked, block, monkeypatch):
    data, items = leaked
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    from pyspark.sql import functions as F

    found = decontamination.find(spark.createDataFrame(data, DOCS), spark.createDataFrame(items, ITEMS), ["doc_id"], block_bytes=block).select("doc_id", "found.*").collect()
    want = hits(data, items)
    for r in found:
        n_hit = sum(e - s for s, e in r["spans"])
        assert (r["n_words"], n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), n_hit > 0) == want[r["doc_id"]]
    if block > 1000:
        rep = decontamination.report(spark.createDataFrame(data, DOCS), spark.createDataFrame(items, ITEMS))
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rep.collect()} == want
        assert rep.where(F.col("n_hit") > 0).count() > 10


def test_clean_leaves_no_phrase(spark, leaked):
    data, items = leaked
    frame, bench = spark.createDataFrame(data, DOCS), spark.createDataFrame(items, ITEMS)
    before = {r["doc_id"]: r["contaminated"] for r in decontamination.report(frame, bench).collect()}
    out = decontamination.clean(frame, bench)
    assert out.columns == frame.columns
    clash = decontamination.clean(frame.withColumn("found", frame["doc_id"] * 2), bench)
    assert clash.columns[-1] == "found" and all(r["found"] == 2 * r["doc_id"] for r in clash.collect())
    texts = {r["doc_id"]: r for r in out.collect()}
    for d, t, *_ in data:
        assert before[d] or texts[d]["text"] == t
        assert not before[d] or texts[d]["n_chars"] == len(texts[d]["text"]) < len(t)
    assert decontamination.without_spans(b"One, two; three. four", [[1, 3]]) == b"One, four"
    none = spark.createDataFrame([], ITEMS)
    assert {r["text"] for r in decontamination.clean(frame, none).collect()} == {t for _, t, *_ in data}
    assert decontamination.report(spark.createDataFrame([], DOCS), bench).collect() == []


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s = rng.integers(0, 4, 300).astype(np.int32)
        s[-1] = 0
        index = decontamination.FMIndex(s, 3)
        for n in (1, 2, 3):
            patterns = np.array(list(itertools.product((1, 2, 3), repeat=n)), np.int64)
            which, lo, hi = index.search(patterns)
            got = {tuple(patterns[w]): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
            want = {}
            for i in range(len(s) - n + 1):
                if 0 not in s[i : i + n]:
                    want.setdefault(tuple(s[i : i + n].tolist()), []).append(i)
            assert {tuple(map(int, k)): v for k, v in got.items()} == want


# --- substring dedup --------------------------------------------------------------------------------------------------------


def passages(seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(3000)]

    def sentences(n):
        return " ".join(prose(rng, rng.randint(8, 16), vocab).capitalize() + "." for _ in range(n))

    passage = sentences(6)
    data = []
    for i in range(30):
        t = prose(rng, 7, vocab) + " " + sentences(rng.randint(2, 6))
        if i % 3 == 0:
            t = t + " " + prose(rng, 2, vocab) + " " + passage + " and more " + prose(rng, 6, vocab)
        data.append((i, t, None, None, len(t)))
    return data, passage


def test_substring_dedup_removes_later_passages(spark):
    data, passage = passages()
    frame = spark.createDataFrame([*data, (100, None, None, None, 0), (101, "", None, None, 0), (102, "a b", None, None, 3)], DOCS).repartition(4)
    out = {r["doc_id"]: r for r in substring_dedup.dedup(frame).collect()}
    for d, t, *_ in data:
        r = out[d]
        keep = "".join(c for k, c in enumerate(t) if not any(s <= k < e for s, e in r["removed"]))
        assert keep == r["text"] and r["n_chars"] == len(r["text"])
        if d == 0 or d % 3:
            assert r["text"] == t and r["removed"] == []
        else:
            ends = 2 * 10 * (substring_dedup.SPAN - 1)  # words of ten characters at most
            assert passage not in r["text"] and len(t) - len(r["text"]) >= len(passage) - ends
            assert t[: t.index(passage)] == r["text"][: t.index(passage)]
    assert out[100]["text"] is None and out[101]["text"] == ""


def test_substring_dedup_cases(spark):
    data, passage = passages(8)
    again = passage.upper().replace(".", " !")  # case and punctuation don't count
    rows_ = [(5, passage, "x"), (2, again, "y"), (None, passage, "z"), (7, "intro words here. " + passage + " " + passage, "w"), (5, passage, "x")]
    got = substring_dedup.dedup(spark.createDataFrame(rows_, "doc_id long, text string, removed_by string"))
    assert got.columns == ["doc_id", "text", "removed_by", "removed"]
    texts = sorted((str(r["doc_id"]), len(r["text"]) < 90) for r in got.collect())
    assert texts == [("2", False), ("5", True), ("5", True), ("7", True), ("None", True)]
    assert substring_dedup.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_rows_keep_the_earliest_occurrence(spark):
    (_, first), (_, second), (_, third) = (passages(seed) for seed in (21, 22, 23))
    data = [(5, first), (5, first), (None, second), (None, second), (9, "before it. " + first), (None, third + " " + third), (None, third + " " + third), (1, "ha " * 90)]
    for n in (1, 5):  # equal rows in one task and in several
        out = sorted((r["doc_id"] or 0, r["text"]) for r in substring_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(n)).collect())
        texts = [t for _, t in out]
        assert out.count((5, first)) == 2 and texts.count(second) == 2
        assert [len(t) < 60 for d, t in out if d == 9] == [True]
        assert [t.split() for d, t in out if d == 1] == [["ha"] * substring_dedup.WINDOW]
        assert sum(t.startswith(third[:-1]) and len(t) < len(third) + 100 for t in texts) == 2


def test_repeats_without_unit_bounds_are_removed(spark):
    rng = random.Random(12)
    data, places = [], {}
    for k in range(20):
        passage = prose(rng, 50, [f"w{i}" for i in range(3000)])
        for copy in (0, 1):
            before, after = (prose(rng, rng.randint(3, 30), [f"x{i}" for i in range(3000)]) for _ in range(2))
            places[2 * k + copy] = len(before) + 1, len(before) + 1 + len(passage)
            data.append((2 * k + copy, f"{before} {passage} {after}"))
    out = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    for d, t in data:
        spans, (s, e) = out[d]["removed"], places[d]
        if d % 2 == 0:
            assert out[d]["text"] == t and spans == []
        else:
            assert len(spans) == 1 and s <= spans[0][0] and spans[0][1] <= e + 1  # a span ends at the next word
            assert len(t[spans[0][0] : spans[0][1]].split()) >= 50 - 2 * (substring_dedup.SPAN - 1)


LINES = "doc_id long, text string, removed string, removed_marks int"


def line_corpus(seed):
    """Texts of short lines from a small pool, with copies, repeated rows, null ids, empty texts and odd line feeds."""
    rng = random.Random(seed)
    pool = [prose(rng, rng.randint(1, 6)) for _ in range(40)] + ["", "  ", "***", "Of."]
    case = [str, str.upper, lambda x: f" {x} !", lambda x: x.replace(" ", ",  ")]
    data = []
    for i in range(60):
        own = [rng.choice(case)(rng.choice(pool)) for _ in range(rng.randint(1, 2))] + [f"line of its own {i}"] * rng.randint(0, 1)
        rng.shuffle(own)
        data.append((None if rng.random() < 0.15 else rng.randint(0, 40), "\n".join(own) + "\n" * rng.randint(0, 2), f"r{i}", i))
    return data + [data[0], data[0], data[7], (None, data[3][1], "n", 0), (None, data[3][1], "m", 0), (50, None, "z", 0), (51, "", "z", 0), (-1, "Of.", "first", 0)]


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_against_brute_force(spark, seed):
    data = line_corpus(seed)
    frame = spark.createDataFrame(data, LINES)
    hashes = {r["text"]: r["h"] for r in frame.select("text", substring_dedup.text_hash().alias("h")).collect()}
    first = {}  # a line's words: rank of the earliest occurrence
    lines = {}
    for d, t, *_ in data:
        at = 0
        lines[d, t] = []
        for part in (t or "").split("\n"):
            words = tuple(re.findall(r"[a-z0-9]+", part.lower()))
            rank = (d is None, d or 0, hashes[t], at)
            lines[d, t].append((part, words, rank))
            if words:
                first[words] = min(first.get(words, rank), rank)
            at += len(words)
    want = []
    for d, t, name, x in data:
        kept, removed, at = "", [], 0
        for k, (part, words, rank) in enumerate(lines[d, t]):
            whole = part + ("\n" if k < len(lines[d, t]) - 1 else "")
            if words and first[words] != rank:
                if removed and removed[-1][1] == at:
                    removed[-1][1] = at + len(whole)
                else:
                    removed.append([at, at + len(whole)])
            else:
                kept += whole
            at += len(whole)
        want.append((str(d), t if t is None else kept, name, x, removed))
    for n in (1, 5):
        out = substring_dedup.dedup(frame.repartition(n))
        assert out.columns == ["doc_id", "text", "removed", "removed_marks", "removed_2"]
        got = [(str(r["doc_id"]), r["text"], r["removed"], r["removed_marks"], r["removed_2"]) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_passages_against_brute_force(spark, monkeypatch):
    """Windows: what is removed stands earlier; no repeat of RUN words stays but for its ends; settling in parts changes nothing."""
    rng = random.Random(31)
    vocab = [f"v{i}" for i in range(4000)]
    passages = [prose(rng, rng.randint(20, 90), vocab).split() for _ in range(12)]
    data = []
    for i in range(70):
        words = []
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            words += prose(rng, rng.randint(1, 30), [f"u{i}_{k}" for k in range(500)]).split() + p[a : a + rng.randint(10, 90)]
        data.append((i, " ".join(words)))
    data.append((70, "ha " * 500 + "end of it"))
    width, run, ends = substring_dedup.WINDOW, substring_dedup.RUN, substring_dedup.SPAN - 1
    earliest = {}
    for d, t in data:
        w = t.split()
        for k in range(len(w) - width + 1):
            earliest.setdefault(tuple(w[k : k + width]), (d, k))
    results = []
    for held in (substring_dedup.HELD_ENTRIES, 50):
        monkeypatch.setattr(substring_dedup, "HELD_ENTRIES", held)
        results.append({r["doc_id"]: r["removed"] for r in substring_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()})
    assert results[0] == results[1]
    for d, t in data:
        w, gone, at = t.split(), [], 0
        for x in w:
            gone.append(any(s <= at < e for s, e in results[0][d]))
            at += len(x) + 1
        # a window is repeated where its earliest occurrence is elsewhere (and, in the same text, doesn't overlap it)
        again = [(e := earliest[tuple(w[k : k + width])])[0] != d or k - e[1] >= width for k in range(len(w) - width + 1)]
        inside = [any(again[max(0, j - width + 1) : j + 1]) for j in range(len(w))]
        assert all(i for i, g in zip(inside, gone, strict=True) if g)
        for k in range(len(w) - run - 2 * ends + 1):
            if all(again[k : k + run + 2 * ends - width + 1]):
                assert all(gone[k + ends : k + run + ends])
    assert results[0][0] == [] and results[0][70]


def test_units_do_not_depend_on_other_texts():
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 11, 12, 13, 90])).encode() for _ in range(60)] + [b"a " * 40, b"", b"x", b"\n\nb c\n--\nd"]
    w = substring_dedup.Words(texts, substring_dedup.ALNUM, latin=True)
    text, _, _, code = substring_dedup.units(w)
    for i, t in enumerate(texts):
        assert sorted(code[text == i]) == sorted(substring_dedup.units(substring_dedup.Words([t], substring_dedup.ALNUM, latin=True))[3])


def test_earliest_occurrence_against_brute_force():
    rng = np.random.default_rng(4)
    e = np.zeros(500, substring_dedup.ENTRY)
    e["a"], e["b"], e["doc"], e["word"], e["hash"] = rng.integers(0, 40, 500), rng.integers(0, 2, 500), rng.integers(0, 50, 500), 2 * rng.integers(0, 9, 500), 1
    first = {}
    for x in e.tolist():
        key, rank = (x[0], x[2]), (x[1], x[3], x[4])
        first[key] = min(first.get(key, rank), rank)
    marked, left = substring_dedup.settle(e)
    assert len(left) == len(first) and not set(marked) & set(left)
    for i, x in enumerate(e.tolist()):
        assert (i in set(marked.tolist())) == ((x[1], x[3], x[4]) != first[x[0], x[2]])


# --- language, quality classifier ---------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(6)
    langs = {"en": "the and of with this that".split(), "de": "der und die mit das nicht".split(), "fr": "le la des avec que pour".split()}
    stems = {"en": "ing tion ness ly".split(), "de": "ung heit keit lich".split(), "fr": "eau eux ment aux".split()}
    data = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        words = [rng.choice(langs[lang]) if rng.random() < 0.4 else "".join(rng.choice("abcdegmnrs") for _ in range(3)) + rng.choice(stems[lang]) for _ in range(30)]
        data.append((i, " ".join(words), None if i % 17 == 0 else lang, None, 0))
    data += [(1000, None, "en", None, 0), (1001, "123 !?", "en", None, 0), (1002, "", "de", None, 0)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(data, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == ["en", "de", "fr"][i % 3] for i in range(240))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = spark.createDataFrame([(1, "words here", None, None, 0)], DOCS)
    assert language_id.identify(nothing).collect()[0]["lang_pred"] == "und"
    assert language_id.identify(spark.createDataFrame([], DOCS)).collect() == []


def test_all_languages_are_learned(spark):
    ids = {}
    for i in range(4000):
        ids.setdefault(zlib.crc32(str(i).encode()) % 3 == 1, []).append(i)
    langs = [f"l{i:03}" for i in range(430)]
    text = {x: " ".join(f"{w}{chr(97 + i // 26)}{chr(97 + i % 26)}" for w in ("on", "under", "with")) for i, x in enumerate(langs)}
    data = [(ids[False][2 * i + k], text[x], x) for i, x in enumerate(langs) for k in (0, 1)] + [(ids[True][i], text[x], x) for i, x in enumerate(langs)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[d] == x for d, _, x in data)


@pytest.mark.parametrize("dense", [16, 0])
def test_language_scores_against_brute_force(spark, sf, monkeypatch, dense):
    monkeypatch.setattr(language_id, "DENSE_LANGS", dense)
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    learned = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None]
    langs = sorted({r["lang"] for r in learned})
    counts = {k: {lang: {} for lang in langs} for k in range(6)}  # 0: words
    pieces = lambda w, k: [w] if not k else list(w) if k == 1 else [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
    for r in learned:
        for w in re.findall(r"[^\W\d_]+", r["text"].lower()):
            for k in range(6):
                for x in pieces(w, k):
                    counts[k][r["lang"]][x] = counts[k][r["lang"]].get(x, 0) + 1
    known = {k: set().union(*counts[k].values()) for k in counts}
    total = {k: {lang: sum(c.values()) for lang, c in counts[k].items()} for k in counts}
    log = lambda k, x, lang: np.log(counts[k][lang].get(x, 0) + 0.5) - np.log((total[k][lang] or 1) + 0.5 * max(1, len(known[k])))
    rows = {}
    for r in docs:
        for w in re.findall(r"[^\W\d_]+", r["text"].lower()):
            if w not in rows:
                k = next((k for k in (0, 5, 4, 3, 2, 1) if any(x in known[k] for x in pieces(w, k))), None)
                found = [] if k is None else [x for x in pieces(w, k) if x in known[k]]
                rows[w] = np.array([np.mean([log(k, x, lang) for x in found]) * ((k + 1) / 6 if k else 1) if found else 0.0 for lang in langs])
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame([(*r[:2], r["lang"], r["source"], 0) for r in docs], DOCS)).collect()}
    for r in docs:
        words = re.findall(r"[^\W\d_]+", r["text"].lower())
        if words:
            mean = sum(rows[w] for w in words) / len(words) * min(len(words), 20)
            p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
            assert abs(got[r["doc_id"]]["score"] - p.max()) < 1e-3 and (got[r["doc_id"]]["lang_pred"] == langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)
    assert len(rows) > 1000


def test_sparse_language_model_scores_as_the_dense_one(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dense = language_id.Predictor(language_id.fit(docs.where("doc_id % 2 = 0")))
    monkeypatch.setattr(language_id, "DENSE_LANGS", 0)
    sparse = language_id.SparsePredictor(language_id.fit(docs.where("doc_id % 2 = 0")))
    for r in docs.collect():
        a, b = dense.predict(r["text"]), sparse.predict(r["text"])
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3


def test_language_backoff_uses_shorter_grams():
    logs = {k: ([], np.zeros((0, 2), np.float32)) for k in (0, *language_id.GRAM_LENGTHS)}
    logs[0] = (["known"], np.array([[-1.0, -5.0]], np.float32))
    logs[2] = (["zz"], np.array([[-6.0, -1.0]], np.float32))
    p = language_id.Predictor({"langs": ["a", "b"], "logs": logs})
    assert p.predict("known")[0] == "a" and p.predict("qzzq")[0] == "b" and p.predict("known qqq")[0] == "a"


def test_language_model_of_more_words_than_the_limit():
    rng = np.random.default_rng(3)
    names = sorted(f"known{a}{b}" for a in WORDS for b in WORDS)
    logs = {k: ([], np.zeros((0, 2), np.float32)) for k in language_id.GRAM_LENGTHS} | {0: (names, rng.normal(size=(len(names), 2)).astype(np.float32))}
    logs[1] = (list("abcdef"), rng.normal(size=(6, 2)).astype(np.float32))
    model = {"langs": ["a", "b"], "logs": logs}
    small, large = language_id.Predictor(model, limit=20), language_id.Predictor(model)
    found = []
    small.unseen = lambda w: found.append(w) or language_id.Predictor.unseen(small, w)
    few = [f"{names[i]} {'abcdef'[i % 6]}x {names[-i]}" for i in range(300)]
    assert [small.predict(t) for t in few] == [large.predict(t) for t in few] and len(found) == 6
    many = [f"{names[i]} {'abcdef'[i % 6]}{chr(97 + i // 26)}{chr(97 + i % 26)} {names[-i]}" for i in range(300)]
    assert [small.predict(t) for t in many + few] == [large.predict(t) for t in many + few]
    assert small.used <= len(names) + 22 and len(small.index) == small.used and large.used == len(names) + 306


def test_quality_classifier_on_held_out_texts(spark, sf):
    docs, labels = (spark.read.parquet(sf.replace("0.001", "0.1") + f"/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    good = [r["selected"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    low = [r["selected"] for r in held if r["quality"] == 0]
    toxic = [r["selected"] for r in held if r["toxic"] == 1]
    assert np.mean(good) > 0.95 and np.mean(low) < 0.1 and np.mean(toxic) < 0.1
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)


def test_quality_classifier_cases(spark):
    docs = spark.createDataFrame([(1, "good text"), (2, None), (None, "x"), (1, "good text")], "doc_id long, text string")
    out = quality_classifier.classify(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert [r["tail"] for r in out.collect()] == [0.5] * 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_classifier.classify(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    data, ranks = [], []
    for i in range(200):
        r = i % 3
        data.append((np.unique(rng.integers(0, 50, 5) + 100 * r), np.zeros(quality_classifier.DENSE)))
        ranks.append(r)
    m = quality_classifier.Ordinal([0, 1, 2]).fit(data, np.array(ranks))
    assert m.thresholds[0] < m.thresholds[1]
    guess = [int((m.tails(m.score(*x)) > 0.5).sum()) for x in data]
    assert np.mean(np.array(guess) == np.array(ranks)) > 0.95
