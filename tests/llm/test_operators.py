"""Operators of the subpackage against brute force on small tables, with nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, langid, lines, near, packing, pii, quality, simhash, substring, topk
from sparkloom.llm.common import connected_components
from sparkloom.llm.queries import oracle_sql, queries, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """Prose of a small vocabulary with copies, near copies, shared passages and edge cases."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    passage, out = prose(60), []
    for i in range(60):
        text = prose(rng.randint(5, 120))
        out.append(text if i % 5 else text + "\n" + passage + "\n" + prose(8))
    out += [out[3], out[3], out[7].upper(), out[10][:-5] + "zzz", passage, passage + " " + passage, "la " * 70, prose(6000)]
    out += [None, "", " \t\n", "x", "one two", "a b c", "<|endoftext|> it's  12 ", "\x1c\x85　 日本 🙂 'll", "w" * 3000, "\n\n\n"]
    table = [(i * 3 % 101, t) for i, t in enumerate(out)]
    return [*table, table[4]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("odd") for c in ("key", "n_words", "label", "component_id", "starts", "base", "node", "lang")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (100, 101), (200, 200)]
    got = defaultdict(set)
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["component"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(61)), [100, 101, 102]]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, width=3):
    w = [x.encode() for x in words(lower(text))]
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex()).collect()
    assert len(got) == len(rows)
    prints = {d: fingerprint(t) for d, t in rows}
    groups = groups_of(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {(r["doc_id"], r["hex"], r["component_id"]) for r in got} == {(d, f"{prints[d]:016x}", groups[d]) for d in prints}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_crowded_drawers(spark):
    """Many fingerprints of few bits: every level of the plan is used, and no link is lost."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 160:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(40)}
    table = [(i, simhash._signed(p)) for i, p in enumerate(sorted(prints))]
    edges = simhash.links(spark.createDataFrame(table, "node long, f0 long"), simhash.exact_plan(), crowd=4)
    got = defaultdict(set)
    for r in connected_components(edges).collect():
        got[r["component"]].add(r["node"])
    value = {i: p for i, p in enumerate(sorted(prints))}
    want = defaultdict(set)
    for i, g in groups_of(list(value), lambda a, b: (value[a] ^ value[b]).bit_count() <= 3).items():
        want[g].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def varied(rng, w, least, word):
    """A copy of the words whose set of five-word shingles is just at or above a similarity, and how similar it is."""
    shingles = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    own, v, j = shingles(w), list(w), 1.0
    for at in rng.sample(range(len(w)), len(w)):
        u = list(v)
        u[at] = word()
        now = len(own & shingles(u)) / len(own | shingles(u))
        if now >= least:
            v, j = u, now
            if j < least + 0.01:
                break
    return v, j


@pytest.mark.parametrize("together", [near.TOGETHER, 300])
def test_near_copies_are_found_and_others_are_not(spark, together):
    """All pairs at 0.8 are found, none below, in drawers of few and in a group of many, compared whole or in blocks."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    table, at, low = [], [], 0
    for i in range(120):
        w = [word() for _ in range(rng.choice([40, 120, 400]))]
        v, j = varied(rng, w, 0.8, word)
        u, below = varied(rng, w, 0.7, word)
        low += below < 0.8
        table += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(v)), (3 * i + 2, " ".join(u))]
        at.append(j)
    base = [word() for _ in range(100)]
    table += [(1000 + i, " ".join(varied(rng, base, 0.85, word)[0])) for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in table}
    want = groups_of([i for i, _ in table], lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    got = {r["doc_id"]: r["component_id"] for r in near.similar_groups(df, together=together).collect()}
    assert sum(j < 0.83 for j in at) > 60 and low > 60
    assert got == want


def majority(s):
    return sum((2 * sum(int(h) >> b & 1 for h in s) > len(s)) << b for b in range(64))


def test_near_fingerprints():
    """Against counting bit by bit, over chunks and empty sets."""
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 0, 2, 3, 2 * near.CHUNK + 5, 40, 0)]
    assert [int(f) for f in near.fingerprints(sets)] == [majority(s) for s in sets]
    assert len(near.fingerprints([])) == 0


def alone(sets):
    """Drawers of least hashes that no two sets share."""
    return np.array([[xxhash.xxh64_intdigest(s.tobytes(), k) for k in range(near.DRAWERS)] for s in sets], np.uint64).reshape(-1, near.DRAWERS)


def test_near_copies_meet_in_pigeonhole_blocks(spark, monkeypatch):
    """SimHash and its blocks find every link of 3 bits or fewer by themselves, with no drawer of least hashes shared."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    table = []
    for i in range(30):
        w = [word() for _ in range(rng.choice([200, 500, 800]))]
        table += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([word(), *w[1:-1], word()])), (3 * i + 2, " ".join([word(), *w, word()]))]
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in table}
    prints = {i: majority(near.shingle_set(t.encode(), 5)) for i, t in table}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    want = groups_of([i for i, _ in table], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 and alike(a, b))
    monkeypatch.setattr(near, "drawers", alone)
    got = {r["doc_id"]: r["component_id"] for r in near.similar_groups(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert sum(i != g for i, g in want.items()) > 40 and len(set(prints.values())) > 60
    assert got == want


@pytest.mark.parametrize("together", [near.TOGETHER, 300])
def test_fingerprints_alone_link_nothing(spark, monkeypatch, together):
    """One fingerprint for all: what links is still what the sets' similarity says."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    table = [(0, "one two"), (1, ""), (2, None)]
    for i in range(1, 13):
        w = [word() for _ in range(60)]
        table += [(10 * i, " ".join(w))] + [(10 * i + k, " ".join(varied(rng, w, 0.8 if k < 4 else 0.7, word)[0])) for k in range(1, 6)]
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for i, t in table}
    want = groups_of([i for i, _ in table], lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    monkeypatch.setattr(near, "drawers", alone)
    monkeypatch.setattr(near, "fingerprints", lambda sets: np.zeros(len(sets), np.uint64))
    got = {r["doc_id"]: r["component_id"] for r in near.similar_groups(spark.createDataFrame(table, "doc_id long, text string"), together=together).collect()}
    assert got == want


def test_near_forest():
    rng = np.random.default_rng(4)
    sets = [np.flatnonzero(rng.random(40) < 0.9) for _ in range(40)] + [np.zeros(0, np.int64)] * 2
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b])))
    for parts in (list(range(42)), [i // 2 for i in range(42)]):
        out: list = []
        near.forest(list(range(42)), parts, sets, 0.9, out)
        assert all(jaccard(a, b) >= 0.9 for a, b in out)
        want = groups_of(list(range(42)), lambda a, b: jaccard(a, b) >= 0.9 or parts[a] == parts[b])  # noqa: B023
        assert len(out) == len(set(parts)) - len(set(want.values())) > 0


def test_one_of_each_row(spark, empty):
    t, own = "alpha beta gamma delta epsilon zeta", "unique text of five words here"
    table = [(3, t, 1), (5, own, 2), (5, t, 3), (7, "seven same row of words", 4), (7, "seven same row of words", 4), (None, t, 5), (None, own.upper(), 6), (8, None, 7), (9, " ", 8), (10, "a b", 9), (11, "a c", 9)]
    df = spark.createDataFrame(table, "doc_id long, text string, size int").withColumn("digest", F.col("text"))
    got = sorted(tuple(r)[:3] for r in near.one_of_each(df).collect())
    assert got == sorted([table[0], table[1], table[3], table[7], table[9], table[10]])
    assert near.one_of_each(df).columns == df.columns
    assert near.one_of_each(empty).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [substring.BROADCAST_BYTES, 0])
def test_substring(docs, rows, empty, broadcast_bytes):
    got = defaultdict(set)
    for r in substring.dedup(docs, broadcast_bytes=broadcast_bytes).collect():
        got[r["doc_id"]].add((r["n_words"], r["n_removed"], r["kept"]))
        assert sum(b - a for a, b in r["factors"]) == r["n_removed"]
    seen, want = set(), {}
    for d, t in sorted(set(rows)):
        w = words(t)
        gone, own = [False] * len(w), []
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        want[d] = {(len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))}
    assert got == want
    assert substring.dedup(empty).count() == 0


def test_substring_drops_its_shuffle_files(spark, docs):
    """What the steps shuffled is gone when they have ended, whether or not the JVM has collected garbage."""

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, ends = shuffled(), time.monotonic() + 20
    out = substring.dedup(docs)
    while (left := shuffled() - before) and time.monotonic() < ends:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert sorted(r["n_words"] for r in out.collect()) == sorted(r["n_words"] for r in out.collect())


def test_substring_without_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    got = substring.dedup(spark.createDataFrame([(None, t), (5, t + " x"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [("5", 31, 0), ("None", 0, 0), ("None", 30, 30)]


def test_repeated_ids_with_other_texts(spark):
    """What is cut from one text of a repeated doc_id isn't cut from the others."""
    t, u, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuv")
    table = [(1, t), (5, t), (5, u), (None, u), (None, v), (None, v), (5, None)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in substring.dedup(df).collect())
    assert got == sorted([("1", 30, t), ("5", 30, ""), ("5", 30, u), ("None", 30, ""), ("None", 30, v), ("None", 30, v), ("5", 0, "")])
    cut = sorted((str(r["doc_id"]), str(r["text"])) for r in lines.dedup(df).collect())
    assert cut == sorted([("1", t), ("5", ""), ("5", u), ("None", ""), ("None", v), ("None", v), ("5", "None")])


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs, path).collect()}
    assert got == {d: w[:3] for d, w in want.items()}
    decoded = bpe.decode(bpe.encode(docs, path), path).collect()
    assert {r["doc_id"]: (r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in decoded} == {d: (w[0], w[1], w[3]) for d, w in want.items()}
    assert bpe.round_trip(empty, path).count() == 0


LETTERS = ["a", "b", "the", "'ll", "'s", " ", "  ", "\n", "\t", "é", "É", "ß", "Σ", "İ", "日本", "9", "123", "!!", "---", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "🙂", "\0", "x" * 30, "'", ",", ". ", "A", "é"]


def test_tokenizers_on_odd_texts():
    from tokenizers import Tokenizer

    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    byte, word = bpe.ByteBpe(a), packing.WordIds(b)
    byte_library, word_library = Tokenizer.from_file(a), Tokenizer.from_file(b)
    rng = random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(b"".join(byte.encode(t)), "<u4").tolist() == byte_library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(next(word.encode([t.encode()])), "<u4").tolist() == word_library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 5000, "=" * 5000 + " " * 7000 + "x", "日本語é🙂" * 2000, "word " * 30000])
def test_streamed_encoding_of_long_runs(text):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    byte = bpe.tokenizer(path)
    ids = np.frombuffer(b"".join(byte.encode(text)), "<u4")
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    raw = ids.tobytes()
    assert "".join(byte.decode(raw[i : i + 4] for i in range(0, len(raw), 4))) == text


@pytest.mark.parametrize("letters", ["etaoinshr", "a", "ab", "=- ", "0123456789"])
def test_stable_tokens_are_emitted_early(letters):
    """Parts join to the ids of the whole, each within twice the lookahead and the longest token of where reading has got to."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    byte = bpe.tokenizer(path)
    rng = random.Random(1)
    data = "".join(rng.choice(letters) for _ in range(6000)).encode()
    read = 0

    def watched():
        nonlocal read
        for x in data:
            read += 1
            yield x

    out, emitted = [], 0
    for part in byte.streamed(watched()):
        out += part
        emitted += sum(len(byte.token[t]) for t in part)
        assert read - emitted <= 2 * byte.lookahead + byte.longest
    assert b"".join(byte.token[t] for t in out) == data
    if letters.isalpha():
        assert out == Tokenizer.from_file(path).encode(data.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_sufficient_lookahead(seed):
    """With so many letters to come, no continuation moves a boundary; merges by definition, all continuations of few letters."""
    rng = random.Random(seed)
    ids, merges = {b"a": 0, b"b": 1, b"c": 2}, []
    while len(merges) < 7:
        u, v = rng.choice(list(ids)), rng.choice(list(ids))
        if u + v not in ids and len(u + v) < 7:
            merges.append((u, v))
            ids[u + v] = len(ids)
    machine = bpe.Bpe(ids, merges)
    ahead = bpe.sufficient_lookahead(merges)
    for _ in range(150):
        text = bytes(rng.choice(b"abc") for _ in range(ahead + rng.randint(1, 8)))
        ends = set()
        for more in (b"", *(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(12))):
            at, cut = 0, []
            for t in machine.merged(text + more):
                at += len(machine.spelling[t])
                if at <= len(text) - ahead:
                    cut.append(at)
            ends.add(tuple(cut))
        assert len(ends) == 1


def brute_increasing(values):
    best, prev = [], []
    for i, v in enumerate(values):
        before = [j for j in range(i) if values[j] < v]
        top = max((best[j] for j in before), default=0)
        prev.append(min((j for j in before if best[j] == top), key=lambda j: values[j], default=None))
        best.append(top + 1)
    i = min((i for i in range(len(values)) if best[i] == max(best)), key=lambda i: values[i], default=None)
    out = []
    while i is not None:
        out.append(i)
        i = prev[i]
    return out[::-1]


def brute_patience(a, b):
    """Pairs of places, by recursion over what equal beginnings, equal ends and unique lines leave."""
    if not a or not b:
        return set()
    if a[0] == b[0]:
        return {(0, 0)} | {(i + 1, j + 1) for i, j in brute_patience(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {(len(a) - 1, len(b) - 1)} | brute_patience(a[:-1], b[:-1])
    unique = [(a.index(k), j) for j, k in enumerate(b) if a.count(k) == b.count(k) == 1]
    chain = [unique[i] for i in brute_increasing([i for i, _ in unique])]
    out, edges = set(chain), [(-1, -1), *chain, (len(a), len(b))]
    for (p, s), (q, t) in zip(edges, edges[1:], strict=False) if chain else []:
        out |= {(p + 1 + i, s + 1 + j) for i, j in brute_patience(a[p + 1 : q], b[s + 1 : t])}
    return out


def brute_lines(rows, rare):
    """The places that each document of different ids loses, from the lines themselves."""
    keys = {}
    for d, t in rows:
        keys[d] = own = []
        for line in t.split("\n") if t else []:
            own.append(line if len(line.encode().split()) >= 3 else (line, own[-1] if own else None))
    everywhere = defaultdict(set)
    for d, own in keys.items():
        for k in own:
            everywhere[k].add(d)
    shared = {d: [(i, k) for i, k in enumerate(own) if len(everywhere[k]) > 1] for d, own in keys.items()}
    first = {}
    for d in sorted(shared):
        first.setdefault(tuple(k for _, k in shared[d]), d)
    lone = {d: x for d, x in shared.items() if first[tuple(k for _, k in x)] == d}
    holders = defaultdict(set)
    for d, x in lone.items():
        for _, k in x:
            holders[k].add(d)
    gone = {d: set() if d in lone else {i for i, _ in x} for d, x in shared.items()}
    for d, x in lone.items():
        partners = {e for _, k in x for e in (holders[k] if len(holders[k]) <= rare else [min(holders[k])]) if e < d}
        for e in partners:
            both = {k for _, k in lone[e]} & {k for _, k in x}
            own = [(i, k) for i, k in x if k in both]
            gone[d] |= {own[j][0] for _, j in brute_patience([k for _, k in lone[e] if k in both], [k for _, k in own])}
    return gone


@pytest.mark.parametrize(("rare", "broadcast_bytes"), [(8, lines.BROADCAST_BYTES), (2, 0)])
def test_lines(docs, rows, empty, rare, broadcast_bytes):
    found = lines.dedup(docs, rare=rare, broadcast_bytes=broadcast_bytes)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()}
    gone = brute_lines([(d, t) for d, t in set(rows)], rare)
    assert sum(map(len, gone.values())) > 10
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert got[d] == (kept, 0 if t is None else len(t.split("\n")), len(gone[d]))
    assert found.count() == len(rows)
    assert lines.dedup(empty).count() == 0
    assert set(docs.columns) < set(found.columns)


@pytest.mark.parametrize("rare", [1, 3, 100])
def test_lines_of_few_kinds(spark, rare):
    """Many documents of the same few lines, in all orders and with repeats."""
    rng = random.Random(rare)
    kinds = [f"line {c} of words" for c in "abcdefghij"] + ["", "short", "}"]
    table = [(i, "\n".join(rng.choice(kinds[: rng.randint(2, 13)]) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(3), rare=rare).collect()}
    gone = brute_lines(table, rare)
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in table}


def test_many_equal_lines(spark):
    text = "\n".join(["the same line of a log"] * 20000)
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup(spark.createDataFrame([(1, text), (2, text + "\nand another line here")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 20000}


def test_lines_align_with_later_holders(spark):
    """A copy of a document that isn't the first to hold its lines goes, and so does what stands in another order than there."""
    foot, x, s, t, u, *p = (f"{w} of three words" for w in ("foot", "x", "s", "t", "u", "p", "q", "r", "own", "lone"))
    second = [p[0], foot, p[1], foot, p[2], t, s]
    table = [(1, [foot, x, s, t]), (2, second), (3, second), (4, [u, t, s, p[3]]), (5, [t, p[4], s])]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup(spark.createDataFrame([(i, "\n".join(v)) for i, v in table], "doc_id long, text string")).collect()}
    assert got[1] == table[0][1] and got[3] == [""]
    assert got[4] == [u, p[3]] and got[5] == [p[4]]


def test_patience():
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert lines.patience([], [1]) == [] and lines.patience([5, 5], [5, 5]) == [(0, 0), (1, 1)]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    times = Counter(d for d, _ in rows)
    for d, t in set(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        cover = Counter(i for r in pieces[d] for i in range(r["start"], r["start"] + r["length"]))
        assert cover == dict.fromkeys(range(len(ids)), times[d])
        for r in pieces[d]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]]))
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_assignment_cuts_only_what_has_no_room():
    rng = random.Random(11)
    lengths = [min(2047, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(1500)]
    sequences, over = packing.assign(lengths, 2048)
    n = sum(lengths) // 2048
    left, cost, place = [2048] * n, [0.0] * n, {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [s for s in range(n) if left[s] >= lengths[i]]
        if fits:
            s = place[i] = min(fits, key=lambda s: (cost[s], s))
            left[s] -= lengths[i]
            cost[s] += lengths[i] + lengths[i] ** 2 / 2048
    assert {i: s for s, x in enumerate(sequences) for i, at, m in x if (at, m) == (0, lengths[i]) and i in place} == place
    assert all(sum(m for _, _, m in x) == 2048 for x in sequences) and sum(m for _, _, m in over) < 2048


def test_assignment_balances_costs():
    rng = random.Random(1)
    lengths = [rng.randint(1, 700) for _ in range(400)] + [5000, 4096]
    sequences, over = packing.assign(lengths, 2048)
    assert all(sum(n for _, _, n in s) == 2048 for s in sequences) and sum(n for _, _, n in over) < 2048
    cover = Counter((i, k) for s in [*sequences, over] for i, at, n in s for k in range(at, at + n))
    assert cover == Counter({(i, k): 1 for i, n in enumerate(lengths) for k in range(n)})
    costs = [sum(n * n for _, _, n in s) for s in sequences if len(s) > 1]
    assert max(costs) < 3 * sum(costs) / len(costs)


PERSONAL = [
    "mail me@x.org or a.b+c@mail-5.example.com. a@b@c.d x@y z@w.v_q@r.s", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5 0001.002.3.255 1..2.3.4",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 12", "call +1 (415) 555-0101, +49 30 123456, +1 23, ++4415551234567x",
    "é🙂 me@x.org é +1 (415) 555-0101 1.2.3.4", "9" * 40, "1.1.1.1" * 30, None, "", "@" * 50, "a" * 5000 + "@b.c", "0 0 0 0 0 0 0 0 0 0 0 0 0",
]


KIND_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def raw(text):
    return [(k, m.start(), m.end()) for k, p in KIND_PATTERNS.items() for m in re.finditer(p, text or "")]


def base(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else None, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in KIND_PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def test_pii(spark, empty):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*PERSONAL, PERSONAL[0]])], "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("spans", F.lit(2))
    got = {r["doc_id"]: r for r in pii.find(df).withColumn("masked", pii.masked()).collect()}
    for i, t in enumerate([*PERSONAL, PERSONAL[0]]):
        want = base(t)
        assert [tuple(s) for s in got[i]["base"]] == want
        assert {tuple(s) for s in got[i]["spans"]} >= set(want)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
    # The phone pattern runs on over the address: 15 digits, so the two overlap and are masked as one.
    assert got[4]["masked"] == "é🙂 [EMAIL] é [PHONE]" and got[7]["masked"] is None
    assert pii.find(empty).count() == 0


def brute_spans(texts, support=5, confidence=0.8, rounds=10):
    """Spans of each text: the base ones, and words that hold a digit where trusted contexts stand beside them."""
    candidate = re.compile(r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*[0-9])[A-Za-z0-9@._+-]{5,}[A-Za-z0-9]")
    side = lambda w: re.sub("[0-9]", "0", w.lower())
    seen = []
    for i, t in enumerate(texts):
        t = t or ""
        known = base(t)
        spots = [(k, a, b) for k, a, b in known]
        spots += [(None, m.start(), m.end()) for m in candidate.finditer(t) if all(b <= m.start() or a >= m.end() for _, a, b in known)]
        # What stands beside a span reaches to the next match of its own pattern.
        ends = {k: [(x, y) for kk, x, y in raw(t) if kk == k] for k in KIND_PATTERNS}
        ends[None] = [(m.start(), m.end()) for m in candidate.finditer(t)]
        for k, a, b in spots:
            left = words(t[max([y for _, y in ends[k] if y <= a], default=0) : a])[-1:]
            right = words(t[b : min([x for x, _ in ends[k] if x >= b], default=len(t))])[:1]
            left, right = side(left[0]) if left else "", side(right[0]) if right else ""
            patterns = [("L", left)] * bool(left) + [("B", left, right)] * bool(left and right)
            seen.append((i, k, a, b, t[a:b], patterns))
    score = {(v, k): 1.0 for _, k, _, _, v, _ in seen if k}
    for _ in range(rounds):
        hits, held, total = Counter(), Counter(), Counter()
        for _, _, _, _, v, patterns in seen:
            for p in patterns:
                total[p] += 1
                for k in pii.KINDS:
                    if (v, k) in score:
                        hits[p, k] += score[v, k]
                        held[p, k] += 1
        trusted = {pk: h / (total[pk[0]] + 1) for pk, h in hits.items() if held[pk] >= support and h / (total[pk[0]] + 1) >= confidence - 1e-9}
        fresh = {(v, k): 1.0 for _, k, _, _, v, _ in seen if k}
        for _, _, _, _, v, patterns in seen:
            for (p, k), x in trusted.items():
                if p in patterns:
                    fresh[v, k] = max(fresh.get((v, k), 0), x)
        if len(fresh) == len(score):
            break
        score = fresh
    out = defaultdict(list)
    for i, k, a, b, _, patterns in seen:
        found = [(-x, pii.KINDS.index(kk), kk) for (p, kk), x in trusted.items() if p in patterns]
        if k or found:
            out[i].append((k or min(found)[2], a, b))
    return {i: sorted(x, key=lambda s: (pii.KINDS.index(s[0]), s[1])) for i, x in out.items()}


def test_pii_against_brute_force(spark):
    rng = random.Random(8)
    kinds = [lambda: f"user{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.org", lambda: f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"+49 30 {rng.randint(100000, 999999)}", lambda: f"item{rng.randint(1000, 9999)}x", lambda: f"node-{rng.randint(10, 99)}a"]
    lead = [["mail:", "Contact:"], ["host", "from"], ["call"], ["mail:", "see", "see", "see"], ["host", "in", "in"]]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 4)):
            k = rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 3, 4])
            parts += [rng.choice(["the", "a", "of", "é"]), rng.choice(lead[k]), kinds[k](), rng.choice(["now", "today", "please\n", ""])]
        texts.append(" ".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df).collect() if r["spans"]}
    want = brute_spans(texts)
    assert got == want
    added = sum(len(x) for x in want.values()) - sum(len(base(t)) for t in texts)
    assert added > 5


def test_pii_of_many_matches(spark):
    text = " ".join(f"u{i}@x.org item{i:05}z" for i in range(6000))
    r = pii.find(spark.createDataFrame([(1, text), (None, "a@b.cd"), (None, "a@b.cd"), (None, "x y@b.cd")], "doc_id long, text string")).withColumn("masked", pii.masked()).collect()
    long = next(x for x in r if x["doc_id"] == 1)
    assert long["n_email"] == 6000 and long["masked"].count("[EMAIL]") >= 6000
    assert sorted(x["masked"] for x in r if x["doc_id"] is None) == ["[EMAIL]", "[EMAIL]", "x [EMAIL]"]


def test_pii_learns_contexts(spark):
    known = [(i, f"write to Contact: user{i}@mail{i}.org today") for i in range(12)]
    df = spark.createDataFrame([*known, (90, "write to Contact: user77.mail77 today"), (91, "in room: user77x today")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df).collect()}
    assert got[90] == [("email", 18, 31)] and got[91] == []


def test_language(spark, docs, empty):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "and", "tion"], "fr": ["ê", "eau", "oux", "la"], "de": ["sch", "ung", "ein", "ü"]}
    table = [(i, lang, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20))) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    df = spark.createDataFrame([*table, (500, None, "thing"), (501, "en", None), (502, "fr", "123 !!"), (503, "xx", "")], "doc_id long, lang string, text string")
    model = langid.fit(df.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.predict(df.withColumn("held_out", langid.held_out()), model).collect()}
    held = [i for i, _, _ in table if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in got.items() if r["held_out"] and i < 500) == held
    assert all(got[i]["lang_pred"] == lang for i, lang, _ in table) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (501, 502, 503)] == ["und"] * 3
    nothing = langid.fit(empty.withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_every_label_is_learned(spark):
    names = [f"l{i:03}" for i in range(150)]
    letters = {x: "".join(chr(0x4E00 + 20 * i + j) for j in range(20)) for i, x in enumerate(names)}
    df = spark.createDataFrame([(10 * i + j, letters[x], x) for i, x in enumerate(names) for j in range(2)], "doc_id long, text string, lang string").coalesce(1)
    model = langid.fit(df)
    assert model.languages == names
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(df, model).collect())


def test_chat(spark):
    import duckdb

    turns = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "s"), (None, 1, "ann", "n"), (None, None, "cid", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("odd"))
    got = sorted((tuple(r) for r in chat.rotate(df).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert got == sorted(con.sql(chat.SQL).fetchall(), key=str)
    assert sum(r[6] for r in got if r[1] == "bob") == 2
    assert chat.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_top_k(spark, dims):
    rng = np.random.default_rng(dims)
    table = [(int(i), rng.normal(size=dims).tolist()) for i in range(300)]
    table += [(300 + i, table[20][1]) for i in range(40)] + [table[40], (400, None), (401, [None] * dims), (402, [float("nan")] * dims), (403, [float("inf")] * dims), (None, [1.0] * dims), (404, [1.0] * (dims + 1)), (420, [])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in table if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in set((i, tuple(v)) for i, v in whole if i % 20 == 0):
        scores = sorted((-sum(map(int.__mul__, v, w)), j) for j, w in whole if j != i and len(w) == len(v))[:20]
        assert sorted(got[i]) == [(k + 1, j, -x) for k, (x, j) in enumerate(scores)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_repeated_queries_and_small_blocks(spark, monkeypatch):
    """Each different vector of a repeated id has a list of its own, and blocks change nothing."""
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    rng = np.random.default_rng(9)
    table = [(int(i), rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(120)] + [(1, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, df.where("vec_id < 10"), k=5, scale=1).collect()]
    want = []
    for i, v in {(i, tuple(v)) for i, v in table if i < 10}:
        scores = sorted((-sum(int(a * b) for a, b in zip(v, w, strict=True)), j) for j, w in table if j != i)[:5]
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(scores)]
    assert sorted(got) == sorted(want) and sum(x[0] == 1 for x in got) == 10


def test_top_k_of_large_numbers():
    q, v = np.array([[2**40, 1]]), np.array([[2**20, 1], [2**20, 2], [0, 5]])
    (index, score), = topk.block_top(q, v, 2, [np.zeros(0, np.int64)])
    assert index.tolist() == [1, 0] and score.tolist() == [2**60 + 2, 2**60 + 1]


def brute_quality(text, least=10):
    w = words(text)
    n = len(w)
    lines_ = [x for x in (text or "").split("\n") if words(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeat = {k for i in range(n - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    covered = {k for i in range(n) if longest[i] >= least for k in range(i, i + longest[i])}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines_) - len(set(lines_)), len(repeat), len(covered), max(longest, default=0)


def test_quality(docs, rows, empty):
    got = {r["doc_id"]: tuple(r[n] for n in quality.NAMES) + (r["base_failed"], r["kept"]) for r in quality.rules(docs).collect()}
    for d, t in rows:
        if len(t or "") < 5000:
            want = brute_quality(t)
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert got[d] == (*want, failed, not failed and want[5] <= 0.5 * want[0] and want[6] <= 0.4 * want[0])
    assert quality.rules(empty).count() == 0


def test_repetition_rules_reject_beyond_the_base(spark):
    w = [f"w{i}" for i in range(400)]
    table = [
        (1, w[:200]),
        (2, w[:24] + w[100:152] + w[:24]),  # a passage of 24 % pasted twice
        (3, [x for k in range(5) for x in w[10 * k : 10 * k + 10] + w[200 + 20 * k : 220 + 20 * k] + w[10 * k : 10 * k + 10]]),  # short ones, half of it
        (4, w[:15] + w[100:220] + w[:15]),  # a tenth of it, a fifth covered
        (5, w[:24] + w[100:252] + w[:24]),  # the longest is over a tenth of it
        (6, w[:22] + w[100:278] + w[:22]),  # 22 of 222
        (7, [x for k in range(5) for x in w[10 * k : 10 * k + 10] + w[200 + 30 * k : 230 + 30 * k] + w[10 * k : 10 * k + 10]]),  # 10 of 250, 40 % covered
    ]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in table], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.rules(df).collect()}
    assert got == {i: (False, i in (1, 4, 6)) for i, _ in table}


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, 60)
    doc = np.sort(rng.integers(0, 3, 60))
    sa, lcp = quality.suffix_array(x, doc)
    end = np.searchsorted(doc, doc, side="right")
    suffix = [(doc[i], tuple(x[i : end[i]])) for i in range(60)]
    assert [suffix[i] for i in sa] == sorted(suffix)
    for k in range(1, 60):
        a, b = suffix[sa[k - 1]], suffix[sa[k]]
        n = next((i for i, (p, q) in enumerate(zip(a[1], b[1], strict=False)) if p != q), min(len(a[1]), len(b[1]))) if a[0] == b[0] else 0
        assert lcp[k] == n


def test_ten_queries_and_sql():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
