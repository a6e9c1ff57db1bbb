import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from keelspark.llm import common, components, simhash, suffix_dedup


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def join(pairs, nodes):
    up = {n: n for n in nodes}
    for a, b in pairs:
        a, b = find(up, a), find(up, b)
        up[max(a, b)] = min(a, b)
    return {n: find(up, n) for n in nodes}


def fingerprint(text):
    """The contract, bit by bit."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab É\t\n\x1c\xa0 Zc") for _ in range(rng.randint(0, 120)))
        assert simhash.fingerprint(text.encode()) == fingerprint(text)
    long = " ".join(str(rng.random()) for _ in range(70_000))
    assert simhash.fingerprint(long.encode()) == fingerprint(long)


@pytest.mark.parametrize("n, centres", [(2, 1), (60, 3), (400, 6), (500, 1), (500, 60)])
def test_trie_against_all_pairs(n, centres):
    rng = np.random.default_rng(n + centres)
    base = rng.integers(0, 2**64, centres, dtype=np.uint64)
    v = base[rng.integers(0, centres, n)]
    for _ in range(4):
        v = v ^ ((np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64))
    v = np.unique(np.append(v, np.array([0, 2**64 - 1], dtype=np.uint64)))
    group = np.sort(rng.integers(0, 2, len(v)))
    for g in (np.zeros(len(v), dtype=np.int64), group):
        order = np.lexsort((v, g))
        roots = simhash.trie_links(g[order], v[order], most=50).roots()
        want = collections.defaultdict(list)
        for i in range(len(v)):
            want[g[order][i]].append((i, int(v[order][i])))
        pairs = [(a, b) for rows in want.values() for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 4]
        expect = join(pairs, range(len(v)))
        assert len({(roots[i], expect[i]) for i in range(len(v))}) == len(set(roots)) == len(set(expect.values()))


def test_links_with_hot_blocks(spark):
    """A limit of a few rows makes every block value hot; the sub-blocks must lose nothing."""
    rng = np.random.default_rng(5)
    v = rng.integers(0, 2**64, 12, dtype=np.uint64)[rng.integers(0, 12, 400)]
    for _ in range(4):
        v = v ^ ((np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) * (rng.random(400) < 0.7).astype(np.uint64))
    fps = sorted(set(v.view(np.int64).tolist()))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = join([(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4], fps)
    for hot in (5, 10**6):
        got = {r.node: r.root for r in components.components(simhash.links(df, hot=hot, per_task=300)).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == join([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(400)]
        texts += [" ".join(words)] * 2 + [" ".join(words[:k] + [word()] + words[k + 1 :]) for k in (3, 200)]
    texts += ["", None, " \n", "one two", "one two"]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (1, texts[0], "x")]
    got = simhash.op7(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    fp = {i: fingerprint(t or "") for i, t, _ in rows if i}
    want = join([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id:
            assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])
        else:
            assert r.component_id == 1
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted([1, *(i for i in fp if want[i] == i)])
    assert simhash.op7(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 9) for i in range(300)], "doc_id long, k long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "times").selectExpr("k", "times", "k * 10 as told")
    want = sorted((i, k, k * 10) for i, k in rows.collect())
    for hot in (50, 10**6):
        assert sorted(tuple(r) for r in common.lookup(rows, keyed, "k", hot).select("doc_id", "k", "told").collect()) == want


def test_difference_covers():
    for q in (2, 3, 5, 7, 13, 17):
        v, d = suffix_dedup.difference_cover(q)
        assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 3000):
        for top in (10, 2**20, 2**62):
            x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            assert (suffix_dedup.unpack(suffix_dedup.pack(x)) == x).all()


def test_fingerprints_follow_content():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 256, 3 * suffix_dedup.SEGMENT // 2, dtype=np.uint8)
    buf[-900:-500] = buf[1000:1400]
    at = np.array([0, 1000, suffix_dedup.SEGMENT - 200, len(buf) - 900, len(buf) - 400])
    h = suffix_dedup.fingerprints((buf, buf), 400, at)
    assert h[1] == h[3] and len(set(h.tolist())) == 4
    each = suffix_dedup.fingerprints((buf, buf), np.array([400, 300, 400, 300, 399]), at)
    other = suffix_dedup.fingerprints((buf[500:], buf[500:]), np.array([7, 300]), np.array([0, 500]))
    assert each[1] == each[3] == other[1] and len(set(each.tolist())) == 4


def test_word_units():
    raw = b" one  two\none\x0b" + b"x" * 9000 + b" " + b"x" * 9000 + b" " + b"x" * 8999
    (a, b), start, stop = suffix_dedup.word_units(np.frombuffer(raw, dtype=np.uint8), suffix_dedup.BASES)
    assert [raw[i:j] for i, j in zip(start, stop)] == raw.split()
    both = list(zip(a.tolist(), b.tolist()))
    assert both[0] == both[2] and both[3] == both[4] and len(set(both)) == 4


def removal(texts, n):
    """The contract by brute force: kept bytes and spans of each text."""
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus(rng, unit):
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(unit // 3)) for _ in range(4)]
    texts = ["", None, "x", "a" * (unit * 3), "ab" * unit, "é" * unit]
    for _ in range(25):
        parts = [" ".join(word() for _ in range(rng.randint(1, unit // 3))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(passage)[rng.randint(0, 40) :])
        texts.append(" ".join(parts))
    return texts + texts[-4:] + [texts[-1]] * 5


@pytest.mark.parametrize("length, q", [(400, 17), (60, 5)])
def test_repeats_against_brute_force(spark, length, q):
    rng = random.Random(length)
    texts = corpus(rng, length)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    plan = suffix_dedup.Plan(length, q, per_task=2000, chunk_bytes=9000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9(df, plan).collect()}
    want = removal([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 0
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df, plan).collect()}
    assert kept[1] is None and kept[0] == ""
    whole = [i for i in range(len(texts)) if kept[i] is not None and hashlib.sha256(kept[i].encode()).hexdigest() == want[i][3]]
    assert len(whole) >= len(texts) - 4  # a run may end inside a character


def passages(texts, n):
    """Runs of words covered by n-word strings that two texts hold, by brute force: spans in bytes for each text."""
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    held = collections.defaultdict(set)
    for i, (t, ws) in enumerate(zip(texts, split)):
        for k in range(len(ws) - n + 1):
            held[tuple(t[a:b] for a, b in ws[k : k + n])].add(i)
    out = []
    for t, ws in zip(texts, split):
        gone = [False] * len(ws)
        for k in range(len(ws) - n + 1):
            if len(held[tuple(t[a:b] for a, b in ws[k : k + n])]) > 1:
                gone[k : k + n] = [True] * n
        runs = [(k, next((j for j in range(k, len(ws)) if not gone[j]), len(ws))) for k in range(len(ws)) if gone[k] and not (k and gone[k - 1])]
        out.append([(ws[a][0], ws[b - 1][1]) for a, b in runs])
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(51)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    planted = [[word() for _ in range(rng.randint(51, 60))] for _ in range(5)]
    texts = ["", None, "and " * 300, "� " + " ".join(planted[0])]
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            words[40:40] = planted[i % 5] if i % 2 else planted[i % 5][:50]
        texts.append(rng.choice(("", " ")) + rng.choice((" ", "\n", " \t ")).join(words))
    texts += ["word " * 80 + texts[-1]] * 3
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, key int, spans int").repartition(4)
    plan = suffix_dedup.PASSAGES._replace(chunk_bytes=4000, per_task=500)
    raw = [(t or "").encode() for t in texts]
    told = dict(zip(sorted(set(raw)), passages(sorted(set(raw)), 51)))
    want = [told[t] for t in raw]
    got = suffix_dedup.remove_repeats(df, plan).collect()
    assert len(got) == len(texts) and all(r.key == 1 and r.spans == 2 for r in got)
    kept = {r.doc_id: r.text for r in got}
    assert kept[1] is None
    for i, t in enumerate(raw):
        if texts[i] is not None:
            assert kept[i].encode() == suffix_dedup.kept(t, want[i]), i
    counts = {r.doc_id: r.n_passages for r in suffix_dedup.op9(df.drop("key", "spans"), passages=plan).collect()}
    assert [counts[i] for i in range(len(texts))] == [len(w) for w in want]
    assert sum(map(bool, want)) > 10


def test_repeats_in_nothing(spark):
    assert suffix_dedup.op9(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    short = suffix_dedup.op9(spark.createDataFrame([(1, "abc"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in short) == [(0, 0, 0), (3, 0, 0)]
