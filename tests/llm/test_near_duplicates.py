"""SimHash, components and line dedup against brute force."""

import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import graph, lines, simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = {tuple(sorted(p)) for p in pairs if None not in p and p[0] != p[1]}
    nodes = sorted({x for p in real for x in p})
    assert got == slow_components(nodes, lambda a, b: (a, b) in real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcÄé \t\n 1"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 200)
    b = a ^ (1 << rng.integers(0, 63, 200)) ^ (1 << rng.integers(0, 63, 200))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    near = F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b"))))
    assert df.where(near > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0


def test_links_connect_all_that_brute_force_connects(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {simhash.signed(x) for x in base}
    for x in base[:20]:
        for _ in range(12):
            y = x
            for _ in range(rng.randrange(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(simhash.signed(y))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for distance, hold, small in ((3, None, 256), (3, 6, 256), (3, None, 2), (5, None, 256)):
        monkeypatch.setattr(simhash, "SMALL", small)
        want = slow_components(fps, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= distance)
        got = {r["node"]: r["root"] for r in graph.components(simhash.links(df, distance, hold)).collect()}  # hold: crowded cells are dealt again
        assert got == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_near_duplicates_of_odd_rows(docs_of):
    words = " ".join(f"w{k}" for k in range(30_000))
    docs = docs_of([(5, "A b c d"), (3, "a B  c\nd"), (9, ""), (2, None), (8, "other words here now"), (8, "other words here now"), (None, "a b c d"), (1, words)])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 2), (2, 2), (8, 8), (8, 8), (None, 3), (1, 1)], key=str)
    kept = simhash.keep_first(docs, simhash.near_duplicates)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "8", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", max_size=12), st.text(alphabet="ab c", max_size=12), st.integers(1, 2))
def test_banded_edit_distance(a, b, k):
    assert lines.within(a, b, k) == (edit_distance(a, b) <= k)


def mutated(rng, line, n):
    out = list(line)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choice(["x", "", "yz"])
    return "".join(out)


def slow_classes(rows):
    all_ = [(d, k, s) for d, t in rows for k, s in lines.lines_of(t or "")]
    texts = sorted({s for *_, s in all_})
    root = slow_components(texts, lambda a, b: 0 < lines.allowed(min(len(a), len(b))) >= edit_distance(a, b))
    first = {}
    for d, k, s in sorted(all_, key=lambda r: (r[0], r[1])):
        first.setdefault(root[s], (d, k))
    return sorted((d, k, *first[root[s]]) for d, k, s in all_)


def test_line_classes(docs_of):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([8, 19, 20, 25, 41, 70]))) for _ in range(12)]
    rows = []
    for d in range(25):
        own = [mutated(rng, rng.choice(base), rng.randrange(4)) for _ in range(4)] + [rng.choice(base), "", "   "]
        rows.append((d, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    want = slow_classes(rows)
    for options in ({}, {"hold": 10}):  # directly, and with keys of more lines dealt again
        got = sorted(tuple(r) for r in lines.line_classes(docs_of(rows), **options).collect())
        assert got == want


def test_lines_of_odd_rows(docs_of):
    long, near = "x" * 150_000 + " end", "x" * 150_000 + " and"
    rows = [(5, f"one line that is long enough\n{long}"), (5, f"one line that is long enough\n{near}"), (None, "one line that is long enough"), (6, None)]
    got = sorted(map(tuple, lines.line_classes(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 0, None, 0), (5, 0, None, 0), (None, 0, None, 0), (5, 1, 5, 1), (5, 1, 5, 1)], key=str)


def test_lines_taken_out(docs_of):
    long = "one long line that is repeated here"
    docs = docs_of([(1, f"{long}\nsolo"), (2, f"solo 2\n{long}\n\nend"), (3, None)])
    kept = lines.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: f"{long}\nsolo", 2: "solo 2\n\nend", 3: None}
    assert lines.line_classes(docs.limit(0)).count() == 0


def test_similar_documents(docs_of):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = {9000: None, 9001: "", 9002: "One  two", 9003: "one two", 9004: "one three"}
    for g in range(120):
        base = [word() for _ in range(rng.choice([6, 40, 120]))]
        for k in range(rng.choice([4, 4, 40])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 20)):
                own[rng.randrange(len(own))] = word()
            rows[g * 40 + k] = " ".join(own)

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {k: shingles(t) for k, t in rows.items()}
    linked = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    close = [(a, b) for a in rows for b in rows if a < b and a // 40 == b // 40 and linked(a, b)]
    want = slow_components(sorted(rows), lambda a, b: a // 40 == b // 40 and linked(a, b))
    docs = docs_of(list(rows.items()))
    for hold in (30,):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, hold).collect()}
        assert got.keys() == rows.keys()
        assert all(want[k] == want[v] for k, v in got.items())  # no link is wrong
        assert sum(got[a] == got[b] for a, b in close) >= 0.97 * len(close)
    assert len(set(want.values())) < len(rows) - 100
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} >= set(want.values())
    assert simhash.similar(docs.limit(0)).count() == 0


def test_the_pipeline_links_by_similarity(spark, docs_of):
    import corpus_pipeline

    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)]
    near, far = list(words), list(words)
    near[20], near[60] = "x", "y"  # 86 of 106 shingles are shared
    for k in range(10, 100, 20):
        far[k] = "z"
    assert bin(simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(near))).count("1") > 5
    out = corpus_pipeline.near_duplicates_out(spark, docs_of([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_clusters_just_under_the_limit(spark, docs_of):
    """Groups whose rows have many partners that do not qualify, and few that do."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, clusters = [], []
    for c in range(6):
        base, members = [rng.choice(vocabulary) for _ in range(400)], []
        for _ in range(90):
            words = list(base)
            for at in rng.sample(range(400), rng.choice([5, 7])):
                words[at] = rng.choice(vocabulary)
            members.append(len(rows))
            rows.append((len(rows), " ".join(words)))
        clusters.append(members)
    for _ in range(700):
        rows.append((len(rows), " ".join(rng.choice(vocabulary) for _ in range(200))))
    shingles = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    links = [(a, b) for m in clusters for a, b in itertools.combinations(m, 2) if len(shingles[a] & shingles[b]) * 5 >= 4 * len(shingles[a] | shingles[b])]
    near = sum(len(m) * (len(m) - 1) // 2 for m in clusters)
    assert 50 < len(links) < near / 4
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs_of(rows).repartition(6)).collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(a) == top(b) for a, b in got.items())  # no wrong link


def test_joining_connects_what_all_similar_pairs_connect():
    rng = np.random.default_rng(4)
    for turn in range(60):
        n, two, distance = int(rng.integers(2, 50)), turn % 3 == 0, 128 if turn % 2 else 60
        base = [rng.choice(400, int(rng.integers(1, 40)), replace=False) for _ in range(3)]
        items = []
        for _ in range(n):
            own = base[rng.integers(3)].copy()
            own[rng.random(len(own)) < 0.15] = rng.integers(400, 1000 if turn % 4 else 404)
            items.append(np.unique(own).astype(np.uint64))
        x = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        root, side = rng.integers(0, n, n), rng.integers(0, 2, n) if two else np.zeros(n, dtype=np.int64)
        across = (side != side[0]).any()

        def linked(a, b):
            shared = len(np.intersect1d(items[a], items[b]))
            near = np.bitwise_count(x[:, a] ^ x[:, b]).sum() <= distance
            return near and 5 * shared >= 4 * (len(items[a]) + len(items[b]) - shared) and (side[a] != side[b] or not across)

        want = slow_components(list(range(n)), lambda a, b: root[a] == root[b] or linked(a, b))
        found = simhash.joining(x, root.copy(), side, items, distance)
        assert all(root[a] != root[b] and linked(a, b) for a, b in found)
        assert slow_components(list(range(n)), lambda a, b: root[a] == root[b] or (a, b) in found or (b, a) in found) == want
        assert len(found) < n


def test_a_large_group_of_near_texts_makes_few_pairs(spark, docs_of, monkeypatch):
    """Of 500 texts that are all near, few are similar: the rows of the joins grow with the group, not with its square."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(500):
        words = list(base)
        for at in rng.sample(range(150), 2 if k % 10 == 0 else 7):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    links = {(a, b) for a, b in itertools.combinations(range(500), 2) if len(shingles[a] & shingles[b]) * 5 >= 4 * len(shingles[a] | shingles[b])}
    want = slow_components(list(range(500)), lambda a, b: (a, b) in links)
    verified, pairs = simhash.verified, []
    monkeypatch.setattr(simhash, "verified", lambda p, sets: pairs.append(p.count()) or verified(p, sets))
    docs = docs_of(rows).repartition(4).cache()
    grids = len(simhash.random_choices(500))
    for block in (simhash.BLOCK, 20_000):  # as one key, and in blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
        assert all(want[a] == want[b] for a, b in got.items())  # no wrong link
        assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
        assert sum(pairs) <= 2 * grids * 500
        pairs.clear()
