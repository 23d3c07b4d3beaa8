"""Hard negatives, importance resampling and I-Match fingerprints against plain versions, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import imatch, negatives, resample

# hard negatives


def test_planes_hold_the_numbers():
    vec = np.random.default_rng(0).integers(-300, 300, (40, 7))
    vec[0] = [-512, 511, 0, -1, 1, 256, -256]
    planes = negatives.planes_of(vec)
    assert (sum(w * bits.astype(int) for w, _, bits in planes) == vec).all()
    assert all(rest == sum(w for w, _, _ in planes[k + 1 :]) for k, (_, rest, _) in enumerate(planes))
    assert (negatives.planes_of(np.zeros((2, 3), dtype=int))[0][2] == 0).all()


@pytest.mark.parametrize("scale", [1 << 7, 1 << 14, 1 << 22])
@pytest.mark.parametrize("high", [False, True])
def test_intervals_drop_nothing_that_qualifies(scale, high):
    rng = np.random.default_rng(scale)
    a, b = rng.integers(-scale, scale, (30, 48)), rng.integers(-scale, scale, (700, 48))
    b[:60] = b[60:120]  # ties
    score = a @ b.T
    k = 4
    planes = negatives.planes_of(b)
    if high:
        low, top = np.quantile(score, 0.9, axis=1).astype(np.int64), np.quantile(score, 0.97, axis=1).astype(np.int64)
        low[0], top[0] = 5, 4  # an empty window
        i, j, s = negatives.qualifying(a, planes, np.arange(len(b)), low, top, None, k)
        want = {(x, y) for x, y in zip(*np.nonzero((score >= low[:, None]) & (score <= top[:, None])))}
        assert set(zip(i.tolist(), j.tolist())) == want
    else:
        barred = np.array([0, 0, 3]), np.array([int(score[0].argmax()), 5, int(score[3].argmax())])
        i, j, s = negatives.qualifying(a, planes, np.arange(len(b)), np.full(len(a), negatives.LOWEST), None, barred, k)
        got = set(zip(i.tolist(), j.tolist()))
        assert not got & set(zip(*barred))
        for x in range(len(a)):
            open_ = [y for y in range(len(b)) if (x, y) not in set(zip(*barred))]
            kth = sorted((score[x, y] for y in open_), reverse=True)[k - 1]
            assert {(x, y) for y in open_ if score[x, y] >= kth} <= got
        assert len(got) < score.size / 4
    assert (s == score[i, j]).all()


def test_best_keeps_smaller_ids_among_ties():
    best = negatives.Best(2, 3)
    best.add(np.array([0, 0, 1]), np.array([5, 7, -9]), np.array([30, 31, 1]))
    best.add(np.array([0, 0, 0]), np.array([5, 5, 4]), np.array([29, 2, 1]))
    q, s, i = best.rows()
    assert list(zip(q.tolist(), s.tolist(), i.tolist())) == [(0, 7, 31), (0, 5, 2), (0, 5, 29), (1, -9, 1)]


def plain_negatives(rows, positives=5, count=5, low=80, high=100):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in good:
        if a % 100:
            continue
        dot = lambda w: sum(x * y for x, y in zip(v, w))
        alike = sorted((-dot(w), i) for i, l, w in good if l == label and i != a)[:positives]
        for p, i in alike:
            fit = sorted((-dot(w), n) for n, l, w in good if l != label and low * -p <= 100 * dot(w) <= high * -p)[:count]
            out += [(a, i, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [1024, 37])
def test_negatives_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "BLOCK", 3 if chunk < 100 else 2048)
    monkeypatch.setattr(negatives, "BAND", 4 if chunk < 100 else 65_536)
    rng = random.Random(chunk)
    rows = []
    for i in range(900):
        v = [rng.uniform(-0.4, 0.6) for _ in range(6)]
        rows.append((i, rng.choice([0, 0, 0, 1, 2, -3, 10**6]), v))
    rows += [rows[5], rows[5], rows[100]]  # repeated rows
    rows += [(1000 + k, 0, rows[7][2]) for k in range(6)]  # ties
    rows += [(None, 0, [1.0] * 6), (2000, None, [1.0] * 6), (2100, 0, None), (2200, 0, [1.0, None]), (2300, 0, [float("nan")]), (2400, 1, [float("inf")]), (2500, 1, []), (2600, 1, [0.5, 0.5]), (2700, 77, [0.5] * 9)]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, label int, embedding array<double>, key string, anchor int").repartition(3)
    got = negatives.mine(negatives.scaled(table), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(negatives.scaled(empty), F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(negatives.scaled(alone), F.col("id") % 100 == 0).count() == 0


# importance resampling


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in lower).split(" ")


def plain_resample(docs, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    def grams(text):
        w = [x for x in plain_words(text) if x]
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, most + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(g for _, x in docs for g in grams(x)[1]), Counter(g for x in target for g in grams(x)[1])
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets))))
    rows = []
    for i, x in docs:
        n, g = grams(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in fit[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least], key=str)


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 97)])
def test_resampling_equals_a_plain_version(spark, docs_of, most, buckets):
    rng = random.Random(most)
    vocabulary = ["".join(rng.choice("abcdeÉé9") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randrange(60))) for k in range(150)] + [(500, None), (501, ""), (502, "?!"), (None, text(40)), (503, text(30_000)), (504, "\U0001f600 A\x7fB  x")]
    rows += [rows[3]] * 3
    target = [text(20) for _ in range(10)] + [None, ""]
    bench = spark.createDataFrame([(k, t, 5) for k, t in enumerate(target)], "item_id long, text string, bucket int")
    got = resample.resample(docs_of(rows).repartition(3), bench, 10, 20, most, buckets)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, most=most, buckets=buckets)


def test_resampling_of_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs_of([]), none).count() == 0
    rows = [(k, "word " * 25) for k in range(20)]
    got = resample.resample(docs_of(rows), none).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0] * 18 + [1, 2]
    assert resample.resampled(docs_of(rows), none).columns == docs_of(rows).columns and resample.resampled(docs_of(rows), none).count() == 2
    with pytest.raises(ValueError):
        resample.resample(docs_of(rows), none, buckets=1 << 30)


def test_exploded_rows_do_not_carry_their_array(spark, docs_of):
    rows = docs_of([(1, "a b c")]).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    plan = resample.bucketed(rows, ["doc_id", "row"], "text", 1, 100)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate" in x)
    assert "[0]" in generate or "_grams" not in generate.split("explode")[1].split(",", 1)[1]


# fingerprints


def test_neighbours_and_edits(spark, docs_of):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(n))
    rows = [(k, text(rng.randrange(5, 200))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "é" * 10), (1003, "?!"), (1004, "!?"), (1005, text(40_000)), (None, text(30)), (1006, rows[3][1]), (1007, "\U0001f600 face")]
    got = {r["doc_id"]: r for r in imatch.with_edits(docs_of(rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n, r = t or "", n or "", got[i]
        want = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) or want != t
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        prints.setdefault(want, r["edited_fingerprint"])
        assert prints[want] == r["edited_fingerprint"]
    assert len({f for t, f in prints.items() if t in {x or "" for _, x in rows}}) == len({x or "" for _, x in rows})
    plain = [r for r in got.values() if r["doc_id"] is not None and r["doc_id"] < 300 and r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in plain]) > 0.9


def test_likeness_follows_shared_terms():
    rng = np.random.default_rng(0)
    terms = np.zeros(0, dtype=np.uint64)
    words = [f"x{k}" for k in range(4000)]

    def near(shared, own):
        out = []
        for _ in range(30):
            pick = rng.permutation(4000)
            a, b = [words[k] for k in pick[: shared + own]], [words[k] for k in [*pick[:shared], *pick[shared + own : shared + 2 * own]]]
            out.append(float(imatch.likeness(imatch.hashed([" ".join(a)], terms), imatch.hashed([" ".join(rng.permutation(b))], terms))[0]))
        return np.mean(out)

    # no lexicon term: all terms count
    assert near(100, 0) == 1 and near(0, 100) < 0.05 and 0.3 < near(100, 50) < 0.7 and near(300, 50) > near(100, 50) > near(60, 90)
    prints = imatch.hashed(["a b c", "", "c b a"], terms)
    again = imatch.parsed(imatch.written(*prints))
    assert (again[0] == prints[0]).all() and (again[1] == prints[1]).all() and prints[0][0] == prints[0][2] and prints[0][1] == 0


def test_lexicon_is_the_band(spark, docs_of, monkeypatch):
    rows = [(k, " ".join([f"all {k % 40}a", f"half{k % 2}", f"one{k}"])) for k in range(400)] + [(400, None)]
    docs = docs_of(rows)
    found = imatch.lexicon(docs, (3.0, 5.0))
    count = Counter(w for _, t in rows for w in set(plain_words(t)) if w)
    want = [w for w, n in count.items() if 401 * math.exp(-5) <= n <= 401 * math.exp(-3)]
    assert 0 < len(want) < len(count) and sorted(np.concatenate([imatch.terms_of(w) for w in want]).tolist()) == found.tolist()
    monkeypatch.setattr(imatch, "EXACT", 0)
    bitmap = imatch.lexicon(docs, (3.0, 5.0))
    assert bitmap.ndim == 2 and imatch.known(bitmap, found).all()
    assert imatch.known(bitmap, np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.1


def test_fingerprints_of_few_rows(spark, docs_of):
    assert imatch.with_edits(docs_of([])).count() == 0
    one = imatch.with_edits(docs_of([(7, "only one text here")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"only one texonly o").hexdigest() and one["near_next"] == 1
    same = imatch.with_edits(docs_of([(7, "the same"), (7, "the same"), (None, None), (None, None)])).collect()
    assert len(same) == 4 and len({r["fingerprint"] for r in same if r["doc_id"] == 7}) == 1
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs_of([(1, "a b"), (2, "b a"), (3, None)])).collect()}
    assert got[1] == got[2] != got[3] and set(got[3]) == {"0"}
