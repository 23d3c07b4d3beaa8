"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments of two bits; its embedding is the vector of their bit counts. One bit that differs
moves one count by one at most, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. Counts are kept in unary (0 -> 00, 1 -> 01, 2 -> 11), so a vector is as wide as the fingerprint and the
Manhattan distance is ``bit_count(u1 ^ u2)``.

The range join: a grid is a choice of coordinates, a cell all fingerprints that agree there. Rows are dealt by cell and
sorted, and each task reads its cells as runs: the Manhattan bound first, then the exact Hamming distance. A cell gives
links in proportion to its rows, never all its pairs: a spanning forest, or each row's nearest partners. A cell of more
than HOLD rows is not compared there; its rows pass through and are dealt again by further bits.

Two searches use it. ``links`` is complete for few bits: coordinates fall into m bands, and the choices of m - distance
bands are grids that miss no pair. ``similar`` looks for documents whose five-word shingles have a Jaccard similarity of
0.8 or more: its 128-bit fingerprints differ in about 19 bits there, so its grids are as many random choices of
coordinates as find a pair at that limit with the stated probability, and every link is verified on the shingles. A
row offers its nearest partner, and its nearest earlier one. Where it has more, its cell stays open: once the offers are verified and their
components known, the rows of open cells of several components get their shingles, and the cell's task compares those of
different components itself. It gives no pairs but the links that join components. So no partner within the distance goes
unverified, and a large group gives rows in proportion to its size, whether its members are copies or only near.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, members_of, sieve, staged, texts_of
from .graph import components

#: Bit j of a byte as byte lane j of a 64-bit word: sums of up to 255 rows of these count the bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()
LOW = 0x5555555555555555
#: Rows of a cell that one task compares; beyond it they are dealt again by further bits.
HOLD = 32_768
#: Cells of up to so many rows are compared together, offset by offset.
SMALL = 256
#: Links that a cell may give for each of its rows before it gives a forest.
PER_ROW = 4
#: Of the similarity search: shingles of an open cell's rows that one task compares with each other or with as many more.
BLOCK = 1_000_000
#: Of the similarity search: words of a shingle, least similarity, bits, and the chance to find a pair at that limit.
WORDS, LEAST, WIDTH, FOUND = 5, Fraction(4, 5), 128, 0.99
FACTOR = np.uint64(0x9E3779B97F4A7C15)

Masks = list[tuple[int, ...]]


def votes(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    lanes = np.add.reduceat(LANES[h.view(np.uint8).reshape(-1, 8)], np.arange(0, len(h), 255), axis=0)
    ones = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (ASCII lower case, repeats count). No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return votes(np.array([digest(s, 42) for s in runs], dtype="<u8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long. Whole texts; null and wordless texts get 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return by_batch(chosen, work, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """Counts of the 32 two-bit segments of one word, each in unary."""
    low = F.lit(LOW)
    right = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(right).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(right).bitwiseAND(low), 1))


def embedded(x: np.ndarray) -> np.ndarray:
    right = x >> np.uint64(1)
    return (x | right) & np.uint64(LOW) | (x & right & np.uint64(LOW)) << np.uint64(1)


def grid_masks(n: int, distance: int) -> Masks:
    """Masks of the band choices; the number of bands weighs rows to deal against pairs to compare for n fingerprints."""

    def cost(m: int) -> float:
        return math.comb(m, distance) * (100 + n * 2.0 ** (-1.415 * 32 * (m - distance) / m))

    m = min(range(distance + 2, distance + 8), key=cost)
    edge = [round(i * 32 / m) for i in range(m + 1)]
    band = [sum(3 << 2 * s for s in range(edge[i], edge[i + 1])) for i in range(m)]
    return [(signed(sum(band[i] for i in pick)),) for pick in combinations(range(m), m - distance)]


def band_choices(level: int, distance: int, bits: int = 64) -> Masks:
    """Raw-bit masks that part a crowded cell: distance + 2 bands in an order of the level's own, two of them chosen.

    Of two fingerprints within the distance two bands agree at least, so no pair is missed.
    """
    order = np.random.default_rng(level).permutation(bits).tolist()
    band = [sum(1 << b for b in order[i :: distance + 2]) for i in range(distance + 2)]
    return [tuple(signed(x >> 64 * w & (1 << 64) - 1) for w in range(bits // 64)) for x in (a | b for a, b in combinations(band, 2))]


def flip_rate() -> float:
    """Share of bits that differ between documents of similarity LEAST."""
    j = float(LEAST)
    return math.acos(2 * j / (1 + j)) / math.pi


def random_choices(n: int, seed: int = 5) -> Masks:
    """Coordinate masks for the similarity search over n fingerprints of WIDTH bits.

    A pair at the limit agrees in c coordinates with the chance q^c, so ln(1 - FOUND) / ln(1 - q^c) grids find it; c
    weighs rows to deal against pairs to compare.
    """
    p = flip_rate()
    q = (1 - p) ** 2 + p * p / 2
    grids = lambda c: math.ceil(math.log(1 - FOUND) / math.log(1 - q**c))
    c = min(range(4, WIDTH // 4), key=lambda c: grids(c) * (200 + n * 2.0 ** (-1.415 * c)))
    return _chosen(WIDTH // 2, c, grids(c), 3, 2, seed)


def random_bits(level: int, c: int = 12) -> Masks:
    """Raw-bit masks that part a crowded cell of the similarity search, with the same chance to keep a pair."""
    grids = math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - flip_rate()) ** c))
    return _chosen(WIDTH, c, grids, 1, 1, 100 + level)


def _chosen(places: int, c: int, grids: int, unit: int, step: int, seed: int) -> Masks:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(grids):
        x = sum(unit << step * int(k) for k in rng.choice(places, c, replace=False))
        out.append(tuple(signed(x >> 64 * w & (1 << 64) - 1) for w in range(WIDTH // 64)))
    return out


def apart(x: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Bits that differ; x has a row for each word."""
    return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int32) for w in x)


def forest(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within a group: each fingerprint is met once, against those not yet reached."""
    unary = embedded(x)
    left = np.arange(x.shape[1])
    links, front = [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        at = front.pop()
        near = apart(unary, left, at) <= distance
        near[near] = apart(x, left[near], at) <= distance
        hit = left[near]
        if len(hit):
            links += [(at, j) for j in hit.tolist()]
            front += hit.tolist()
            left = left[~near]
    return links


def near_pairs(x: np.ndarray, run: np.ndarray, end: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the distance in runs of equal numbers, up to SMALL rows each; end: where a row's run ends, by run."""
    unary = embedded(x)
    after = np.where(np.diff(np.concatenate([[0], end]))[run] <= SMALL, end[run] - np.arange(len(run)), 0)
    ones, others = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    at, k = np.flatnonzero(after > 1), 1
    while len(at):
        near = at[apart(unary, at, at + k) <= distance]
        near = near[apart(x, near, near + k) <= distance]
        ones.append(near)
        others.append(near + k)
        k += 1
        at = at[after[at] > k]
    return np.concatenate(ones), np.concatenate(others)


def runs_in(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's run of equal cells, where each run ends)."""
    edge = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
    return np.repeat(np.arange(len(edge)), np.diff(np.concatenate([[0], edge]))), edge


def offers(cell: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, open) of runs of equal cells: pairs within the distance where b is a's nearest (by distance, then place) or
    the nearest before a, so that the links of a group of copies reach from each to the first. Open are rows with a second
    partner, and all partners of these."""
    run, end = runs_in(cell)
    a, b = near_pairs(x, run, end, distance)
    one, other, d = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(apart(x, a, b), 2)
    by = np.lexsort((other, d, one))
    one, other = one[by], other[by]
    kept = np.concatenate([[True], one[1:] != one[:-1]])[: len(one)]
    late, opened = np.zeros(len(run), dtype=bool), np.zeros(len(run), dtype=bool)
    late[one[~kept]] = True
    opened[other[late[one]]] = True
    opened |= late
    earlier = np.flatnonzero(other < one)
    kept[earlier[np.unique(one[earlier], return_index=True)[1]]] = True
    ones, others = [one[kept]], [other[kept]]
    size = np.diff(np.concatenate([[0], end]))
    for r in np.flatnonzero(size > SMALL).tolist():
        begin = int(end[r] - size[r])
        own = x[:, begin : end[r]]
        unary, every = embedded(own), np.arange(size[r])
        for at in range(int(size[r])):
            near = every[apart(unary, every, at) <= distance]
            near = near[near != at]
            d = apart(own, near, at)
            near = near[np.argsort(d, kind="stable")[: int((d <= distance).sum())]]
            fit = np.union1d(near[:1], near[near < at][:1])
            ones.append(np.full(len(fit), begin + at))
            others.append(begin + fit)
            if len(near) > 1:
                opened[[begin + at, *(begin + near)]] = True
    return np.concatenate(ones), np.concatenate(others), opened


def joining(x: np.ndarray, root: np.ndarray, side: np.ndarray, items: list[np.ndarray], distance: int) -> list[tuple[int, int]]:
    """Positions (a, b) of similar rows of different roots within the distance, one for each two roots that it joins: they
    connect what all such pairs connect. Where the rows have two sides, only pairs across them count."""
    root = np.unique(root, return_inverse=True)[1]
    size = np.array([len(i) for i in items])
    token = np.unique(np.concatenate(items), return_inverse=True)[1]
    at, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    left, before = np.ones(len(size), dtype=bool), len(size) + 1
    while 0 < left.sum() < before - before // 8:
        # a row shares LEAST of its own shingles with any row that is similar, so as many must be in rows of other roots
        before, of = left.sum(), left[at]
        low, high = np.full(len(at), len(size)), np.full(len(at), -1)
        np.minimum.at(low, token[of], root[at[of]])
        np.maximum.at(high, token[of], root[at[of]])
        left &= np.bincount(at, (low < high)[token], len(size)) * LEAST.denominator >= LEAST.numerator * size
    links, two, marked = [], (side != side[0]).any(), np.zeros(len(at), dtype=np.int8)
    if not left.any():
        return links
    # of two rows of different roots one at least is not of the root with the most rows
    for a in np.flatnonzero(left & (root != np.bincount(root[left]).argmax())).tolist():
        left[a] = False
        fit = left & (root != root[a]) & (np.minimum(size, size[a]) * LEAST.denominator >= LEAST.numerator * np.maximum(size, size[a]))
        near = np.flatnonzero(fit & (side != side[a]) if two else fit)
        near = near[apart(x, near, a) <= distance]
        if not len(near):
            continue
        own, n = token[begin[a] : begin[a] + size[a]], size[near]
        first = np.cumsum(n) - n
        marked[own] = 1
        shared = np.add.reduceat(marked[token[np.repeat(begin[near] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        marked[own] = 0
        near = near[shared * LEAST.denominator >= LEAST.numerator * (n + size[a] - shared)]
        found, once = np.unique(root[near], return_index=True)
        links += [(a, b) for b in near[once].tolist()]
        root[np.isin(root, found)] = root[a]
    return links


def of_runs(cell: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links within runs of equal cells that join what all pairs within the distance would join."""
    run, end = runs_in(cell)
    size = np.diff(np.concatenate([[0], end]))
    a, b = near_pairs(x, run, end, distance)
    dense = np.bincount(run[a], minlength=len(size)) > PER_ROW * size
    kept = ~dense[run[a]]
    ones, others = [a[kept]], [b[kept]]
    for r in np.flatnonzero(dense | (size > SMALL)).tolist():
        begin = end[r] - size[r]
        p, q = np.array(forest(x[:, begin : end[r]], distance), dtype=np.int64).reshape(-1, 2).T
        ones.append(p + begin)
        others.append(q + begin)
    return np.concatenate(ones), np.concatenate(others)


def in_cells(rows: DataFrame, words: int, distance: int, most: int, connect: bool) -> DataFrame:
    """(a, b, d, cell, w0, ...) from rows (node, w0, ..., cell), dealt by cell here and staged.

    b not null: a link; d: its distance. Rows with b null pass through: those of a cell of more than ``most`` rows (d
    null), and the open ones (d 0). ``connect``: links that join what all would join, and none open.
    """
    names = [f"w{k}" for k in range(words)]
    columns = ["a", "b", "d", "cell", *names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 + words, 0), dtype=np.int64)
        passing: int | None = None

        def passed(rows: np.ndarray, d: int | None) -> pa.RecordBatch:
            n = rows.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(rows[1].copy()), pa.nulls(n, pa.int64()), pa.array([d] * n, pa.int32()), pa.array(rows[0].copy()), *[pa.array(w.copy()) for w in rows[2:]]], names=columns)

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            again = rows[0, 1:] == rows[0, :-1]
            rows = rows[:, np.concatenate([[False], again]) | np.concatenate([again, [False]])]
            if not rows.shape[1]:
                return
            x = rows[2:].view(np.uint64)
            if connect:
                a, b = of_runs(rows[0], x, distance)
            else:
                a, b, opened = offers(rows[0], x, distance)
                if opened.any():
                    yield passed(rows[:, opened], 0)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[1][a]), pa.array(rows[1][b]), pa.array(apart(x, a, b).astype(np.int32)), *[none] * (1 + words)], names=columns)

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("cell", "node", *names)])
            if passing is not None:
                n = int(np.searchsorted(rows[0] != passing, True)) if rows.shape[1] else 0
                if n:
                    yield passed(rows[:, :n], None)
                if n == rows.shape[1]:
                    continue
                rows, passing = rows[:, n:], None
            rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            if last:
                yield from linked(rows[:, :last])
            held = rows[:, last:]
            if held.shape[1] > most:
                yield passed(held, None)
                passing, held = int(held[0, 0]), held[:, :0]
        if held.shape[1] > 1:
            yield from linked(held)

    schema = "a long, b long, d int, cell long, " + ", ".join(f"{w} long" for w in names)
    dealt = rows.select("cell", "node", *names).repartition("cell").sortWithinPartitions("cell", "node")
    return staged(by_batch(dealt, work, schema), "cells")


def grid_join(points: DataFrame, words: list[str], masks: Masks, finer: Callable[[int], Masks], distance: int, connect: bool, hold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, d) links between the nodes of points (node and the named words, all distinct), repeats included; and the
    open rows (cell, node, w0, ...), none if ``connect``."""
    names = [f"w{k}" for k in range(len(words))]
    split = lambda rows, keys: rows.select("node", *names, F.explode(F.array(*keys)).alias("cell"))
    at = lambda m, of: [of(F.col(w)).bitwiseAND(F.lit(v)) for w, v in zip(names, m)]
    rows = points.select("node", *[F.col(c).alias(w) for c, w in zip(words, names)])
    rows = split(rows, [F.xxhash64(F.lit(g), *at(m, embedding)) for g, m in enumerate(masks)])
    met, opened, level = [], [], 0
    while True:
        found = in_cells(rows, len(words), distance, hold or HOLD, connect)
        met.append(found.where("b is not null").select("a", "b", "d"))
        opened.append(found.where("b is null and d = 0").select("cell", F.col("a").alias("node"), *names))
        more = found.where("b is null and d is null").select(F.col("a").alias("node"), "cell", *names)
        if more.isEmpty():
            return reduce(DataFrame.unionByName, met), reduce(DataFrame.unionByName, opened)
        level += 1
        rows = split(more, [F.xxhash64("cell", F.lit(g), *at(m, lambda c: c)) for g, m in enumerate(finer(level))])


def links(fps: DataFrame, distance: int = 3, hold: int | None = None) -> DataFrame:
    """(a, b) links between different fingerprints that connect all within ``distance`` bits; fps: distinct ``fp``."""
    points = fps.select(F.col("fp").alias("node"), "fp")
    return grid_join(points, ["fp"], grid_masks(fps.count(), distance), lambda level: band_choices(level, distance), distance, True, hold)[0].select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links of ``distance`` bits).

    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows give repeated rows. A null
    doc_id is kept; it names a component only if no member has an id. An empty table gives no rows.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "fps")
    first = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp")
    found = components(links(first.select("fp"), distance))
    return _named(fps, first, found, "fp").select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, first: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with component_id: the smallest first_id of the key's component."""
    grouped = first.join(found.withColumnRenamed("node", key), key, "left").select(key, "first_id", F.coalesce("root", key).alias("root"))
    # tables of their own, so that the joins can split the rows of a large group
    grouped = staged(grouped, "grouped")
    lowest = staged(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    named = staged(grouped.join(lowest, "root").select(key, "component_id"), "named")
    return rows.join(named, key)


def shingled(text: str) -> tuple[int, np.ndarray]:
    """(name, sorted different hashes of word shingles) of a text, ASCII lower case; a short text is one shingle.

    The name is 63 bits of a hash of the words; the lowest bit is free.
    """
    words = text.encode().lower().split()
    h = np.array([xxhash.xxh64_intdigest(w, 11) for w in words], dtype=np.uint64)
    span = min(WORDS, len(h))
    if not span:
        return named(words), np.zeros(1, dtype=np.uint64)
    out = np.zeros(len(h) - span + 1, dtype=np.uint64)
    for i in range(span):
        out = out * FACTOR + h[i : len(h) - span + 1 + i]
    out ^= out >> np.uint64(32)
    out *= FACTOR
    return named(words), np.unique(out ^ out >> np.uint64(29))


def named(words: list[bytes]) -> int:
    return (xxhash.xxh64_intdigest(b" ".join(words), 7) & ~1) - (1 << 63)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, f0, f1): the name of a text's words and the 128-bit fingerprint of its set of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, words = [], []
            for t in texts_of(batch):
                name, own = shingled(t)
                more = own * np.uint64(0xD6E8FEB86659FD93)
                more ^= more >> np.uint64(32)
                nodes.append(name)
                words.append((votes(own), votes(more * FACTOR)))
            both = np.array(words, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "node", "f0", "f1"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, node long, f0 long, f1 long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items, n: their number) of the wanted nodes; the sieve keeps other texts out of the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve(wanted, "node"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            texts = texts_of(batch)
            for low in range(0, len(texts), 1000):
                part = texts[low : low + 1000]
                names = np.array([named(t.encode().lower().split()) for t in part], dtype=np.int64)
                _, once = np.unique(names, return_index=True)
                found = [shingled(part[k]) for k in once[members_of(bitmap, names[once])].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["node", "items"])

    return by_batch(docs.select("text"), work, "node long, items binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")).withColumn("n", F.octet_length("items") / 8)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is LEAST at least."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * LEAST.denominator >= LEAST.numerator * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs of nodes whose similarity is LEAST at least."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [alike(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in pair)) for pair in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    return staged(by_batch(both.select("a", "b", "x", "y"), work, "a long, b long"), "verified")


def similar(docs: DataFrame, hold: int | None = None) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over links of similarity LEAST or more.

    Texts with the same words link; null counts as no words. Links are never wrong, but a pair at the limit shares a
    cell with the chance FOUND only (README has the measured recall); pairs that share one are all verified, unless
    other links join them already. Texts of one fingerprint are searched through one of them. Each text is verified
    against its nearest partner first, then offers between components are, then what open cells hold of several.
    Whole texts of any length; repeated rows give repeated rows; other columns are not read.
    """
    rows = staged(sketches(docs), "sketches")
    first = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("f0").alias("f0"), F.min("f1").alias("f1")), "first")
    points = staged(first.groupBy("f0", "f1").agg(F.min("node").alias("node")), "points")
    equal = first.join(points.withColumnRenamed("node", "b"), ["f0", "f1"]).where("node <> b").select(F.col("node").alias("a"), "b", F.lit(0).alias("d"))
    most = math.floor(WIDTH * flip_rate() + 3.6 * math.sqrt(WIDTH * flip_rate() * (1 - flip_rate())))
    met, opened = grid_join(points, ["f0", "f1"], random_choices(points.count()), random_bits, most, False, hold)
    pairs = staged(_pairs(met.unionByName(equal)), "pairs")
    wanted = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(opened.select("node")).distinct(), "wanted")
    sets = staged(sets_of(docs, wanted), "sets")
    ends = pairs.select("a", "b", "d").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = ends.groupBy("a").agg(F.min(F.struct("d", "b")).alias("n")).select(F.least("a", "n.b").alias("a"), F.greatest("a", "n.b").alias("b"))
    found = components(verified(staged(best.distinct(), "best"), sets))
    found = _joined(found, verified(staged(_between(pairs, found).select("a", "b"), "rest"), sets))
    found = _joined(found, within_cells(opened, found, sets, most))
    return _named(rows.select("doc_id", "node"), first.select("node", "first_id"), found, "node").select("doc_id", "component_id")


def within_cells(opened: DataFrame, found: DataFrame, sets: DataFrame, distance: int) -> DataFrame:
    """(a, b) links between components, from the rows (cell, node, w0, w1) of open cells: they connect what all similar
    pairs within the distance that share a cell connect.

    A cell of more than BLOCK shingles is cut into blocks, and each two of them are a key that one task compares.
    """

    def linked(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        if not parts:
            return []
        rows = pa.Table.from_batches(parts)
        node, root, side, *x = (rows.column(c).to_numpy() for c in ("node", "root", "side", "w0", "w1"))
        if (root == root[0]).all():
            return []
        items = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.column("items")]
        return [(int(node[a]), int(node[b])) for a, b in joining(np.stack(x).view(np.uint64), root, side, items, distance)]

    def of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key, links, begin = batch.column("key").to_numpy(), [], 0
            for end in runs_in(key)[1].tolist() if len(key) else []:
                if held and held[0].column("key")[0].as_py() != key[begin]:
                    links += linked(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                begin = end
            yield of(links)
        yield of(linked(held))

    rooted = opened.join(found.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = staged(rooted.join(sets.select("node", "n"), "node"), "rooted")
    cells = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    mixed = rooted.join(cells.where("low <> high").select("cell", "blocks"), "cell").withColumn("side", F.pmod(F.xxhash64("node"), "blocks"))
    keys = mixed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = keys.withColumn("key", F.xxhash64("cell", F.least("side", "other"), F.greatest("side", "other"))).select("key", "node", "root", "side", "w0", "w1")
    dealt = keys.join(sets.select("node", "items"), "node").select("key", "node", "root", "side", "w0", "w1", "items")
    return staged(by_batch(dealt.repartition("key").sortWithinPartitions("key", "node"), work, "a long, b long"), "joining")


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair once, with its distance."""
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) with further links between them, of which there are few: only roots are joined anew."""
    if links.isEmpty():
        return found
    above = components(_between(links, found).select(F.col("p").alias("a"), F.col("q").alias("b"))).withColumnRenamed("root", "top")
    lifted = found.join(above.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(found.select("node"), "node", "left_anti").select("node", F.col("top").alias("root"))
    return staged(lifted.unionByName(fresh), "found")


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components, with their roots p and q."""
    rooted = pairs.join(found.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left")
    return rooted.withColumns({"p": F.coalesce("p", "a"), "q": F.coalesce("q", "b")}).where("p <> q")


def keep_first(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = similar) -> DataFrame:
    """docs without the rows that have a near-duplicate with a smaller doc_id in their group; columns stay.

    groups gives (doc_id, component_id). Ids are expected to be unique: rows that share an id stand or fall together.
    Rows with a null id stay.
    """
    gone = groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
