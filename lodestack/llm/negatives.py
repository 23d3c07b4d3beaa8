"""Hard negatives of anchors by bit-sliced integer products.

Vectors of integers are packed: a chunk is one row with the ids, labels and components of up to CHUNK vectors, a block
the same of up to BLOCK anchors. A chunk's components are cut into bit-planes (two's complement). The product of an
anchor with a plane is a sum over the components whose bit is set, so the planes are processed most significant first:
after each, a score is known to lie in an interval whose width halves, and pairs whose interval can no longer reach
what is asked for are dropped. Many open pairs are taken as one matrix product for each plane, few one by one.

Anchors meet all vectors in a grid of tasks: blocks fall into bands, chunks into groups, and the two are joined by the
(band, group) key that both are copied to. A task keeps the best of each anchor over the chunks it has seen, which
tightens the next intervals, and gives a bounded number of rows for each anchor; a window over those ends the search.
Nothing passes through the driver but counts. The work is anchors x vectors, as the task asks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, forget, staged

#: Vectors in one chunk and anchors in one block at most.
CHUNK, BLOCK = 1024, 2048
#: Anchors that share a copy of the vectors; groups of chunks at most, each with a copy of the anchors.
BAND, GROUPS = 65_536, 128
#: Components are below 2^BITS (beside the sign), so that every score fits a long.
BITS = 23
#: Share of open pairs below which they are taken one by one, and how many of them at a time.
SPARSE, PAIRS = 0.1, 32_768
#: Blocks whose best a worker keeps at a time.
HELD = 64
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

NUMBERS, BINARIES = ["first", "n", "dims", "width"], ["ids", "labels", "keys", "vecs", "low", "high"]


def _matrix(column: pa.Array, wide: int | None = None) -> np.ndarray:
    """Lists as rows, filled with zeros."""
    counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    d = int(counts.max(initial=0)) if wide is None else wide
    out = np.zeros((len(counts), d), dtype=np.int64)
    out[np.arange(d)[None, :] < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def packed(rows: DataFrame, size: int, windows: int = 0) -> DataFrame:
    """Rows (id, label, vec, key, and lists low and high of ``windows`` numbers) as they come, up to size in one, sorted by label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                label = part.column("label").to_numpy().astype(np.int64)
                by = np.argsort(label, kind="stable")
                ids, keys, vec = part.column("id").to_numpy()[by], part.column("key").to_numpy()[by], _matrix(part.column("vec"))[by]
                width = 2 if np.abs(vec).max(initial=0) < 1 << 15 else 4
                asked = [_matrix(part.column(c), windows)[by] if windows else vec[:0] for c in ("low", "high")]
                numbers = [int(keys[0]), len(ids), vec.shape[1], width]
                wholes = [x.tobytes() for x in (ids, label[by], keys, vec.astype(f"i{width}"), *asked)]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in numbers] + [pa.array([v], pa.binary()) for v in wholes], names=NUMBERS + BINARIES)

    return by_batch(rows, work, ", ".join([f"{c} long" for c in NUMBERS] + [f"{c} binary" for c in BINARIES]))


class Pack:
    """A row of ``packed`` as arrays."""

    def __init__(self, batch: pa.RecordBatch, at: int, prefix: str):
        value = {c: batch.column(prefix + c)[at] for c in NUMBERS + BINARIES}
        n, dims, width = (value[c].as_py() for c in ("n", "dims", "width"))
        whole = lambda name, kind=np.int64: np.frombuffer(value[name].as_buffer(), dtype=kind)
        self.ids, self.labels, self.keys = whole("ids"), whole("labels"), whole("keys")
        self.vec = whole("vecs", f"i{width}").reshape(n, dims)
        self.low, self.high = (whole(c).reshape(n, -1) for c in ("low", "high"))

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(label, begin, end)."""
        edge = [0, *(np.flatnonzero(self.labels[1:] != self.labels[:-1]) + 1).tolist(), len(self.labels)]
        return zip(self.labels[edge[:-1]].tolist(), edge[:-1], edge[1:])

    def run(self, label: int) -> tuple[int, int]:
        begin, end = np.searchsorted(self.labels, [label, label + 1])
        return int(begin), int(end)


#: Weight, what all later planes have together at most, and the bits as numbers.
Plane = tuple[int, int, np.ndarray]


def planes_of(vec: np.ndarray) -> list[Plane]:
    """The bit-planes of integer vectors in two's complement, most significant first."""
    v = vec.astype(np.int64)
    top = int(np.abs(v).max(initial=0)).bit_length()
    bits = [v < 0, *(v >> b & 1 for b in range(top - 1, -1, -1))]
    return [(-(1 << top) if k == 0 else 1 << top - k, (1 << top - k) - 1, bit.astype(np.float32)) for k, bit in enumerate(bits)]


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LOWEST, dtype=np.int64)
        self.ids = np.full((n, k), HIGHEST, dtype=np.int64)

    def least(self) -> np.ndarray:
        """Scores below this are no longer asked for (an equal one may have a smaller id)."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fit = score >= self.least()[query]
        if not fit.any():
            return
        own, again = np.unique(query[fit], return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(own)), self.k), again])
        s, i = np.concatenate([self.score[own].ravel(), score[fit]]), np.concatenate([self.ids[own].ravel(), ids[fit]])
        by = np.lexsort((i, ~s, q))
        q, s, i = q[by], s[by], i[by]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < self.k
        self.score[own], self.ids[own] = s[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, at = np.nonzero(self.score > LOWEST)
        return query, self.score[query, at], self.ids[query, at]


def qualifying(vec: np.ndarray, planes: list[Plane], columns: np.ndarray, low: np.ndarray, high: np.ndarray | None, barred: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, vector, score) of the pairs of an anchor and a vector of ``columns`` whose score lies in the anchor's low..high.

    high None: no upper end, and what is asked for are the k best of each anchor (and all that tie); low then rises to
    the k-th best lower end of the intervals. barred: pairs (anchor, place in columns) that do not count.
    """
    a = vec.astype(np.int64)
    least, most = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    size = min(4 * int((most - least).max(initial=0)) * (planes[0][1] + 1) + 4, 1 << 62)
    # integers below 2^24 or 2^53 are exact in floats, whose matrix products are fast
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64
    exact = lambda x: np.clip(x, -size, size).astype(kind)  # noqa: E731  ends of intervals are within size
    a, least, most, low = exact(a), exact(least), exact(most), exact(low)
    high = None if high is None else exact(high)
    part = np.zeros((len(a), len(columns)), dtype=kind)
    alive = np.ones(part.shape, dtype=bool)
    if barred is not None:
        alive[barred] = False
    out = alive.copy()
    later = list(planes)
    while later:
        weight, rest, bits = later.pop(0)
        part += kind(weight) * (a @ bits[columns].astype(kind, copy=False).T)
        top = part + (rest * most)[:, None]
        if high is None and len(columns) >= k:
            sure = np.where(out, part + (rest * least)[:, None], kind(-size))
            low = np.maximum(low, np.partition(sure, len(columns) - k, axis=1)[:, len(columns) - k])
        alive &= top >= low[:, None]
        if high is not None:
            alive &= part + (rest * least)[:, None] <= high[:, None]
        open_ = alive.any(axis=0)
        if 2 * open_.sum() < len(open_):
            columns, part, alive, out = columns[open_], part[:, open_], alive[:, open_], out[:, open_]
        if alive.sum() <= SPARSE * alive.size:
            break
    one, other = np.nonzero(alive)
    score, other = part[one, other], columns[other]
    found = []
    for begin in range(0, len(one), PAIRS):
        i, j, s = (x[begin : begin + PAIRS] for x in (one, other, score))
        for weight, rest, bits in later:
            s = s + kind(weight) * np.einsum("nd,nd->n", a[i], bits[j].astype(kind, copy=False))
            fit = s + rest * most[i] >= low[i]
            if high is not None:
                fit &= s + rest * least[i] <= high[i]
            i, j, s = i[fit], j[fit], s[fit]
        found.append((i, j, s.astype(np.int64)))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found)) if found else (none, none, none)


def equal_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of equal ids."""
    by = np.argsort(y, kind="stable")
    low, high = (np.searchsorted(y[by], x, side=side) for side in ("left", "right"))
    count = high - low
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(x)), count), by[np.repeat(low, count) + inner]


def nearest_alike(block: Pack, chunk: Pack, planes: list[Plane], best: Best) -> None:
    """Best other vectors of the same label for each anchor."""
    for label, begin, end in block.runs():
        low, high = chunk.run(label)
        if low < high:
            own = np.arange(low, high)
            i, j, s = qualifying(block.vec[begin:end], planes, own, best.least()[begin:end], None, equal_pairs(block.ids[begin:end], chunk.ids[own]), best.k)
            best.add(i + begin, s, chunk.ids[j])


def windowed_unlike(block: Pack, chunk: Pack, planes: list[Plane], best: Best) -> None:
    """Best vectors of other labels in each window of each anchor."""
    windows = block.low.shape[1]
    valid = block.low <= block.high
    for label, begin, end in block.runs():
        low, high = chunk.run(label)
        others = np.concatenate([np.arange(low), np.arange(high, len(chunk.ids))])
        own = slice(begin, end)
        floor = np.maximum(block.low[own], best.least().reshape(-1, windows)[own])
        least, most = np.where(valid[own], floor, HIGHEST).min(axis=1), np.where(valid[own], block.high[own], LOWEST).max(axis=1)
        i, j, s = qualifying(block.vec[own], planes, others, least, most, None, best.k)
        for w in range(windows):
            fit = (s >= block.low[begin + i, w]) & (s <= block.high[begin + i, w])
            best.add((begin + i[fit]) * windows + w, s[fit], chunk.ids[j[fit]])


def searched(blocks: DataFrame, chunks: DataFrame, groups: int, bands: int, k: int, windows: int = 0) -> DataFrame:
    """(key, slot, score, id, rank): the k best of each anchor (windows 0) or of each of its windows, over all chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Best]] = {}

        def done(first: int) -> pa.RecordBatch:
            keys, best = held.pop(first)
            query, score, ids = best.rows()
            at, slot = np.divmod(query, max(1, windows))
            return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(ids)], names=["key", "slot", "score", "id"])

        seen, planes = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                first, block, chunk = batch.column("b_first")[at].as_py(), Pack(batch, at, "b_"), Pack(batch, at, "c_")
                dims = min(block.vec.shape[1], chunk.vec.shape[1])  # beyond it one of the two is zero
                block.vec = block.vec[:, :dims]
                if (mark := (int(chunk.keys[0]), dims)) != seen:
                    seen, planes = mark, planes_of(chunk.vec[:, :dims])
                if first not in held:
                    if len(held) == HELD:
                        yield done(next(iter(held)))
                    held[first] = block.keys.copy(), Best(len(block.ids) * max(1, windows), k)
                (windowed_unlike if windows else nearest_alike)(block, chunk, planes, held[first][1])
        while held:
            yield done(next(iter(held)))

    key = lambda n: F.pmod(F.xxhash64("first"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = lambda df, p: df.select("band", "group", *[F.col(c).alias(p + c) for c in NUMBERS + BINARIES]).repartition(groups * bands, "band", "group")
    left = blocks.withColumn("band", key(bands)).withColumn("group", every(groups))
    right = chunks.withColumn("group", key(groups)).withColumn("band", every(bands))
    met = by_batch(named(left, "b_").join(named(right, "c_"), ["band", "group"]).drop("band", "group"), work, "key long, slot int, score long, id long")
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(points: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of points where ``anchor`` holds.

    points: id long, label int, vec array of integers. A score is the inner product with the anchor; higher scores come
    first, ties by smaller id. positives are the best other rows of the anchor's label, negatives for each positive the
    best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null id, label, vector or component take no part, nor do those with a component of 2^BITS or more
    beside the sign. Of vectors of different lengths the shorter counts as filled with zeros; an empty one scores 0.
    Repeated rows count each, but a row is no positive of an anchor with the same id. Anchors without a positive and
    positives without a negative give no row, as do empty tables. Other columns are not read.
    """
    whole = F.forall("vec", lambda x: F.coalesce(x.between(1 - (1 << BITS), (1 << BITS) - 1), F.lit(False)))
    chosen = points.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "vec", anchor.alias("anchor"))
    rows = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(whole, F.lit(False))).withColumn("key", F.monotonically_increasing_id())
    chunks = staged(packed(rows.select("id", "label", "vec", "key"), CHUNK), "chunks")
    anchors = staged(rows.where("anchor").select("id", "label", "vec", "key"), "anchors")
    total, count = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], anchors.count()
    groups, bands = max(1, min(GROUPS, math.ceil(total / CHUNK))), max(1, math.ceil(count / BAND))
    tasks = max(1, math.ceil(count / BLOCK))
    alike = staged(searched(packed(anchors.repartition(tasks, "key"), BLOCK), chunks, groups, bands, positives), "alike")
    # the windows of a positive score p: low * p / 100 rounded up to high * p / 100 rounded down, without overflow
    rest = F.pmod("score", F.lit(100))
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    end = lambda share, up: hundreds * share + F.floor((rest * share + up) / 100)
    asked = alike.select("key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), end(low, 99).alias("low"), end(high, 0).alias("high"))
    slots = asked.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("low", "high")))).alias("w"))
    every = F.sequence(F.lit(1), F.lit(positives))
    of = lambda name, none: F.transform(every, lambda r: F.coalesce(F.try_element_at("w", r)[name], F.lit(none).cast("long"))).alias(name)
    windowed = anchors.join(slots, "key").select("id", "label", "vec", "key", of("low", 1), of("high", 0))
    blocks = staged(packed(windowed.repartition(tasks, "key"), BLOCK, positives), "blocks")
    found = searched(blocks, chunks, groups, bands, negatives, positives)
    named = asked.select("key", (F.col("rank") - 1).alias("slot"), "positive_id", "positive_score").join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    out = found.select("key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["key", "slot"])
    out = staged(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    forget(chunks, anchors, alike, blocks)
    return out


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, vec) with vec = floor(scale * x) of each component as a double; a vector with a null or non-finite component becomes null."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.when(whole, parts).alias("vec"))
