"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of those its hash and the hashes of its beginnings lead to; filters of several widths slide over them, each filter keeps its maximum over the
whole text, and a logistic layer joins them. Only the score decides what the text is like; thresholds for a verdict
are calibrated by language on documents that were not fitted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, staged, texts_of
from .labelled import dealt

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 16
#: Fitted documents that must hold a bucket for it to have an embedding; others are the zero vector.
LEAST_DOCS = 3


def buckets(text: str) -> np.ndarray:
    """For each word of a whole text its hash and those of its first four and five bytes; bucket 0 is for padding."""
    words = WORD.findall(text.encode().lower())
    keys = [words, [b"4" + w[:4] for w in words], [b"5" + w[:5] for w in words]]
    return np.stack([np.fromiter(map(zlib.crc32, k), dtype=np.uint32, count=len(k)) for k in keys], axis=1).astype(np.int64) % (BUCKETS - 1) + 1


@dataclass
class Model:
    """embedding[bucket], filters[width][offset, dim, filter], bias by width, output weights; thresholds by language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    threshold: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        """What each bucket adds at each offset of each filter: (width-offset pair, bucket, filter)."""
        return np.stack([self.embedding @ f[j] for f in self.filters for j in range(len(f))]).astype(np.float32)


def joined(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All runs, each with padding behind it (one text is never empty), and their starts."""
    pad = np.zeros((max(WIDTHS), 3), dtype=np.int64)
    starts = np.cumsum([0] + [len(r) + len(pad) for r in runs])
    return np.concatenate([x for r in runs for x in (r, pad)] + [pad]), starts


def scores(model: Model, table: np.ndarray, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    ids, starts = joined([buckets(t) for t in texts])
    n = int(starts[-1]) + 1
    out, pair = np.full(len(texts), model.out_bias), 0
    for k, (width, bias) in enumerate(zip(WIDTHS, model.bias)):
        conv = np.zeros((n, FILTERS), dtype=np.float32)
        for j in range(width):
            for kind in range(3):
                conv += table[pair + j].take(ids[j : n + j, kind], axis=0)
        pair += width
        # windows that begin in a text or its padding and end there
        own = np.stack([starts[:-1], starts[1:] - width + 1], axis=1).ravel()
        top = np.maximum.reduceat(conv, own, axis=0)[::2] + bias
        out += np.maximum(top, 0) @ model.out[k * FILTERS : (k + 1) * FILTERS]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


@dataclass
class Slopes:
    """Gradients of the mean log loss of some texts: of the embedding's touched rows, the filters, biases and output."""

    rows: np.ndarray
    pull: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float


def gradients(model: Model, runs: list[np.ndarray], y: np.ndarray) -> Slopes:
    flat, starts = joined(runs)
    n = int(starts[-1])
    x = model.embedding[flat].sum(axis=1)
    places, tops = [], []
    for f, bias in zip(model.filters, model.bias):
        conv = sum(x[j : n + j] @ f[j] for j in range(len(f)))
        place = np.stack([conv[a : b - len(f) + 1].argmax(axis=0) + a for a, b in zip(starts[:-1], starts[1:])])
        places.append(place)
        tops.append(np.take_along_axis(conv, place, axis=0) + bias)
    pooled = np.maximum(np.concatenate(tops, axis=1), 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
    slope = (p - y) / len(runs)
    back = slope[:, None] * model.out[None, :] * (pooled > 0)
    grads_f, grads_b, touched, pulls = [], [], [], []
    for k, f in enumerate(model.filters):
        g, place = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
        grads_b.append(g.sum(axis=0))
        grads_f.append(np.stack([np.einsum("bf,bfd->df", g, x[place + j]) for j in range(len(f))]))
        for j in range(len(f)):
            touched.append(flat[place + j].ravel())
            pulls.append(np.repeat((g[:, :, None] * f[j].T[None]).reshape(-1, DIM), 3, axis=0))
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    pull = np.zeros((len(rows), DIM))
    np.add.at(pull, inverse, np.concatenate(pulls))
    return Slopes(rows, pull, grads_f, grads_b, pooled.T @ slope, float(slope.sum()))


def begun(seen: np.ndarray, base: float, rng: np.random.Generator) -> Model:
    """The model before the first step: seen counts the fitted documents that hold a bucket, base is the share of 1."""
    base = float(np.clip(base, 1e-4, 1 - 1e-4))
    return Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)) * living(seen)[:, None],
        [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)),
        float(np.log(base / (1 - base))),
    )


def living(seen: np.ndarray) -> np.ndarray:
    live = seen >= LEAST_DOCS
    live[0] = False
    return live


def bucket_counts(ids: list[np.ndarray]) -> np.ndarray:
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for r in ids:
        seen[np.unique(r)] += 1
    return seen


def fit(texts: list[str], y: np.ndarray, epochs: int = 5, rate: float = 0.01, seed: int = 7, size: int = 32) -> Model:
    """Adam on the log loss; without both classes every score is the base rate."""
    rng = np.random.default_rng(seed)
    ids = [buckets(t) for t in texts]
    seen = bucket_counts(ids)
    model = begun(seen, y.mean() if len(y) else 0.0, rng)
    if len(set(y.tolist())) < 2:
        model.out[:] = 0
        return model
    return stepped(model, living(seen), ids, y, rng, epochs, rate, size)


def stepped(model: Model, live: np.ndarray, ids: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int, rate: float = 0.01, size: int = 32) -> Model:
    """The model after Adam has gone over the texts, in place."""
    weights = [model.embedding, *model.filters, *model.bias, model.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    bias_moments, step = [0.0, 0.0], 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for low in range(0, len(order), size):
            pick = order[low : low + size]
            s = gradients(model, [ids[i] for i in pick], y[pick])
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in enumerate([s.pull * live[s.rows][:, None], *s.filters, *s.bias, s.out]):
                at = s.rows if k == 0 else slice(None)
                first[k][at] = 0.9 * first[k][at] + 0.1 * g
                second[k][at] = 0.999 * second[k][at] + 0.001 * g * g
                weights[k][at] -= rate * fix * first[k][at] / (np.sqrt(second[k][at]) + 1e-8)
            g = s.out_bias
            bias_moments = [0.9 * bias_moments[0] + 0.1 * g, 0.999 * bias_moments[1] + 0.001 * g * g]
            model.out_bias -= rate * fix * bias_moments[0] / (np.sqrt(bias_moments[1]) + 1e-8)
    return model


def packed(model: Model) -> np.ndarray:
    """All weights in one row."""
    return np.concatenate([x.ravel() for x in (model.embedding, *model.filters, *model.bias, model.out, np.array([model.out_bias]))])


def unpacked(flat: np.ndarray) -> Model:
    shapes = [(BUCKETS, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (FILTERS * len(WIDTHS),)]
    edges = np.cumsum([0, *map(math.prod, shapes)])
    x = [flat[a:b].reshape(s).copy() for a, b, s in zip(edges, edges[1:], shapes)]
    k = len(WIDTHS)
    return Model(x[0], x[1 : 1 + k], x[1 + k : 1 + 2 * k], x[-1], float(flat[-1]))


def cut(rows: DataFrame) -> DataFrame:
    """(part, ids, y): texts as buckets, two bytes each, so that no epoch cuts them again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([buckets(t).astype(np.uint16).tobytes() for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("part"), ids, batch.column("y")], names=["part", "ids", "y"])

    return staged(by_batch(rows.select("part", "text", "y"), work, "part int, ids binary, y int"), "buckets")


#: Pieces in which models are added up.
PIECES = 16


def added(rows: DataFrame, of_part: Callable[[int, list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over parts of a row of numbers that a part's texts (as buckets) and labels give. Each task holds one part;
    the pieces are added by Spark, so the driver gets one row whatever the number of parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, y = None, [], []

        def made() -> Iterator[pa.RecordBatch]:
            if ids:
                pieces = np.array_split(of_part(part, ids, np.array(y, dtype=np.float64)), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([p.astype(np.float64).tobytes() for p in pieces], pa.binary())], names=["piece", "x"])

        for batch in batches:
            for k, run, label in zip(batch.column("part").to_pylist(), batch.column("ids"), batch.column("y").to_pylist()):
                if k != part:
                    yield from made()
                    part, ids, y = k, [], []
                ids.append(np.frombuffer(run.as_buffer(), dtype=np.uint16).reshape(-1, 3))
                y.append(label)
        yield from made()

    def total(key: tuple, table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(v.as_buffer(), dtype=np.float64) for v in table.column("x"))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([out.tobytes()], pa.binary())})

    each = by_batch(rows.select("part", "ids", "y"), work, "piece int, x binary")
    got = each.groupBy("piece").applyInArrow(total, "piece int, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"], dtype=np.float64) for r in sorted(got, key=lambda r: r["piece"])])


#: Cuts that are tried for a threshold: scores are counted in so many steps.
STEPS = 10_000


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, hits, cut) of rows (lang, score, y): the cut with the best F1, null without both classes; null lang: all."""
    step = F.floor(F.col("score") * STEPS)
    counts = scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high"))
    every = counts.groupBy(F.lit(None).cast("string").alias("lang"), "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    both = counts.where("lang <> ''").unionByName(every)
    down = Window.partitionBy("lang").orderBy(F.desc("step"))  # at most STEPS + 1 rows
    all_ = Window.partitionBy("lang")
    found = both.select("lang", F.sum("n").over(down).alias("taken"), F.sum("hits").over(down).alias("right"), F.sum("hits").over(all_).alias("hits"), F.sum("n").over(all_).alias("rows"), ((F.col("low") + F.coalesce(F.lead("high").over(down), F.lit(0.0))) / 2).alias("cut"))
    f1 = 2 * F.col("right") / (F.col("taken") + F.col("hits"))
    best = found.groupBy("lang").agg(F.first("hits").alias("hits"), F.first("rows").alias("rows"), F.max_by("cut", F.struct(f1, -F.col("taken"))).alias("cut"))
    return best.select("lang", "hits", F.when((F.col("hits") > 0) & (F.col("hits") < F.col("rows")), F.col("cut")).alias("cut"))


def train(docs: DataFrame, labels: DataFrame, calibration: float = 0.2, epochs: int = 5, seed: int = 7) -> Model:
    """Fit on all of labels.toxic (never those with crc32 mod 4 = 2); calibrate on a part kept aside.

    Up to labelled.PART documents make one part, which a task fits as ``fit`` does. More are parts of that size: in each
    epoch every part goes on from the common model, and their mean, weighed by their documents, is the next one.
    """
    rows, parts = dealt(docs, labels, "toxic", 4, 2)
    aside = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % 1000 < 1000 * calibration
    own = cut(rows.where(~aside))
    known = own.agg(F.count("*").alias("n"), F.sum("y").alias("hits")).first()
    n, hits = known["n"], known["hits"] or 0
    seen = added(own, lambda part, ids, y: bucket_counts(ids).astype(np.float64)).astype(np.int64) if n else np.zeros(BUCKETS, dtype=np.int64)
    model = begun(seen, hits / n if n else 0.0, np.random.default_rng(seed))
    if not 0 < hits < n:
        model.out[:] = 0
        return calibrated(model, rows.where(aside))
    live = living(seen)
    for epoch in range(1 if parts == 1 else epochs):
        sent = docs.sparkSession.sparkContext.broadcast(packed(model))

        def further(part: int, ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
            rng = np.random.default_rng([seed, epoch, part])
            return packed(stepped(unpacked(sent.value), live, ids, y, rng, epochs if parts == 1 else 1)) * len(ids)

        model = unpacked(added(own, further) / n)
        sent.destroy()
    return calibrated(model, rows.where(aside))


def calibrated(model: Model, aside: DataFrame) -> Model:
    """The model with its thresholds: the common one, and those of languages with ten toxic documents or more."""
    sent = aside.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(batch_scores(sent.value, table, texts_of(batch)), pa.float64()), batch.column("y")], names=["lang", "score", "y"])

    for r in thresholds(by_batch(aside.select("text", "lang", "y"), work, "lang string, score double, y int")).collect():
        if r["lang"] is None:
            model.threshold = r["cut"] or 0.5
        elif r["hits"] >= 10 and r["cut"]:
            model.by_lang[r["lang"]] = r["cut"]
    return model


def chunks(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each; a longer text stands alone."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield low, k
            low, size = k, 0
        size += len(t)
    if texts:
        yield low, len(texts)


def batch_scores(model: Model, table: np.ndarray, texts: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(scores(model, table, texts[a:b]) for a, b in chunks(texts))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, threshold, toxic) of every row; null text is scored as the empty text, repeats as often as stored,
    null ids as they come. Texts of any length are pooled whole. Equal maxima count once. Other columns are not read,
    whatever their names; an empty table gives no rows.

    toxic is the calibrated verdict: score >= threshold of the document's language, or the common one for languages
    that had too few toxic documents to calibrate. The model has a fixed size, whatever the number of documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.table()
        for batch in batches:
            cut = np.array([own.by_lang.get(x, own.threshold) for x in batch.column("lang").to_pylist()], dtype=np.float64)
            value = batch_scores(own, table, texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(cut), pa.array(value >= cut)], names=["doc_id", "score", "threshold", "toxic"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")), work, "doc_id long, score double, threshold double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score reaches the threshold of their language; columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.table()
        for batch in batches:
            cut = np.array([own.by_lang.get(x, own.threshold) for x in batch.column("lang").to_pylist()], dtype=np.float64)
            yield batch.filter(pa.array(batch_scores(own, table, texts_of(batch)) < cut))

    return by_batch(docs, work, docs.schema)
