"""Document fingerprints by I-Match: hashes of the terms whose inverse document frequency lies in a band.

Document frequencies are counted over all documents. The terms of the band are the lexicon; at most
(mean number of different terms of a document) x e^high terms can be in it, whatever the number of documents, so it goes
to the workers as sorted hashes, or beyond EXACT terms as a bitmap of fixed size that lets a few other terms in.

A fingerprint hashes a text's sorted different lexicon terms as a whole, and again within randomised subsets of the
lexicon: COPIES draws, each thinned to a half, a quarter, ... The whole agrees for texts of the same terms; a small
subset agrees where an edit has left its few terms alone, so the share of agreeing subsets tells how alike two texts are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, members_of, sieve, staged, texts_of
from .decontam import WORD
from .resample import words

#: The band: idf is ln(documents / documents with the term).
BAND = (3.0, 8.5)
#: A text with fewer lexicon terms takes all its terms.
LEAST_TERMS = 4
#: Draws of lexicon subsets, and how often each is halved.
COPIES, LEVELS = 24, 12
#: Lexicon terms that are sent as they are.
EXACT = 1 << 22
#: Texts that are hashed together.
SLICE = 500
#: Share of a level's subsets that may be filled for the level to count in likeness.
SPARSE = 0.75

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms of the band; a two-dimensional bitmap where they are more than EXACT."""
    total = docs.count()
    each = docs.select(F.explode(F.array_distinct(words(F.col(text_col)))).alias("term")).select(F.xxhash64("term").alias("term"))
    low, high = (total * math.exp(-x) for x in reversed(band))
    chosen = staged(each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).select("term"), "lexicon")
    if chosen.count() > EXACT:
        return sieve(chosen, "term")
    return np.sort(chosen.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def known(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the lexicon."""
    if terms.ndim == 2:
        out = np.zeros(len(hashes), dtype=bool)
        out[members_of(terms, hashes.view(np.int64))] = True
        return out
    if not len(terms):
        return np.zeros(len(hashes), dtype=bool)
    return terms[np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)] == hashes


def terms_of(text: str) -> np.ndarray:
    """Sorted hashes of a text's different words; a text without words is one term, the empty text has none."""
    found = set(WORD.findall(text.encode().lower())) or ({text.encode()} if text else set())
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), dtype=np.uint64, count=len(found)))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def hashed(texts: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole, subsets) of some texts: a 64-bit hash each, and 8 bits for each copy and level, 0 where it holds no term."""
    whole, subsets = np.zeros(len(texts), dtype=np.uint64), np.zeros((len(texts), COPIES, LEVELS), dtype=np.uint8)
    for begin in range(0, len(texts), SLICE):
        own = [terms_of(t) for t in texts[begin : begin + SLICE]]
        at, h = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.zeros(0, dtype=np.uint64), *own])
        keep = known(terms, h)
        keep |= (np.bincount(at[keep], minlength=len(own)) < LEAST_TERMS)[at]
        at, h = at[keep], h[keep]
        edge = np.searchsorted(at, np.arange(len(own) + 1))
        for k in range(len(own)):
            if edge[k] < edge[k + 1]:
                whole[begin + k] = xxhash.xxh64_intdigest(h[edge[k] : edge[k + 1]].tobytes(), 13)
        for c in range(COPIES):
            drawn, held = mixed(h, c + 1), at
            for level in range(LEVELS):
                fit = drawn < np.uint64(1 << 63 - level)
                drawn, held = drawn[fit], held[fit]
                if not len(held):
                    break
                start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
                total = mixed(np.add.reduceat(drawn, start), 77)
                subsets[begin + held[start], c, level] = np.maximum(total >> np.uint64(56), np.uint64(1)).astype(np.uint8)
    return whole, subsets


def written(whole: np.ndarray, subsets: np.ndarray) -> list[str]:
    """Fingerprints as hex digits: 16 of the whole, 2 of each subset."""
    return [f"{w:016x}{s.tobytes().hex()}" for w, s in zip(whole.tolist(), subsets)]


def parsed(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``written``."""
    whole = np.array([int(f[:16], 16) for f in fingerprints], dtype=np.uint64)
    return whole, np.array([np.frombuffer(bytes.fromhex(f[16:]), dtype=np.uint8) for f in fingerprints], dtype=np.uint8).reshape(-1, COPIES, LEVELS)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 if they are equal, else the share of agreeing subsets.

    Of the levels those count whose subsets are small, so that no more than SPARSE of them hold a term of either text;
    where none is, the last one counts. There a subset mostly has one term, and the share is near that of common terms.
    """
    filled = (a[1] > 0) | (b[1] > 0)
    some, same = filled.sum(axis=1), (filled & (a[1] == b[1])).sum(axis=1)
    counts = some <= SPARSE * COPIES
    counts[:, -1] |= (some * counts).sum(axis=1) == 0
    total = (some * counts).sum(axis=1)
    out = (same * counts).sum(axis=1) / np.maximum(total, 1)
    return np.where((a[0] == b[0]) & (a[1] == b[1]).all(axis=(1, 2)), 1.0, out)


def fingerprints(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, by the lexicon of docs or the given one.

    Whole texts of any length; null counts as empty, and the empty text's fingerprint is all zeros. Equal texts have
    equal fingerprints, also in repeated rows. An empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col=text_col) if terms is None else terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(written(*hashed(texts_of(batch), sent.value)), pa.string())], names=["doc_id", "fingerprint"])

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(ids: list[int | None], texts: list[str], following: list[str], own: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], terms: np.ndarray) -> list[pa.Array]:
    """The columns of documents, each with the one that follows it."""
    changed = [edited(t, n) for t, n in zip(texts, following)]
    other = hashed(changed, terms)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(written(*own), pa.string()),
        pa.array(written(*other), pa.string()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def with_edits(docs: DataFrame, band: tuple[float, float] = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its fingerprint beside that of its edited text, and how near it is to this and to the next document.

    Documents stand in descending order of doc_id, null last, repeated ids as they come; after the last comes the first
    (a single document follows itself). The edited text has the last third of its code points, rounded down, replaced by
    as many from the beginning of the next document. near_edited and near_next are ``likeness``; edited_sha256 is of the
    edited text. Rows are dealt by ranges of doc_id, so neighbours meet in one task but at the ranges' ends, whose rows
    are joined afterwards. Texts as in ``fingerprints``; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    sent: Broadcast[np.ndarray] = spark.sparkContext.broadcast(lexicon(docs, band, text_col))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([press(t.encode()) for t in texts_of(batch)], pa.binary())], names=["doc_id", "packed"])

    # whole texts are shuffled once; packed text by text they take a third less than the shuffle's own compression leaves
    rows = by_batch(chosen, squeezed, "doc_id long, packed binary").withColumn("row", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.asc("row")]
    names = [*COLUMNS, "end", "part", "text"]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        last: tuple[int | None, str, tuple[np.ndarray, np.ndarray]] | None = None

        def open_end(end: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            none = [pa.nulls(1, kind) for kind in kinds[1:]]
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *none, pa.array([end]), pa.array([part], pa.int32()), pa.array([text])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id").to_pylist(), [unpack(p.as_buffer()).decode() for p in batch.column("packed")]
            own = hashed(texts, sent.value)
            if last is None:
                yield open_end("first", ids[0], texts[0])
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], tuple(np.concatenate([x, y]) for x, y in zip(last[2], own))
            last = ids[-1], texts[-1], tuple(x[-1:] for x in own)
            n = len(ids) - 1
            found = compared(ids[:-1], texts[:-1], texts[1:], tuple(x[:-1] for x in own), tuple(x[1:] for x in own), sent.value)
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
        if last is not None:
            yield open_end("last", last[0], last[1])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = texts_of(batch), texts_of(batch, "following")
            found = compared(batch.column("doc_id").to_pylist(), texts, following, hashed(texts, sent.value), hashed(following, sent.value), sent.value)
            yield pa.RecordBatch.from_arrays(found, names=COLUMNS)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "packed")
    met = staged(by_batch(dealt, neighbours, f"{SCHEMA}, end string, part int, text string"), "neighbours")
    first = met.where("end = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    # the ranges' numbers alone pass through one task
    ranges = Window.orderBy("part")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = met.where("end = 'last'").select("part", F.coalesce(F.lead("part").over(ranges), F.first("part").over(whole)).alias("after"))
    ends = met.where("end = 'last'").select("doc_id", "text", "part").join(following, "part").join(first, "after").select("doc_id", "text", "following")
    return met.where("end is null").select(*COLUMNS).unionByName(by_batch(ends, across, SCHEMA))
