"""Line dedup by a segment-partition edit join.

Two lines within t edits share one of t + 1 segments of the shorter line, at nearly the same place. Every line is cut
into its segments (index entries), and for each length that a shorter partner may have, the substrings at the places
where a segment of that length could stand are probed. Places follow the multi-match-aware bounds: segment i has seen
at most i edits before it and at most t - i behind. Keys hold the length, the segment and the substring, so only lines
of compatible lengths meet.

No pairs are made: of each key that lines share, every line is a row that carries its text. The rows are sorted by key,
and each run gives a spanning forest of its links, verified by a banded bit-parallel edit distance. A run of more than
HOLD lines is not compared there; its lines pass through and are dealt again by parts of their signatures, of which
lines within two edits share enough. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, members_of, sieve, staged, texts_of
from .graph import components
from .simhash import band_choices, signed

#: Edits allowed at most, and characters of the shorter line for each edit.
EDITS, CHARS = 2, 20
#: Lines, and characters of them, that one run holds to be compared; beyond it they are dealt again.
HOLD, HOLD_CHARS = 20_000, 64_000_000
#: Times that lines are dealt again at most: then all bits of the signature have been used.
LEVELS = 12
SPACES = " \t\x0b\x0c\r"


def allowed(length: int) -> int:
    return min(EDITS, length // CHARS)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines that are not blank."""
    return [(k, s) for k, line in enumerate(text.split("\n")) if (s := line.strip(SPACES))]


def line_id(line: str) -> bytes:
    """128 bits of a hash: the name of all lines that are equal."""
    return xxhash.xxh3_128_digest(line.encode(), 5)


def short_id(line: str) -> int:
    """63 bits of a hash, to look lines up; the lowest bit is left free."""
    return (xxhash.xxh64_intdigest(line.encode(), 5) & ~1) - (1 << 63)


@lru_cache(4096)
def segments(length: int) -> list[tuple[int, int]]:
    """(start, size) of allowed + 1 even segments."""
    parts = allowed(length) + 1
    edge = [i * length // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


@lru_cache(4096)
def probes(length: int) -> list[tuple[int, int, int, int]]:
    """(partner's length, segment, start, size) to look up for a line, but for its own segments in place."""
    out = []
    for other in range(max(CHARS, length - EDITS), length + 1):
        t, gap = allowed(other), length - other
        if gap > t:
            continue
        for i, (start, size) in enumerate(segments(other)):
            low, high = max(start - i, start + gap - (t - i), 0), min(start + i, start + gap + (t - i), length - size)
            out += [(other, i, at, size) for at in range(low, high + 1) if gap or at != start]
    return out


def keys_of(line: str) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) of a line; none if it is too short for an edit."""
    n = len(line)
    if not allowed(n):
        return [], []
    digest = xxhash.xxh64_intdigest
    own = [digest(line[a : a + size].encode(), n << 2 | i) for i, (a, size) in enumerate(segments(n))]
    return own, [digest(line[a : a + size].encode(), other << 2 | i) for other, i, a, size in probes(n)]


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is k at most: k + 1 bit vectors over the 2k + 1 diagonals of the band.

    Bit k + d of vector e: the first j characters of b and j + d of a can be matched with e edits.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    start, end = 0, len(a)
    while start < end and a[start] == b[start]:
        start += 1
    while end > start and a[end - 1] == b[end - 1 + len(b) - len(a)]:
        end -= 1
    a, b = a[start:end], b[start : end + len(b) - len(a)]
    if not a or not b:
        return len(b) + len(a) <= k
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i + k
    full = (1 << 2 * k + 1) - 1
    rows = [((1 << e + 1) - 1) << k & full for e in range(k + 1)]
    for j, c in enumerate(b):
        match = place.get(c, 0) >> j & full
        last, before = 0, 0
        for e in range(k + 1):
            now = rows[e] & match
            if e:
                now |= before | before >> 1 | last << 1 & full
            before, last = rows[e], now
            rows[e] = now
        if not rows[k]:
            return False
    return bool(rows[k] >> k + len(a) - len(b) & 1)


def close(a: str, b: str) -> bool:
    k = allowed(min(len(a), len(b)))
    return k > 0 and within(a, b, k)


#: Bits of the signature that one edit flips at most.
FLIPS = 4


def signature(line: str) -> int:
    """Parity of hashed character pairs in 64 bits."""
    raw = line.encode("utf-32-le")
    c = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    pair = (c[:-1] * np.uint64(0x9E3779B1) + c[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)
    return int(np.packbits(np.bincount(pair.astype(np.int64), minlength=64) & 1 == 1, bitorder="little").view("<u8")[0])


def forest(texts: list[str]) -> list[tuple[int, int]]:
    """Spanning forest of the links among some lines."""
    n = len(texts)
    sign = np.array([signature(t) for t in texts], dtype=np.uint64)
    size = np.array([len(t) for t in texts])
    left = np.arange(n)
    links, front = [], []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        at = front.pop()
        may = (np.abs(size[left] - size[at]) <= EDITS) & (np.bitwise_count(sign[left] ^ sign[at]) <= FLIPS * EDITS)
        may[may] = [close(texts[at], texts[j]) for j in left[may].tolist()]
        hit = left[may].tolist()
        links += [(at, j) for j in hit]
        front += hit
        left = left[~may]
    return links


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_id) of every line that is not blank."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, hashes = [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                for number, line in lines_of(text):
                    ids.append(key)
                    numbers.append(number)
                    hashes.append(line_id(line))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "line_no", "line_id"])

    return by_batch(docs, work, "doc_id long, line_no long, line_id binary")


def key_table(docs: DataFrame) -> DataFrame:
    """(key, line): one row for each index entry (lowest bit of line 0) and probe (1), once for each batch's different lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for low in range(0, len(texts), 1000):
                keys: list[int] = []
                lines: list[int] = []
                for line in {s for t in texts[low : low + 1000] for _, s in lines_of(t)}:
                    own, probed = keys_of(line)
                    if own:
                        keys += own
                        keys += probed
                        name = short_id(line)
                        lines += [name] * len(own)
                        lines += [name + 1] * len(probed)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(np.array(lines, dtype=np.int64))], names=["key", "line"])

    return by_batch(docs, work, "key long, line long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, short) of the keys that an index entry and another line have, each line once.

    Rows come sorted, index entries first, so a run is known after its first two lines and never held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None  # an index entry that has met no other line
        open_key: int | None = None  # the key whose run goes out
        for batch in batches:
            key, line = batch.column("key").to_numpy(), batch.column("line").to_numpy()
            if not len(key):
                continue
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            runs = np.flatnonzero(np.diff(edge) > 1)
            keys, shorts = [], []
            for r in np.unique(np.concatenate([[0], runs, [len(edge) - 2]])).tolist():
                here, rows = int(key[edge[r]]), line[edge[r] : edge[r + 1]]
                names = rows & ~1
                if here != open_key:
                    open_key = None
                    if held is not None and held[0] == here:
                        names = np.concatenate([[held[1]], names])
                    elif rows[0] & 1:
                        held = None
                        continue
                    held = (here, int(names[0]))
                    if not (names != names[0]).any():
                        continue
                    open_key, held = here, None
                keys.append(np.full(len(names), here))
                shorts.append(names)
            none = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + keys)), pa.array(np.concatenate(none + shorts))], names=["key", "short"])

    rows = keys.repartition("key").sortWithinPartitions("key", F.col("line").bitwiseAND(F.lit(1)))
    return by_batch(rows, work, "key long, short long").distinct()


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(short, line_id, line) of the wanted lines. The sieve keeps other lines out of the shuffle; the join is exact."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve(wanted, "short"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            texts = texts_of(batch)
            for low in range(0, len(texts), 1000):
                found = list({s for t in texts[low : low + 1000] for _, s in lines_of(t) if len(s) >= CHARS})
                ids = np.array([short_id(s) for s in found], dtype=np.int64)
                kept = members_of(bitmap, ids)
                lines = [found[k] for k in kept.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array([line_id(s) for s in lines], pa.binary()), pa.array(lines, pa.string())], names=["short", "line_id", "line"])

    every = by_batch(docs, work, "short long, line_id binary, line string")
    return every.join(wanted, "short", "left_semi").groupBy("line_id").agg(F.first("short").alias("short"), F.first("line").alias("line"))


class Core:
    """Some lines of a run, and which of them are joined."""

    def __init__(self, run: dict[bytes, str]):
        self.ids, self.texts = list(run), list(run.values())
        self.sign = np.array([signature(t) for t in self.texts], dtype=np.uint64)
        self.size = np.array([len(t) for t in self.texts])
        self.links = forest(self.texts)
        self.part = np.arange(len(self.ids))
        for i, j in self.links:  # a forest grows from its roots
            self.part[j] = self.part[i]

    def pairs(self) -> list[tuple[bytes, bytes]]:
        return [(self.ids[i], self.ids[j]) for i, j in self.links]

    def beside(self, name: bytes, text: str, sign: int) -> list[tuple[bytes, bytes]]:
        """One link from another line to each part that it is close to."""
        may = np.flatnonzero((np.abs(self.size - len(text)) <= EDITS) & (np.bitwise_count(self.sign ^ np.uint64(sign)) <= FLIPS * EDITS))
        met: dict[int, bytes] = {}
        for i in may.tolist():
            if int(self.part[i]) not in met and close(self.texts[i], text):
                met[int(self.part[i])] = self.ids[i]
        return [(m, name) for m in met.values()]


def run_links(rows: DataFrame, hold: int, last: bool) -> DataFrame:
    """(a, b, key, line_id, line, sign): links within runs of one key (a, b), and all rows of runs that are too long.

    Of a run that is too long the first ``hold`` lines are compared with all others. ``last``: all runs are held.
    """
    names = ["a", "b", "key", "line_id", "line", "sign"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chars = None, 0
        run: dict[bytes, str] = {}
        core: Core | None = None
        pairs: list[tuple[bytes, bytes]] = []
        passed: list[tuple[int, bytes, str, int]] = []

        def out() -> Iterator[pa.RecordBatch]:
            ends = [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ends, *[pa.nulls(len(pairs), k) for k in kinds[2:]]], names=names)
            rest = [pa.array([p[k] for p in passed], kind) for k, kind in enumerate(kinds[2:])]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(passed), k) for k in kinds[:2]], *rest], names=names)
            pairs.clear()
            passed.clear()

        def settle() -> None:
            if core is None and len(run) > 1:
                pairs.extend(Core(run).pairs())

        for batch in batches:
            for here, name, text in zip(batch.column("key").to_pylist(), batch.column("line_id").to_pylist(), batch.column("line").to_pylist()):
                if here != key:
                    settle()
                    key, chars, run, core = here, 0, {}, None
                if core is not None:
                    sign = signature(text)
                    pairs.extend(core.beside(name, text, sign))
                    passed.append((here, name, text, signed(sign)))
                    continue
                run[name] = text
                chars += len(text)
                if not last and len(run) > 1 and (len(run) > hold or chars > HOLD_CHARS):
                    core = Core(run)
                    pairs.extend(core.pairs())
                    passed.extend((here, n, t, signed(int(s))) for n, t, s in zip(core.ids, core.texts, core.sign))
            if len(pairs) + len(passed) > 5000:
                yield from out()
        settle()
        yield from out()

    return by_batch(rows.select("key", "line_id", "line").repartition("key").sortWithinPartitions("key", "line_id"), work, "a binary, b binary, key long, line_id binary, line string, sign long")


def links(members: DataFrame, texts: DataFrame, hold: int | None = None) -> DataFrame:
    """(a, b) line ids that connect all lines within the allowed edits; members: key, short.

    Keys of too many lines are looked at again where their lines are not all of one component yet: each line is dealt
    by every choice of bands of its signature, and groups of one component are left out before their texts move.
    """
    rows = members.join(texts, "short").select("key", "line_id", "line")
    every = None
    for level in range(LEVELS + 1):
        found = staged(run_links(rows, hold or HOLD, level == LEVELS), "runs")
        pairs = found.where("a is not null").select("a", "b")
        every = pairs if every is None else every.unionByName(pairs)
        more = found.where("a is null").select("key", "line_id", "line", "sign")
        if more.isEmpty():
            break
        root = components(every).withColumnRenamed("node", "line_id")
        mixed = lambda x: x.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        rooted = staged(more.join(root, "line_id", "left").withColumn("root", F.coalesce("root", "line_id")), "rooted")
        keys = [F.xxhash64("key", F.lit(g), F.col("sign").bitwiseAND(F.lit(m))) for g, (m,) in enumerate(band_choices(level, FLIPS * EDITS))]
        dealt = staged(rooted.join(mixed(rooted), "key", "left_semi").select("line_id", "root", F.explode(F.array(*keys)).alias("key")), "dealt")
        rows = dealt.join(mixed(dealt), "key", "left_semi").select("key", "line_id").join(rooted.select("line_id", "line").dropDuplicates(["line_id"]), "line_id")
    return every


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold: int | None = None) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line) of every line of docs that is not blank.

    Lines are compared without the white space around them. A class is what links connect: equal lines, and lines of
    CHARS characters or more within one edit for each CHARS of the shorter one, EDITS at most. It is named by its first
    line (smallest doc_id, null first, then line number); a line is a duplicate unless it is that one. Null and empty
    texts have no lines. Rows that repeat an id, or have none, are taken as they come: their equal line numbers are
    ties that name the same place. Lines of any length are compared whole. Columns of docs beside these two are not
    read, whatever their names. An empty table gives no rows.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = staged(line_table(chosen), "lines")
    members = staged(shared_keys(key_table(chosen)), "members")
    texts = staged(line_texts(chosen, members.select("short").distinct()), "texts")
    root = components(links(members, texts, hold))
    classed = lines.join(root.withColumnRenamed("node", "line_id"), "line_id", "left").select("doc_id", "line_no", F.coalesce("root", "line_id").alias("class"))
    # a table of its own, so that the join can split the rows of a hot class
    first = staged(classed.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("f")), "classes")
    return classed.join(first, "class").select("doc_id", "line_no", F.col("f.doc_id").alias("class_doc"), F.col("f.line_no").alias("class_line"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the text's duplicate lines taken out; blank lines stay, columns stay. Ids are expected to be unique."""
    again = line_classes(docs).where("doc_id is distinct from class_doc or line_no <> class_line")
    gone = again.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(*[docs[c] for c in docs.columns], "__gone")

    columns = docs.columns

    def left(text: str | None, lines: list[int] | None) -> str | None:
        if not lines or text is None:
            return text
        out = set(lines)
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(map(left, batch.column("text").to_pylist(), batch.column("__gone").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in columns], names=columns)

    return by_batch(both, work, docs.schema)
