"""Benchmark decontamination by suffix arrays over shards of training text.

Benchmark words are numbered; a training word outside that vocabulary can be in no match, so a shard keeps only runs
of known words that are long enough for the shortest window. The suffixes of what is left are sorted by prefix
doubling, every benchmark suffix is binary-searched, and the interval of suffixes that share its window gives all
occurrences. Neighbouring windows on one diagonal are joined into the longest verbatim matches with their places.

The benchmark is cut into blocks of a bounded number of words; each block is broadcast to the executors' disks, and
every shard is searched for one block after another, which a worker lets go before it loads the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of

#: A word: digits, ASCII letters and all beyond ASCII; of UTF-8 bytes after ASCII lower-casing.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Benchmark words in one broadcast block at most (a single longer item has a block of its own).
BLOCK_WORDS = 1_000_000
#: Training words in one suffix array, beyond which a shard is closed.
SHARD_WORDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass
class Block:
    """Distinct windows of some benchmark items."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    known: dict[tuple[int, ...], int] = field(default_factory=dict)
    owners: list[list[tuple[int, int]]] = field(default_factory=list)
    size: int = 0

    def add(self, item: str, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        own = len(self.items)
        self.items.append(item)
        self.size += len(ids)
        for at in range(max(1, len(ids) - self.window + 1)):
            k = self.known.setdefault(tuple(ids[at : at + self.window]), len(self.owners))
            if k == len(self.owners):
                self.owners.append([])
            self.owners[k].append((own, at))

    @cached_property
    def names(self) -> list[list[str]]:
        """The different items of each window."""
        return [list(dict.fromkeys(self.items[i] for i, _ in own)) for own in self.owners]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows padded with 0, and their lengths."""
        out = np.zeros((len(self.known), self.window), dtype=np.int32)
        for k, w in enumerate(self.known):
            out[k, : len(w)] = w
        return out, np.array([len(w) for w in self.known], dtype=np.int64)


def blocks_of(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Block]:
    block = Block(window)
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if words := words_of(text):
            if block.size and block.size + len(words) > BLOCK_WORDS:
                yield block
                block = Block(window)
            block.add("null" if item is None else item, words)
    if block.items:
        yield block


#: (item name, length, word position, item position) of verbatim matches that cannot be made longer.
Found = list[tuple[str, int, int, int]]
#: Pairs of a match and an item that has it which are looked at together.
PAIRS = 2_000_000


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of seq in the order of their suffixes' first ``depth`` numbers at least (prefix doubling)."""
    _, rank = np.unique(seq, return_inverse=True)
    rank, span, n = rank.astype(np.int64) + 1, 1, len(seq)
    order = np.argsort(rank, kind="stable")
    while span < depth:
        key = rank * (n + 2)
        key[: n - span] += rank[span:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        span *= 2
        if rank[order[-1]] == n:
            break
    return order


def intervals(seq: np.ndarray, order: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the range of suffixes that begin with it: all binary searches step together."""
    reach = np.arange(windows.shape[1])
    padded = np.concatenate([seq, np.zeros(windows.shape[1], dtype=seq.dtype)])
    beyond = reach[None, :] >= sizes[:, None]

    def search(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(order), dtype=np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            diff = np.sign(padded[order[mid][:, None] + reach] - windows[open_])
            diff[beyond[open_]] = 0
            first = np.take_along_axis(diff, (diff != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
            right = first <= 0 if upper else first < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    return search(False), search(True)


class Hits:
    """Notes nothing but which words are hit."""

    def __init__(self, n: int):
        pass

    def note(self, shard: Shard) -> None:
        pass


class Items:
    """Collects the names of the items that each document has a window of, each once however often they occur."""

    def __init__(self, n: int):
        self.found: list[set[str]] = [set() for _ in range(n)]

    def note(self, shard: Shard) -> None:
        # each window once for a document, then the items of each window
        n = len(shard.sizes)
        pair = np.unique(shard.doc * n + shard.which)
        doc, which = pair // n, pair % n
        names = shard.block.names
        edge = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = self.found[int(doc[low])]
            for k in which[low:high].tolist():
                own.update(names[k])


class Matches:
    """Collects the places of all verbatim matches that cannot be made longer."""

    def __init__(self, n: int):
        self.found: list[Found] = [[] for _ in range(n)]

    def note(self, shard: Shard) -> None:
        met, sizes, owned = np.unique(shard.which), shard.sizes, shard.block.owners
        own_count = np.array([len(owned[k]) for k in met.tolist()])
        own_start, many = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        own_start[met], many[met] = np.cumsum(own_count) - own_count, own_count
        own = np.array([x for k in met.tolist() for x in owned[k]], dtype=np.int64).reshape(-1, 2)
        by = np.argsort(shard.doc, kind="stable")
        doc, at, which = shard.doc[by], shard.at[by], shard.which[by]
        # some documents at a time: a passage that many items hold has a row for each of them
        turn = np.cumsum(many[which]) // PAIRS
        turn = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), turn, 0))
        edge = np.concatenate([[0], np.flatnonzero(turn[1:] != turn[:-1]) + 1, [len(turn)]])
        for low, high in zip(edge[:-1], edge[1:]):
            note_matches(doc[low:high], at[low:high], which[low:high], sizes, own, own_start, many, shard.bounds, shard.block.items, self.found)


Collector = Hits | Items | Matches


@dataclass
class Shard:
    """Occurrences of a block's windows in some documents: document, word position in the shard, window."""

    block: Block
    sizes: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    which: np.ndarray


def search_shard(docs: list[list[bytes]], block: Block, hit: np.ndarray, bounds: np.ndarray, collector: Collector) -> None:
    """Mark hit words of a shard, and let the collector note the occurrences."""
    windows, sizes = block.table()
    get = block.vocabulary.get
    flat = np.zeros(int(bounds[-1]) + len(docs), dtype=np.int32)
    for k, words in enumerate(docs):
        flat[bounds[k] + k : bounds[k + 1] + k] = [get(w, 0) for w in words]
    known = np.concatenate([[0], (flat > 0).view(np.int8), [0]])
    edge = np.diff(known)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts >= sizes.min()
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return
    lengths = stops - starts + 1  # each run with the separator behind it
    place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    seq = flat[np.minimum(place, len(flat) - 1)].astype(np.int64)
    seq[np.cumsum(lengths) - 1] = 0
    order = suffix_array(seq, block.window)
    low, high = intervals(seq, order, windows, sizes)
    met = np.flatnonzero(high > low)
    if not len(met):
        return
    count = (high - low)[met]
    which = np.repeat(met, count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = place[order[np.repeat(low[met], count) + inner]]
    doc = np.searchsorted(bounds[:-1] + np.arange(len(docs)), at, side="right") - 1
    at = at - doc  # separators out: positions in the shard's words
    cover = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, at + sizes[which], 1)
    hit |= np.cumsum(cover)[:-1] > 0
    collector.note(Shard(block, sizes, bounds, doc, at, which))


def note_matches(doc: np.ndarray, at: np.ndarray, which: np.ndarray, sizes: np.ndarray, own: np.ndarray, own_start: np.ndarray, many: np.ndarray, bounds: np.ndarray, names: list[str], found: list[Found]) -> None:
    """Join windows that follow each other on one diagonal of a document and an item."""
    rep = many[which]
    pick = np.repeat(own_start[which], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
    doc, at, size = np.repeat(doc, rep), np.repeat(at, rep), np.repeat(sizes[which], rep)
    item, item_at = own[pick, 0], own[pick, 1]
    by = np.lexsort((at, at - item_at, item, doc))
    doc, at, size, item, item_at = doc[by], at[by], size[by], item[by], item_at[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - item_at[1:] != at[:-1] - item_at[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(by)))
    for d, i, a, p, n in zip(doc[head].tolist(), item[head].tolist(), (at[head] - bounds[doc[head]]).tolist(), item_at[head].tolist(), (run - 1 + size[head]).tolist()):
        found[d].append((names[i], n, a, p))


def scan(texts: list[str], sent: list[Broadcast[Block]], collect: type[Collector] = Matches) -> Iterator[tuple[np.ndarray, np.ndarray, Collector]]:
    """Word counts, hit word counts and the collector of some texts, one shard after another."""
    shard: list[list[bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        shard.append(words_of(text))
        size += len(shard[-1])
        if size > SHARD_WORDS or k == len(texts) - 1:
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in shard])]).astype(np.int64)
            hit = np.zeros(size, dtype=bool)
            collector = collect(len(shard))
            for one in sent:
                search_shard(shard, one.value, hit, bounds, collector)
                if len(sent) > 1:
                    one.__dict__.pop("_value", None)  # it is read from disk again for the next shard
            yield np.diff(bounds), np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds]), collector
            shard, size = [], 0


def sent_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> list[Broadcast[Block]]:
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(b) for b in blocks_of(benchmark, window, id_col, text_col)]


def _searched(docs: DataFrame, sent: list[Broadcast[Block]], collect: type[Collector], columns: Callable[[Collector], list[pa.Array]], names: list[str], schema: str, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n_words, n_hit, collector in scan(texts_of(batch), sent, collect):
                ids = batch.column("doc_id").slice(at, len(n_words))
                at += len(n_words)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_hit), *columns(collector)], names=["doc_id", "n_words", "n_hit", *names])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return by_batch(chosen, work, f"doc_id long, n_words long, n_hit long, {schema}")


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window), and items: the different
    items with an occurring window, ordered as strings. Its size is bounded by the benchmark, not by the occurrences.

    Items shorter than the window count as one window of their own length; wordless and null items are never met,
    and a null item id is named "null". Items with the same id count as one. Null and empty texts have no words; texts are
    searched whole, whatever their length. Repeated rows give repeated rows; empty tables of documents give no rows, and
    an empty benchmark meets nothing. Other columns are not read, whatever their names.
    """
    column = lambda c: [pa.array([sorted(f) for f in c.found], pa.list_(pa.string()))]
    return _searched(docs, sent_blocks(benchmark, window, item_col, item_text), Items, column, ["items"], "items array<string>", id_col, text_col)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """find_items with matches in place of items: all verbatim matches of a window or more that cannot be made longer, as
    item, n_words, doc_at, item_at (word positions from 0), ordered by item as a string, then by place.

    A document that repeats what many items hold has a match for each of both; where only the items count, find_items
    does without them.

    Items shorter than the window count as one window of their own length; wordless and null items are never met,
    and a null item id is named "null". Items with the same id count as one. Null and empty texts have no words; texts are
    searched whole, whatever their length. Repeated rows give repeated rows; empty tables of documents give no rows, and
    an empty benchmark meets nothing. Other columns are not read, whatever their names.
    """
    kind = pa.list_(pa.struct([("item", pa.string()), ("n_words", pa.int64()), ("doc_at", pa.int64()), ("item_at", pa.int64())]))
    listed = lambda f: [dict(zip(("item", "n_words", "doc_at", "item_at"), m)) for m in sorted(f, key=lambda m: (m[0], m[2], m[3]))]
    column = lambda c: [pa.array([listed(f) for f in c.found], kind)]
    return _searched(docs, sent_blocks(benchmark, window, item_col, item_text), Matches, column, ["matches"], "matches array<struct<item:string,n_words:long,doc_at:long,item_at:long>>", id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op1 query from those of find_items (or find_matches)."""
    items = F.col("items") if "items" in found.columns else F.array_distinct(F.transform("matches", lambda m: m["item"]))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark window; all other rows, columns and their order stay."""
    sent = sent_blocks(benchmark, window, "item_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [n_hit == 0 for _, n_hit, _ in scan(texts_of(batch, text_col), sent, Hits)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, dtype=bool), *clean])))

    return by_batch(docs, work, docs.schema)
