"""Token-id files: documents in ascending id order, Simple-8b coded segments, read back by blocks.

A file is a table of segments in the shared folder, written through Spark's commit protocol so that retried tasks
leave nothing behind. Each segment's payload is self-contained:

    magic "S8B1", then uint32 n_docs, n_ids, n_blocks, n_words
    n_docs x int64 document ids, n_docs x uint8 (1: the id is null), n_docs x uint32 token counts
    n_blocks x uint32 word offsets, n_words x uint64 Simple-8b words (little-endian)
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .common import by_batch, kept, scratch, staged

MAGIC = b"S8B1"
#: Ids that a segment holds at most; a longer document has a segment of its own.
SEGMENT = 1 << 20
#: Bytes of text that are encoded together.
PIECE = 8_000_000
#: Chunks and words that an encoder remembers before it starts afresh.
REMEMBERED = 1_000_000
SEPARATOR = "<|endoftext|>"
#: A word of Latin letters, perhaps behind a line break, and a run of up to three marks behind it, which are one
#: pre-token (no apostrophe: it may start a contraction).
LATIN = r"^(?P<word>\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]{0,3})$"


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Whole texts to ids with the tokenizers library; each different word is encoded once and remembered.

    Byte-level pre-tokenisation always cuts before a space, and around a line break, that stands between two
    non-spaces, so the ids of a text are the ids of its chunks in order: a chunk begins at such a space (which it leads
    with) or line break. Most chunks are one Latin word with a few marks behind it; Arrow tells them apart, and word
    and marks are looked up alone. Other chunks are encoded together in one call, parted by the end marker. Texts with
    other white space beside a space or line break are encoded as a whole. When too much is remembered, only what the
    texts at hand hold is kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.token_to_id(SEPARATOR)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelt = lambda c: level.pre_tokenize_str(c)[0][0]
        # the letter that the library's byte level writes for each byte of Latin UTF-8: ASCII, continuation, lead
        self.letters = {i: spelt(chr(i))[-1] for i in range(0xC0)} | {i: spelt(bytes([i, 0x80]).decode())[0] for i in range(0xC2, 0xE0)}
        self.first: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.irregular: set[str] = {""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Latin words, each led by a space or a line break in its text."""
        model, space, known, lead = self.model.tokenize, self.letters[32], self.words, self.whole("\n")
        for w in words:
            if w[0] == "\n":
                spelt = w[1:] if w.isascii() else w[1:].encode().decode("latin-1").translate(self.letters)
                known[w] = lead + array("I", [t.id for t in model(spelt)]).tobytes()
            else:
                spelt = space + (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))
                known[w] = array("I", [t.id for t in model(spelt)]).tobytes()

    def learn_others(self, chunks: list[str]) -> None:
        led = [c if c[:1] == "\n" else f" {c}" for c in chunks]
        plain = [k for k, c in enumerate(chunks) if SEPARATOR not in c]
        self.others.update((c, self.whole(t)) for c, t in zip(chunks, led) if SEPARATOR in c)
        self.irregular.update(c for c in chunks if c and (c[-1].isspace() or c[0].isspace() and (c[0] != "\n" or c[1:2].isspace())))
        if plain:
            ids = self.whole("".join(f"{led[k]}{SEPARATOR}" for k in plain))
            at = 0
            for k, cut in zip(plain, np.flatnonzero(np.frombuffer(ids, dtype="<u4") == self.mark).tolist(), strict=True):
                self.others[chunks[k]] = ids[4 * at : 4 * cut]
                at = cut + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Arrow splits the texts and numbers chunks, words and marks; each
        different one is looked up once, and the ids of all occurrences are gathered by position."""
        if self.mark is None or not len(texts):
            runs = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(runs), dtype="<u4"), np.array([len(r) // 4 for r in runs], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        bounds -= bounds[0]
        codes, chunks = numbered.indices.to_numpy(), numbered.dictionary
        parts = pc.extract_regex(chunks, LATIN)
        latin = parts.is_valid().to_numpy(zero_copy_only=False)
        words, marks = (parts.field(k).filter(parts.is_valid()).dictionary_encode() for k in ("word", "marks"))
        different = listed(words.dictionary)
        if len(self.words) + len(self.others) > REMEMBERED:
            self.words = {w: self.words[w] for w in different if w in self.words}
            self.first, self.others, self.irregular = {}, {}, {""}
        self.learn_words([w for w in different if w not in self.words])
        for m in listed(marks.dictionary):
            if m not in self.marks:
                self.marks[m] = self.whole(m)
        rest = listed(chunks.filter(parts.is_null()))
        self.learn_others([c for c in rest if c not in self.others])
        heads = listed(chunks.take(pa.array(codes[bounds[:-1]])))
        for c in heads:
            if c not in self.first:
                self.first[c] = self.whole(c)
        # runs of ids: words, marks, other chunks, first chunks, mended texts; a chunk is two of them, one may be empty
        runs = [*map(self.words.__getitem__, different), *map(self.marks.__getitem__, listed(marks.dictionary)), *map(self.others.__getitem__, rest)]
        head_at = len(runs)
        runs += [*map(self.first.__getitem__, heads), b""]
        none = len(runs) - 1
        one, two = np.empty(len(chunks), dtype=np.int32), np.full(len(chunks), none, dtype=np.int32)
        one[latin], two[latin] = words.indices.to_numpy(), len(different) + marks.indices.to_numpy()
        one[~latin] = len(different) + len(marks.dictionary) + np.arange(len(rest))
        pair = np.stack([one[codes], two[codes]], axis=1)
        odd = np.zeros(len(chunks), dtype=bool)
        odd[~latin] = [c in self.irregular for c in rest]
        mended = np.flatnonzero((np.add.reduceat(odd[codes], bounds[:-1], dtype=np.int64) > 0) & (np.diff(bounds) > 1))
        for k in mended.tolist():
            runs[head_at + k] = self.whole(texts[k].as_py())
            pair[bounds[k] : bounds[k + 1]] = none
        pair[bounds[:-1], 0], pair[bounds[:-1], 1] = head_at + np.arange(len(heads)), none
        # a piece has fewer than 2**31 ids, so places fit 32 bits
        flat = np.frombuffer(b"".join(runs), dtype="<u4")
        size = np.fromiter(map(len, runs), dtype=np.int32, count=len(runs)) // 4
        place = np.cumsum(size, dtype=np.int32) - size
        pair = pair.ravel()
        size, place = size[pair], place[pair]
        ends = np.cumsum(size, dtype=np.int32)
        return flat[np.repeat(place - ends + size, size) + np.arange(ends[-1], dtype=np.int32)], np.add.reduceat(size, 2 * bounds[:-1], dtype=np.int64)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept between the tasks of a stage."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes each; a longer text stands alone."""
    stops = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = int(stops[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(stops, before + most, side="right")))
        yield low, high
        low = high


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    head = MAGIC + struct.pack("<4I", len(doc_ids), len(ids), len(offsets), len(words))
    keys = np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes() + bytes(i is None for i in doc_ids)
    return head + keys + lengths.astype("<u4").tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token counts, all ids) of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, _, blocks, words = struct.unpack("<4I", payload[4:20])
    at = 20
    keys = np.frombuffer(payload, "<i8", docs, at).tolist()
    nulls = payload[at + 8 * docs : at + 9 * docs]
    lengths = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    at += 13 * docs + 4 * blocks
    ids = simple8b.decode(np.frombuffer(payload, "<u8", words, at))
    return [None if n else k for k, n in zip(keys, nulls)], lengths, ids


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts in ascending id order (null ids first, equal ids by the text's hash) and write segments.

    Null text counts as empty; every document ends with ``end_id``. Returns the path written.
    """
    path = path or f"{scratch(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def segment(part: int, seq: int, keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(keys), pa.int64()), (len(ids), pa.int64()), (pack(keys, lengths, ids), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_docs", "n_ids", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for low, high in pieces(texts):
                ids, lengths = code.encode(texts.slice(low, high - low))
                stops = np.cumsum(lengths)
                ids, lengths = np.insert(ids, stops, end_id), lengths + 1
                stops = np.cumsum(lengths)
                a = 0
                while a < high - low:  # at least one document, then as many as SEGMENT holds
                    before = int(stops[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(stops, before + SEGMENT, side="right")))
                    yield segment(part, seq, keys[low + a : low + b], lengths[a:b], ids[before : stops[b - 1]])
                    a, seq = b, seq + 1

    by_batch(ordered, work, "part int, seq int, n_docs long, n_ids long, payload binary").write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments of a written file.

    start counts the ids of all documents before it: a sum inside the segment, plus the segments before it in its
    part, plus the parts before that; no window sees more than one part's segments or one row for each part.
    """
    written = spark.read.schema("part int, seq int, n_docs long, n_ids long, payload binary").parquet(path)
    meta = staged(written.select("part", "seq", "n_ids"), "segments")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    shift = meta.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("seq_start")).join(parts, "part")
    shift = shift.select("part", "seq", (F.col("seq_start") + F.col("part_start")).alias("shift"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload"))):
                keys, lengths, ids = unpack(payload)
                raw, stops = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths.astype(np.int64))
                starts = stops - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    decoded = by_batch(written.select("part", "seq", "payload"), work, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return decoded.join(shift, ["part", "seq"]).select("doc_id", (F.col("inner") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32")
