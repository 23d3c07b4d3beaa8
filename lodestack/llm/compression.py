"""Quality rules by bands of zstandard ratios over whole documents and over fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of

LEVEL = 3
#: Bytes from which a band holds; lowest and highest ratio (bytes / compressed bytes). The lower limits lie just below
#: what prose of four languages measures at that length, above what random words of 64 signs reach.
BANDS = ((0, 0.0, float("inf")), (128, 1.2, 3.0), (512, 1.38, 3.0), (1024, 1.65, 3.0), (2048, 1.8, 3.5), (4096, 1.95, 3.5), (16384, 2.1, 4.0), (131072, 2.2, 5.0))
CHUNK = 1024
#: Band of one chunk, and the share of chunks outside it beyond which a text is rejected.
CHUNK_BAND = (1.62, 4.0)
CHUNK_SHARE = 0.25
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_share double"


def repeated_words(words: list[bytes], span: int = 3) -> int:
    """Words that lie in a window of ``span`` words found twice or more, the first one included."""
    if len(words) <= span:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    key = ids[: len(ids) - span + 1]
    for j in range(1, span):
        _, key = np.unique(key, return_inverse=True) if len(number) >= 1 << 20 else (None, key)
        key = key * len(number) + ids[j : len(ids) - span + 1 + j]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    cover = np.zeros(len(words), dtype=bool)
    again = np.flatnonzero(count[inverse] > 1)
    for j in range(span):
        cover[again + j] = True
    return int(cover.sum())


def ratios(data: bytes, press: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(ratio of the whole, share of chunks outside the chunk band); the empty text has ratio 1.

    Chunks are those of CHUNK bytes in turn and, where bytes are left, a last one that ends with the text. A text
    shorter than a chunk has none.
    """
    if not data:
        return 1.0, 0.0
    whole = len(data) / len(press.compress(data))
    if len(data) < CHUNK:
        return whole, 0.0
    starts = list(range(0, len(data) - CHUNK + 1, CHUNK))
    if len(data) % CHUNK:
        starts.append(len(data) - CHUNK)
    view = memoryview(data)
    out = 0
    for at in starts:
        r = CHUNK / len(press.compress(view[at : at + CHUNK]))
        out += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    return whole, out / len(starts)


def in_band(size: int, ratio: float) -> bool:
    low, high = next((a, b) for least, a, b in reversed(BANDS) if size >= least)
    return low <= ratio <= high


def measure(text: str, press: zstandard.ZstdCompressor) -> tuple:
    """All columns but doc_id for one whole text."""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    ratio, share = ratios(data, press)
    kept = not failed and in_band(len(data), ratio) and share <= CHUNK_SHARE
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, kept, ratio, share


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs with COLUMNS. Null text counts as empty, which fails the base rules.

    ratio is bytes by compressed bytes of the whole text; chunk_share the share of its chunks out of their band. Texts
    of any length are compressed whole and in all their chunks. Rows are judged one by one: repeated rows and null ids
    give rows as they come. Other columns of docs are not read, whatever their names. An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            rows = [measure(t, press) for t in texts_of(batch)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, COLUMNS)
