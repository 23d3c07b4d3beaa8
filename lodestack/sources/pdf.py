"""Reading page texts of PDFs in executors. The readers are plug-ins; none is needed to import this module."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guard import Guarded, Unreadable


def text_layer(data: bytes) -> list[str]:
    """Texts of all pages of the text layer; encrypted and broken files raise ValueError, whatever the library raises."""
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("the text-layer reader needs pypdf") from e
    try:
        reader = PdfReader(io.BytesIO(data))
        if not reader.is_encrypted:
            return [p.extract_text() or "" for p in reader.pages]
    except Exception as e:
        raise ValueError(f"{type(e).__name__}: {e}") from e
    raise ValueError("encrypted")


def ocr_engine(name: str = "auto") -> Callable[[bytes, int], str] | None:
    """A function (file, page) -> text of the first engine that is installed; none for "none" or if there is none."""
    if name in ("auto", "tesseract"):
        try:
            import pdf2image
            import pytesseract

            return lambda data, page: pytesseract.image_to_string(pdf2image.convert_from_bytes(data, dpi=200, first_page=page + 1, last_page=page + 1)[0])
        except ImportError:
            if name != "auto":
                raise
    if name in ("auto", "rapidocr"):
        try:
            import pdf2image
            from rapidocr_onnxruntime import RapidOCR

            engine = RapidOCR()

            def read(data: bytes, page: int) -> str:
                image = pdf2image.convert_from_bytes(data, dpi=200, first_page=page + 1, last_page=page + 1)[0]
                return "\n".join(line[1] for line in engine(image)[0] or [])

            return read
        except ImportError:
            if name != "auto":
                raise
    return None


def with_ocr(files: DataFrame, pages: DataFrame, wanted: DataFrame, engine: Callable[[], Callable[[bytes, int], str] | None]) -> DataFrame:
    """pages (doc_id, page, text) with the wanted (doc_id, page) read again by an engine, which each task makes once.

    files: (doc_id, content). Without an engine, or where it reads nothing, the text layer's text stays.
    """
    asked = wanted.groupBy("doc_id").agg(F.collect_set("page").alias("pages"))  # a document's first pages, few

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            rows = [(d, int(k), read(bytes(c), int(k)) if read else "") for d, c, ks in zip(batch["doc_id"], batch["content"], batch["pages"]) for k in ks]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ocr"])

    key = dict(pages.dtypes)["doc_id"]
    again = files.join(asked, "doc_id").select("doc_id", "content", "pages").mapInPandas(work, f"doc_id {key}, page int, ocr string")
    return pages.join(again, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce(F.nullif(F.trim("ocr"), F.lit("")), F.col("text")).alias("text"))


def read_pages(files: DataFrame, read: Callable[[bytes], list[str]] = text_layer, seconds: float = 60) -> DataFrame:
    """(path, page, text, error) of (path, content); a file that cannot be read gives one row with the error.

    The reader runs in a process of its own, so one that raises, dies or hangs for ``seconds`` costs its file alone.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(Guarded(lambda: read, seconds)) as guarded:
            for batch in batches:
                rows = []
                for path, content in zip(batch["path"], batch["content"]):
                    try:
                        rows += [(path, k, t, None) for k, t in enumerate(guarded(bytes(content)))]
                    except Unreadable as e:
                        rows.append((path, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(work, "path string, page int, text string, error string")
