"""Small result tables as CSV and Markdown files of the driver."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of a report at most; a report is for people.
MOST_ROWS = 10_000


def rows_of(df: DataFrame) -> list[list]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return [list(r) for r in rows]


def write_csv(df: DataFrame, path: str) -> int:
    """Rows written, in the table's order, below a header."""
    rows = rows_of(df)
    with Path(path).open("w", newline="", encoding="utf-8") as out:
        csv.writer(out).writerows([df.columns, *rows])
    return len(rows)


def markdown(df: DataFrame, title: str) -> str:
    shown = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows_of(df)]) + "\n"


def write_markdown(tables: dict[str, DataFrame], path: str) -> None:
    Path(path).write_text("\n".join(markdown(df, title) for title, df in tables.items()), encoding="utf-8")
