"""Writers of the results: Parquet, CSV, and reports from small aggregates."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text in one file of the folder path, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def html_table(df: DataFrame, most: int = 200) -> str:
    """The first ``most`` rows of a report's frame, and a note if there are more; nulls are empty cells."""
    cell = lambda tag, v: f"<{tag}>{'' if v is None else html.escape(str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    found = df.limit(most + 1).collect()
    rows = ["".join(cell("td", v) for v in row) for row in found[:most]]
    note = f"<p>The first {most} of {df.count()} rows.</p>" if len(found) > most else ""
    return f"<table><tr>{head}</tr>" + "".join(f"<tr>{r}</tr>" for r in rows) + f"</table>{note}"


def html_report(title: str, parts: dict[str, DataFrame]) -> str:
    """A page with one table for each named frame."""
    body = "".join(f"<h2>{html.escape(name)}</h2>{html_table(df)}" for name, df in parts.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'
