"""Visible text of web pages, laid out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import Veil, by_batch
from .html_layout import extract


ADDED = ("title", "text", "n_lines")


def visible_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the column ``html``, with title, text (the visible text, laid out) and n_lines.

    Tags that are missing are implied; what a reader doesn't see (scripts, templates, hidden elements, also by simple
    rules of the page's own style sheets) is left out. Blocks begin lines, paragraphs and the like have blank lines
    around them, lists have markers and are indented, and the cells of a table stand in aligned columns. Null and empty
    pages give an empty text; anything else is a page, however broken. Repeated rows are taken as they come. Columns of
    pages named like the added ones are replaced. Each page is one row's work: no shuffle.
    """
    veil = Veil(pages)
    column = veil.at(html)
    fields = veil.fields(html, *ADDED)
    names = [f.name for f in fields if f.name != column]
    fields = StructType([f for f in fields if f.name != column]).add("title", StringType()).add("text", StringType()).add("n_lines", LongType())

    def work(batch: pa.RecordBatch) -> dict:
        out = {"title": [], "text": [], "n_lines": []}
        for raw in batch.column("_html").to_pylist():
            title, text = extract((raw or b"").decode("utf-8", "replace"))
            for k, v in zip(out, (title, text, text.count("\n") + 1 if text else 0)):
                out[k].append(v)
        return {c: batch.column(c) for c in names} | out

    rows = by_batch(veil.df.select(*names, F.col(column).cast("binary").alias("_html")), work, fields)
    return rows.select(*[F.col(own).alias(name) for own, name in zip(veil.own, veil.names) if own in names], *ADDED)
