"""Snippets as they are shown: shortened or not, with diagnostics and coloured HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.present import diagnostics, highlighted
from ..functions.scan import expand_tabs
from ..functions.text import snippet_language, truncation

SHOWN = "key struct<file_id:string,sym_id:int>, display_snippet string, display_html string, diagnostics array<struct<severity:string,message:string,line:int,col:int>>"
_DIAGNOSTIC = pa.list_(pa.struct([("severity", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))


def _show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, pages, found = [], [], []
        for code, marker, language, mode in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            shown = expand_tabs((code or "") + (marker or ""))
            texts.append(shown)
            pages.append(highlighted(shown, language))
            found.append([{"severity": "warning", "message": m, "line": line, "col": col} for m, line, col in diagnostics(code or "", language, mode, bool(marker))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), pa.array(pages), pa.array(found, _DIAGNOSTIC)], names=["key", "display_snippet", "display_html", "diagnostics"])


def shown(symbols: DataFrame) -> DataFrame:
    """file_id, sym_id, display_snippet, display_html, diagnostics of symbols; one Arrow step, no shuffle."""
    cut = truncation(F.col("snippet"))
    rows = symbols.select(F.struct("file_id", "sym_id").alias("key"), cut["code"].alias("code"), cut["marker"].alias("marker"), snippet_language(F.col("language")).alias("language"), "diagnostics_mode")
    return rows.mapInArrow(_show, SHOWN).select("key.file_id", "key.sym_id", "display_snippet", "display_html", "diagnostics")
