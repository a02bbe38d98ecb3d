"""Blocks and cells of DOCX files, by the standard library alone."""

from __future__ import annotations

import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, block_no long, kind string, table_no long, row_no long, col_no long, text string, is_break boolean"


def parse(path: str, content: bytes) -> list[tuple]:
    """Paragraphs and table cells in order; a broken file has none."""
    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    text = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab"))
    rows, tables = [], 0
    for n, e in enumerate(body if body is not None else []):
        if e.tag == f"{_W}p":
            broken = any(b.get(f"{_W}type") == "page" for b in e.iter(f"{_W}br")) or e.find(f".//{_W}sectPr") is not None
            rows.append((path, n, "para", None, None, None, text(e), broken))
        elif e.tag == f"{_W}tbl":
            for i, r in enumerate(e.findall(f"{_W}tr")):
                for j, c in enumerate(r.findall(f"{_W}tc")):
                    rows.append((path, n, "cell", tables, i, j, "\n".join(map(text, c.findall(f"{_W}p"))), False))
            tables += 1
    return rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every DOCX under a path, a file to a row of the scan."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in parse(p, c)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("table_no", "row_no", "col_no")})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, BLOCKS)
