"""Files inside archives and spreadsheets, read in parallel: one file is one task's work, its rows stream out in batches."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.tables import amount_text

BATCH = 20_000


def _frames(rows: Iterator[tuple], names: Sequence[str]) -> Iterator[pd.DataFrame]:
    block: list[tuple] = []
    for r in rows:
        block.append(r)
        if len(block) == BATCH:
            yield pd.DataFrame(block, columns=list(names), dtype=object)
            block = []
    yield pd.DataFrame(block, columns=list(names), dtype=object)


def read_zipped_csv(spark: SparkSession, path: str, columns: Mapping[str, str], member: str = r".*\.csv$", encoding: str = "GBK", sep: str = ",") -> DataFrame:
    """(archive, member, columns... as text) of every row of the CSV members of zip files under `path`.

    columns: header -> name; a header that a member lacks gives nulls. Bytes that are no text of the encoding become the replacement
    character. An archive is read where it lies: only its directory and one member at a time are unpacked. A file
    that is no zip archive gives no rows; a member without a header line neither.
    """
    names = list(columns.values())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for where, content in zip(b["path"], b["content"], strict=True):
                    try:
                        z = zipfile.ZipFile(io.BytesIO(content))
                    except zipfile.BadZipFile:
                        continue
                    for m in sorted(n for n in z.namelist() if re.fullmatch(member, n, re.I)):
                        with z.open(m) as f:
                            lines = csv.reader(io.TextIOWrapper(f, encoding, errors="replace", newline=""), delimiter=sep)
                            head = [h.strip().lstrip("﻿") for h in next(lines, [])]
                            at = [head.index(h) if h in head else -1 for h in columns]
                            for line in lines:
                                if line:
                                    yield (where, m, *[line[i] if 0 <= i < len(line) else None for i in at])

        yield from _frames(rows(), ["archive", "member", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "archive string, member string, " + ", ".join(f"`{n}` string" for n in names))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Rows of a worksheet of an .xlsx file as text; empty cells and rows are null and left out at the end."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
            if si.tag.endswith("}si"):
                shared.append("".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")))
                si.clear()
    for _, row in ElementTree.iterparse(z.open(f"xl/worksheets/sheet{sheet}.xml")):
        if not row.tag.endswith("}row"):
            continue
        out: list[str | None] = []
        for i, c in enumerate(row.iterfind("m:c", _NS)):
            at = _column(c.get("r")) if c.get("r") else i
            out += [None] * (at + 1 - len(out))
            kind, v = c.get("t"), c.find("m:v", _NS)
            if kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in c.iter() if t.tag.endswith("}t"))
            elif v is not None and v.text is not None:
                out[at] = shared[int(v.text)] if kind == "s" else v.text
        row.clear()
        yield out


def read_sheets(spark: SparkSession, path: str, columns: Mapping[str, str], numbers: Sequence[str] = (), sheet: int = 1) -> DataFrame:
    """(file, columns...) of the rows of .xlsx files under `path`: headers in the sheet's first row, values as text, `numbers` (names) as numbers.

    A header that a file lacks gives nulls; a file that is no workbook, or lacks the sheet, gives no rows. Numbers may carry the suffixes of `amount_text`.
    """
    names = list(columns.values())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for where, content in zip(b["path"], b["content"], strict=True):
                    try:
                        it = sheet_rows(content, sheet)
                        head = [(h or "").strip() for h in next(it, [])]
                    except (zipfile.BadZipFile, KeyError):
                        continue
                    at = [head.index(h) if h in head else -1 for h in columns]
                    for line in it:
                        if any(v is not None for v in line):
                            yield (where, *[line[i] if 0 <= i < len(line) else None for i in at])

        yield from _frames(rows(), ["file", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(read, "file string, " + ", ".join(f"`{n}` string" for n in names))
    # spreadsheets store numbers in scientific notation where they are long
    number = lambda n: F.coalesce(F.expr(f"try_cast(`{n}` as double)"), amount_text(F.col(n)))
    return out.select("file", *[number(n).alias(n) if n in numbers else F.col(n) for n in names])


def latest_archive(df: DataFrame, key: Sequence[str], order: str = "archive") -> DataFrame:
    """Of each key the row of the archive whose name comes last: later deliveries replace earlier ones."""
    rest = [c for c in df.columns if c not in (*key, order)]
    best = F.max(F.struct(order, *rest)).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, F.col(f"_b.{order}").alias(order), *[F.col(f"_b.{c}").alias(c) for c in rest])
