"""Cutting texts into located chunks: heads, windows of whole lines, and the definition around a window."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxrank.functions.fixed import BOUNDARY, CHUNK_CHARS, SOFT_MINIMUM, SYMBOL


def head_chunks(files: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """One chunk a file (path, text): a header line and the first characters; blank texts have none."""
    head = F.substring("text", 1, chars)
    rows = files.where(F.col("text").rlike(r"\S"))
    return rows.select("path", F.lit(1).cast("bigint").alias("start_line"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("end_line"), (F.length("text") <= chars).alias("whole_file"), F.concat(F.lit("# File: "), F.col("path"), F.lit("\n"), head).alias("text"))


def split_lines(text: str) -> list[str]:
    """Lines with their ends."""
    return text.splitlines(keepends=True)


#: What SQL's trim() takes off, and the line end.
SPACES = "\n \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def newline_lines(text: str) -> list[str]:
    """Lines with their ends, cut at newlines alone; an empty text is one empty line."""
    parts = text.split("\n")
    lines = [f"{x}\n" for x in parts[:-1]]
    return [*lines, parts[-1]] if parts[-1] or not lines else lines


def windows(lines: list[str], chars: int = CHUNK_CHARS, space: str | None = None) -> list[tuple[int, int, str]]:
    """(first, last, text): a window closes once it is three quarters full and the next line starts a definition or is blank (of `space`), or when it is full."""
    boundary, out, first, size = re.compile(BOUNDARY), [], 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        following = lines[i + 1] if i + 1 < len(lines) else None
        natural = following is not None and (boundary.match(following) is not None or not following.strip(space))
        if size >= chars or size >= SOFT_MINIMUM * chars and natural:
            out.append((first, i, "".join(lines[first : i + 1])))
            first, size = i + 1, 0
    if first < len(lines):
        out.append((first, len(lines) - 1, "".join(lines[first:])))
    return out


def enclosing(lines: list[str], start: int) -> str | None:
    """The nearest definition before a window that is less indented than its first line with text (of twelve), or equally so on the line just before; with its class."""
    symbol = re.compile(SYMBOL)
    line = next((x for x in lines[start : start + 12] if x.strip()), None)
    if line is None:
        return None
    depth = len(line) - len(line.lstrip())
    for i in range(start - 1, -1, -1):
        m = symbol.match(lines[i])
        if not m:
            continue
        indent = len(m[1])
        if indent < depth or indent == depth and i == start - 1:
            if indent:
                for j in range(i - 1, -1, -1):
                    c = symbol.match(lines[j])
                    if c and len(c[1]) < indent and lines[j].lstrip().startswith("class "):
                        return f"{c[2]}.{m[2]}"
            return m[2]
    return None


SCHEMA = "path string, part bigint, start_line bigint, end_line bigint, symbol string, whole_file boolean, body string"


def window_chunks(files: DataFrame, chars: int = CHUNK_CHARS, cut: Callable[[str], list[str]] = split_lines, space: str | None = None, blank: bool = False) -> DataFrame:
    """(path, part, start_line, end_line, symbol, whole_file, body): one narrow pass, a file a row; blank texts have chunks if `blank`."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.path, pdf.text):
                if text is None or not blank and not text.strip():
                    continue
                lines = cut(text)
                found = windows(lines, chars, space)
                rows += [(path, k, a + 1, b + 1, enclosing(lines, a), len(found) == 1, body) for k, (a, b, body) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "part", "start_line", "end_line", "symbol", "whole_file", "body"])

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def with_header(chunks: DataFrame) -> DataFrame:
    inside = F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" -- inside "), "symbol")).otherwise("")
    header = F.concat(F.lit("# File: "), "path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"), inside)
    return chunks.withColumn("text", F.concat(header, F.lit("\n"), "body"))


def source_lines(chunks: DataFrame, header_lines: int = 1) -> DataFrame:
    """(path, part, offset, line_no, line): line numbers in the file, null within the header."""
    rows = chunks.select("path", "part", "start_line", F.posexplode(F.split("text", "\n")).alias("offset", "line"))
    return rows.select("path", "part", F.col("offset").cast("bigint").alias("offset"), F.when(F.col("offset") >= header_lines, F.col("start_line") + F.col("offset") - header_lines).cast("bigint").alias("line_no"), "line")
