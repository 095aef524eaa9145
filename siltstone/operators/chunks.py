"""Chunking of Markdown and the identity of chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# From coarse to fine: headings, rules and fences, paragraphs, lines, words, characters.
SEPARATORS = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n```", "\n---\n", "\n\n", "\n", " ", "")


def _pieces(text: str, size: int, level: int) -> list[str]:
    """The text in pieces of at most ``size`` characters that put together give the text; cuts come before separators."""
    if len(text) <= size:
        return [text] if text else []
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    sep = SEPARATORS[level]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts, at = [], 0
    while at < len(text):
        nxt = text.find(sep, at + 1)
        nxt = len(text) if nxt < 0 else nxt
        parts.append(text[at:nxt])
        at = nxt
    return [x for p in parts for x in (_pieces(p, size, level + 1) if len(p) > size else [p])]


def split_text(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Chunks of at most ``size`` characters; each repeats the last pieces of the one before, ``overlap`` characters at most."""
    out, held, length = [], [], 0
    for piece in _pieces(text, size, 0):
        if held and length + len(piece) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def chunk(df: DataFrame, text_col: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row for each chunk: the columns of ``df`` but the text, and ``page_content, chunk_index, total_chunks``; blank texts have none."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: split_text(t or "", size, overlap))

    rest = [c for c in df.columns if c != text_col]
    d = df.withColumn("__chunks", run(F.col(text_col))).withColumn("total_chunks", F.size("__chunks"))
    return d.select(*rest, F.posexplode("__chunks").alias("chunk_index", "page_content"), "total_chunks")


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(F.sha2(F.regexp_replace(path, "^file:(?://)?", ""), 256), F.lit(":"), index.cast("string"))


def metadata(path: Column, source_url: Column, url: Column) -> Column:
    """(source_id, source_path, file_name, source_url, url, citation_url) of a file's chunks."""
    name = F.element_at(F.split(path, "/"), -1)
    source = F.coalesce(source_url, url)
    return F.struct(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("source_id"), path.alias("source_path"), name.alias("file_name"), source.alias("source_url"), F.coalesce(source_url, url).alias("url"), source.alias("citation_url")
    )
