"""Markdown files with a YAML head: reading, parsing, writing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEAD = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"


PARSED = T.StructType([T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("content", T.StringType())])


@F.pandas_udf(PARSED)
def parse(raw: pd.Series) -> pd.DataFrame:
    """Head and body of each file, the body stripped; a file without a head is all body, a broken head gives nothing."""
    import re

    import yaml

    rows = []
    for text in raw:
        head = re.match(_HEAD, text or "")
        if not head:
            rows.append(({}, (text or "").strip()))
            continue
        try:
            data = yaml.safe_load(head[1]) or {}
            rows.append(({str(k): None if v is None else str(v) for k, v in data.items()}, head[2].strip()))
        except (yaml.YAMLError, AttributeError):
            rows.append(({}, ""))
    return pd.DataFrame(rows, columns=["metadata", "content"])


def _plain(value: Column) -> Column:
    """A scalar without its quotes and escapes; null where it stands for nothing."""
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    single = F.replace(F.regexp_extract(value, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(value.rlike('^".*"$'), quoted).when(value.rlike("^'.*'$"), single).when(~value.isin("", "null", "~"), value)


def parse_flat(raw: Column) -> Column:
    """The same for heads of ``key: value`` lines, plain or as ``render`` writes them, as an expression without Python."""
    has = raw.rlike(_HEAD)
    lines = F.filter(F.split(F.regexp_extract(raw, _HEAD, 1), r"\r?\n"), lambda x: x.rlike(r"^[\w-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), _plain(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1))).alias("value")))
    body = F.when(has, F.regexp_extract(raw, _HEAD, 2)).otherwise(raw)
    return F.struct(F.map_from_entries(pairs).alias("metadata"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("content"))


def with_url(df: DataFrame) -> DataFrame:
    """Adds ``url``: the head's source_url if it has one (a null one counts), else its source_file without a leading ``crawled/``, else its url."""
    m = F.col("metadata")
    url = F.when(F.map_contains_key(m, "source_url"), m["source_url"]).when(F.map_contains_key(m, "source_file"), F.regexp_replace(m["source_file"], "^crawled/", "")).otherwise(m["url"])
    return df.withColumn("url", url)


def site_of(path: Column, root: str) -> Column:
    """First folder of a path below ``root``; null for files in the root itself."""
    below = F.regexp_replace(F.regexp_replace(path, "^file:(?://)?", ""), "^" + root.rstrip("/").removeprefix("file://").removeprefix("file:").replace(".", r"\.") + "/", "")
    return F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1))


def read(spark: SparkSession, root: str, site: str | None = None) -> DataFrame:
    """``path, metadata, content, url`` of all Markdown files below ``root``, or of one site's folder, that have content."""
    return _files(spark, root, site).filter("content <> ''")


def rejected(spark: SparkSession, root: str, site: str | None = None) -> DataFrame:
    """``path`` of the Markdown files that give no document: empty ones and those with a broken head."""
    return _files(spark, root, site).filter("content = ''").select("path")


def raw_files(spark: SparkSession, root: str, site: str | None = None) -> DataFrame:
    """``path, raw`` of all Markdown files below ``root``, or of one site's folder."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    df = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return df if site is None else df.filter(site_of(F.col("path"), root) == site)


def _files(spark: SparkSession, root: str, site: str | None) -> DataFrame:
    return with_url(raw_files(spark, root, site).select("path", parse(F.col("raw")).alias("p")).select("path", "p.*"))


def quoted(value: Column) -> Column:
    """A string as a YAML scalar in double quotes, as JSON writes it; characters that YAML can't hold are left out."""
    json = F.to_json(F.struct(F.regexp_replace(value, r"[\x7f-\x84\x86-\x9f\ufffe\uffff]", "").alias("v")))
    for sign in ("\x85", "\u2028", "\u2029"):  # line ends to YAML, but not to JSON
        json = F.replace(json, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.regexp_extract(json, r'(?s)^\{"v":(.*)\}$', 1)


def render(fields: dict[str, Column], body: Column) -> Column:
    """Head and body as one text.  Strings are quoted, so any title reads back as it was; null fields are written as ``null``."""
    lines = [F.concat(F.lit(f"{k}: "), F.when(c.isNull(), "null").otherwise(quoted(c.cast("string")))) for k, c in sorted(fields.items())]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def write(df: DataFrame, path: str, text_col: str = "rendered") -> None:
    """One Parquet table of rendered files, by site; a file for each document is for ``export`` alone."""
    df.select("site_name", "file_name", text_col).write.mode("overwrite").partitionBy("site_name").parquet(path)


def export(df: DataFrame, root: str, text_col: str = "rendered") -> None:
    """A file for each row at ``root/site_name/parsed/file_name``; ``root`` must be a folder that all executors share.

    A file is written beside its place and then renamed, so a task that runs again leaves whole files.  Names in
    ``old_names``, where there is such a column, are removed afterwards, unless some row has that name.
    """
    root = root.removeprefix("file://").rstrip("/")

    def put(rows):
        import os
        import uuid

        for r in rows:
            folder = f"{root}/{r['site_name']}/parsed"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r[text_col])
            os.replace(part, f"{folder}/{r['file_name']}")

    def remove(rows):
        import contextlib
        import os

        for r in rows:
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{root}/{r['site_name']}/parsed/{r['old']}")

    df.select("site_name", "file_name", text_col).foreachPartition(put)
    if "old_names" in df.columns:
        gone = df.select("site_name", F.explode("old_names").alias("old"))
        gone.join(df.select("site_name", F.col("file_name").alias("old")), ["site_name", "old"], "left_anti").foreachPartition(remove)
