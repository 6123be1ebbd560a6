"""Sources: source trees, version-control text, interface descriptions and symbol indexes, all as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions.extract import BY_EXTENSION

MOST_BYTES = 10 << 20
SKIPPED = ["node_modules", "target", "build", "dist", "vendor", "__pycache__", "venv"]


def source_tree(spark: SparkSession, root: str, skipped: list[str] = SKIPPED) -> DataFrame:
    """Path (from the root), content, lang and an order key of the files that can be parsed; hidden and skipped folders and files over 10 MiB are left out.

    A folder's files come before its subfolders, both by name.
    """
    base = root.rstrip("/")
    glob = "*{" + ",".join(sorted(BY_EXTENSION)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    rows = files.where(F.col("length") <= MOST_BYTES)
    path = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    rows = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    rows = rows.where(~F.exists(folders, lambda p: p.startswith(".") | p.isin(skipped)))
    key = F.transform(parts, lambda p, k: F.concat(F.when(k == F.size(parts) - 1, "0").otherwise("1"), p))
    ext = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    lang = F.lit(None).cast("string")
    for e, name in BY_EXTENSION.items():
        lang = F.when(ext == e, name).otherwise(lang)
    return rows.select("path", "content", lang.alias("lang"), key.alias("order_key"))


def name_only_log(lines: DataFrame) -> DataFrame:
    """Distinct (sha, file) of a log with names only. lines: log, k, text; a line of 40 hexadecimal digits begins a commit."""
    w = W.partitionBy("log").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    sha = F.when(F.col("text").rlike("^[0-9a-f]{40}$"), F.col("text"))
    rows = lines.withColumn("sha", F.last(sha, True).over(w)).where(sha.isNull() & (F.trim("text") != "") & F.col("sha").isNotNull())
    return rows.select("sha", F.col("text").alias("file")).distinct()


def numstat(lines: DataFrame) -> DataFrame:
    """File, added, removed of numstat lines (text); a dash counts as 0; other lines are left out."""
    p = F.split("text", "\t")
    n = lambda k: F.when(F.get(p, F.lit(k)) == "-", 0).otherwise(F.get(p, F.lit(k)).try_cast("long"))
    return lines.where(F.size(p) == 3).select(F.get(p, F.lit(2)).alias("file"), n(0).alias("added"), n(1).alias("removed")).where("added IS NOT NULL AND removed IS NOT NULL")


def openapi(spark: SparkSession, path: str) -> DataFrame:
    """Method, path, operation, summary, tags of every operation with an id."""
    schema = "paths map<string, map<string, struct<operationId: string, summary: string, tags: array<string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("paths").alias("path", "methods"))
    rows = rows.select("path", F.explode("methods").alias("method", "o")).where(F.lower("method").isin("get", "post", "put", "delete", "patch"))
    return rows.select(F.upper("method").alias("method"), "path", F.col("o.operationId").alias("operation"), "o.summary", "o.tags").where("operation IS NOT NULL")


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of the fields of a protocol-buffer message."""
    k = 0

    def varint() -> int:
        nonlocal k
        value = shift = 0
        while True:
            b = raw[k]
            k += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while k < len(raw):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, wire, varint()
        elif wire == 2:
            n = varint()
            yield number, wire, raw[k : k + n]
            k += n
        else:
            n = {1: 8, 5: 4}[wire]
            yield number, wire, raw[k : k + n]
            k += n


def packed(raw: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in raw:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def symbol_index(spark: SparkSession, path: str) -> DataFrame:
    """File, symbol, line (from 0), is_definition of every occurrence in index files, by their public message layout."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"].tolist():
                for number, _, document in fields(content):
                    if number != 2:
                        continue
                    parts = list(fields(document))
                    file = next((v.decode() for n, _, v in parts if n == 1), "")
                    for n, _, occurrence in parts:
                        if n == 2:
                            own = {a: v for a, _, v in fields(occurrence)}
                            span = packed(own.get(1, b""))
                            rows.append((file, own.get(2, b"").decode(), span[0] if span else 0, bool(own.get(3, 0) & 1)))
            yield pd.DataFrame(rows, columns=["file", "symbol", "line", "is_definition"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "file string, symbol string, line int, is_definition boolean")


def symbol_records(spark: SparkSession, path: str) -> DataFrame:
    """File, symbol, display_name, documentation of every symbol that index files describe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"].tolist():
                for number, _, document in fields(content):
                    if number != 2:
                        continue
                    parts = list(fields(document))
                    file = next((v.decode() for n, _, v in parts if n == 1), "")
                    for n, _, record in parts:
                        if n == 3:
                            own = list(fields(record))
                            one = lambda k: next((v.decode("utf-8", "replace") for a, _, v in own if a == k), "")  # noqa: B023, E731
                            rows.append((file, one(1), one(6), [v.decode("utf-8", "replace") for a, _, v in own if a == 3]))
            yield pd.DataFrame(rows, columns=["file", "symbol", "display_name", "documentation"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "file string, symbol string, display_name string, documentation array<string>")


def window(files: DataFrame, line: Column | None = None, around: int = 50, most: int = 2000) -> DataFrame:
    """Files (path, content) with language, total_lines, start_line, end_line and the lines around a line, or the first `most`; files that may hold credentials or aren't text are left out."""
    rows = files.where(~N.is_sensitive(F.col("path")) & (F.octet_length("content") <= MOST_BYTES) & N.is_text(F.substring(F.col("content").cast("binary"), 1, 8192)))
    rows = rows.withColumn("all", F.split("content", "\n")).withColumn("total_lines", F.size("all"))
    start = F.greatest(F.lit(1), line - around) if line is not None else F.lit(1)
    end = F.least(F.col("total_lines"), line + around) if line is not None else F.least(F.col("total_lines"), F.lit(most))
    rows = rows.withColumns({"start_line": start, "end_line": end, "language": N.syntax_lang(F.col("path"))})
    return rows.withColumn("lines", F.slice("all", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1))).drop("all", "content")


def segment(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Place, text of some lines of a file (from 1, both ends in), as far as they are there."""
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n")).alias("place", "text")).withColumn("place", F.col("place") + 1)
    return lines.where(F.col("place").between(max(1, start), end))


def matched_calls(lines: DataFrame, type_imports: DataFrame | None = None) -> DataFrame:
    """File, lineno, callee of calls that an outside matcher reports, one JSON object a line (text): once for each line and name, without names imported as types only (file, name)."""
    schema = "file string, range struct<start: struct<line: int>>, metaVariables struct<single: struct<NAME: struct<text: string>>>"
    found = lines.select(F.from_json("text", schema).alias("m")).select("m.file", (F.col("m.range.start.line") + 1).alias("lineno"), F.col("m.metaVariables.single.NAME.text").alias("callee"))
    found = found.where("callee IS NOT NULL").distinct()
    return found if type_imports is None else found.join(type_imports.withColumnRenamed("name", "callee"), ["file", "callee"], "left_anti").select("file", "lineno", "callee")
