"""Readers: compile databases, directory scans, lines of files, saved fact tables, configuration and project roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.commandline import parse_commands
from lodestar.functions.predicates import scan_filter
from lodestar.schema import TABLES


def compile_database(spark: SparkSession, path: str) -> DataFrame:
    """(directory, file, command) of a compile database; records with an arguments array get their command from it."""
    schema = "directory STRING, file STRING, command STRING, arguments ARRAY<STRING>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select("directory", "file", F.coalesce("command", F.array_join("arguments", " ")).alias("command")).where("command is not null")


def sources_of(commands: DataFrame) -> DataFrame:
    """Source rows with build_index counted per path."""
    rows = parse_commands(commands)
    return rows.withColumn("build_index", F.row_number().over(Window.partitionBy("path").orderBy("compiler", F.array_join("arguments", " "), F.col("output"))) - 1)


def scan(spark: SparkSession, root: str, filters: list[str] | None = None, ignore_file: str = "lodestar-ignore") -> DataFrame:
    """(dir, name, mtime_ms, size) of all files below a root but those filtered and those below a directory that holds the ignore file.

    Contents are not read. Spark lists no names that start with a dot or an underscore, so the ignore file has a plain name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "modificationTime", "length")
    rows = found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    ignored = rows.where(F.col("name") == ignore_file).select(F.col("dir").alias("_above")).distinct()
    above = rows.select("path", F.explode(ancestors(F.col("dir"))).alias("_above"))
    gone = above.join(ignored, "_above").select("path").distinct()
    rows = rows.join(gone, "path", "left_anti")
    return (rows.where(~scan_filter(F.col("path"), filters)) if filters else rows).drop("path")


def lines(texts: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """(file_id, line, text), lines from 1."""
    return texts.select(F.col(file_id).alias("file_id"), F.posexplode(F.split(F.col(text), "\n")).alias("_p", "text")).select("file_id", (F.col("_p") + 1).alias("line"), "text")


def overlay(files: DataFrame, unsaved: DataFrame) -> DataFrame:
    """(file_id, text) with the unsaved text where there is one."""
    u = unsaved.select("file_id", F.col("text").alias("_unsaved"))
    return files.join(u, "file_id", "left").select("file_id", F.coalesce("_unsaved", "text").alias("text"))


def words(file_lines: DataFrame) -> DataFrame:
    """Tokens of lines split at single spaces: (file_id, line, col, spelling); columns from 1. Null lines have none.

    Columns are running sums of lengths, which functions over arrays give in quadratic time only; Arrow kernels make them in one pass over a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = pc.split_pattern(b.column("text"), " ")
            spelling, row = split.flatten(), pc.list_parent_indices(split)
            parent = row.to_numpy()
            after = np.cumsum(pc.utf8_length(spelling).to_numpy().astype(np.int64) + 1)  # up to and with each token's space
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.empty(0, np.int64)
            before = np.r_[0, after[:-1]][: len(after)]
            col = before - np.repeat(before[first], np.diff(np.r_[first, len(parent)])) + 1
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(row), b.column("line").take(row), pa.array(col.astype(np.int32)), spelling], ["file_id", "line", "col", "spelling"])

    return file_lines.select(F.col("file_id").cast("int"), F.col("line").cast("int"), F.col("text").cast("string")).mapInArrow(run, "file_id int, line int, col int, spelling string")


def include_directives(file_lines: DataFrame) -> DataFrame:
    """The #include lines of files as symbols: (file_id, line, col, symbol_name, kind, spelling); col is that of the #."""
    pattern = r'^(\s*)#\s*include\s*([<"][^>"]*[>"])'
    part = lambda k: F.regexp_extract("text", pattern, k)
    hit = file_lines.where(F.col("text").rlike(pattern))
    return hit.select("file_id", "line", (F.length(part(1)) + 1).alias("col"), F.concat(F.lit("#include "), part(2)).alias("symbol_name"), F.lit("InclusionDirective").alias("kind"), F.regexp_replace(part(2), '[<>"]', "").alias("spelling"))


def guess_commands(files: DataFrame, project_files: DataFrame, roots: DataFrame, compiler: str = "/usr/bin/g++") -> DataFrame:
    """Compile commands (directory, command) for files without any: (path) from ``files``, with the folders that hold headers.

    Include paths are a file's own folder and, below each root (dir) that holds the file, the folders with headers and those between them and the root.
    """
    heads = project_files.where(F.col("name").rlike(r"\.(h|hh|hpp|hxx|H)$")).select("dir").distinct()
    up = heads.select(F.col("dir").alias("head"), F.explode(ancestors(F.col("dir"))).alias("dir"))
    below = up.join(roots.select("dir").distinct(), "dir").select("head", F.col("dir").alias("root"))
    between = below.select("root", "head", F.explode(ancestors(F.col("head"))).alias("inc")).where(F.length("inc") >= F.length("root")).select("root", "inc").distinct()
    own = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("own"))
    of = own.select("path", F.explode(ancestors(F.col("own"))).alias("root")).join(between, "root").select("path", "inc")
    every = of.union(own.select("path", F.col("own").alias("inc"))).groupBy("path").agg(F.sort_array(F.collect_set("inc")).alias("incs"))  # the header folders of a project
    flags = F.array_join(F.transform("incs", lambda i: F.concat(F.lit("-I"), i)), " ")
    return every.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), F.concat_ws(" ", F.lit(compiler), "path", flags).alias("command"))


def ancestors(path: F.Column) -> F.Column:
    """All directories above and including a directory, the outermost first; the root is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def nearest_config(paths: DataFrame, config: DataFrame) -> DataFrame:
    """(path, key, value): per path and key the setting (dir, key, value) of the nearest directory above."""
    up = paths.select("path", F.posexplode(ancestors(F.regexp_extract("path", "^(.*)/[^/]*$", 1))).alias("depth", "dir"))
    return up.join(config, "dir").groupBy("path", "key").agg(F.max_by("value", "depth").alias("value"))


def project_root(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, root) from directories with markers (dir, priority, authoritative, shallow).

    An authoritative marker decides at once, the nearest first; others give the outermost directory (the nearest if shallow) of the least priority.
    """
    up = paths.select("path", F.posexplode(ancestors(F.regexp_extract("path", "^(.*)/[^/]*$", 1))).alias("depth", "dir"))
    hit = up.join(markers, "dir")
    key = F.struct(F.when(F.col("authoritative"), 0).otherwise(1), F.col("priority"), F.when(F.col("shallow") | F.col("authoritative"), -F.col("depth")).otherwise(F.col("depth")))
    return hit.groupBy("path").agg(F.min_by("dir", key).alias("root"))


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Writes fact tables as Parquet, sorted within files by their key, so that row groups prune."""
    keys = {"symbols": ["file_id", "line", "col"], "symbol_names": ["name"], "usrs": ["usr"], "targets": ["usr"], "tokens": ["file_id", "offset"]}
    for name, df in tables.items():
        by = keys.get(name, df.columns[:1])
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Reads fact tables; a missing or odd column is an error at once."""
    out = {}
    for name in names or list(TABLES):
        df = spark.read.parquet(f"{path}/{name}")
        want = {f.name for f in spark.createDataFrame([], TABLES[name]).schema} if name in TABLES else set()
        if not set(df.columns) <= want:
            raise ValueError(f"{name}: unknown columns {sorted(set(df.columns) - want)}")
        out[name] = df
    return out


def remote(sources: DataFrame, part: str) -> DataFrame:
    """Only sources whose path holds a part."""
    return sources.where(F.col("path").contains(part)) if part else sources
