"""Incremental maintenance: staleness, keyed replacement of facts, debounced change feeds.

Staleness is a batch question over the reverse include graph; applying results is a keyed replace in ``foreachBatch``, so a
batch that is run again after a failure gives the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import report
from lodestar.operators.graph import nearest
from lodestar.operators.sets import build_diff
from lodestar.session import cut


def simple_dirty(includes: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and all that depends on them: (file_id)."""
    edges = includes.select(F.col("dst_file").alias("src"), F.col("src_file").alias("dst"))
    return nearest(edges, changed).select(F.col("node").alias("file_id"))


def modified_dirty(includes: DataFrame, files: DataFrame, sources: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Sources of which something they include (themselves too) is newer than their parse, or missing; only by ``changed`` files if given."""
    newest = newest_below(includes, files, sources, changed)
    return newest.join(files.select("file_id", "parsed_ms"), "file_id").where("newest > parsed_ms").select("file_id")


def newest_below(includes: DataFrame, files: DataFrame, sources: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(file_id, newest): the greatest mtime_ms of what each source includes, itself too; the greatest long where something is missing.

    Times climb the include edges until none rises any more: one row a file, and a round joins only those that rose in the last.
    """
    e = cut(includes.select(F.col("src_file").alias("file_id"), F.col("dst_file").alias("below")).where("file_id <> below").distinct())
    nodes = e.select("file_id").union(e.select("below")).union(sources.select("file_id")).distinct()
    held = nodes.join(files.select("file_id", "mtime_ms"), "file_id", "left").select("file_id", F.coalesce("mtime_ms", F.lit((1 << 63) - 1)).alias("newest"))
    if changed is not None:
        held = held.join(changed.select(F.col(changed.columns[0]).alias("file_id"), F.lit(True).alias("_c")).distinct(), "file_id", "left").select("file_id", F.when(F.col("_c"), F.col("newest")).otherwise(F.lit(-1).cast("long")).alias("newest"))
    held = rose = cut(held)
    while True:
        offer = rose.select(F.col("file_id").alias("below"), "newest").join(e, "below").groupBy("file_id").agg(F.max("newest").alias("offer"))
        rose = cut(held.join(offer, "file_id").where(F.col("offer") > F.col("newest")).select("file_id", F.col("offer").alias("newest")))
        if rose.isEmpty():
            return held.join(sources.select("file_id").distinct(), "file_id", "left_semi")
        held = cut(held.join(rose.withColumnRenamed("newest", "_n"), "file_id", "left").select("file_id", F.coalesce("_n", "newest").alias("newest")))


def replace_by_key(old: DataFrame, delta: DataFrame, keys: list[str], visited: DataFrame | None = None) -> DataFrame:
    """Rows of the visited keys replaced by the delta's; ``visited`` also names keys that are now empty."""
    gone = (delta if visited is None else visited).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(delta)


def invalid_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Files (file_id) of which some table is missing: expected and present are (file_id, table)."""
    return expected.join(present, ["file_id", "table"], "left_anti").select("file_id").distinct()


def not_suspended(jobs: DataFrame, suspended: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    out = jobs.join(suspended.select("file_id"), "file_id", "left_anti")
    return out if projects is None else out.join(projects.select("project_id"), "project_id", "left_anti")


def reload_database(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two loads of a compile database."""
    return build_diff(old, new, ["path"], ["arguments"])


def maintain_files(project_files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files (dir, name) after added and removed ones (dir, name, change)."""
    kept = project_files.join(changes.where("change = 'removed'"), ["dir", "name"], "left_anti")
    return kept.unionByName(changes.where("change = 'added'").select("dir", "name")).distinct()


def last_request(requests: DataFrame) -> DataFrame:
    """The newest completion request of each source: (source, seq, ...)."""
    return requests.groupBy("source").agg(F.max_by(F.struct(*[c for c in requests.columns if c != "source"]), "seq").alias("r")).select("source", "r.*")


class Versioned:
    """A Parquet table with versions, in buckets by key: each write is a new folder, pointer rows name the current folder of each bucket. Readers never see half a write.

    Only the buckets that a write touches are read and written again; pointers of one write appear together, as one file.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _pointers(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema("version bigint, batch bigint, bucket int, folder string").json(f"{self.path}/versions")

    def _folders(self) -> dict[int, str]:
        """The current folder of each bucket that has any row; at most as many as buckets."""
        p = self._pointers()
        if p is None:
            return {}
        last = p.where("bucket is not null").groupBy("bucket").agg(F.max_by(F.struct("folder"), "version").alias("f")).collect()
        return {r["bucket"]: r["f"]["folder"] for r in last if r["f"]["folder"]}

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        folders = [f for b, f in self._folders().items() if buckets is None or b in buckets]
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else empty

    def done(self, batch: int) -> bool:
        p = self._pointers()
        return p is not None and not p.where(F.col("batch") == batch).isEmpty()

    def bucket(self, keys: list[str]) -> F.Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, delta: DataFrame, keys: list[str]) -> list[int]:
        """Buckets with a key of the delta; at most as many as there are."""
        return sorted(r[0] for r in delta.select(self.bucket(keys)).distinct().collect())

    def write(self, df: DataFrame, batch: int, keys: list[str], buckets: list[int]) -> None:
        """Replaces the rows of ``buckets`` by ``df``."""
        p = self._pointers()
        version = ((p.agg(F.max("version")).first()[0] if p is not None else None) or 0) + 1
        folder = f"data-{version}-{uuid.uuid4().hex}"
        df.withColumn("_bucket", self.bucket(keys)).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()
        full = {r[0] for r in made}
        rows = [(version, batch, b, f"{folder}/_bucket={b}" if b in full else None) for b in buckets] or [(version, batch, None, None)]
        schema = "version bigint, batch bigint, bucket int, folder string"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{self.path}/versions")


def apply_deltas(stream: DataFrame, table: Versioned, keys: list[str], checkpoint: str, seq: str = "seq", trigger: dict | None = None):
    """Starts a query that applies a stream of facts by keyed replace.

    Within a batch only the latest delta of a key counts (column ``seq``); a batch already applied is skipped.
    """

    def batch(df: DataFrame, number: int) -> None:
        if table.done(number) or df.isEmpty():
            return
        last = df.groupBy(*keys).agg(F.max(seq).alias("_last"))
        rows = df.join(last, keys).where(F.col(seq) == F.col("_last")).drop("_last", seq)
        buckets = table.touched(rows, keys)
        old = table.current(buckets)
        table.write(replace_by_key(old, rows.select(*old.columns), keys), number, keys, buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(stream: DataFrame, on_changed: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "100 milliseconds"):
    """Starts a debounced change feed: each micro-batch hands over its distinct changed files once."""
    return stream.writeStream.foreachBatch(lambda df, n: on_changed(df.select("file_id").distinct(), n)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def active_only(diagnostics: DataFrame, buffers: DataFrame) -> DataFrame:
    """Diagnostics of files that are active in an editor, to be pushed there; all of them as long as no buffers are set at all."""
    active = buffers.agg(F.count("*").alias("_set"), F.collect_set(F.when(F.col("state") == "active", F.col("file_id"))).alias("_active"))  # what an editor has open
    return diagnostics.join(F.broadcast(active)).where("_set = 0 or array_contains(_active, file_id)").drop("_set", "_active")  # one row


def publish(diagnostics: DataFrame, files: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(subscriber, path, text): each file's diagnostics of a subscriber's levels in its format: xml, json or lisp.

    subscribers: (subscriber, format, levels array).
    """
    wanted = diagnostics.join(subscribers.select("subscriber", "format", F.explode("levels").alias("severity")), "severity")
    item = F.struct("line", "col", F.coalesce("length", F.lit(-1)).alias("length"), "severity", "message")
    lists = wanted.groupBy("subscriber", "format", "file_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # one file's
    named = lists.join(files.select("file_id", "path"), "file_id")
    form = {"xml": report.file_xml(), "json": F.to_json(F.struct("path", "items")), "lisp": report.file_lisp()}
    text = F.lit(None).cast("string")
    for name, column in form.items():
        text = F.when(F.col("format") == name, column).otherwise(text)
    return named.select("subscriber", "path", text.alias("text"))


def subscribe(stream: DataFrame, levels: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Pushes diagnostics of some levels to a sink as they come."""
    return stream.where(F.col("severity").isin(levels)).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
