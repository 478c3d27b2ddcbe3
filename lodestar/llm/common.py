"""What the corpus operators share: a folder every executor sees, intermediate
tables, word hashing and connected components.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` so
that a lost executor costs a re-read, never a recomputation of the lineage.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_paths: dict[int, tuple[DataFrame, str]] = {}
_dirs: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the folder its context checkpoints to. Only a local master may do without: it gets a fresh local folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        told = context._jsc.sc().getCheckpointDir()
        root = told.get() if told.isDefined() else None
    if not root:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _dirs.setdefault("local", (spark, tempfile.mkdtemp(prefix="lodestar-")))[1]
        root = root if "://" in root else "file://" + root
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is the cluster's scratch space
        pass


@contextmanager
def few_at_once(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While it lasts Spark sends a Python worker so many rows at once; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; removed when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    with few_at_once(spark):
        df.write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``: never a part of a group,
    and at least ``least`` rows but at the end. Holds one such table in memory, so groups must be bounded."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        last = [t.column(k)[-1].as_py() for k in keys]
        same = np.ones(t.num_rows, dtype=bool)
        for k, v in zip(keys, last, strict=True):
            same &= np.asarray(pa.compute.equal(t.column(k), pa.scalar(v, t.schema.field(k).type)))
        cut = t.num_rows - int(same.sum())
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` has written."""
    remove(df.sparkSession, _paths.pop(id(df))[1])


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(batches: Iterator[pa.RecordBatch], rows: int = 500, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes (one row at least), so that what a task makes of one stays small.

    Spark itself bounds what it sends at once, in rows and in bytes; :func:`materialise` lowers the rows.
    """
    for b in batches:
        step = max(1, min(rows, most * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class WordHashes(dict):
    """Word bytes to their 8-byte hash. Bounded: emptied when full, long words are not kept."""

    limit, longest = 200_000, 64

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_64_digest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


#: The one memo of word hashes of a worker.
WORDS = WordHashes()

_memos: dict[str, Callable[[], None]] = {"words": WORDS.clear}


def memo(name: str, clear: Callable[[], None]) -> None:
    """Makes a worker's memo known, so that :func:`use` can empty it."""
    _memos[name] = clear


def use(name: str) -> None:
    """Called by a task before it fills a memo: workers live on between stages, so what other operators keep is let go."""
    for other, clear in _memos.items():
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()


_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer over 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
        return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of word hashes ``h``; empty if there are fewer than k words.

    Doubling: the hash of a span of 2m words is made from those of its halves.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        spans, size, out, done = mixed(h + _MIX[2]), 1, None, 0
        rest = k
        while True:
            if rest & 1:
                part = spans[done : done + n]
                out = part.copy() if out is None else mixed(out * _MIX[3] + part)
                done += size
            rest >>= 1
            if not rest:
                return out
            spans = mixed(spans[:-size] * _MIX[4] + spans[size:])
            size *= 2


def as_long(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays], names)


def sampled(ids: DataFrame, group: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct ids (column doc_id, not null) of each group: those with the least hashes.

    Counts give each group's share first, so a group's window sorts about four times the bound, however many rows it has.
    """
    rows = ids.select(group, "doc_id").where(F.col(group).isNotNull() & F.col("doc_id").isNotNull())
    sizes = broadcast_if_small(rows.groupBy(group).agg(F.count("*").alias("_n")), "groups")  # else a very common group would meet in one task
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("_n") <= F.lit(4 * bound)
    near = rows.join(sizes, group).where(near).select(group, "doc_id").distinct()
    first = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= bound).select(group, "doc_id")


def broadcast_if_small(keys: DataFrame, name: str, most: int = 200_000, weigh: F.Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """A table of keys, written and counted: marked for broadcast up to ``most`` rows, else left for a shuffle join.

    ``weigh``: the bytes of a row's column of unbounded size; their sum must stay below ``most_bytes`` as well.
    """
    keys = materialise(keys, name)
    if weigh is None:
        return F.broadcast(keys) if keys.count() <= most else keys
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum(weigh), F.lit(0))).first()
    return F.broadcast(keys) if n <= most and size <= most_bytes else keys


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component = smallest node.

    Every round each node takes the least label among itself and its neighbours, and labels
    jump to their label's label. A hub with a third of all edges is only ever summed with a
    map-side partial ``min``; rounds are cut by written tables; nothing is collected.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct()
    e = materialise(e.union(e.select("b", "a")), "edges")
    labels = materialise(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        before = labels
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        near = e.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # hook: the old label itself also learns of the smaller one
        up = hooked.where("component < was").groupBy(F.col("was").alias("node")).agg(F.min("component").alias("up"))
        hooked = hooked.join(up, "node", "left").select("node", "was", F.least("component", "up").alias("component"))
        hooked = materialise(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = materialise(
            hooked.join(jump, "component", "left").select("node", "was", F.least("component", "root").alias("component")), "labels"
        )
        discard(before)
        discard(hooked)
        if labels.where("component <> was").isEmpty():
            discard(e)
            return labels.select("node", "component")
    raise RuntimeError("components did not converge")
