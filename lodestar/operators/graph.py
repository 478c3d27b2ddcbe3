"""Graphs of includes, classes and calls: closures, paths, trees, reports.

Edges are (src, dst). Closures walk level by level from all seeds at once: a join with the frontier and an anti join
with what has been seen, checkpointed each round. Rounds end by themselves on any graph, cycles included.
Where only the nearest seed matters, or only whether there is one, a walk keeps one row a node however many seeds reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) of all nodes that each seed reaches, itself at depth 0; depth is the shortest."""
    e = edges.select(F.col("src"), F.col("dst")).distinct()
    e = cut(e.where("src <> dst"))
    front = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    seen = front = cut(front)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.union(front)) if depth % 8 == 0 else seen.union(front)
    return seen


def nearest(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, seed) of all nodes that any seed reaches: the least depth and of the seeds at that depth the least. One row a node.

    The nearest seeds of a node at depth d are those of its neighbours at depth d - 1, so each level hands on one label.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    first = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    seen = front = cut(first.select("node", F.lit(0).alias("depth"), F.col("node").alias("seed")))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("seed").alias("seed"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "seed"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front)) if depth % 8 == 0 else seen.union(front)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependencies(includes: DataFrame, seeds: DataFrame, mode: str) -> DataFrame:
    """(seed, node, depth) for mode ``arg_depends_on`` (what a file includes) or ``depends_on_arg`` (what includes it).

    The third mode, ``all`` files, is no closure: :func:`lodestar.operators.xref.scoped` lets its keys take all candidates.
    """
    edges = includes.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))
    if mode == "arg_depends_on":
        return closure(edges, seeds)
    if mode == "depends_on_arg":
        return closure(reverse(edges), seeds)
    raise ValueError(f"unknown mode {mode}")


def depends_on(includes: DataFrame, source: int, header: int) -> bool:
    """Whether a file reaches a header by includes."""
    seed = includes.sparkSession.createDataFrame([(source,)], "seed int")
    return not dependencies(includes, seed, "arg_depends_on").where(F.col("node") == header).isEmpty()


def direct(includes: DataFrame, file_id: int, reverse_: bool = False) -> DataFrame:
    a, b = ("dst_file", "src_file") if reverse_ else ("src_file", "dst_file")
    return includes.where(F.col(a) == file_id).select(F.col(b).alias("file_id")).distinct()


def adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, neighbours sorted), of all nodes or of those in ``nodes``."""
    e = edges if nodes is None else edges.join(nodes.select(F.col(nodes.columns[0]).alias("src")).distinct(), "src", "left_semi")
    return e.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))  # out-degree bounds the list


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_nodes: int = 8) -> DataFrame:
    """(end, path) of all paths without a repeated node from a start to an end of at most ``max_nodes`` nodes, both ends counted.

    A path stops at its end, but may lead through other ends. Only nodes from which an end is near enough are walked, so dead branches are never expanded.
    """
    s, t = starts.select(F.col(starts.columns[0]).alias("node")).distinct(), ends.select(F.col(ends.columns[0]).alias("end")).distinct()
    near = cut(closure(reverse(edges), t, max_nodes - 1).select(F.col("seed").alias("end"), "node", F.col("depth").alias("left")))
    e = cut(edges.select("src", F.col("dst").alias("node")).distinct().join(near, "node").withColumnRenamed("node", "dst"))
    front = cut(s.join(near, "node").where(F.col("left") < max_nodes).select("end", F.array("node").alias("path")))
    done = None
    for n in range(1, max_nodes + 1):
        last = F.element_at("path", -1)
        hit = front.where(last == F.col("end")).select("end", "path")
        done = hit if done is None else done.union(hit)
        if n == max_nodes:
            break
        rest = front.where(last != F.col("end")).withColumn("src", last)
        front = cut(rest.join(e, ["end", "src"]).where((F.col("left") + n + 1 <= max_nodes) & ~F.array_contains("path", F.col("dst"))).select("end", F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            break
    return done


def include_tree(edges: DataFrame, root: int) -> DataFrame:
    """(position, depth, node, expanded): depth-first order from a root, children by id, each node expanded at its first visit only.

    Which visit is the first depends on all before it, so one task walks; it gets the edges that the root reaches, found by a
    distributed walk, and reads each once, whatever the number of ways to a node.
    """
    spark = edges.sparkSession
    reached = nearest(edges, spark.createDataFrame([(root,)], "node int")).select(F.col("node").cast("long").alias("src"))
    mine = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct().join(reached, "src", "left_semi")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, list[int]] = {}
        for b in batches:
            for a, z in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                below.setdefault(a, []).append(z)
        rows, seen, open_ = [(1, 0, root, True)], {root}, [iter(sorted(below.get(root, ())))]
        while open_:
            node = next(open_[-1], None)
            if node is None:
                open_.pop()
                continue
            rows.append((len(rows) + 1, len(open_), node, node not in seen))
            if node not in seen:
                seen.add(node)
                open_.append(iter(sorted(below.get(node, ()))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["position", "depth", "node", "expanded"])

    # a row of no use keeps the one task from having no input at all
    none = spark.createDataFrame([(root, root)], "src long, dst long").where("src is not null")
    tree = mine.union(none).coalesce(1).mapInArrow(lambda batches: walk(b.filter(pc.not_equal(b.column("src"), b.column("dst"))) for b in batches), "position int, depth int, node long, expanded boolean")
    return tree.select("position", "depth", F.col("node").cast("int").alias("node"), "expanded")


def alias_headers(includes: DataFrame) -> DataFrame:
    """Headers that include exactly one other header: (src_file, dst_file)."""
    return includes.distinct().groupBy("src_file").agg(F.count("*").alias("n"), F.min("dst_file").alias("dst_file")).where("n = 1").select("src_file", "dst_file")


def header_source(includes: DataFrame, headers: DataFrame, sources: DataFrame) -> DataFrame:
    """For each header a source that depends on it: the nearest, then the least file id. ``sources``: file_id of compiled files.

    One walk from all sources at once. Headers that are sources themselves, which that walk gives to themselves, ask on their own.
    """
    edges = includes.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))
    heads = headers.select(F.col(headers.columns[0]).alias("header")).distinct()
    compiled = sources.select(F.col("file_id").alias("source")).distinct()
    down = nearest(edges, compiled).where("depth > 0").select(F.col("node").alias("header"), F.col("seed").alias("source"), "depth")
    found = heads.join(down, "header").select("header", "source", "depth")
    own = cut(heads.join(compiled, F.col("header") == F.col("source"), "left_semi"))
    if own.isEmpty():
        return found
    up = dependencies(includes, own, "depends_on_arg").where("depth > 0").join(compiled, F.col("node") == F.col("source"))
    best = up.groupBy(F.col("seed").alias("header")).agg(F.min(F.struct("depth", "source")).alias("best"))
    return found.union(best.select("header", "best.source", "best.depth"))


def has_source(includes: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, has_source): whether anything compiled depends on a file, itself included. One walk from all sources at once."""
    edges = includes.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))
    hit = nearest(edges, sources.select("file_id")).select(F.col("node").alias("file_id"))
    f = files.select(F.col(files.columns[0]).alias("file_id")).distinct()
    return f.join(hit.withColumn("_hit", F.lit(True)), "file_id", "left").select("file_id", F.coalesce("_hit", F.lit(False)).alias("has_source"))


def reaches_buffer(includes: DataFrame, sources: DataFrame, buffers: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that reach an open or active buffer other than themselves by includes, through files outside of the system: (file_id).

    One walk back from all buffers at once; sources that are buffers, no more than an editor has open, ask on their own.
    """
    user = files.where(~F.col("is_system")).select(F.col("file_id").alias("dst_file"))
    inside = includes.join(user, "dst_file", "left_semi")
    edges = inside.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))
    ask = sources.select(F.col(sources.columns[0]).alias("file_id")).distinct()
    open_ = buffers.select("file_id").distinct()
    back = nearest(reverse(edges), open_).where("depth > 0").select(F.col("node").alias("file_id"))
    found = ask.join(back, "file_id", "left_semi")
    own = cut(ask.join(open_, "file_id", "left_semi"))
    if own.isEmpty():
        return found
    down = closure(edges, own).where("depth > 0").join(open_.withColumnRenamed("file_id", "node"), "node", "left_semi")
    return found.union(down.select(F.col("seed").alias("file_id"))).distinct()


def unneeded_includes(includes: DataFrame, references: DataFrame, system: DataFrame) -> DataFrame:
    """Include edges a -> b where nothing in a refers into b or what b includes; files in ``system`` (file_id) are not judged.

    references: (from_file, to_file), one row a referring pair is enough.
    """
    edges = includes.distinct().join(system.select(F.col("file_id").alias("src_file")), "src_file", "left_anti")
    below = dependencies(includes, edges.select("dst_file").distinct(), "arg_depends_on").select(F.col("seed").alias("dst_file"), F.col("node").alias("to_file"))
    used = references.select(F.col("from_file").alias("src_file"), "to_file").distinct()
    needed = edges.join(used, "src_file").join(below, ["dst_file", "to_file"], "left_semi").select("src_file", "dst_file").distinct()
    return edges.join(needed, ["src_file", "dst_file"], "left_anti")


def missing_includes(includes: DataFrame, references: DataFrame) -> DataFrame:
    """(from_file, to_file): used files that the user does not include directly."""
    used = references.where("from_file <> to_file").select("from_file", "to_file").distinct()
    return used.join(includes.select(F.col("src_file").alias("from_file"), F.col("dst_file").alias("to_file")), ["from_file", "to_file"], "left_anti")


def replace_edges(includes: DataFrame, visited: DataFrame, new: DataFrame, failed: bool = False) -> DataFrame:
    """Edges after files were visited anew: theirs are replaced; a failed visit only adds."""
    old = includes if failed else includes.join(visited.select(F.col("file_id").alias("src_file")), "src_file", "left_anti")
    return old.unionByName(new).distinct()


def hierarchy(bases: DataFrame, usr: str, down: bool = False) -> DataFrame:
    """(depth, usr, path): super classes of a class, or with ``down`` its sub classes, as a tree; bases: (usr, base). Cycles end at a repeated class."""
    e = bases.select(F.col("base" if down else "usr").alias("src"), F.col("usr" if down else "base").alias("dst")).distinct()
    e = cut(e)
    front = cut(e.sparkSession.createDataFrame([(usr, [usr])], "usr string, path array<string>"))
    rows = front
    while True:
        front = cut(front.join(e, F.col("usr") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("usr"), F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            break
        rows = rows.union(front)
    return rows.select((F.size("path") - 1).alias("depth"), "usr", "path")


def call_tree(calls: DataFrame, root: str, max_depth: int = 5) -> DataFrame:
    """(depth, function): callers of a function, their callers and so on, each at its least depth; calls: (caller, callee)."""
    edges = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    seed = calls.sparkSession.createDataFrame([(root,)], "seed string")
    return closure(edges, seed, max_depth).select("depth", F.col("node").alias("function"))
