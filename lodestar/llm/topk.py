"""Exact top-k by inner product with a pivot-distance index.

Vectors are lifted to equal length (one more coordinate), so that the highest inner product is
the smallest distance. Every vector is keyed by its nearest pivot and its distance to it; a
pivot's vectors are cut, sorted by distance, into annuli of bounded size. A query first searches
its nearest annuli, which gives a k-th best distance; then only annuli remain that the triangle
inequality |d(q, p) - d(v, p)| cannot rule out.

Pivots are chosen on a bounded sample (``SAMPLE`` rows, farthest point first); every row is indexed.
A task holds one annulus; the queries that visit it stream through, in blocks that many tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small

#: Pivots, rows sampled for them, vectors in an annulus, queries multiplied with it at once, queries that go through one copy of it.
PIVOTS, SAMPLE, ANNULUS, BLOCK, STREAM = 32, 4000, 16384, 256, 65536
#: Most annuli of a pivot; beyond, an annulus is dealt on by hash.
RINGS = 64
#: Squared lengths below which sums of products are exact as doubles, and below which they fit a long.
EXACT, FITS = 2.0**53, 2.0**62


def integers(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(256 x) as long. Rows whose id or vector is null or that hold a null or non-finite component take no part.

    Nor do vectors so long (2**31 in these units) that their scores need not fit a long. An empty vector counts as zero.
    """
    x = F.transform(F.col(f"`{col}`"), lambda e: e.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    long_ = F.aggregate("x", F.lit(0.0), lambda a, e: a + (F.abs(e) * 256 + 1) * (F.abs(e) * 256 + 1))
    return rows.where(fine).where(long_ < FITS).select("vec_id", F.transform("x", lambda e: F.floor(e * 256).cast("long")).alias("v"))


def pivots_of(rows: DataFrame, pivots: int, sample: int, width: int) -> np.ndarray:
    """Farthest-point pivots among ``sample`` rows with the least hash of their id."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not got:
        return np.empty((0, 0))
    x = np.array([r["v"] + [0] * (width - len(r["v"])) for r in got], dtype=np.float64)
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat, sizes = np.asarray(column.flatten()), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def best_of(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best columns of ``x`` for each row of ``q``, a query's own id left out, ties to the smaller id; ``ids`` are sorted."""
    s = q @ x
    low = -np.inf if s.dtype.kind == "f" else np.iinfo(s.dtype).min
    s[qid[:, None] == ids] = low
    n = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    i, j = np.nonzero((s >= least[:, None]) & (s > low))
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[nth < k], j[nth < k]
    return qid[i], ids[j], s[i, j].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, annulus: int = ANNULUS, stream: int = STREAM) -> DataFrame:
    """Per query its k best rows of ``vectors`` but itself (both from ``integers``): query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; an id given twice counts as two rows, an equal query once. Vectors of unequal length are filled up
    with zeros. Empty inputs give no rows. Scores are exact: as doubles where no sum can leave 2**53, else as integers.
    """
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = materialise(vectors, "vectors")
    width, most = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))).first()
    if width is None:
        return spark.createDataFrame([], out)
    width = max(width, 1)
    p = pivots_of(rows, pivots, sample, width)
    # the longest squared length among rows and queries
    asked = materialise(queries.select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    wide, longest, number = asked.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))), F.count("*")).first()
    if not number:
        return spark.createDataFrame([], out)
    if wide > width:
        p = np.pad(p, ((0, 0), (0, wide - width)))
        width = wide
    kind = np.float64 if max(most, longest) < EXACT else np.int64
    blocks = -(-number // stream)
    piv = spark.sparkContext.broadcast((p, float(most)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, top = piv.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), width)
            lift = top - (x * x).sum(1)  # the square of the added coordinate; pivots and queries have 0 there
            d2 = (x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * x @ centre.T + lift[:, None]
            near = d2.argmin(1)
            d = np.sqrt(np.maximum(d2[np.arange(len(x)), near], 0))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(d)], ["vec_id", "v", "pivot", "dist"])

    keyed = materialise(rows.mapInArrow(key, "vec_id bigint, v array<bigint>, pivot int, dist double"), "keyed")
    # Annuli of about ``annulus`` rows by quantile sketches of each pivot's distances.
    grid = [i / RINGS for i in range(1, RINGS)]
    sizes = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", grid, 1000).alias("c"))
    cuts = {}
    for r in sizes.collect():  # at most `pivots` rows
        rings = min(RINGS, -(-r["n"] // annulus))
        cuts[r["pivot"]] = sorted({r["c"][i * RINGS // rings - 1] for i in range(1, rings)})
    edges = F.create_map(*[x for q in cuts for x in (F.lit(q), F.array(*[F.lit(float(c)) for c in cuts[q]]).cast("array<double>"))])
    ring = F.size(F.filter(edges[F.col("pivot")], lambda c: c <= F.col("dist")))
    annuli = materialise(keyed.withColumn("ring", ring), "annuli")
    discard(rows)
    discard(keyed)
    found = annuli.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).collect()  # at most 64 a pivot
    spans = sorted((r["pivot"], r["ring"], r["lo"], r["hi"], -(-r["n"] // annulus)) for r in found)  # equal distances make a ring of any size: it is dealt on by hash
    table = spark.sparkContext.broadcast(np.array(spans))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (centre, top), spans_ = piv.value, table.value
            at = spans_[:, 0].astype(int)
            for b in small(batches, 64):
                if not b.num_rows:
                    continue
                x = _matrix(b.column("v"), width)
                q2 = (x * x).sum(1)
                dp = np.sqrt(np.maximum(q2[:, None] + (centre * centre).sum(1) - 2 * x @ centre.T, 0))[:, at]
                bound = np.maximum(np.maximum(spans_[:, 2] - dp, dp - spans_[:, 3]), 0)
                if first:  # the nearest annulus by bound
                    go = np.zeros_like(bound, dtype=bool)
                    go[np.arange(len(x)), bound.argmin(1)] = True
                else:
                    kth = b.column("kth").to_pylist()
                    limit = np.array([np.inf if s is None else np.sqrt(max(q + top - 2 * s, 0)) for s, q in zip(kth, q2, strict=True)])
                    go = bound <= limit[:, None] + 1e-6 * (1 + limit[:, None] + np.sqrt(top))  # well above what rounding may add
                    go[np.isinf(limit)] = True
                    go[np.arange(len(x)), bound.argmin(1)] = False
                i, j = np.nonzero(go)
                if len(i):
                    n = spans_[j, 4].astype(int)
                    i, j = np.repeat(i, n), np.repeat(j, n)
                    part = np.concatenate([np.arange(c) for c in n])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("query_id").take(pa.array(i)), b.column("v").take(pa.array(i)), pa.array(spans_[j, 0].astype(np.int32)), pa.array(spans_[j, 1].astype(np.int32)), pa.array(part.astype(np.int32))],
                        ["query_id", "v", "pivot", "ring", "part"],
                    )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of annulus, its vectors (side 0) in front of the queries that visit it: the annulus is held, the queries pass."""
        now, ids, parts, x = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in keys], axis=1)
            side, row = b.column("side").to_numpy(), b.column("id").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist()
            got: list[tuple] = []
            for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if now is None or (key[s] != now).any():
                    now, ids, parts, x = key[s], [], [], None
                q = s + int((side[s:e] == 0).sum())
                if q > s:
                    ids.append(row[s:q])
                    parts.append(_matrix(b.column("v").slice(s, q - s), width, kind))
                if q == e or not ids:
                    continue
                if x is None:
                    ids, x = [np.concatenate(ids)], np.ascontiguousarray(np.concatenate(parts).T)
                    parts = []
                for at in range(q, e, BLOCK):
                    to = min(e, at + BLOCK)
                    got.append(best_of(row[at:to], _matrix(b.column("v").slice(at, to - at), width, kind), ids[0], x, k))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], ["query_id", "vec_id", "score"])

    visit_schema = "query_id bigint, v array<bigint>, pivot int, ring int, part int"
    keys = ["pivot", "ring", "part", "block"]
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    parts_of = spark.createDataFrame([(p_, r_, n_) for p_, r_, _, _, n_ in spans], "pivot int, ring int, parts long")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    held = annuli.join(F.broadcast(parts_of), ["pivot", "ring"]).select("pivot", "ring", part.alias("part"), copies.alias("block"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v")

    def searched(visit: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        asking = visit.select("pivot", "ring", "part", block.alias("block"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "v")
        both = held.union(asking).repartition(*keys).sortWithinPartitions(*keys, "side", "id")
        return both.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = materialise(searched(asked.mapInArrow(visits(True), visit_schema)), "near")
    kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    rest = asked.join(kth, "query_id", "left").mapInArrow(visits(False), visit_schema)
    total = found.union(searched(rest))
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
