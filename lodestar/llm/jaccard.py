"""Exact n-gram Jaccard join with count-vector R-trees.

A document's shingles are hashed into groups; the counts per group are a point. Two sets share at
most the sum over groups of the smaller counts, so a tree node whose upper corner cannot reach the
overlap that the threshold needs is skipped with all it holds; pairs that survive the bound are verified on their sets.

To index only what can have a partner, three lossless steps come first, each a property of sets that
meet the threshold t:
  1. equal sets form one class;
  2. among the |A| - ceil(t|A|) + m least hashes of both partners at least about m agree, so a class with
     fewer least hashes known elsewhere has no partner;
  3. of what is left, with true frequencies, partners share one of the |A| - ceil(t|A|) + 1 rarest shingles;
     classes connected by such shingles form a neighbourhood.
Each neighbourhood gets an R-tree: its upper level are tiles of bounded size in bytes (by set size, then hash) with their
corners, of which Spark pairs those that the bound allows; a task builds the tree of each pair of tiles.
Only links that join components are kept, never all pairs of a group, so thousands of near copies give thousands of links.
A neighbourhood of more than one tile is first held against a few of its members, which joins most of a group of near copies
in one pass over it; tiles whose classes all are in its largest component so far are not paired with each other.

Sets are of 64-bit hashes; classes carry 128-bit digests. Texts are read whole, however long; a very long one is a tile of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, as_long, broadcast_if_small, components, discard, gram_hashes, grouped, materialise, mixed, release, small, use

#: Groups that shingles are counted in, entries of a leaf, numbers (hashes and counts) in a tile, members that a large neighbourhood is held against.
GROUPS, LEAF, TILE, PIVOTS = 32, 16, 100_000, 4
#: Classes left by the second step whose ids are broadcast to the texts, counted first; beyond, texts are shuffled.
BROADCAST_ROWS = 200_000
#: Per cent of a set that its least hashes are given beyond those that a partner may lack; partners agree in about as many.
AGREE = 15


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer than n words are one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = WORDS.of(words)
    if len(words) < n:
        return mixed(gram_hashes(h, len(words)) ^ np.uint64(len(words)))
    return np.unique(gram_hashes(h, n))


def digest_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def needed(size: int, num: int, den: int) -> int:
    """The least overlap of a set with any partner: ceil(num * size / den)."""
    return -(-num * size // den)


class CountTree:
    """R-tree over count vectors, packed by recursive halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple] = []  # (upper corner, least size, most size, members or None, children)
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        p, s = self.points[rows], self.sizes[rows]
        if len(rows) <= leaf:
            node = (p.max(axis=0), int(s.min()), int(s.max()), rows, ())
        else:
            spread = np.append(p.max(axis=0) - p.min(axis=0), s.max() - s.min())
            axis = int(spread.argmax())
            order = np.argsort(p[:, axis] if axis < p.shape[1] else s, kind="stable")
            half = len(rows) // 2
            kids = (self._build(rows[order[:half]], leaf), self._build(rows[order[half:]], leaf))
            node = (p.max(axis=0), int(s.min()), int(s.max()), None, kids)
        self.nodes.append(node)
        return len(self.nodes) - 1

    def search(self, point: np.ndarray, size: int, num: int, den: int, skip) -> Iterator[int]:
        """Rows whose bound allows a partner of the point. ``skip(node)``: whole nodes that need no look."""
        stack = [self.root]
        while stack:
            i = stack.pop()
            upper, least, most, rows, kids = self.nodes[i]
            if den * most < num * size or num * least > den * size:
                continue
            small = max(least, -(-num * size // den))  # a partner has at least so many
            if (num + den) * int(np.minimum(upper, point).sum()) < num * (size + small) or skip(i):
                continue
            if rows is None:
                stack += kids
                continue
            bound = np.minimum(self.points[rows], point).sum(axis=1)
            yield from rows[(num + den) * bound >= num * (size + self.sizes[rows])].tolist()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def links(points: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows: equal ``sides`` everywhere is a self join, else only rows of different sides are compared.

    ``known``: labels of the components that are known before; rows of one label need no link.
    """
    n = len(sets)
    parent = list(range(n))
    if known is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(k, i) for i, k in enumerate(known.tolist())]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    if n == 2:
        if parent[1] == 0:
            return []
        k = overlap(*sets)
        return [(0, 1)] if den * k >= num * (sizes[0] + sizes[1] - k) else []
    tree = CountTree(points, sizes)
    cross = len(set(sides.tolist())) > 1
    under: list[np.ndarray] = []
    for _, _, _, rows, kids in tree.nodes:
        under.append(rows if rows is not None else np.concatenate([under[k] for k in kids]))
    whole: dict[int, int] = {}  # nodes known to lie in one component, by one of its rows

    def one(i: int) -> bool:
        """Whether a node lies in one component; only nodes of one known stay so."""
        if i in whole:
            return True
        _, _, _, rows, kids = tree.nodes[i]
        if rows is not None:
            first = find(int(rows[0]))
            same = all(find(r) == first for r in rows[1:].tolist())
        else:
            same = all(k in whole for k in kids) and len({find(whole[k]) for k in kids}) == 1
        if same:
            whole[i] = int(under[i][0])
        return same

    out = []
    for q in range(n):
        def skip(i: int, q: int = q) -> bool:
            return one(i) and find(whole[i]) == find(q)

        for c in tree.search(points[q], int(sizes[q]), num, den, skip):
            if c == q or cross and sides[c] == sides[q] or find(c) == find(q):
                continue
            k = overlap(sets[q], sets[c])
            if den * k >= num * (int(sizes[q]) + int(sizes[c]) - k):
                parent[find(c)] = find(q)
                out.append((q, c))
    return out


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, tile: int = TILE, texts: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least num / den (above 1/2).

    ``docs``: (doc_id, text). Per row: doc_id, n_shingles, component_id, the smallest doc_id reachable by links (itself if none).
    Null and empty texts have no shingles and no links; rows with equal sets are linked. Ids may repeat.

    ``texts``: instead per row doc_id, key (the text's MD5), n_shingles and first, the least (no id, doc_id, key) of its component.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["key"] if texts else []
    keyed = base.withColumn("key", F.md5(F.coalesce("text", F.lit("")))) if texts else base

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("words")
        told: set[bytes] = set()  # a task gives a class's least hashes once, so copies are combined before the shuffle
        for b in small(batches):
            size, digest, least, gave = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, n)
                d = digest_of(s)
                size.append(len(s))
                digest.append(d)
                spare = len(s) - needed(len(s), num, den)
                gave.append(d not in told)
                least.append(as_long(s[: spare + _agree(len(s))] if gave[-1] else s[:0]))
                if len(told) < 1_000_000:
                    told.add(d)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array(gave, pa.bool_()), *[b.column(k) for k in key]], ["doc_id", "n", "digest", "least", "gave", *key]
            )

    sig = materialise(keyed.mapInArrow(first, "doc_id bigint, n bigint, digest binary, least array<bigint>, gave boolean" + (", key string" if texts else "")), "signatures")
    rows = materialise(sig.drop("least"), "sizes")

    # 2. least hashes given more often than their own class was; of partners as small as num/den of A, m is the smaller one's
    known = sig.select(F.explode("least").alias("h"), F.xxhash64("digest").alias("c"))
    shared = materialise(known.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    release(spark)
    per = known.join(shared, "h").groupBy("c", "k").agg(F.count("*").alias("hits"))  # few different k a class
    must = F.expr(f"greatest(1L, {AGREE} * ((n * {num} + {den - 1}) div {den}) div 100)")  # _agree of the smallest partner
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.sum(F.col("gave").cast("int")).alias("times")).withColumn("c", F.xxhash64("digest"))
    # a hash of one class only was counted once each time the class gave it; other classes' counts come on top
    hits = per.join(classes, "c").where("k > times").groupBy("digest", "doc_id", "n").agg(F.sum(F.expr("hits div times")).alias("hits"))
    live = hits.where(F.col("hits") >= must).select("digest", "doc_id")
    live = materialise(live, "live")
    discard(sig)
    discard(shared)
    release(spark)

    # the whole sets of what is left
    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("words")
        for b in small(batches):
            keep, size, sets, points = [], [], [], []
            for i, (text, digest) in enumerate(zip(b.column("text").to_pylist(), b.column("digest").to_pylist(), strict=True)):
                s = shingle_set(text, n)
                if digest_of(s) == digest:  # ids may repeat with other texts
                    keep.append(i)
                    size.append(len(s))
                    sets.append(as_long(s))
                    points.append(np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("digest").take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int32()))], ["digest", "n", "hashes", "point"]
            )

    ids = live.withColumnRenamed("doc_id", "id")
    ids = F.broadcast(ids) if live.count() <= BROADCAST_ROWS else ids
    picked = base.join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "digest")
    sets = picked.mapInArrow(second, "digest binary, n bigint, hashes array<bigint>, point array<int>").dropDuplicates(["digest"])
    sets = materialise(sets.withColumn("id", F.monotonically_increasing_id()), "sets")  # written, so the short ids stay
    discard(live)
    release(spark)

    # 3. prefixes by true frequency: shingles of one class come first and are no use, so only their number counts
    tokens = sets.select("id", F.explode("hashes").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    prefix = (
        tokens.join(often, "h")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))  # the shingles of one set
        .join(sets.select("id", "n"), "id")
        .withColumn("spare", F.expr(f"cast((n * {den - num}) div {den} as int)"))
        .withColumn("take", F.col("spare") + 1 - (F.col("n").cast("int") - F.size("common")))
        .where("take > 0")
        .select("id", F.explode(F.slice("common", 1, F.col("take"))).alias("t"))
        .select("id", F.col("t.h").alias("h"))
    )
    prefix = materialise(prefix, "prefix")
    release(spark)
    lead = prefix.groupBy("h").agg(F.min("id").alias("lead"), F.count("*").alias("k")).where("k > 1")
    near = components(prefix.join(lead, "h").where("id <> lead").select(F.col("lead").alias("src"), F.col("id").alias("dst")))
    release(spark)

    edges = components(_tiles(near, sets, num, den, tile))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key") if texts else F.col("doc_id")
    least = rows.groupBy("digest").agg(F.min(own).alias("first"))
    named = edges.join(sets.select("id", "digest"), F.col("node") == F.col("id")).join(least, "digest").select("digest", "component", "first")
    found = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(found, "component").select("digest", "smallest")
    ids = least.join(named, "digest", "left").select("digest", F.least("first", F.coalesce("smallest", "first")).alias("component_id"))
    ids = materialise(ids, "components")  # so that the rows of a very common class can be split
    release(spark)
    out = rows.join(ids, "digest")
    alone = F.col("n") == 0
    if texts:
        return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(alone, own).otherwise(F.col("component_id")).alias("first"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _agree(size: int) -> int:
    """How many least hashes must agree, at least one."""
    return max(1, AGREE * size // 100)


def _tiles(near: DataFrame, sets: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Links (src, dst) between classes: tiles of each neighbourhood, pairs of tiles that the bound allows, a tree for each pair."""
    members = near.select(F.col("node").alias("id"), F.col("component").alias("hood")).join(sets.drop("digest"), "id")
    members = materialise(members, "members")
    # what a class takes in memory, in numbers
    large = materialise(members.groupBy("hood").agg(F.sum(F.col("n") + GROUPS).alias("size"), *_least("id", PIVOTS)).where(F.col("size") > tile), "large")
    found = None
    inside = members.withColumn("label", F.col("id")).withColumn("most", F.lit(False))
    if not large.isEmpty():
        chosen = large.select("hood", F.explode(F.array_distinct(F.array(*[F.col(f"_p{k}") for k in range(PIVOTS)]))).alias("id"))
        chosen = broadcast_if_small(chosen.join(sets.select("id", "n", "hashes"), "id").select("hood", F.col("id").alias("p_id"), F.col("n").alias("p_n"), F.col("hashes").alias("p_hashes")), "pivots", weigh=F.col("p_n") * 8)
        both = F.size(F.array_intersect("hashes", "p_hashes")).cast("long")
        near_ = members.join(chosen, "hood").where("id <> p_id").select("id", "p_id", both.alias("both"), (F.col("n") + F.col("p_n") - both).alias("either"))
        found = materialise(near_.where(F.col("both") * den >= F.col("either") * num).select(F.col("id").alias("src"), F.col("p_id").alias("dst")), "found")
        labels = components(found)
        labelled = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        labelled = materialise(labelled, "labelled")
        sizes = labelled.groupBy("hood", "label").agg(F.count("*").alias("k"))
        largest = sizes.join(large.select("hood"), "hood", "left_semi").groupBy("hood").agg(F.max(F.struct("k", "label")).alias("m")).where("m.k > 1")
        largest = broadcast_if_small(largest.select("hood", F.col("m.label").alias("l")), "largest")
        inside = labelled.join(largest, "hood", "left").withColumn("most", F.coalesce(F.col("label") == F.col("l"), F.lit(False))).drop("l")
    weight = F.col("k") * (F.col("n") + GROUPS)
    per = inside.groupBy("hood", "most", "n").agg(F.count("*").alias("k"))  # few sizes a neighbourhood, however many members
    before = Window.partitionBy("hood", "most").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    parts = F.ceil(weight / tile)
    # small groups of one size stay together; a large one is dealt on by hash; odd tiles are of the largest component
    spot = 2 * (F.floor(F.col("start") / tile) + F.pmod(F.xxhash64("id"), parts)).cast("long") + F.col("most").cast("long")
    tiled = inside.join(per, ["hood", "most", "n"]).select("hood", spot.alias("tile"), "id", "label", "n", "hashes", "point")
    tiled = materialise(tiled, "tiles")
    corner = F.array(*[F.max(F.get("point", F.lit(g))) for g in range(GROUPS)])
    box = materialise(tiled.groupBy("hood", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), corner.alias("upper")), "boxes")
    a, b = box.where("tile % 2 = 0").alias("a"), box.alias("b")
    reach = F.aggregate(F.zip_with("a.upper", "b.upper", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    once = (F.col("a.tile") <= F.col("b.tile")) | (F.col("b.tile") % 2 == 1)
    pairs = a.join(b, (F.col("a.hood") == F.col("b.hood")) & once).where(
        (F.col("a.hi") * den >= F.col("b.lo") * num) & (F.col("b.hi") * den >= F.col("a.lo") * num) & (reach * (num + den) >= (F.col("a.lo") + F.col("b.lo")) * num)
    )
    pairs = pairs.select(F.col("a.hood").alias("hood"), F.col("a.tile").alias("x"), F.col("b.tile").alias("y"))
    visits = pairs.select("hood", F.col("x").alias("tile"), "x", "y").union(pairs.where("x <> y").select("hood", F.col("y").alias("tile"), "x", "y"))
    work = tiled.join(visits, ["hood", "tile"]).repartition("hood", "x", "y").sortWithinPartitions("hood", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["hood", "x", "y"], 2000):
            t = t.combine_chunks()
            hood = t.column("hood").to_numpy()
            x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
            new = [i for i in range(t.num_rows) if not i or hood[i] != hood[i - 1] or x[i] != x[i - 1] or y[i] != y[i - 1]] + [t.num_rows]
            ids, side, label = t.column("id").to_numpy(), t.column("tile").to_numpy(), t.column("label").to_numpy()
            lists = t.column("hashes").combine_chunks()
            flat, off = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            points = t.column("point").combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)
            src, dst = [], []
            for s, e in zip(new, new[1:], strict=False):
                if e - s > 1:
                    for i, j in links(points[s:e], [flat[off[k] : off[k + 1]] for k in range(s, e)], side[s:e], num, den, label[s:e]):
                        src.append(ids[s + i])
                        dst.append(ids[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    cols = work.select("hood", "x", "y", "tile", "id", "label", "hashes", "point")
    made = cols.mapInArrow(run, "src bigint, dst bigint")
    made = materialise(made if found is None else made.union(found), "links")
    for table in (members, tiled, box):
        discard(table)
    return made


def _least(col: str, n: int) -> list[F.Column]:
    """Aggregates _p0.. that pick members of a group by the least of differing hashes; they may coincide."""
    return [F.min_by(col, F.xxhash64(F.col(col), F.lit(k))).alias(f"_p{k}") for k in range(n)]
