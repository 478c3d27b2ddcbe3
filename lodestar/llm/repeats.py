"""Removal of long repeated passages with prefix-partitioned suffix trees.

A window of ``WINDOW`` words is repeated if the same words start anywhere else. Suffixes are taken
at content-defined anchors: of the GRAM-word grams in a window the one with the least hash (the
leftmost of equals), so equal windows share their anchor and every window has one.

Suffixes are split by prefixes of variable length into groups that fit in memory. First by the anchor's gram; prefixes that
occur once are dropped before any context moves. The suffixes of a prefix that more than ``SUBTREE`` share are split by how far
in front of the anchor their windows begin, and their prefix is lengthened to the words that such windows have in common.
There, suffixes with the same words all around are made one, with their number, by map-side sums: a passage that very many
texts share, or a text repeats, becomes a few. Where more than ``SUBTREE`` different ones are left, the prefix is lengthened to
the whole window, where a node needs no tree any more and Spark sums its leaves.

A task sorts the suffixes of a group that fits, from every word a window begins at, into a suffix array with the lengths of
common prefixes, which is its suffix tree: runs of neighbours with ``WINDOW`` words in common are the deep internal nodes, whose
leaves are the repeats. Repeats that begin at consecutive words make a maximal repeat.

Copies of a text form one class and are worked on once. Words are compared by 32-bit hashes of
which all WINDOW of a window must agree, and by their group's 64-bit prefix. Texts are read whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, as_long, batch, discard, gram_hashes, grouped, materialise, release, small, use

#: Words of a window and of an anchor's gram; rows of suffixes of one prefix that a task sorts in memory.
WINDOW, GRAM, SUBTREE = 35, 12, 4096


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, unchanged, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, first window, last window) of the anchors of word hashes ``h``."""
    n = len(h) - window + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, np.empty(0, np.uint64), e, e
    g = gram_hashes(h, gram)
    width = window - gram + 1
    p = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1)
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    at = p[starts]
    return at, g[at], starts, np.r_[starts[1:], n] - 1


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest")


def lengthened(window: int, gram: int) -> tuple[int, int]:
    """(words of the lengthened prefix, places a window may begin at for it): a third of the places that an anchor leaves."""
    places = -(-(window - gram + 1) // 3)
    return window - places + 1, places


def suffix_array(heads: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, words in common with the one before, for all but the first) of suffixes (n, words) in groups ``heads``."""
    n, depth = suffixes.shape
    full = np.concatenate([heads.astype(">u8").view("u1").reshape(n, 8), np.ascontiguousarray(suffixes.astype(">u4")).view("u1").reshape(n, 4 * depth)], axis=1)
    order = np.argsort(full.view(f"S{full.shape[1]}").ravel(), kind="stable")
    differ = suffixes[order[1:]] != suffixes[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    common[heads[order[1:]] != heads[order[:-1]]] = 0
    return order, common


def subtree(keys: np.ndarray, words: np.ndarray, ids: np.ndarray, times: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which windows of the rows of whole prefix groups are repeated.

    ``words`` (rows, places - 1 + window): hashes; a row's windows begin at its last place or ``first``..``last`` words before it, and
    are found ``times`` times. The suffixes from all of them are sorted together; those below an internal node of depth ``window`` are repeated.
    Returns (rows, places) booleans. Rows with equal ``ids`` are one row.
    """
    places = words.shape[1] - window + 1
    back = np.arange(places)
    here = (first[:, None] <= back) & (back <= last[:, None])
    _, where, same = np.unique(ids, return_index=True, return_inverse=True)
    one = np.zeros(len(keys), dtype=bool)
    one[where] = True
    out = here & (times > 1)[:, None]
    row, off = np.nonzero(here & one[:, None])
    if len(row):
        order, common = suffix_array(keys[row], np.lib.stride_tricks.sliding_window_view(words, window, axis=1)[row, places - 1 - off])
        deep = common >= window
        leaf = order[np.r_[deep, False] | np.r_[False, deep]]
        out[row[leaf], off[leaf]] = True
    return out[where][same]  # repeated rows get their row's answer


CONTEXT = "kind int, key bigint, digest binary, pos array<int>, first int, last int, words binary, context binary"


def repeated_ranges(docs: DataFrame, rows: DataFrame, reps: DataFrame, window: int = WINDOW, gram: int = GRAM, subtree_rows: int = SUBTREE) -> DataFrame:
    """(digest, ranges): runs (lo, hi) of starts of repeated windows, per class of equal texts; a class has several rows.

    ``rows``: (digest, doc_id, n_words) of all documents. ``reps``: (digest, doc_id, keys, poss), one row a class, with the anchors of its text.
    """
    left = window - gram
    longer, places = lengthened(window, gram)
    spots = reps.select("digest", "doc_id", F.explode(F.arrays_zip("keys", "poss")).alias("a")).select("digest", "doc_id", F.col("a.keys").alias("key"), F.col("a.poss").alias("pos"))
    counts = spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts, "counts")  # a join of two plain shuffles, so a very common prefix can be split
    live = spots.join(counts, "key").groupBy("digest", "doc_id").agg(F.collect_list(F.struct("pos", (F.col("n") > subtree_rows).alias("big"))).alias("marks"))  # anchors of one text
    live = materialise(live, "live")
    release(docs.sparkSession)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("words")
        for b in small(batches):
            out: list[tuple] = []
            for digest, text, marks in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                h = WORDS.of(words_of(text))
                at, key, lo, hi = anchors(h, window, gram)
                short, long_keys = h.astype(np.uint32), None
                spans: dict[tuple, list[int]] = {}  # places with the same words all around

                def around(end: int, n: int, short: np.ndarray = short) -> bytes:
                    """The words that windows from ``end`` or up to n - 1 words before it span; places without a word are zeros."""
                    w = short[max(0, end - n + 1) : end + window]
                    before = np.zeros(max(0, n - 1 - end), np.uint32)
                    return np.concatenate([before, w, np.zeros(n - 1 + window - len(before) - len(w), np.uint32)]).tobytes()

                for i, m in zip(np.searchsorted(at, [m["pos"] for m in marks]).tolist(), marks, strict=True):
                    p, near, far = int(at[i]), int(at[i] - hi[i]), int(at[i] - lo[i])  # its windows begin so many words in front of it
                    if not m["big"]:
                        spans.setdefault((0, int(key[i].view(np.int64)), near, far, around(p, left + 1)), []).append(p)
                        continue
                    long_keys = gram_hashes(h, longer) if long_keys is None else long_keys
                    for part in range(near // places, far // places + 1):
                        end = p - part * places
                        known = int((long_keys[end] ^ np.uint64(part)).view(np.int64))
                        spans.setdefault((1, known, max(0, near - part * places), min(places - 1, far - part * places), around(end, places)), []).append(end)
                for (kind, known, a, z, w), pos in spans.items():
                    out.append((kind, known, digest, pos, a, z, w, xxhash.xxh3_128_digest(w + b"%d %d" % (a, z)) if kind else None))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "key", "digest", "pos", "first", "last", "words", "context"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), F.col("text").cast("string").alias("text"))
    joined = text.join(live, text.digest.eqNullSafe(live.digest) & text.doc_id.eqNullSafe(live.doc_id)).select(text.digest, "text", "marks")
    found = materialise(joined.mapInArrow(contexts, CONTEXT), "contexts")
    discard(live)
    discard(counts)
    release(docs.sparkSession)

    def trees(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches, ["key"], 2 * SUBTREE):
                t = t.combine_chunks()
                words = np.frombuffer(b"".join(t.column("words").to_pylist()), dtype=np.uint32).reshape(t.num_rows, n - 1 + window)
                ids = np.array([d + int(p).to_bytes(4, "big") for d, p in zip(t.column("id").to_pylist(), t.column("place").to_pylist(), strict=True)], dtype="S20")
                key, times, first, last = (t.column(c).to_numpy() for c in ("key", "times", "first", "last"))
                flags = subtree(key, words, ids, times, first, last, window)
                edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (row, a), (_, z) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                if len(row):
                    some = t.take(pa.array(row))
                    yield batch(["id", "pos", "near", "far"], [some.column("id").combine_chunks(), some.column("pos").combine_chunks(), a.astype(np.int32), (z - 1).astype(np.int32)])

        return run

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a window, by all its words."""
        for b in small(batches, 2000):
            words = np.frombuffer(b"".join(b.column("words").to_pylist()), dtype=np.uint32).reshape(b.num_rows, places - 1 + window)
            back = np.arange(places)
            row, off = np.nonzero((b.column("first").to_numpy()[:, None] <= back) & (back <= b.column("last").to_numpy()[:, None]))
            spans = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, window, axis=1)[row, places - 1 - off])
            yield batch(["whole", "id", "off", "times"], [pa.array([xxhash.xxh3_128_digest(w) for w in spans], pa.binary()), b.column("id").take(pa.array(row)), off.astype(np.int32), b.column("times").take(pa.array(row))])

    def repeats_in(group: DataFrame, n: int) -> DataFrame:
        """(id, pos, near, far): of the rows (key, id, pos, times, first, last, words), which windows are repeated: from ``near`` to ``far`` words in front of their place."""
        group = group.select("key", "id", "pos", F.get("pos", F.lit(0)).alias("place"), "times", "first", "last", "words").repartition(F.col("key")).sortWithinPartitions("key")
        return group.mapInArrow(trees(n), "id binary, pos array<int>, near int, far int")

    def ranges(found: DataFrame) -> DataFrame:
        return found.select("digest", F.transform("pos", lambda p: F.struct((p - F.col("far")).alias("lo"), (p - F.col("near")).alias("hi"))).alias("ranges"))

    fit = found.where("kind = 0").withColumn("times", F.size("pos")).withColumnRenamed("digest", "id")
    out = ranges(repeats_in(fit, left + 1).withColumnRenamed("id", "digest"))
    big = found.where("kind = 1").select("key", "context", "digest", "pos", "first", "last", "words")
    if big.isEmpty():
        return out
    if not rows.where(F.col("n_words") >= window).groupBy("digest", "doc_id").count().where("count > 1").isEmpty():
        big = big.dropDuplicates(["digest", "key", "context"])  # rows that repeat id and text gave theirs each
    alike = big.groupBy("key", "context").agg(F.sum(F.size("pos")).alias("times"), *[F.first(c).alias(c) for c in ("first", "last", "words")])
    alike = materialise(alike.withColumnRenamed("context", "id").withColumn("pos", F.array(F.lit(0))), "alike")
    held = materialise(alike.groupBy("key").agg(F.count("*").alias("n"), F.sum("times").alias("all")).where("all > 1").select("key", "n"), "lengthened")
    alike = alike.join(held, "key")
    deep = repeats_in(alike.where(F.col("n") <= subtree_rows), places).select("id", "near", "far")
    single = alike.where(F.col("n") > subtree_rows).mapInArrow(windows, "whole binary, id binary, off int, times bigint")
    often = single.groupBy("whole").agg(F.sum("times").alias("n")).where("n > 1").select("whole")
    deep = deep.union(single.join(often, "whole").select("id", F.col("off").alias("near"), F.col("off").alias("far")))
    deep = materialise(deep, "deep")  # a join of two plain shuffles, so a very common context can be split
    return out.union(ranges(big.select("context", "digest", "pos").join(deep.withColumnRenamed("id", "context"), "context")))


def maximal(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """(first word, words) of the maximal repeats from runs of starts: those that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi - lo + window) for lo, hi in out]


def covered(n: int, ranges: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n words a window that starts in one of the ranges covers."""
    d = np.zeros(n + 1, dtype=np.int64)
    for lo, hi in ranges:
        d[lo] += 1
        d[min(n, hi + window)] -= 1
    return d[:-1].cumsum() > 0


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, subtree_rows: int = SUBTREE, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, joined by one space, on demand),
    n_repeats, its maximal repeats, and longest_repeat, the words of the longest (0 if none).

    Null and empty texts have no words. Repeated rows are each other's repeats. A text shorter than a window keeps all its words.
    """
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("words")
        for b in small(batches):
            n, sha, keys, poss = [], [], [], []
            for text in b.column("text").to_pylist():
                w = words_of(text)
                at, key, _, _ = anchors(WORDS.of(w), window, gram)
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                keys.append(as_long(key))
                poss.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(poss, pa.list_(pa.int32()))],
                ["doc_id", "digest", "n_words", "sha", "keys", "poss"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), F.col("text").cast("string").alias("text"))
    rows = materialise(base.mapInArrow(first, "doc_id bigint, digest binary, n_words bigint, sha string, keys array<bigint>, poss array<int>"), "rows")
    reps = rows.where(F.col("n_words") >= window).select("digest", "doc_id", "keys", "poss").dropDuplicates(["digest"])
    reps = materialise(reps, "reps")
    copies = rows.where(F.col("n_words") >= window).groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    marks = repeated_ranges(docs, rows, reps, window, gram, subtree_rows)
    marks = marks.groupBy("digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # repeats of one text
    # texts without copies: only there the words left are to be found out
    marks = marks.join(copies, "digest", "left_anti").join(reps.select("digest", "doc_id"), "digest")
    marks = materialise(marks, "marks")
    discard(reps)
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            gone, sha, kept, number, longest = [], [], [], [], []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                w = words_of(text)
                runs = [(r["lo"], r["hi"]) for r in ranges]
                out = covered(len(w), runs, window)
                passages = maximal(runs, window)
                number.append(len(passages))
                longest.append(max(n for _, n in passages))
                left = b" ".join([x for x, o in zip(w, out.tolist(), strict=True) if not o])
                gone.append(int(out.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(number, pa.int64()), pa.array(longest, pa.int64())],
                ["digest", "gone", "left_sha", "left_text", "number", "longest"],
            )

    both = base.join(marks, base.digest.eqNullSafe(marks.digest) & base.doc_id.eqNullSafe(marks.doc_id)).select(base.digest, "text", "ranges")
    done = both.mapInArrow(cut, "digest binary, gone bigint, left_sha string, left_text string, number bigint, longest bigint")
    none = hashlib.sha256(b"").hexdigest()
    whole = copies.select("digest", F.lit(-1).cast("long").alias("gone"), F.lit(none).alias("left_sha"), F.lit("").alias("left_text"), F.lit(1).cast("long").alias("number"), F.lit(None).cast("long").alias("longest"))
    done = materialise(done.dropDuplicates(["digest"]).union(whole), "done")  # so that the rows of a very common text can be split
    out = rows.select("doc_id", "digest", "n_words", "sha").join(done, "digest", "left")
    gone = F.when(F.col("gone") == -1, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0)))
    number, longest = F.coalesce("number", F.lit(0)).alias("n_repeats"), F.when(F.col("gone") == -1, F.col("n_words")).otherwise(F.coalesce("longest", F.lit(0))).alias("longest_repeat")
    out = out.select("doc_id", "digest", "n_words", gone.alias("n_removed"), F.coalesce("left_sha", "sha").alias("kept_sha256"), "left_text", number, longest)
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats", "longest_repeat"]
    if not with_text:
        return out.select(*cols)
    texts = base.select("digest", "text").dropDuplicates(["digest"])
    plain = F.array_join(F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != ""), " ")
    return out.join(texts, "digest", "left").select(*cols, F.coalesce("left_text", plain, F.lit("")).alias("kept"))
