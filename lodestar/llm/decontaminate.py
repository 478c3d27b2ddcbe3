"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed hashes the tokens of a window that a fixed mask selects and ignores the others, so a
substitution at an ignored position leaves it unchanged. Seeds of training texts and benchmark items
are joined; around every hit the item is laid over the text without gaps, and the overlap counts
if some stretch of ``STRETCH`` tokens (the whole item, if shorter) agrees in at least ``SIMILARITY`` of them.
The masks leave a seed wherever the changed tokens of such a stretch are, so that the seeds miss no overlap.

Benchmark seeds are broadcast only below ``BROADCAST_ROWS`` rows, and the keys of texts with a hit only below
``BROADCAST_KEYS``, both counted first; beyond, both sides are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: Masks over token positions; 0 is ignored. Any 3 changed tokens in a stretch of 15 leave a seed of some mask.
MASKS = ("1111011", "11010001011", "1010001000111")
#: (tokens, changed tokens, masks): wherever so many of so many tokens are changed, some mask leaves a seed; in longer stretches too.
COVERS = ((15, 3, MASKS), (10, 2, ("111011", "11001011", "11010011")), (5, 1, ("1111", "11011", "10111", "11101")))
STRETCH, SIMILARITY, BROADCAST_ROWS, BROADCAST_KEYS = 15, 0.8, 1_000_000, 200_000

_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: F.Column) -> F.Column:
    """Hashes of the runs of letters and digits, lower case; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def cover(stretch: int, similarity: float) -> tuple[str, ...]:
    """Masks of which one at least leaves a seed in every stretch of so many tokens that agrees in ``similarity`` of them."""
    changed = stretch - math.ceil(similarity * stretch)
    for n, most, masks in COVERS:
        if n <= stretch and 0 < changed <= most:
            return masks
    return ("1" * -(-(stretch - changed) // (changed + 1)),)  # the longest run that the changed tokens must leave


def seeds(rows: DataFrame, masks: list[str], of: tuple[str, ...], keys: list[str]) -> DataFrame:
    """(keys, at, seed): every seed of array column ``h`` by the masks ``of``, numbered as in ``masks``. Positions are generated inside one code-generated stage; arrays are not copied."""
    # the outer form: for the plain one the optimiser would compute the array once more to filter empty ones
    at = rows.select(*keys, "h", F.posexplode_outer("h").alias("at", "_t")).drop("_t")

    def seed(k: int, mask: str) -> F.Column:
        picked = [F.get("h", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]
        return F.when(F.col("at") + len(mask) <= F.size("h"), F.xxhash64(F.lit(k), *picked))

    made = at.select(*keys, "at", F.explode(F.array(*[seed(masks.index(m), m) for m in of])).alias("seed"))
    return made.where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, similarity: float = SIMILARITY, broadcast_rows: int = BROADCAST_ROWS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(key, item_id, agree, best, stretch, item_tokens) per distinct text and item with an overlap; key is the text's MD5.

    ``docs``: text, read whole however long. ``benchmark``: item_id, text. Null texts hold nothing. Items of fewer than five tokens must agree whole.
    agree: most tokens of the item that agree on one diagonal; best: of these in the best stretch. Every text of an item is searched for;
    texts under one id, null too, count as one item with the highest figures of those found.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("h")).where("size(h) > 0")
    named = materialise(named.select("item_id", "h", F.md5(F.concat_ws(" ", F.col("h").cast("array<string>"))).alias("item_key")), "items")
    items = named.groupBy("item_key").agg(F.first("h").alias("h"))
    n = F.least(F.size("h"), F.lit(stretch))
    # a seed that spells its whole item has found it, so one place in a text will do
    items = items.withColumn("whole", (F.size("h") <= stretch) & (F.ceil(F.lit(similarity) * n) == n))
    sizes = items.groupBy(n.alias("stretch")).agg(F.sum(F.size("h")).alias("n")).collect()  # as many as the stretch has tokens
    covers: dict[tuple[str, ...], list[int]] = {}
    for r in sizes:
        covers.setdefault(cover(r["stretch"], similarity), []).append(r["stretch"])
    covers = covers or {MASKS: []}  # an empty benchmark
    masks = sorted({m for of in covers for m in of})
    theirs = reduce(DataFrame.union, [seeds(items.where(n.isin(held)), masks, of, ["item_key", "whole"]) for of, held in covers.items()])
    theirs = theirs.select("item_key", "whole", F.col("at").alias("item_at"), "seed")
    small = sum(r["n"] for r in sizes) * len(masks) <= broadcast_rows
    texts = docs.select(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.col("text").cast("string").alias("text"))
    mine = seeds(texts.select("key", tokens(F.col("text")).alias("h")), masks, tuple(masks), ["key"])
    diagonal = F.col("at") - F.col("item_at")
    hits = mine.join(F.broadcast(theirs) if small else theirs, "seed").groupBy("key", "item_key", F.when(~F.col("whole"), diagonal).alias("of")).agg(F.min(diagonal).alias("diagonal")).drop("of")  # combined before the shuffle
    hits = materialise(hits, "hits")
    items = items.select("item_key", F.col("h").alias("item"))
    held = broadcast_if_small(hits.select("key").distinct(), "held", broadcast_keys)  # texts with a hit
    full = texts.join(held, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", tokens(F.col("text")).alias("h"))  # one row a text, however many copies
    laid = hits.join(full, "key").join(F.broadcast(items) if small else items, "item_key")
    found = measured(laid, stretch).where(F.col("best") >= F.ceil(F.lit(similarity) * F.col("stretch")))
    ids = broadcast_if_small(named.select("item_key", "item_id").distinct(), "ids", broadcast_keys)
    found = found.join(ids, "item_key")
    return found.groupBy("key", "item_id").agg(F.max("agree").alias("agree"), F.max("best").alias("best"), F.max("stretch").alias("stretch"), F.max("item_tokens").alias("item_tokens"))


def measured(laid: DataFrame, stretch: int) -> DataFrame:
    """Overlaps of rows (key, item_key, diagonal, h, item): agree, best, stretch and item_tokens; overlaps shorter than the stretch give none.

    One pass over an overlap, however long: a sliding sum. What a filter or a lambda needs of it comes out of a generator, as the
    optimiser would put a projected expression in their place and compute it again for every token.
    """
    lo, hi = F.greatest(F.col("diagonal"), F.lit(0)), F.least(F.size("h"), F.col("diagonal") + F.size("item"))
    same = F.transform(F.sequence(lo, hi - 1), lambda p: (F.get(F.col("h"), p) == F.get(F.col("item"), p - F.col("diagonal"))).cast("int"))
    laid = laid.where(hi > lo).select("key", "item_key", F.size("item").alias("item_tokens"), F.explode_outer(F.array(same)).alias("same"))
    laid = laid.withColumn("stretch", F.least(F.lit(stretch), F.col("item_tokens"))).where(F.size("same") >= F.col("stretch"))

    def step(a: F.Column, i: F.Column) -> F.Column:
        new, gone = F.get("same", i), F.when(i >= F.col("stretch"), F.get("same", i - F.col("stretch"))).otherwise(0)
        run = a["run"] + new - gone
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"), (a["agree"] + new).alias("agree"))

    none = F.struct(*[F.lit(0).alias(c) for c in ("run", "best", "agree")])
    sums = F.aggregate(F.sequence(F.lit(0), F.size("same") - 1), none, step)
    laid = laid.select("key", "item_key", "stretch", "item_tokens", F.explode_outer(F.array(sums)).alias("m"))
    return laid.select("key", "item_key", F.col("m.agree").alias("agree"), F.col("m.best").alias("best"), "stretch", "item_tokens")


def report(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` and benchmark item that it holds: doc_id, item_id, agree, best, stretch, item_tokens. Clean rows give none; rows that repeat give theirs each."""
    found = broadcast_if_small(overlaps(docs, benchmark, stretch, similarity), "found", BROADCAST_KEYS)  # written, so the rows of a very common text can be split
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    return keyed.join(found, "key").select("doc_id", "item_id", "agree", "best", "stretch", "item_tokens")


def drop(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns kept."""
    found = broadcast_if_small(overlaps(docs, benchmark, stretch, similarity).select(F.col("key").alias("_lodestar_key")).distinct(), "leaks", BROADCAST_KEYS)
    keyed = docs.withColumn("_lodestar_key", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return keyed.join(found, "_lodestar_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
