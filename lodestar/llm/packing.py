"""Best-fit packing of tokenised documents into fixed-length training sequences.

Best-fit decreasing depends only on how many pieces there are of each length, and a length
is at most the sequence's capacity. So Spark tokenises and counts; the driver plans over the
histogram (at most ``capacity`` rows, whatever the corpus size) with a segment tree over
remaining capacities; and the plan, a bounded table of runs, is applied to every piece by its
rank within its length. The result is the very packing that a loop over single documents gives.

Plan size: each length ends in the middle of at most one group of equal bins, so it adds at
most three groups; a run is (length, group), so there are below 3 * capacity groups with at
most sqrt(2 * capacity) distinct lengths each.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, memo, small, use

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open groups left with so much."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.n = [0] * (2 * self.size)

    def add(self, c: int, by: int) -> None:
        i = self.size + c
        while i:
            self.n[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` with an open group; logarithmic."""
        i = self.size + need
        if self.n[i]:
            return need
        while i > 1:
            if i & 1 == 0 and self.n[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.n[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, first sequence, pieces a sequence, offset of the first), sorted.
    Piece r of a length belongs to the last row with first rank <= r. Groups hold bins of equal
    contents; all pieces of a length go to the tightest group that takes them, floor(rest / length)
    to a bin, which is what single placements do.
    """
    tree, open_, rows, made = CapacityTree(capacity), {}, [], 0

    def put(c: int, first: int, n: int) -> None:
        if c and n:
            open_.setdefault(c, []).append((first, n))
            tree.add(c, 1)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left, rank = counts[length], 0
        while left:
            c = tree.tightest(length)
            if c is None:
                c = capacity
                first, n = made, -(-left // (c // length))
                made += n
            else:
                first, n = open_[c].pop()
                tree.add(c, -1)
            m = c // length
            full = min(n, left // m)
            if full:
                rows.append((length, rank, first, m, capacity - c))
                put(c - m * length, first, full)
                rank, left, first, n = rank + full * m, left - full * m, first + full, n - full
            if n and left and left < m:
                rows.append((length, rank, first, left, capacity - c))
                put(c - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(c, first, n)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


class Kept(dict):
    """A bounded memo of a function of bytes, in two generations: when one is full it becomes the old one, from which hits come back. Long keys are not kept."""

    longest = 64

    def __init__(self, make: Callable[[bytes], bytes], limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else more))
        more += b not in shown
    return out


class TokenIds:
    """Ids of whole texts as little-endian uint32 bytes.

    A lower-casing vocabulary that splits at white space never joins across it, so a text's ids are those of its words. A word that is
    printable ASCII and composed Latin letters once lower-cased is further split into runs of letters, digits and runs of other characters,
    which the vocabulary's model encodes without the way through a whole text. Words and runs are memoised. Other words go
    through the whole tokenizer, and so do texts of other tokenizers or with a token that the tokenizer adds to its vocabulary.
    """

    words_kept, runs_kept = 150_000, 100_000
    #: Fixed value: how such a tokenizer splits a text.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Without the apostrophe, whose contractions are split otherwise; no letter here changes its length in lower case.
    plain, run = re.compile(rb"[a-z0-9!-&(-/:-@\[-`{-~]+"), re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    #: Of words in lower case: some capitals of these blocks have their small letter in another one.
    latin = re.compile("[a-z0-9!-&(-/:-@\\[-`{-~\u00df-\u00f6\u00f8-\u024f]+")
    latin_run = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)]  # not the whole file, which takes 100 MB
        split = str((parts[0].get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex"))
        lower = any(n.get("type") == "Lowercase" for n in parts[1].get("normalizers") or [])
        self.by_word = lower and split == self.pattern
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        mark = os.path.commonprefix(added) if added else "\x00"
        self.mark = mark if mark.lower() == mark.upper() else ""  # all of them hold it, whatever the case
        self.letters = byte_letters()
        self.words, self.runs = Kept(self.word, self.words_kept), Kept(self.of_run, self.runs_kept)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_run(self, run: bytes) -> bytes:
        text = run.decode() if run.isascii() else "".join([self.letters[b] for b in run])
        return np.array([t.id for t in self.model.tokenize(text)], dtype="<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.runs[word]
        if self.plain.fullmatch(word):
            return b"".join(map(self.runs.__getitem__, self.run.findall(word)))
        text = word.decode()
        low = text.lower()
        if self.latin.fullmatch(low):
            return b"".join([self.runs[r.encode()] for r in self.latin_run.findall(low)])
        return self.whole([text])[0]

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        get = self.words.__getitem__
        return [self.whole([t])[0] if self.mark in t and self.added.search(t) else b"".join(map(get, t.encode().lower().split())) for t in texts]


_ids: dict[str, TokenIds] = {}
memo("tokens", _ids.clear)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts by the tokenizer at ``path``, without special tokens added."""
    if path not in _ids:
        _ids[path] = TokenIds(path)
    return _ids[path].of(texts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: its ids, then ``end_id``, cut every ``capacity`` ids.

    A null text counts as empty: one piece of one id. Repeated rows are packed each, and so are rows that share an id or have none.
    Texts are read whole, however long; a task holds a few rows of them at once.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("tokens")
        for b in small(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(token_ids(texts, tokenizer)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces by best-fit decreasing.

    Ranks within a length are taken in salted groups, so a length that most pieces share is
    ranked by many tasks. An empty table gives an empty one.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    salts = 256 * max(1, sum(counts.values()) // 50_000_000)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length"), F.col("_salt"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")  # rows equal in these are equal rows
    ranked = (
        salted.withColumn("_in", F.row_number().over(inside))
        .join(sizes, ["length", "_salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in") - 1).alias("_rank"))
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        keys = t[:, 0] * (1 << 48) + t[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            nth, inside = np.divmod(rank - t[at, 1], np.maximum(t[at, 3], 1))
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(t[at, 2] + nth), pa.array(t[at, 4] + inside * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(put, PIECES + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into as few sequences of ``capacity`` ids as best-fit decreasing does."""
    return place(materialise(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
