"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams in order. A document is compared
by the out-of-place distance: for each of its own most frequent n-grams, how far the ranks are
apart, or the full profile length where the language lacks it.

Profiles are fitted on a bounded sample of labelled rows: ``docs_per_language`` documents of each
language, those with the least hash of their id. Predictions read whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import broadcast_if_small, sampled, small, use

#: Values of the fit. Profiles of 400 n-grams of 1 to 3 letters.
PROFILE, LONGEST, DOCS_PER_LANGUAGE = 400, 3, 600


def letter_runs(token: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in token.lower()).split()


def grams_of(token: str) -> list[str]:
    out = []
    for run in letter_runs(token):
        word = f"_{run}_"
        for n in range(1, LONGEST + 1):
            out += [g for i in range(len(word) - n + 1) if (g := word[i : i + n]) != "_"]
    return out


def profiles(train: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[str]]:
    """Profiles of the languages in ``train`` (doc_id, text, lang). Rows without text, language or id are left out.

    Returns to the driver ``size`` n-grams a language, no more.
    """
    rows = train.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = broadcast_if_small(sampled(rows, "lang", docs_per_language), "sample")
    sample = rows.join(chosen, ["lang", "doc_id"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for b in small(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                c = total.setdefault(lang, Counter())
                for token, n in Counter(text.split()).items():
                    for g in grams_of(token):
                        c[g] += n
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    got = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= size).select("lang", "gram", "r").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda x: (x["lang"], x["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """1 for every code point that is a letter, made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=np.uint32, count=0x110000))
    return _letters[0]


class Ranker:
    """Out-of-place distances of texts to fixed profiles, over arrays of code points.

    Letters are numbered: 0 the edge of a word, 1 any letter that no profile has (those count as one letter), then
    the profiles' letters in order. An n-gram's code is its letters' number; ties in frequency go by code.
    """

    def __init__(self, known: dict[str, list[str]], size: int):
        self.langs, self.size = sorted(known), size
        letters = sorted({c for grams in known.values() for g in grams for c in g if c != "_"})
        self.ids = {"_": 0} | {c: i + 2 for i, c in enumerate(letters)}
        self.v = len(letters) + 2
        self.table = letter_table().copy()
        for c in letters:
            self.table[ord(c)] = self.ids[c]
        codes = sorted({self.code(g) for grams in known.values() for g in grams})
        self.codes = np.array([*codes, np.iinfo(np.int64).max])
        at = {c: i for i, c in enumerate(codes)}
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            for r, g in enumerate(known[lang]):
                self.ranks[i, at[self.code(g)]] = r

    def code(self, gram: str) -> int:
        n, v = 0, self.v
        for c in gram:
            n = n * v + self.ids.get(c, 1)
        return n + (0, 0, v, v + v * v)[len(gram)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). ``und`` and 0 if there is no letter or no profile. Ties go to the first language in order."""
        if not text or not self.langs:
            return "und", 0.0
        x = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = x != 0
        if not keep.any():
            return "und", 0.0
        keep[1:] |= keep[:-1]  # one edge behind each run of letters
        y = np.concatenate([[0], x[keep], [0]]).astype(np.int64)
        y = y[: len(y) - 1] if y[-2] == 0 else y
        v = self.v
        pairs = y[:-1] * v + y[1:]
        triples = (pairs[:-1] * v + y[2:])[y[1:-1] != 0]
        codes = np.concatenate([y[y != 0], pairs + v, triples + (v + v * v)])
        if v**3 <= 1 << 20:
            counts = np.bincount(codes)
            have = np.flatnonzero(counts)
            counts = counts[have]
        else:
            have, counts = np.unique(codes, return_counts=True)
        if len(have) > self.size:
            least = np.partition(counts, len(have) - self.size)[len(have) - self.size]
            have, counts = have[counts >= least], counts[counts >= least]
        order = have[np.argsort(-counts, kind="stable")][: self.size]
        at = np.searchsorted(self.codes, order)
        ranks = np.where(self.codes[at] == order, self.ranks[:, at], -1)
        d = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(order)))).sum(axis=1)
        best = int(np.argmin(d))
        return self.langs[best], float(1.0 - d[best] / (self.size * len(order)))


def predict(docs: DataFrame, known: dict[str, list[str]], size: int = PROFILE, keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score (0 to 1: 1 less the mean distance over its most) to every row, as columns ``out``.

    Only ``text`` decides, all of it, in time linear in its length; null texts and those without a letter are ``und``, and repeated rows get a row each.
    ``keep``: the columns to carry on (all by default); one named like a result gives way to it.
    """
    keep = [c for c in (keep or docs.columns) if c not in out]
    cols = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*cols)
    # a text that is carried on anyway is sent once
    at = keep.index("text") if "text" in keep and docs.schema["text"].dataType == StringType() else len(keep)
    src = docs.select(*cols, *([F.col("text").cast("string").alias("_lodestar_text")] if at == len(keep) else []))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most `size` n-grams a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("language")
        ranker = Ranker(shared.value, size)
        for b in small(batches):
            got = [ranker.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, *out])

    return src.mapInArrow(run, schema.schema.add(out[0], StringType()).add(out[1], DoubleType()))
