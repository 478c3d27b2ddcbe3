"""Personal data by bootstrapped contextual extraction.

Seed entities (checked e-mail, address, card and phone shapes) induce lexical patterns: the
words just before them, with their kind. Spark scores the graph between patterns and instances
iteratively: a pattern is as good as the instances it extracts, an instance as good as its
patterns. Patterns of high confidence then mark identifiers that no seed shape covers.

Everything is keyed by the text's digest, so copies count once and share their findings. Texts are scanned whole, in
time linear in their length: every expression reads a character a bounded number of times.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small

# What may follow a run is optional, so that a run without it is passed over at once instead of tried again from each of its characters.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
KINDS = ("email", "ip", "card", "phone")

#: Of the bootstrap: rounds over the graph, the confidence a pattern needs and the distinct seed instances that must support it.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5

#: Inside of an identifier-shaped token: an @ sign or at least four digits.
_SHAPED = re.compile(r"@|[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9]")
_SPACE = re.compile(r"\s")
_EDGES = " \t\r\n.,;:!?()[]{}<>\"'"
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, those that fail their check dropped; by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if _DOTTED.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def context(text: str, start: int) -> str:
    """The two whole words before a position that begin within 60 characters of it, lower case; '' if there are fewer."""
    low = max(0, start - 60)
    words = _WORDS.findall(text[low:start])
    if low and words and _WORDS.match(text[low - 1]) and _WORDS.match(text[low]):
        words = words[1:]  # begins further in front
    return " ".join(words[-2:]).lower() if len(words) >= 2 else ""


def shaped(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-shaped tokens, five or more characters without the marks around them, that no base span touches."""
    out, done = [], 0
    starts, ends = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    for m in _SHAPED.finditer(text):
        s = m.start()
        if s < done:
            continue  # of the token before
        while s > done and not text[s - 1].isspace():
            s -= 1
        e = _SPACE.search(text, m.end())
        e = done = e.start() if e else len(text)
        while s < e and text[s] in _EDGES:
            s += 1
        while e > s and text[e - 1] in _EDGES:
            e -= 1
        before = bisect_left(starts, e)  # spans that start before the token's end
        if e - s >= 5 and not (before and ends[before - 1] > s):
            out.append((s, e))
    return out


OCCURRENCES = "blob string, pattern string, instance string, kind string, begin int, stop int"


def occurrences(docs: DataFrame) -> DataFrame:
    """Per row its base spans (kind '' and pattern the spans), and per seed or candidate the pattern before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows: list[tuple] = []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = shaped(text, base)
                if base or more:
                    blob = xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))
                    rows.append((blob, joined(base), None, None, None, None))
                    rows += [(blob, p, text[s:e], k, s, e) for k, s, e in base if (p := context(text, s))]
                    rows += [(blob, p, text[s:e], "?", s, e) for s, e in more if (p := context(text, s))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["blob", "pattern", "instance", "kind", "begin", "stop"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, OCCURRENCES)


def score_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, label, confidence, support) from occurrences.

    Edges join (pattern, label) with distinct instances. Seeds have confidence 1 for their own kind. A pattern's
    confidence is the mean of its distinct instances'; an unseen instance's is the best of its patterns',
    damped by a half a round until several patterns agree. Copies are dropped before counting.
    """
    edges = found.where("kind is not null").select("pattern", "instance", "kind").distinct()
    seeds = edges.where("kind <> '?'")
    labels = seeds.groupBy("pattern", F.col("kind").alias("label")).agg(F.count("*").alias("support"))
    # a pattern competes under each label it has seeds for: at most four
    graph = materialise(edges.join(labels, "pattern").select("pattern", "label", "support", "instance", (F.col("kind") == F.col("label")).cast("double").alias("conf"), (F.col("kind") == "?").alias("free")), "graph")
    for _ in range(rounds):
        pattern = graph.groupBy("pattern", "label").agg(F.avg("conf").alias("p"))
        best = graph.where("free").join(pattern, ["pattern", "label"]).groupBy("instance", "label").agg((1 - F.exp(F.sum(F.log(1 - 0.5 * F.col("p"))))).alias("q"))
        old, graph = graph, materialise(
            graph.join(best, ["instance", "label"], "left").select("pattern", "label", "support", "instance", F.when(F.col("free"), F.coalesce("q", F.col("conf"))).otherwise(F.col("conf")).alias("conf"), "free"), "graph"
        )
        discard(old)
    return graph.groupBy("pattern", "label").agg(F.avg("conf").alias("confidence"), F.max("support").alias("support"))


def report(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Per row of ``docs``: doc_id, base counts, digest of the base spans, and all spans with those that confident patterns add; n_all, their number.

    A null text counts as empty. Rows that repeat a text or an id get a row each, with the same findings. An added span bears the kind
    its pattern's seeds have (of several the first in the alphabet) and never touches a base span.
    """
    found = materialise(occurrences(docs), "occurrences")
    good = score_patterns(found).where((F.col("confidence") >= confidence) & (F.col("support") >= support))
    added = found.where("kind = '?'").join(good, "pattern").groupBy("blob", "begin", "stop").agg(F.min("label").alias("label"))
    span = F.struct(F.col("begin").alias("s"), F.col("label").alias("k"), F.col("stop").alias("e"))
    added = added.groupBy("blob").agg(F.collect_list(span).alias("_more"))  # the candidates of one text
    base = found.where("kind is null").groupBy("blob").agg(F.min("pattern").alias("_base"))
    hits = materialise(base.join(added, "blob", "left"), "hits")  # a join of two plain shuffles, so the rows of a very common text can be split
    merge = F.udf(lambda b, m: merged(b, [(x["k"], x["s"], x["e"]) for x in m or ()]), "string")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_hexdigest((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "blob"])

    paths = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(key, "doc_id bigint, blob string")
    j = paths.join(hits, "blob", "left").withColumn("_base", F.coalesce("_base", F.lit("")))
    count = lambda k: F.size(F.filter(F.split("_base", ","), lambda x: x.startswith(k + ":"))).cast("long")
    return j.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2("_base", 256).alias("base_sha256"),
        F.when(F.col("_more").isNull(), F.col("_base")).otherwise(merge("_base", "_more")).alias("spans"),
    ).withColumn("n_all", F.when(F.col("spans") == "", F.lit(0)).otherwise(F.size(F.split("spans", ","))).cast("long"))


def merged(base: str, more: list[tuple[str, int, int]]) -> str:
    got = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)] + more
    return joined(sorted(got, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
