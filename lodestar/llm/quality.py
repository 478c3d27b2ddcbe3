"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad with features of itself and of its neighbours; the
forward-backward marginals, weighted by line length, aggregate into a document's quality,
which a logistic step fitted on the same rows turns into a probability.

The field is fitted on a bounded sample of labelled rows: ``sample`` documents of each label,
those with the least hash of their id, as long as their lines are at most ``LINES`` in all, and each with all its lines.
Executors turn them into features; only these reach the driver. Scoring reads whole texts too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sampled, small

#: Values of the fit: documents and lines of a label, gradient steps, their size, the weight of the squares.
SAMPLE, LINES, STEPS, RATE, L2 = 1500, 200_000, 150, 0.1, 1e-3

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?!-]")
_FEATURES = 12


def line_features(line: str) -> list[float]:
    """Twelve numbers, most of them shares in 0..1; blank lines give zeros."""
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * _FEATURES
    size = len(line)
    lower = [w.lower() for w in words]
    upper = sum(map(str.isupper, words))
    return [
        1.0,
        math.log1p(n) / 5,
        len(set(lower)) / n,
        sum(map(eq, lower, lower[1:])) / n,
        upper / n,
        len(_SYMBOL.findall(line)) / size * 5,
        line.count("|") / n,
        (line.count("!") + line.count("?")) / n,
        sum(map(str.isdigit, line)) / size * 5,
        min(size / n, 30) / 10,
        float(line[-1] in ".!?…\"'" ),
        math.sqrt(len(set(lower))) / 10,
    ]


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, line lengths); lines end at \\n."""
    lines = (text or "").split("\n")
    return np.array([line_features(line) for line in lines], dtype=np.float32), np.array([len(line) for line in lines], dtype=np.float64)


def widened(x: np.ndarray) -> np.ndarray:
    """Each line's features with those of both neighbours and a constant."""
    none = np.zeros((1, _FEATURES), np.float32)
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), np.ones((len(x), 1), np.float32)])


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with those of both neighbours, line lengths)."""
    x, sizes = lines_of(text)
    return widened(x), sizes


def marginals(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Forward-backward over padded chains: unary (docs, T, 2), lengths (docs,), trans (2, 2).

    Returns node marginals (docs, T, 2), log Z (docs,), and with ``weight`` (docs,) the sum over chains of weight times pair marginals (2, 2).
    With two labels a message is one number, the log of its ratio.
    """
    d, t, _ = unary.shape
    u = np.ascontiguousarray((unary[:, :, 1] - unary[:, :, 0]).T)
    inside = np.arange(t)[:, None] < lengths
    ahead, back = np.empty_like(u), np.zeros_like(u)
    ahead[0] = u[0]
    for i in range(1, t):
        ahead[i] = u[i] + np.logaddexp(trans[0, 1], trans[1, 1] + ahead[i - 1]) - np.logaddexp(trans[0, 0], trans[1, 0] + ahead[i - 1])
    for i in range(t - 2, -1, -1):
        v = u[i + 1] + back[i + 1]
        back[i] = np.where(inside[i + 1], np.logaddexp(trans[1, 0], trans[1, 1] + v) - np.logaddexp(trans[0, 0], trans[0, 1] + v), 0.0)
    good = 1 / (1 + np.exp(-np.clip(ahead + back, -700, 700)))
    node = np.stack([1 - good.T, good.T], 2)
    step = unary[:, :, 0].T.copy()
    step[1:] += np.logaddexp(trans[0, 0], trans[1, 0] + ahead[:-1])
    z = np.where(inside, step, 0.0).sum(axis=0) + np.logaddexp(0.0, ahead[lengths - 1, np.arange(d)])
    if weight is None:
        return node, z, None
    before, after = ahead[:-1], u[1:] + back[1:]
    logit = np.stack([np.full_like(before, trans[0, 0]), trans[0, 1] + after, trans[1, 0] + before, trans[1, 1] + before + after])
    p = np.exp(logit - logit.max(axis=0))
    p *= np.where(inside[1:], weight, 0.0) / p.sum(axis=0)
    return node, z, p.sum(axis=(1, 2)).reshape(2, 2)


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains])
    x = np.zeros((len(chains), int(lengths.max()), chains[0].shape[1]), chains[0].dtype)
    for i, c in enumerate(chains):
        x[i, : len(c)] = c
    return x, lengths


def fit(made: list[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """Fits the field to (features, line lengths, label) of documents by gradient steps on the chains' likelihood, a document's label standing for its lines, then the logistic step.

    Without documents of both labels the model is constant: the only label seen, or 0.5. Those without a character are left out.
    """
    labels = {m[2] for m in made}
    if labels != {0, 1}:
        return {"constant": float(labels.pop()) if len(labels) == 1 else 0.5}
    made = [m for m in made if m[1].sum() > 0]
    if {m[2] for m in made} != {0, 1}:
        return {"constant": float(made[0][2]) if made else 0.5}
    chains = [(x, size) for x, size, _ in made]
    y = np.array([m[2] for m in made])
    share = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = (len(y) / (2 * share))[y] / len(y)
    lines = np.array([len(x) for x, _ in chains])
    per = weight / lines
    total = np.array([(lines[y == k] - 1).sum() for k in (0, 1)])
    parts = [(np.array(part), *_padded([chains[i][0] for i in part])) for part in alike(chains)]
    w, b = np.zeros(chains[0][0].shape[1]), np.zeros((2, 2))
    m1, m2 = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, STEPS + 1):
        gw, gb = -L2 * w, np.zeros((2, 2))
        for part, x, lengths in parts:
            s = (x @ w.astype(x.dtype)).astype(np.float64)
            # transitions: expected, so that both labels weigh the same
            node, _, pairs = marginals(np.stack([-s / 2, s / 2], 2), lengths, b, 0.5 / np.maximum(total, 1)[y[part]])
            gap = np.where(np.arange(x.shape[1]) < lengths[:, None], (y[part][:, None] - node[:, :, 1]) * per[part][:, None], 0.0)
            gw += gap.ravel().astype(x.dtype) @ x.reshape(-1, x.shape[2])
            gb -= pairs
        for k in (0, 1):  # observed
            gb[k, k] += 0.5 * (total[k] > 0)
        gb -= L2 * b
        for i, (p, g) in enumerate(((w, gw), (b, gb))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            p += RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    model = {"w": w, "b": b, "scale": 1.0, "shift": 0.0, "empty": 0.0}
    raw = raw_scores(model, chains)
    scale, shift = 1.0, 0.0
    for _ in range(200):  # logistic regression on one number, classes weighted by how common they are
        p = 1 / (1 + np.exp(-(scale * raw + shift)))
        h = np.clip(p * (1 - p), 1e-6, None)
        g = y - p
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, np.array([(g * raw).sum() - 1e-3 * scale, g.sum()]))
        scale, shift = scale + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
        if abs(d).max() < 1e-6:
            break
    return model | {"scale": scale, "shift": shift}


def alike(chains: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[int]]:
    """Numbers of chains in parts of like length, of bounded size when padded."""
    order = sorted(range(len(chains)), key=lambda i: len(chains[i][1]))
    at = 0
    while at < len(order):
        n = min(512, max(1, 200_000 // max(1, len(chains[order[min(at + 511, len(order) - 1)]][1]))))
        yield order[at : at + n]
        at += n


def raw_scores(model: dict, chains: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logit of the length-weighted mean marginal of label good. Chains of like length run together."""
    out = np.zeros(len(chains))
    for part in alike(chains):
        s, lengths = _padded([(chains[i][0] @ model["w"])[:, None] for i in part])
        node, _, _ = marginals(np.concatenate([-s / 2, s / 2], 2), lengths, model["b"])
        for j, i in enumerate(part):
            size = chains[i][1]
            p = float((node[j, : len(size), 1] * size).sum() / size.sum()) if size.sum() else 0.5
            out[i] = math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    return out


def score_texts(model: dict, texts: list[str | None]) -> list[float]:
    """Probability of good per text; a text without any character scores ``model["empty"]``."""
    if "constant" in model:
        return [model["constant"]] * len(texts)
    chains = [featurise(t) for t in texts]
    z = np.clip(model["scale"] * raw_scores(model, chains) + model["shift"], -30, 30)
    p = 1 / (1 + np.exp(-z))
    return [float(v) if c[1].sum() else model["empty"] for v, c in zip(p, chains, strict=True)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> dict:
    """Fits on at most ``sample`` documents and ``lines`` lines a label from ``labels`` (doc_id, quality) joined with ``docs`` (doc_id, text).

    Rows with a null label or id, or a label other than 0 and 1, are left out, and so are ids that bear both labels. Of several texts under
    one id the one with the least MD5 counts. A document takes part whole or not at all. Brings the features of the sample to the driver, 52 bytes a line.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min("quality").cast("int").alias("_q")).where("quality = _q").drop("_q")
    ids = sampled(docs.select("doc_id").join(marked, "doc_id"), "quality", sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")  # ids: at most 2 * sample rows
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 100):
            got = [lines_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([len(n) for _, n in got], pa.int64()), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in got], pa.binary())],
                ["doc_id", "quality", "n", "x", "sizes"],
            )

    made = materialise(chosen.select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(features, "doc_id bigint, quality int, n bigint, x binary, sizes binary"), "labelled")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    so_far = Window.partitionBy("quality").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    short = made.where(F.col("n") <= lines).select("doc_id", "quality", F.sum("n").over(so_far).alias("all")).where(F.col("all") <= lines)
    rows = made.join(F.broadcast(short.select("doc_id")), "doc_id", "left_semi").orderBy(*order).collect()  # at most 2 * sample rows and 2 * lines lines
    return fit([(widened(np.frombuffer(r["x"], np.float32).reshape(-1, _FEATURES)), np.frombuffer(r["sizes"], np.uint32).astype(np.float64), r["quality"]) for r in rows])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; null and empty texts score the model's value for them, repeated rows get a row each, long texts are read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(shared.value, b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
