"""The pipeline against a brute-force version on a small folder of tables."""

from __future__ import annotations

import random
import zlib

import pytest
from test_llm_operators import TOKENIZER, odd_rows, plain_components, plain_secrets, prose, reference_ids

import corpus_pipeline
from lodestar.llm import secrets

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(prose(rng, 30))
    rows = [(i, " ".join(prose(rng, 60)), "aa" if i % 2 else "bb", "s", 1) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " more", "aa", "s", 1) for i in range(5)]
    rows += [(200, "x " + item + " y", "aa", "s", 1), (201, 'start token = "abcdef0123456789abcdef01" end', None, None, None), (202, "123 456", "aa", "s", 7)]
    rows += [(None if i is None else 300 + i, t, None, "odd", None) for i, t in odd_rows()]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def brute(rows, item):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    comp = plain_components([(r[0], r[1]) for r in rows], 5, 8, 10)
    root = {d: c for d, _, c in comp}
    kept = {(r[0], r[1]) for r in rows if root[str(r[0])] == str(r[0]) or r[0] is None or len([x for x in rows if x[0] == r[0]]) > 1 and root[str(r[0])] == str(r[0])}
    out = []
    for d, t in kept:
        if item in t:
            continue
        spans = secrets.merged(secrets.find(t, "base"), secrets.find(t, "extended"))
        assert [s for s in spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [f"{k}:{s}:{e}" for s, _, k, e in plain_secrets(t)]
        ids = reference_ids(secrets.redact_text(t, spans))
        out += [(str(d), zlib.crc32(ids[s : s + 2048].tobytes()), s) for s in range(0, len(ids), 2048)]
    return sorted(out)


def test_pipeline_is_brute_force(spark, folder):
    path, rows, item = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r.doc_id), r.ids_crc32, r.start) for r in got) == brute(rows, item)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_columns_and_clean_rows(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'x' as digest", "'y' as score", "'z' as lang_pred", "1 as _base", "2 as key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} >= set(range(30))
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
    assert TOKENIZER


def test_duplicates_are_decided_by_text(spark, tmp_path):
    """A clean text stays under the id of a near duplicate; copies without id go, one stays where none has an id."""
    rng = random.Random(22)
    a, b, c, d, e = (" ".join(prose(rng, 60)) for _ in range(5))
    rows = [(1, a), (5, a + " more"), (5, b), (None, a), (None, a + " again"), (None, c), (None, c + " more"), (None, d), (7, e), (7, e + " more"), (None, None), (8, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()]
    assert {x for x in got if x[1] and x[1][:9] in (a[:9], b[:9], d[:9])} == {(1, a), (5, b), (None, d)}
    assert sum(t is not None and t.startswith(c) for _, t in got) == 1 == sum(t is not None and t.startswith(e) for _, t in got)
    assert len(got) == 7 and {(None, None), (8, None)} <= set(got)
