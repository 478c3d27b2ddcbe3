"""Every registered query of the base package against its SQL on the smallest tables."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest

from lodestar.plans import queries as q
from lodestar.plans.facts import Tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns: list[str], data: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


def both(spark, folder: Path, name: str, **tables: str) -> tuple[list[str], list[str]]:
    """A query's rows and its SQL's over the smallest tables, of which some are made anew, each by SQL over the old ones."""
    con, new = duckdb.connect(), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        if t not in tables:
            (folder / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    for t in TABLES:
        new.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = q.queries()[name](spark, str(folder))
    cur = new.execute(q.SQL[name])
    return rows(df.columns, [tuple(r) for r in df.collect()]), rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, sql, name):
    df = q.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = sql.execute(q.SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want


def test_called_by_takes_the_last_line_whole(spark, tmp_path):
    """References of file 4 beyond column 10,000 of line 39, the last of the range."""
    far = "SELECT * FROM lineitem UNION ALL SELECT * REPLACE (CAST(400038 + 200 * l_partkey AS BIGINT) AS l_orderkey, CAST(4 AS BIGINT) AS l_suppkey) FROM lineitem WHERE l_orderkey < 30"
    got, want = both(spark, tmp_path, "called_by", lineitem=far)
    assert got == want
    assert sum(ast.literal_eval(r)[2] > 10000 for r in want) > 5  # from_col


def test_include_lines_with_shared_paths(spark, tmp_path):
    """Two files a path, and file 0 in another folder than the one that the lines are for."""
    twice = "SELECT * EXCLUDE i REPLACE (CAST(s_suppkey + i * (SELECT count(*) FROM supplier) AS BIGINT) AS s_suppkey, CAST(CASE s_suppkey WHEN 0 THEN 2 ELSE s_suppkey % 3 + 3 END AS INT) AS s_nationkey) FROM supplier, (SELECT unnest(range(2)) AS i)"
    got, want = both(spark, tmp_path, "include_lines", supplier=twice, part="SELECT * REPLACE ('small ring' AS p_name) FROM part")
    assert got == want
    assert any('#include "' in r for r in want) and any(ast.literal_eval(r)[1] > 2 for r in want)  # position


def test_all_have_sql():
    assert set(q.QUERIES) == set(q.SQL)


def tree_rows(edges: list[tuple[int, int]], root: int) -> list[tuple[int, int, int, bool]]:
    """Depth-first order by a plain walk."""
    out, seen = [], set()
    below: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        below.setdefault(a, []).append(b)

    def walk(n: int, depth: int) -> None:
        out.append((len(out) + 1, depth, n, n not in seen))
        if n not in seen:
            seen.add(n)
            for m in below.get(n, []):
                walk(m, depth + 1)

    walk(root, 0)
    return out


@pytest.mark.parametrize("root", [0, 7, 9])
def test_include_tree_is_depth_first(spark, root):
    t = Tables(spark, DATA)
    edges = [(r.src_file, r.dst_file) for r in t.includes.collect()] + [(7, 2), (3, 9), (9, 0), (2, 2)]
    e = spark.createDataFrame(edges, "src int, dst int")
    from lodestar.operators.graph import include_tree

    got = [tuple(r) for r in include_tree(e, root).orderBy("position").collect()]
    assert got == tree_rows([x for x in edges if x[0] != x[1]], root)


def test_include_tree_is_linear(spark):
    """A ladder in which the number of ways to a node doubles with every step."""
    from lodestar.operators.graph import include_tree

    edges = [(3 * k + a, 3 * k + b) for k in range(12) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    got = [tuple(r) for r in include_tree(spark.createDataFrame(edges, "src int, dst int"), 0).orderBy("position").collect()]
    assert got == tree_rows(edges, 0) and len(got) == len(edges) + 1
