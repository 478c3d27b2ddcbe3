"""Fact tables projected from the star-schema test tables, as SQL that both engines read.

Parts are symbols (even keys declare, odd ones define; two share a usr), line items are references to
them, suppliers are files, orders are functions in other projections. Spark gets tables as DataFrames in
braces; the SQL side names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = "CAST(floor(p_partkey / 2) AS BIGINT)"
_KIND = "CASE u % 6 WHEN 0 THEN 'FunctionDecl' WHEN 1 THEN 'CXXMethod' WHEN 2 THEN 'ClassDecl' WHEN 3 THEN 'VarDecl' WHEN 4 THEN 'FieldDecl' ELSE 'CXXConstructor' END"

FACTS: dict[str, str] = {
    "files": """SELECT CAST(s_suppkey AS INT) AS file_id,
        CASE WHEN s_nationkey < 3 THEN '/usr/include/' WHEN s_nationkey % 3 = 0 THEN '/src/core/' WHEN s_nationkey % 3 = 1 THEN '/src/util/' ELSE '/src/net/' END
          || s_name || CASE WHEN s_suppkey % 2 = 1 THEN '.hpp' ELSE '.cpp' END AS path,
        s_suppkey % 2 = 1 AS is_header, s_nationkey < 3 AS is_system,
        CAST((s_suppkey * 37) % 1009 AS BIGINT) AS mtime_ms, CAST((s_suppkey * 53) % 1009 + 300 AS BIGINT) AS parsed_ms FROM {supplier}""",
    "includes": """SELECT CAST(s_suppkey AS INT) AS src_file, CAST(floor((s_suppkey - 1) / 2) AS INT) AS dst_file FROM {supplier} WHERE s_suppkey > 0
        UNION SELECT CAST(s_suppkey AS INT), CAST(s_suppkey - 1 AS INT) FROM {supplier} WHERE s_suppkey % 10 = 7
        UNION SELECT CAST(s_suppkey AS INT), CAST(s_suppkey + 1 AS INT) FROM {supplier} WHERE s_suppkey % 10 = 6""",
    "defs": f"""SELECT *, {_KIND} AS kind, CAST(CASE WHEN p_partkey % 2 = 1 THEN 2048 ELSE 0 END + CASE WHEN u % 12 = 1 THEN 1 ELSE 0 END AS INT) AS flags,
        'c:' || CAST(u AS STRING) AS usr,
        CASE WHEN u % 6 = 2 AND p_partkey % 2 = 1 AND u >= 6 THEN 'c:' || CAST(CAST(6 * floor(floor(u / 6) / 2) + 2 AS BIGINT) AS STRING) END AS base,
        CASE WHEN u % 12 = 1 AND u % 48 <> 1 THEN 'c:' || CAST(u - u % 48 + 1 AS STRING) END AS overridden,
        p_type || '::' || replace(p_name, ' ', '_') || CASE WHEN u % 6 IN (0, 1, 5) THEN '(' || CAST(p_size AS STRING) || ')' ELSE '' END AS symbol_name,
        CAST(CASE WHEN u % 6 IN (0, 1, 2, 5) AND p_partkey % 2 = 1 THEN line + 8 ELSE line END AS INT) AS end_line FROM (
          SELECT p_partkey, p_type, p_name, p_size, {_U} AS u, CAST(p_partkey % (SELECT count(*) FROM {{supplier}}) AS INT) AS file_id,
            CAST(floor(p_partkey / (SELECT count(*) FROM {{supplier}})) * 10 + 1 AS INT) AS line, CAST(1 + p_size % 20 AS INT) AS col, CAST(5 + p_size % 10 AS INT) AS symbol_length FROM {{part}}) p""",
    "refs": """SELECT file_id, line, col, min(p) AS p, CAST(min(ln) AS INT) AS ln FROM (
          SELECT CAST(l_suppkey AS INT) AS file_id, CAST(l_orderkey % 200 + 1 AS INT) AS line,
            CAST(30 + floor(l_orderkey / 200) * 8 + l_linenumber AS INT) AS col, l_partkey AS p, l_linenumber AS ln FROM {lineitem}) r GROUP BY file_id, line, col""",
    "symbols": """SELECT file_id, line, col, symbol_name, usr, base, kind, flags, symbol_length, line AS start_line, 1 AS start_col, end_line, 80 AS end_col FROM {defs}
        UNION ALL SELECT file_id, line, col, '', '', NULL, CASE ln % 3 WHEN 0 THEN 'DeclRefExpr' WHEN 1 THEN 'CallExpr' ELSE 'MemberRefExpr' END, 0, 5, line, col, line, col + 5 FROM {refs}""",
    "usrs": "SELECT usr, file_id, line, col FROM {defs}",
    "targets": """SELECT 'c:' || CAST(CAST(floor(p / 2) AS BIGINT) AS STRING) AS usr, file_id, line, col FROM {refs}
        UNION ALL SELECT overridden, file_id, line, col FROM {defs} WHERE overridden IS NOT NULL""",
    "symbol_names": """SELECT symbol_name AS name, file_id, line, col FROM {defs}
        UNION SELECT split_part(symbol_name, '(', 1), file_id, line, col FROM {defs}
        UNION SELECT split_part(symbol_name, '::', 2), file_id, line, col FROM {defs}""",
    "diagnostics": """SELECT event_id AS diag_id, CAST(user_id % 50 AS INT) AS file_id, CAST(event_id % 40 + 1 AS INT) AS line, CAST(event_id % 7 + 1 AS INT) AS col, CAST(event_id % 11 AS INT) AS length,
          CASE event_id % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' WHEN 2 THEN 'note' ELSE 'skipped' END AS severity, 'event ' || CAST(event_id AS STRING) AS message FROM {events} WHERE event_type = 'error'""",
}
NEEDS = {
    "files": ["supplier"], "includes": ["supplier"], "defs": ["supplier", "part"], "refs": ["lineitem"], "symbols": ["defs", "refs"], "usrs": ["defs"], "targets": ["defs", "refs"], "symbol_names": ["defs"], "diagnostics": ["events"],
}


class Tables:
    """The test tables and facts of one folder, read on demand and once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            if name in FACTS:
                df = self.spark.sql(FACTS[name], **{n: getattr(self, n) for n in NEEDS[name]})
                if name == "symbols":
                    df = df.withColumn("base_classes", F.when(F.col("base").isNotNull(), F.array("base")).otherwise(F.array().cast("array<string>"))).drop("base")
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._held[name] = df
        return self._held[name]


def with_facts(sql: str, *names: str) -> str:
    """``sql`` behind common table expressions of the facts it names, for the SQL side."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            if m in FACTS:
                add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FACTS[n].format(**{m: m for m in NEEDS[n]})})" for n in order]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql) if not sql.lstrip().startswith(",") else "WITH RECURSIVE " + ",\n".join(ctes) + sql
