"""Registered queries: every operator over projections of the test tables, with the SQL that gives the same rows.

The Spark side goes through the package's operators and commands; the SQL side states the result on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import commandline, names, predicates, text
from lodestar.operators import aggregates, graph, lookup, rank, report, sets, xref
from lodestar.plans.commands import CodeBase
from lodestar.plans.facts import Tables, with_facts
from lodestar.schema import LOC, in_category, is_definition
from lodestar.sources import readers
from lodestar.streaming import incremental

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}

_RANK = "(CASE WHEN kind IN ('VarDecl','FieldDecl') THEN 2 WHEN kind IN ('FunctionDecl','CXXMethod','CXXConstructor','FunctionTemplate') THEN 5 WHEN kind IN ('ClassDecl','StructDecl','ClassTemplate') THEN 10 ELSE 1 END + CASE WHEN flags & 2048 <> 0 THEN 100 ELSE 0 END)"
_TARGET_RANK = "CASE WHEN kind IN ('VarDecl','FieldDecl') THEN 6 WHEN kind IN ('FunctionDecl','CXXMethod') THEN 4 WHEN kind = 'CXXConstructor' THEN 3 WHEN kind = 'ClassDecl' THEN 0 ELSE 2 END"
_REF = "kind IN ('DeclRefExpr','CallExpr','MemberRefExpr')"


def query(sql: str | None = None, *facts: str):
    """Registers a function of :class:`Tables` under its name; ``sql`` may use the named facts."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_facts(sql, *facts) if facts else sql
        return f

    return put


def base(t: Tables) -> CodeBase:
    return CodeBase(t.spark, {n: getattr(t, n) for n in ("files", "includes", "symbols", "usrs", "targets", "symbol_names", "diagnostics")})


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select(*LOC, "symbol_name", "kind", rank.sort_rank().alias("rank"))


def _ranked_sql(where: str, symbols: str = "symbols") -> str:
    return f"""SELECT file_id, line, col, symbol_name, kind, CAST({_RANK} AS INT) AS rank FROM {symbols} s
      JOIN (SELECT DISTINCT file_id, line, col FROM symbol_names WHERE {where}) n USING (file_id, line, col)"""


# --- name search -------------------------------------------------------------------------------------------


@query(_ranked_sql("starts_with(name, 'ECONOMY::red')"), "symbols", "symbol_names")
def find_symbols_prefix(t):
    return _ranked(xref.at(t.symbol_names.where(predicates.prefix(F.col("name"), "ECONOMY::red")).select(*LOC).distinct(), t.symbols))


@query(_ranked_sql("regexp_matches(name, '^.*::red_.o.*\\([0-9]*\\)$')"), "symbols", "symbol_names")
def find_symbols_wildcard(t):
    return _ranked(base(t).find_symbols("*::red_?o*(*)", wildcards=True))


@query(_ranked_sql("regexp_matches(name, 'ring\\(1[0-9]\\)$')"), "symbols", "symbol_names")
def find_symbols_regex(t):
    return _ranked(base(t).find_symbols(r"ring\(1[0-9]\)$", regex=True))


@query(_ranked_sql("starts_with(lower(name), 'small::blue')"), "symbols", "symbol_names")
def find_symbols_icase(t):
    return _ranked(base(t).find_symbols("Small::BLUE", ignore_case=True))


@query(_ranked_sql("name = 'small_ring' OR (starts_with(name, 'small_ring') AND strpos(name, '(') = 11)"), "symbols", "symbol_names")
def find_symbols_overload(t):
    return _ranked(base(t).find_symbols("small_ring"))


@query(_ranked_sql("starts_with(name, 'PROMO::')", "(SELECT * FROM symbols WHERE flags & 2048 <> 0 AND line BETWEEN 20 AND 120)"), "symbols", "symbol_names")
def find_definitions_in_range(t):
    return _ranked(base(t).find_symbols("PROMO::*", wildcards=True, definitions_only=True, lines=(20, 120)))


@query(f"""SELECT file_id, line, col, symbol_name, CAST(position AS INT) AS position FROM (SELECT s.*, row_number() OVER (ORDER BY {_RANK} DESC, file_id, line, col) AS position FROM symbols s
      JOIN (SELECT DISTINCT file_id, line, col FROM symbol_names WHERE starts_with(name, 'ECONOMY')) n USING (file_id, line, col)) WHERE position <= 100""", "symbols", "symbol_names")
def find_symbols_first(t):
    """The limit of a search is the feature: a top-n of every task, so only n rows meet in one."""
    first = base(t).find_symbols("ECONOMY*", wildcards=True, limit=100)
    return report.numbered(first, [rank.sort_rank().desc(), *LOC]).select(*LOC, "symbol_name", "position")


@query("SELECT DISTINCT name FROM symbol_names WHERE starts_with(name, 'LARGE::') AND name <> ''", "symbol_names")
def list_symbols(t):
    return base(t).list_symbols("LARGE::*", wildcards=True)


@query("SELECT DISTINCT split_part(name, '(', 1) AS name FROM symbol_names WHERE starts_with(name, 'small')", "symbol_names")
def list_symbols_strip(t):
    return base(t).list_symbols("small", strip=True)


@query("SELECT DISTINCT symbol_name AS name FROM symbols JOIN files USING (file_id) WHERE path IN ('/src/net/Supplier#000000006.cpp','/src/core/Supplier#000000000.cpp') AND contains(symbol_name, 'ring')", "symbols", "files")
def list_symbols_in_file(t):
    return base(t).list_symbols("ring", files=["/src/net/Supplier#000000006.cpp", "/src/core/Supplier#000000000.cpp"])


# --- positions ---------------------------------------------------------------------------------------------

_PROBES = "SELECT CAST(row_number() OVER (ORDER BY file_id, line, col) AS BIGINT) AS probe_id, file_id, line, col FROM (SELECT DISTINCT file_id, line, CAST(col + p % 7 AS INT) AS col FROM refs)"


def _probes(t) -> DataFrame:
    spots = t.refs.select("file_id", "line", (F.col("col") + F.col("p") % 7).cast("int").alias("col")).distinct()
    return spots.withColumn("probe_id", F.xxhash64(*LOC))


@query(f"""SELECT p.file_id, p.line, p.col, CASE WHEN p.col - s.col < s.symbol_length THEN s.col END AS found_col, CASE WHEN p.col - s.col < s.symbol_length THEN s.kind END AS found_kind
  FROM ({_PROBES}) p ASOF LEFT JOIN symbols s ON p.file_id = s.file_id AND p.line = s.line AND p.col >= s.col""", "symbols")
def floor_lookup(t):
    return lookup.floor_lookup(_probes(t), t.symbols).select(*LOC, F.col("symbol.col").alias("found_col"), F.col("symbol.kind").alias("found_kind"))


@query("SELECT file_id, line, col, kind, symbol_name FROM symbols WHERE file_id = 6 AND line = 21 AND col <= 45 AND 45 - col < symbol_length ORDER BY col DESC LIMIT 1", "symbols")
def symbol_at(t):
    return base(t).symbol_at(6, 21, 45).select(*LOC, "kind", "symbol_name")


@query("SELECT file_id, line, col, kind FROM symbols WHERE file_id = 7 AND (line > 3 OR (line = 3 AND col >= 10)) AND (line < 40 OR (line = 40 AND col <= 20))", "symbols")
def range_symbols(t):
    return base(t).symbol_info(7, (3, 10), (40, 20)).select(*LOC, "kind")


_ENCLOSE = """SELECT r.file_id, r.line, r.col, max_by(struct_pack(l := c.line, k := c.col, n := c.symbol_name), c.line * 100000 + c.col) AS e FROM refs r
  JOIN symbols c ON c.file_id = r.file_id AND c.flags & 2048 <> 0 AND c.kind IN ('FunctionDecl','CXXMethod','ClassDecl','CXXConstructor')
    AND (c.line < r.line OR (c.line = r.line AND c.col <= r.col)) AND (r.line < c.end_line OR (r.line = c.end_line AND r.col <= c.end_col)) GROUP BY r.file_id, r.line, r.col"""


@query(f"SELECT file_id, line, col, e.l AS enclosing_line, e.k AS enclosing_col, e.n AS enclosing_symbol_name FROM ({_ENCLOSE})", "symbols")
def enclosing_innermost(t):
    return lookup.enclosing_container(t.refs.select(*LOC), t.symbols).select(*LOC, "enclosing_line", "enclosing_col", "enclosing_symbol_name")


@query("""SELECT o.o_orderkey AS probe, arg_max(i.o_orderkey, (i.o_orderdate, i.o_orderkey)) AS inside FROM orders o JOIN orders i
  ON o.o_custkey = i.o_custkey AND i.o_orderkey <> o.o_orderkey AND i.o_orderdate <= o.o_orderdate AND date_diff('day', i.o_orderdate, o.o_orderdate) <= 30 GROUP BY o.o_orderkey""")
def enclosing_orders(t):
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    o = t.orders.select("o_orderkey", "o_custkey", day.alias("d"))
    iv = o.select(F.col("o_orderkey").alias("inside"), "o_custkey", F.col("d").alias("s"), (F.col("d") + 30).alias("e"))
    p = o.withColumnRenamed("o_orderkey", "probe")
    both = lookup.enclosing(p, iv, ["o_custkey"], "d", "s", "e", ["s", "inside"], ["inside"])
    found = both.where("enclosing_inside <> probe").select("probe", F.col("enclosing_inside").alias("inside"))
    # an order is no interval of its own: those that found themselves look again among their customer's others
    again = both.where("enclosing_inside = probe").select("probe", "o_custkey", "d").join(iv, "o_custkey").where("inside <> probe and s <= d and d <= e")
    return found.union(again.groupBy("probe").agg(F.max_by("inside", F.struct("s", "inside")).alias("inside")))


_WORDS = """, l AS (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INT) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  w AS (SELECT doc_id, line, unnest(string_split(text, ' ')) AS spelling, CAST(generate_subscripts(string_split(text, ' '), 1) AS INT) AS n FROM l),
  k AS (SELECT CAST(doc_id AS INT) AS file_id, line, n, CAST(1 + coalesce(sum(length(spelling) + 1) OVER (PARTITION BY doc_id, line ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS col, spelling FROM w)
"""


def _tokens(t) -> DataFrame:
    return readers.words(readers.lines(t.documents.select(F.col("doc_id").cast("int").alias("file_id"), "text")))


@query("WITH" + _WORDS[1:] + "SELECT file_id, line, col, spelling FROM k WHERE spelling <> ''")
def tokenise_lines(t):
    return _tokens(t).where("spelling <> ''").select(*LOC, "spelling")


@query("WITH" + _WORDS[1:] + "SELECT file_id, col, spelling FROM k WHERE line = 1 AND file_id = 10 AND col - 1 + length(spelling) >= 20 AND col - 1 <= 60 AND spelling <> ''")
def token_range(t):
    k = _tokens(t).where("line = 1 and spelling <> ''").select("file_id", (F.col("col") - 1).alias("offset"), F.length("spelling").alias("length"), "line", "col", "spelling")
    return lookup.tokens_between(k, 10, 20, 60).select("file_id", "col", "spelling")


@query("WITH" + _WORDS[1:] + ", s AS (SELECT * FROM k WHERE n % 3 = 1) SELECT k.file_id, k.line, k.col, s.spelling AS symbol FROM k ASOF LEFT JOIN s ON k.file_id = s.file_id AND k.line = s.line AND k.col >= s.col WHERE k.col - s.col < 10")
def token_symbols(t):
    k = _tokens(t)
    w = Window.partitionBy("file_id", "line").orderBy("col")
    k = k.withColumn("n", F.row_number().over(w)).withColumn("offset", F.col("line").cast("long") * 1000000 + F.col("col"))
    s = k.where("n % 3 = 1").select(*LOC, "spelling", F.lit(10).alias("symbol_length"))
    return lookup.token_symbols(k, s).where("symbol is not null").select(*LOC, F.col("symbol.spelling").alias("symbol"))


@query("SELECT doc_id AS file_id, text AS context FROM (SELECT CAST(doc_id AS INT) AS doc_id, string_split(text, chr(10)) AS x FROM documents) d, LATERAL (SELECT CASE WHEN len(x) >= 2 THEN x[2] END AS text)")
def line_context(t):
    lines = readers.lines(t.documents.select(F.col("doc_id").cast("int").alias("file_id"), "text"))
    files = t.documents.select(F.col("doc_id").cast("int").alias("file_id"), F.concat_ws("/", "source", "doc_id").alias("path"))
    return report.with_context(files.select("file_id", F.lit(2).alias("line")), files, lines).select("file_id", "context")


@query("""WITH a AS (SELECT l_orderkey AS call_id, l_linenumber AS i, min(CAST(l_partkey % 1000 AS INT)) AS col FROM lineitem GROUP BY 1, 2),
  b AS (SELECT call_id, i, col, lead(col) OVER (PARTITION BY call_id ORDER BY i) AS nxt FROM a WHERE TRUE), p AS (SELECT o_orderkey AS call_id, CAST(o_custkey % 1000 AS INT) AS col FROM orders)
  SELECT p.call_id AS probe_id, max_by(b.i, b.col * 100 + b.i) AS arg FROM p JOIN b ON p.call_id = b.call_id AND b.col <= p.col AND p.col <= coalesce(nxt - 1, 999) GROUP BY p.call_id""")
def argument_usage(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("index")).agg(F.min((F.col("l_partkey") % 1000).cast("int")).alias("col"))
    a = a.select("call_id", "index", F.col("call_id").cast("int").alias("file_id"), F.lit(1).alias("line"), "col", F.lit(1).alias("end_line"), F.lit(999).alias("end_col"))
    p = t.orders.select(F.col("o_orderkey").alias("probe_id"), F.col("o_orderkey").cast("int").alias("file_id"), F.lit(1).alias("line"), (F.col("o_custkey") % 1000).cast("int").alias("col"))
    return lookup.argument_index(p, a).select("probe_id", F.col("enclosing_index").alias("arg"))


# --- cross references --------------------------------------------------------------------------------------

_FOLLOW = f"""SELECT r.file_id AS from_file_id, r.line AS from_line, r.col AS from_col, d.file_id, d.line, d.col,
  row_number() OVER (PARTITION BY r.file_id, r.line, r.col ORDER BY {_TARGET_RANK.replace("kind", "d.kind")} DESC, d.flags & 2048 DESC, d.file_id, d.line, d.col) AS n
  FROM refs r JOIN defs d ON d.usr = 'c:' || CAST(CAST(floor(r.p / 2) AS BIGINT) AS STRING)"""


@query(f"SELECT from_file_id, from_line, from_col, file_id, line, col FROM ({_FOLLOW}) WHERE n = 1", "refs", "defs")
def follow_location(t):
    found = xref.targets_of(t.symbols.where(in_category("reference")), t.symbols, t.usrs, t.targets)
    return rank.best_target(found, ["from_file_id", "from_line", "from_col"]).select("from_file_id", "from_line", "from_col", *LOC)


@query("""SELECT a.file_id AS from_file_id, a.line AS from_line, a.col AS from_col, b.file_id, b.line, b.col FROM defs a JOIN defs b ON a.usr = b.usr AND (a.flags & 2048) <> (b.flags & 2048)
  WHERE NOT (a.kind = 'ClassDecl' AND a.flags & 2048 <> 0)""", "defs")
def declaration_to_definition(t):
    found = xref.targets_of(t.symbols.where(~in_category("reference")), t.symbols, t.usrs, t.targets)
    return found.select("from_file_id", "from_line", "from_col", *LOC)


@query("SELECT DISTINCT file_id, line, col, usr FROM targets", "targets")
def target_usrs(t):
    return xref.target_usrs(t.symbols, t.targets)


_KEYS = "SELECT usr, min(file_id) AS scope_file FROM defs GROUP BY usr"
_CLOSURE = """, c(seed, node) AS (SELECT DISTINCT src_file, src_file FROM includes UNION SELECT DISTINCT dst_file, dst_file FROM includes UNION SELECT c.seed, i.dst_file FROM c JOIN includes i ON i.src_file = c.node)
"""


@query(_CLOSURE + f""", k AS ({_KEYS}), m AS (SELECT k.usr, k.scope_file, t.file_id, t.line, t.col, c.node IS NOT NULL AS inside FROM k JOIN (SELECT DISTINCT * FROM targets) t ON t.usr = k.usr LEFT JOIN c ON c.seed = k.scope_file AND c.node = t.file_id)
  SELECT usr, scope_file, file_id, line, col FROM m WHERE inside OR usr NOT IN (SELECT usr FROM m WHERE inside)""", "defs", "targets", "includes")
def scoped_then_widened(t):
    keys = t.defs.groupBy("usr").agg(F.min("file_id").alias("scope_file"))
    scope = graph.dependencies(t.includes, keys.select("scope_file"), "arg_depends_on")
    return xref.scoped_then_wide(keys, t.targets.distinct(), scope, ["usr"]).select("usr", "scope_file", *LOC)


@query("SELECT DISTINCT d.usr AS from_usr, t.file_id, t.line, t.col FROM defs d JOIN targets t ON t.usr = d.usr WHERE d.flags & 2048 <> 0", "defs", "targets")
def references(t):
    keys = xref.origin(t.symbols.where(is_definition())).select("from_usr")
    return xref.references_of(keys, t.symbols, t.targets).select("from_usr", *LOC)


@query(f"""SELECT DISTINCT d.usr AS from_usr, s.file_id, s.line, s.col FROM (SELECT DISTINCT usr, kind AS k FROM defs) d JOIN targets t ON t.usr = d.usr JOIN symbols s USING (file_id, line, col)
  WHERE s.{_REF} AND (d.k <> 'ClassDecl' OR s.kind <> 'CallExpr')""", "defs", "targets", "symbols")
def callers(t):
    keys = t.defs.select(F.col("usr").alias("from_usr")).distinct()
    kinds_of = t.defs.select(F.col("usr").alias("from_usr"), F.col("kind").alias("from_kind")).distinct()
    return xref.callers(keys, t.symbols, t.targets, kinds_of).select("from_usr", *LOC)


@query("SELECT usr AS from_usr, file_id, line, col FROM usrs UNION SELECT usr, file_id, line, col FROM targets WHERE usr IN (SELECT usr FROM defs)", "defs", "targets", "usrs")
def all_references(t):
    keys = t.defs.select(F.col("usr").alias("from_usr")).distinct()
    return xref.all_references(keys, t.symbols, t.usrs, t.targets).select("from_usr", *LOC)


@query("SELECT d.file_id, d.line, d.col, d.usr FROM defs d WHERE d.u % 48 IN (1, 13, 25, 37) AND d.u - d.u % 48 + 1 = 49", "defs")
def virtuals(t):
    keys = t.defs.where("usr = 'c:61'").select(F.col("usr").alias("from_usr")).distinct()
    return xref.virtuals(keys, t.symbols, t.usrs, t.targets).select(*LOC, "usr")


@query("SELECT k.usr AS from_usr, d.file_id, d.line, d.col, d.usr FROM (SELECT DISTINCT usr, u FROM defs) k JOIN defs d ON d.u - d.u % 48 = k.u - k.u % 48 WHERE k.u % 48 IN (1, 13, 25, 37) AND d.u % 48 IN (1, 13, 25, 37)", "defs")
def virtuals_all(t):
    keys = t.defs.select(F.col("usr").alias("from_usr")).distinct()
    return xref.virtuals(keys, t.symbols, t.usrs, t.targets).select("from_usr", *LOC, "usr")


@query("""SELECT usr, file_id, line, col, CAST(row_number() OVER (PARTITION BY usr ORDER BY CASE WHEN (file_id, line, col) > (f, l, c) THEN 0 ELSE 1 END, file_id, line, col) AS INT) AS position
  FROM (SELECT DISTINCT t.usr, t.file_id, t.line, t.col, d.file_id AS f, d.line AS l, d.col AS c FROM defs d JOIN targets t ON t.usr = d.usr WHERE d.flags & 2048 <> 0)""", "defs", "targets")
def references_rotated(t):
    own = [F.col(c).alias(f"from_{c}") for c in LOC]
    d = t.defs.where(is_definition()).select("usr", *own)
    rows = d.join(t.targets.distinct(), "usr")
    return rank.rotated(rows, ["usr"], [f"from_{c}" for c in LOC]).select("usr", *LOC, "position")


@query("SELECT DISTINCT file_id, line, col FROM (SELECT * FROM usrs UNION ALL SELECT * FROM targets) WHERE usr = (SELECT 'c:' || CAST(CAST(floor(p / 2) AS BIGINT) AS STRING) FROM refs ORDER BY file_id, line, col LIMIT 1)", "usrs", "targets", "refs")
def rename_locations(t):
    r = t.refs.orderBy(*LOC).select(*LOC).first()
    return base(t).rename(r["file_id"], r["line"], r["col"]).select(*LOC)


_CALLED = "SELECT usr, file_id, line, col FROM targets WHERE line % 40 = 1 AND col % 8 = 7"


@query(f"""SELECT d.usr, d.file_id, d.line, d.col, d.symbol_name, CAST(least(coalesce(n, 0), 2) AS INT) AS callers FROM defs d JOIN files f USING (file_id)
  LEFT JOIN (SELECT usr, count(*) AS n FROM (SELECT DISTINCT t.usr, t.file_id, t.line, t.col FROM ({_CALLED}) t JOIN refs r USING (file_id, line, col)) GROUP BY usr) c ON c.usr = d.usr
  WHERE d.flags & 2048 <> 0 AND d.kind IN ('FunctionDecl','CXXMethod','CXXConstructor') AND NOT f.is_system AND coalesce(n, 0) < 2""", "defs", "files", "targets", "refs")
def dead_functions(t):
    """With the references of some lines only, so that there are functions with none, one and more."""
    facts = {n: getattr(t, n) for n in ("files", "symbols")}
    return CodeBase(t.spark, facts | {"targets": t.targets.where("line % 40 = 1 and col % 8 = 7")}).dead_functions()


@query("SELECT o_custkey AS customer, CAST(least(count(*), 9) AS INT) AS callers FROM orders GROUP BY 1")
def capped_count(t):
    calls = t.orders.select(F.col("o_custkey").alias("usr"), "o_orderkey")
    return aggregates.capped_callers(calls, calls, 9).select(F.col("usr").alias("customer"), "callers")


# --- graphs ------------------------------------------------------------------------------------------------

_FK = """, e(src, dst) AS (SELECT DISTINCT 'O:' || o_orderkey, 'C:' || o_custkey FROM orders UNION SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)
"""


@query("WITH RECURSIVE" + _FK[1:] + ", c(seed, node) AS (SELECT src, src FROM e WHERE src LIKE 'O:%' UNION SELECT c.seed, e.dst FROM c JOIN e ON e.src = c.node) SELECT seed, node FROM c")
def closure_acyclic(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = t.orders.select(key("O:", "o_orderkey").alias("src"), key("C:", "o_custkey").alias("dst"))
    e = o.union(t.customer.select(key("C:", "c_custkey"), key("N:", "c_nationkey"))).union(t.nation.select(key("N:", "n_nationkey"), key("R:", "n_regionkey")))
    return graph.closure(e, o.select("src")).select("seed", "node")


_CYCLIC = """, n AS (SELECT count(*) AS n FROM part), e(src, dst) AS (SELECT p_partkey, (7 * p_partkey + 1) % n FROM part, n UNION SELECT p_partkey, (3 * p_partkey + 2) % n FROM part, n)
"""


def _cyclic(t) -> DataFrame:
    n = t.part.count()
    p = F.col("p_partkey")
    return t.part.select(p.alias("src"), ((7 * p + 1) % n).alias("dst")).union(t.part.select(p, (3 * p + 2) % n))


@query("WITH RECURSIVE" + _CYCLIC[1:] + ", c(node) AS (SELECT 5 UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT CAST(node AS BIGINT) AS node FROM c")
def closure_cyclic(t):
    return graph.closure(_cyclic(t), t.part.where("p_partkey = 5").select("p_partkey")).select("node")


@query(", c(node) AS (SELECT 40 UNION SELECT i.dst_file FROM c JOIN includes i ON i.src_file = c.node) SELECT CAST(node AS INT) AS file_id FROM c WHERE node <> 40", "includes")
def depends_on(t):
    return base(t).dependencies(40, "depends-on").select("file_id")


@query(", c(node) AS (SELECT 3 UNION SELECT i.src_file FROM c JOIN includes i ON i.dst_file = c.node) SELECT CAST(node AS INT) AS file_id FROM c WHERE node <> 3", "includes")
def depended_on(t):
    return base(t).dependencies(3, "depended-on").select("file_id")


@query("SELECT src_file AS file_id FROM includes WHERE dst_file = 6", "includes")
def included_by(t):
    return base(t).dependencies(6, "included-by")


@query(", c(node) AS (SELECT 17 UNION SELECT i.dst_file FROM c JOIN includes i ON i.src_file = c.node) SELECT src_file AS src, array_to_string(list_sort(list(DISTINCT dst_file)), ',') AS neighbours FROM includes WHERE src_file IN (SELECT node FROM c) GROUP BY src_file", "includes")
def raw_dependencies(t):
    return base(t).dependencies(17, "raw").select("src", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("WITH RECURSIVE" + _CYCLIC[1:] + """, w(path) AS (SELECT [CAST(1 AS BIGINT)] UNION ALL SELECT list_append(path, CAST(e.dst AS BIGINT)) FROM w JOIN e ON e.src = path[-1] WHERE len(path) < 8 AND NOT list_contains(path, e.dst) AND path[-1] <> (SELECT 400 % n FROM n))
  SELECT array_to_string(path, '>') AS path FROM w WHERE path[-1] = (SELECT 400 % n FROM n)""")
def include_paths(t):
    one = lambda k: t.part.where(F.col("p_partkey") == k).select("p_partkey")
    return graph.simple_paths(_cyclic(t), one(1), one(400 % t.part.count()), 8).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(""", w(path) AS (SELECT [47] UNION ALL SELECT list_append(path, i.dst_file) FROM w JOIN includes i ON i.src_file = path[-1] WHERE NOT list_contains(path, i.dst_file)),
  first AS (SELECT path[-1] AS node, min(path) AS path FROM w GROUP BY 1), v AS (SELECT path AS p FROM first WHERE len(path) = 1 UNION ALL SELECT list_append(path, i.dst_file) FROM first JOIN (SELECT DISTINCT * FROM includes) i ON i.src_file = node AND i.dst_file <> node)
  SELECT CAST(row_number() OVER (ORDER BY p) AS INT) AS position, CAST(len(p) - 1 AS INT) AS depth, p[-1] AS node, p = first.path AS expanded FROM v JOIN first ON first.node = p[-1]""", "includes")
def include_tree(t):
    return base(t).dependencies(47, "tree")


_BASES = "b(usr, base) AS (SELECT DISTINCT usr, base FROM defs WHERE base IS NOT NULL)"


@query(f""", {_BASES}, up(d, usr, path) AS (SELECT 0, 'c:44', 'c:44' UNION ALL SELECT d + 1, b.base, path || '>' || b.base FROM up JOIN b ON b.usr = up.usr),
  down(d, usr, path) AS (SELECT 0, 'c:44', 'c:44' UNION ALL SELECT d + 1, b.usr, path || '>' || b.usr FROM down JOIN b ON b.base = down.usr)
  SELECT 'super' AS direction, d AS depth, usr, path FROM up WHERE d > 0 UNION ALL SELECT 'sub', d, usr, path FROM down WHERE d > 0""", "defs")
def class_hierarchy(t):
    return base(t).class_hierarchy("c:44")


@query("SELECT d.base, d.usr, d.file_id, d.line, d.col FROM defs d WHERE d.base IN ('c:8', 'c:14')", "defs")
def subclasses(t):
    keys = t.defs.where("usr in ('c:8', 'c:14')").select("usr")
    return xref.subclasses(keys, t.symbols).select("base", "usr", *LOC)


@query("SELECT d.base, d.usr, d.file_id, d.line, d.col FROM defs d WHERE d.base IN (SELECT usr FROM defs)", "defs")
def subclasses_all(t):
    return xref.subclasses(t.defs.select("usr"), t.symbols).select("base", "usr", *LOC)


@query("SELECT d.usr, b.usr AS base, b.file_id, b.line, b.col FROM defs d JOIN defs b ON b.usr = d.base AND b.flags & 2048 <> 0", "defs")
def superclasses(t):
    return xref.superclasses(t.defs.select("usr"), t.symbols, t.usrs).select("usr", "base", *LOC)


@query(_CLOSURE + """, e AS (SELECT src_file, dst_file FROM includes WHERE src_file NOT IN (SELECT file_id FROM files WHERE is_system)), u AS (SELECT CAST(s_suppkey AS INT) AS a, s_nationkey AS b FROM supplier)
  SELECT src_file, dst_file FROM e WHERE NOT EXISTS (SELECT 1 FROM u JOIN c ON c.node = u.b WHERE u.a = e.src_file AND c.seed = e.dst_file)""", "includes", "files")
def unneeded_includes(t):
    used = t.supplier.select(F.col("s_suppkey").cast("int").alias("from_file"), F.col("s_nationkey").alias("to_file"))  # a supplier's file uses its nation's
    return graph.unneeded_includes(t.includes, used, t.files.where("is_system").select("file_id"))


@query("SELECT CAST(s_suppkey AS INT) AS from_file, s_nationkey AS to_file FROM supplier WHERE s_suppkey <> s_nationkey AND NOT EXISTS (SELECT 1 FROM includes i WHERE i.src_file = s_suppkey AND i.dst_file = s_nationkey)", "includes")
def missing_includes(t):
    used = t.supplier.select(F.col("s_suppkey").cast("int").alias("from_file"), F.col("s_nationkey").alias("to_file"))  # a supplier's file uses its nation's
    return graph.missing_includes(t.includes, used)


@query(", c(seed, node, d) AS (SELECT file_id, file_id, 0 FROM files WHERE is_header UNION SELECT c.seed, i.src_file, d + 1 FROM c JOIN includes i ON i.dst_file = c.node WHERE d < 30), r AS (SELECT seed, node, min(d) AS d FROM c JOIN files f ON f.file_id = c.node AND NOT f.is_header WHERE d > 0 GROUP BY 1, 2) SELECT seed AS header, CAST(d AS INT) AS depth, node AS source FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY d, node) AS n FROM r) WHERE n = 1", "files", "includes")
def header_source(t):
    return graph.header_source(t.includes, t.files.where("is_header").select("file_id"), t.files.where("not is_header")).select("header", "depth", "source")


@query(", c(seed, node) AS (SELECT file_id, file_id FROM files UNION SELECT c.seed, i.src_file FROM c JOIN includes i ON i.dst_file = c.node) SELECT seed AS file_id, bool_or(node % 9 = 4) AS has_source FROM c GROUP BY seed", "files", "includes")
def has_source(t):
    return graph.has_source(t.includes, t.files.select("file_id"), t.files.where("file_id % 9 = 4"))


@query("SELECT src_file, min(dst_file) AS dst_file FROM includes GROUP BY src_file HAVING count(*) = 1", "includes")
def alias_headers(t):
    return graph.alias_headers(t.includes)


@query(", user_edges AS (SELECT src_file, dst_file FROM includes JOIN files ON file_id = dst_file WHERE NOT is_system), c(seed, node) AS (SELECT file_id, dst_file FROM files JOIN user_edges ON src_file = file_id WHERE NOT is_header UNION SELECT c.seed, e.dst_file FROM c JOIN user_edges e ON e.src_file = c.node) SELECT DISTINCT seed AS file_id FROM c WHERE node IN (5, 11, 30) AND seed <> node", "files", "includes")
def reaches_open_buffer(t):
    buffers = t.files.where("file_id in (5, 11, 30)").select("file_id")
    return graph.reaches_buffer(t.includes, t.files.where("not is_header").select("file_id"), buffers, t.files)


@query("SELECT src_file, dst_file FROM includes WHERE src_file % 5 <> 0 UNION SELECT file_id, CAST(floor(file_id / 3) AS INT) FROM files WHERE file_id % 5 = 0", "includes", "files")
def replaced_edges(t):
    visited = t.files.where("file_id % 5 = 0").select("file_id")
    new = visited.select(F.col("file_id").alias("src_file"), F.floor(F.col("file_id") / 3).cast("int").alias("dst_file"))
    return graph.replace_edges(t.includes, visited, new)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS callee, 100000 + l_suppkey AS caller FROM lineitem UNION SELECT DISTINCT 100000 + s_suppkey, 200000 + s_nationkey FROM supplier),
  c(d, f) AS (SELECT 0, 50 UNION SELECT d + 1, e.caller FROM c JOIN e ON e.callee = c.f WHERE d < 3) SELECT CAST(min(d) AS INT) AS depth, CAST(f AS STRING) AS function FROM c GROUP BY f""")
def call_tree(t):
    s = lambda c: c.cast("string")
    calls = t.lineitem.select(s(F.col("l_partkey")).alias("callee"), s(100000 + F.col("l_suppkey")).alias("caller")).distinct()
    calls = calls.union(t.supplier.select(s(100000 + F.col("s_suppkey")), s(200000 + F.col("s_nationkey"))))
    return graph.call_tree(calls, "50", 3)


# --- filters -----------------------------------------------------------------------------------------------


@query("SELECT file_id, line, col FROM symbols WHERE kind IN ('FunctionDecl','CXXMethod','CXXConstructor') AND flags & 2048 <> 0", "symbols")
def kind_filter_definitions(t):
    return t.symbols.where(predicates.kind_filter("function+")).select(*LOC)


@query("SELECT kind, count(*) AS n FROM symbols WHERE kind <> 'ClassDecl' AND NOT (kind LIKE 'CXX%' AND flags & 2048 = 0) GROUP BY kind", "symbols")
def kind_filter_exclude(t):
    return t.symbols.where(predicates.kind_filter("-classdecl,-cxx*-")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT file_id, path FROM files WHERE starts_with(path, '/src/net/') OR path = '/src/core/Supplier#000000000.cpp'", "files")
def path_prefix(t):
    known = frozenset(["/src/core/Supplier#000000000.cpp"])
    return t.files.where(predicates.path_filter(F.col("path"), ["/src/net/", "/src/core/Supplier#000000000.cpp"], known)).select("file_id", "path")


@query("SELECT file_id, path FROM files WHERE regexp_matches(path, '(net|util)/.*[05]\\.cpp$')", "files")
def path_regex(t):
    return t.files.where(predicates.path_filter(F.col("path"), [r"(net|util)/.*[05]\.cpp$"], regex=True)).select("file_id", "path")


@query(", c(node) AS (SELECT 9 UNION SELECT i.src_file FROM c JOIN includes i ON i.dst_file = c.node) SELECT file_id, line, col FROM defs WHERE file_id IN (SELECT node FROM c WHERE node <> 9)", "defs", "includes")
def dependency_filter(t):
    inside = base(t).dependencies(9, "depended-on").select("file_id")
    return t.defs.join(inside, "file_id", "left_semi").select(*LOC)


@query("SELECT path FROM files WHERE contains(path, '00001')", "files")
def find_file(t):
    return base(t).find_file("00001")


@query("SELECT path FROM files WHERE path LIKE '%/Supplier#000000012.cpp'", "files")
def find_file_prefer_exact(t):
    return base(t).find_file("Supplier#000000012.cpp", prefer_exact=True)


@query("SELECT file_id, CASE WHEN path LIKE '%.hpp' THEN 'c++-header' ELSE 'c++' END AS language, path LIKE '/usr/%' AS system FROM files", "files")
def file_language(t):
    return t.files.select("file_id", names.language(F.col("path")).alias("language"), predicates.is_system(F.col("path")).alias("system"))


@query("SELECT file_id FROM files WHERE NOT (contains(path, '/net/') OR regexp_matches(path, '^.*00007.hpp$'))", "files")
def scan_filter(t):
    return t.files.where(~predicates.scan_filter(F.col("path"), ["/net/", "*00007.hpp"])).select("file_id")


# --- scalar functions --------------------------------------------------------------------------------------


@query("SELECT file_id, line, col, path || ':' || line || ':' || col || ':' AS location, CASE WHEN kind IN ('FunctionDecl','CXXMethod','CXXConstructor') THEN split_part(symbol_name, '(', 1) ELSE symbol_name END AS display FROM defs JOIN files USING (file_id)", "defs", "files")
def location_text(t):
    j = t.defs.join(t.files.select("file_id", "path"), "file_id")
    return j.select(*LOC, names.format_location(F.col("path"), F.col("line"), F.col("col")).alias("location"), names.display_name(F.col("symbol_name"), F.col("kind")).alias("display"))


@query("SELECT file_id, line, col, path FROM defs JOIN files USING (file_id)", "defs", "files")
def location_parse(t):
    j = t.defs.join(t.files.select("file_id", "path"), "file_id")
    p = names.parse_location(names.format_location(F.col("path"), F.col("line"), F.col("col")))
    back = names.unpack(names.pack(F.col("file_id"), F.col("line"), F.col("col")))
    return j.select(back.alias("b"), p.alias("p")).select("b.file_id", F.col("p.line").alias("line"), F.col("b.col").alias("col"), "p.path")


@query("SELECT file_id, replace(replace(path, '/', '%2F'), '#', '%23') AS encoded, replace(path, '/src/', '[[SBROOT]]') AS relocated FROM files", "files")
def path_encoding(t):
    return t.files.select("file_id", text.encode_path(F.col("path")).alias("encoded"), text.relocate(F.col("path"), "/src/").alias("relocated"))


@query("SELECT coalesce(max(d), '/') AS root FROM (SELECT unnest(['/src','/src/core','/src/net','/src/util','/usr','/usr/include']) AS d) WHERE NOT EXISTS (SELECT 1 FROM files WHERE NOT starts_with(path, d || '/'))", "files")
def shared_root(t):
    return names.shared_root(t.files).select(F.when(F.col("root") == "", "/").otherwise(F.col("root")).alias("root"))


@query("SELECT p_partkey, '(list (cons ''name \"' || replace(p_name, '\"', '\\\"') || '\"))' AS lisp, replace('<' || p_name || '>&', '&', '&amp;').replace('<', '&lt;').replace('>', '&gt;') AS xml FROM part")
def quoted_text(t):
    lisp = F.concat(F.lit("(list (cons 'name "), text.quote_lisp(F.col("p_name")), F.lit("))"))
    return t.part.select("p_partkey", lisp.alias("lisp"), text.escape_xml(F.concat(F.lit("<"), F.col("p_name"), F.lit(">&"))).alias("xml"))


@query("SELECT DISTINCT file_id, line, col, unnest([symbol_name, split_part(symbol_name, '(', 1), split_part(symbol_name, '::', 2), split_part(split_part(symbol_name, '::', 2), '(', 1)]) AS name FROM defs", "defs")
def name_permutations(t):
    return aggregates.name_index(t.defs).select(*LOC, "name")


# --- aggregates, sets, order -------------------------------------------------------------------------------


@query("SELECT o_custkey AS function, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS stack_cost FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0 GROUP BY o_custkey")
def stack_cost(t):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "VarDecl").otherwise("CallExpr")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("function"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("size"))
    return aggregates.stack_cost(rows)


@query("""SELECT file_id, build_index FROM (SELECT o_custkey AS file_id, o_orderkey AS build_index, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def build_dedupe(t):
    args = F.array(F.lit("-c"), F.col("o_orderpriority"), F.concat(F.lit("-O"), F.col("o_orderstatus")), F.lit("-g"))
    defines = F.array(F.struct(F.lit("NDEBUG").alias("name"), F.col("o_orderstatus").alias("value")))
    s = t.orders.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("build_index"), args.alias("arguments"), defines.alias("defines"))
    return aggregates.distinct_builds(s).select("file_id", "build_index")


@query("""WITH s AS (SELECT DISTINCT user_id % 5 AS unit, CAST(event_id % 3 AS INT) AS file_id, CAST(event_id % 400 AS INT) AS line FROM events)
  SELECT file_id, line FROM s GROUP BY file_id, line HAVING count(DISTINCT unit) = (SELECT count(DISTINCT unit) FROM s x WHERE x.file_id = s.file_id)""")
def skipped_intersection(t):
    s = t.events.select((F.col("user_id") % 5).alias("unit"), (F.col("event_id") % 3).cast("int").alias("file_id"), (F.col("event_id") % 400).cast("int").alias("line"), F.lit(1).alias("col"), F.lit(9).alias("length")).distinct()
    return aggregates.skipped_in_all(s).select("file_id", "line")


@query("""SELECT path, count(*) AS n, string_agg(line || ':' || col || ' ' || severity || ' ' || message, '|' ORDER BY line, col) AS items FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id, line, col ORDER BY diag_id DESC) AS k FROM diagnostics) d JOIN files USING (file_id) WHERE k = 1 AND severity <> 'skipped' GROUP BY path""", "diagnostics", "files")
def diagnostics_by_file(t):
    d = base(t).diagnose()
    item = F.transform("items", lambda i: F.format_string("%d:%d %s %s", i["line"], i["col"], i["severity"], i["message"]))
    return d.select("path", F.size("items").cast("long").alias("n"), F.array_join(item, "|").alias("items"))


@query("""SELECT path, '<file name="' || path || '">' || string_agg('<error line="' || line || '" column="' || col || '" severity="' || severity || '" message="' || message || '"/>', '' ORDER BY line, col) || '</file>' AS xml FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id, line, col ORDER BY diag_id DESC) AS k FROM diagnostics) d JOIN files USING (file_id) WHERE k = 1 GROUP BY path""", "diagnostics", "files")
def diagnostics_xml(t):
    return report.diagnostics_xml(base(t).diagnose(skipped=True)).select(F.regexp_extract("xml", '<file name="([^"]*)"', 1).alias("path"), "xml")


@query("SELECT file_id, line, col, CAST(json_object('file_id', file_id, 'line', line, 'col', col, 'symbol_name', symbol_name, 'usr', usr, 'kind', kind, 'flags', flags) AS VARCHAR) AS json FROM defs", "defs")
def symbol_json(t):
    return report.symbol_json(t.defs.select(*LOC, "symbol_name", "usr", "kind", "flags"))


@query("""SELECT 'symbols' AS "table", line || ':' || col AS key, CAST(json_object('symbol_name', symbol_name, 'usr', usr, 'kind', kind, 'flags', flags, 'symbol_length', symbol_length, 'start_line', start_line, 'start_col', start_col, 'end_line', end_line, 'end_col', end_col, 'base_classes', CASE WHEN base IS NULL THEN [] ELSE [base] END) AS VARCHAR) AS value FROM symbols WHERE file_id = 7
  UNION ALL SELECT 'symbol_names', line || ':' || col, CAST(json_object('name', name) AS VARCHAR) FROM symbol_names WHERE file_id = 7
  UNION ALL SELECT 'usrs', line || ':' || col, CAST(json_object('usr', usr) AS VARCHAR) FROM usrs WHERE file_id = 7 UNION ALL SELECT 'targets', line || ':' || col, CAST(json_object('usr', usr) AS VARCHAR) FROM targets WHERE file_id = 7""", "symbols", "symbol_names", "usrs", "targets")
def dump_file(t):
    return base(t).dump_file(7)


@query("SELECT file_id, CASE WHEN kind = 'ClassDecl' THEN 'Classes' WHEN kind IN ('FunctionDecl','CXXMethod','CXXConstructor') THEN 'Functions' ELSE 'Variables' END AS category, count(*) AS symbols FROM defs GROUP BY 1, 2", "defs")
def taglist(t):
    return base(t).taglist()


@query("""SELECT file_id, priority, CAST(row_number() OVER (ORDER BY priority DESC, file_id) AS INT) AS position FROM (SELECT file_id,
    CAST(CASE WHEN file_id % 11 = 0 THEN 4 WHEN file_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN file_id % 13 = 0 THEN 8 WHEN file_id % 7 = 0 THEN 3 WHEN file_id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN NOT is_system THEN 1 ELSE 0 END AS INT) AS priority FROM files)""", "files")
def priority_order(t):
    m = lambda n: F.col("file_id") % n == 0
    p = rank.job_priority(m(2), m(11), F.when(m(13), "active").when(m(7), "open"), m(5), ~F.col("is_system"))
    return report.numbered(t.files.select("file_id", p.alias("priority")), [F.desc("priority"), F.col("file_id")])


@query("SELECT l_partkey AS header, min(l_orderkey) AS job FROM lineitem GROUP BY 1")
def header_claim(t):
    return xref.owner(t.lineitem.select(F.col("l_partkey").alias("header"), F.col("l_orderkey").alias("job")).distinct(), "header", "job")


@query("""SELECT name, priority, score, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (ORDER BY score, priority, name) AS position FROM (
    SELECT DISTINCT p_name AS name, p_size AS priority, CASE WHEN starts_with(lower(p_name), 're') THEN 0 ELSE 1 END AS score FROM part WHERE regexp_matches(lower(p_name), 'r.*e'))) WHERE position <= 50""")
def completion_rank(t):
    c = t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("priority")).distinct()
    return report.numbered(rank.completions(c, "re", 50), [F.col("score"), F.col("priority"), F.col("name")]).select("name", "priority", "score", "position")


@query("SELECT substr(path, 6) AS name FROM files WHERE is_header AND starts_with(path, '/src/')", "files")
def include_completions(t):
    return base(t).complete_includes(["/src"], 1)


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), w AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1)
  SELECT coalesce(o.k, w.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN w ON o.k = w.k WHERE o.k IS NULL OR w.k IS NULL OR o.n <> w.n""")
def db_diff(t):
    part = lambda m: t.orders.where(f"o_orderkey % {m} <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return sets.build_diff(part(3), part(4), ["k"], ["n"])


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0) OR c_nationkey = 24")
def set_operations(t):
    key = lambda df, c: df.select(F.col(c).alias("k"))
    c, s = key(t.customer, "c_nationkey").distinct(), key(t.supplier.where("s_nationkey % 3 = 0"), "s_nationkey")
    return sets.union_distinct(sets.difference(c, s, ["k"]), sets.intersection(c, c.where("k = 24"), ["k"]), ["k"])


@query("SELECT usr, CAST(list_sort(list(DISTINCT file_id * 1000000 + line * 1000 + col))[1] AS BIGINT) AS first, count(*) AS n FROM (SELECT DISTINCT * FROM targets) GROUP BY usr", "targets")
def inverted_index(t):
    g = aggregates.grouped_index(aggregates.inverted_index(t.targets, "usr"), "usr")
    first = F.get("locations", F.lit(0))
    return g.select("usr", (first["file_id"].cast("long") * 1000000 + first["line"] * 1000 + first["col"]).alias("first"), F.size("locations").cast("long").alias("n"))


# --- incremental -------------------------------------------------------------------------------------------


@query(", c(node) AS (SELECT file_id FROM files WHERE file_id % 20 = 3 UNION SELECT i.src_file FROM c JOIN includes i ON i.dst_file = c.node) SELECT node AS file_id FROM c", "files", "includes")
def dirty_sources(t):
    return incremental.simple_dirty(t.includes, t.files.where("file_id % 20 = 3").select("file_id"))


@query(", c(seed, node) AS (SELECT file_id, file_id FROM files WHERE NOT is_header UNION SELECT c.seed, i.dst_file FROM c JOIN includes i ON i.src_file = c.node) SELECT c.seed AS file_id FROM c LEFT JOIN files f ON f.file_id = c.node JOIN files s ON s.file_id = c.seed GROUP BY c.seed, s.parsed_ms HAVING max(f.mtime_ms) > s.parsed_ms OR bool_or(f.file_id IS NULL)", "files", "includes")
def modified_sources(t):
    return incremental.modified_dirty(t.includes, t.files, t.files.where("not is_header").select("file_id"))


@query("SELECT diag_id, file_id, severity FROM diagnostics WHERE file_id % 4 <> 1 UNION ALL SELECT -diag_id, file_id, severity FROM diagnostics WHERE file_id % 4 = 1 AND severity = 'error'", "diagnostics")
def incremental_replace(t):
    old = t.diagnostics.select("diag_id", "file_id", "severity")
    visited = old.where("file_id % 4 = 1").select("file_id").distinct()
    delta = old.where("file_id % 4 = 1 and severity = 'error'").withColumn("diag_id", -F.col("diag_id"))
    return incremental.replace_by_key(old, delta, ["file_id"], visited)


@query("SELECT user_id AS source, max(event_id) AS seq FROM events GROUP BY user_id")
def last_request(t):
    return incremental.last_request(t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), "event_type")).select("source", "seq")


@query("SELECT file_id FROM files WHERE NOT is_system", "files")
def suspended_jobs(t):
    return incremental.not_suspended(t.files.select("file_id"), t.files.where("is_system")).select("file_id")


# --- builds ------------------------------------------------------------------------------------------------


@query("""SELECT '/w/' || p_name || '.cc' AS path, 'g++' AS compiler, 'c++' AS language, '/w/' || p_brand AS include, 'SIZE=' || p_size AS define, '-Wall' AS argument FROM part WHERE p_name NOT LIKE '% %'
  UNION ALL SELECT '/w/' || replace(p_name, ' ', '_') || '.cc', 'g++', 'c++', '/w/' || p_brand, 'SIZE=' || p_size, '-Wall' FROM part WHERE p_name LIKE '% %'""")
def parse_commands(t):
    c = t.part.select(F.lit("/w").alias("directory"), F.format_string("g++ -DSIZE=%d -I '%s' -Wall -o x.o -c %s.cc", "p_size", "p_brand", F.translate("p_name", " ", "_")).alias("command"))
    return commandline.parse_commands(c).select(
        "path", "compiler", "language", F.col("includes")[0]["path"].alias("include"), F.concat_ws("=", F.col("defines")[0]["name"], F.col("defines")[0]["value"]).alias("define"), F.element_at(F.filter("arguments", lambda a: a.startswith("-W")), 1).alias("argument")
    )


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '-c' ELSE '-c,-Wall' END AS args FROM part")
def blocked_arguments(t):
    a = F.when(F.col("p_partkey") % 3 == 0, F.array(*map(F.lit, ["-c", "-o", "x", "-pipe"]))).otherwise(F.array(*map(F.lit, ["-c", "-pipe", "-Wall", "-o", "y"])))
    return t.part.select("p_partkey", F.array_join(commandline.blocked_removed(a, ["-o=", "-pipe"]), ",").alias("args"))


@query("SELECT path, CASE WHEN contains(path, '/net/') THEN 'net' WHEN starts_with(path, '/src/') THEN 'src' ELSE 'top' END AS value FROM files", "files")
def nearest_config(t):
    rows = t.spark.createDataFrame([("", "k", "top"), ("/src", "k", "src"), ("/src/net", "k", "net")], "dir string, key string, value string")
    return readers.nearest_config(t.files.select("path"), rows).select("path", "value")


@query("SELECT path, CASE WHEN contains(path, '/util/') THEN '/src/util' WHEN starts_with(path, '/src/') THEN '/src' ELSE '/usr' END AS root FROM files", "files")
def project_root(t):
    rows = t.spark.createDataFrame([("/src", 2, False, False), ("/src/net", 2, False, False), ("/src/util", 5, True, False), ("/usr", 3, False, False), ("/usr/include", 3, False, False)], "dir string, priority int, authoritative boolean, shallow boolean")
    return readers.project_root(t.files.select("path"), rows)


from lodestar.plans import command_queries  # noqa: E402, F401  (registers its own)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for n, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
