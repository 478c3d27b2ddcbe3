"""Position lookups: floor (as-of), ranges and enclosing intervals, each for a whole table of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.schema import LOC, is_definition


def floor_lookup(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each probe (file_id, line, col, and any other columns) with the symbol that covers it, as struct ``symbol`` (null if none).

    A symbol covers its own position and symbol_length columns on its line; of several the last one counts.
    One shuffle by (file_id, line): a window carries the last symbol forward, so there is no range join.
    """
    keep = [c for c in symbols.columns if c not in LOC]
    carried = F.struct(*[F.col(c) for c in probes.columns])
    p = probes.select(*LOC, carried.alias("_probe"), F.lit(1).alias("_p"))
    s = symbols.select(*LOC, F.struct(*LOC, *keep).alias("symbol"), F.lit(None).cast(p.schema["_probe"].dataType).alias("_probe"), F.lit(0).alias("_p"))
    p = p.select(*LOC, F.lit(None).cast(s.schema["symbol"].dataType).alias("symbol"), "_probe", "_p")
    w = Window.partitionBy("file_id", "line").orderBy("col", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = s.union(p).withColumn("symbol", F.last("symbol", ignorenulls=True).over(w)).where("_p = 1")
    width = F.greatest(F.col("symbol.symbol_length"), F.lit(1))
    return found.select("_probe.*", F.when(F.col("col") - F.col("symbol.col") < width, F.col("symbol")).alias("symbol"))


def find_symbol(symbols: DataFrame, file_id: int, line: int, col: int) -> DataFrame:
    """The one symbol that covers a position: filters reach the scan, then the greatest column."""
    near = symbols.where((F.col("file_id") == file_id) & (F.col("line") == line) & (F.col("col") <= col)).orderBy(F.desc("col")).limit(1)
    return near.where(F.lit(col) - F.col("col") < F.greatest("symbol_length", F.lit(1)))


def symbols_between(symbols: DataFrame, file_id: int, start: tuple[int, int], end: tuple[int, int | None]) -> DataFrame:
    """Symbols of a file from start to end, both (line, col) and inclusive; an end without a column is its whole line, however long."""
    at = F.struct("line", "col")
    lit = lambda p: F.struct(F.lit(p[0]).alias("line"), F.lit(p[1]).alias("col"))
    rows = symbols.where((F.col("file_id") == file_id) & F.col("line").between(start[0], end[0]) & (at >= lit(start)))
    return rows if end[1] is None else rows.where(at <= lit(end))


def tokens_between(tokens: DataFrame, file_id: int, begin: int, end: int) -> DataFrame:
    """Tokens of a file that touch byte offsets begin..end: the one before counts if it reaches begin; none if begin is past the last start."""
    mine = tokens.where(F.col("file_id") == file_id)
    last = mine.agg(F.max("offset").alias("_last"))
    return mine.where((F.col("offset") + F.col("length") >= begin) & (F.col("offset") <= end)).join(F.broadcast(last), F.col("_last") >= begin).drop("_last")  # one row


def token_symbols(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every token with the symbol that covers it, or null: the floor lookup carries the token along."""
    return floor_lookup(tokens, symbols)


def destructor_fix(symbols: DataFrame) -> DataFrame:
    """Adds ``lookup_col``: a type or template reference directly behind a member reference to ~X stands for the latter."""
    w = Window.partitionBy("file_id", "line").orderBy("col")
    before = lambda c: F.lag(c).over(w)
    hit = F.col("kind").isin("TypeRef", "TemplateRef") & (before("kind") == "MemberRefExpr") & (before("col") == F.col("col") - 1) & before("symbol_name").contains("~")
    return symbols.withColumn("lookup_col", F.when(hit, before("col")).otherwise(F.col("col")))


def _level(length: F.Column) -> F.Column:
    """The least power of two, as exponent, that a length fits in."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def enclosing(probes: DataFrame, intervals: DataFrame, group: list[str], at: str, start: str, end: str, innermost: list[str], keep: list[str]) -> DataFrame:
    """Each probe with its innermost interval: start <= at <= end in the same group, the greatest by ``innermost``.

    An equality join: an interval is filed under the one or two blocks, of the least power of two at least its length,
    that it overlaps; a probe looks into one block of each length that occurs. Lengths that occur are at most 64.
    Both sides are shuffled: Spark reckons exploded rows by the size of the file they come from, and would broadcast them.
    """
    intervals = intervals.where(F.col(start) <= F.col(end))
    i = intervals.withColumn("_level", _level(F.col(end) - F.col(start) + 1))
    size = F.pow(F.lit(2.0), F.col("_level")).cast("long")
    block = lambda c: F.floor(F.col(c) / size)
    i = i.withColumn("_block", F.explode(F.array_distinct(F.array(block(start), block(end)))))
    levels = [r[0] for r in intervals.select(_level(F.col(end) - F.col(start) + 1)).distinct().collect()]
    p = probes.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]))) if levels else probes.withColumn("_level", F.lit(0))
    p = p.withColumn("_block", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_level")).cast("long")))
    right = i.select(*[F.col(g).alias(f"_g{n}") for n, g in enumerate(group)], F.col("_level").alias("_l"), F.col("_block").alias("_b"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*innermost).alias("_by"), F.struct(*keep).alias("_kept"))
    on = (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_b")) & (F.col("_s") <= F.col(at)) & (F.col(at) <= F.col("_e"))
    for n, g in enumerate(group):
        on = on & (p[g] == F.col(f"_g{n}"))
    best = p.join(right.hint("merge"), on).groupBy(*probes.columns).agg(F.max_by("_kept", "_by").alias("_kept"))
    return best.select(*probes.columns, *[F.col(f"_kept.{k}").alias(f"enclosing_{k}") for k in keep])


def enclosing_container(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each probe (file_id, line, col, ...) in a function, class or other container's definition: the innermost, as enclosing_*.

    The container must start at or before the probe and lie before it in the file.
    """
    from lodestar.schema import in_category

    c = symbols.where(in_category("container") & is_definition())
    pos = lambda line, col: F.col(line).cast("long") * (1 << 21) + F.col(col)
    c = c.withColumn("_start", F.greatest(pos("start_line", "start_col"), pos("line", "col"))).withColumn("_end", pos("end_line", "end_col"))
    p = probes.withColumn("_at", pos("line", "col"))
    out = enclosing(p, c.where("_start <= _end"), ["file_id"], "_at", "_start", "_end", ["line", "col"], ["line", "col", "symbol_name", "usr", "kind"])
    return out.drop("_at")


def argument_index(probes: DataFrame, arguments: DataFrame) -> DataFrame:
    """Symbols inside a call's arguments get the argument's index: from its position up to that of the next one; of several the last to start, then the greatest index.

    probes: (probe_id, file_id, line, col); arguments: (call_id, index, file_id, line, col, end_line, end_col).
    """
    w = Window.partitionBy("call_id").orderBy("index")
    pos = lambda line, col: F.col(line).cast("long") * (1 << 21) + F.col(col)
    a = arguments.withColumn("_start", pos("line", "col"))
    a = a.withColumn("_stop", F.coalesce(F.lead("_start").over(w) - 1, pos("end_line", "end_col")))
    p = probes.withColumn("_at", pos("line", "col"))
    return enclosing(p, a, ["file_id"], "_at", "_start", "_stop", ["_start", "index"], ["call_id", "index"]).drop("_at")
