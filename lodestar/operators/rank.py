"""Orders, ranks and limits. Ordered results carry their position as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.schema import LOC, is_definition, rank_by


def sort_rank(kind: F.Column | None = None, flags: F.Column | None = None) -> F.Column:
    """Rank of a result: by kind, and 100 more for a definition."""
    return rank_by(0, kind) + F.when(is_definition(flags), 100).otherwise(0)


def target_rank(kind: F.Column | None = None) -> F.Column:
    return rank_by(1, kind, default=2)


def _loc(descending: bool) -> list[F.Column]:
    return [F.desc(c) if descending else F.asc(c) for c in LOC]


def ordered(symbols: DataFrame, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """By rank, best first, then location; ``reverse`` turns the location only. Bounded by ``limit`` where given."""
    return symbols.orderBy(sort_rank().desc(), *_loc(reverse)) if limit is None else symbols.orderBy(sort_rank().desc(), *_loc(reverse)).limit(limit)


def ordered_targets(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy(target_rank().desc(), is_definition().desc(), *_loc(False))


def best_target(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One target a key: the highest rank, then a definition, then the first location. A partial aggregate, no window."""
    neg = F.struct(*[(-F.col(c)).alias(f"n{c}") for c in LOC])
    by = F.struct(target_rank().alias("r"), is_definition().alias("d"), neg.alias("l"))
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), by).alias("_b")).select(*keys, "_b.*")


def rotated(rows: DataFrame, keys: list[str], start: list[str]) -> DataFrame:
    """Adds ``position``: per key, rows by location, but those after the key's own location (columns ``start``) first, the rest behind them."""
    later = F.struct(*LOC) > F.struct(*[F.col(s).alias(c) for s, c in zip(start, LOC, strict=True)])
    w = Window.partitionBy(*keys).orderBy(F.when(later, 0).otherwise(1), *LOC)
    return rows.withColumn("position", F.row_number().over(w))


def prefer_exact(rows: DataFrame, path: str, pattern: str, keys: list[str] | None = None) -> DataFrame:
    """Only exact matches once there is one: exact is the whole path or its end after a slash."""
    exact = (F.col(path) == pattern) | F.col(path).endswith("/" + pattern.lstrip("/"))
    hits = rows.where(F.col(path).contains(pattern)).withColumn("_exact", exact)
    if keys:
        w = Window.partitionBy(*keys)
        return hits.withColumn("_any", F.max("_exact").over(w)).where("_exact or not _any").drop("_exact", "_any")
    any_ = hits.agg(F.coalesce(F.max("_exact"), F.lit(False)).alias("_any"))
    return hits.join(F.broadcast(any_)).where("_exact or not _any").drop("_exact", "_any")  # one row


def drop_shadowed(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Alternatives by length, shortest first; one that starts with a shorter one of its key is dropped. Adds ``position``, with equal ones by the other columns."""
    short = rows.select(*keys, F.col(text).alias("_short")).distinct()
    shadowed = rows.join(short, keys).where(F.col(text).startswith(F.col("_short")) & (F.length(text) > F.length("_short"))).select(*keys, text)
    w = Window.partitionBy(*keys).orderBy(F.length(text), text, *[c for c in rows.columns if c not in (*keys, text)])
    return rows.join(shadowed, [*keys, text], "left_anti").withColumn("position", F.row_number().over(w))


def completions(rows: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Candidates (name, priority) that hold the prefix as a subsequence: prefix matches first, then priority, then name."""
    letters = ".*".join(f"\\Q{c}\\E" for c in prefix)
    hit = rows.where(F.col("name").rlike("(?i)" + letters)) if prefix else rows
    score = F.when(F.lower("name").startswith(prefix.lower()), 0).otherwise(1)
    return hit.withColumn("score", score).orderBy("score", "priority", "name").limit(limit)


def job_priority(dirty: F.Column, reindex: F.Column, state: F.Column, includes_open: F.Column, current: F.Column) -> F.Column:
    """Priority of an indexing job: what changed, what is being edited, which project is current."""
    n = lambda c, v: F.when(c, v).otherwise(0)
    edited = F.when(state == "active", 8).when(state == "open", 3).when(includes_open, 2).otherwise(0)
    return F.when(reindex, 4).otherwise(n(dirty, 1)) + edited + n(current, 1)


def project_choice(projects: DataFrame, multi: bool = False) -> DataFrame:
    """Projects (project_id, match, is_current) by match (0 no, 1 yes, 2 indexed), the current one first; only the best unless ``multi``."""
    hits = projects.where("match > 0").orderBy(F.desc("match"), F.desc("is_current"), "project_id")
    return hits if multi else hits.limit(1)
