"""Aggregations: inverted indexes, capped counts, sums, best of group, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.commandline import normalised_arguments, normalised_defines
from lodestar.functions.names import name_permutations
from lodestar.schema import LOC, in_category


def inverted_index(symbols: DataFrame, key: str) -> DataFrame:
    """(key, location) rows, unique; kept exploded, so that a name with very many locations never is one row."""
    return symbols.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key, *LOC).distinct()


def name_index(symbols: DataFrame) -> DataFrame:
    """(name, location) with every permutation of the names."""
    return symbols.select(F.explode(name_permutations("symbol_name")).alias("name"), *LOC).distinct()


def grouped_index(index: DataFrame, key: str) -> DataFrame:
    """(key, locations sorted): for export of keys of bounded size."""
    return index.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*LOC))).alias("locations"))


def invert_targets(targets_by_location: DataFrame) -> DataFrame:
    """(usr, location) from rows of a location with an array of usrs."""
    return targets_by_location.select(F.explode("usrs").alias("usr"), *LOC).distinct()


def capped_callers(functions: DataFrame, calls: DataFrame, cap: int = 2) -> DataFrame:
    """(usr, callers): number of calling locations, counted no further than ``cap``; functions without any count 0."""
    n = calls.groupBy("usr").agg(F.count("*").alias("n"))
    return functions.select("usr").distinct().join(n, "usr", "left").select("usr", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("int").alias("callers"))


def stack_cost(locals_in: DataFrame) -> DataFrame:
    """Sum of the sizes of the variables in each function: rows (function, kind, size)."""
    return locals_in.where(F.col("kind") == "VarDecl").groupBy("function").agg(F.sum(F.col("size").cast("long")).alias("stack_cost"))


def skipped_in_all(skipped: DataFrame) -> DataFrame:
    """Skipped ranges (unit, file_id, line, col, length) that every unit of their file skips."""
    units = skipped.groupBy("file_id").agg(F.count_distinct("unit").alias("units"))
    same = skipped.groupBy(*LOC, "length").agg(F.count_distinct("unit").alias("n"))
    return same.join(units, "file_id").where("n = units").select(*LOC, "length")


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs, total and average milliseconds by project."""
    return jobs.groupBy("project_id").agg(F.count("*").alias("jobs"), F.sum("elapsed_ms").alias("total_ms"), F.avg("elapsed_ms").alias("average_ms"))


def include_hash(includes: F.Column) -> F.Column:
    """A hash of an include list that depends on its order."""
    return F.xxhash64(F.transform(includes, lambda i: F.concat_ws(" ", i["type"], i["path"])))


def distinct_builds(sources: DataFrame) -> DataFrame:
    """One build of a file for each set of arguments and defines that tells builds apart; the least index stays."""
    keyed = sources.withColumn("_a", normalised_arguments(F.col("arguments"))).withColumn("_d", F.transform(normalised_defines(F.col("defines")), lambda d: F.concat_ws("=", d["name"], d["value"])))
    cols = sources.columns
    return keyed.groupBy("file_id", "_a", "_d").agg(F.min_by(F.struct(*cols), "build_index").alias("s")).select("s.*")


def category(kind: F.Column) -> F.Column:
    """The heading a symbol is listed under."""
    return F.when(in_category("class", kind), "Classes").when(in_category("function", kind), "Functions").when(kind.isin("VarDecl", "FieldDecl", "ParmDecl"), "Variables").when(kind.isin("EnumDecl", "EnumConstantDecl"), "Enums").when(in_category("preprocessing", kind), "Macros").otherwise("Other")


def taglist(symbols: DataFrame) -> DataFrame:
    """(file_id, category, symbols): a file's definitions counted by heading."""
    return symbols.groupBy("file_id", category(F.col("kind")).alias("category")).agg(F.count("*").alias("symbols"))
