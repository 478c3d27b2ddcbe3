"""The state around an index: projects, editor buffers, suspended files, jobs, and the commands that read and change them.

State is kept in small tables (schemas below). A command that changes one returns the new table; its message is a string, its listing a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import predicates as P
from lodestar.operators import report
from lodestar.streaming import incremental

STATE: dict[str, str] = {
    "projects": "project_id INT, root STRING, database STRING, is_current BOOLEAN, last_idle_ms BIGINT",
    "buffers": "file_id INT, state STRING",
    "suspended": "project_id INT, file_id INT",
    "jobs": "job_id BIGINT, project_id INT, file_id INT, state STRING, elapsed_ms BIGINT",
}


# projects ------------------------------------------------------------------------------------------------


def listed_projects(projects: DataFrame) -> DataFrame:
    """(index, project_id, text): projects with a compile database first, then by root; the current one is marked."""
    order = [F.col("database").isNull(), F.col("root"), F.col("project_id")]
    rows = report.numbered(projects, order).withColumn("index", F.col("position") - 1)
    mark = F.when(F.col("is_current"), " <=").otherwise("")
    return rows.select("index", "project_id", F.concat(F.col("index").cast("string"), F.lit(": "), F.col("root"), mark).alias("text"))


def matching_projects(projects: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Projects a query names: one root as it is, else an index of the listing, else all roots that match."""
    exact = projects.where(F.col("root") == query)
    if not exact.isEmpty():
        return exact
    if query.isdigit():
        return projects.join(listed_projects(projects).where(F.col("index") == int(query)).select("project_id"), "project_id", "left_semi")
    return projects.where(P.matches(F.col("root"), query, regex))


def select_project(projects: DataFrame, query: str, regex: bool = False) -> tuple[DataFrame, str]:
    """Makes the one project that a query names the current one; of several or none the message tells."""
    found = matching_projects(projects, query, regex).orderBy("root").limit(20).collect()  # a message names no more
    if not found:
        return projects, f"No matches for {query}"
    if len(found) > 1:
        return projects, "\n".join([f"Multiple matches for {query}", *[r["root"] for r in found]])
    if found[0]["is_current"]:
        return projects, f"{found[0]['root']} is already the active project"
    return projects.withColumn("is_current", F.col("project_id") == found[0]["project_id"]), f"Selected project: {found[0]['root']} for {query}"


def delete_projects(projects: DataFrame, query: str | None = None, regex: bool = False) -> DataFrame:
    """Projects without those that a query names; without all of them if there is no query."""
    return projects.limit(0) if query is None else projects.join(matching_projects(projects, query, regex).select("project_id"), "project_id", "left_anti")


def drop_facts(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Fact tables without the rows of deleted projects; tables without a project_id stay as they are."""
    return {n: t.join(project_ids.select("project_id"), "project_id", "left_anti") if "project_id" in t.columns else t for n, t in tables.items()}


# buffers -------------------------------------------------------------------------------------------------


def set_buffers(buffers: DataFrame, changes: DataFrame, mode: str = "set") -> DataFrame:
    """Buffers after ``set`` (these only), ``add`` (these replace their files' rows) or ``remove``: changes (file_id, state)."""
    if mode == "set":
        return changes.select("file_id", "state")
    rest = buffers.join(changes.select("file_id"), "file_id", "left_anti").select("file_id", "state")
    if mode == "add":
        return rest.unionByName(changes.select("file_id", "state"))
    if mode == "remove":
        return rest
    raise ValueError(f"unknown mode {mode}")


def buffers_message(old: DataFrame, new: DataFrame) -> str:
    a, b = old.count(), new.count()
    return f"Added {b - a} buffers" if b > a else f"Removed {a - b} buffers" if a > b else f"We still have {a} buffers"


def listed_buffers(buffers: DataFrame, files: DataFrame) -> DataFrame:
    return buffers.join(files.select("file_id", "path"), "file_id").select("file_id", F.concat_ws(": ", "path", "state").alias("text"))


# suspension ----------------------------------------------------------------------------------------------


def suspend(suspended: DataFrame, targets: DataFrame, mode: str) -> DataFrame:
    """Suspended files (project_id, file_id) after ``on``, ``off`` or ``toggle`` for the targets (project_id, file_id).

    A whole project is suspended, or cleared, by targets that name all of its files.
    """
    keys = ["project_id", "file_id"]
    named = targets.select(*keys).distinct()
    rest = suspended.select(*keys).join(named, keys, "left_anti")
    if mode == "on":
        return rest.unionByName(named)
    if mode == "off":
        return rest
    if mode == "toggle":
        return rest.unionByName(named.join(suspended.select(*keys), keys, "left_anti"))
    raise ValueError(f"unknown mode {mode}")


def listed_suspended(suspended: DataFrame, files: DataFrame) -> DataFrame:
    return suspended.join(files.select("file_id", "path"), "file_id").select("project_id", "file_id", F.concat(F.col("path"), F.lit(" is suspended")).alias("text"))


# indexing ------------------------------------------------------------------------------------------------


def reindex(files: DataFrame, pattern: str = "", regex: bool = False) -> DataFrame:
    """Sources to be indexed again whatever their age: those whose path matches."""
    hit = files.where(~F.col("is_header"))
    return (hit.where(P.matches(F.col("path"), pattern, regex)) if pattern else hit).select("file_id")


def check_reindex(includes: DataFrame, files: DataFrame, pattern: str = "", regex: bool = False) -> DataFrame:
    """Of these only the sources of which something is newer than their last parse."""
    return incremental.modified_dirty(includes, files, reindex(files, pattern, regex))


def reindex_message(dirty: DataFrame) -> str:
    n = dirty.count()
    return f"Dirtied {n} files" if n else "No matches"


def validate(files: DataFrame, present: DataFrame, tables: list[str]) -> DataFrame:
    """Parsed files (file_id) that lack one of the tables; present: (file_id, table)."""
    expected = files.where("parsed_ms > 0").select("file_id", F.explode(F.array(*[F.lit(t) for t in tables])).alias("table"))
    return incremental.invalid_files(expected, present)


def is_indexing(jobs: DataFrame) -> DataFrame:
    """One row (indexing): 1 while any job is pending or running, else 0."""
    return jobs.agg(F.coalesce(F.max(F.col("state").isin("pending", "running").cast("int")), F.lit(0)).alias("indexing"))


def last_indexed(projects: DataFrame) -> DataFrame:
    """(project_id, last_idle_ms) of each project."""
    return projects.select("project_id", "last_idle_ms")


def indexed_states(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, state) of paths: unknown, managed (seen, not parsed) or indexed."""
    known = paths.select("path").distinct().join(files.select("path", "parsed_ms"), "path", "left_outer")
    seen = files.select("path", F.lit(True).alias("_seen")).distinct()
    state = F.when(F.col("_seen").isNull(), "unknown").when(F.coalesce("parsed_ms", F.lit(0)) != 0, "indexed").otherwise("managed")
    return known.join(seen, "path", "left").select("path", state.alias("state"))


class JobCount:
    """How many jobs run at once: a number, ``default``, ``push:n`` and ``pop``; 1 to 512."""

    most = 512

    def __init__(self, default: int):
        self.default = self.now = default
        self.stack: list[int] = []

    def command(self, query: str = "") -> str:
        if not query:
            return f"Running with {self.now} jobs"
        if query == "pop":
            if not self.stack:
                return "Job count stack is empty"
            self.now = self.stack.pop()
            return f"Changed jobs to {self.now}"
        number = str(self.default) if query == "default" else query.removeprefix("push:")
        if not number.isdigit() or not 0 <= int(number) <= self.most:
            return f"Invalid job count {query}"
        if query.startswith("push:"):
            self.stack.append(self.now)
        self.now = int(number)
        return f"Changed jobs to {self.now}"


class DebugLocations:
    """Which locations are logged in detail: ``clear``, ``all`` or one more."""

    def __init__(self) -> None:
        self.kept: list[str] = []

    def command(self, query: str = "") -> str:
        if query in ("clear", "none"):
            self.kept = []
        elif query in ("all", "*"):
            self.kept = ["all"]
        elif query:
            self.kept.append(query)
        return "\n".join(["Debug locations:", *self.kept]) if self.kept else "No debug locations"

    def selected(self, rows: DataFrame, text: str = "location") -> DataFrame:
        """Rows whose location is logged."""
        if "all" in self.kept:
            return rows
        return rows.where(P.any_of([F.col(text).startswith(k) for k in self.kept]))
