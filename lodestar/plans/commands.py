"""The commands of the engine over one or more projects' fact tables. Each returns a DataFrame; text and JSON are a separate last step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import predicates as P
from lodestar.functions.names import strip_parentheses
from lodestar.functions.text import relative
from lodestar.operators import aggregates, graph, lookup, rank, report, xref
from lodestar.schema import LOC, in_category, is_definition, kinds


class CodeBase:
    """Fact tables by name (see ``lodestar.schema.TABLES``); tables a command does not need may be missing."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], root: str = ""):
        self.spark, self.t, self.root = spark, tables, root

    def __getitem__(self, name: str) -> DataFrame:
        return self.t[name]

    @property
    def edges(self) -> DataFrame:
        return self["includes"].select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))

    def _filtered(self, rows: DataFrame, path_filters: list[str] | None, kind_filter: str | None, lines: tuple[int, int] | None, regex: bool, skip_system: bool) -> DataFrame:
        """Path filters OR-ed, AND-ed with kind, line range and the system filter; a single known file becomes an equality on file_id."""
        if kind_filter:
            rows = rows.where(P.kind_filter(kind_filter))
        if lines:
            rows = rows.where(P.line_range(*lines))
        if path_filters or skip_system:
            f = self["files"]
            if path_filters:
                known = frozenset(r["path"] for r in f.where(F.col("path").isin(path_filters)).select("path").collect())  # at most as many as filters
                f = f.where(P.path_filter(F.col("path"), path_filters, known, regex))
            if skip_system:
                f = f.where(~F.col("is_system"))
            rows = rows.join(f.select("file_id"), "file_id", "left_semi")
        return rows

    # names -----------------------------------------------------------------------------------------------

    def find_symbols(self, pattern: str = "", *, regex: bool = False, wildcards: bool = False, ignore_case: bool = False, declarations_only: bool = False, definitions_only: bool = False,
                     path_filters: list[str] | None = None, kind_filter: str | None = None, lines: tuple[int, int] | None = None, reverse: bool = False, skip_system: bool = False, limit: int | None = None) -> DataFrame:
        """Symbols by name, best rank first: prefix with the overload rule, wildcard, regular expression; '' finds every name."""
        hit = P.name_search(F.col("name"), pattern, regex=regex, wildcards=wildcards, ignore_case=ignore_case, exact_overload=not (regex or wildcards))
        places = self["symbol_names"].where(hit).select(*LOC).distinct()
        rows = places.join(self["symbols"], LOC)
        if definitions_only:
            rows = rows.where(is_definition())
        if declarations_only:
            rows = rows.where(~is_definition())
        return rank.ordered(self._filtered(rows, path_filters, kind_filter, lines, False, skip_system), reverse, limit)

    def list_symbols(self, pattern: str = "", *, wildcards: bool = False, ignore_case: bool = False, strip: bool = False, files: list[str] | None = None, reverse: bool = False) -> DataFrame:
        """Distinct names: by prefix over all, or by substring of the symbols of some files."""
        if wildcards and any(c in pattern for c in "*?") and not pattern.endswith("*"):
            pattern += "*"
        if files:
            f = self["files"].where(F.col("path").isin(files)).select("file_id")
            names = self["symbols"].join(F.broadcast(f), "file_id", "left_semi").select(F.col("symbol_name").alias("name")).where(P.matches(F.col("name"), pattern, False, ignore_case))  # as many as files are named
        else:
            names = self["symbol_names"].where(P.name_search(F.col("name"), pattern, wildcards=wildcards, ignore_case=ignore_case)).select("name")
        if strip:
            names = names.select(strip_parentheses(F.col("name")).alias("name"))
        return names.where("name <> ''").distinct().orderBy(F.desc("name") if reverse else F.asc("name"))

    # positions -------------------------------------------------------------------------------------------

    def symbol_at(self, file_id: int, line: int, col: int) -> DataFrame:
        return lookup.find_symbol(lookup.destructor_fix(self["symbols"].where((F.col("file_id") == file_id) & (F.col("line") == line))), file_id, line, col).drop("lookup_col")

    def symbol_info(self, file_id: int, start: tuple[int, int], end: tuple[int, int | None] | None = None) -> DataFrame:
        return self.symbol_at(file_id, *start) if end is None else lookup.symbols_between(self["symbols"], file_id, start, end)

    def follow_location(self, file_id: int, line: int, col: int, all_targets: bool = False) -> DataFrame:
        """Where a symbol leads: its best target, or all of them in order; each location once."""
        found = xref.targets_of(self.symbol_at(file_id, line, col), self["symbols"], self["usrs"], self["targets"])
        out = rank.ordered_targets(found.dropDuplicates(LOC))
        return out if all_targets else out.limit(1)

    def target_usrs(self, file_id: int, line: int, col: int) -> DataFrame:
        return xref.target_usrs(self.symbol_at(file_id, line, col), self["targets"]).select("usr").distinct()

    def references(self, file_id: int, line: int, col: int, *, mode: str = "callers", rotate: bool = True, kind_filter: str | None = None, path_filters: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """References to the symbol at a position. mode: callers, all, virtuals or rename; rotated to start behind the position."""
        return self._references(self.symbol_at(file_id, line, col), mode, rotate and mode != "rename", kind_filter, path_filters, limit)

    def references_by_name(self, name: str, *, mode: str = "callers", limit: int | None = None) -> DataFrame:
        return self._references(self.find_symbols(name), mode, False, None, None, limit)

    def _references(self, inputs: DataFrame, mode: str, rotate: bool, kind_filter: str | None, path_filters: list[str] | None, limit: int | None) -> DataFrame:
        s, u, t = self["symbols"], self["usrs"], self["targets"]
        keys = xref.resolve(inputs, s, u, t)
        if mode == "callers":
            kinds_of = xref.find_by_usr(keys.select(F.col("from_usr").alias("usr")), u, s).groupBy(F.col("usr").alias("from_usr")).agg(F.min("kind").alias("from_kind"))
            rows = xref.callers(keys, s, t, kinds_of)
        elif mode == "all":
            rows = xref.all_references(keys, s, u, t)
        elif mode == "virtuals":
            rows = xref.virtuals(keys, s, u, t)
        elif mode == "rename":
            rows = xref.rename_locations(keys, s, u, t)
        else:
            raise ValueError(f"unknown mode {mode}")
        rows = self._filtered(rows, path_filters, kind_filter, None, False, False).dropDuplicates([f"from_{c}" for c in LOC] + LOC)
        if rotate:
            rows = rank.rotated(rows, [f"from_{c}" for c in LOC], [f"from_{c}" for c in LOC]).orderBy("position")
        else:
            rows = rows.dropDuplicates(LOC).orderBy(*LOC)
        return rows if limit is None else rows.limit(limit)

    def rename(self, file_id: int, line: int, col: int) -> DataFrame:
        return self.references(file_id, line, col, mode="rename")

    def called_by(self, file_id: int, start: tuple[int, int], end: tuple[int, int | None]) -> DataFrame:
        """Functions that the code of a range calls; an end without a column is its whole line."""
        refs = lookup.symbols_between(self["symbols"], file_id, start, end).where(in_category("reference"))
        found = xref.targets_of(refs, self["symbols"], self["usrs"], self["targets"]).where(in_category("function"))
        return rank.best_target(found, [f"from_{c}" for c in LOC])

    def tokens(self, file_id: int, begin: int, end: int, with_symbols: bool = False) -> DataFrame:
        rows = lookup.tokens_between(self["tokens"], file_id, begin, end)
        return lookup.token_symbols(rows, self["symbols"].where(F.col("file_id") == file_id)) if with_symbols else rows

    # graphs ----------------------------------------------------------------------------------------------

    def class_hierarchy(self, usr: str) -> DataFrame:
        """(direction, depth, usr, path): super and sub classes; nothing for a side without any."""
        b = xref.bases(self["symbols"])
        sides = [graph.hierarchy(b, usr, down).where("depth > 0").select(F.lit(n).alias("direction"), "depth", "usr", F.array_join("path", ">").alias("path")) for n, down in (("super", False), ("sub", True))]
        return sides[0].union(sides[1])

    def dependencies(self, file_id: int, what: str = "depends-on") -> DataFrame:
        """includes, included-by, depends-on, depended-on, tree or raw."""
        i = self["includes"]
        if what in ("includes", "included-by"):
            return graph.direct(i, file_id, what == "included-by")
        if what == "tree":
            return graph.include_tree(self.edges, file_id)
        seed = self.spark.createDataFrame([(file_id,)], "seed int")
        mode = "depends_on_arg" if what == "depended-on" else "arg_depends_on"
        reach = graph.dependencies(i, seed, mode)
        if what == "raw":
            return graph.adjacency(self.edges, reach.select("node"))
        return reach.where(F.col("node") != file_id).select(F.col("node").alias("file_id"), "depth")

    def include_path(self, file_id: int, line: int, col: int, max_nodes: int = 8, absolute: bool = False) -> DataFrame:
        """Include chains from a file to the file of each target of a symbol: the target's location and the chain as text, paths relative to the project.

        One row a target and chain, best target first, chains by file id.
        """
        found = xref.targets_of(self.symbol_at(file_id, line, col), self["symbols"], self["usrs"], self["targets"]).dropDuplicates(LOC)
        found = found.select(*LOC, rank.target_rank().alias("_rank"), is_definition().alias("_def"))
        start = self.spark.createDataFrame([(file_id,)], "node int")
        paths = graph.simple_paths(self.edges, start, found.select("file_id"), max_nodes)
        name = F.col("path") if absolute else relative(F.col("path"), self.root)
        steps = paths.select(F.col("path").alias("chain"), F.posexplode("path").alias("i", "file_id")).distinct().join(self["files"].select("file_id", name.alias("name")), "file_id")
        named = steps.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("i", "name"))).alias("p"))  # at most max_nodes
        text = F.array_join(F.transform("p", lambda x: x["name"]), " -> ")
        rows = found.join(named.select("chain", F.element_at("chain", -1).alias("file_id"), text.alias("text")), "file_id")
        return rows.orderBy(F.desc("_rank"), F.desc("_def"), *LOC, "chain").select(*LOC, "text")

    def include_for(self, name: str, here: int | str, include_dirs: list[str]) -> DataFrame:
        """#include lines that would bring a symbol's definition to a file: headers that define it and headers that only pass those on, the shortest first.

        ``here`` is the file, or a folder for any file that lies directly in it. Headers that share a path have a row each.
        """
        hit = self.find_symbols(name, definitions_only=True).select("file_id").distinct()
        alias = graph.alias_headers(self["includes"]).join(hit.select(F.col("file_id").alias("dst_file")), "dst_file").select(F.col("src_file").alias("file_id"))
        heads = self["files"].where("is_header").join(hit.union(alias).distinct(), "file_id", "left_semi").select("file_id", "path")
        if isinstance(here, str):
            own = self.spark.range(1).select(F.lit(here.rstrip("/") + "/").alias("dir"))
        else:
            own = self["files"].where(F.col("file_id") == here).select(F.regexp_extract("path", "^(.*/)", 1).alias("dir"))
        lines = heads.join(F.broadcast(own), F.col("path").startswith(F.col("dir"))).select("file_id", "path", F.concat(F.lit('#include "'), F.expr("substring(path, length(dir) + 1)"), F.lit('"')).alias("text"))  # one row
        for d in include_dirs:
            d = d.rstrip("/") + "/"
            lines = lines.union(heads.where(F.col("path").startswith(d)).select("file_id", "path", F.concat(F.lit("#include <"), F.substring("path", len(d) + 1, 1 << 30), F.lit(">")).alias("text")))
        return rank.drop_shadowed(lines.distinct(), ["path"], "text").orderBy("path", "position")

    def dead_functions(self, skip_system: bool = True) -> DataFrame:
        """Functions with fewer than two callers: usr and location of the definition, callers (0 or 1)."""
        s = self["symbols"].where(is_definition() & P.dead_candidate(F.col("kind"), F.col("symbol_name")))
        if skip_system:
            s = s.join(self["files"].where(~F.col("is_system")).select("file_id"), "file_id", "left_semi")
        uses = self["targets"].join(self["symbols"].where(in_category("reference")).select(*LOC), LOC, "left_semi").select("usr", *LOC).distinct()
        n = aggregates.capped_callers(s, uses).where("callers < 2")
        return s.select("usr", *LOC, "symbol_name").join(n, "usr")

    def check_includes(self) -> DataFrame:
        """Includes that nothing needs."""
        used = self.file_references().select(F.col("from_file"), F.col("to_file")).distinct()
        return graph.unneeded_includes(self["includes"], used, self["files"].where("is_system").select("file_id"))

    def file_references(self) -> DataFrame:
        refs = self["targets"].select("usr", F.col("file_id").alias("from_file")).distinct()
        return refs.join(self["usrs"].select("usr", F.col("file_id").alias("to_file")).distinct(), "usr").select("from_file", "to_file").distinct()

    # files and builds ------------------------------------------------------------------------------------

    def find_file(self, pattern: str = "", *, regex: bool = False, ignore_case: bool = False, prefer_exact: bool = False, absolute: bool = False) -> DataFrame:
        f = self["project_files"].select(F.concat_ws("/", "dir", "name").alias("path")) if "project_files" in self.t else self["files"].select("path")
        if prefer_exact and not regex:
            f = rank.prefer_exact(f, "path", pattern)
        elif pattern:
            f = f.where(P.matches(F.col("path"), pattern, regex, ignore_case))
        return f if absolute else f.select(F.when(F.col("path").startswith(self.root), F.substring("path", len(self.root) + 1, 1 << 30)).otherwise(F.col("path")).alias("path"))

    def sources(self, file_id: int) -> DataFrame:
        """Builds of a file; for a header those of the nearest source that depends on it."""
        own = self["sources"].where(F.col("file_id") == file_id)
        if not own.isEmpty():
            return own
        seed = self.spark.createDataFrame([(file_id,)], "header int")
        best = graph.header_source(self["includes"], seed, self["sources"]).select(F.col("source").alias("file_id"))
        return self["sources"].join(best, "file_id", "left_semi")

    def compile_commands(self) -> DataFrame:
        return report.compile_commands(self["sources"], self["files"])

    def diagnose(self, file_ids: list[int] | None = None, skipped: bool = False) -> DataFrame:
        wanted = None if file_ids is None else self["files"].where(F.col("file_id").isin(file_ids))
        return report.diagnostics_by_file(report.latest_diagnostics(self["diagnostics"]), self["files"], wanted, skipped)

    def fixits(self, file_id: int) -> DataFrame:
        return report.fixits_text(self["fixits"], file_id)

    def complete(self, prefix: str, limit: int = 50) -> DataFrame:
        return rank.completions(self["completion_candidates"].where(P.available(F.col("availability"))), prefix, limit)

    def complete_includes(self, include_dirs: list[str], depth: int) -> DataFrame:
        """Headers below include directories as they would be included, no deeper than ``depth``."""
        parts = []
        for d in include_dirs:
            d = d.rstrip("/") + "/"
            rel = F.substring("path", len(d) + 1, 1 << 30)
            parts.append(self["files"].where(F.col("is_header") & F.col("path").startswith(d)).select(rel.alias("name")).where(F.size(F.split("name", "/")) - 1 <= depth))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct().orderBy("name")

    def is_indexed(self, path: str) -> str:
        """unknown, managed (seen, not parsed) or indexed."""
        r = self["files"].where(F.col("path") == path).select("parsed_ms").first()
        return "unknown" if r is None else "indexed" if r["parsed_ms"] else "managed"

    def taglist(self, file_id: int | None = None) -> DataFrame:
        s = self["symbols"].where(~in_category("reference"))
        return aggregates.taglist(s if file_id is None else s.where(F.col("file_id") == file_id))

    def cursor_kinds(self) -> DataFrame:
        return kinds(self.spark)

    def table_counts(self) -> DataFrame:
        """(name, rows) of all tables."""
        out = self.spark.createDataFrame([], "name string, rows bigint")
        for name in sorted(self.t):
            out = out.union(self[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows"))
        return out

    def status(self, section: str = "") -> DataFrame:
        """(section, text): what is known, by sections whose name starts with ``section``, whatever the case. Sections without their table are empty."""
        place = lambda p: F.format_string("%s:%d:%d:", p, "line", "col")
        named = lambda rows: rows.join(self["files"].select("file_id", "path"), "file_id")
        folder = F.regexp_extract("path", "^(.*/)", 1)
        makers = {
            "fileids": (["files"], lambda: self["files"].select(F.format_string("  %d: %s", "file_id", "path"))),
            "info": (["settings"], lambda: self["settings"].select(F.concat_ws(": ", "name", "value"))),
            "jobs": (["jobs", "files"], lambda: named(self["jobs"]).select(F.concat_ws(" ", "path", "state"))),
            "daemon": (["daemons"], lambda: self["daemons"].select(F.concat_ws(": ", "name", "state"))),
            "watchedpaths": (["files"], lambda: self["files"].groupBy(folder.alias("dir")).agg(F.max(F.when(F.col("is_header"), "dependency").otherwise("source")).alias("a"), F.min(F.when(F.col("is_header"), "dependency").otherwise("source")).alias("b")).select(F.concat(F.lit("  "), "dir", F.lit(" ("), F.concat_ws("|", F.array_distinct(F.array("a", "b"))), F.lit(")")))),
            "dependencies": (["includes", "files"], lambda: self["includes"].distinct().join(self["files"].select(F.col("file_id").alias("src_file"), F.col("path").alias("a")), "src_file").join(self["files"].select(F.col("file_id").alias("dst_file"), F.col("path").alias("b")), "dst_file").select(F.concat(F.lit("  "), "a", F.lit(" -> "), "b"))),
            "symbols": (["symbols"], lambda: report.symbol_text(self["symbols"]).select("text")),
            "targets": (["targets", "files"], lambda: named(self["targets"].distinct()).select(F.concat(F.lit("  "), "usr", F.lit("    "), place("path")))),
            "symbolnames": (["symbol_names", "files"], lambda: named(self["symbol_names"].distinct()).select(F.concat(F.lit("  "), "name", F.lit("    "), place("path")))),
            "sources": (["sources", "files"], lambda: self.compile_commands().select(F.concat_ws(" ", "file", "command"))),
            "compilers": (["sources"], lambda: self["sources"].select("compiler").distinct()),
            "memory": ([], lambda: self.table_counts().select(F.concat_ws(": ", "name", F.col("rows").cast("string")))),
            "project": ([], lambda: self.spark.createDataFrame([(f"Path: {self.root}",)], "text string")),
        }
        out = self.spark.createDataFrame([], "section string, text string")
        for name, (needs, make) in makers.items():
            also = "cursors" if name == "symbols" else name
            if (name.startswith(section.lower()) or also.startswith(section.lower())) and all(n in self.t for n in needs):
                rows = make()
                out = out.union(rows.select(F.lit(name).alias("section"), F.col(f"`{rows.columns[0]}`").alias("text")))
        return out

    def dump_file(self, file_id: int) -> DataFrame:
        """The facts of one file, a text line each."""
        parts = []
        for name in ("symbols", "symbol_names", "usrs", "targets"):
            rows = self[name].where(F.col("file_id") == file_id)
            rest = [c for c in rows.columns if c not in LOC]
            parts.append(rows.select(F.lit(name).alias("table"), F.format_string("%d:%d", "line", "col").alias("key"), F.to_json(F.struct(*rest)).alias("value")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def generate_test(self) -> DataFrame:
        """Every symbol that has a target, with its best one: the cases of a navigation test."""
        found = xref.targets_of(self["symbols"], self["symbols"], self["usrs"], self["targets"])
        return rank.best_target(found, [f"from_{c}" for c in LOC]).select(*[f"from_{c}" for c in LOC], *LOC)
