"""Output rows: text, JSON, XML and Lisp forms of locations, symbols, diagnostics and builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.names import display_name, format_location
from lodestar.functions.text import escape_xml, quote_lisp, relative
from lodestar.schema import LOC


def with_context(rows: DataFrame, files: DataFrame, lines: DataFrame, unsaved: DataFrame | None = None) -> DataFrame:
    """Adds path and the text of the line; an unsaved buffer's lines (file_id, line, text) come first."""
    if unsaved is not None:
        lines = lines.join(unsaved.select("file_id").distinct(), "file_id", "left_anti").unionByName(unsaved)
    return rows.join(files.select("file_id", "path"), "file_id").join(lines.select("file_id", "line", F.col("text").alias("context")), ["file_id", "line"], "left")


def location_text(rows: DataFrame, root: str = "", columns: tuple[str, ...] = ("context",)) -> DataFrame:
    """One text line a row: ``path:line:col:`` (relative to root) and further columns behind tabs, nulls skipped.

    columns: any of context, display_name, kind, containing_function, containing_location, in this order.
    """
    known = {
        "context": F.col("context") if "context" in rows.columns else F.lit(None),
        "display_name": display_name(F.col("symbol_name"), F.col("kind")) if "symbol_name" in rows.columns else F.lit(None),
        "kind": F.col("kind") if "kind" in rows.columns else F.lit(None),
        "containing_function": F.concat(F.lit("function: "), F.col("enclosing_symbol_name")) if "enclosing_symbol_name" in rows.columns else F.lit(None),
        "containing_location": F.concat(F.lit("function: "), format_location(F.col("path"), F.col("enclosing_line"), F.col("enclosing_col"))) if "enclosing_line" in rows.columns else F.lit(None),
    }
    spot = format_location(relative(F.col("path"), root), F.col("line"), F.col("col"))
    return rows.withColumn("text", F.concat_ws("\t", spot, *[known[c] for c in known if c in columns]))


def pieces(rows: DataFrame, names: list[str]) -> DataFrame:
    """Only the named fields that exist."""
    return rows.select(*[n for n in names if n in rows.columns])


def symbol_text(symbols: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A record a symbol: ``Name: value`` lines, nulls skipped."""
    cols = [c for c in symbols.columns if c not in LOC and (names is None or c in names) and not symbols.schema[c].dataType.simpleString().startswith(("struct", "array"))]
    line = lambda c: F.concat(F.lit(c.replace("_", " ").capitalize() + ": "), F.col(c).cast("string"))
    return symbols.select(*LOC, F.concat_ws("\n", *[line(c) for c in cols]).alias("text"))


def symbol_json(symbols: DataFrame, names: list[str] | None = None, **nested: DataFrame) -> DataFrame:
    """A JSON object a symbol. ``nested``: name -> rows (location, item) that become an array under that name."""
    cols = [c for c in symbols.columns if names is None or c in names]
    out = symbols
    for name, rows in nested.items():
        lists = rows.groupBy(*LOC).agg(F.sort_array(F.collect_list("item")).alias(name))
        out = out.join(lists, LOC, "left")
    return out.select(*LOC, F.to_json(F.struct(*cols, *nested)).alias("json"))


def symbol_lisp(symbols: DataFrame, names: list[str]) -> DataFrame:
    """An association list a symbol."""
    cell = lambda c: F.concat(F.lit(f"(cons '{c.replace('_', '-')} "), quote_lisp(F.col(c).cast("string")), F.lit(")"))
    return symbols.select(*LOC, F.concat(F.lit("(list "), F.concat_ws(" ", *[cell(c) for c in names]), F.lit(")")).alias("lisp"))


def compile_commands(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a compile database: directory, file, command; written with ``write.json`` it is one object a line."""
    j = sources.join(files.select("file_id", F.col("path").alias("file")), "file_id")
    defines = F.transform("defines", lambda d: F.concat(F.lit("-D"), d["name"], F.when(d["value"].isNull(), "").otherwise(F.concat(F.lit("="), d["value"]))))
    includes = F.transform("includes", lambda i: F.concat(i["type"], F.when(i["type"].isin("-I", "-F"), "").otherwise(" "), i["path"]))
    words = F.array_join(F.concat(F.array("compiler"), "arguments", defines, includes, F.array("file")), " ")
    return j.select("directory", "file", words.alias("command"))


def latest_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """One diagnostic a location: the last reported."""
    cols = diagnostics.columns
    return diagnostics.groupBy(*LOC).agg(F.max_by(F.struct(*cols), "diag_id").alias("d")).select("d.*")


def diagnostics_by_file(diagnostics: DataFrame, files: DataFrame, wanted: DataFrame | None = None, skipped: bool = True) -> DataFrame:
    """(path, items): each file's diagnostics in order of place; files in ``wanted`` without any get an empty list, which clears them."""
    d = diagnostics if skipped else diagnostics.where("severity <> 'skipped'")
    item = F.struct("line", "col", F.coalesce("length", F.lit(-1)).alias("length"), "severity", "message")
    lists = d.groupBy("file_id").agg(F.sort_array(F.collect_list(item)).alias("items"))  # one file's
    named = (files if wanted is None else files.join(wanted.select("file_id").distinct(), "file_id", "left_semi")).select("file_id", "path")
    j = named.join(lists, "file_id", "inner" if wanted is None else "left")
    return j.select("path", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)).alias("items"))


def diagnostics_json(by_file: DataFrame) -> DataFrame:
    return by_file.select(F.to_json(F.struct("path", "items")).alias("json"))


def file_xml() -> F.Column:
    """A checkstyle <file> element of columns path and items."""
    error = lambda e: F.concat(F.lit("<error line=\""), e["line"].cast("string"), F.lit('" column="'), e["col"].cast("string"), F.lit('" severity="'), e["severity"], F.lit('" message="'), escape_xml(e["message"]), F.lit('"/>'))
    return F.concat(F.lit('<file name="'), escape_xml(F.col("path")), F.lit('">'), F.array_join(F.transform("items", error), ""), F.lit("</file>"))


def file_lisp() -> F.Column:
    """A pair of path and list of diagnostics of columns path and items; nil where there are none."""
    number = lambda c: F.when(c > 0, c.cast("string")).otherwise("nil")
    item = lambda e: F.concat(F.lit(" (list nil "), e["line"].cast("string"), F.lit(" "), e["col"].cast("string"), F.lit(" "), number(e["length"]), F.lit(" '"), e["severity"], F.lit(" "), quote_lisp(e["message"]), F.lit(" nil)"))
    some = F.concat(F.lit("(cons "), quote_lisp(F.col("path")), F.lit(" (list"), F.array_join(F.transform("items", item), ""), F.lit("))"))
    return F.when(F.size("items") > 0, some).otherwise(F.concat(F.lit("(cons "), quote_lisp(F.col("path")), F.lit(" nil)")))


def diagnostics_xml(by_file: DataFrame) -> DataFrame:
    """A checkstyle <file> element a file."""
    return by_file.select(file_xml().alias("xml"))


def diagnostics_lisp(by_file: DataFrame) -> DataFrame:
    """A Lisp pair a file."""
    return by_file.select("path", file_lisp().alias("lisp"))


def coloured(context: F.Column, col: F.Column, colour: str = "\x1b[32;1m", reset: str = "\x1b[0;0m") -> F.Column:
    """A line with the identifier at a column (from 1), a ~ in front of it too, in colour; unchanged where the line ends before."""
    rest = F.substring(context, col, F.length(context))
    word = F.regexp_extract(rest, "^~?[A-Za-z0-9_]*", 0)
    shown = F.concat(F.substring(context, F.lit(1), col - 1), F.lit(colour), word, F.lit(reset), F.substring(rest, F.length(word) + 1, F.length(context)))
    return F.when(col < F.length(context), shown).otherwise(context)


def fitted_table(rows: DataFrame, key: str, value: str, most: int = 80) -> DataFrame:
    """Two columns as text, the first as wide as its longest entry but no wider than ``most``, longer ones cut."""
    width = rows.agg(F.least(F.max(F.length(F.col(key).cast("string"))), F.lit(most)).alias("_w"))
    line = F.concat(F.rpad(F.col(key).cast("string"), F.col("_w"), F.lit(" ")), F.lit(" "), F.col(value).cast("string"))
    return rows.join(F.broadcast(width)).select(line.alias("text"))  # one row


def fixits_text(fixits: DataFrame, file_id: int) -> DataFrame:
    """``line:col length text``, the last place first, so that edits do not move what is still to be edited."""
    return fixits.where(F.col("file_id") == file_id).orderBy(F.desc("line"), F.desc("col")).select(F.format_string("%d:%d %d %s", "line", "col", "length", "text").alias("text"))


def file_table(rows: DataFrame, key: str, value: str, width: int = 40) -> DataFrame:
    """Two columns padded to a width, as text."""
    return rows.select(F.concat(F.rpad(F.col(key).cast("string"), width, " "), F.lit(" "), F.col(value).cast("string")).alias("text"))


def numbered(rows: DataFrame, order: list[F.Column], keys: list[str] | None = None) -> DataFrame:
    """Adds ``position`` within each key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(*order)))
