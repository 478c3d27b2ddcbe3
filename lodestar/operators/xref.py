"""Cross references: from symbols to their targets and back, in batch form.

Relations: symbols (one row a location), usrs (usr, location of declarations and definitions), targets (usr, location
of references). Inputs are tables of symbols keyed by location, so a whole set of questions is one plan; every join is
an equality of hashes that Spark may shuffle, or broadcast where it measures one side as small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.names import parse_location
from lodestar.operators.graph import closure, dependencies
from lodestar.schema import IMPLICIT_DESTRUCTION, LOC, TEMPLATE_SPECIALIZATION, VIRTUAL, in_category, is_definition

#: Kinds whose declarations and definitions pair by usr.
PAIRED = ("ClassDecl", "ClassTemplate", "StructDecl", "FunctionDecl", "FunctionTemplate", "CXXMethod", "CXXConstructor", "CXXDestructor", "VarDecl", "FieldDecl")

_FROM = [f"from_{c}" for c in LOC]


def at(relation: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols at a relation's locations: the relation's other columns and the symbol's. One row a location."""
    extra = [c for c in relation.columns if c not in LOC]
    return relation.join(symbols.drop(*extra), LOC)


def origin(inputs: DataFrame) -> DataFrame:
    """Input symbols by their location as from_*; with their usr, kind and flags."""
    return inputs.select(*[F.col(c).alias(f) for c, f in zip(LOC, _FROM, strict=True)], F.col("usr").alias("from_usr"), F.col("kind").alias("from_kind"), F.col("flags").alias("from_flags"))


def find_by_usr(keys: DataFrame, usrs: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Declarations and definitions of each usr; a usr that is a position (``/path:line:col``) and has none stands for that position."""
    u = usrs.select("usr", *LOC).distinct()
    found = at(keys.select("usr").distinct().join(u, "usr"), symbols.drop("usr"))
    if files is None:
        return found
    lost = keys.select("usr").distinct().where(F.col("usr").startswith("/")).join(u.select("usr"), "usr", "left_anti")
    loc = parse_location(F.col("usr"))
    spots = lost.withColumn("l", loc).where("l is not null").join(files.select("file_id", "path"), F.col("l.path") == F.col("path"))
    return found.unionByName(at(spots.select("usr", "file_id", F.col("l.line").alias("line"), F.col("l.col").alias("col")), symbols.drop("usr")))


def scoped_then_wide(keys: DataFrame, candidates: DataFrame, scope: DataFrame, key: list[str], seed: str = "scope_file") -> DataFrame:
    """Per key the candidates in scope; only keys without any take all.

    candidates: (key..., file_id, ...), each key with its ``seed`` file; scope: (seed, node) from the include closure.
    """
    s = scope.select(F.col("seed").alias(seed), F.col("node").alias("file_id")).distinct().withColumn("_in", F.lit(True))
    marked = keys.join(candidates, key).join(s, [seed, "file_id"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    any_ = marked.groupBy(*key).agg(F.max("_in").alias("_any"))
    return marked.join(any_, key).where("_in or not _any").drop("_in", "_any")


def scoped(keys: DataFrame, candidates: DataFrame, includes: DataFrame, key: list[str]) -> DataFrame:
    """Per key the candidates in its scope, then all: keys (key..., scope_file, mode from :func:`scope_mode`).

    Mode ``all`` takes all candidates at once, so no closure is walked for it.
    """
    narrow = keys.where("mode <> 'all'")
    parts = [dependencies(includes, narrow.where(F.col("mode") == m).select("scope_file"), m).select("seed", "node", F.lit(m).alias("mode")) for m in ("arg_depends_on", "depends_on_arg")]
    found = [scoped_then_wide(narrow.where(F.col("mode") == m), candidates, p, key) for m, p in zip(("arg_depends_on", "depends_on_arg"), parts, strict=True)]
    wide = keys.where("mode = 'all'").join(candidates, key)
    return found[0].unionByName(found[1]).unionByName(wide)


def scope_mode(kind: F.Column, flags: F.Column, linkage: F.Column | None = None) -> F.Column:
    """Where a symbol's partners are looked for first: a definition's in what it includes, a declaration's in what includes it, a forward declaration's everywhere."""
    forward = kind.isin("ClassDecl", "StructDecl", "FunctionDecl") | ((kind == "VarDecl") & (linkage == "External") if linkage is not None else F.lit(False))
    return F.when(is_definition(flags), "arg_depends_on").when(forward, "all").otherwise("depends_on_arg")


def target_usrs(locations: DataFrame, targets: DataFrame) -> DataFrame:
    """(location, usr): all usrs that each location refers to."""
    return locations.select(*LOC).distinct().join(targets.select("usr", *LOC).distinct(), LOC)


def targets_of(inputs: DataFrame, symbols: DataFrame, usrs: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets of each input symbol, as from_* and the target's columns.

    Declarations and definitions of the paired kinds lead to their other half of the same kind; a class definition that is
    no template specialization has none, nor has an implicit destruction. Everything else follows its references.
    """
    o = origin(inputs).where(F.col("from_flags").bitwiseAND(IMPLICIT_DESTRUCTION) == 0)
    dead = F.col("from_kind").isin("ClassDecl", "ClassTemplate", "StructDecl") & is_definition(F.col("from_flags")) & (F.col("from_flags").bitwiseAND(TEMPLATE_SPECIALIZATION) == 0)
    o = o.where(~dead)
    paired = F.col("from_kind").isin(*PAIRED) & (F.col("from_usr") != "")
    defs = at(usrs.select("usr", *LOC).distinct(), symbols.drop("usr"))
    halves = o.where(paired).join(defs, F.col("from_usr") == F.col("usr")).where((F.col("kind") == F.col("from_kind")) & (is_definition() != is_definition(F.col("from_flags"))))
    refs = o.where(~F.coalesce(paired, F.lit(False))).join(targets.select(F.col("usr").alias("t_usr"), *[F.col(c).alias(f) for c, f in zip(LOC, _FROM, strict=True)]).distinct(), _FROM)
    followed = refs.join(defs, F.col("t_usr") == F.col("usr")).drop("t_usr")
    return halves.unionByName(followed)


def resolve(inputs: DataFrame, symbols: DataFrame, usrs: DataFrame, targets: DataFrame) -> DataFrame:
    """(from_*, from_usr): each input with the usr its references are kept under: its own, or its best target's if it is a reference."""
    from lodestar.operators.rank import best_target

    is_ref = in_category("reference") | (F.coalesce(F.col("usr"), F.lit("")) == "")
    own = origin(inputs.where(~is_ref)).select(*_FROM, "from_usr")
    via = targets_of(inputs.where(is_ref), symbols, usrs, targets)
    return own.unionByName(best_target(via, _FROM).select(*_FROM, F.col("usr").alias("from_usr")))


def references_of(keys: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """References to each from_usr: (from_*, from_usr) and the referring symbol's columns, one row a location."""
    t = targets.select(F.col("usr").alias("from_usr"), *LOC).distinct()
    return keys.join(t, "from_usr").join(symbols, LOC)


def callers(keys: DataFrame, symbols: DataFrame, targets: DataFrame, kinds_of: DataFrame) -> DataFrame:
    """References that count as uses: for a class no constructors, destructors or calls; for a constructor also variables and fields of the class.

    kinds_of: (from_usr, from_kind).
    """
    r = references_of(keys, symbols, targets).join(kinds_of, "from_usr")
    klass = in_category("class", F.col("from_kind"))
    use = in_category("reference")
    hit = F.when(klass, use & ~F.col("kind").isin("CXXConstructor", "CXXDestructor", "CallExpr")).when(F.col("from_kind") == "CXXConstructor", use | F.col("kind").isin("VarDecl", "FieldDecl")).otherwise(use)
    return r.where(hit)


def all_references(keys: DataFrame, symbols: DataFrame, usrs: DataFrame, targets: DataFrame) -> DataFrame:
    """Declarations, definitions and references of each from_usr, one row a location: (from_*, from_usr) and symbol columns."""
    decls = usrs.select(F.col("usr").alias("from_usr"), *LOC)
    refs = targets.select(F.col("usr").alias("from_usr"), *LOC)
    return keys.join(decls.union(refs).distinct(), "from_usr").join(symbols, LOC)


def overrides(usrs: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(root_usr, usr) of virtual methods: a method refers to the usr of the method it overrides, directly or also of those above; roots override nothing.

    Climbs from step to step, so that facts need not be closed transitively.
    """
    methods = at(usrs.select("usr", *LOC).distinct(), symbols.drop("usr")).where((F.col("kind") == "CXXMethod") & (F.col("flags").bitwiseAND(VIRTUAL) != 0))
    up = methods.select("usr", *LOC).join(targets.select(F.col("usr").alias("parent"), *LOC).distinct(), LOC).where("usr <> parent").select("usr", "parent").distinct()
    roots = methods.select("usr").distinct().join(up, "usr", "left_anti")
    return closure(up.select(F.col("parent").alias("src"), F.col("usr").alias("dst")), roots).select(F.col("seed").alias("root_usr"), F.col("node").alias("usr"))


def virtuals(keys: DataFrame, symbols: DataFrame, usrs: DataFrame, targets: DataFrame) -> DataFrame:
    """All declarations and definitions of the methods of each from_usr's override family, climbed to its root."""
    family = overrides(usrs, symbols, targets)
    root = keys.join(family.select(F.col("usr").alias("from_usr"), "root_usr"), "from_usr")
    members = root.join(family, "root_usr").select(*[c for c in keys.columns if c != "from_usr"], "from_usr", F.col("usr").alias("m_usr")).distinct()
    return members.join(usrs.select(F.col("usr").alias("m_usr"), *LOC).distinct(), "m_usr").join(symbols, LOC)


def rename_locations(keys: DataFrame, symbols: DataFrame, usrs: DataFrame, targets: DataFrame, macro: bool = False) -> DataFrame:
    """Locations to rewrite when a usr is renamed: all its references and declarations, in order of location; macro expansions only for a macro."""
    r = all_references(keys, symbols, usrs, targets)
    return r if macro else r.where(F.col("kind") != "MacroExpansion")


def rename_key(inputs: DataFrame, symbols: DataFrame, class_of: DataFrame) -> DataFrame:
    """Constructors and destructors stand for their class: class_of (usr, class_usr)."""
    return inputs.join(class_of, "usr", "left").withColumn("usr", F.coalesce("class_usr", "usr")).drop("class_usr")


def bases(symbols: DataFrame) -> DataFrame:
    """(usr, base) of class definitions."""
    return symbols.where(is_definition() & in_category("class")).select("usr", F.explode("base_classes").alias("base")).distinct()


def subclasses(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose base classes hold each usr: an exploded equality join."""
    b = symbols.withColumn("base", F.explode("base_classes"))
    return keys.select(F.col("usr").alias("base")).distinct().join(b, "base")


def superclasses(keys: DataFrame, symbols: DataFrame, usrs: DataFrame) -> DataFrame:
    """The first definition, by location, of each base of each usr."""
    b = bases(symbols).join(keys.select("usr").distinct(), "usr", "left_semi")
    defs = at(usrs.select(F.col("usr").alias("base"), *LOC).distinct(), symbols.drop("usr")).where(is_definition())
    cols = [c for c in defs.columns if c != "base"]
    first = defs.groupBy("base").agg(F.min_by(F.struct(*cols), F.struct(*LOC)).alias("s")).select("base", "s.*")
    return b.join(first, "base")


def union_by_location(*parts: DataFrame) -> DataFrame:
    """Union of symbol sets; one row a location."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(LOC)


def first_project(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Of answers from several projects (project_rank) those of the first that has any, per key."""
    best = answers.groupBy(*keys).agg(F.min("project_rank").alias("_best"))
    return answers.join(best, keys).where(F.col("project_rank") == F.col("_best")).drop("_best")


def owner(visits: DataFrame, header: str, job: str) -> DataFrame:
    """The first job that visits a header owns it."""
    w = Window.partitionBy(header).orderBy(job)
    return visits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
