"""Secret scanning with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. A ledger, a table in the shared store, remembers which
(blob, rule set version) pairs have been scanned and what they held; only unseen pairs are scanned, once each however many
paths hold the blob, and findings are joined back to all paths.

What is unseen is found out on keys alone. Texts move only if more blobs than can be broadcast are held by several rows, or
are unseen by an older ledger. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import broadcast_if_small, materialise, remove, shared_dir, small, use

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: The rest of a key without an end line: header fields, lines of base64, a shorter last line. Line ends may be escaped.
_PEM_REST = re.compile(r"""(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+((?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})++((?:[\x20\t\r]*+\n|\\[nr])++[\x20\t]*+[A-Za-z0-9+/]++={0,2}(?=[\x20\t\r]*+(?:\n|\\|["']|\Z)))?""")
#: From the :// on; in front of it stands a scheme, a letter and then letters, digits, + . and -.
_LOGIN = re.compile(r"://[^\s:/@]+:([^\s:/@]+)@")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def _assign(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6] if ":" in text or "=" in text else []


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []


def _hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX_RUN.finditer(text)]  # maximal runs either way: the run's length decides


def _pem(text: str) -> list[tuple[int, int]]:
    """From the BEGIN through the END line; where that is missing before the next key, over the base64 lines that follow."""
    if "PRIVATE KEY-----" not in text:
        return []
    begun = list(_PEM.finditer(text))
    out = []
    for m, to in zip(begun, [*(b.start() for b in begun[1:]), len(text)], strict=True):
        end = _PEM_END.search(text, m.end(), to) or _PEM_REST.match(text, m.end(), to)
        out.append((m.start(), end.end() if end else m.end()))
    return out


def _url(text: str) -> list[tuple[int, int]]:
    """Passwords in addresses. Each :// is looked at once, and so are the characters in front of it."""
    out = []
    for m in _LOGIN.finditer(text) if "://" in text else ():
        at = m.start() - 1
        while at >= 0 and text[at] in _SCHEME and not (text[at].isalpha()):
            at -= 1
        if at >= 0 and text[at] in _SCHEME:
            out.append(m.span(1))
    return out


#: Rule sets: name -> (version, [(kind, finder)]). A changed set gets a new version, so that seen blobs are scanned again by it.
RULES: dict[str, tuple[int, list[tuple[str, Callable[[str], list[tuple[int, int]]]]]]] = {
    "base": (1, [("assign", _assign), ("access", _access), ("hex", _hex)]),
    "extended": (2, [("pem", _pem), ("url", _url)]),
}
KINDS = [kind for _, rules in RULES.values() for kind, _ in rules]

LEDGER = "blob binary, rule_set string, rule_version int, spans string"


def find(text: str, rule_set: str) -> str:
    """kind:start:end of one rule set's findings by start, then kind as listed; code points, end exclusive."""
    found = [(s, n, kind, e) for n, (kind, f) in enumerate(RULES[rule_set][1]) for s, e in f(text)]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def versions() -> list[tuple[str, int]]:
    return [(name, v) for name, (v, _) in RULES.items()]


def _text() -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _blob() -> F.Column:
    return F.unhex(F.sha2(_text(), 256))


def _current() -> F.Column:
    """Whether a ledger row is of a present rule set's present version."""
    return F.concat_ws(":", "rule_set", F.col("rule_version").cast("string")).isin([f"{n}:{v}" for n, v in versions()])


def scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """New ledger rows for the texts of ``docs``: one per unseen (blob, rule set, version).

    A null text counts as the empty blob. ``ledger``: earlier rows (``LEDGER``); None if there are none. Of the rows that hold
    a blob the ones with the least ``id_col`` are scanned; where ids repeat, what they give is made one row.
    """
    names = versions()
    rows = docs.select(_blob().alias("blob"), F.col(f"`{id_col}`").alias("id"), _text().alias("text"))
    first = rows.groupBy("blob").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    if ledger is None:
        # rows whose blob no other row holds need no look
        several = broadcast_if_small(first.where("copies > 1").select("blob", "least", F.lit(True).alias("held")), "several")
        todo = rows.join(several, "blob", "left").where("held is null or id <=> least").select("blob", "text", F.lit(None).cast("array<string>").alias("seen"))
    else:
        seen = ledger.where(_current()).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule_set", F.col("rule_version").cast("string"))).alias("seen"))  # as many as rule sets
        unseen = first.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(names)).select("blob", "least", "seen")
        unseen = broadcast_if_small(unseen, "unseen")
        todo = rows.join(unseen, "blob").where("id <=> least").select("blob", "text", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("secrets")
        for b in small(batches):
            blob, rule, ver, spans = [], [], [], []
            for key, text, done in zip(b.column("blob").to_pylist(), b.column("text").to_pylist(), b.column("seen").to_pylist(), strict=True):
                for name, v in names:
                    if f"{name}:{v}" not in (done or ()):
                        blob.append(key)
                        rule.append(name)
                        ver.append(v)
                        spans.append(find(text, name))
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.binary()), pa.array(rule, pa.string()), pa.array(ver, pa.int32()), pa.array(spans, pa.string())], ["blob", "rule_set", "rule_version", "spans"])

    return todo.mapInArrow(run, LEDGER).dropDuplicates(["blob", "rule_set", "rule_version"])


class Ledger:
    """A ledger kept as a Parquet table in a folder that all executors share.

    Each update appends the rows of what was unseen, in one commit; an update that is run again after a failure finds them and adds
    nothing. Rows of older rule versions stay, as a record.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        """All rows, or None if nothing has been recorded."""
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")  # a first update that has failed leaves none
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Scans the unseen blobs of ``docs``, records them and returns the whole ledger."""
        scan(docs, self.rows(), id_col).write.mode("append").parquet(self.path)
        return self.rows()


def history(versions_: DataFrame, ledger: Ledger) -> DataFrame:
    """Findings of every historical version of every path: ``versions_`` (path, version, text) with spans, all in order.

    Blobs that the ledger knows are not scanned again, whatever path or version they come back under.
    """
    known = ledger.update(versions_, "path")
    keep = [c for c in versions_.columns if c not in ("text", "spans")]
    found = findings(versions_, known, keep)
    return found.select(*[F.col(f"`{c}`") for c in keep], all_spans().alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Joins the findings of a ledger back to every row of ``docs``: adds _lodestar_base and _lodestar_more, '' where nothing was found.

    Only blobs with findings take part in the join; the rows of one very common blob are split by Spark's skew join.
    """
    pick = lambda name: F.coalesce(F.max(F.when(F.col("rule_set") == name, F.col("spans"))), F.lit(""))
    hits = ledger.where(_current() & (F.col("spans") != "")).groupBy(F.col("blob").alias("_lodestar_blob")).agg(pick("base").alias("_lodestar_base"), pick("extended").alias("_lodestar_more"))
    hits = broadcast_if_small(hits, "found", weigh=F.length("_lodestar_base") + F.length("_lodestar_more"))
    keep = keep or docs.columns
    paths = docs.select(*[F.col(f"`{c}`") for c in keep], _blob().alias("_lodestar_blob"))
    joined = paths.join(hits, "_lodestar_blob", "left")
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("_lodestar_base", F.lit("")).alias("_lodestar_base"), F.coalesce("_lodestar_more", F.lit("")).alias("_lodestar_more"))


def counted(spans: F.Column, kind: str) -> F.Column:
    """How many spans of a kind a joined string holds."""
    return F.size(F.filter(F.split(spans, ","), lambda x: x.startswith(kind + ":"))).cast("long")


def all_spans() -> F.Column:
    """Base and extended spans in one order: by start, then kind as listed, then end."""

    def keyed(x: F.Column) -> F.Column:
        part = F.split(x, ":")
        nth = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.get(part, F.lit(0)))
        return F.struct(F.get(part, F.lit(1)).cast("long").alias("s"), nth.alias("n"), F.get(part, F.lit(2)).cast("long").alias("e"), x.alias("x"))

    both = F.filter(F.split(F.concat_ws(",", "_lodestar_base", "_lodestar_more"), ","), lambda x: x != "")
    merged_ = F.array_join(F.transform(F.sort_array(F.transform(both, keyed)), lambda k: k["x"]), ",")
    return F.when(F.col("_lodestar_more") == "", F.col("_lodestar_base")).otherwise(merged_)


def in_order(spans: str) -> list[tuple[str, int, int]]:
    got = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
    return sorted(got, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def merged(base: str, extended: str) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in in_order(base + "," + extended)) if extended else base


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, counts, digest of the base spans and all spans.

    A null text counts as empty; rows that repeat a text or an id get a row each. Without a ``ledger`` a new one is begun in the shared folder.
    """
    spark = docs.sparkSession
    if ledger is None:
        ledger = Ledger(spark, f"{shared_dir(spark)}/lodestar-ledger-{uuid.uuid4().hex}")
        atexit.register(remove, spark, ledger.path)
    j = findings(docs, ledger.update(docs), ["doc_id"])
    return j.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[counted(F.col("_lodestar_base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.col("_lodestar_base"), 256).alias("base_sha256"),
        all_spans().alias("spans"),
    )


def redact_text(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for _, s, e in in_order(spans):
        if s >= at:
            out += [text[at:s], mark]
        elif e <= at:
            continue
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found secret replaced by [SECRET] (overlapping ones by one mark) and n_chars recounted; no row is dropped."""
    j = findings(docs, materialise(scan(docs), "ledger"))
    # one Python function in the stage: each further one would keep a worker of its own on every core
    plain = F.udf(lambda text, base, more: None if text is None else redact_text(text, merged(base, more)), StringType(), useArrow=True)
    hit = (F.col("_lodestar_base") != "") | (F.col("_lodestar_more") != "")
    j = j.withColumn("text", F.when(hit, plain(F.when(hit, F.col("text")), "_lodestar_base", "_lodestar_more")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return j.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
