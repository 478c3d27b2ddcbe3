"""Text output: quoting, escaping, relocation and slices of sources."""

from __future__ import annotations

from pyspark.sql import functions as F


def quote_lisp(text: F.Column) -> F.Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def escape_xml(text: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encode_path(path: F.Column) -> F.Column:
    """A path as a directory name: URL encoding that leaves ~ alone."""
    return F.replace(F.url_encode(path), F.lit("%7E"), F.lit("~"))


def decode_path(name: F.Column) -> F.Column:
    return F.url_decode(name)


ROOT_MARK = "[[SBROOT]]"


def relocate(text: F.Column, root: str, everywhere: bool = True) -> F.Column:
    """The sandbox root by its mark, everywhere or only in front."""
    if everywhere:
        return F.replace(text, F.lit(root), F.lit(ROOT_MARK))
    return F.when(text.startswith(root), F.concat(F.lit(ROOT_MARK), F.substring(text, len(root) + 1, 1 << 30))).otherwise(text)


def restore(text: F.Column, root: str) -> F.Column:
    return F.replace(text, F.lit(ROOT_MARK), F.lit(root))


def relative(path: F.Column, root: str) -> F.Column:
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def source_slice(text: F.Column, start: F.Column, length: F.Column) -> F.Column:
    """Part of a line or file by byte offset (0-based) and byte length."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, length), "UTF-8")
