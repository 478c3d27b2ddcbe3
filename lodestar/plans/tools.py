"""The nine tools of a language-model client: commands with bounded answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestar.plans.commands import CodeBase

#: Most rows of an answer, and of a completion's.
MOST, MOST_COMPLETIONS = 100, 50


def tools(code: CodeBase) -> dict[str, Callable[..., DataFrame]]:
    """Each tool by its name; ``most`` overrides the bound."""

    def bounded(f: Callable[..., DataFrame], n: int = MOST) -> Callable[..., DataFrame]:
        return lambda *a, most=n, **k: f(*a, **k).limit(most)

    return {
        "symbol_info": bounded(lambda file_id, line, col: code.symbol_info(file_id, (line, col))),
        "follow_location": bounded(code.follow_location),
        "references": bounded(code.references),
        "references_by_name": bounded(code.references_by_name),
        "find_symbols": bounded(code.find_symbols),
        "list_symbols": bounded(code.list_symbols),
        "code_complete": lambda prefix, most=MOST_COMPLETIONS: code.complete(prefix, most),
        "class_hierarchy": bounded(code.class_hierarchy),
        "diagnose": bounded(code.diagnose),
    }
