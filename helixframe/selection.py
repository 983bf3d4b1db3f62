"""Selection expressions over tag arrays: `tag`, `[e]`, `-e`, `a:b` and, `a/b` or, `a^b` xor, left to right without precedence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\[\]:/^-]|[^\[\]:/^-]+")


def split_name(spec: str) -> tuple[str, str]:
    """P10: (expression, name) of spec=name; the name defaults to the expression."""
    expression, _, name = spec.partition("=")
    return expression, name or expression


def selects(expression: str, tags: Column) -> Column:
    """Whether rows with these tags are selected; empty selects none, `all` all."""
    tokens = TOKEN.findall(expression)
    if not tokens:
        return F.lit(False)
    found, at = _expression(tokens, 0, tags)
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {expression!r}")
    return found


def _term(tokens: list[str], at: int, tags: Column) -> tuple[Column, int]:
    if at >= len(tokens):
        raise ValueError("selection ends early")
    token = tokens[at]
    if token == "-":
        found, at = _term(tokens, at + 1, tags)
        return ~found, at
    if token == "[":
        found, at = _expression(tokens, at + 1, tags)
        if at >= len(tokens) or tokens[at] != "]":
            raise ValueError("missing ]")
        return found, at + 1
    if token in "]:/^":
        raise ValueError(f"unexpected {token!r}")
    return (F.lit(True) if token == "all" else F.coalesce(F.array_contains(tags, token), F.lit(False))), at + 1


def _expression(tokens: list[str], at: int, tags: Column) -> tuple[Column, int]:
    found, at = _term(tokens, at, tags)
    while at < len(tokens) and tokens[at] in ":/^":
        op = tokens[at]
        other, at = _term(tokens, at + 1, tags)
        found = {":": found & other, "/": found | other, "^": found != other}[op]
    return found, at


def weight(expression: str, tags: Column) -> Column:
    """The sum of the weights of the matching parts of `{w}expr,...`; a part without one weighs 1."""
    total = F.lit(0.0)
    for part in filter(None, expression.split(",")):
        match = re.match(r"\{([^}]*)\}(.*)", part)
        value, inner = (float(match[1]), match[2]) if match else (1.0, part)
        total = total + F.when(selects(inner, tags), value).otherwise(0.0)
    return total


def order(expression: str, tags: Column, position: Column) -> list[Column]:
    """Sort keys that put matches of each part first, in the order of the parts, then by position."""
    return [*[F.when(selects(part, tags), 0).otherwise(1).asc() for part in filter(None, expression.split(","))], position.asc()]
