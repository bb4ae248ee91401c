"""Integer formulas over edge states, compiled to Column expressions.

A formula list is expressions between commas: numbers, ``e`` and an edge number,
``+ - * /``, a leading minus and parentheses.  Division cuts towards zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+)|e(\d+)|([-+*/(),]))")


class FormulaError(ValueError):
    """A formula that cannot be read."""


@dataclass(frozen=True)
class Formula:
    """One parsed expression: nested tuples (operator, operands)."""

    tree: tuple

    @property
    def edges(self) -> list[int]:
        """Edges it names, in order, each once."""
        found: set[int] = set()

        def walk(t: tuple) -> None:
            if t[0] == "edge":
                found.add(t[1])
            elif t[0] != "number":
                for x in t[1:]:
                    walk(x)

        walk(self.tree)
        return sorted(found)

    def column(self, edge: Callable[[int], Column]) -> Column:
        """The value as a long; ``edge`` gives an edge's 0 or 1."""

        def build(t: tuple) -> Column:
            if t[0] == "number":
                return F.lit(t[1]).cast("long")
            if t[0] == "edge":
                return edge(t[1]).cast("long")
            args = [build(x) for x in t[1:]]
            if t[0] == "neg":
                return -args[0]
            if t[0] == "/":
                return F.call_function("div", *args)
            return {"+": args[0] + args[1], "-": args[0] - args[1], "*": args[0] * args[1]}[t[0]]

        return build(self.tree)

    def sql(self, edge: Callable[[int], str]) -> str:
        """The value as SQL text, with ``//`` for division."""

        def build(t: tuple) -> str:
            if t[0] == "number":
                return str(t[1])
            if t[0] == "edge":
                return edge(t[1])
            args = [build(x) for x in t[1:]]
            return f"(-{args[0]})" if t[0] == "neg" else f"({args[0]} {'//' if t[0] == '/' else t[0]} {args[1]})"

        return build(self.tree)


def parse(text: str, edges: int) -> list[Formula]:
    """The formulas of a comma-separated list for a graph of so many edges."""
    tokens: list[tuple[str, int | str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"invalid character {text[at:].lstrip()[:1]!r}")
        if m[1] is not None:
            tokens.append(("number", int(m[1])))
        elif m[2] is not None:
            if int(m[2]) >= edges:
                raise FormulaError(f"edge {m[2]} is out of bounds")
            tokens.append(("edge", int(m[2])))
        else:
            tokens.append((m[3], m[3]))
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place][0] if place < len(tokens) else ""

    def take() -> tuple:
        nonlocal place
        if place == len(tokens):
            raise FormulaError("the formula ends too early")
        place += 1
        return tokens[place - 1]

    def operand() -> tuple:
        t = take()
        if t[0] in ("number", "edge"):
            return t
        if t[0] == "-":
            return ("neg", operand())
        if t[0] == "(":
            inner = expression(1)
            if take()[0] != ")":
                raise FormulaError("a parenthesis is not closed")
            return inner
        raise FormulaError(f"unexpected {t[1]!r}")

    rank = {"+": 1, "-": 1, "*": 2, "/": 2}

    def expression(least: int) -> tuple:
        left = operand()
        while rank.get(peek(), 0) >= least:
            op = take()[0]
            left = (op, left, expression(rank[op] + 1))
        return left

    out = [Formula(expression(1))]
    while peek() == ",":
        take()
        out.append(Formula(expression(1)))
    if place < len(tokens):
        raise FormulaError(f"unexpected {tokens[place][1]!r}")
    return out


def source(edges: int, *, function: str | None = None, function_file: str | None = None) -> list[Formula]:
    """Formulas from a text or a file, exactly one of which is given."""
    if (function is None) == (function_file is None):
        raise FormulaError("exactly one of a function and a function file is needed")
    if function_file is not None:
        with open(function_file, encoding="utf-8") as f:
            function = f.read()
    return parse(function, edges)
