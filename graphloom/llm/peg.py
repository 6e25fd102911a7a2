"""A small packrat engine for parsing-expression grammars over text.

An expression is a function (parser, position) -> end position or -1. Rules are memoised by (rule, position);
``Parser.commit`` drops the memo once no expression can look back, so memory stays bounded on long texts.
Repetition is iterative: no recursion grows with the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Expr = Callable[["Parser", int], int]


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.memo: dict[tuple[int, int], int] = {}

    def commit(self) -> None:
        if self.memo:
            self.memo.clear()


def rx(pattern: str, flags: int = re.IGNORECASE) -> Expr:
    """A terminal: the regular expression matches at the position."""
    match = re.compile(pattern, flags).match

    def terminal(p: Parser, at: int) -> int:
        m = match(p.text, at)
        return m.end() if m else -1

    return terminal


def seq(*parts: Expr) -> Expr:
    def sequence(p: Parser, at: int) -> int:
        for part in parts:
            at = part(p, at)
            if at < 0:
                return -1
        return at

    return sequence


def choice(*parts: Expr) -> Expr:
    def ordered(p: Parser, at: int) -> int:
        for part in parts:
            end = part(p, at)
            if end >= 0:
                return end
        return -1

    return ordered


def opt(part: Expr) -> Expr:
    def optional(p: Parser, at: int) -> int:
        end = part(p, at)
        return at if end < 0 else end

    return optional


def plus(part: Expr) -> Expr:
    def repeated(p: Parser, at: int) -> int:
        end = part(p, at)
        if end < 0:
            return -1
        while True:
            more = part(p, end)
            if more <= end:
                return end
            end = more

    return repeated


def rule(part: Expr) -> Expr:
    """A memoised expression."""
    key = id(part)

    def memoised(p: Parser, at: int) -> int:
        known = p.memo.get((key, at))
        if known is None:
            known = p.memo[(key, at)] = part(p, at)
        return known

    memoised.keep = part  # the key stays unique while the rule lives
    return memoised
