"""Conditions on a text that render as a Spark column and as DuckDB SQL, and sums of points over them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, reduce
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
_START, _END = f"(?<!{_WORD})", f"(?!{_WORD})"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _alternatives(pattern: str, at: int, step: int) -> list[str]:
    """The alternatives of the group that opens (step 1) or closes (step -1) here; else the neighbouring text."""
    if not 0 <= at < len(pattern):
        return [""]
    if pattern[at] != ("(" if step > 0 else ")"):
        return [pattern[at:] if step > 0 else pattern[: at + 1]]
    depth, k = 0, at
    while 0 <= k < len(pattern):
        escaped = k > 0 and pattern[k - 1] == "\\"
        if not escaped and pattern[k] in "()":
            depth += 1 if (pattern[k] == "(") == (step > 0) else -1
            if not depth:
                break
        k += step
    inner = pattern[at + 1 : k] if step > 0 else pattern[k + 1 : at]
    inner = inner.removeprefix("?:")
    return inner.split("|") if "(" not in inner and "[" not in inner else [""]


def _begins(text: str) -> bool:
    """It can only begin with an ASCII letter or digit."""
    return bool(re.match(r"[A-Za-z0-9_](?![?*])|\\d", text))


def _ends(text: str) -> bool:
    """It can only end with one."""
    return bool(re.search(r"(?<!\\)[A-Za-z0-9_]\Z|[A-Za-z0-9_][A-Za-z0-9_]\?\Z", text))


def java_pattern(pattern: str, fold: bool = False) -> str:
    """The pattern for the JVM: ASCII word edges, case folded beyond ASCII, $ at the very end only.

    Where a word can only begin or end at an edge, it is half the look-around, and faster.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            edge = pattern[i + 1] == "b" and not in_class
            if edge:
                after, before = _alternatives(pattern, i + 2, 1), _alternatives(pattern, i - 1, -1)
                out.append(_START if all(map(_begins, after)) else _END if all(map(_ends, before)) else _EDGE)
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return (("(?i)" if pattern.isascii() else "(?iu)") if fold else "") + "".join(out)


def _once(pattern: str) -> str:
    """The pattern without the repetition of a group at its end: it is found in the same texts.

    The JVM's matcher goes one level deeper for each repetition of a group and overflows its stack on long runs.
    """
    return re.sub(r"(?<!\\)\)(?:\+|\{1,\})\Z", ")", re.sub(r"\(\?:[^()|]*\)\*\Z", "", pattern))


@cache
def required(pattern: str, least: int = 3) -> frozenset[str]:
    """Strings of `least` characters or more one of which every match has in it; none if there aren't such.

    Looking for them first is much faster than the pattern.
    """

    def of(parts) -> frozenset[str]:
        options: list[frozenset[str]] = []
        run = ""
        for op, arg in [*parts, (None, None)]:
            if op is parser.LITERAL:
                run += chr(arg)
                continue
            options.append(frozenset([run]) if run else frozenset())
            run = ""
            if op is parser.SUBPATTERN:
                options.append(of(arg[-1]))
            elif op is parser.MAX_REPEAT and arg[0] >= 1:
                options.append(of(arg[2]))
            elif op is parser.BRANCH:
                each = [of(x) for x in arg[1]]
                options.append(frozenset().union(*each) if all(each) else frozenset())
        fit = [o for o in options if o and min(map(len, o)) >= least]
        return max(fit, key=lambda o: (min(map(len, o)), -len(o)), default=frozenset())

    return of(parser.parse(pattern))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return Both(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Either(self, other)

    def __invert__(self) -> Condition:
        return Not(self)

    def column(self, text: Column, lower: Column | None = None) -> Column:
        """lower: the text in lower case, if there is a column of it; it saves making it for each pattern."""
        raise NotImplementedError

    def sql(self, text: str) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Has(Condition):
    """The pattern is found in the text."""

    pattern: str
    fold: bool = False

    def column(self, text: Column, lower: Column | None = None) -> Column:
        found = text.rlike(java_pattern(_once(self.pattern), self.fold))
        needed = required(self.pattern)
        if not needed:
            return found
        where = (F.lower(text) if lower is None else lower) if self.fold else text
        some = [F.contains(where, F.lit(x.lower() if self.fold else x)) for x in sorted(needed)]
        return reduce(lambda a, b: a | b, some) & found

    def sql(self, text: str) -> str:
        return f"regexp_matches({text}, {quoted(self.pattern)}, {quoted('i' if self.fold else 'c')})"


@dataclass(frozen=True)
class Longer(Condition):
    """The text has more characters than n."""

    n: int

    def column(self, text: Column, lower: Column | None = None) -> Column:
        return F.length(text) > self.n

    def sql(self, text: str) -> str:
        return f"length({text}) > {self.n}"


@dataclass(frozen=True)
class Shorter(Condition):
    n: int

    def column(self, text: Column, lower: Column | None = None) -> Column:
        return F.length(text) < self.n

    def sql(self, text: str) -> str:
        return f"length({text}) < {self.n}"


@dataclass(frozen=True)
class Both(Condition):
    a: Condition
    b: Condition

    def column(self, text: Column, lower: Column | None = None) -> Column:
        return self.a.column(text, lower) & self.b.column(text, lower)

    def sql(self, text: str) -> str:
        return f"({self.a.sql(text)} AND {self.b.sql(text)})"


@dataclass(frozen=True)
class Either(Condition):
    a: Condition
    b: Condition

    def column(self, text: Column, lower: Column | None = None) -> Column:
        return self.a.column(text, lower) | self.b.column(text, lower)

    def sql(self, text: str) -> str:
        return f"({self.a.sql(text)} OR {self.b.sql(text)})"


@dataclass(frozen=True)
class Not(Condition):
    a: Condition

    def column(self, text: Column, lower: Column | None = None) -> Column:
        return ~self.a.column(text, lower)

    def sql(self, text: str) -> str:
        return f"(NOT {self.a.sql(text)})"


def any_of(conditions: Sequence[Condition]) -> Condition:
    return reduce(Either, conditions)


Points = Sequence[tuple[float, Condition]]


def total(points: Points, text: Column, lower: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c.column(text, lower), F.lit(p)).otherwise(F.lit(type(p)(0))) for p, c in points))


def total_sql(points: Points, text: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c.sql(text)} THEN {p} ELSE {type(p)(0)} END" for p, c in points) + ")"


def first_match(named: Sequence[tuple[str, Condition]], text: Column, lower: Column | None = None) -> Column:
    """The name of the first condition that holds, or null."""
    return F.coalesce(*[F.when(c.column(text, lower), name) for name, c in named])


def first_match_sql(named: Sequence[tuple[str, Condition]], text: str) -> str:
    return "CASE " + " ".join(f"WHEN {c.sql(text)} THEN {quoted(name)}" for name, c in named) + " END"


def plain_pattern(pattern: str, fold: bool = False) -> re.Pattern:
    """The pattern for Python, for tests."""
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if fold else 0))
