"""Compile linear-time regex dialect patterns to the JVM regex Spark uses."""

from __future__ import annotations

import re
from re import _parser
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# A control character that separates captured groups inside one replace result.
GROUP_SEP = "\x01"

# the parser folds equal arms of an alternative, so they are looked for in the text
_EQUAL_ARMS = re.compile(r"[(|]([^()|]+)\|(?:[^()|]*\|)*\1(?=[|)])")
_NAMED_GROUP = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_POSIX_CLASS = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "digit": r"\d",
    "lower": r"\p{Lower}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}


class UnsafePattern(ValueError):
    """The pattern could backtrack without bound."""


def ambiguous(pattern: str) -> bool:
    """Whether some unbounded repeat can split a text between its rounds in more than one way.

    Judged on the parsed pattern: a body that repeats without bound inside must also hold something that has to stand
    beside that, and its alternatives must not begin alike. Patterns that this parser does not know are left to the JVM.
    """
    if _EQUAL_ARMS.search(pattern):
        return True
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return any(_loose(body) for body in _repeated(tree))


def _unbounded(op: object, arg: tuple) -> bool:
    return op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[1] == _parser.MAXREPEAT


def _children(op: object, arg: object) -> list:
    """Sub-patterns of a node."""
    if op is _parser.SUBPATTERN:
        return [arg[-1]]
    if op is _parser.BRANCH:
        return list(arg[1])
    if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT):
        return [arg[2]]
    return [arg[1]] if op in (_parser.ASSERT, _parser.ASSERT_NOT) else []


def _repeated(tree: list) -> list:
    """Bodies of all unbounded repeats."""
    out = []
    for op, arg in tree:
        if _unbounded(op, arg):
            out.append(arg[2])
        for child in _children(op, arg):
            out += _repeated(child)
    return out


def _loose(body: list) -> bool:
    """Whether a body holds an unbounded repeat and nothing that must stand beside it, or alternatives that begin alike."""
    loose, fixed = False, False
    for op, arg in body:
        if _unbounded(op, arg):
            loose = True
        elif op is _parser.SUBPATTERN:
            loose, fixed = (True, fixed) if _loose(arg[-1]) else (loose, True)
        elif op is _parser.BRANCH:
            heads = [str(list(b)[:1]) for b in arg[1]]
            again = len(set(heads)) < len(heads) or any(_loose(b) for b in arg[1])
            loose, fixed = (True, fixed) if again else (loose, True)
        elif op is not _parser.AT and not (op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] == 0):
            fixed = True
    return loose and not fixed


@dataclass(frozen=True)
class JavaPattern:
    pattern: str  # JVM syntax, groups made positional
    names: tuple[str | None, ...]  # one entry per capture group

    @property
    def body(self) -> str:
        # (?d): "." stops at \n only, as in the source dialect
        return f"(?d:{self.pattern})"


def to_java(pattern: str) -> JavaPattern:
    """Translate syntax differences: named groups, `$` at end of text, POSIX classes."""
    if ambiguous(pattern):
        raise UnsafePattern(f"a repeated part of {pattern!r} can match the same text in several ways")
    out: list[str] = []
    names: list[str | None] = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if posix and posix.group(2) in _POSIX_CLASS:
                word = _POSIX_CLASS[posix.group(2)]
                if posix.group(1):
                    word = word[0] + (word[1].swapcase()) + word[2:]
                out.append(word)
                i += posix.end()
                continue
            # a bare "[" or "&&" inside a class has set meaning on the JVM only
            out.append("\\[" if ch == "[" else "\\&" if ch == "&" else ch)
            in_class = ch != "]"
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            while i < len(pattern) and pattern[i] in "^]":
                out.append("\\]" if pattern[i] == "]" else "^")
                i += 1
                if pattern[i - 1] == "]":
                    break
            continue
        named = _NAMED_GROUP.match(pattern, i)
        if named:
            names.append(named.group(1))
            out.append("(")
            i = named.end()
            continue
        if ch == "(" and pattern[i + 1 : i + 2] != "?":
            names.append(None)
        if ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    return JavaPattern("".join(out), tuple(names))


def quote(literal: str) -> str:
    """Escape a literal for the JVM regex."""
    return re.sub(r"([\\.^$|?*+()\[\]{}&#~\-])", r"\\\1", literal)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(to_java(pattern).body)


def capture_all(col: Column, java: JavaPattern) -> Column:
    """All groups of the first match as `[prefix, g1, g2, …]`; one element when nothing matched.

    One replace pass finds the match and every group. Text that itself holds the
    separator takes the group-by-group route, so results are exact for any input.
    """
    n = len(java.names)
    anchored = rf"\A(?s:.*?){java.body}(?s:.*)\z"
    template = "".join(f"{GROUP_SEP}${i}" for i in range(1, n + 1)) or GROUP_SEP
    fast = F.split(F.regexp_replace(col, anchored, template), GROUP_SEP, -1)
    slow = F.when(
        col.rlike(java.body),
        F.array(F.lit(""), *[F.regexp_extract(col, java.body, i) for i in range(1, n + 1)])
        if n
        else F.array(F.lit(""), F.lit("")),
    ).otherwise(F.array(col))
    return F.when(col.contains(GROUP_SEP), slow).otherwise(fast)


def java_replacement(template: str, names: tuple[str | None, ...]) -> str:
    """Rewrite `$name`, `${name}`, `$1x` replacement references to numbered ones."""
    index = {name: i + 1 for i, name in enumerate(names) if name}

    def ref(name: str) -> str:
        number = int(name) if name.isdigit() else index.get(name)
        if number is None or number > len(names):
            return ""
        return f"${number}"

    out, i = [], 0
    while i < len(template):
        ch = template[i]
        if ch == "\\":
            out.append("\\\\")
            i += 1
        elif ch == "$":
            if template[i + 1 : i + 2] == "$":
                out.append("\\$")
                i += 2
                continue
            m = re.match(r"\$(?:\{(\w+)\}|(\w+))", template[i:])
            if not m:
                out.append("\\$")
                i += 1
                continue
            number = ref(m.group(1) or m.group(2))
            tail = template[i + m.end() : i + m.end() + 1]
            # a literal digit after the reference must not extend the group number
            out.append(number + ("\\" if number and tail.isdigit() else ""))
            i += m.end()
        else:
            out.append(ch)
            i += 1
    return "".join(out)
