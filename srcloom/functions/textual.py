"""Text expressions whose results do not depend on an engine's regex dialect."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
TRIMMED = r"\s ﻿  "
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_WORD = r"[0-9A-Za-z_]"
#: A word character, or a group of alternatives that all begin (end) with one, that no quantifier makes optional.
_BEGINS = re.compile(rf"(?:{_WORD}|\((?:\?:)?{_WORD}[^()\[\]|]*(?:\|{_WORD}[^()\[\]|]*)*\))(?![?*{{])")
_ENDS = re.compile(rf"(?:(?<!\\){_WORD}|\((?:\?:)?(?:{_WORD}*\|)*{_WORD}+\))$")


@lru_cache(maxsize=None)
def ascii_pattern(pattern: str) -> str:
    r"""A pattern whose \b stands between ASCII word characters only; Java's own looks at Unicode.

    Where the pattern itself says that a word character comes next, or came before, only the other side is asked.
    """
    out, at = "", 0
    for m in re.finditer(r"(?<!\\)(?:\\\\)*(\\b)", pattern):
        before, after = pattern[: m.start(1)], pattern[m.end(1) :]
        begins = _BEGINS.match(after)
        surely = begins and not re.search(rf"(?:^\((?:\?:)?|\|){_WORD}[?*{{]", begins[0])
        side = r"(?<!\w)" if surely else r"(?!\w)" if _ENDS.search(before) else _BOUNDARY
        out, at = out + pattern[at : m.start(1)] + side, m.end(1)
    return out + pattern[at:]


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(ascii_pattern(pattern))


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(ascii_pattern(pattern)))


def group_of(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match."""
    return F.when(matches(x, pattern), F.regexp_extract(x, ascii_pattern(pattern), group))


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a pattern holds at least one; none where the pattern does not tell."""

    def best(*choices: tuple[str, ...]) -> tuple[str, ...]:
        return max(choices, key=lambda c: min(map(len, c), default=0), default=())

    def of(items) -> tuple[str, ...]:
        found, run = [], ""
        for kind, value in [*items, (None, None)]:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
                continue
            if run:
                found.append((run,))
            run = ""
            if name == "SUBPATTERN" and not value[1] & re.IGNORECASE:
                found.append(of(value[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                found.append(of(value[2]))
            elif name == "ATOMIC_GROUP":
                found.append(of(value))
            elif name == "BRANCH":
                each = [of(branch) for branch in value[1]]
                found.append(tuple(dict.fromkeys(x for branch in each for x in branch)) if all(each) else ())
        return best(*found)

    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return ()
    return () if parsed.state.flags & re.IGNORECASE else of(parsed)


def matches_holding(x: Column, pattern: str) -> Column:
    """matches, with the pattern tried only where a string stands that each of its matches holds."""
    strings = needed(pattern)
    if min(map(len, strings), default=0) < 2 or len(strings) > 12:
        return matches(x, pattern)
    return reduce(lambda a, b: a | b, [x.contains(w) for w in strings]) & matches(x, pattern)


def replaced(x: Column, holds: str, pattern: str, by: str) -> Column:
    """regexp_replace where x holds a string that every match of the pattern holds; other texts skip the pattern."""
    return F.when(x.contains(holds), F.regexp_replace(x, pattern, by)).otherwise(x)


def trim_start(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{TRIMMED}]+", "")


def trim_both(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{TRIMMED}]+|[{TRIMMED}]+$", "")


def spaced(pattern: str) -> str:
    r"""A pattern whose \s means all white space that trimming removes."""
    return pattern.replace(r"\s", f"[{TRIMMED}]")


def hundredths(x: Column) -> Column:
    """Rounded to two places, halves up, by the same steps in every engine."""
    return F.floor(x * 100 + 0.5) / 100


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


@lru_cache(maxsize=None)
def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: ** crosses folders, * and ? stay inside one, {a,b} are alternatives.

    A glob whose braces do not close stands for itself.
    """
    out, at, depth = "", 0, 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(.+/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = glob[at]
            at += 1
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "{":
                out, depth = out + "(?:", depth + 1
            elif c == "}" and depth:
                out, depth = out + ")", depth - 1
            elif c == "," and depth:
                out += "|"
            else:
                out += re.escape(c) if not c.isalnum() and c != "_" else c
    return f"^{out}$" if not depth else f"^{re.escape(glob)}$"


def any_glob(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    """Whether a glob matches the path or its base name."""
    if not globs:
        return F.lit(False)
    joined = "|".join(f"(?:{glob_pattern(g)})" for g in globs)
    return path.rlike(joined) | base_name(path).rlike(joined)
