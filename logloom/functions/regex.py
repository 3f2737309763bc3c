"""Patterns in RE2's dialect, which rules are written in, for the JVM's regex engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def re2(pattern: str) -> str:
    """``$`` is the end of the text only; white space has no vertical tab; without lookaround or backreferences nothing else differs."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out.append("\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]")
            i += 2
        elif two == "\\S" and not in_class:
            out.append("[^\\t\\n\\f\\r ]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            c = pattern[i]
            if c == "[" and not in_class:
                in_class = True
                out.append(c)
                if pattern[i + 1 : i + 2] == "^":
                    out.append("^")
                    i += 1
            elif c == "[" and in_class:
                out.append("\\[")
            elif c == "]" and in_class:
                in_class = False
                out.append(c)
            elif c == "$" and not in_class:
                out.append("\\z")
            else:
                out.append(c)
            i += 1
    return "".join(out)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(re2(pattern))


def replace(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, re2(pattern), by)


def extract(col: Column, pattern: str, group: int) -> Column:
    """The group of the first match; '' without a match (guard with ``matches`` to tell them apart)."""
    return F.regexp_extract(col, re2(pattern), group)


def count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(re2(pattern)))
