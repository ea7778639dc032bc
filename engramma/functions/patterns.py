"""Search patterns as request values: what is a pattern at all, and how it is written for the JVM."""

from __future__ import annotations

import re
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}|\{,\d+\}")


def respelled(pattern: str) -> str | None:
    """A pattern in the JVM's notation, None where it is none: named groups and their references, the end of the text, plain
    braces and brackets inside a class are written otherwise there."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    out, i, in_class, first = [], 0, False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            out.append({"\\Z": "\\z"}.get(two, two))
            i += 2
            continue
        if in_class:
            if c == "]" and i > first:
                in_class = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[]&" else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            first = i
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif m := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(f"\\k<{m.group(1)}>")
            i += m.end()
        elif c == "{" and (m := _QUANTIFIER.match(pattern, i)):
            out.append(m.group().replace("{,", "{0,"))
            i = m.end()
        else:
            out.append("\\" + c if c in "{}" else c)
            i += 1
    return "".join(out)


def usable(pattern: Column) -> Column:
    """The pattern in the JVM's notation, null where it is no pattern. Requests are few; this never runs over texts."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else respelled(p))

    return F.pandas_udf(each, StringType())(pattern)
