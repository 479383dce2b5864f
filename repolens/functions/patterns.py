"""Globs and regular expressions, as Java patterns for ``rlike``.

Globs: ``*`` and ``?`` also match ``/``; ``**/`` matches any number of directories, none
included; ``[a-z]``, ``[!x]`` and ``{a,b}`` work; a backslash escapes. A glob matches the whole path.

Regular expressions are those of a linear-time engine: look-around and back references
are refused. Classes are Unicode's, and only a line feed ends a line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column


def glob_to_regex(glob: str) -> str:
    """The pattern of a glob, anchored at both ends."""
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(glob[i]))
        elif glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 2
        elif c == "*":
            while i + 1 < n and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            stop = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if stop < 0:
                raise ValueError(f"no end of the class in glob {glob!r}")
            body = glob[i + 1 : stop]
            negate = body[:1] in ("!", "^")
            out.append("[" + "^" * negate + re.sub(r"([\\\[\]&^])", r"\\\1", body[negate:]) + "]")
            i = stop
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"no end of the alternatives in glob {glob!r}")
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def glob_key(glob: str, most: int, inside: int) -> tuple[str, str]:
    """(place, text) that every match of a glob has: at its end, its start, or inside; ``any`` and no text if it needs none.

    The longest such text, as it tells most: at most ``most`` characters at an end, ``inside`` of them within. What stands in alternatives isn't needed.
    """
    pieces, i, depth = [""], 0, 0
    while i < len(glob):
        c, gap = glob[i], True
        if c == "\\" and i + 1 < len(glob):
            i += 1
            c, gap = glob[i], depth > 0
        elif glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            i += 2
        elif c == "[":
            i = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
        elif c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
        elif c not in "*?":
            gap = depth > 0
        if gap:
            pieces.append("")
        else:
            pieces[-1] += c
        i += 1
    found = [("end", pieces[-1][-most:]), ("start", pieces[0][:most]), ("inside", max(pieces, key=len)[:inside])]
    place, key = max(found, key=lambda f: len(f[1]))
    return (place, key) if key else ("any", "")


def glob_matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_to_regex(glob))


_UNSUPPORTED = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+)")


def line_regex(pattern: str) -> str:
    """The Java pattern for searching one line."""
    if _UNSUPPORTED.search(pattern):
        raise ValueError(f"look-around, back references and possessive repeats aren't supported: {pattern!r}")
    return "(?Ud)" + pattern
