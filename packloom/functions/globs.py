"""Glob text to Java regular expressions, and comma-separated pattern lists.

Two dialects: include/exclude globs, where ``*`` and ``?`` cross ``/``, and ignore-file
globs, where they stop at ``/`` and a backslash escapes the next character.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Unicode defines it (a Java and RE2 character class body); \s alone means less.
SPACES = r"\t\n\x0B\f\r\x{85}\p{Z}"
STRIPPED = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_ANYTHING = re.compile(r"(?:\*\*/)*\*\*(?=$|[,}])")  # the whole glob, or a whole branch of it
_ANY_PARENTS = re.compile(r"(?:\*\*/)+")
_ALL_BELOW = re.compile(r"(?:/\*\*)+(?=$|[,}])")
_ANY_BETWEEN = re.compile(r"(?:/\*\*)+/")
_STARS = re.compile(r"\*+")
_TO_BRANCH_END = (_ANYTHING, _ALL_BELOW)
_CLASS = re.compile(r"\[([!^]?)(\]?[^\]]*)\]")


class GlobError(ValueError):
    """A glob that cannot be compiled; the message names the pattern as the user wrote it."""


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c for c in text)


def _class_regex(negation: str, members: str) -> str:
    out, i = [], 0
    while i < len(members):
        if i + 2 < len(members) and members[i + 1] == "-":
            low, high = members[i], members[i + 2]
            if low > high:
                raise ValueError(f"invalid range {low}-{high}")
            out.append(f"{_quote(low)}-{_quote(high)}")
            i += 3
        else:
            out.append("/" if members[i] == "/" else _quote(members[i]))
            i += 1
    return f"[{'^' if negation else ''}{''.join(out)}]"


def glob_body(glob: str, crosses_slash: bool = True) -> str:
    """Unanchored regex for ``glob``; raises ValueError when it is malformed."""
    star, single = (".*", ".") if crosses_slash else ("[^/]*", "[^/]")
    branch, open_groups = "", []  # regex so far, and (text before, finished branches) per open brace
    finished: list[str] = []
    i = 0
    while i < len(glob):
        starts_branch = branch == "" and (i == 0 or glob[i - 1] in "{,")
        step = None
        for pattern, piece, allowed in (
            (_ANYTHING, ".*", starts_branch),
            (_ANY_PARENTS, "(?:/?|.*/)", starts_branch),
            (_ALL_BELOW, "/.*", True),
            (_ANY_BETWEEN, "(?:/|/.*/)", True),
            (_STARS, star, True),
        ):
            step = allowed and pattern.match(glob, i)
            if step and pattern in _TO_BRANCH_END and not open_groups and step.end() < len(glob):
                step = None  # outside braces only the end of the glob ends a branch
            if step:
                branch += piece
                break
        if step:
            i = step.end()
            continue
        char = glob[i]
        i += 1
        if char == "?":
            branch += single
        elif char == "[":
            found = _CLASS.match(glob, i - 1)
            if not found or not found.group(2):
                raise ValueError("unclosed character class")
            branch += _class_regex(*found.groups())
            i = found.end()
        elif char == "{":
            open_groups.append((branch, finished))
            branch, finished = "", []
        elif char == "," and open_groups:
            finished.append(branch)
            branch = ""
        elif char == "}":
            if not open_groups:
                raise ValueError("unopened alternation")
            choices = "|".join(b for b in [*finished, branch] if b)
            before, finished = open_groups.pop()
            branch = before + (f"(?:{choices})" if choices else "")
        elif char == "\\":
            if i == len(glob):
                raise ValueError("dangling escape")
            branch += _quote(glob[i])
            i += 1
        else:
            branch += _quote(char)
    if open_groups:
        raise ValueError("unclosed alternation")
    return branch


def whole(body: str, ignore_case: bool = False) -> str:
    return f"(?{'is' if ignore_case else 's'})\\A(?:{body})\\z"


def split_patterns(csv: str | None) -> list[tuple[str, list[str]]]:
    """``(pattern as written, globs it stands for)`` in list order; see :func:`pattern_list`."""
    out = []
    for piece in (csv or "").split(","):
        raw = piece.strip(STRIPPED).replace("\\", "/")
        if not raw:
            continue
        if not any(c in raw for c in "/*."):
            out.append((raw, [f"**/{raw}", f"**/{raw}/**"]))
        else:
            out.append((raw, [raw + "**" if raw.endswith("/") else raw]))
    return out


def compile_patterns(csv: str | None) -> list[tuple[str, str]]:
    """``(pattern as written, regex body)`` in list order; a bad glob raises GlobError."""
    rules = []
    for raw, globs in split_patterns(csv):
        try:
            rules.append((raw, "|".join(glob_body(g) for g in globs)))
        except ValueError as error:
            raise GlobError(f"Invalid glob pattern '{raw}': {error}") from None
    return rules


# A schema object, since a type given as text needs a running session at import.
COMPILED = (
    T.StructType().add("error", "string").add("raws", T.ArrayType(T.StringType()))
    .add("regexes", T.ArrayType(T.StringType())).add("any_regex", "string"))


@F.pandas_udf(COMPILED)
def compiled_patterns(csv: pd.Series) -> pd.DataFrame:
    """Compile pattern lists held in a column; a bad list becomes an error text, not a failure."""
    rows = []
    for text in csv:
        try:
            rules = compile_patterns(text)
            rows.append((None, [r for r, _ in rules], [whole(b) for _, b in rules],
                         whole("|".join(f"({b})" for _, b in rules)) if rules else None))
        except GlobError as error:
            rows.append((str(error), [], [], None))
    return pd.DataFrame(rows, columns=["error", "raws", "regexes", "any_regex"])


def pattern_list(csv: Column) -> Column:
    """Patterns of a comma-separated list, trimmed, with ``/`` for ``\\``; empty pieces dropped."""
    trimmed = lambda p: F.regexp_replace(p, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")
    return F.filter(
        F.transform(F.split(csv, ","), lambda p: F.translate(trimmed(p), "\\", "/")),
        lambda p: p != "",
    )


def pattern_globs(raw: Column) -> Column:
    """Globs one pattern stands for: a simple name means that name and all below it, anywhere."""
    return (
        F.when(~raw.rlike(r"[/*.]"), F.array(F.concat(F.lit("**/"), raw), F.concat(F.lit("**/"), raw, F.lit("/**"))))
        .when(raw.endswith("/"), F.array(F.concat(raw, F.lit("**"))))
        .otherwise(F.array(raw))
    )
