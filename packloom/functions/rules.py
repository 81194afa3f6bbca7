"""Rules on one path as column expressions: pattern lists, blacklist, size limit.

Rule sets come in two forms with the same two questions, ``first_match`` and ``matches``:
literals (folded into the expression) and columns (one compiled list per row, for projects
that each bring their own rules).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom import fixed_values
from packloom.functions.globs import compile_patterns, glob_body, whole

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONGEST = 2**63 - 1


class LiteralRules:
    """A pattern list known when the query is built; a bad glob raises here, before any job."""

    def __init__(self, csv: str | None):
        self.rules = compile_patterns(csv)

    def is_set(self) -> Column:
        return F.lit(bool(self.rules))

    def matches(self, path: Column) -> Column:
        return path.rlike(whole("|".join(body for _, body in self.rules))) if self.rules else F.lit(False)

    def first_match(self, path: Column) -> Column:
        if not self.rules:
            return F.lit(None).cast("string")
        each = [F.when(path.rlike(whole(body)), F.lit(raw)) for raw, body in self.rules]
        return each[0] if len(each) == 1 else F.when(self.matches(path), F.coalesce(*each))

    def text(self) -> Column:
        return F.lit(",".join(raw for raw, _ in self.rules))


class ColumnRules:
    """A compiled pattern list held in a struct column (see ``globs.compiled_patterns``)."""

    def __init__(self, compiled: Column):
        self.raws, self.regexes = compiled["raws"], compiled["regexes"]
        self.any_regex = compiled["any_regex"]

    def is_set(self) -> Column:
        return self.any_regex.isNotNull()

    def matches(self, path: Column) -> Column:
        return F.coalesce(column_rlike(path, self.any_regex), F.lit(False))

    def first_match(self, path: Column) -> Column:
        # One group per rule in one regex, which stays compiled; the group that took the path names the rule.
        taken = F.filter(self.raws, lambda _, i: F.call_function("regexp_extract", path, self.any_regex, i + 1) == path)
        of_root = F.filter(self.raws, lambda _, i: F.rlike(path, F.get(self.regexes, i)))
        return F.when(self.matches(path), F.get(F.when(path == "", of_root).otherwise(taken), F.lit(0)))

    def text(self) -> Column:
        return F.array_join(self.raws, ",")


def column_rlike(text: Column, regex: Column) -> Column:
    """Whether an anchored regex column matches the text.

    ``regexp_extract`` keeps the compiled pattern while consecutive rows repeat it, which rows
    joined to their project's rules do; ``rlike`` with a column pattern compiles it every row.
    """
    found = F.call_function("regexp_extract", text, regex, F.lit(0)) == text
    return F.when(text == "", F.rlike(text, regex)).otherwise(found)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


_COMPONENTS = {name.lower(): name for name in fixed_values.BLACKLIST_COMPONENTS}
_COMPONENT = rf"(?:\A|/)({'|'.join(name.replace('.', chr(92) + '.') for name in _COMPONENTS)})(?=/|\z)"


def _pattern_regex(globs: list[str]) -> str:
    """The globs on the whole path, or on the file name (where they find no slash to cross)."""
    on_path = "|".join(map(glob_body, globs))
    on_name = "|".join(glob_body(g, crosses_slash=False) for g in globs)
    return whole(f"{on_path}|.*/(?:{on_name})", ignore_case=True)


def blacklist_component(path: Column) -> Column:
    """Canonical name of the first component on the blacklist, else null."""
    found = F.regexp_extract(ascii_lower(path), _COMPONENT, 1)
    canonical = F.create_map(*[F.lit(x) for pair in _COMPONENTS.items() for x in pair])
    return F.when(found != "", F.element_at(canonical, found))


def blacklist_pattern(path: Column, more: tuple[str, ...] = ()) -> Column:
    """First blacklist glob, or one of ``more``, that matches the whole path or the file name, else null."""
    globs = [*fixed_values.BLACKLIST_PATTERNS, *more]
    return F.coalesce(*[F.when(path.rlike(_pattern_regex([g])), F.lit(g)) for g in globs])


def blacklisted(path: Column, more: tuple[str, ...] = ()) -> Column:
    return ascii_lower(path).rlike(_COMPONENT) | path.rlike(_pattern_regex([*fixed_values.BLACKLIST_PATTERNS, *more]))


def filter_code(path: Column, include, exclude, no_blacklist: Column, more: tuple[str, ...] = ()) -> Column:
    """blacklist, exclude, include or included, in that order; exclude always wins over include."""
    return (
        F.when(~no_blacklist & blacklisted(path, more), "blacklist")
        .when(exclude.matches(path), "exclude")
        .when(include.is_set() & ~include.matches(path), "include")
        .otherwise("included")
    )


def filter_rule(code: Column, path: Column, include, exclude, more: tuple[str, ...] = ()) -> Column:
    """The rule behind a filter code; worked out only for rows that have such a code."""
    return (
        F.when(code == "blacklist", F.coalesce(blacklist_component(path), blacklist_pattern(path, more)))
        .when(code == "exclude", exclude.first_match(path))
        .when(code == "include", include.text())
    )


def max_bytes(max_kib: Column) -> Column:
    """Size limit in bytes; a limit beyond the number range is no limit."""
    return F.when(max_kib > _LONGEST // 1024, F.lit(_LONGEST)).otherwise(max_kib.cast("bigint") * 1024)


def too_large(length: Column, max_kib: Column) -> Column:
    return F.coalesce(length > max_bytes(max_kib), F.lit(False))

