"""Column functions on relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters that path escaping spells out as code points.
_RARE = "[\\x00-\\x1F\\x7F-\\x9F]"


def path_order(rel_path: Column) -> Column:
    """Key whose plain string order is component-wise path order.

    NUL cannot occur in a path and sorts before every other byte, so ``a/b`` comes before
    ``a-b/x``; a string key also sorts much faster than an array of components.
    """
    return F.replace(rel_path, F.lit("/"), F.lit("\0"))


def file_name(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1)


def parent_dir(rel_path: Column) -> Column:
    """Directory part of the path, ``''`` at the top level."""
    return F.substring(rel_path, F.lit(1), F.length(rel_path) - F.length(file_name(rel_path)) - 1)


def prefixes(rel_path: Column, with_self: bool = True) -> Column:
    """Array of the path's ancestors from the top level down, by default ending in itself."""
    parts = F.split(rel_path, "/")
    upto = F.size(parts) - (0 if with_self else 1)
    steps = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.call_function("substring_index", rel_path, F.lit("/"), k))


def depth(rel_path: Column) -> Column:
    """Number of components; 0 for the root itself."""
    slashes = F.length(rel_path) - F.length(F.translate(rel_path, "/", ""))
    return F.when(rel_path == "", 0).otherwise(slashes + 1)


def below(rel_path: Column, base_dir: Column) -> Column:
    """``rel_path`` as seen from its ancestor ``base_dir`` (``''`` is the root)."""
    return F.when(base_dir == "", rel_path).otherwise(F.substring(rel_path, F.length(base_dir) + 2, F.length(rel_path)))


def normalized(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes; a result starting with ``..`` leaves the root."""
    last = lambda done: F.element_at(done, -1)
    step = lambda done, part: (
        F.when(part.isin("", "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.when(F.size(done) > 0, last(done)) != ".."),
              F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def escape_path(rel_path: Column) -> Column:
    """Path as it appears inside the opening line of a framed file."""
    text = rel_path
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                           ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    spelled = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike(_RARE), F.concat(F.lit("\\u{"), F.hex(F.ascii(c)), F.lit("}"))).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(_RARE), spelled).otherwise(text)


def link_escapes(link_target: Column, root: Column) -> Column:
    """True for a link whose resolved target is outside the root; an empty target is a dead link."""
    inside = (link_target == root) | F.startswith(link_target, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    return F.coalesce(~inside, F.lit(False))
