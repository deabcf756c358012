"""Column functions on paths, addresses, lines and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter of each action of a change.
ACTION_LETTERS = {"Add": "A", "Delete": "D", "Move": "V", "Copy": "C", "Graft": "G", "Keep": "M"}


def name(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def root(path: Column) -> Column:
    """First part of a path."""
    return F.substring_index(path, "/", 1)


def parent(path: Column) -> Column:
    """A path without its last part; null for a path of one part."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def remote_url(url: Column) -> Column:
    """An address without scheme and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "^.*?://", "")


def moved(path: Column, old: str, new: str) -> Column:
    """``path`` after the subtree ``old`` became ``new``; other paths stay."""
    inside = (path == old) | F.startswith(path, F.lit(f"{old}/"))
    return F.when(inside, F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def below(path: Column, top: str) -> Column:
    """Whether ``path`` is ``top`` or lies in its subtree."""
    return (path == top) | F.startswith(path, F.lit(f"{top}/"))


def collapse_blanks(text: Column) -> Column:
    """Runs of space, tab and carriage return as one space."""
    return F.regexp_replace(text, "[ \t\r]+", " ")


def bucket(value: Column, size: int) -> Column:
    """``value`` rounded up to a multiple of ``size``."""
    if size <= 0:
        raise ValueError("a bucket's size is above 0")
    return (F.ceil(value / size) * size).cast("long")


def action_letter(action: Column) -> Column:
    """One letter for each action of a change; null for any other."""
    out = F.lit(None).cast("string")
    for action_name, letter in ACTION_LETTERS.items():
        out = F.when(action == action_name, letter).otherwise(out)
    return out


def overlaps(a: Column, b: Column) -> Column:
    """Whether one of two paths is the other or lies in its subtree."""
    return covers(a, b) | covers(b, a)


def covers(top: Column, path: Column) -> Column:
    """Whether ``path`` is ``top`` or lies in its subtree; the root (empty) covers all."""
    return (top == "") | (top == path) | F.startswith(path, F.concat(top, F.lit("/")))


def join_path(a: Column, b: Column) -> Column:
    """Two parts of a path as one; empty parts leave no slash."""
    return F.concat_ws("/", F.when(a != "", a), F.when(b != "", b))


def subtree_key(path: Column) -> Column:
    """What to sort paths by so that each is followed by its own subtree: a slash ranks below every byte."""
    return F.split(path, "/")


def clean_path(path: Column) -> Column:
    """A path with forward slashes only, none doubled, without . and with .. taken back where it can be.

    Of a path from the root, leading .. go; else they stay.
    """
    slashed = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"(/\.)+(?=/|$)", "")
    slashed = F.regexp_replace(slashed, r"^(\./)+", "")

    def step(kept: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, F.greatest(F.size(kept), F.lit(1))), F.lit("")) != "..")
        return F.when(part == "", kept).when(back, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    folded = F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), step)
    reduced = F.array_join(folded, "/")
    rooted = F.concat(F.lit("/"), F.regexp_replace(reduced, r"^(\.\./)+", ""))
    return F.when(~F.contains(slashed, F.lit("..")), slashed).when(F.startswith(slashed, F.lit("/")), rooted).otherwise(reduced)


def function_key(salt: str, function: str, *args: Column) -> Column:
    """The hash by which a function's result for its arguments is found; lengths keep arguments apart."""
    parts = [F.concat(F.length(a).cast("string"), F.lit(":"), a) for a in args]
    return F.sha2(F.concat_ws("|", F.lit(salt), F.lit(function), *parts), 256)


def name_key(name: Column) -> Column:
    """A 64-bit key of a name without case; equal names have equal keys."""
    return F.xxhash64(F.lower(name))
