"""Ordered glob rules: exclusions and inclusions, rule files, subtree proofs and filter modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import ancestors

# What working-directory filters leave out on their own.
BUILT_IN = ("*~mine", "*~theirs", "*~base")
#: Filter modes.
IGNORE, VIEW, FULL = 1, 2, 3


@dataclass(frozen=True)
class Line:
    """One compiled rule: a glob, whether it lets paths in, matches directories only, or names only."""

    glob: str
    keeps: bool = False
    directory: bool = False
    by_name: bool = False
    generated: bool = False


def exclusion(glob: str) -> list[Line]:
    """Lines of a rule that leaves paths out, with what lies below them."""
    body = glob.strip("/").lower()
    by_name = not glob.startswith("/") and "/" not in body and body != "**"
    lines = [Line(body, directory=glob.endswith("/"), by_name=by_name)]
    if (not by_name or glob.endswith("/")) and not body.endswith("*"):
        lines.append(Line(f"{body}/**", generated=True))
    return lines


def inclusion(glob: str) -> list[Line]:
    """Lines of a rule that lets paths in again: the directories on the way, the path, and what lies below it."""
    if glob.startswith("**"):
        raise ValueError("an inclusion can't start with **")
    body = glob.strip("/").lower()
    by_name = not glob.startswith("/") and "/" not in body
    parts = body.split("/")
    above = [] if by_name else [Line("/".join(parts[:i]), True, True, generated=True) for i in range(1, len(parts))]
    below = [] if by_name or body.endswith("*") else [Line(f"{body}/**", True, generated=True)]
    return [*above, Line(body, True, glob.endswith("/"), by_name), *below]


def parse(lines: list[str]) -> list[Line]:
    """Lines of a rule file: # starts a comment, each ! turns the rule over, a backslash keeps a ! in a name."""
    out: list[Line] = []
    for raw in lines:
        rule = raw.strip()
        if not rule or rule.startswith("#"):
            continue
        bare = rule.lstrip("!")
        turned = (len(rule) - len(bare)) % 2 == 1
        if bare.startswith("\\!"):
            bare = bare[1:]
        out += inclusion(bare) if turned else exclusion(bare)
    return out


def pattern(glob: str) -> str:
    """A glob as a regular expression for a whole lower-cased path or name."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            inner = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + f"[{'^/' if negated else ''}{inner}]", end + 1
        elif c == "{" and "}" in glob[i:]:
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        else:
            if c == "\\" and i + 1 < len(glob):
                i, c = i + 1, glob[i + 1]
            out, i = out + (c if c.isalnum() or c in "/_-~ " else f"\\{c}" if c.isascii() else c), i + 1
    return f"^{out}$"


def excluded(path: Column, rules: list[Line], directory: bool) -> Column:
    """Whether the rules alone leave a path out: the last line that matches and changes the state decides."""
    lowered = F.lower(path)
    name = F.substring_index(lowered, "/", -1)
    out = F.lit(False)
    for line in rules:
        if line.directory and not directory:
            continue
        hit = (name if line.by_name else lowered).rlike(pattern(line.glob))
        out = out & ~hit if line.keeps else out | hit
    return F.when(path.isin("", "."), False).otherwise(out)


def admits(path: Column, rules: list[Line]) -> Column:
    """Whether a walk from the top reaches a file: neither it nor any directory above it is left out."""
    above = F.exists(ancestors(path), lambda p: excluded(p, rules, True))
    return ~above & ~excluded(path, rules, False)


def admits_by_mode(path: Column, ignore: list[Line], view: list[Line], mode: int = FULL) -> Column:
    """``admits`` by the ignore rules, the view rules or both."""
    out = F.lit(True)
    if mode & IGNORE:
        out = out & admits(path, ignore)
    if mode & VIEW:
        out = out & admits(path, view)
    return out


def reasons(paths: DataFrame, ignore: list[Line], view: list[Line]) -> DataFrame:
    """The paths left out, each with what leaves it out first: ignore (0) or view (1)."""
    why = F.when(~admits(F.col("path"), ignore), 0).when(~admits(F.col("path"), view), 1)
    return paths.select("path", why.alias("reason")).where("reason is not null")


def excludes_subtree(path: Column, rules: list[Line]) -> Column:
    """Whether everything below a directory is surely out: no rule lets anything in, and one covers it."""
    if any(line.keeps for line in rules):
        return F.lit(False)
    lowered, out = F.lower(path), F.lit(False)
    for line in rules:
        if line.glob.endswith("/**") and not line.by_name and not line.directory:
            top = line.glob.removesuffix("/**")
            out = out | (lowered == top) | F.startswith(lowered, F.lit(f"{top}/"))
    return ~path.isin("", ".") & out
