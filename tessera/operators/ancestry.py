"""Lines of history from given tips: first-parent lines by pointer doubling, both-parent reach by levels, and
what is read off them: common ancestors, merge bases, bisection, specifiers, searches and pages.

``revisions`` has revision, number, parent_self, parent_other, branch. Every operator starts from asked tips,
so nothing grows with the square of the history; each round is written to the shared folder by ``checkpoint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(revisions: DataFrame, tips: DataFrame, limit: int = 0) -> DataFrame:
    """(tip, revision, depth): each tip and its first parents, at most ``limit`` of them (0: any).

    Round i joins what is found with the ancestors 2**i steps up, so a line of n revisions takes log n rounds.
    """
    jump = revisions.select("revision", F.col("parent_self").alias("up")).where("up is not null")
    found = tips.select(F.col("tip"), F.col("tip").alias("revision"), F.lit(0).cast("long").alias("depth"))
    step = 1
    while not limit or step < limit:
        jump = jump.checkpoint()
        more = found.join(jump, "revision").select("tip", F.col("up").alias("revision"), (F.col("depth") + step).alias("depth"))
        more = (more.where(F.col("depth") < limit) if limit else more).checkpoint()
        if more.isEmpty():
            break
        found = found.unionByName(more)
        jump = jump.join(jump.select(F.col("revision").alias("up"), F.col("up").alias("next")), "up").select("revision", F.col("next").alias("up"))
        step *= 2
    return found


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 0, tags: list[str] | None = None) -> DataFrame:
    """(root, target, depth): what each root leads to, at its least depth; ``edges``: source, target (, tags).

    A root itself is left out unless an edge leads back to it. Tags keep the edges that carry one of them; none
    keep all. A front is joined only with what its own roots have not met yet.
    """
    kept = edges if not tags else edges.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    step = kept.select(F.col("source").alias("at"), "target").distinct().checkpoint()
    front = roots.select("root", F.col("root").alias("at")).distinct()
    found, depth = None, 0
    while not max_depth or depth < max_depth:
        depth += 1
        met = front.join(step, "at").select("root", "target").distinct()
        if found is not None:
            met = met.join(found.select("root", "target"), ["root", "target"], "left_anti")
        met = met.withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        if met.isEmpty():
            return met if found is None else found
        found = met if found is None else found.unionByName(met)
        front = met.select("root", F.col("target").alias("at"))
    return found


def both_parents(revisions: DataFrame) -> DataFrame:
    """Edges (source, target) from a revision to each of its parents."""
    parents = F.explode(F.array_distinct(F.array("parent_self", "parent_other")))
    return revisions.select(F.col("revision").alias("source"), parents.alias("target")).where("target is not null")


def meeting(line: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (mine, theirs) of tips of ``line``: the newest revision on both lines (null: none), and how many
    revisions each has in front of it alone."""
    a = line.select(F.col("tip").alias("mine"), "revision", F.col("depth").alias("ahead"))
    b = line.select(F.col("tip").alias("theirs"), "revision", F.col("depth").alias("behind"))
    met = pairs.join(a, "mine").join(b, ["theirs", "revision"]).groupBy("mine", "theirs").agg(
        F.min_by(F.struct("revision", "ahead", "behind"), "ahead").alias("m")
    )
    size = line.groupBy("tip").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(met, ["mine", "theirs"], "left").join(size.select(F.col("tip").alias("mine"), F.col("n").alias("n1")), "mine", "left")
    out = out.join(size.select(F.col("tip").alias("theirs"), F.col("n").alias("n2")), "theirs", "left")
    return out.select("mine", "theirs", F.col("m.revision").alias("base"), F.coalesce("m.ahead", "n1").alias("ahead"), F.coalesce("m.behind", "n2").alias("behind"))


def exclusive(line: DataFrame, met: DataFrame) -> DataFrame:
    """(mine, theirs, side, revision, depth): the revisions of either line in front of where they meet."""
    side = lambda name, n: met.select("mine", "theirs", F.col(name).alias("tip"), F.col(n).alias("n"), F.lit(name).alias("side"))
    both = side("mine", "ahead").unionByName(side("theirs", "behind"))
    return both.join(line, "tip").where("depth < n").select("mine", "theirs", "side", "revision", "depth")


def on_line(line: DataFrame, revisions: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Per pair (newer, older): reached, diverged (the line went below the older one's number) or exhausted
    (it ended at ``limit`` revisions before that)."""
    number = revisions.select("revision", "number")
    asked = pairs.join(number.select(F.col("revision").alias("older"), F.col("number").alias("old_number")), "older")
    walked = asked.join(line.select(F.col("tip").alias("newer"), "revision", "depth"), "newer").join(number, "revision")
    seen = walked.groupBy("newer", "older").agg(
        F.max((F.col("revision") == F.col("older")).cast("int")).alias("hit"),
        F.count(F.lit(1)).alias("n"),
        F.max((F.col("number") < F.col("old_number")).cast("int")).alias("passed"),
    )
    state = F.when(F.col("hit") == 1, "reached").when((F.col("passed") == 0) & (F.col("n") >= limit), "exhausted").otherwise("diverged")
    return seen.select("newer", "older", state.alias("state"))


def _common_of_reach(revisions: DataFrame, pairs: DataFrame) -> DataFrame:
    tips = pairs.select(F.col("mine").alias("root")).union(pairs.select("theirs")).distinct()
    got = reach(both_parents(revisions), tips).select("root", "target").unionByName(tips.select("root", F.col("root").alias("target")))
    numbered = got.join(revisions.select(F.col("revision").alias("target"), "number"), "target")
    a = numbered.select(F.col("root").alias("mine"), "target", "number")
    b = numbered.select(F.col("root").alias("theirs"), "target")
    return pairs.join(a, "mine").join(b, ["theirs", "target"]).groupBy("mine", "theirs").agg(
        F.max_by("target", "number").alias("found"), F.max("number").alias("number")
    )


def _newest_common(revisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per different pair (mine, theirs) with a common ancestor: the highest-numbered one (``found``, ``number``).

    Both sides go down together, and a pair ends once nothing that is still to be followed is numbered above the best
    that both have met. That needs every parent numbered below its child; else the whole reach is compared.
    """
    number = revisions.select("revision", "number").distinct()
    up = both_parents(revisions).distinct().join(number.select(F.col("revision").alias("source"), F.col("number").alias("below")), "source")
    up = up.join(number.select(F.col("revision").alias("target"), "number"), "target").select(F.col("source").alias("revision"), "target", "number", "below").checkpoint()
    falls = up.where("number is null or below is null or number >= below").isEmpty() and number.groupBy("revision").count().where("count > 1").isEmpty()
    if not falls:
        return _common_of_reach(revisions, pairs)
    up = up.drop("below")
    tips = pairs.select("*", F.col("mine").alias("revision"), F.lit(1).alias("sides")).unionByName(pairs.select("*", F.col("theirs").alias("revision"), F.lit(2).alias("sides")))
    # sides: which of the two have met the revision; done: for which of them its parents have been met
    state = tips.join(number, "revision").withColumn("done", F.lit(0))
    each, settled = Window.partitionBy("mine", "theirs"), None
    while True:
        met = state.groupBy("mine", "theirs", "revision").agg(F.first("number").alias("number"), F.bit_or("sides").alias("sides"), F.bit_or("done").alias("done"))
        met = met.withColumn("best", F.max(F.when(F.col("sides") == 3, F.col("number"))).over(each))
        more = (F.col("sides") != F.col("done")) & (F.col("best").isNull() | (F.col("number") > F.col("best")))
        met = met.withColumn("more", more).withColumn("open", F.max("more").over(each)).where("best is null or number >= best")
        met = met.where("open or sides = 3").checkpoint()
        ended = met.where("not open").select("mine", "theirs", F.col("revision").alias("found"), "number")
        settled = ended if settled is None else settled.unionByName(ended)
        front = met.where("more").select("mine", "theirs", "revision", F.col("sides").bitwiseXOR(F.col("done")).alias("sides"))
        asked = front.count()
        if not asked:
            return settled.groupBy("mine", "theirs").agg(F.max_by("found", "number").alias("found"), F.max("number").alias("number"))
        further = (F.broadcast(front) if asked < 50_000 else front).join(up, "revision")
        further = further.select("mine", "theirs", F.col("target").alias("revision"), "number", "sides", F.lit(0).alias("done"))
        state = met.where("open").select("mine", "theirs", "revision", "number", "sides", F.when(F.col("more"), F.col("sides")).otherwise(F.col("done")).alias("done")).unionByName(further)


def merge_bases(revisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (mine, theirs): the highest-numbered revision that both reach through both parents, not below
    ``floor`` (a column of ``pairs``: the base known from branch points, null for none)."""
    best = _newest_common(revisions, pairs.select("mine", "theirs").where("mine is not null and theirs is not null").distinct())
    low = revisions.select(F.col("revision").alias("floor"), F.col("number").alias("floor_number"))
    out = pairs.join(best, ["mine", "theirs"], "left").join(low, "floor", "left")
    better = F.coalesce(F.col("number") > F.col("floor_number"), F.col("floor_number").isNull())
    return out.select("mine", "theirs", F.when(better, F.col("found")).otherwise(F.col("floor")).alias("base"))


def shared_points(stacks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (source, source_revision, target, target_revision) of branches: the branch they share and each
    side's point on it.

    ``stacks``: branch, pos, member, point. A branch that the other side's stack names is shared with its tip as
    its own point; the source's stack is asked first, then the target's from its nearest entry on. Stacks that come
    from an explode are taken for as small as its input, hence the merge hints.
    """
    s = stacks.select(F.col("branch").alias("source"), F.col("pos").alias("s_pos"), F.col("member").alias("shared"), F.col("point").alias("s_point")).hint("merge")
    t = stacks.select(F.col("branch").alias("target"), F.col("pos").alias("t_pos"), F.col("member").alias("shared"), F.col("point").alias("t_point")).hint("merge")
    first = pairs.join(s, "source").where("shared = target").select(
        *pairs.columns, "shared", F.col("s_point").alias("source_point"), F.col("target_revision").alias("target_point"), F.lit(-1).alias("rank"), F.lit(0).alias("tie"), F.col("s_pos").alias("turn")
    )
    own = pairs.join(t, "target").where("shared = source").select(
        *pairs.columns, "shared", F.col("source_revision").alias("source_point"), F.col("t_point").alias("target_point"), F.col("t_pos").alias("rank"), F.lit(0).alias("tie"), F.lit(0).alias("turn")
    )
    both = pairs.join(t, "target").join(s, ["source", "shared"]).select(
        *pairs.columns, "shared", F.col("s_point").alias("source_point"), F.col("t_point").alias("target_point"), F.col("t_pos").alias("rank"), F.lit(1).alias("tie"), F.col("s_pos").alias("turn")
    )
    every = first.unionByName(own).unionByName(both)
    best = every.groupBy(*pairs.columns).agg(F.min_by(F.struct("shared", "source_point", "target_point"), F.struct("rank", "tie", "turn")).alias("b"))
    return pairs.join(best, pairs.columns, "left").select(*pairs.columns, "b.shared", "b.source_point", "b.target_point")


def base_of_points(revisions: DataFrame, shared: DataFrame, limit: int = 10_000) -> DataFrame:
    """``shared`` (source_point, target_point) with the base: the older point where the newer one's line holds it,
    else where the two lines meet, else null."""
    number = revisions.select("revision", "number")
    both = shared.join(number.select(F.col("revision").alias("source_point"), F.col("number").alias("n1")), "source_point", "left").join(
        number.select(F.col("revision").alias("target_point"), F.col("number").alias("n2")), "target_point", "left"
    )
    source_newer = F.coalesce("n1", F.lit(0)) >= F.coalesce("n2", F.lit(0))
    both = both.withColumn("newer", F.when(source_newer, F.col("source_point")).otherwise(F.col("target_point")))
    both = both.withColumn("older", F.when(source_newer, F.col("target_point")).otherwise(F.col("source_point"))).drop("n1", "n2")
    both = both.checkpoint()  # every round of the lines would else find the points anew
    pairs = both.where("newer is not null and older is not null").select("newer", "older").distinct()
    line = lines(revisions, pairs.select(F.col("newer").alias("tip")).union(pairs.select("older")).distinct(), limit).checkpoint()
    met = meeting(line, pairs.select(F.col("newer").alias("mine"), F.col("older").alias("theirs")))
    return both.join(met.select(F.col("mine").alias("newer"), F.col("theirs").alias("older"), "base"), ["newer", "older"], "left")


def history(line: DataFrame, revisions: DataFrame, limit: int = 100, since: Column | None = None, only_branch: bool = False) -> DataFrame:
    """Rows of each tip's listing, newest first by ``depth``.

    A row older than ``since`` ends the list and isn't shown; with ``only_branch`` the first row of another branch
    than the tip's is the last one shown.
    """
    rows = line.join(revisions.select("revision", "number", "branch", "ts"), "revision")
    order = Window.partitionBy("tip").orderBy("depth")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    keep = F.col("depth") < limit
    if since is not None:
        keep = keep & (F.max((F.col("ts") < since).cast("int")).over(upto) == 0)
    if only_branch:
        crossed = (F.col("branch") != F.first("branch").over(order)).cast("int")
        rows = rows.withColumn("crossed", crossed)
        keep = keep & (F.coalesce(F.max("crossed").over(before), F.lit(0)) == 0)
    return rows.withColumn("keep", keep).where("keep").select("tip", "revision", "number", "branch", "depth")


def branch_page(line: DataFrame, points: DataFrame, limit: int = 100) -> DataFrame:
    """Each tip's revisions above its branch point (``points``: tip, point), at most ``limit``, and whether there
    are more (``has_more``)."""
    stop = line.join(points, "tip").where("revision = point").select("tip", F.col("depth").alias("stop"))
    own = line.join(stop, "tip", "left").where("stop is null or depth < stop")
    size = own.groupBy("tip").agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return own.where(F.col("depth") < limit).join(size, "tip").select("tip", "revision", "depth", "has_more")


def segment_page(line: DataFrame, revisions: DataFrame, step: int, limit: int = 100) -> DataFrame:
    """One page a tip: at most ``limit`` revisions that lie in the segment (B - step, B] of its first, and the
    forward cursor, the revision numbered exactly one more (null: none)."""
    rows = line.join(revisions.select("revision", "number"), "revision")
    top = rows.where("depth = 0").select("tip", ((F.ceil(F.col("number") / step) - 1) * step).alias("low"), (F.col("number") + 1).alias("next"))
    after = revisions.select(F.col("number").alias("next"), F.col("revision").alias("forward"), F.col("parent_self").alias("tip"))
    page = rows.join(top, "tip").where((F.col("number") > F.col("low")) & (F.col("depth") < limit))
    return page.join(after, ["tip", "next"], "left").select("tip", "revision", "number", "depth", "forward")


def skip_pointers(revisions: DataFrame, step: int) -> DataFrame:
    """(branch, key, revision): a pointer where a revision lies in another step than its first parent."""
    parent = revisions.select(F.col("revision").alias("parent_self"), F.col("number").alias("parent_number"))
    crossed = revisions.join(parent, "parent_self").where(F.floor(F.col("parent_number") / step) != F.floor(F.col("number") / step))
    return crossed.select("branch", (F.ceil(F.col("number") / step) * step).alias("key"), "revision")


def bisect(line: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per range (start, end): steps between them on the end's line, the revision half of them above the end, and
    whether it's done. A start that isn't on the line, or equals the end, gives no row."""
    at = ranges.join(line.select(F.col("tip").alias("end"), F.col("revision").alias("start"), F.col("depth").alias("steps")), ["start", "end"]).where("steps > 0")
    half = at.withColumn("depth", F.expr("steps div 2"))
    found = half.join(line.select(F.col("tip").alias("end"), F.col("revision").alias("target"), "depth"), ["end", "depth"])
    return found.select("start", "end", "steps", "target", (F.col("steps") <= 1).alias("done"))


def search(line: DataFrame, revisions: DataFrame, match: Column, abort: Column | None = None, limit: int = 0) -> DataFrame:
    """The first revision of each tip's line that ``match`` holds for: tip, revision (null: none), state (found,
    none, aborted where ``abort`` held first, limit where more than ``limit`` had to be seen)."""
    rows = line.join(revisions, "revision").select("tip", "revision", "depth", match.alias("hit"), (F.lit(False) if abort is None else abort).alias("stop"))
    seen = rows.groupBy("tip").agg(
        F.min(F.when(F.col("hit"), F.col("depth"))).alias("hit_at"),
        F.min_by("revision", F.when(F.col("hit"), F.col("depth"))).alias("hit"),
        F.min(F.when(~F.col("hit") & F.col("stop"), F.col("depth"))).alias("stop_at"),
        F.count(F.lit(1)).alias("n"),
    )
    first = F.least(F.coalesce("hit_at", "n"), F.coalesce("stop_at", "n"))
    state = F.lit("none")
    state = F.when(F.col("stop_at").isNotNull() & (F.coalesce("hit_at", F.col("n")) > F.col("stop_at")), "aborted").when(F.col("hit_at").isNotNull(), "found").otherwise(state)
    if limit:
        state = F.when(first >= limit, F.when(F.col("n") > limit, "limit").otherwise(state)).otherwise(state)
    out = seen.withColumn("state", state)
    return out.select("tip", F.when(F.col("state") == "found", F.col("hit")).alias("revision"), "state")


def up(line: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (tip, n) with the n-th first parent of each tip (null beyond the root)."""
    return asked.join(line.select("tip", F.col("depth").alias("n"), "revision"), ["tip", "n"], "left")


def is_branch_point(stacks: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (branch, revision), and whether the branch's stack holds that revision."""
    held = stacks.select("branch", F.col("point").alias("revision"), F.lit(True).alias("held")).distinct().hint("merge")  # stacks: see shared_points
    return asked.join(held, ["branch", "revision"], "left").select("branch", "revision", F.coalesce("held", F.lit(False)).alias("is_point"))


def next_number(revisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The number of a revision on top of each pair (mine, theirs): one more than the larger parent's."""
    number = revisions.select("revision", "number")
    out = pairs.join(number.select(F.col("revision").alias("mine"), F.col("number").alias("a")), "mine", "left")
    out = out.join(number.select(F.col("revision").alias("theirs"), F.col("number").alias("b")), "theirs", "left")
    return out.select("mine", "theirs", (F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) + 1).alias("number"))


def merged_already(revisions: DataFrame, line: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair (tip, other): whether some revision of the tip's line has ``other`` as a parent, or is it."""
    rows = line.join(revisions.select("revision", "parent_self", "parent_other"), "revision")
    hit = (F.col("parent_self") == F.col("other")) | (F.col("parent_other") == F.col("other")) | (F.col("revision") == F.col("other"))
    seen = pairs.join(rows, "tip").groupBy("tip", "other").agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("m"))
    return pairs.join(seen, ["tip", "other"], "left").select("tip", "other", (F.coalesce("m", F.lit(0)) == 1).alias("merged"))
