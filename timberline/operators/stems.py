"""Stems without learning (GRF4-12, JN11-14, AGG26, AGG27, FLT10): circles in slices, suppression, climbing, merging, extraction.

What is sequential (suppression, first come first kept) is decided in rounds over blocks
of bounded size, climbing by doubling pointers. The random circle search is in
:mod:`timberline.operators.circles`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators import decisions
from timberline.operators.circles import BEST, MANY, CircleSearch, angular_bins, best_circles, candidate_circles, circle_stacks, circumcircles, find_best_circle, find_circles, fit_circle, seed_of  # noqa: F401
from timberline.operators.graph import checkpointed, connected_components, numbered
from timberline.operators.spatial import half_overlapping_tiles


def circle_residual(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    """GRF12 as an expression: the radius less the point's distance from the centre."""
    return r - F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def _in_shares(members: DataFrame, keys: list[str], per: int = 256) -> DataFrame:
    """(keys, ids): the cids of equal keys in sorted arrays of about ``per``, so that no row holds all copies of a place."""
    counts = members.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in keys], "_n")
    same = [F.col(c) == F.col(f"_{c}") for c in keys]
    dealt = members.join(counts.hint("merge"), same).withColumn("_share", F.pmod(F.xxhash64("cid"), F.ceil(F.col("_n") / per)))
    return dealt.groupBy(*keys, "_share").agg(F.sort_array(F.collect_list("cid")).alias("ids")).drop("_share")


def overlapping_at_height(circles: DataFrame, size: float = 1.0) -> DataFrame:
    """JN11: pairs (u <= v, itself included) of circles of one height whose centres are nearer than their radii's sum.

    Distances are computed between distinct circles; copies of a circle (equal
    x, y, r and z) are expanded into pairs afterwards, share by share.
    Circles with a null coordinate or radius overlap nothing.
    """
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("r").isNotNull() & F.col("z").isNotNull() & (F.col("r") >= 0)
    place = ["x", "y", "r", "z"]
    held = circles.where(whole).select("cid", *place)
    classes = held.groupBy(*place).agg(F.min("cid").alias("cid"))
    pairs = _overlaps_of_distinct(classes, size)
    named = _in_shares(held, place).join(classes.select(*[F.col(c).alias(f"_{c}") for c in place], F.col("cid").alias("least")).hint("merge"), [F.col(c) == F.col(f"_{c}") for c in place])
    sides = [named.select(F.col("least").alias(f"_{c}"), F.col("ids").alias(f"ids{c}")).hint("merge") for c in "uv"]
    met = pairs.join(sides[0], F.col("u") == F.col("_u")).join(sides[1], F.col("v") == F.col("_v"))
    each = met.select((F.col("u") == F.col("v")).alias("_own"), F.explode("idsu").alias("a"), "idsv").select("_own", "a", F.explode("idsv").alias("b"))
    # shares of one class meet in both orders
    return each.where(~F.col("_own") | (F.col("a") <= F.col("b"))).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _overlaps_of_distinct(circles: DataFrame, size: float = 1.0) -> DataFrame:
    """The pairs of :func:`overlapping_at_height` among circles without nulls.

    Circles are spread over the cells of ``size`` that their squares cover; a
    pair is taken in the first cell both cover.
    """
    cells = lambda c: F.sequence(F.floor((F.col(c) - F.col("r")) / size), F.floor((F.col(c) + F.col("r")) / size))
    spread = circles.select("cid", "x", "y", "r", "z", cells("x").alias("_xs"), cells("y").alias("_ys"))
    spread = spread.withColumns({"_x0": F.col("_xs")[0], "_y0": F.col("_ys")[0]}).withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys")).drop("_xs", "_ys")
    a, b = spread.alias("a"), spread.alias("b")
    dist = F.sqrt((F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y")))
    first = (F.col("a._cx") == F.greatest("a._x0", "b._x0")) & (F.col("a._cy") == F.greatest("a._y0", "b._y0"))
    same = (F.col("a.z") == F.col("b.z")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col("a.cid") <= F.col("b.cid"))
    return a.join(b.hint("merge"), same).where(first & (dist < F.col("a.r") + F.col("b.r"))).select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v"))


def suppressed(circles: DataFrame, block: int = decisions.BLOCK) -> DataFrame:
    """GRF5: at each height, in order of cid, the overlapping circles give way to the one with most inliers (Q22).

    A circle that still stands when its turn comes acts: all that it overlaps (itself
    included) go, but for the one with most inliers (then the least cid), which stands
    again even if it had gone. So a circle stands at its turn if the last acting one
    before it names it, or if none acted; and at the end likewise, over all that it
    overlaps. Copies of a circle overlap the same ones: only the first of them and the one
    with most inliers can ever act, and only the latter can stay. Circles with a null
    coordinate or radius, and those that overlap nothing, stay. cids are distinct.
    """
    place = ["x", "y", "r", "z"]
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("r").isNotNull() & F.col("z").isNotNull() & (F.col("r") >= 0)
    held = circles.where(whole).select("cid", "n", *place)
    own = F.when(F.col("r") == 0, F.col("cid"))  # circles without extent do not overlap their copies
    best = F.max(F.struct("n", (-F.col("cid")).alias("less")))
    classes = checkpointed(held.groupBy(*place, own.alias("own")).agg(F.min("cid").alias("cid"), best.alias("best")).select("cid", *place, F.col("best.n").alias("n"), (-F.col("best.less")).alias("top")))
    pairs = checkpointed(_overlaps_of_distinct(classes))
    near = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.where(F.col("u") != F.col("v")).select("v", "u"))
    # whom each class names: the best of all that it overlaps
    known = classes.select(F.col("cid").alias("b"), F.struct("n", (-F.col("top")).alias("less")).alias("of_b"))
    named = near.join(known.hint("merge"), "b").groupBy("a").agg((-F.max("of_b")["less"]).alias("names"))
    named = checkpointed(classes.join(named.hint("merge"), F.col("cid") == F.col("a"), "left").drop("a"))
    nodes = named.select("cid", *place, "names", F.explode(F.array_distinct(F.array("cid", "top"))).alias("id"))
    ours = nodes.select(F.col("cid").alias("a"), "id")
    theirs = nodes.select(F.col("cid").alias("b"), F.col("id").alias("j"), "names")
    edges = near.join(ours.hint("merge"), "a").join(theirs.hint("merge"), "b").where(F.col("j") < F.col("id"))
    lower = edges.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("j", (F.col("names") == F.col("id")).alias("named"))), asc=False).alias("l"))
    items = nodes.join(lower.hint("merge"), F.col("id") == F.col("_id"), "left")
    items = checkpointed(items.select("id", *place, F.coalesce(F.col("l.j"), F.array().cast("array<bigint>")).alias("lower"), F.coalesce(F.col("l.named"), F.array().cast("array<boolean>")).alias("names")))
    acts = decisions.decided(items, "z", "x", "y", "id", block=block).where("act").select(F.col("id").alias("_id"))
    acting = nodes.join(acts.hint("merge"), F.col("id") == F.col("_id")).groupBy(F.col("cid").alias("b")).agg(F.max("id").alias("last"), F.first("names").alias("names"))
    last = near.join(acting.hint("merge"), "b").groupBy("a").agg(F.max_by("names", "last").alias("last_names"))
    kept = named.join(last.hint("merge"), F.col("cid") == F.col("a")).where(F.col("last_names") == F.col("top")).select(F.col("top").alias("_id"))
    alone = named.where(F.col("names").isNull()).select(F.col("cid").alias("_id"))
    stay = circles.where(whole).join(kept.union(alone).hint("merge"), F.col("cid") == F.col("_id"), "left_semi")
    return stay.unionByName(circles.where(~F.coalesce(whole, F.lit(False))))


def next_up(circles: DataFrame, reach: float = 2.5, shift: float = 0.1, change: float = 0.2, keys: tuple[str, ...] = (), ties: tuple[str, ...] = ("next",)) -> DataFrame:
    """JN12: (keys, cid, next) the circle to climb to: above by at most ``reach``, nearly below, of like radius; lowest level, then closest radius.

    Circles climb to those of equal ``keys``; ``ties`` (of z, next) decide between equal radii.
    """
    place, keyed = ["x", "y", "r", "z"], list(keys)
    held = circles.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in place])).select("cid", *place, *keyed)
    classes = checkpointed(held.groupBy(*place, *keyed).agg(F.min("cid").alias("cid")))  # copies climb alike, and to the first of copies
    a = classes.select(F.col("cid").alias("cid0"), *[F.col(c).alias(f"{c}0") for c in place], *keyed)
    b = classes.select(F.col("cid").alias("next"), *place, *keyed, F.floor(F.col("x") / shift).alias("_i"), F.floor(F.col("y") / shift).alias("_j"))
    b = b.withColumn("_k", F.explode(F.array(*[F.struct((F.col("_i") + i).alias("i"), (F.col("_j") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    b = b.select("next", *place, *keyed, F.col("_k.i").alias("kx"), F.col("_k.j").alias("ky"))
    dist = F.sqrt((F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")))
    gap = F.abs(F.col("r") - F.col("r0"))

    def above(a: DataFrame) -> DataFrame:
        at = a.withColumns({"kx": F.floor(F.col("x0") / shift), "ky": F.floor(F.col("y0") / shift)})
        return at.join(b.hint("merge"), ["kx", "ky", *keyed]).where((F.col("z") > F.col("z0")) & (F.col("z") <= F.col("z0") + reach) & (dist < shift) & (gap < change * F.col("r0")))

    under = {c: f"_{c}" for c in ("cid0", *keyed)}
    lowest = above(a).groupBy("cid0", *keyed).agg(F.min("z").alias("lowest")).withColumnsRenamed(under)  # numbers, combined before the shuffle
    level = above(a.join(lowest.hint("merge"), [F.col(c) == F.col(n) for c, n in under.items()]).drop(*under.values())).where(F.col("z") <= F.col("lowest") + 0.01).withColumn("gap", gap)
    found = level.groupBy("cid0", *keyed).agg(F.min_by("next", F.struct("gap", *ties)).alias("next")).withColumnsRenamed(under)
    named = held.join(classes.select(*[F.col(c).alias(f"_{c}") for c in (*place, *keyed)], F.col("cid").alias("least")).hint("merge"), [F.col(c) == F.col(f"_{c}") for c in (*place, *keyed)])
    named = named.select("cid", "least", *keyed)
    return named.join(found.hint("merge"), [F.col("least") == F.col("_cid0"), *[F.col(c) == F.col(f"_{c}") for c in keyed]]).select(*keyed, "cid", "next")


def _jump(one: DataFrame, two: DataFrame) -> DataFrame:
    """(tx, ty, cid, next): as far as ``one`` and then as far as ``two`` goes."""
    on = two.select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("cid").alias("_cid"), F.col("next").alias("_next"))
    met = one.join(on.hint("merge"), (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty")) & (F.col("next") == F.col("_cid")))
    return met.select(*[c for c in one.columns if c != "next"], F.col("_next").alias("next"))


def climb(circles: DataFrame, tile: float = 5.0, at_least: int = 10) -> DataFrame:
    """GRF6: (stem_id, seq, circle) stacks of more than ``at_least`` circles, climbed inside half-overlapping tiles.

    What each circle climbs to makes a forest of pointers. A stack begins at each circle
    that none climbs to (and that is below the tile's top), and is the way up from there.
    Ways are found by doubling: tables of what lies 1, 2, 4 ... steps up, from which a stack
    of any length is put together in as many joins as its length has binary digits, so that no
    tile is gathered. Tiles of fewer than 10 circles have no stacks. Stems are numbered by
    tile, then by z and cid of their first circle. Those in overlaps appear once a tile;
    :func:`merge_stems` joins them.
    """
    tiled = half_overlapping_tiles(circles, tile).select("tx", "ty", "cid", "x", "y", "r", "z", "n")
    sizes = tiled.groupBy(F.col("tx").alias("_tx"), F.col("ty").alias("_ty")).agg(F.count("*").alias("_n"), F.max("z").alias("top"))
    same = (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty"))
    tiled = checkpointed(tiled.join(sizes.where(F.col("_n") >= 10), same).drop("_tx", "_ty", "_n"))
    jumps = [checkpointed(next_up(tiled, keys=("tx", "ty"), ties=("z", "next")))]
    reached = jumps[0].select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("next").alias("_cid")).distinct()
    seeds = tiled.where(F.col("z") < F.col("top")).join(reached.hint("merge"), same & (F.col("cid") == F.col("_cid")), "left_anti")
    seeds = seeds.select("tx", "ty", "z", F.col("cid").alias("seed"))
    while not jumps[-1].isEmpty():  # the last table is empty
        jumps.append(checkpointed(_jump(jumps[-1], jumps[-1])))
    far = seeds.withColumn("next", F.col("seed"))  # only those with so many steps above them
    for k, table in enumerate(jumps[:-1]):
        if at_least >> k & 1:
            far = _jump(far, table)
    if at_least >> len(jumps[:-1]):
        far = far.limit(0)
    numbered_seeds = numbered(far.select("tx", "ty", "z", "seed"), "tx", "ty", "z", "seed", name="stem_id").drop("z")
    ways = checkpointed(numbered_seeds.select("stem_id", F.lit(0).alias("seq"), "tx", "ty", F.col("seed").alias("next")))
    for k, table in enumerate(jumps[:-1]):
        ways = checkpointed(ways.union(_jump(ways, table).withColumn("seq", F.col("seq") + (1 << k)).select(*ways.columns)))
    own = tiled.select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), "cid", "x", "y", "r", "z", "n")
    return ways.join(own.hint("merge"), same & (F.col("next") == F.col("cid"))).select("stem_id", "seq", "cid", "x", "y", "r", "z", "n")


def shared_circles(stems: DataFrame) -> DataFrame:
    """JN13: pairs (u > v) of stems that have a circle in common."""
    a, b = stems.select("cid", F.col("stem_id").alias("u")), stems.select("cid", F.col("stem_id").alias("v"))
    return a.join(b, "cid").where(F.col("u") > F.col("v")).select("u", "v").distinct()


def merge_stems(stems: DataFrame) -> DataFrame:
    """GRF7: (tree_id, circle) trees as groups of stems tied by shared circles; at each height the circle with most inliers stays."""
    stems = checkpointed(stems)
    # all stems of a circle are tied to the least of them, so their pairs are not listed
    least = stems.groupBy("cid").agg(F.min("stem_id").alias("v")).withColumnRenamed("cid", "_cid")
    groups = connected_components(stems.join(least.hint("merge"), F.col("cid") == F.col("_cid")).where(F.col("stem_id") != F.col("v")).select(F.col("stem_id").alias("u"), "v"))
    tagged = stems.join(groups.hint("merge"), stems["stem_id"] == groups["node"], "left").withColumn("tree_id", F.coalesce("component", "stem_id"))
    tagged = tagged.select("tree_id", "cid", "x", "y", "r", "z", "n").distinct()  # a circle once a tree
    best = F.max_by(F.struct("cid", "x", "y", "r", "n"), F.struct("n", -F.col("cid"))).alias("c")
    return tagged.groupBy("tree_id", "z").agg(best).select("tree_id", "c.cid", "c.x", "c.y", "c.r", "z", "c.n")


def locations(trees: DataFrame) -> DataFrame:
    """AGG27: (tree_id, x, y) mean of the ring centres."""
    return trees.groupBy("tree_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def unique_locations(places: DataFrame, distance: float = 2.0, at_once: int = 32, block: int = decisions.BLOCK) -> DataFrame:
    """GRF4: in order of tree_id, places farther than ``distance`` from every kept one.

    Places stand in cells so small that no two of one cell can both be kept. In each round
    the ``at_once`` first undecided places of each cell are decided together; what comes
    behind them in a cell stands for one neighbour that stays open. Then all places near to
    kept ones go. So a cell with any number of places never has its pairs listed. Of places
    with equal coordinates only the first can be kept. Places without coordinates are near
    none and stay; tree_ids are distinct.
    """
    places = checkpointed(places.select(F.col("tree_id").cast("long").alias("tree_id"), "x", "y"))
    whole = F.coalesce(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"), F.lit(False))
    if distance < 0:
        return places
    rest = places.where(~whole)
    width, reach = F.lit(float(distance) / 1.5 or 1.0), 2
    left = places.where(whole).groupBy("x", "y").agg(F.min("tree_id").alias("id"))
    if distance == 0:
        return left.select(F.col("id").alias("tree_id"), "x", "y").union(rest)
    left = left.withColumns({"cx": F.floor(F.col("x") / width), "cy": F.floor(F.col("y") / width)})
    left, kept = checkpointed(left), None
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])

    def meeting(frame: DataFrame) -> DataFrame:
        """``frame`` (columns o...) sent to the cells that it can be near to, joined with ``left`` there."""
        sent = frame.withColumn("_s", F.explode(steps)).withColumns({"_cx": F.col("ocx") + F.col("_s.i"), "_cy": F.col("ocy") + F.col("_s.j")}).drop("_s")
        return left.join(sent.hint("merge"), (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))).drop("_cx", "_cy")

    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("cx", "cy", "_s").orderBy("id"))
        some = left.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_k", rank).where(F.col("_k") <= at_once + 1)  # a cell may hold any number
        first = checkpointed(some.withColumn("_k", F.row_number().over(Window.partitionBy("cx", "cy").orderBy("id"))).where(F.col("_k") <= at_once + 1).drop("_s"))
        active = first.where(F.col("_k") <= at_once)
        # an open neighbour is known by an id that is no item: -1 and less
        others = active.select(F.col("id").alias("oid"), F.col("id").alias("oat"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cx").alias("ocx"), F.col("cy").alias("ocy"))
        open_ = first.where(F.col("_k") > at_once).select(F.lit(None).cast("long").alias("oid"), F.col("id").alias("oat"), F.lit(None).cast("double").alias("ox"), F.lit(None).cast("double").alias("oy"), F.col("cx").alias("ocx"), F.col("cy").alias("ocy"))
        near = _near(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), distance)
        met = meeting(others.union(open_)).where((F.col("oat") < F.col("id")) & F.coalesce(near, F.lit(True)))
        lower = met.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("oat", F.coalesce("oid", F.lit(_OPEN)).alias("j"))), asc=False).alias("l"))
        items = active.join(lower.hint("merge"), F.col("id") == F.col("_id"), "left").withColumn("lower", F.coalesce(F.col("l.j"), F.array().cast("array<bigint>")))
        items = checkpointed(items.select("id", "x", "y", "cx", "cy", "lower", F.transform("lower", lambda _: F.lit(False)).alias("names")))
        acts = decisions.decided(items, "cx", "cy", "id", block=block).where("act").select(F.col("id").alias("_id"))
        new = checkpointed(items.join(acts.hint("merge"), F.col("id") == F.col("_id")).select("id", "x", "y", "cx", "cy"))
        kept = new if kept is None else kept.union(new)
        gone = meeting(new.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cx").alias("ocx"), F.col("cy").alias("ocy"))).where(near).select(F.col("id").alias("_id")).distinct()
        left = checkpointed(left.join(gone.hint("merge"), F.col("id") == F.col("_id"), "left_anti"))
    if kept is None:
        return rest
    return kept.select(F.col("id").alias("tree_id"), "x", "y").union(rest)


#: Stands for the places of a cell that wait for their turn.
_OPEN = -(1 << 63)


def _near(x: Column, y: Column, other_x: Column, other_y: Column, distance: float) -> Column:
    return F.sqrt((x - other_x) * (x - other_x) + (y - other_y) * (y - other_y)) <= distance


#: Ids of copies in one array, on average at most.
IDS = 1 << 14


def stem_points(points: DataFrame, rings: DataFrame, dh: float = 0.5, outer: float = 0.05, inner: float = 0.05, tree_size: float = 3.0) -> DataFrame:
    """FLT10, JN14: (tree_id, cid, pid, x, y, z) points in the shell of each ring; one may be in several.

    Points outside the tree's half-open bounds (ring centres and half of
    ``tree_size`` around) are no stem points; rings meet points cell by cell.
    """
    edges = rings.groupBy("tree_id").agg(*[(f(c) + s * tree_size / 2).alias(f"{c}{k}") for c in "xy" for k, f, s in ((0, F.min, -1), (1, F.max, 1))])
    named = rings.select("tree_id", "cid", F.col("x").alias("rx"), F.col("y").alias("ry"), "r", F.col("z").alias("rz"))
    same = ["tree_id", "rx", "ry", "r", "rz"]
    # copies of a ring in a tree share their points, so points meet distinct rings; their ids come in shares of bounded size
    parts = max(1, -(-rings.count() // IDS))
    held = named.dropna(subset=same).groupBy(*same, F.pmod(F.xxhash64("cid"), F.lit(parts)).alias("_share"))
    copies = checkpointed(held.agg(F.sort_array(F.collect_list("cid")).alias("ids")).drop("_share"))
    ring = copies.select(*same).distinct().join(edges.withColumnRenamed("tree_id", "_tree"), F.col("tree_id") == F.col("_tree")).drop("_tree")
    reach, size = F.col("r") + outer, 1.0
    # only cells that the tree's bounds reach as well
    cells = lambda low, high: F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))
    spread = ring
    for c in "xy":
        low = F.floor(F.greatest(F.col(f"r{c}") - reach, F.col(f"{c}0")) / size)
        spread = spread.withColumn(f"c{c}", F.explode(cells(low, F.floor(F.least(F.col(f"r{c}") + reach, F.col(f"{c}1")) / size))))
    spread = spread.withColumn("cz", F.explode(F.sequence(F.floor((F.col("rz") - dh / 2) / dh), F.floor((F.col("rz") + dh / 2) / dh))))
    keyed = points.select("pid", "x", "y", "z", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("z") / dh).alias("cz"))
    off = F.sqrt((F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))) - F.col("r")
    inside = (F.col("z") >= F.col("rz") - dh / 2) & (F.col("z") < F.col("rz") + dh / 2) & (off < outer) & (off > -inner)
    inside = inside & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    met = keyed.join(spread.hint("merge"), ["cx", "cy", "cz"]).where(inside).select(*same, "pid", "x", "y", "z")
    each = met.join(copies.withColumnsRenamed({c: f"_{c}" for c in same}).hint("merge"), [F.col(c) == F.col(f"_{c}") for c in same])
    return each.select("tree_id", F.explode("ids").alias("cid"), "pid", "x", "y", "z")


def find_stem(circles: np.ndarray, seed: int = 0, tests: int = 100, at_least: int = 5, z_range: float = 2.0) -> np.ndarray | None:
    """GRF10: rows (x, y, r, z, n) of the circles along the best 3-D line through two random ones; None without one.

    A line needs ``at_least`` circles within 0.1 m, the height range, and more
    than one circle in every half metre or so.
    """
    if len(circles) < at_least:
        return None
    rng, best = np.random.default_rng(seed), None
    place, z = circles[:, :2], circles[:, 3]
    for _ in range(tests):
        i, j = rng.permutation(len(circles))[:2]
        if z[i] == z[j]:
            continue
        slope = (place[j] - place[i]) / (z[j] - z[i])
        off = place - (place[i] + slope * (z - z[i])[:, None])
        on = np.flatnonzero(np.hypot(off[:, 0], off[:, 1]) < 0.1)
        span = np.ptp(z[on])
        if len(on) < at_least or span < z_range or (best is not None and len(on) <= len(best)):
            continue
        filled = np.histogram(z[on], bins=np.linspace(z[on].min() - 0.01, z[on].max() + 0.01, int(np.ceil(span / 0.5))))[0]
        if (filled > 1).all():
            best = on
    if best is None:
        return None
    line = circles[best]
    return np.array([max(line[line[:, 3] == h], key=lambda c: c[4]) for h in np.unique(line[:, 3])])


def line_stems(circles: DataFrame, keys: list[str]) -> DataFrame:
    """GRF10 for each key (say, a tile): (keys, x, y, r, z, n)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in circles.schema if f.name in keys)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = find_stem(pdf.sort_values("cid")[["x", "y", "r", "z", "n"]].to_numpy(float), seed_of(*key))
        out = pd.DataFrame([] if found is None else found, columns=["x", "y", "r", "z", "n"])
        for k, v in zip(keys, key, strict=True):
            out.insert(0, k, v)
        return out[[*keys, "x", "y", "r", "z", "n"]]

    return circles.groupBy(*keys).applyInPandas(search, f"{fields}, x double, y double, r double, z double, n double")


def ring_rows(trees: DataFrame, parity: bool = False) -> DataFrame:
    """SNK11: tree_id, X, Y, Z, DBH_cm of each ring; ``parity`` negates Y and Z (Q21)."""
    s = -1.0 if parity else 1.0
    return trees.select("tree_id", F.col("x").alias("X"), (F.col("y") * s).alias("Y"), (F.col("z") * s).alias("Z"), (F.col("r") * 200.0).alias("DBH_cm"))
