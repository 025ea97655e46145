"""Transport topology derived from the sites: tiers, feeds and protection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators.graph import settled
from gridwright.operators.grid_join import nearest, within
from gridwright.operators.ordering import ordinal
from gridwright.operators.raster import sample
from gridwright.schema import CLEARANCE_M, HUB_FRACTION, HUB_SPACING, PROFILE_SAMPLES, REACH_M, RELAY_FRACTION

#: The first radius of searches for a neighbour.
NEAR_M = 400.0


def ranked(sites: DataFrame) -> DataFrame:
    """``sites`` with rank: highest altitude first, ties by id."""
    return settled(ordinal(sites, [F.desc("altitude"), F.col("site")], "rank"))


def _others(sites: DataFrame, *columns: str) -> DataFrame:
    return sites.select(F.col("site").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.col(c).alias(f"other_{c}") for c in columns])


def spacing(sites: DataFrame) -> float:
    """The median distance to the nearest other site; 0 without one."""
    apart = nearest(sites.select("site", "x", "y"), _others(sites), "site", "other", 1, NEAR_M, lambda: F.col("site") != F.col("other"))
    return float(apart.agg(F.median("distance")).first()[0] or 0.0)


def spaced_hubs(sites: DataFrame) -> DataFrame:
    """(site, turn) of ``sites`` with rank: hubs by rank, each at least twice the median spacing from those before it.

    The choice goes in parallel: a site is taken once all higher ones within the distance are out, and
    then puts those below it out, which is what going through the ranks one by one gives. The share of
    hubs is fixed; spacing may leave fewer.
    """
    least = HUB_SPACING * spacing(sites)
    pairs = within(sites.select("site", "x", "y", "rank"), _others(sites, "rank"), max(least, 1e-6))
    close = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 < least * least
    above = settled(pairs.where(close & (F.col("other_rank") < F.col("rank"))).select("site", F.col("other").alias("above")))
    left, taken = settled(sites.select("site", "rank")), None
    while not left.isEmpty():
        open_ = above.join(left.select(F.col("site").alias("above")), "above", "left_semi")
        now = settled(left.join(open_, "site", "left_anti"))
        taken = now if taken is None else taken.unionByName(now)
        out = above.join(now.select(F.col("site").alias("above")), "above", "left_semi")
        left = settled(left.join(now, "site", "left_anti").join(out, "site", "left_anti"))
    if taken is None:
        return sites.select("site", F.col("rank").alias("turn")).limit(0)
    wanted = max(1, round(HUB_FRACTION * sites.count()))
    return ordinal(taken, ["rank"], "turn").where(F.col("turn") <= wanted).select("site", "turn")


def tiers(sites: DataFrame) -> DataFrame:
    """``sites`` with rank and tier: spaced hubs, then relays by rank up to the fleet's share, then edges."""
    by_rank = ranked(sites)
    hubs = settled(spaced_hubs(by_rank).select("site"))
    relays = round(RELAY_FRACTION * by_rank.count())
    rest = ordinal(by_rank.join(hubs, "site", "left_anti"), ["rank"], "place")
    below = rest.withColumn("tier", F.when(F.col("place") <= relays, "relay").otherwise("edge")).drop("place")
    return settled(by_rank.join(hubs, "site", "left_semi").withColumn("tier", F.lit("hub")).unionByName(below))


def clears(grid: Column, x0: Column, y0: Column, z0: Column, x1: Column, y1: Column, z1: Column) -> Column:
    """Whether the straight line stays ``CLEARANCE_M`` over the ground at each of ``PROFILE_SAMPLES`` places."""

    def low(k: Column) -> Column:
        t = k / float(PROFILE_SAMPLES - 1)
        return z0 + (z1 - z0) * t - F.round(sample(grid, x0 + (x1 - x0) * t, y0 + (y1 - y0) * t), 6) < CLEARANCE_M

    return ~F.exists(F.sequence(F.lit(0), F.lit(PROFILE_SAMPLES - 1)), low)


def _roots(parents: DataFrame, hubs: DataFrame) -> DataFrame:
    """(site, root): the hub at the end of each site's ``parents`` (site, parent), by doubling pointers."""
    at = settled(parents.select("site", F.col("parent").alias("root")).unionByName(hubs.select("site", F.col("site").alias("root"))))
    while True:
        further = at.select(F.col("site").alias("root"), F.col("root").alias("further"))
        fresh = settled(at.join(further, "root").select("site", F.col("root").alias("old"), F.col("further").alias("root")))
        at = fresh.select("site", "root")
        if fresh.where("old <> root").isEmpty():
            return at


def feeds(sites: DataFrame, grid: DataFrame) -> DataFrame:
    """(site, parent, role, distance, clear): each relay's and edge's primary feed and, where there is one, its protection.

    The primary is the nearest higher-ranked site within reach whose line clears the ground, else the
    nearest higher-ranked one at all. Protection is a higher-ranked site within reach that hangs on
    another hub: clear ones first, then the nearest. ``sites`` has z, the antenna's height; ``grid`` as
    of ``raster.as_array``.
    """
    fleet = tiers(sites)
    low, hubs = fleet.where("tier <> 'hub'").select("site", "x", "y", "z", "rank"), fleet.where("tier = 'hub'").select("site")
    other = _others(fleet, "z", "rank")
    higher = F.col("other_rank") < F.col("rank")

    def seen(pairs: DataFrame) -> DataFrame:
        clear = clears(F.col("grid"), *[F.col(c) for c in ("x", "y", "z", "x2", "y2", "other_z")])
        return pairs.crossJoin(F.broadcast(grid)).select("site", F.col("other").alias("parent"), "distance", clear.alias("clear"))

    distance = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    reach = settled(seen(within(low, other, REACH_M).where(higher).withColumn("distance", distance)))
    best = reach.where("clear").groupBy("site").agg(F.min(F.struct("distance", "parent")).alias("b")).select("site", "b.parent", "b.distance", F.lit(True).alias("clear"))
    alone = low.join(best, "site", "left_anti")
    primary = settled(best.unionByName(seen(nearest(alone, other, "site", "other", 1, REACH_M, lambda: higher))))
    roots = _roots(primary, hubs)
    own = primary.select("site", F.col("parent").alias("first")).join(roots, "site")
    theirs = roots.select(F.col("site").alias("parent"), F.col("root").alias("their_root"))
    diverse = reach.join(own, "site").join(theirs, "parent").where("parent <> first and their_root <> root")
    protect = diverse.groupBy("site").agg(F.min(F.struct(~F.col("clear"), "distance", "parent", "clear")).alias("b")).select("site", "b.parent", "b.distance", "b.clear")
    return primary.withColumn("role", F.lit("primary")).unionByName(protect.withColumn("role", F.lit("protect"))).select("site", "parent", "role", "distance", "clear")
