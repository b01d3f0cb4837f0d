"""Point tables (cloud_id, point_id, x, y, z, ...): scaling, voxels, sampling, neighbours, distances, augmentation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import md5_number, md5_unit
from ragloom.operators.allclouds import farthest_of
from ragloom.operators.nearest import nearest_points
from ragloom.operators.ranks import ranked_in_groups
from ragloom.session import spread, stash

AXES = ("x", "y", "z")


def _cloud():
    return Window.partitionBy("cloud_id")


def distance2(a: str = "", b: str = "b_") -> Column:
    """Squared distance of (x, y, z) under two column prefixes."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in AXES), F.lit(0.0))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def per_cloud(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds aggregates of each cloud; they combine before the shuffle and come back by a join."""
    return df.join(df.groupBy("cloud_id").agg(*[c.alias(n) for n, c in aggregates.items()]), "cloud_id")


def unit_sphere(df: DataFrame) -> DataFrame:
    """Centred on the centroid, farthest point at distance 1."""
    d = per_cloud(df, **{f"m{c}": F.avg(c) for c in AXES})
    for c in AXES:
        d = d.withColumn(c, F.col(c) - F.col(f"m{c}"))
    d = per_cloud(d.drop("mx", "my", "mz"), far=F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))))
    for c in AXES:
        d = d.withColumn(c, F.col(c) / F.col("far"))
    return d.drop("far")


def min_shift(df: DataFrame) -> DataFrame:
    d = per_cloud(df, **{f"m{c}": F.min(c) for c in AXES})
    for c in AXES:
        d = d.withColumn(c, F.col(c) - F.col(f"m{c}"))
    return d.drop("mx", "my", "mz")


def height(df: DataFrame, axis: str = "z") -> DataFrame:
    return per_cloud(df, low=F.min(axis)).withColumn("height", F.col(axis) - F.col("low")).drop("low")


def align(df: DataFrame, gravity: str = "z") -> DataFrame:
    """Centred in the plane, floor at zero."""
    d = per_cloud(df, **{f"m{c}": F.min(c) if c == gravity else F.avg(c) for c in AXES})
    for c in AXES:
        d = d.withColumn(c, F.col(c) - F.col(f"m{c}"))
    return d.drop("mx", "my", "mz")


def voxels(df: DataFrame, size: float) -> DataFrame:
    """Adds the cell (vx, vy, vz) of each point."""
    for c in AXES:
        df = df.withColumn(f"v{c}", F.floor(F.col(c) / size).cast("long"))
    return df


CELL = ("cloud_id", "vx", "vy", "vz")


def voxel_ravel(df: DataFrame) -> DataFrame:
    """Adds voxel, one number per cell of a cloud, from cells shifted to the cloud's minimum."""
    low = {f"l{c}": F.min(f"v{c}") for c in AXES}
    high = {f"h{c}": F.max(f"v{c}") for c in AXES}
    d = per_cloud(df, **low, **high)
    p = [F.col(f"v{c}") - F.col(f"l{c}") for c in AXES]
    n = [F.col(f"h{c}") - F.col(f"l{c}") + 1 for c in AXES]
    return d.withColumn("voxel", (p[0] * n[1] + p[1]) * n[2] + p[2]).drop(*low, *high)


def draw(*key: str, seed: str = "0") -> Column:
    """Seeded order of points: md5 of seed, cloud and point."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]))


def voxel_sample(df: DataFrame) -> DataFrame:
    """One drawn point of each cell."""
    return df.groupBy(*CELL).agg(F.min_by("point_id", draw("cloud_id", "point_id")).alias("point_id"), F.count(F.lit(1)).alias("n"))


def voxel_rounds(df: DataFrame) -> DataFrame:
    """(cloud_id, round, point_id): in round i every cell gives its member i mod count; all points appear."""
    w = Window.partitionBy(*CELL)
    d = df.withColumn("r", F.row_number().over(w.orderBy("point_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    d = per_cloud(d, rounds=F.max("n"))
    rounds = F.sequence(F.col("r").cast("long"), F.col("rounds") - 1, F.col("n"))
    return d.select("cloud_id", F.explode(rounds).alias("round"), "point_id")


def grid_barycenter(df: DataFrame, label: str) -> DataFrame:
    """Mean place and feature of each cell, and its most frequent label, the smallest on ties."""
    counts = df.groupBy(*CELL, label).agg(*[F.sum(c).alias(c) for c in (*AXES, "f1")], F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))["l"].alias(label)
    return counts.groupBy(*CELL).agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in (*AXES, "f1")], best, F.sum("n").alias("n"))


def _drawn(df: DataFrame, seed: str, most) -> DataFrame:
    """Adds place by drawn order, see ranked_in_groups; the whole draw settles what its first digits leave open."""
    drawn = df.withColumn("_draw", draw("cloud_id", "point_id", seed=seed))
    return ranked_in_groups(drawn, "cloud_id", F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long"), "_draw", "point_id", most=most).drop("_draw")


def sample(df: DataFrame, n: int, replace: bool = False, seed: str = "0") -> DataFrame:
    """n points of each cloud: the first by drawn order, or n draws with replacement."""
    if not replace:
        return _drawn(df, seed, n).withColumn("place", F.col("place") - 1)
    ordered = _drawn(df, seed, None).withColumn("place", F.col("place") - 1)
    sizes = df.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("size")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    picks = sizes.withColumn("place", md5_number(seed, F.col("cloud_id"), F.col("draw")) % F.col("size"))
    return picks.join(ordered, ["cloud_id", "place"])


def crop_nearest(df: DataFrame, most: int) -> DataFrame:
    """The points nearest to a cloud's middle point (by id order), at most ``most``."""
    sizes = df.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_n"))
    by_id = ranked_in_groups(df, "cloud_id", F.col("point_id")).join(sizes, "cloud_id")
    centre = by_id.where(F.col("place") - 1 == F.floor(F.col("_n") / 2)).select("cloud_id", *[F.col(c).alias(f"b_{c}") for c in AXES])
    d = df.join(centre, "cloud_id").withColumn("d2", F.round(distance2(), 9))
    return ranked_in_groups(d, "cloud_id", F.col("d2"), "point_id", most=most).withColumnRenamed("place", "rank")


def pad(df: DataFrame, size: int) -> DataFrame:
    """(cloud_id, place, point_id, valid): short clouds repeat their points up to a fixed size."""
    sizes = df.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_n"))
    r = ranked_in_groups(df, "cloud_id", F.col("point_id"), most=size).join(sizes, "cloud_id").withColumn("_r", F.col("place") - 1)
    places = F.sequence(F.col("_r").cast("long"), F.lit(size - 1).cast("long"), F.least("_n", F.lit(size).cast("long")))
    return r.select("cloud_id", F.explode(places).alias("place"), "point_id", "_n").select("cloud_id", "place", "point_id", (F.col("place") < F.col("_n")).cast("long").alias("valid"))


def split_near(df: DataFrame, view: tuple[float, float, float], k: int) -> DataFrame:
    """Adds removed: the k points of each cloud nearest to a viewpoint."""
    d = df.select("*", *[F.lit(v).alias(f"b_{c}") for c, v in zip(AXES, view, strict=True)]).withColumn("d2", F.round(distance2(), 9))
    d = ranked_in_groups(d, "cloud_id", F.col("d2"), "point_id", most=k, keep_rest=True)
    return d.withColumn("removed", F.col("place").isNotNull()).drop("place")


def farthest_points(df: DataFrame, n: int) -> DataFrame:
    """(cloud_id, place, point_id): farthest-point sampling from the smallest id, ties to the smaller id.

    Each round every point meets the few chosen ones of its cloud, and one
    aggregate that combines before the shuffle finds the farthest: a cloud of
    any size is spread over all tasks, and only chosen points are written.
    """
    points = df.select("cloud_id", F.struct("point_id", *AXES).alias("p"))
    chosen = points.groupBy("cloud_id").agg(F.array(F.min_by("p", "p.point_id")).alias("chosen"))
    for _ in range(n - 1):
        apart = lambda c: sum(((F.col(f"p.{x}") - c[x]) * (F.col(f"p.{x}") - c[x]) for x in AXES), F.lit(0.0))
        left = points.join(chosen, "cloud_id").where(~F.exists("chosen", lambda c: c["point_id"] == F.col("p.point_id")))
        left = left.withColumn("d2", F.array_min(F.transform("chosen", apart)))
        best = left.groupBy("cloud_id").agg(F.max_by("p", F.struct("d2", -F.col("p.point_id"))).alias("best"))
        longer = F.when(F.col("best").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("best")))
        chosen = stash(chosen.join(best, "cloud_id", "left").select("cloud_id", longer.alias("chosen")), "chosen-points")
    places = chosen.select("cloud_id", F.posexplode("chosen").alias("place", "p"))
    return places.select("cloud_id", F.col("place").cast("long").alias("place"), "p.point_id")


def neighbours(q: DataFrame, s: DataFrame, k: int, farthest: bool = False) -> DataFrame:
    """(cloud_id, q, s, d2, rank): the k nearest support points of each query point of the same cloud, ties to the smaller id.

    Blocks of points are looked up by rings, see nearest_points.  The farthest
    points have no such order: there the blocks of a cloud pass by all queries,
    see farthest_of, and no pair but the k of a query leaves a task.
    """
    pairs = farthest_of(q, s, k) if farthest else nearest_points(q, s, k)
    pairs = pairs.withColumn("d2", F.round("d2", 9))
    w = Window.partitionBy("cloud_id", "q").orderBy(F.desc("d2") if farthest else F.col("d2"), "s")
    return pairs.select("cloud_id", "q", "s", "d2", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)


def within(q: DataFrame, s: DataFrame, radius: float, asking: str = "q") -> DataFrame:
    """(cloud_id, q, s, d2) of pairs within a radius: points meet by equal cells of that size, each point of the side that asks (the smaller, best) naming its 27."""
    a = voxels(q, radius).select("cloud_id", F.col("point_id").alias("q"), *AXES, "vx", "vy", "vz")
    b = voxels(s, radius).select("cloud_id", F.col("point_id").alias("s"), *[F.col(c).alias(f"b_{c}") for c in AXES], "vx", "vy", "vz")
    a, b = (_around(a), b) if asking == "q" else (a, _around(b))
    # The bound is rounded as the distances are: 0.2 * 0.2 lies above 0.04.
    return a.join(b, list(CELL)).withColumn("d2", F.round(distance2(), 9)).where(F.col("d2") < round(radius * radius, 9)).select("cloud_id", "q", "s", "d2")


def _around(df: DataFrame) -> DataFrame:
    """Each row once for each of the 27 cells about its own."""
    df = df.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(27)])))
    for i, c in enumerate(AXES):
        df = df.withColumn(f"v{c}", F.try_add(F.col(f"v{c}"), F.floor(F.col("_k") / 3**i) % 3 - 1))
    return df.drop("_k")


#: Clouds of more points are searched for balls in rounds of ids, the first of so many points of a cloud, then of GROWTH times as many.
PLAIN, FIRST, GROWTH = 1024, 64, 8


def ball_query(q: DataFrame, s: DataFrame, radius: float, n: int) -> DataFrame:
    """(cloud_id, q, place, s): up to n points within the radius by id, short groups filled with their first."""
    g = _balls(q, s, radius, n).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return g.select("cloud_id", "q", F.col("place").cast("long").alias("place"), F.coalesce(F.get("found", F.col("place")), F.get("found", F.lit(0))).alias("s"))


def _first_within(near: DataFrame, n: int) -> DataFrame:
    """(cloud_id, q, found): the n smallest ids of each query, in order."""
    r = near.withColumn("place", F.row_number().over(Window.partitionBy("cloud_id", "q").orderBy("s"))).where(F.col("place") <= n)
    return r.groupBy("cloud_id", "q").agg(F.array_sort(F.collect_list("s")).alias("found"))


def _balls(q: DataFrame, s: DataFrame, radius: float, n: int) -> DataFrame:
    """(cloud_id, q, found): the n smallest ids within the radius of each query that has any.

    A query of a large cloud first meets the smallest ids of its cloud, and
    goes on to the next, of which there are more each round, only while it has
    found fewer than n: where many points are near, few of them are looked at.
    """
    sizes = s.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= PLAIN:
        return _first_within(within(q, s, radius), n)
    ends = [FIRST]
    while ends[-1] < most:
        ends.append(ends[-1] * GROWTH)
    upto = sizes.agg(*[F.sum(F.least("n", F.lit(e))) for e in ends]).first()
    points = s.select("cloud_id", "point_id", *AXES)
    points = stash(ranked_in_groups(points, "cloud_id", F.col("point_id")), "points-by-id")
    left = q.select("cloud_id", "point_id", *AXES, F.array().cast("array<long>").alias("found"))
    rounds, n_left = [], None
    for i, end in enumerate(ends):
        part = points.where((F.col("place") > (ends[i - 1] if i else 0)) & (F.col("place") <= end))
        n_part = upto[i] - (upto[i - 1] if i else 0)
        asking = "q" if n_left is not None and n_left < n_part else "s"
        left = spread(left, "cloud_id", "point_id")
        more = _first_within(within(left, part, radius, asking), n).select("cloud_id", F.col("q").alias("point_id"), F.col("found").alias("more"))
        left = left.join(more, ["cloud_id", "point_id"], "left")
        left = left.withColumn("found", F.when(F.col("more").isNull(), F.col("found")).otherwise(F.slice(F.concat("found", "more"), 1, n))).drop("more")
        state = stash(left, "balls")
        last = end == ends[-1]
        rounds.append(state.where(F.size("found") > 0 if last else F.size("found") == n))
        left = state.where(F.size("found") < n)
        n_left = left.count()
        if not n_left:
            break
    return reduce(DataFrame.union, rounds).select("cloud_id", F.col("point_id").alias("q"), "found")


def relative(groups: DataFrame, df: DataFrame, radius: float = 1.0) -> DataFrame:
    """Adds dx, dy, dz of each member from its centre, over the radius, and the member's and the centre's feature."""
    a = df.select("cloud_id", F.col("point_id").alias("q"), *AXES, F.col("f1").alias("own"))
    b = df.select("cloud_id", F.col("point_id").alias("s"), *[F.col(c).alias(f"b_{c}") for c in AXES], F.col("f1").alias("member"))
    d = groups.join(a, ["cloud_id", "q"]).join(b, ["cloud_id", "s"])
    for c in AXES:
        d = d.withColumn(f"d{c}", (F.col(f"b_{c}") - F.col(c)) / radius)
    return d


def interpolate(q: DataFrame, s: DataFrame, squared: bool = False) -> DataFrame:
    """(cloud_id, q, value): feature by the three nearest, weighted by 1 / (distance + 1e-8)."""
    near = neighbours(q, s, 3).join(s.select("cloud_id", F.col("point_id").alias("s"), "f1"), ["cloud_id", "s"])
    w = 1 / ((F.col("d2") if squared else F.sqrt("d2")) + 1e-8)
    return near.groupBy("cloud_id", "q").agg((F.sum(w * F.col("f1")) / F.sum(w)).alias("value"))


def nearest_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cloud_id, d2): squared distance of each point of a to its nearest in b."""
    return nearest_points(a, b, 1).groupBy("cloud_id", "q").agg(F.min("d2").alias("d2")).select("cloud_id", "d2")


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cloud_id, there, back, l2, l1)."""
    m = [nearest_distances(*p).groupBy("cloud_id").agg(F.avg("d2").alias(f"{n}2"), F.avg(F.sqrt("d2")).alias(f"{n}1")) for p, n in (((a, b), "there"), ((b, a), "back"))]
    d = m[0].join(m[1], "cloud_id")
    return d.select("cloud_id", F.col("there2").alias("there"), F.col("back2").alias("back"), (F.col("there2") + F.col("back2")).alias("l2"), ((F.col("there1") + F.col("back1")) / 2).alias("l1"))


def shape_f1(truth: DataFrame, guess: DataFrame, tau: float = 0.1, edge: float = 10.0) -> DataFrame:
    """(cloud_id, precision, recall, f1) in percent, both clouds scaled so that the truth's longest box edge is ``edge``."""
    box = truth.groupBy("cloud_id").agg(F.greatest(*[F.max(c) - F.min(c) for c in AXES]).alias("box"))
    scale = F.lit(edge) / F.greatest("box", F.lit(1e-8))
    t, g = (x.join(box, "cloud_id").select("cloud_id", "point_id", *[(F.col(c) * scale).alias(c) for c in AXES]) for x in (truth, guess))
    share = lambda d, n: d.groupBy("cloud_id").agg((100 * F.avg((F.sqrt("d2") < tau).cast("double"))).alias(n))
    d = share(nearest_distances(g, t), "precision").join(share(nearest_distances(t, g), "recall"), "cloud_id")
    return d.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))


def refine(df: DataFrame, allowed: DataFrame, least: int) -> DataFrame:
    """(cloud_id, point_id, seg): points of a segment with fewer than ``least`` members, or not allowed for the cloud,
    take the most frequent other segment among their least + 1 nearest; one pass over the original labels."""
    sizes = df.groupBy("cloud_id", "seg").agg(F.count(F.lit(1)).alias("n"))
    fine = sizes.where(F.col("n") >= least).join(allowed, ["cloud_id", "seg"], "left_semi").select("cloud_id", "seg", F.lit(True).alias("fine"))
    d = df.join(fine, ["cloud_id", "seg"], "left")
    odd = d.where("fine is null")
    near = neighbours(odd, df, least + 1).join(df.select("cloud_id", F.col("point_id").alias("s"), F.col("seg").alias("other")), ["cloud_id", "s"])
    near = near.join(odd.select("cloud_id", F.col("point_id").alias("q"), "seg"), ["cloud_id", "q"]).where("other <> seg")
    votes = near.groupBy("cloud_id", "q", "other").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("cloud_id", F.col("q").alias("point_id")).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("other").alias("o")))["o"].alias("new"))
    return d.join(best, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", F.coalesce("new", "seg").alias("seg"))


def depth_raster(df: DataFrame, width: int, scale: float, near: float = 1.0) -> DataFrame:
    """(cloud_id, px, py, depth): points projected to x/z, y/z and spread over 4 x 4 pixels, weighted by nearness."""
    d = df.withColumn("depth", F.col("z") + near).where("depth > 0")
    u, v = (F.col("x") / F.col("depth") + 1) * scale, (F.col("y") / F.col("depth") + 1) * scale
    d = d.withColumn("u", u).withColumn("v", v).withColumn("i", F.explode(F.array(*map(F.lit, (-2, -1, 0, 1))))).withColumn("j", F.explode(F.array(*map(F.lit, (-2, -1, 0, 1)))))
    d = d.withColumn("px", F.ceil(F.col("u") + F.col("i")).cast("long")).withColumn("py", F.ceil(F.col("v") + F.col("j")).cast("long"))
    w = 1 / (F.col("depth") + 1e-12)
    return d.where(f"px >= 0 and px < {width} and py >= 0 and py < {width}").groupBy("cloud_id", "px", "py").agg((F.sum(w * F.col("depth")) / F.sum(w)).alias("depth"))


def batch_offsets(df: DataFrame) -> DataFrame:
    """(cloud_id, batch, n, offset_end): running ends over the table of cloud sizes."""
    sizes = df.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    # Ranges of clouds are summed apart, and a table of ranges gives each its start: no task orders all clouds.
    ranges = stash(sizes.repartitionByRange("cloud_id").withColumn("_range", F.spark_partition_id()), "cloud-sizes")
    sums = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_rows", "_sum")])
    w = Window.partitionBy("_range").orderBy("cloud_id")
    d = ranges.join(starts, "_range")
    return d.select("cloud_id", (F.col("_rows") + F.row_number().over(w) - 1).cast("long").alias("batch"), "n", (F.col("_sum") + F.sum("n").over(w)).alias("offset_end"))


def features_by_key(keys: str) -> Column:
    """Named columns as one array; pos stands for x, y, z."""
    names = [c for k in keys.split(",") for c in (AXES if k == "pos" else (k,))]
    return F.array(*[F.col(c).cast("double") for c in names])


def uniform(name: str, *key: str, low: float = 0.0, high: float = 1.0, seed: str = "0") -> Column:
    return F.lit(low) + md5_unit(seed, name, *[F.col(k) for k in (key or ("cloud_id",))]) * (high - low)


def gaussian(name: str, *key: str, seed: str = "0") -> Column:
    """A normal draw from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(name + "a", *key, seed=seed))) * F.cos(2 * np.pi * uniform(name + "b", *key, seed=seed))


def clip(c: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), c))


def rotate(df: DataFrame, x: Column | None = None, y: Column | None = None, z: Column | None = None) -> DataFrame:
    """Turned about the x, then y, then z axis by angles given per row."""
    for angle, (a, b) in ((x, ("y", "z")), (y, ("z", "x")), (z, ("x", "y"))):
        if angle is not None:
            d = df.withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle))
            df = d.withColumns({a: F.col("_c") * F.col(a) - F.col("_s") * F.col(b), b: F.col("_s") * F.col(a) + F.col("_c") * F.col(b)}).drop("_c", "_s")
    return df


def dropout(df: DataFrame, ratio: float) -> DataFrame:
    """int(n * (1 - ratio)) points of each cloud in drawn order."""
    return _drawn(df, "0", F.floor(F.col("_size") * (1 - ratio))).drop("place")
