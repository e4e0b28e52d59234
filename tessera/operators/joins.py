"""Joins: keyed, anti, full-anti, calculated, lookups, blending, distance.

Spark chooses the physical join (broadcast hash when AQE measures a side as
small, else sort-merge with skew splitting).  We only force a broadcast for
sides whose size is bounded by construction or checked with
``broadcast_if_small`` (the optimizer's size estimate, read without running a
job; a side without a small estimate is left to AQE's runtime measurement).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.spatial import EARTH_RADIUS, arc, half_chord
from tessera.operators.sizing import estimated_bytes
from tessera.session import stored

Step = Callable[[DataFrame], DataFrame]

# Join kinds of the prep language and their Spark names.
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full",
              "leftOnly": "left_anti", "rightOnly": "right_anti", "notInner": "not_inner"}


# Fixed value: broadcast bound used when the caller gives none (Spark's default
# broadcast threshold is 10 MiB).
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the estimated size is within ``max_bytes``.

    Estimates of scans and projections are upper bounds; a side whose estimate
    is unknown or large gets no hint, and AQE still converts the join at
    runtime if the measured shuffle output turns out small.
    """
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame (a global aggregate) to every row.

    Planned as an uncorrelated scalar subquery: the aggregate runs once and its
    value is inlined into the projection — no join, no shuffle of ``df``.
    More than one row is an error, as for any scalar subquery.
    """
    cols = one_row.columns
    sub = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_s")).scalar()
    return df.withColumns({c: sub[c] for c in cols})


def _cond(left: DataFrame, right: DataFrame, left_keys, right_keys) -> Column:
    cond = None
    for lk, rk in zip(left_keys, right_keys):
        term = left[lk] == right[rk]
        cond = term if cond is None else cond & term
    return cond


def join(right: DataFrame, left_keys: Sequence[str] | str, right_keys: Sequence[str] | str | None = None,
         how: str = "left", expand: Sequence[str] | None = None) -> Step:
    """Keyed equi join that keeps the chosen right columns.

    inner/left keep the left key, right keeps the right key, full coalesces the
    two; left_anti/right_anti/not_inner return unmatched rows.
    """
    lks = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    rks = lks if right_keys is None else ([right_keys] if isinstance(right_keys, str) else list(right_keys))
    how = JOIN_KINDS.get(how, how)

    def step(left: DataFrame) -> DataFrame:
        r = right
        # Right columns that collide with left names get the suffix "_right".
        ren = {c: f"{c}_right" for c in r.columns if c in left.columns}
        r = r.withColumnsRenamed(ren)
        rk = [ren.get(k, k) for k in rks]
        keep = [ren.get(c, c) for c in (expand if expand is not None else right.columns)]
        keep = [c for c in keep if c not in rk]
        if how == "left_anti":
            return left.join(r, _cond(left, r, lks, rk), "left_anti")
        if how == "right_anti":
            return r.join(left, _cond(left, r, lks, rk), "left_anti").withColumnsRenamed(
                {v: k for k, v in ren.items()})
        if how == "not_inner":
            lo = left.join(r, _cond(left, r, lks, rk), "left_anti")
            ro = r.join(left, _cond(left, r, lks, rk), "left_anti").withColumnsRenamed(
                {v: k for k, v in ren.items()})
            return lo.unionByName(ro, allowMissingColumns=True)
        j = left.join(r, _cond(left, r, lks, rk), how)
        if how in ("inner", "left", "left_outer"):
            key_cols = [left[k] for k in lks]
        elif how in ("right", "right_outer"):
            key_cols = [r[k].alias(lk) for k, lk in zip(rk, lks)]
        else:  # full
            key_cols = [F.coalesce(left[lk], r[k]).alias(lk) for lk, k in zip(lks, rk)]
        others = [left[c] for c in left.columns if c not in lks]
        return j.select(*key_cols, *others, *[r[c] for c in keep])
    return step


def join_on(right: DataFrame, condition: Callable[[DataFrame, DataFrame], Column], how: str = "inner") -> Step:
    """Join on any condition built from both sides (calculated keys, theta clauses)."""
    return lambda left: left.join(right, condition(left, right), JOIN_KINDS.get(how, how))


def align_key_types(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Cast the right key to the left key's type so the join compares like with like."""
    t = left.schema[left_key].dataType
    return right.withColumn(right_key, F.col(right_key).try_cast(t))


def related(dim: DataFrame, key: str, columns: Sequence[str], dim_key: str | None = None,
            max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> Step:
    """Many-to-one lookup (RELATED): left join to the dimension, one row per key."""
    dk = dim_key or key

    def step(df: DataFrame) -> DataFrame:
        # Of several rows of a key the smallest (by the columns in their order) is taken, in every run.
        one = F.min(F.struct(*[F.col(c) for c in columns])).alias("_v")
        d = dim.groupBy(F.col(dk).alias("_rk")).agg(one).select("_rk", *[F.col("_v")[c].alias(c) for c in columns])
        d = broadcast_if_small(d, max_broadcast_bytes)
        return df.join(d, df[key].eqNullSafe(d["_rk"]), "left").drop("_rk")
    return step


def lookupvalue(target: DataFrame, target_key: str, value: str, key: str, name: str) -> Step:
    """LOOKUPVALUE: the target's value for the key when it is unique, else null."""
    def step(df: DataFrame) -> DataFrame:
        t = target.groupBy(F.col(target_key).alias("_lk")).agg(
            F.when(F.min(value) == F.max(value), F.min(value)).alias(name))
        return df.join(t, df[key] == t["_lk"], "left").drop("_lk")
    return step


def blend(secondary: DataFrame, links: Sequence[str], aggs: Sequence[Column],
          secondary_links: Sequence[str] | None = None) -> Step:
    """Data blending: aggregate the secondary source to the link fields, then left join.

    The aggregate is taken before the join (partial aggregation map-side), so
    the join never multiplies primary rows.
    """
    sl = list(secondary_links or links)

    def step(primary: DataFrame) -> DataFrame:
        agg = secondary.groupBy(*[F.col(s).alias(f"_b_{p}") for s, p in zip(sl, links)]).agg(*aggs)
        cond = None
        for p in links:
            term = primary[p].eqNullSafe(agg[f"_b_{p}"])
            cond = term if cond is None else cond & term
        return primary.join(agg, cond, "left").drop(*[f"_b_{p}" for p in links])
    return step


def within_distance(left: DataFrame, right: DataFrame, left_point: str, right_point: str,
                    radius_km: float, left_id: str, right_id: str, leaf: int = 4000) -> DataFrame:
    """Pairs of points no further apart than ``radius_km`` (great-circle).

    An equi join on grid cells instead of a cartesian product: latitude bands
    one radius high, and band ``b`` cut into equal longitude cells at least as
    wide as the radius at the band's pole-side edge.  Cells wrap around at +-180
    degrees, and a band within reach of a pole is one cell.  Each right point is
    keyed by its own (band, cell); each left point by the 3 neighbouring bands x
    3 neighbouring cells, so every pair within the radius meets exactly once,
    and the exact haversine test follows.

    A cell of more than ``leaf`` right points (a city) is a quadtree: it is halved in both directions as often as
    its count asks for, and a left point goes only to those of its parts that reach into the radius.  So a dense
    place is many keys, and pairs of its far ends are not compared.

    The sides change places where the left one has more points, so it is the fewer points that are copied.

    A part is one join key, if its comparisons are one task's work.  Else its rows of either side are cut into blocks, and
    a block pair is a join key of its own, so neither a crowded place nor one repeated point is one task's work.  Each block
    is copied for every block of the other side, and those copies are what the shuffle writes.  So blocks grow with the
    comparisons (there are about ``CORE_PAIRS`` full block pairs a core, or fewer), and the copies grow as the rows do, while
    comparisons and result grow as the product of both sides.  Only what a join buffers, a block of the side that is not
    copied to cells, stays below ``BLOCK`` rows.  The join's partitions follow its comparisons, whatever the rows' bytes.  A
    comparison is the chord between two unit vectors, made after the shuffle; only at the radius itself the haversine decides.
    """
    km_per_degree = 2 * math.pi * EARTH_RADIUS["km"] / 360
    deg = max(radius_km / km_per_degree, 1e-6)   # degrees of latitude per radius
    leaf = max(leaf, 1)

    def cells(band: Column) -> Column:
        edge = F.greatest(F.abs(band * deg), F.abs((band + 1) * deg)) + deg
        width = F.lit(deg) / F.cos(F.radians(F.least(edge, F.lit(89.9))))
        return F.when(edge >= 90 - deg, F.lit(1)).otherwise(F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))).cast("bigint")

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / n)), n).cast("bigint")

    def angles(p: Column, side: str) -> list[Column]:
        """What a comparison needs of a point: its unit vector, and latitude, longitude and cosine for the haversine."""
        lat, lon = F.radians(p["lat"]), F.radians(p["lon"])
        cols = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat), "a": lat, "o": lon, "c": F.cos(lat)}
        return [v.alias(f"_{side}{k}") for k, v in cols.items()]

    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n_left, n_all = left.select(F.lit(1).alias("_l")).unionAll(right.select(F.lit(0).alias("_l"))).agg(F.sum("_l"), F.count(F.lit(1))).first()
    swapped = 2 * (n_left or 0) > n_all
    if swapped:
        left, right, left_point, right_point, left_id, right_id = right, left, right_point, left_point, right_id, left_id

    band = lambda p: F.floor(p["lat"] / deg)
    finest, m = 1 << MAX_HALVINGS, F.col("_m")
    part = lambda x: F.least(F.greatest(F.floor(x * finest), F.lit(0)), F.lit(finest - 1)).cast("int")
    r = right.select(F.col(right_id).alias("_rid"), F.col(right_point).alias("_rp")).withColumn("_cy", band(F.col("_rp")))
    r = r.withColumn("_nx", cells(F.col("_cy"))).withColumn("_cx", cell(F.col("_rp")["lon"], F.col("_nx"))).where(F.col("_cx").isNotNull())
    r = r.withColumn("_f", part(F.col("_rp")["lat"] / deg - F.col("_cy")) * finest
                     + part(F.pmod(F.col("_rp")["lon"] + 180, F.lit(360.0)) / 360 * F.col("_nx") - F.col("_cx")))

    def coarse(f: Column) -> Column:
        """The part that holds the finest part ``f``, where the cell is cut into ``_m`` by ``_m``."""
        span = F.lit(finest) / m
        return (F.floor(F.floor(f / finest) / span) * m + F.floor((f % finest) / span)).cast("int")

    # Halvings of a dense cell: each divides its points by four, if they lie evenly.
    halvings = F.least(F.ceil(F.log(4.0, F.col("_n") / leaf)), F.lit(MAX_HALVINGS))
    held = lambda q: F.aggregate("_fine", F.lit(0).cast("bigint"), lambda n, f: n + F.when(coarse(f["_f"]) == q, f["_c"]).otherwise(0))
    counts = (r.groupBy("_cy", "_cx", "_f").agg(F.count(F.lit(1)).alias("_c"))
              .groupBy("_cy", "_cx").agg(F.collect_list(F.struct("_f", "_c")).alias("_fine"), F.sum("_c").alias("_n"))
              .withColumn("_m", F.when(F.col("_n") > leaf, F.pow(F.lit(2), halvings)).otherwise(1).cast("int"))
              .withColumn("_parts", F.filter(F.transform(F.sequence(F.lit(0), m * m - 1), lambda q: F.struct(q.alias("_q"), held(q).alias("_c"))),
                                             lambda p: p["_c"] > 0)).drop("_fine"))

    def around(df: DataFrame) -> DataFrame:
        """Left rows, once for each of the cells that a point within the radius may be in."""
        return (df.withColumn("_cy", F.explode(F.sequence(band(F.col("_lp")) - 1, band(F.col("_lp")) + 1)))
                .withColumn("_nx", cells(F.col("_cy"))).withColumn("_c0", cell(F.col("_lp")["lon"], F.col("_nx")))
                .withColumn("_cx", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_c0") + k, F.col("_nx")) for k in (-1, 0, 1)])))))

    l_ = left.select(F.col(left_id).alias("_lid"), F.col(left_point).alias("_lp"))
    near = around(l_).groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_ln"))
    # Of the left rows around a cell, one of its parts is met by the share within the radius of the part, if they lie evenly.
    share = F.when(m == 1, 1.0).otherwise((math.pi + F.lit(4.0) / m + F.lit(1.0) / (m * m)) / 9)
    places = stored(counts.join(near, ["_cy", "_cx"]).withColumn("_s", F.ceil(F.col("_ln") * share)), "places")
    compared, rows = places.agg(F.sum(F.col("_s").cast("double") * F.col("_n")), F.sum(F.col("_ln") + F.col("_n"))).first()
    work = max((compared or 0.0) / max(CORE_PAIRS * cores, LEAST_PAIRS), float(TASK_PAIRS))
    n = int(min(max(math.ceil(3 * (compared or 0.0) / work), math.ceil((rows or 0) / TASK_ROWS)), MAX_TASKS))
    # Fewer partitions than Spark's own would be shuffled again, and what fits one task is left to Spark.
    spread = lambda df: df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *names) if n > 1 else df

    def reached(q: Column) -> Column:
        """Part ``q`` of a dense cell may hold a point within the radius: neither its latitudes nor its meridians are too far."""
        lat, lon = F.col("_lp")["lat"], F.col("_lp")["lon"]
        south = (F.col("_cy") + F.floor(q / m) / m) * deg
        near_lat = (lat >= south - deg * SLACK) & (lat <= south + deg / m + deg * SLACK)
        width = F.lit(360.0) / F.col("_nx") / m
        ahead = F.pmod(lon + 180 - (F.col("_cx") / F.col("_nx") * 360 + (q % m) * width), F.lit(360.0))  # degrees east of the part's west edge
        off = F.greatest(F.least(ahead - width, 360 - ahead), F.lit(0.0))  # degrees outside of it
        # A meridian so many degrees away is this far, in degrees of a great circle; beyond 90 no bound is taken.
        across = F.degrees(F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(off, F.lit(90.0))))))
        return near_lat & ((off > 90) | (across <= deg * SLACK))

    # Block pairs: a row takes one block of its side in a part, and meets every block of the other.  Blocks of both sides
    # have the same rows, or all those of the side that has fewer.
    deal = lambda blocks, *cols: F.pmod(F.xxhash64(*cols), blocks)
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    c, even = F.col("_p._c"), F.lit(math.sqrt(work))
    blocks = {"_s": F.ceil(F.col("_s") * F.least(c, even) / work), "_t": F.greatest(F.ceil(c * F.least(F.col("_s"), even) / work), F.ceil(c / BLOCK))}
    key = F.shiftleft(F.shiftleft(F.col("_p._q").cast("bigint"), LIMIT) + F.col("_a"), LIMIT) + F.col("_b")
    names = ["_k", "_cx", "_cy"]
    places = places.select("_cy", "_cx", "_m", "_s", "_parts")
    l_ = spread(around(l_.repartition(3 * cores, "_lid", "_lp")).join(places, ["_cy", "_cx"])
          .withColumn("_p", F.explode("_parts")).where((m == 1) | reached(F.col("_p._q"))).withColumns(blocks)
          .select("*", deal(F.col("_s"), "_lid", "_lp").alias("_a"), each(F.col("_t")).alias("_b"))
          .select(key.alias("_k"), "_cx", "_cy", "_lid", F.col("_lp.lat"), F.col("_lp.lon"))
          ).select(*names, "_lid", *angles(F.struct("lat", "lon"), "l"))
    r = spread(r.join(places, ["_cy", "_cx"]).withColumn("_p", F.filter("_parts", lambda p: p["_q"] == coarse(F.col("_f")))[0]).withColumns(blocks)
         .select("*", deal(F.col("_t"), "_rid", "_rp").alias("_b"), each(F.col("_s")).alias("_a"))
         .select(key.alias("_k"), "_cx", "_cy", "_rid", F.col("_rp.lat"), F.col("_rp.lon"))
         ).select(*names, "_rid", *angles(F.struct("lat", "lon"), "r")).alias("r")
    # Twice the sine of half the angle is the chord; the margin is far above what rounding does to either test.
    chord = (2 * math.sin(min(max(radius_km, 0.0) / (2 * EARTH_RADIUS["km"]), math.pi / 2))) ** 2
    margin = chord * 1e-9 + 1e-14
    gap = [F.col(f"_l{k}") - F.col(f"_r{k}") for k in "xyz"]
    apart = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
    d = arc(half_chord(*[F.col(f"_l{k}") for k in "aoc"], *[F.col(f"_r{k}") for k in "aoc"]))
    within = F.when(apart > chord + margin, False).when(apart < chord - margin, True).otherwise(d <= radius_km)
    j = l_.join(r.hint("merge"), reduce(and_, [l_[c] == F.col(f"r.{c}") for c in names]) & within)
    ids = [F.col("_lid").alias(left_id), F.col("_rid").alias(right_id)]
    return j.select(*(ids[::-1] if swapped else ids), d.alias("distance_km"))


# Halvings of a dense cell at most (parts of a quarter of the radius: smaller ones cost a left point more keys than they
# spare it comparisons), and the share by which a part's distance may be rounded.
MAX_HALVINGS, SLACK = 2, 1 + 1e-9
# Comparisons that a block pair is meant for, and full block pairs for a core and at least: beyond those a block pair gets
# more comparisons.  Rows of a block of the buffered side at most, rows that a task of the join sorts, tasks at most (beyond
# that a task gets more), and the bits of a block's number, of which two and a part's make a key.
TASK_PAIRS, CORE_PAIRS, LEAST_PAIRS, BLOCK, TASK_ROWS, MAX_TASKS, LIMIT = 20_000_000, 32, 256, 1 << 17, 1_000_000, 20_000, 28


def cross(right: DataFrame) -> Step:
    """Join with no key, for scaffolds of dimension members (every region x every
    segment).  Left rows are dealt to as many salts as there are shuffle
    partitions and the right rows copied to each, so it is an equi join that
    Spark spreads and can split; neither side passes through the driver or has
    a size limit."""
    def step(left: DataFrame) -> DataFrame:
        salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Maps have no hash of their own; their JSON has.
        parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in left.schema]
        salted = left.withColumn("_tsr_salt", F.pmod(F.xxhash64(*parts), F.lit(salts)).cast("int"))
        copies = right.withColumn("_tsr_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(copies, "_tsr_salt").drop("_tsr_salt")
    return step
