"""Nearest stations for a table of points.

Positions lie on the unit sphere, cut into cubes of one side length, so neither the poles nor the date
line are special.  A station is filed in the 27 cubes around its own; a point looks into its own cube only and
meets every station within one side length.  Where the k-th distance found is no longer than that, it is proven.
The other points go on with sides twice as long, up to the whole sphere.  Every step is an equi-join on a
cube; the first side length is the largest at which a station shares its cube with few others on average, so
that stations which lie close together are not all compared with every point among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlens.functions import require_columns
from voltlens.functions.geo import EARTH_RADIUS_KM, great_circle_km
from voltlens.session import written

#: Cubes this long reach around the sphere from any point.
WHOLE = 2.0
#: Sides are halved this often at most, and begin where this many times the wanted stations share a cube.
LEVELS = 20
CROWD = 4
#: Share of a side length within which a distance counts as proven, against rounding.
SURE = 1 - 1e-9


def _axes(latitude: Column, longitude: Column) -> list[Column]:
    lat, lon = F.radians(latitude), F.radians(longitude)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _cubes(latitude: Column, longitude: Column, side: float) -> list[Column]:
    return [F.floor(a / F.lit(side)).alias(f"_c{i}") for i, a in enumerate(_axes(latitude, longitude))]


def _valid(latitude: Column, longitude: Column) -> Column:
    return latitude.between(-90, 90) & longitude.between(-180, 180)


def nearest_stations_of(points: DataFrame, stations: DataFrame, limit: int = 5) -> DataFrame:
    """Every row of ``points`` (latitude, longitude) with its ``limit`` closest stations (id, latitude, longitude).

    Adds ``rank``, ``id`` and ``distance_km``, closest first, ties by id.  Fewer stations give fewer rows; points
    and stations without a valid position take no part.  Equal points are searched once.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    require_columns(points, ["latitude", "longitude"], "points")
    require_columns(stations, ["id", "latitude", "longitude"], "stations")
    clash = {"rank", "id", "distance_km"} & {c.lower() for c in points.columns}
    if clash:
        raise ValueError(f"points must not have columns {sorted(clash)}")
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    placed = stations.select("id", lat.alias("_slat"), lon.alias("_slon")).where(_valid(F.col("_slat"), F.col("_slon")))
    # Of stations at one place only the first ones by id can be among the closest.
    order = Window.partitionBy("_slat", "_slon").orderBy("id")
    placed = written(placed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n"), "stations")
    open_ = points.select(lat.alias("_plat"), lon.alias("_plon")).where(_valid(F.col("_plat"), F.col("_plon"))).distinct()
    open_ = written(open_, "open")
    side, found = _first_side(placed, limit), []
    while True:
        last = side >= WHOLE
        near = written(_within(open_, placed, side, limit), "nearest")
        # The last of the wanted number lies within reach, or there are no more stations.
        done = near.groupBy("_plat", "_plon").agg(
            F.max("distance_km").alias("far"), F.count("id").alias("n")
        ).where(F.lit(last) | ((F.col("n") == limit) & (_chord(F.col("far")) <= F.lit(side * SURE))))
        closed = done.select("_plat", "_plon")
        found.append(near.join(closed, ["_plat", "_plon"], "left_semi"))
        if last:
            break
        open_ = written(open_.join(closed, ["_plat", "_plon"], "left_anti"), "open")
        if open_.isEmpty():
            break
        side = min(WHOLE, side * 2)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    every = every.select("_plat", "_plon", "rank", "id", "distance_km")
    asked = points.withColumns({"_plat": lat, "_plon": lon})
    return asked.join(every, ["_plat", "_plon"]).select(*[asked[c] for c in points.columns], "rank", "id", "distance_km")


def _first_side(placed: DataFrame, limit: int) -> float:
    """The largest side at which a station finds ``CROWD`` times ``limit`` stations in its cube, or fewer, on average."""
    axes = F.array(*_axes(F.col("_slat"), F.col("_slon")))
    levels = placed.select(axes.alias("_axes"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level"))
    cube = F.transform("_axes", lambda a: F.floor(a / F.lit(WHOLE) * F.pow(F.lit(2.0), F.col("_level"))))
    counted = levels.groupBy("_level", cube.alias("_cube")).agg(F.count("*").alias("_n"))
    shared = counted.groupBy("_level").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("_met")).collect()
    calm = [r["_level"] for r in shared if r["_met"] <= CROWD * limit]
    return WHOLE / 2 ** (min(calm) if calm else LEVELS if shared else 0)


def _chord(km: Column) -> Column:
    return 2 * F.sin(km / F.lit(2 * EARTH_RADIUS_KM))


def _within(points: DataFrame, placed: DataFrame, side: float, limit: int) -> DataFrame:
    """The closest stations of every point among those in the cubes around it."""
    step = F.sequence(F.lit(-1), F.lit(1))
    filed = placed.select("*", *_cubes(F.col("_slat"), F.col("_slon"), side))
    for i in range(3):
        filed = filed.withColumn("_step", F.explode(step)).withColumn(f"_c{i}", F.col(f"_c{i}") + F.col("_step")).drop("_step")
    asked = points.select("*", *_cubes(F.col("_plat"), F.col("_plon"), side))
    distance = great_circle_km(F.col("_plat"), F.col("_plon"), F.col("_slat"), F.col("_slon"))
    order = Window.partitionBy("_plat", "_plon").orderBy("distance_km", "id")
    return (
        asked.join(filed, ["_c0", "_c1", "_c2"]).select("_plat", "_plon", "id", distance.alias("distance_km"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    )


def recommended_stations_of(points: DataFrame, stations: DataFrame, scores: DataFrame, limit: int = 5) -> DataFrame:
    """Every point with its ``limit`` stations by score, then distance, then id; no score counts as -1.

    Scores do not depend on the point.  Stations above the score at which ``limit`` is passed go to every
    point, fewer than ``limit`` in number; distance decides among those with that score alone.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    own = stations.select("id", "latitude", "longitude").join(
        scores.select(F.col("station_id").alias("id"), "score"), "id", "left"
    ).select("id", "latitude", "longitude", F.coalesce("score", F.lit(-1.0)).alias("recommend_score"))
    own = written(own.where(_valid(F.col("latitude"), F.col("longitude"))), "scored")
    levels = own.groupBy("recommend_score").count().orderBy(F.desc("recommend_score")).limit(limit).collect()
    sure, edge, taken = [], None, 0
    for level in levels:
        if taken + level["count"] >= limit:
            edge = level["recommend_score"]
            break
        sure.append(level["recommend_score"])
        taken += level["count"]
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    first = own.where(F.col("recommend_score").isin(sure)) if sure else own.limit(0)
    listed = first.agg(F.coalesce(F.collect_list(F.struct("id", "latitude", "longitude", "recommend_score")), F.array()).alias("s")).scalar()
    valid = points.where(_valid(lat, lon))
    ahead = valid.withColumn("_s", F.explode(listed)).select(
        *points.columns, F.col("_s.id").alias("id"),
        great_circle_km(lat, lon, F.col("_s.latitude"), F.col("_s.longitude")).alias("distance_km"),
        F.col("_s.recommend_score").alias("recommend_score"),
    )
    order = [F.desc("recommend_score"), F.asc("distance_km"), F.asc("id")]
    if edge is not None:
        tied = nearest_stations_of(valid, own.where(F.col("recommend_score") == edge), limit - taken)
        # Equal points have equal answers, so rows of one point never mix with another's.
        ahead = ahead.unionByName(tied.drop("rank").withColumn("recommend_score", F.lit(edge)))
    place = F.row_number().over(Window.partitionBy(*[F.col(c) for c in points.columns], "id").orderBy(F.lit(1)))
    numbered = ahead.withColumn("_copy", place)
    rank = F.row_number().over(Window.partitionBy(*[F.col(c) for c in points.columns], "_copy").orderBy(*order))
    return numbered.withColumn("rank", rank).select(*points.columns, "rank", "id", "distance_km", "recommend_score")
