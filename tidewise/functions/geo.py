"""Distances and grids on plain latitude and longitude columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ellipsoid of WGS 84: its longer radius in metres, and its flattening.
RADIUS_M, FLATTENING = 6378137.0, 1 / 298.257223563
#: Degrees per metre, with room for the shortest radius of curvature.
DEGREES_PER_M = math.degrees(1 / RADIUS_M) * 1.008
METRES_PER_MILE = 1609.34
KM_PER_DEGREE = 111.0
CELL = 0.05


def distance_m(lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    """Metres on the ellipsoid by Andoyer and Lambert: the great circle between reduced latitudes, corrected to the first order in the flattening.

    Below a hundred kilometres it is within a decimetre of the geodesic.
    """
    square = lambda x: x * x
    reduced = lambda x: F.atan((1 - FLATTENING) * F.tan(F.radians(x)))

    def central(p: Column) -> Column:
        """Half the middle and half the difference of the latitudes, and the square of the sine of half the angle."""
        h = square(F.sin((p["b"] - p["a"]) / 2)) + F.cos(p["a"]) * F.cos(p["b"]) * square(F.sin(p["lng"] / 2))
        return F.struct(((p["a"] + p["b"]) / 2).alias("middle"), ((p["b"] - p["a"]) / 2).alias("half"), F.when(h > 1, 1.0).otherwise(h).alias("h"))

    def metres(p: Column) -> Column:
        angle, h = p["angle"], p["p"]["h"]
        x = (angle - F.sin(angle)) * square(F.sin(p["p"]["middle"]) * F.cos(p["p"]["half"])) / F.nullif(1 - h, F.lit(0.0))
        y = (angle + F.sin(angle)) * square(F.cos(p["p"]["middle"]) * F.sin(p["p"]["half"])) / F.nullif(h, F.lit(0.0))
        return RADIUS_M * (angle - FLATTENING / 2 * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))

    latitudes = F.struct(reduced(lat).alias("a"), reduced(to_lat).alias("b"), F.radians(to_lng - lng).alias("lng"))
    angle = lambda p: F.struct(p.alias("p"), (2 * F.asin(F.sqrt(p["h"]))).alias("angle"))
    return _step(_step(_step(latitudes, central), angle), metres)


def _step(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: expressions that use a value often would else grow with every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distance_sql(lat: str, lng: str, to_lat: str, to_lng: str) -> str:
    """The same as DuckDB SQL."""
    flat = "(1::double / 298.257223563::double)"
    a, b = (f"atan((1 - {flat}) * tan(radians({x})))" for x in (lat, to_lat))
    h = f"(pow(sin(({b} - {a}) / 2), 2) + cos({a}) * cos({b}) * pow(sin(radians({to_lng} - {lng}) / 2), 2))"
    h = f"(case when {h} > 1 then 1::double else {h} end)"
    angle, p, q = f"(2 * asin(sqrt({h})))", f"(({a} + {b}) / 2)", f"(({b} - {a}) / 2)"
    x = f"({angle} - sin({angle})) * pow(sin({p}) * cos({q}), 2) / nullif(1 - {h}, 0)"
    y = f"({angle} + sin({angle})) * pow(cos({p}) * sin({q}), 2) / nullif({h}, 0)"
    return f"(6378137::double * ({angle} - {flat} / 2 * (coalesce({x}, 0) + coalesce({y}, 0))))"


def reach(point: tuple[float, float], radius_m: float) -> tuple[float, float | None]:
    """Degrees of latitude and longitude that a radius can reach; no longitude near a pole or across longitude 180."""
    d_lat = radius_m * DEGREES_PER_M
    if abs(point[0]) + d_lat >= 89.0:
        return d_lat, None
    d_lng = d_lat / math.cos(math.radians(abs(point[0]) + d_lat))
    return d_lat, d_lng if -180 <= point[1] - d_lng and point[1] + d_lng <= 180 else None


def within_radius(lat: Column, lng: Column, point: tuple[float, float], radius_m: float) -> Column:
    """Inclusive radius test: plain ranges that scans can prune by, then the distance."""
    d_lat, d_lng = reach(point, radius_m)
    box = lat.between(point[0] - d_lat, point[0] + d_lat)
    if d_lng is not None:
        box = box & lng.between(point[1] - d_lng, point[1] + d_lng)
    return box & (distance_m(lat, lng, F.lit(float(point[0])), F.lit(float(point[1]))) <= radius_m)


def miles(metres: Column) -> Column:
    """Miles to one decimal place; a distance of exactly 0 has none."""
    return F.when(metres != 0, F.round(metres / METRES_PER_MILE, 1))


def cell(lat: Column, lng: Column) -> list[Column]:
    """Integer cell of a point, to join points with their surroundings by equality."""
    return [F.floor(lat / CELL).alias("cell_lat"), F.floor(lng / CELL).alias("cell_lng")]


def nearby_pairs(points: DataFrame, places: DataFrame, radius_m: float, most: int = 100_000) -> DataFrame:
    """Every (point, place) within the radius, for tables with lat and lng: cells first, then the distance.

    A point looks at the cells around it that the radius can reach, so no pair beyond them is ever made. Cells go round the globe, so the
    radius may cross longitude 180. Cells with over `most` places are dealt to parts of that size, and points go to each of them, so that no task sees more
    of one cell; cells without places get no points.
    """
    around = round(360 / CELL)
    reach_lat = math.ceil(radius_m * DEGREES_PER_M / CELL)
    widest = F.lit(radius_m * DEGREES_PER_M) / F.cos(F.radians(F.least(F.abs(F.col("p.lat")) + 1, F.lit(89.0))))
    reach_lng = F.least(F.ceil(widest / CELL), F.lit(around // 2)).cast("int")
    q = places.select(*[F.col(c).alias(f"place_{c}") for c in places.columns])
    q = q.withColumns({"_qy": F.floor(F.col("place_lat") / CELL), "_qx": F.pmod(F.floor(F.col("place_lng") / CELL), F.lit(around))})
    parts = q.groupBy(F.col("_qy").alias("_cy"), F.col("_qx").alias("_cx")).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_cy is not null and _cx is not null")
    p = points.alias("p").withColumn("_dy", F.explode(F.sequence(F.lit(-reach_lat), F.lit(reach_lat))))
    p = p.withColumn("_dx", F.explode(F.sequence(-reach_lng, F.least(reach_lng, around - 1 - reach_lng))))
    p = p.withColumns({"_cy": F.floor(F.col("lat") / CELL) + F.col("_dy"), "_cx": F.pmod(F.floor(F.col("lng") / CELL) + F.col("_dx"), F.lit(around))}).drop("_dy", "_dx")
    p = p.join(parts, ["_cy", "_cx"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    q = q.join(parts.withColumnsRenamed({"_cy": "_qy", "_cx": "_qx", "_parts": "_of"}), ["_qy", "_qx"])
    q = q.withColumn("_own", F.pmod(F.xxhash64(*[f"place_{c}" for c in places.columns]), F.col("_of")).cast("int"))
    metres = distance_m(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    same = (F.col("_cy") == F.col("_qy")) & (F.col("_cx") == F.col("_qx")) & (F.col("_part") == F.col("_own"))
    found = p.join(q, same).withColumn("distance_m", metres)
    return found.where(F.col("distance_m") <= radius_m).select(*points.columns, *[f"place_{c}" for c in places.columns], "distance_m")


def grid_points(metros: DataFrame, spacing_km: float | None = None) -> DataFrame:
    """Grid over each metro's box, row by row from the south-west: metro, row, col, lat, lng, label.

    One degree of latitude counts 111 km, of longitude 111 km times the cosine of the box's middle latitude.
    """
    spacing = F.lit(float(spacing_km)) if spacing_km else F.col("default_spacing_km")
    lat_step = spacing / KM_PER_DEGREE
    lng_step = spacing / (KM_PER_DEGREE * F.cos(F.radians((F.col("sw_lat") + F.col("ne_lat")) / 2)))
    rows = metros.withColumns({"_dy": lat_step, "_dx": lng_step})
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.floor((F.col("ne_lat") - F.col("sw_lat")) / F.col("_dy")).cast("int"))))
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((F.col("ne_lng") - F.col("sw_lng")) / F.col("_dx")).cast("int"))))
    return rows.select(
        F.col("name").alias("metro"),
        "row",
        "col",
        F.round(F.col("sw_lat") + F.col("row") * F.col("_dy"), 4).alias("lat"),
        F.round(F.col("sw_lng") + F.col("col") * F.col("_dx"), 4).alias("lng"),
        F.concat_ws("_", "name", "row", "col").alias("label"),
    )


def bounding_box(df: DataFrame, *by: str) -> DataFrame:
    """Box, middle and padded span (1.4 times, 0.01 at least) of the points, per group."""
    box = df.groupBy(*by).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))
    middle = {f"mid_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("lat", "lng")}
    span = {f"span_{c}": F.greatest(1.4 * (F.col(f"max_{c}") - F.col(f"min_{c}")), F.lit(0.01)) for c in ("lat", "lng")}
    return box.withColumns(middle | span)


def view_radius_m(lat: Column, lat_span: Column, lng_span: Column, most: float = 50_000.0) -> Column:
    """Radius that a map view asks for: half its longer side."""
    degree = 111_320.0
    return F.least(F.greatest(lat_span * degree, lng_span * degree * F.cos(F.radians(lat))) / 2, F.lit(most))


def has_moved(by: list[str], order: str, metres: float = 500.0) -> Column:
    """Whether a view (lat, lng) is more than `metres` away from the one before it in its session; the first one is."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.coalesce(distance_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")) > metres, F.lit(True))
