import math
import random

import pytest
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.sources.bridge import metro_grid


def vincenty(lat, lng, to_lat, to_lng):
    """Metres of the geodesic on the ellipsoid, by iteration."""
    a, f = geo.RADIUS_M, geo.FLATTENING
    b, ell = (1 - f) * a, math.radians(to_lng - lng)
    u, v = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat, to_lat))
    lam = ell
    for _ in range(200):
        s = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        sigma, alpha = math.atan2(s, c), math.cos(u) * math.cos(v) * math.sin(lam) / s
        cos2 = 1 - alpha**2
        m = c - 2 * math.sin(u) * math.sin(v) / cos2 if cos2 else 0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        lam, old = ell + (1 - k) * f * alpha * (sigma + k * s * (m + k * c * (2 * m * m - 1))), lam
        if abs(lam - old) < 1e-13:
            break
    w = cos2 * (a * a - b * b) / (b * b)
    big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    d = small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
    return b * big * (sigma - d)


def test_distances_are_those_of_the_ellipsoid(spark):
    rnd = random.Random(1)
    rows = [(i, lat := rnd.uniform(-80, 80), lng := rnd.uniform(-179, 178), lat + rnd.uniform(-0.3, 0.3), lng + rnd.uniform(-0.3, 0.3)) for i in range(300)]
    rows += [(900, 10.0, 20.0, 10.0, 20.0), (901, 0.0, 0.0, 0.0, 1.0), (902, 45.0, -179.9, 45.0, 179.9), (903, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    for r in df.withColumn("m", geo.distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        if r.id == 903:
            assert r.m is None
        else:
            assert abs(r.m - vincenty(r.a, r.b, r.c, r.d)) < 0.1 + 1e-5 * r.m, r
    near = df.where("id < 900").withColumn("near", geo.within_radius(F.col("c"), F.col("d"), (10.0, 20.0), 1e7)).withColumn("m", geo.distance_m(F.col("c"), F.col("d"), F.lit(10.0), F.lit(20.0)))
    assert all(r.near == (r.m <= 1e7) for r in near.collect())


def test_nearby_pairs_equal_all_pairs(spark):
    """Also across longitude 180 and near the poles."""
    rnd = random.Random(2)
    spot = lambda: rnd.choice([(0.0, 179.98), (52.0, -179.99), (-88.7, 40.0), (32.8, -117.2)])
    points, places = ([(i, (at := spot())[0] + rnd.uniform(-0.2, 0.2), (at[1] + rnd.uniform(-0.2, 0.2) + 180) % 360 - 180) for i in range(n)] for n in (60, 120))
    one, other = (spark.createDataFrame(x, "id long, lat double, lng double") for x in (points, places))
    got = {(r.id, r.place_id) for r in geo.nearby_pairs(one, other, 12_000.0).collect()}
    want = {(i, j) for i, a, b in points for j, c, d in places if vincenty(a, b, c, d) <= 12_000}
    assert got == want and any(points[i][2] * places[j][2] < 0 for i, j in got)


def test_grids(spark):
    assert metro_grid(spark, "san_diego").where("label = 'Old Town'").count() == 1 and metro_grid(spark, "denver").count() > 10
    assert metro_grid(spark, "san_diego", 5.0).where("label = 'Old Town'").count() == 0
    with pytest.raises(ValueError):
        metro_grid(spark, "atlantis")
