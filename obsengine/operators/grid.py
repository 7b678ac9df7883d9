"""Equal-area grids, raster tables and spatial lookups, as Column math and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions.expressions import EARTH_RADIUS_KM, haversine_km
from obsengine.operators.sizes import short

# WGS84 semi-major axis and eccentricity, and the standard parallel of EPSG:6933.
WGS84_A, WGS84_E, PARALLEL = 6378137.0, 0.0818191908426215, 30.0
_K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - (WGS84_E * math.sin(math.radians(PARALLEL))) ** 2)
_QP = (1 - WGS84_E**2) * (1 / (1 - WGS84_E**2) - 1 / (2 * WGS84_E) * math.log((1 - WGS84_E) / (1 + WGS84_E)))


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres of the cylindrical equal-area projection (EPSG:6933), ellipsoidal forward formula."""
    s = F.sin(F.radians(lat))
    es = F.lit(WGS84_E) * s
    q = F.lit(1 - WGS84_E**2) * (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * WGS84_E))
    return F.radians(lon) * (WGS84_A * _K0), q * (WGS84_A / (2 * _K0))


def from_equal_area(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude, the latter by the authalic series (to about 1e-9 degrees)."""
    e2 = WGS84_E**2
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * (2 * _K0 / (WGS84_A * _QP)))))
    lat = beta + F.sin(2 * beta) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) + F.sin(4 * beta) * (23 * e2**2 / 360 + 251 * e2**3 / 3780) + F.sin(6 * beta) * (761 * e2**3 / 45360)
    return F.degrees(x / (WGS84_A * _K0)), F.degrees(lat)


def cell_index(x: Column, y: Column, left: float, top: float, size: float = 1000.0) -> tuple[Column, Column]:
    """Column and row of the cell, counted from the left and from the top."""
    return F.floor((x - left) / size).cast("int"), F.floor((F.lit(top) - y) / size).cast("int")


def cell_centre(col: Column, row: Column, left: float, top: float, size: float = 1000.0) -> tuple[Column, Column]:
    return F.lit(left) + (col + 0.5) * size, F.lit(top) - (row + 0.5) * size


def inside_grid(col: Column, row: Column, n_cols: int, n_rows: int) -> Column:
    return F.coalesce(col.between(0, n_cols - 1) & row.between(0, n_rows - 1), F.lit(False))


def block_id(row: Column, col: Column, size: int) -> Column:
    """Id of the square of cells that a cell lies in; negative indices round down."""
    return F.concat_ws(":", F.floor(row / size).cast("string"), F.floor(col / size).cast("string"))


def raster_value(df: DataFrame, raster: DataFrame, row: str, col: str, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """df with the raster's value at the cell: null where it has none or it is out of range. raster: row, col, value; one row a cell."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(value) >= low)
    if high is not None:
        ok = ok & (F.col(value) <= high)
    one = raster.select(row, col, F.when(ok, F.col(value)).alias(value))
    return df.join(one, [row, col], "left")


def nearest_valid_cell(points: DataFrame, cells: DataFrame, key: str, step: float, reach: int = 3, most_km: float = 25.0) -> DataFrame:
    """points with the nearest valid native cell within most_km: near_lat_idx, near_lon_idx, near_km; null if there is none.

    points: key, lat, lon. cells: lat_idx, lon_idx, cell_lat, cell_lon, valid; index = round(degrees / step). A point looks
    at (2 * reach + 1)^2 indices, so the join is an equi-join; ties go to the smaller (distance, lat_idx, lon_idx)."""
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    near = points.select(key, "lat", "lon", F.explode(F.transform(offsets, lambda d: F.round(F.col("lat") / step).cast("int") + d)).alias("lat_idx"))
    near = near.select("*", F.explode(F.transform(offsets, lambda d: F.round(F.col("lon") / step).cast("int") + d)).alias("lon_idx"))
    found = near.join(cells.filter("valid").select("lat_idx", "lon_idx", "cell_lat", "cell_lon"), ["lat_idx", "lon_idx"]).withColumn("km", haversine_km("lat", "lon", "cell_lat", "cell_lon")).filter(F.col("km") <= most_km)
    best = found.groupBy(key).agg(F.min(F.struct("km", "lat_idx", "lon_idx")).alias("b"))
    return points.join(best, key, "left").select(*points.columns, F.col("b.lat_idx").alias("near_lat_idx"), F.col("b.lon_idx").alias("near_lon_idx"), F.col("b.km").alias("near_km"))


def buckets_around(row: Column, col: Column, size: int) -> Column:
    """The 3 x 3 buckets of `size` cells around a cell, as (bucket_row, bucket_col)."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    return F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct((F.floor(row / size) + i).alias("bucket_row"), (F.floor(col / size) + j).alias("bucket_col")))))


def within_distance(left: DataFrame, right: DataFrame, on: list[str], row: str, col: str, most: float, shape: str = "circle", how: str = "inner") -> DataFrame:
    """Pairs of left and right rows with equal `on` whose cells lie within `most` cells: circle (Euclidean) or square.

    right's columns must not clash with left's, but for `on`. Left rows go to the 3 x 3 buckets around them, right rows to
    their own, so buckets are as wide as the distance and the join is an equi-join with a residual test."""
    size = max(1, math.ceil(most))
    a = left.withColumn("__b", F.explode(buckets_around(F.col(row), F.col(col), size))).select(left.columns + ["__b.*"])
    r_row, r_col = f"right_{row}", f"right_{col}"
    b = right.withColumnRenamed(row, r_row).withColumnRenamed(col, r_col).withColumn("bucket_row", F.floor(F.col(r_row) / size)).withColumn("bucket_col", F.floor(F.col(r_col) / size))
    dx, dy = F.col(col) - F.col(r_col), F.col(row) - F.col(r_row)
    near = dx * dx + dy * dy <= most * most if shape == "circle" else F.greatest(F.abs(dx), F.abs(dy)) <= most
    same = (a["bucket_row"] == b["bucket_row"]) & (a["bucket_col"] == b["bucket_col"])
    for name in on:
        same = same & (a[name] == b[name])
    joined = a.join(b, same & near, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(left.columns)
    return joined.select(*[a[c] for c in left.columns], *[b[c] for c in b.columns if c not in on and not c.startswith("bucket_")])


def dilated(cells: DataFrame, centres: DataFrame, on: list[str], row: str, col: str, radius: int) -> DataFrame:
    """Cells within the square of `radius` around some centre, each once.

    The centres spread to buckets, made distinct first; a cell keeps its own row whatever number of centres it is near."""
    size = max(1, radius)
    marks = centres.select(*on, row, col).distinct().withColumnRenamed(row, "__row").withColumnRenamed(col, "__col")
    marks = marks.withColumn("__b", F.explode(buckets_around(F.col("__row"), F.col("__col"), size))).select(*on, "__row", "__col", F.col("__b.bucket_row").alias("__br"), F.col("__b.bucket_col").alias("__bc"))
    mine = cells.withColumn("__br", F.floor(F.col(row) / size)).withColumn("__bc", F.floor(F.col(col) / size))
    same = (mine["__br"] == marks["__br"]) & (mine["__bc"] == marks["__bc"])
    for name in on:
        same = same & (mine[name] == marks[name])
    return mine.join(marks, same & (F.abs(F.col(row) - F.col("__row")) <= radius) & (F.abs(F.col(col) - F.col("__col")) <= radius), "left_semi").select(cells.columns)


def edges_of(rings: DataFrame, key: str) -> DataFrame:
    """Edges of closed rings. rings: key, ring, seq, lon, lat; the last vertex joins the first."""
    w = Window.partitionBy(key, "ring").orderBy("seq")
    every = Window.partitionBy(key, "ring")
    first = F.min_by(F.struct("lon", "lat"), "seq").over(every)
    nxt = F.coalesce(F.lead(F.struct("lon", "lat")).over(w), first)
    return rings.select(key, "ring", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt["lon"].alias("x2"), nxt["lat"].alias("y2"))


def point_in_polygon(points: DataFrame, edges: DataFrame, point_key: str, key: str, bucket: float = 1.0) -> DataFrame:
    """points (point_key, lon, lat) with the smallest key of a polygon that holds them; null if none does.

    An odd number of edges crossed on a way out of the polygon is inside; an edge counts at its lower and western ends and
    not at the others, so a point on a border lies in one of two neighbours. Ways are short: the plane is cut into cells of
    `bucket` degrees. For each polygon and cell, the south-east corner is judged once by the edges that cross the corner's
    latitude; a point goes east to its cell's border and along that to the corner, and meets the edges in its cell alone.
    So points and cells meet by an equi-join on the cell, and a polygon's cells without edges cost a row each."""
    size = F.lit(float(bucket))
    plain = edges.select(F.col(key).alias("__k"), "x1", "y1", "x2", "y2")
    cell = lambda v: F.floor(v / size)
    west, east = F.ceil(F.least("x1", "x2") / size) - 1, cell(F.greatest("x1", "x2"))  # an edge on a border is in the cell west of it too
    south, north = cell(F.least("y1", "y2")), cell(F.greatest("y1", "y2"))
    banded = plain.withColumn("__w", west).withColumn("__e", east).withColumn("__row", F.explode(F.sequence(south, north)))
    across = lambda a, b, at: (a <= at) != (b <= at)
    edge_y = F.col("__row") * size
    cut = F.when(across(F.col("y1"), F.col("y2"), edge_y), F.col("x1") + (edge_y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    corners = banded.groupBy("__k", "__row").agg(F.collect_list(cut).alias("cuts"), F.sequence(F.min("__w"), F.max("__e")).alias("cols"))
    corners = corners.select("__k", "__row", "cuts", F.explode("cols").alias("__col"))
    corners = corners.select("__k", "__row", "__col", (F.size(F.filter("cuts", lambda c: c > (F.col("__col") + 1) * size)) % 2).alias("odd"))
    inner = banded.withColumn("__col", F.explode(F.sequence("__w", "__e"))).groupBy("__k", "__row", "__col").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    cells = corners.join(inner, ["__k", "__row", "__col"], "left").filter("odd = 1 or edges is not null")
    mine = points.select(point_key, "lon", "lat", cell(F.col("lat")).alias("__row"), cell(F.col("lon")).alias("__col"))
    border, base = (F.col("__col") + 1) * size, F.col("__row") * size

    def crossed(e):
        """Times that the way from the point to the corner crosses an edge. Where the edge lies at the border is told by where
        it crosses the two latitudes, as for the corner and the point, so that no rounding can make the two disagree."""
        x = lambda at: e["x1"] + (at - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        lat, rising = F.col("lat"), (e["x2"] - e["x1"]) * (e["y2"] - e["y1"]) > 0
        by_lat, by_base = across(e["y1"], e["y2"], lat), across(e["y1"], e["y2"], base)
        eastward = F.when(by_lat, (x(lat) > F.col("lon")) & (x(lat) <= border)).otherwise(False)
        below = F.when(by_lat, (x(lat) > border) == rising).otherwise(e["y1"] <= lat)
        above = F.when(by_base, (x(base) <= border) == rising).otherwise(e["y1"] > base)
        return eastward.cast("int") + (across(e["x1"], e["x2"], border) & below & above).cast("int")

    n = F.col("odd") + F.coalesce(F.aggregate("edges", F.lit(0), lambda total, e: total + crossed(e)), F.lit(0))
    inside = mine.join(cells, ["__row", "__col"]).filter(n % 2 == 1).groupBy(point_key).agg(F.min("__k").alias(key))
    return points.join(inside, point_key, "left")


def class_counts(pixels: DataFrame, klass: str, wanted: list[int], nodata: int = 0) -> DataFrame:
    """A row a class: pixels, and whether it is one of the wanted; the nodata class and null are left out."""
    return pixels.filter(F.col(klass) != nodata).groupBy(klass).agg(F.count("*").alias("pixels")).withColumn("wanted", F.col(klass).isin(wanted))


def block_fraction(pixels: DataFrame, cell: list[str], mask: Column, valid: Column) -> DataFrame:
    """By cell: share of valid pixels that the mask holds for (by pixel centres), and valid pixels."""
    return pixels.filter(valid).groupBy(*cell).agg(F.avg(mask.cast("int")).alias("fraction"), F.count("*").alias("valid_pixels"))


def cell_area_km2(lat_south: Column, lat_north: Column, lon_width: Column | float, radius: float = EARTH_RADIUS_KM) -> Column:
    """Area of a cell of the sphere between two latitudes (degrees)."""
    width = lon_width if isinstance(lon_width, Column) else F.lit(lon_width)
    return F.lit(radius * radius) * F.radians(width) * F.abs(F.sin(F.radians(lat_north)) - F.sin(F.radians(lat_south)))


def ring_area_km2(edges: DataFrame, key: str, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """Area by polygon from the edges of its rings, on the sphere (geodesic areas differ slightly); inner rings, wound the
    other way, take off."""
    part = F.radians(F.col("x2") - F.col("x1")) * (2 + F.sin(F.radians("y1")) + F.sin(F.radians("y2")))
    rings = edges.groupBy(key, "ring").agg(F.sum(part).alias("s"))
    return rings.groupBy(key).agg((F.abs(F.sum("s")) * (radius * radius / 2)).alias("area_km2"))


def split_area(land: Column, part: Column) -> tuple[Column, Column]:
    """The part, kept between 0 and the land, and the rest."""
    inside = F.greatest(F.lit(0.0), F.least(land, part))
    return inside, land - inside


def transitions(pixels: DataFrame, specs: DataFrame, cell: str, pixel: str, klass: str = "klass") -> DataFrame:
    """Pixels by cell, event year, horizon and packed code pre * 100 + post.

    pixels: cell, pixel, year, klass. specs: event_year, horizon, pre_year, post_year (a short list)."""
    pre = pixels.join(short(specs), pixels["year"] == specs["pre_year"]).select(cell, pixel, "event_year", "horizon", "post_year", F.col(klass).alias("pre"))
    post = pixels.select(cell, pixel, F.col("year").alias("post_year"), F.col(klass).alias("post"))
    return pre.join(post, [cell, pixel, "post_year"]).groupBy(cell, "event_year", "horizon", (F.col("pre") * 100 + F.col("post")).alias("code")).agg(F.count("*").cast("double").alias("n"))


def transition_metrics(histogram: DataFrame, cell: str, natural: list[int], unobserved: list[int], destinations: dict[str, list[int]]) -> DataFrame:
    """By cell, event year, horizon: observed and natural shares before, observed share after, loss and loss by destination.

    A loss is natural before and observed as something else after. Shares are of all counted pixels."""
    pre, post, n = F.floor(F.col("code") / 100), F.col("code") % 100, F.col("n")
    observed_pre, observed_post = ~pre.isin(unobserved), ~post.isin(unobserved)
    lost = pre.isin(natural) & observed_post & ~post.isin(natural)
    total = F.sum(n)
    share = lambda c, name: (F.coalesce(F.sum(F.when(c, n)), F.lit(0.0)) / total).alias(name)
    known = sorted({c for codes in destinations.values() for c in codes})
    dest = [share(lost & post.isin(codes), f"to_{name}") for name, codes in destinations.items()] + [share(lost & ~post.isin(known), "to_other")]
    return histogram.groupBy(cell, "event_year", "horizon").agg(share(observed_pre, "pre_observed"), share(pre.isin(natural), "pre_natural"), share(observed_post, "post_observed"), share(lost, "loss"), *dest)


def band_means(df: DataFrame, cell: list[str], vector: str) -> DataFrame:
    """Mean vector by cell, element by element."""
    flat = df.select(*cell, F.posexplode(vector).alias("band", "x")).groupBy(*cell, "band").agg(F.avg("x").alias("x"))
    return flat.groupBy(*cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "x"))), lambda p: p["x"]).alias("mean"))


def regional_mean(df: DataFrame, inside: Column, ts: str, variables: list[str]) -> DataFrame:
    """Mean of each variable over the cells of a region, by stamp."""
    return df.filter(inside).groupBy(ts).agg(*[F.avg(v).alias(v) for v in variables], F.count("*").alias("cells"))
