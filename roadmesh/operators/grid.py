"""Boxes, grids and geodesy as column arithmetic. Boxes are columns n, e, s, w in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM, KM_PER_DEGREE = 6371.0, 111.0


def bbox_center(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": (F.col("n") + F.col("s")) / 2, "lon": (F.col("e") + F.col("w")) / 2})


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(h))


def destination(lat: Column, lon: Column, km: Column, bearing: Column) -> tuple[Column, Column]:
    """Latitude and longitude km away at a bearing in degrees clockwise from north."""
    a, t, d = F.radians(lat), F.radians(bearing), km / RADIUS_KM
    out = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(out))
    return F.degrees(out), F.degrees(lon2)


def square_box(df: DataFrame, side_km: float) -> DataFrame:
    """A square of this side around (lat, lon): its corners lie at 45 and 225 degrees."""
    far = F.lit(side_km / 2**0.5)
    n, e = destination(F.col("lat"), F.col("lon"), far, F.lit(45.0))
    s, w = destination(F.col("lat"), F.col("lon"), far, F.lit(225.0))
    return df.withColumns({"n": n, "e": e, "s": s, "w": w})


#: Shift codes: kilometres as a share, bearing. 0 stays; 1-4 by 2/3 km, 5-8 by 2/7 km.
SHIFTS = {0: (0.0, 0.0), **{i + 1: (2 / 3, b) for i, b in enumerate((0.0, 180.0, 90.0, 270.0))}, **{i + 5: (2 / 7, b) for i, b in enumerate((0.0, 180.0, 90.0, 270.0))}}


def shift_box(df: DataFrame, code: str = "code") -> DataFrame:
    """The box moved by the shift that the column code names (0 to 8)."""
    pick = lambda i: F.element_at(F.create_map(*[x for k, v in SHIFTS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col(code).cast("int"))
    c = bbox_center(df)
    lat, lon = destination(F.col("lat"), F.col("lon"), pick(0), pick(1))
    c = c.withColumns({"dlat": lat - F.col("lat"), "dlon": lon - F.col("lon")})
    return c.withColumns({"n": F.col("n") + F.col("dlat"), "s": F.col("s") + F.col("dlat"), "e": F.col("e") + F.col("dlon"), "w": F.col("w") + F.col("dlon")}).drop("dlat", "dlon", "lat", "lon")


def shrink_box(df: DataFrame, pct: float) -> DataFrame:
    """The box with sides of pct percent, about its centre."""
    k = pct / 200.0
    c = bbox_center(df).withColumns({"hh": (F.col("n") - F.col("s")) * k, "hw": (F.col("e") - F.col("w")) * k})
    return c.withColumns({"n": F.col("lat") + F.col("hh"), "s": F.col("lat") - F.col("hh"), "e": F.col("lon") + F.col("hw"), "w": F.col("lon") - F.col("hw")}).drop("lat", "lon", "hh", "hw")


def box_sides(df: DataFrame) -> DataFrame:
    """x_km, y_km (means of opposite edges) and area of each box."""
    south = haversine_km(F.col("s"), F.col("w"), F.col("s"), F.col("e"))
    north = haversine_km(F.col("n"), F.col("w"), F.col("n"), F.col("e"))
    return df.withColumns({"x_km": (south + north) / 2, "y_km": haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("w"))}).withColumn("area_km2", F.col("x_km") * F.col("y_km"))


def resize_check(df: DataFrame, side_km: float) -> DataFrame:
    """Whether the side that the diagonal gives is within 2 % of side_km."""
    diagonal = haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("e")) / F.sqrt(F.lit(2.0))
    return df.withColumns({"side_km": diagonal, "fits": F.abs(diagonal - side_km) <= 0.02 * side_km})


def grid_deltas(df: DataFrame) -> DataFrame:
    """dy and dx of tiles that are as high as wide: scale tiles from south to north."""
    d = box_sides(df)
    return d.withColumns({"dy": (F.col("n") - F.col("s")) / F.col("scale"), "dx": (F.col("e") - F.col("w")) / F.col("scale") * (F.col("y_km") / F.col("x_km"))})


def make_grid(df: DataFrame) -> DataFrame:
    """A row per tile of boxes with dy, dx, row-major from the south-west; a partial last
    row or column is dropped."""
    rows = F.floor((F.col("n") - F.col("s")) / F.col("dy") + 1e-9).cast("int")
    cols = F.floor((F.col("e") - F.col("w")) / F.col("dx") + 1e-9).cast("int")
    g = df.withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), cols - 1)))
    return g.withColumns({"tile_s": F.col("s") + F.col("row") * F.col("dy"), "tile_w": F.col("w") + F.col("col") * F.col("dx"), "tile_n": F.col("s") + (F.col("row") + 1) * F.col("dy"), "tile_e": F.col("w") + (F.col("col") + 1) * F.col("dx")})


def make_grid_deg(df: DataFrame, km: float) -> DataFrame:
    """make_grid with square cells of km / 111 degrees."""
    return make_grid(df.withColumns({"dy": F.lit(km / KM_PER_DEGREE), "dx": F.lit(km / KM_PER_DEGREE)}))


def box_around(df: DataFrame, km: float) -> DataFrame:
    """n, e, s, w of (lat, lon) plus and minus km, planar."""
    dlat = F.lit(km / RADIUS_KM)
    dlon = F.lit(km) / (RADIUS_KM * F.cos(F.radians("lat")))
    return df.withColumns({"n": F.col("lat") + F.degrees(dlat), "s": F.col("lat") - F.degrees(dlat), "e": F.col("lon") + F.degrees(dlon), "w": F.col("lon") - F.degrees(dlon)})


def boxes_intersect(w1: Column, s1: Column, e1: Column, n1: Column, w2: Column, s2: Column, e2: Column, n2: Column) -> Column:
    return (w1 <= e2) & (w2 <= e1) & (s1 <= n2) & (s2 <= n1)


def point_in_box(x: Column, y: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Strictly inside: the boundary doesn't count."""
    return (x > w) & (x < e) & (y > s) & (y < n)


def to_cell(df: DataFrame, n: float, e: float, s: float, w: float, size: int) -> DataFrame:
    """Raster row and col of (lat, lon), and whether it lies inside the extent."""
    fy, fx = (F.col("lat") - s) / (n - s), (F.col("lon") - w) / (e - w)
    return df.withColumns({"inside": (fy > 0) & (fy < 1) & (fx > 0) & (fx < 1), "r": (fy * (size - 1)).cast("int"), "c": (fx * (size - 1)).cast("int")})


def once(df: DataFrame, pair: tuple[Column, Column], a: str, b: str) -> DataFrame:
    """df with the pair as columns a and b, each evaluated once a row in compiled code: plain columns
    would be repeated wherever they are used, in methods too large to be compiled."""
    return df.select("*", F.inline(F.array(F.struct(pair[0].alias(a), pair[1].alias(b)))))


def part_between(a: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """From where to where (as parts of the whole way) a + t * d lies within low and high."""
    step = F.nullif(d, F.lit(0.0))  # null where nothing moves
    at, inside = ((low - a) / step, (high - a) / step), (a >= low) & (a <= high)
    return F.coalesce(F.least(*at), F.when(inside, 0.0).otherwise(2.0)), F.coalesce(F.greatest(*at), F.when(inside, 1.0).otherwise(-1.0))


def clip(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, s: Column, e: Column, n: Column) -> tuple[Column, Column]:
    """The part t0 <= t <= t1 of a piece inside a closed box; t0 > t1 where they don't meet."""
    x, y = part_between(x1, x2 - x1, w, e), part_between(y1, y2 - y1, s, n)
    return F.greatest(F.lit(0.0), x[0], y[0]), F.least(F.lit(1.0), x[1], y[1])
