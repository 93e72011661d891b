"""Coordinates stored at tie points and interpolated between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def linear(ua: Column, ub: Column, s: Column) -> Column:
    return ua + s * (ub - ua)


def bilinear(ua: Column, ub: Column, uc: Column, ud: Column, s1: Column, s2: Column) -> Column:
    """a, b at the ends of the first axis, c and d beyond them on the second: along the second first."""
    return linear(linear(ua, uc, s2), linear(ub, ud, s2), s1)


def quadratic(ua: Column, ub: Column, w: Column, s: Column) -> Column:
    """Without w (NULL) it is linear."""
    return linear(ua, ub, s) + F.coalesce(w, F.lit(0.0)) * 4 * s * (1 - s)


def quadratic_w(ua: Column, ub: Column, u: Column, s: Column) -> Column:
    """The w with which quadratic() gives u at s."""
    return (u - linear(ua, ub, s)) / (4 * s * (1 - s))


def to_vector(lat: Column, lon: Column) -> Vector:
    lat, lon = F.radians(lat), F.radians(lon)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def to_lat(v: Vector) -> Column:
    return F.degrees(F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1])))


def to_lon(v: Vector) -> Column:
    return F.degrees(F.atan2(v[1], v[0]))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def curvature(va: Vector, vb: Vector, ce: Column, ca: Column) -> Vector:
    """The vector of quadratic coefficients from the expansion and alignment coefficients (CF conventions, appendix J)."""
    middle = tuple((x + y) * 0.5 for x, y in zip(va, vb))
    ce, ca = F.coalesce(ce, F.lit(0.0)), F.coalesce(ca, F.lit(0.0))
    cr = F.sqrt(1 - ce * ce - ca * ca) - F.sqrt(dot(middle, middle))
    return tuple(cr * m + ce * (x - y) + ca * c for m, x, y, c in zip(middle, va, vb, cross(va, vb)))


def quadratic_lat_lon(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, ce: Column, ca: Column, s: Column, cartesian: Column) -> tuple[Column, Column]:
    """(lat, lon) between two tie points: on the sphere where `cartesian`, else quadratic in degrees through the middle on the sphere."""
    va, vb = to_vector(lat_a, lon_a), to_vector(lat_b, lon_b)
    c = curvature(va, vb, ce, ca)
    at = tuple(quadratic(x, y, w, s) for x, y, w in zip(va, vb, c))
    half = F.lit(0.5)
    middle = tuple(quadratic(x, y, w, half) for x, y, w in zip(va, vb, c))
    lat = quadratic(lat_a, lat_b, quadratic_w(lat_a, lat_b, to_lat(middle), half), s)
    lon = quadratic(lon_a, lon_b, quadratic_w(lon_a, lon_b, to_lon(middle), half), s)
    return F.when(cartesian, to_lat(at)).otherwise(lat), F.when(cartesian, to_lon(at)).otherwise(lon)


def areas(tie: DataFrame, index: str, over: list[str] | None = None, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """One row per interpolation sub-area: `low`, `high` (tie point positions), the values there (`_a`, `_b`), `first` (of its continuous area) and its number `area`.

    Tie points next to each other (a gap of 1 or less) end one continuous area and begin another."""
    w = Window.partitionBy(*(over or [])).orderBy(index)
    out = tie.withColumn("high", F.lead(index).over(w)).withColumn("low", F.col(index)).withColumn("_gap", F.coalesce(F.col(index) - F.lag(index).over(w), F.lit(0)))
    for v in values:
        out = out.withColumn(f"{v}_a", F.col(v)).withColumn(f"{v}_b", F.lead(v).over(w))
    out = out.where(F.col("high").isNotNull() & (F.col("high") - F.col("low") > 1)).withColumn("first", F.col("_gap") <= 1)
    return out.withColumn("area", F.row_number().over(w) - 1).drop("_gap", index, *values)


def located(sub: DataFrame, name: str) -> DataFrame:
    """Rows of areas() for each of their locations, with the coefficient s; only the first sub-area of an area has its left end."""
    low = F.when(F.col("first"), F.col("low")).otherwise(F.col("low") + 1)
    out = sub.withColumn(name, F.explode(F.sequence(low, F.col("high"))))
    return out.withColumn("s", (F.col(name) - F.col("low")) / (F.col("high") - F.col("low")))


def interpolated(tie: DataFrame, index: str, value: str = "value", name: str = "i", over: list[str] | None = None, w: str | None = None, parameters: DataFrame | None = None) -> DataFrame:
    """(over, name, value) along one axis: linear, or quadratic with `w` of `parameters` (area, w)."""
    sub = areas(tie, index, over, (value,))
    if parameters is not None:
        sub = sub.join(parameters, "area", "left")
    u = quadratic(F.col(f"{value}_a"), F.col(f"{value}_b"), F.col(w) if w else F.lit(None).cast("double"), F.col("s"))
    return located(sub, name).select(*(over or []), name, u.alias(value))


def interpolated_2d(tie: DataFrame, index1: str, index2: str, value: str = "value", names: tuple[str, str] = ("i", "j"), over: list[str] | None = None) -> DataFrame:
    """Bi-linear over two axes, for each key of `over`: along the second for each row of tie points, then along the first."""
    over = over or []
    rows = interpolated(tie, index2, value, names[1], over=[*over, index1])
    return interpolated(rows, index1, value, names[0], over=[*over, names[1]]).select(*over, *names, value)


def _cells_of(sub: DataFrame, name: str) -> tuple[DataFrame, Column, Column]:
    """The cells of each sub-area, and where on its way from `low` to `high` each begins and ends. Cells are as many as locations that areas give; one ends where the next begins."""
    low = F.when(F.col("first"), F.col("low")).otherwise(F.col("low") + 1)
    n, k = F.col("high") - low + 1, F.col(name) - low
    return sub.withColumn(name, F.explode(F.sequence(low, F.col("high")))), k / n, (k + 1) / n


def bounds(tie_bounds: DataFrame, index: str, value: str = "value", name: str = "i", over: list[str] | None = None) -> DataFrame:
    """(over, name, bounds): cells between neighbouring interpolated vertices; a cell of an area ends where the next begins."""
    over = over or []
    cells, begin, end = _cells_of(areas(tie_bounds, index, over, (value,)), name)
    u = lambda s: linear(F.col(f"{value}_a"), F.col(f"{value}_b"), s)
    return cells.select(*over, name, F.array(u(begin), u(end)).alias("bounds"))


def bounds_2d(tie_bounds: DataFrame, index1: str, index2: str, value: str = "value", names: tuple[str, str] = ("i", "j"), over: list[str] | None = None) -> DataFrame:
    """(over, names, bounds): cells of two interpolated axes by their four corners (i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j); neighbours share vertices, also across sub-areas.

    Vertices are found along the second axis for each row of tie points, then along the first between these rows, so each
    step is a window over one array's tie points."""
    over = over or []
    cells, begin, end = _cells_of(areas(tie_bounds, index2, [*over, index1], (value,)), names[1])
    u = lambda s: linear(F.col(f"{value}_a"), F.col(f"{value}_b"), s)
    rows = cells.select(*over, index1, names[1], u(begin).alias("_l"), u(end).alias("_r"))
    cells, begin, end = _cells_of(areas(rows, index1, [*over, names[1]], ("_l", "_r")), names[0])
    v = lambda side, s: linear(F.col(f"{side}_a"), F.col(f"{side}_b"), s)
    return cells.select(*over, *names, F.array(v("_l", begin), v("_r", begin), v("_r", end), v("_l", end)).alias("bounds"))


def half_way_w(ua: Column, ub: Column, u: Column) -> Column:
    """The quadratic coefficient with which quadratic() gives u half-way."""
    return quadratic_w(ua, ub, u, F.lit(0.5))


def _fq(a: Vector, b: Vector, w: Vector, s: Column) -> Vector:
    return tuple(quadratic(x, y, z, s) for x, y, z in zip(a, b, w))


def bi_quadratic_lat_lon(corners: tuple[tuple[Column, Column], ...], sides: dict[str, tuple[Column, Column]], s1: Column, s2: Column, cartesian: Column) -> tuple[Column, Column]:
    """(lat, lon) between four tie points a, b, c, d: a to b along the first axis, a to c along the second.

    `sides` gives the expansion and alignment coefficients of the sides ab, cd (along the first axis) and ac, bd
    (along the second), and of the middle line z between ac and bd. Along the second axis the sides ac and bd are
    followed to s2; the line between them is bent by coefficients that are themselves quadratic in s2, equal to those of ab
    and cd at the ends and to z's half-way (CF conventions, appendix J). On the sphere where `cartesian`, else in degrees."""
    va, vb, vc, vd = (to_vector(*x) for x in corners)
    half = F.lit(0.5)
    v_ac = _fq(va, vc, curvature(va, vc, *sides["ac"]), s2)
    v_bd = _fq(vb, vd, curvature(vb, vd, *sides["bd"]), s2)
    m_ac = _fq(va, vc, curvature(va, vc, *sides["ac"]), half)
    m_bd = _fq(vb, vd, curvature(vb, vd, *sides["bd"]), half)
    c_ab, c_cd, c_z = curvature(va, vb, *sides["ab"]), curvature(vc, vd, *sides["cd"]), curvature(m_ac, m_bd, *sides["z"])
    c_zz = tuple(half_way_w(x, y, z) for x, y, z in zip(c_ab, c_cd, c_z))
    at = _fq(v_ac, v_bd, _fq(c_ab, c_cd, c_zz, s2), s1)

    def degrees(pick: object, k: int) -> Column:
        """The same in degrees: the points half-way on each side and in the middle come from the sphere."""
        a, b, c, d = (x[k] for x in corners)
        ab, cd = pick(_fq(va, vb, c_ab, half)), pick(_fq(vc, vd, c_cd, half))
        ac, bd = pick(m_ac), pick(m_bd)
        middle = pick(_fq(m_ac, m_bd, c_z, half))
        left, right = quadratic(a, c, half_way_w(a, c, ac), s2), quadratic(b, d, half_way_w(b, d, bd), s2)
        w_ab, w_cd, w_z = half_way_w(a, b, ab), half_way_w(c, d, cd), half_way_w(ac, bd, middle)
        return quadratic(left, right, quadratic(w_ab, w_cd, half_way_w(w_ab, w_cd, w_z), s2), s1)

    return F.when(cartesian, to_lat(at)).otherwise(degrees(to_lat, 0)), F.when(cartesian, to_lon(at)).otherwise(degrees(to_lon, 1))


def flag(flags: Column, masks: dict[str, int], name: str) -> Column:
    """Whether a flag of an interpolation sub-area is set; masks are the powers of two of flag_masks by their meanings."""
    return flags.bitwiseAND(F.lit(masks[name])) != 0
