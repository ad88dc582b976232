"""Column expressions: geodesy, rotations, tapers and rounding. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_KM = 6371.0
KM_PER_DEG = EARTH_KM * 3.141592653589793 / 180.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def round_even(x, digits: int) -> Column:
    """x to so many digits, halves to even, as DuckDB's round_even: in double arithmetic (F.bround goes through the text of each value)."""
    return F.rint(_c(x) * 10.0**digits) / 10.0**digits


def wrap_lon(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    return haversine_m(lon1, lat1, lon2, lat2) / 1000.0


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Forward bearing, 0 to 360."""
    p1, p2, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))) + 360.0, F.lit(360.0))


def destination(lon, lat, azimuth, distance_m) -> tuple[Column, Column]:
    """lon, lat reached from a point."""
    p, b, d = F.radians(_c(lat)), F.radians(_c(azimuth)), _c(distance_m) / EARTH_M
    lat2 = F.asin(clamp(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b), -1.0, 1.0))
    lon2 = F.radians(_c(lon)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.degrees(lon2), F.degrees(lat2)


def hop_km(dlon: Column, dlat: Column, lat_mid: Column) -> Column:
    """Local equirectangular length of a step."""
    return F.hypot(dlon * F.cos(F.radians(lat_mid)), dlat) * KM_PER_DEG


def pole_from_center(lon0: float, lat0: float) -> tuple[float, float]:
    """pole_lon, pole_lat of the rotated grid whose equator meets (lon0, lat0)."""
    return (lon0 - 180.0 + 180.0) % 360.0 - 180.0, 90.0 - lat0


def rotate_plane(lon, lat, lon0: float, lat0: float, angle: float) -> tuple[Column, Column]:
    """Rotation in the tangent plane about (lon0, lat0)."""
    k = F.cos(F.radians(F.lit(float(lat0))))
    x, y, a = (_c(lon) - lon0) * k, _c(lat) - lat0, F.radians(F.lit(float(angle)))
    return F.lit(float(lon0)) + (x * F.cos(a) - y * F.sin(a)) / k, F.lit(float(lat0)) + x * F.sin(a) + y * F.cos(a)


def unrotate_pole(rlon, rlat, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """Geographic lon, lat of rotated-pole coordinates; a point at a pole keeps the pole's longitude."""
    t, p = F.radians(_c(rlon)), F.radians(_c(rlat))
    pl = F.radians(F.lit(float(pole_lat)))
    s = F.sin(p) * F.sin(pl) + F.cos(p) * F.cos(t) * F.cos(pl)
    lat = F.asin(clamp(s, -1.0, 1.0))
    y, x = F.cos(p) * F.sin(t), F.sin(pl) * F.cos(p) * F.cos(t) - F.cos(pl) * F.sin(p)
    lon = F.when(F.cos(lat) > 1e-10, F.degrees(F.atan2(y, x)) + pole_lon + 180.0).otherwise(F.lit(float(pole_lon)))
    return wrap_lon(lon), F.degrees(lat)


def rotate_vector(east, north, angle) -> tuple[Column, Column]:
    """Components along a grid's axes at a local axis angle."""
    e, n, a = _c(east), _c(north), F.radians(_c(angle))
    return e * F.cos(a) + n * F.sin(a), n * F.cos(a) - e * F.sin(a)


def taper(distance, width: float, shape: str = "cosine") -> Column:
    d = _c(distance)
    if shape == "linear":
        return 1.0 - d / width
    if shape == "exponential":
        return F.exp(d * (-3.0 / width))
    return (F.cos(d * (3.141592653589793 / width)) + 1.0) * 0.5


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def slug(name) -> Column:
    """Lower-case ascii words joined by underscores."""
    plain = F.translate(F.lower(_c(name)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(name) -> Column:
    return F.translate(F.replace(_c(name), F.lit(" "), F.lit("_")), "→[]", "-")


def smooth_name(r: Column) -> Column:
    """depth_rx0_0p20 for 0.2"""
    return F.concat(F.lit("depth_rx0_"), F.replace(F.format_string("%.2f", r), F.lit("."), F.lit("p")))


def corridor_name(lon, lat) -> Column:
    return F.format_string("auto_%.2f%s_%.2fN", F.abs(_c(lon)), F.when(_c(lon) >= 0, "E").otherwise("W"), F.abs(_c(lat)))


def mode_label(category, direction) -> Column:
    """boundary, waypoint or strait, else the category's name; ? if there is none."""
    c = _c(category)
    return F.when(c == "AUTO", "boundary").when(c == "WAYPOINT", "waypoint").when(_c(direction).isin("U", "V"), "strait").when(c != "", F.lower(c)).otherwise("?")


def anchor(heading) -> Column:
    return F.concat(F.lit("#"), F.replace(F.regexp_replace(F.lower(_c(heading)), r"(?U)[^\w\- ]", ""), F.lit(" "), F.lit("-")))


def log_depth(depth) -> Column:
    """log10 of positive depths, else null."""
    return F.when(_c(depth) > 0, F.log10(_c(depth)))
