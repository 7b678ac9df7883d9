"""Scalar expressions as Columns. Null in, null out, unless said otherwise; no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
# Shares of the three upper soil layers (0.07, 0.21 and 0.72 m) in the root zone.
ROOT_ZONE = (0.07, 0.21, 0.72)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = col(x).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def all_finite(names: Sequence[str], above: dict[str, float] | None = None) -> Column:
    """Every column is finite, and those in `above` exceed their sentinel."""
    return reduce(and_, [is_finite(n) for n in names] + [F.coalesce(F.col(n) > v, F.lit(False)) for n, v in (above or {}).items()], F.lit(True))


def saturation_vapour_pressure_kpa(celsius: Column | str) -> Column:
    """Tetens over water."""
    c = col(celsius)
    return F.lit(0.6108) * F.exp(F.lit(17.27) * c / (c + 237.3))


def vapour_pressure_deficit_kpa(celsius: Column | str, dew_point: Column | str) -> Column:
    return F.greatest(F.lit(0.0), saturation_vapour_pressure_kpa(celsius) - saturation_vapour_pressure_kpa(dew_point))


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.hypot(col(u), col(v))


def root_zone_water(*layers: Column | str) -> Column:
    return sum((col(x) * w for x, w in zip(layers, ROOT_ZONE, strict=True)), F.lit(0.0))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def platform_group(satellite: Column | str, other: str = "other") -> Column:
    """MODIS before NOAA-20 before Suomi NPP; anything else, null too, is other."""
    s = F.upper(F.coalesce(col(satellite).cast("string"), F.lit("")))
    return F.when(s.contains("MODIS") | s.contains("TERRA") | s.contains("AQUA"), "MODIS").when(s.contains("NOAA20") | s.contains("NOAA-20"), "VIIRS NOAA-20").when(s.contains("NPP"), "VIIRS S-NPP").otherwise(other)


def threshold_state(x: Column | str, high: float = 0.5, low: float | None = None, names: tuple[str, str, str] = ("high", "low", "neutral")) -> Column:
    low = -high if low is None else low
    c = col(x)
    return F.when(c >= high, names[0]).when(c <= low, names[1]).when(c.isNotNull(), names[2])


def ascii_key(name: Column | str) -> Column:
    """Lower case, common accents folded, everything but letters and digits dropped."""
    plain = F.translate(F.lower(col(name)), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def private_id(prefix: str, *parts: Column | str, length: int = 20) -> Column:
    """First hex digits of sha256 of prefix:part:part..."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(prefix), *[col(p).cast("string") for p in parts]), 256), 1, length)


def strict_boolean(x: Column | str) -> Column:
    """true/false/1/0 in any case, white space around it allowed; any other text, and null, fails the job."""
    t = F.lower(F.trim(col(x).cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


def l2_normalised(vector: Column | str) -> Column:
    """Unit vector as array<double>; a vector of norm zero, or with a null, gives null."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def safe_rate(count: Column | str, area: Column | str, per: float = 1.0, digits: int | None = None) -> Column:
    """count * per / area, null unless the area is positive."""
    r = F.when(col(area) > 0, col(count) * F.lit(per) / col(area))
    return r if digits is None else F.round(r, digits)


def in_season(day: Column | str, first_month: int = 7, last_month: int = 11) -> Column:
    return F.month(col(day)).between(first_month, last_month)


def season_bounds(year: Column | str, first_month: int = 7, last_month: int = 11) -> tuple[Column, Column]:
    y = col(year)
    return F.make_date(y, F.lit(first_month), F.lit(1)), F.last_day(F.make_date(y, F.lit(last_month), F.lit(1)))


def closed_day(day: Column | str, today: Column) -> Column:
    """A day counts once the next one has begun."""
    return col(day) < today


def eligible_years(horizon: int, first: int, last: int) -> list[int]:
    """Event years whose year after `horizon` lies in the archive."""
    return [y for y in range(first, last + 1) if y + horizon <= last]


def record_hash(names: Sequence[str]) -> Column:
    """sha256 of the canonical JSON of a row: named columns by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def z_score(x: Column | str, mean: Column | float, sd: Column | float) -> Column:
    return (col(x) - mean) / sd


def qa_pass(qa: Column | str, value: Column | str, fill: int = 65535, low: float = -2000, high: float = 10000) -> Column:
    """Fields of a 16-bit quality word: bits 0-1 are 0, 2-5 at most 1, 8, 10, 14 and 15 are 0, 11-13 are 1; value in range."""
    q = col(qa).cast("long")
    bits = lambda at, n: F.shiftright(q, at).bitwiseAND(F.lit((1 << n) - 1))
    good = (bits(0, 2) == 0) & (bits(2, 4) <= 1) & (bits(8, 1) == 0) & (bits(10, 1) == 0) & (bits(11, 3) == 1) & (bits(14, 2) == 0)
    return F.coalesce((q != fill) & good & col(value).between(low, high), F.lit(False))
