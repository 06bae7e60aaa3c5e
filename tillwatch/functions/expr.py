"""Column expressions shared by all operators. No Python UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, low=None, high=None) -> Column:
    """Bound a value and keep nulls: ``greatest``/``least`` alone would turn a null into a bound."""
    c = _col(c)
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def half_even(c, digits: int = 0) -> Column:
    """Round a double on its exact binary value, ties to even (0.125 -> 0.12, 2.675 -> 2.67).

    Scaling by a power of ten can land on a half that the value itself does not have, so in that
    case the part lost in the multiplication decides the direction.
    """
    c = _col(c)
    if digits == 0:
        return F.rint(c)
    scale = F.lit(float(10**digits))
    scaled = c * scale
    # The value split into two short halves, whose products with the scale are exact.
    spread = c * F.lit(float(2**27 + 1))
    high = spread - (spread - c)
    lost = (high * scale - scaled) + (c - high) * scale
    below = F.floor(scaled).cast("double")
    on_half = (scaled - below == 0.5) & (lost != 0)
    return F.when(on_half, F.when(lost > 0, below + 1).otherwise(below)).otherwise(F.rint(scaled)) / scale


def half_up(c, digits: int = 0) -> Column:
    """Round a double with ties up, the way a browser rounds."""
    scale = float(10**digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(num, den) -> Column:
    """Division that gives null, not an error, on a zero denominator."""
    return F.try_divide(_col(num), _col(den))


def cos_degrees(c) -> Column:
    return F.cos(F.radians(_col(c)))


def distance_km(lat1, lng1, lat2, lng2, cos1=None, cos2=None) -> Column:
    """Great-circle distance (haversine). Null when any coordinate is null. ``cos1`` and ``cos2`` are the latitudes'
    ``cos_degrees`` where these are at hand."""
    a = haversine(lat1, lng1, lat2, lng2, cos1, cos2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine(lat1, lng1, lat2, lng2, cos1=None, cos2=None) -> Column:
    """The squared sine of half the angle between two places; it grows with their distance."""
    lat1, lng1, lat2, lng2 = (_col(c) for c in (lat1, lng1, lat2, lng2))
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlng = F.sin(F.radians(lng2 - lng1) / 2)
    cos1, cos2 = cos_degrees(lat1) if cos1 is None else _col(cos1), cos_degrees(lat2) if cos2 is None else _col(cos2)
    return half_dlat * half_dlat + cos1 * cos2 * half_dlng * half_dlng


def stable_uniform(seed: int, *keys: str) -> Column:
    """A uniform draw in (0, 1) that depends on the row's key alone.

    ``rand(seed)`` depends on how rows are laid out over partitions, so a retried
    task after a shuffle may draw other values. A hash of the key never does. The first 48 bits of
    an MD5 digest give the same draw in any engine.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def stable_normal(seed: int, *keys: str) -> Column:
    """A standard normal draw per row key (Box-Muller over two stable uniforms)."""
    u1 = stable_uniform(2 * seed, *keys)
    u2 = stable_uniform(2 * seed + 1, *keys)
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
