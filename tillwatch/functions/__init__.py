from tillwatch.functions.expr import (  # noqa: F401
    clip,
    distance_km,
    half_up,
    half_even,
    ratio,
    stable_normal,
    stable_uniform,
)
