"""Numeric columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the universal transverse Mercator grid.
WGS84_A, WGS84_INVERSE_FLATTENING = 6378137.0, 298.257223563
UTM_SCALE, UTM_FALSE_EASTING = 0.9996, 500000.0


def proportions(parts: Mapping[str, Column], whole: Column) -> dict[str, Column]:
    """Each part over the whole; NULL where the whole is zero."""
    return {name: F.try_divide(part, whole) for name, part in parts.items()}


def row_mean(cols: Sequence[Column], skip_null: bool = True) -> Column:
    """Mean across columns; with ``skip_null=False`` any missing value makes it NULL."""
    if not skip_null:
        return sum(cols[1:], cols[0]) / len(cols)
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, present)


def rescale(col: Column, how: str) -> Column:
    return {
        "percent_to_fraction": lambda: col / 100,
        "sqrt": lambda: F.sqrt(col),
        "m2_to_ha": lambda: col / 10000,
        "round2": lambda: F.round(col, 2),
    }[how]()


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series eight steps up, then stepped back down."""
    z = x + 8
    series = (
        (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    )
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    return series - F.log(product)


def utm(lon: Column, lat: Column, zone: int = 12) -> tuple[Column, Column]:
    """Northern-hemisphere UTM easting and northing in metres (Krüger series, third order)."""
    flattening = 1 / WGS84_INVERSE_FLATTENING
    n = flattening / (2 - flattening)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    eccentricity = 2 * math.sqrt(n) / (1 + n)
    lon0 = 6 * zone - 183
    sin_lat = F.sin(F.radians(lat))
    conformal = F.sinh(F.atanh(sin_lat) - eccentricity * F.atanh(eccentricity * sin_lat))
    dlon = F.radians(lon - lon0)
    xi = F.atan2(conformal, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(1 + conformal**2))
    east, north = eta, xi
    for order, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * order * xi) * F.sinh(2 * order * eta)
        north = north + a * F.sin(2 * order * xi) * F.cosh(2 * order * eta)
    return UTM_FALSE_EASTING + UTM_SCALE * radius * east, UTM_SCALE * radius * north


# Wichura's rational approximation of the normal quantile (1988), full double precision;
# highest power first, numerator and denominator, for the centre and the two parts of a tail.
QUANTILE_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
QUANTILE_NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _ratio(parts: Sequence[Sequence[float]], r: Column) -> Column:
    def polynomial(values: Sequence[float]) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * r + F.lit(v)
        return out

    return polynomial(parts[0]) / polynomial(parts[1])


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, as an expression."""
    middle = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(QUANTILE_NEAR, r - 1.6)).otherwise(_ratio(QUANTILE_FAR, r - 5))
    return F.when(F.abs(middle) <= 0.425, middle * _ratio(QUANTILE_CENTRE, F.lit(0.180625) - middle * middle)).otherwise(F.signum(middle) * tail)
