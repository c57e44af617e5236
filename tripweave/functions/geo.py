"""Geometry as SQL expressions of doubles, so that they stay inside generated code.

Each function takes SQL text for its arguments and returns SQL text; column()
makes a Spark column of it. The projection is the transverse Mercator series of
Snyder, USGS Professional Paper 1395."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K0, E2, R = 0.9996, 0.00669438, 6378137.0
EARTH_M = 6371000.0


def lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def column(sql: str) -> Column:
    return F.expr(sql)


def zone(lat: str, lon: str) -> str:
    """UTM zone number, with the exceptions for Norway and Svalbard."""
    plain = f"(CAST(floor(({lon} + 180) / 6) AS INT) % 60 + 1)"
    svalbard = f"CASE WHEN {lon} < 9 THEN 31 WHEN {lon} < 21 THEN 33 WHEN {lon} < 33 THEN 35 ELSE 37 END"
    return (
        f"(CASE WHEN {lat} >= 56 AND {lat} < 64 AND {lon} >= 3 AND {lon} < 12 THEN 32"
        f" WHEN {lat} >= 72 AND {lat} <= 84 AND {lon} >= 0 AND {lon} < 42 THEN {svalbard} ELSE {plain} END)"
    )


def zone_letter(lat: str) -> str:
    """UTM latitude band, C to X; null outside 80 S to 84 N."""
    return f"(CASE WHEN {lat} >= -80 AND {lat} <= 84 THEN substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor(({lat} + 80) / 8) AS INT) + 1, 1) END)"


def _meridian(phi: str) -> str:
    a = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
    b = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
    c = 15 * E2**2 / 256 + 45 * E2**3 / 1024
    d = 35 * E2**3 / 3072
    return f"{lit(R)} * ({lit(a)} * {phi} - {lit(b)} * sin(2 * {phi}) + {lit(c)} * sin(4 * {phi}) - {lit(d)} * sin(6 * {phi}))"


def _series(lat: str, lon: str) -> dict[str, str]:
    phi = f"radians({lat})"
    ep2 = E2 / (1 - E2)
    return {
        "phi": phi,
        "t": f"(tan({phi}) * tan({phi}))",
        "c": f"({lit(ep2)} * cos({phi}) * cos({phi}))",
        "n": f"({lit(R)} / sqrt(1 - {lit(E2)} * sin({phi}) * sin({phi})))",
        "a": f"(cos({phi}) * radians({lon} - ({zone(lat, lon)} * 6 - 183)))",
        "e": lit(ep2),
    }


def easting(lat: str, lon: str) -> str:
    s = _series(lat, lon)
    t, c, n, a, e = s["t"], s["c"], s["n"], s["a"], s["e"]
    return f"(500000 + {lit(K0)} * {n} * ({a} + pow({a}, 3) / 6 * (1 - {t} + {c}) + pow({a}, 5) / 120 * (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {e})))"


def northing(lat: str, lon: str) -> str:
    s = _series(lat, lon)
    phi, t, c, n, a, e = (s[k] for k in ("phi", "t", "c", "n", "a", "e"))
    up = f"{n} * tan({phi}) * (pow({a}, 2) / 2 + pow({a}, 4) / 24 * (5 - {t} + 9 * {c} + 4 * {c} * {c}) + pow({a}, 6) / 720 * (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {e}))"
    return f"({lit(K0)} * ({_meridian(phi)} + {up}) + CASE WHEN {lat} < 0 THEN 10000000 ELSE 0 END)"


def to_latlon(x: str, y: str, number: str, south: str = "false") -> tuple[str, str]:
    """(latitude, longitude) of UTM coordinates: the inverse series."""
    ep2 = E2 / (1 - E2)
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    m = f"(({y} - CASE WHEN {south} THEN 10000000 ELSE 0 END) / {lit(K0)})"
    mu = f"({m} / {lit(R * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))})"
    p = (
        f"({mu} + {lit(1.5 * e1 - 27 / 32 * e1**3)} * sin(2 * {mu}) + {lit(21 / 16 * e1**2 - 55 / 32 * e1**4)} * sin(4 * {mu})"
        f" + {lit(151 / 96 * e1**3)} * sin(6 * {mu}) + {lit(1097 / 512 * e1**4)} * sin(8 * {mu}))"
    )
    n = f"({lit(R)} / sqrt(1 - {lit(E2)} * sin({p}) * sin({p})))"
    r = f"({lit(R * (1 - E2))} / pow(1 - {lit(E2)} * sin({p}) * sin({p}), {lit(1.5)}))"
    t, c = f"(tan({p}) * tan({p}))", f"({lit(ep2)} * cos({p}) * cos({p}))"
    d = f"(({x} - 500000) / ({n} * {lit(K0)}))"
    lat = (
        f"degrees({p} - ({n} * tan({p}) / {r}) * (pow({d}, 2) / 2 - pow({d}, 4) / 24 * (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - {lit(9 * ep2)})"
        f" + pow({d}, 6) / 720 * (61 + 90 * {t} + 298 * {c} + 45 * {t} * {t} - {lit(252 * ep2)} - 3 * {c} * {c})))"
    )
    lon = (
        f"(degrees(({d} - pow({d}, 3) / 6 * (1 + 2 * {t} + {c}) + pow({d}, 5) / 120 * (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + {lit(8 * ep2)} + 24 * {t} * {t})) / cos({p}))"
        f" + {number} * 6 - 183)"
    )
    return lat, lon


def planar(e1: str, n1: str, e2: str, n2: str) -> str:
    """Distance in metres of two UTM points."""
    return f"sqrt(pow({e2} - {e1}, 2) + pow({n2} - {n1}, 2))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, compat: bool = True) -> str:
    """Great-circle distance in metres; `compat` scales both terms by the cosines, as the tools at hand do."""
    dp, dl = f"pow(sin(radians({lat2} - {lat1}) / 2), 2)", f"pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    cc = f"cos(radians({lat1})) * cos(radians({lat2}))"
    a = f"(({dp} + {dl}) * {cc})" if compat else f"({dp} + {cc} * {dl})"
    return f"({lit(EARTH_M)} * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Initial bearing in degrees, 0 to 360."""
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))"
    d = f"(degrees(atan2({y}, {x})) + 360)"
    return f"({d} - 360 * floor({d} / 360))"


def delta_heading(b1: str, b2: str) -> str:
    return f"least(abs({b2} - {b1}), 360 - abs({b2} - {b1}))"


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Ellipsoidal (WGS-84) distance in metres by Vincenty's inverse formula, vectorised over Arrow batches.

    The iteration has no closed form; null where it doesn't converge (nearly antipodal points)."""

    @F.arrow_udf("double")
    def vincenty(a, b, c, d):
        import numpy as np
        import pyarrow as pa

        x = [v.to_numpy(zero_copy_only=False).astype(float) for v in (a, b, c, d)]
        return pa.array(vincenty_inverse(*x), pa.float64(), from_pandas=True) if len(x[0]) else pa.array(np.zeros(0))

    return vincenty(lat1, lon1, lat2, lon2)


def vincenty_inverse(lat1, lon1, lat2, lon2):
    import numpy as np

    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    big_l = np.radians(lon2 - lon1)
    lam = big_l.copy() if hasattr(big_l, "copy") else big_l
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            ss = np.sqrt((cu2 * np.sin(lam)) ** 2 + (cu1 * su2 - su1 * cu2 * np.cos(lam)) ** 2)
            cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * np.sin(lam) / np.where(ss == 0, 1, ss))
            c2a = 1 - sa**2
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1, c2a))
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = big_l + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done | np.isnan(new)):
                break
        us = c2a * (a * a - b * b) / (b * b)
        big_a = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
        big_b = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
        ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        return np.where(done, b * big_a * (sigma - ds), np.nan)
