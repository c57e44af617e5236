"""Named SQL functions of the geometry, and a registry of transforms by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geo

#: name -> (parameters, kind of result, expression in them).
FUNCTIONS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "utm_easting": (("lat", "lon"), "DOUBLE", geo.easting("lat", "lon")),
    "utm_northing": (("lat", "lon"), "DOUBLE", geo.northing("lat", "lon")),
    "utm_zone": (("lat", "lon"), "INT", geo.zone("lat", "lon")),
    "utm_letter": (("lat",), "STRING", geo.zone_letter("lat")),
    "utm_lat": (("easting", "northing", "zone"), "DOUBLE", geo.to_latlon("easting", "northing", "zone")[0]),
    "utm_lon": (("easting", "northing", "zone"), "DOUBLE", geo.to_latlon("easting", "northing", "zone")[1]),
    "planar_distance": (("e1", "n1", "e2", "n2"), "DOUBLE", geo.planar("e1", "n1", "e2", "n2")),
    "survey_distance": (("lat1", "lon1", "lat2", "lon2"), "DOUBLE", geo.haversine("lat1", "lon1", "lat2", "lon2")),
    "great_circle_distance": (("lat1", "lon1", "lat2", "lon2"), "DOUBLE", geo.haversine("lat1", "lon1", "lat2", "lon2", False)),
    "initial_bearing": (("lat1", "lon1", "lat2", "lon2"), "DOUBLE", geo.bearing("lat1", "lon1", "lat2", "lon2")),
    "heading_change": (("b1", "b2"), "DOUBLE", geo.delta_heading("b1", "b2")),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions in the session, for spark.sql; their names. They are inlined by the optimizer, as the column forms are."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        typed = ", ".join(f"{p} {'INT' if p == 'zone' else 'DOUBLE'}" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS {kind} RETURN CAST({body} AS {kind})")
    return list(FUNCTIONS)


class Transforms:
    """Transforms of a survey's frames by name: `function(frame, **parameters) -> frame`, found by process and organisation."""

    def __init__(self):
        self.known: dict[tuple[str, str], Callable[..., DataFrame]] = {}

    def add(self, process: str, name: str) -> Callable:
        """A decorator that registers a transform, once for each name."""

        def put(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if (process, name) in self.known:
                raise ValueError(f"{process}/{name} is there already")
            self.known[process, name] = function
            return function

        return put

    def names(self, process: str) -> list[str]:
        return sorted(n for p, n in self.known if p == process)

    def run(self, process: str, name: str, frame: DataFrame, **parameters) -> DataFrame:
        if (process, name) not in self.known:
            raise LookupError(f"no {process}/{name}; there are {', '.join(self.names(process)) or 'none'}")
        return frame.transform(self.known[process, name], **parameters)
