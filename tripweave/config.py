"""Thresholds of the operators, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults are the published settings; every operator takes its own from here."""

    survey_name: str = "survey"
    timezone: str = "America/Montreal"
    accuracy_cutoff_m: float = 50.0
    spike_kph: float = 100.0
    break_interval_s: int = 300
    subway_buffer_m: float = 200.0
    subway_most_s: int = 4800
    subway_least_ms: float = 0.1
    velocity_kph: float = 15.0
    lone_break_s: int = 20 * 60
    lone_distance_m: float = 150.0
    min_trip_m: float = 250.0
    cold_start_m: float = 750.0
    location_proximity_m: float = 50.0
    explained_distance_m: float = 750.0
    explained_days: int = 2
    stop_min_s: int = 120
    min_step_m: float = 0.1


#: Trip codes of the current algorithm.
TRIP_CODES = {
    "complete": 1, "complete subway": 2, "missing": 101, "missing subway": 102, "missing too short": 103,
    "missing known location": 104, "single point": 201, "too short": 202,
}
