"""Explicit schemas: column order and types are fixed here, never inferred from file contents."""

from __future__ import annotations

from sensorframe import constants as K

READINGS = (
    "id_code string, area string, site int, datetime timestamp, T1 double, T2 double, T3 double, "
    "T4 double, moist double, moist_count double, arh double, error_tomst int, error_T4 int, "
    "logger_T4 string"
)

SITE_VARIABLES = (
    "id_code string, area string, site int, logger string, altitude double, "
    + ", ".join(f"pisr_m{m}_50m double" for m in range(1, 13))
    + ", wetland_prop_100m double, tpi100 double, water_prop_500m double, canopy_cover2m_10m double"
)

SNOW = (
    "id_code string, area string, site int, hydro_year int, snow_days int, "
    "first_snow_date date, last_snow_date date"
)

MOISTURE = "id_code string, area string, year int, month int, moist_prop double, moist_med double"

WEATHER_DAILY = "FMISID int, area string, time date, tday double"

NORMALS = "FMISID int, area string, yday int, n_days long, Tavg30 double"

# Distance columns of the station table.
STATION_DISTANCES = ["KAR", "HYY", "PIS", "TII", "VAR", "AIL", "SAA", "MAL", "RAS"]

STATIONS = (
    "Name string, FMISID int, LPNN int, WMO int, Elevation int, x_utm35 double, y_utm35 double, "
    "Started int, first_date date, last_date date, tdays int, rrdays int, closest_area string, "
    + ", ".join(f"{c} double" for c in STATION_DISTANCES)
    + ", area string"
)

MONTHLY = (
    "id_code string, area string, site int, year int, month int, "
    + ", ".join(f"{s}_prop double" for s in K.TEMPERATURES + ["moist"])
    + ", logger_T4 string, "
    + ", ".join(f"{s}_{k} double" for s in K.TEMPERATURES for k in K.STATISTICS)
    + ", "
    + ", ".join(f"moist_{k} double" for k in ["sd", "cv", "med", "mean", "absmax", "absmin"])
    + ", "
    + ", ".join(f"{s}_{q} double" for s in K.TEMPERATURES for q in K.UPPER_LABELS)
)

RESPONSES = [f"{s}_{k}" for s in K.TEMPERATURES for k in K.STATISTICS]
