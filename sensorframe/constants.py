"""The study design, codes and labels that results depend on."""

# Study areas from north to south.
AREAS = ["MAL", "AIL", "VAR", "TII", "PIS", "HYY", "KAR"]

# Areas left out altogether, and the managed sites of one area.
EXCLUDED_AREAS = ["RAR", "SAA", "RAS"]
MANAGED_AREA = "PIS"
MANAGED_SITE_FROM = 100

# Study period as half-open local dates, and the fixed offset from UTC in hours.
PERIOD_START = "2019-11-01"
PERIOD_END = "2020-11-01"
UTC_OFFSET_HOURS = 2

# Calendar range used for the number of days per month.
CALENDAR_START = "2018-01-01"
CALENDAR_END = "2021-12-31"

# Sensors and their statistics.
SOIL_SENSORS = ["T1", "T2", "T3", "moist"]
TEMPERATURES = ["T1", "T2", "T3", "T4"]
STATISTICS = ["mean", "absmax", "absmin", "meanmax", "meanmin"]
UPPER_PROBABILITIES = [0.99, 0.98, 0.97, 0.96, 0.95]
UPPER_LABELS = ["99", "98", "97", "96", "95"]

# Logger error codes that void a sensor.
T1_VOID_CODES = [1, 2, 4]
T2_VOID_CODES = [1, 2]
MOIST_VOID_CODES = [1, 2]
FROZEN_BELOW = 1.0

# Coverage limits. The daily share is in percent, the monthly one a fraction;
# both are compared with 0.95 as published. 95 is the likely intent for the daily limit.
DAILY_COVERAGE_PERCENT = 0.95
MONTHLY_COVERAGE = 0.95
SENSOR_COVERAGE = 0.95
MOISTURE_COVERAGE = 0.1

# Longest run of missing readings that is filled.
MAX_GAP = 3
MAX_GAP_T4 = 1

# Predictors of the monthly models.
PREDICTORS = [
    "altitude",
    "pisr",
    "wetland_prop_100m",
    "snow_days",
    "tpi100",
    "water_prop_500m",
    "canopy_cover2m_10m",
    "moist_med",
]

# When a predictor is not offered to a model.
NO_RADIATION_MONTHS = [1, 2, 11, 12]
NO_SNOW_AREAS = ["KAR"]
NO_ALTITUDE_AREAS = ["KAR", "HYY", "TII"]
NO_WATER_AREAS = ["VAR"]

# Areas whose snow model is Gaussian instead of Poisson.
GAUSSIAN_SNOW_AREAS = ["VAR"]

# Hand-checked snow seasons (id, snow days, first and last snow date) of one year.
SNOW_YEAR = 2020
SNOW_OVERRIDES = [
    ("TII045", 179, "2019-10-28", "2020-04-24"),
    ("TII020", 189, "2019-10-28", "2020-05-04"),
    ("TII006", 177, "2019-10-28", "2020-04-22"),
]

# The first study year covers months 11 and 12, the next year the others.
STUDY_YEAR = 2019
FIRST_YEAR_MONTHS = [11, 12]
HYDRO_MONTHS = [11, 12, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Display names, in display order.
PREDICTOR_LABELS = {
    "altitude": "Elevation",
    "pisr": "Solar radiation",
    "snow_days": "Snow cover",
    "canopy_cover2m_10m": "Canopy cover",
    "tpi100": "TPI",
    "moist_med": "Soil moisture",
    "wetland_prop_100m": "Wetland cover",
    "water_prop_500m": "Water cover",
}
RESPONSE_LABELS = {"absmin": "Tmin", "mean": "Tavg", "absmax": "Tmax"}
EFFECT_LABELS = {"absmin": "T_absmin", "mean": "T_avg", "absmax": "T_absmax"}

# Gradient table columns, display names and decimals, in display order.
GRADIENT_LABELS = {
    "altitude": "Elevation (m)",
    "pisr_Jan": "Solar radiation, January (kWh / m²)",
    "pisr_Jul": "Solar radiation, July (kWh / m²)",
    "canopy_cover2m_10m": "Canopy cover (%)",
    "snow_days": "Snow cover duration (days)",
    "tpi100": "Topographic position index",
    "moist_med": "Soil moisture (VWC%)",
    "wetland_prop_100m": "Wetland cover (%)",
    "water_prop_500m": "Water cover (%)",
}
GRADIENT_DECIMALS = {
    "altitude": 1,
    "pisr_Jan": 2,
    "pisr_Jul": 2,
    "canopy_cover2m_10m": 0,
    "snow_days": 0,
    "tpi100": 1,
    "moist_med": 1,
    "wetland_prop_100m": 0,
    "water_prop_500m": 0,
}
GRADIENT_STATISTICS = ["mean", "median", "min", "max", "range length"]
KJ_PER_KWH = 3600

# Right-closed p-value classes (upper bound, label).
P_CLASSES = [
    (0.001, "< 0.001"),
    (0.01, "0.01 - 0.001"),
    (0.05, "0.05 - 0.01"),
    (0.1, "0.1 - 0.05"),
    (0.5, "0.5 - 0.1"),
    (float("inf"), "1 - 0.5"),
]
EFFECT_PREDICTOR = "canopy_cover2m_10m"

# Permutations per predictor; smoothing grid; normals window and its full length.
PERMUTATIONS = 10
SMOOTH_POINTS = 80
SPREAD_SPAN, WEATHER_SPAN, R2_SPAN = 0.3, 0.2, 0.8
PDP_POINTS = 51
NORMALS_START = "1991-01-01"
NORMALS_END = "2020-12-31"
PERIOD_LAST_DAY = "2020-10-31"

# Two areas that share a weather station are shown as one.
MERGED_AREA = "MAL"
MERGED_LABEL = "MAL & AIL"
DROPPED_AREA = "AIL"
WEATHER_ORDER = ["MAL & AIL", "VAR", "TII", "PIS", "HYY", "KAR"]
