"""Column contract, fixed values and tunables shared by every job."""

from __future__ import annotations

from dataclasses import dataclass

TANK = "tank_id"
TIME = "timestamp"
RAIN = "rainfall_mm"
INFLOW = "inflow_litres"
USAGE = "usage_litres"
LEVEL = "tank_level_litres"
CAPACITY = "tank_capacity_litres"
TEMPERATURE = "temperature_c"
TARGET = "target_level_next"

# Physical layout columns added by the staging step, never part of a result.
SEGMENT = "segment"
TS_US = "ts_us"
HOT = "is_hot"
SEQ = "ingest_seq"
COERCED = "coerced_cells"
LAYOUT = [SEGMENT, TS_US, HOT, SEQ, COERCED]
SEGMENT_KEYS = [TANK, SEGMENT]

# --- fixed values: must equal the published behaviour this engine reproduces -------------------
DEFAULT_CAPACITY = 5000.0
REQUIRED_COLUMNS = [TIME, RAIN, INFLOW, USAGE, LEVEL]
NUMERIC_COLUMNS = [RAIN, INFLOW, USAGE, LEVEL, CAPACITY, TEMPERATURE]
INTERNAL_COLUMNS = ["_is_sensor_outlier", "overflow_litres"]
FLAGS = ["level_was_outlier", "inflow_was_outlier", "usage_was_outlier"]

FEATURES = [
    "hour", "day_of_week", "is_weekend",
    RAIN, INFLOW, USAGE, LEVEL, TEMPERATURE,
    "fill_pct", "net_flow_litres", "headroom_litres", "delta_lag_1",
    "level_lag_1", "level_lag_2", "level_lag_3",
    "inflow_lag_1", "inflow_lag_2", "inflow_lag_3",
    "usage_lag_1", "usage_lag_2", "usage_lag_3",
    "rain_lag_1", "rain_lag_2", "rain_lag_3",
    "rain_roll_3", "rain_roll_6", "rain_roll_24",
    "usage_roll_mean_6", "usage_roll_mean_24",
]

# Text cells a CSV reader treats as missing before any numeric coercion is counted.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

PREVENT = "PREVENT_OVERFLOW"
HARVEST = "HARVEST"
USE = "USE"
CONSERVE = "CONSERVE"
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningRules:
    """Outlier limits of the cleaning job."""

    iqr_multiplier: float = 3.0
    zscore_threshold: float = 3.5
    max_level_jump_litres: float | None = None
    jump_fraction: float = 0.30
    min_positive_readings: int = 10


@dataclass(frozen=True)
class ControlRules:
    """Thresholds of the operating rules and of the balance they control."""

    overflow_pct: float = 90.0
    early_overflow_pct: float = 75.0
    use_band_pct: float = 55.0
    low_pct: float = 30.0
    heavy_rain_3h_mm: float = 4.0
    heavy_rain_24h_mm: float = 12.0
    max_preventive_draw: float = 700.0
    conserve_reduction: float = 0.40
    reserve_fraction: float = 0.15
    event_eps_litres: float = 1.0
    warning_fraction: float = 0.90
    flatline_hours: int = 6
    history_rows: int = 48


@dataclass(frozen=True)
class InputLimits:
    """Plausibility limits of a typed-in hourly reading."""

    max_rainfall_mm: float = 100.0
    max_inflow_litres: float = 50_000.0
    max_usage_litres: float = 10_000.0


@dataclass(frozen=True)
class Layout:
    """How much of one series a single task may hold."""

    segment_rows: int = 500_000
    cells_per_segment: int = 8


CLEANING = CleaningRules()
CONTROL = ControlRules()
LIMITS = InputLimits()
LAYOUT_DEFAULT = Layout()


class DataValidationError(ValueError):
    """A dataset lacks columns or rows the pipeline needs."""
