"""Plain SQL for the catalogued queries, written independently of the segment layout.

Each statement is a chain of named steps followed by a result. A step is only included when it is needed.
"""

from __future__ import annotations

from tidewell.catalog.queries import NUDGE
from tidewell.contract import FEATURES

MEASURES = ["rainfall_mm", "inflow_litres", "usage_litres", "tank_level_litres", "temperature_c"]
NUMERIC = [
    "rainfall_mm", "inflow_litres", "usage_litres", "tank_level_litres", "tank_capacity_litres", "temperature_c",
]
FLAGS = ["level_was_outlier", "inflow_was_outlier", "usage_was_outlier"]
KEY = 'tank_id, "timestamp"'
W = 'PARTITION BY tank_id ORDER BY "timestamp"'


FILE_OF_EVENT = (
    "CASE event_id % 6 WHEN 0 THEN 'iso' WHEN 1 THEN 'zoned' WHEN 2 THEN 'month' WHEN 3 THEN 'day' WHEN 4 THEN 'name' ELSE 'epoch' END "
    "AS source_file"
)


def settled(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}, 6) AS {name or expr}"


def d(*names: str) -> str:
    return ", ".join(settled(n) for n in names)


def n(*names: str) -> str:
    return ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in names)


# --- steps --------------------------------------------------------------------------------------
_READING = """
  CASE WHEN event_type = 'view' THEN value / 10 - 0.1 END AS rainfall_mm,
  CASE WHEN event_type = 'click' THEN value * 4 - 4 END AS inflow_litres,
  CASE WHEN event_type = 'purchase' THEN value * 2 - 2 END AS usage_litres,
  CASE WHEN event_type = 'signup' THEN value * 25 - 100 END AS tank_level_litres,
  CAST(5000.0 AS DOUBLE) AS tank_capacity_litres,
  CASE WHEN event_type = 'error' THEN value END AS temperature_c
"""


def _signal(kind: str, scale: float, offset: float) -> str:
    total = f"CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = '{kind}') AS DOUBLE)"
    return f"{total} * CAST({scale} AS DOUBLE) + CAST({offset} AS DOUBLE)"


TELEMETRY = f"""
SELECT user_id AS tank_id, date_trunc('hour', ts) AS "timestamp",
  {_signal('view', 0.1, -0.1)} AS rainfall_mm,
  {_signal('click', 4.0, -4.0)} AS inflow_litres,
  {_signal('purchase', 2.0, -2.0)} AS usage_litres,
  max_by(value, ts) FILTER (event_type = 'signup') * 25.0 - 100.0 AS tank_level_litres,
  CAST(5000.0 AS DOUBLE) AS tank_capacity_litres,
  ({_signal('error', 1.0, 0.0)}) / count(*) FILTER (event_type = 'error') AS temperature_c
FROM events GROUP BY 1, 2
"""
LONG_TELEMETRY = f'SELECT CAST(0 AS BIGINT) AS tank_id, ts AS "timestamp", event_id, {_READING} FROM events'
EVENT_READINGS = f"""
SELECT user_id AS tank_id, date_trunc('hour', ts) AS "timestamp", event_id AS ingest_seq, {_READING} FROM events
"""
TEXT = """
SELECT user_id AS tank_id, event_id AS ingest_seq,
  CASE WHEN event_type <> 'error' THEN ts END AS "timestamp", event_type, value, props,
  CASE WHEN event_type = 'view' THEN value END AS rainfall_mm,
  CASE WHEN event_type <> 'click' THEN value END AS inflow_litres,
  CASE WHEN event_type <> 'purchase' THEN value END AS usage_litres,
  value AS tank_level_litres
FROM events
"""


def _low(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN 0.0 ELSE {c} END"


STEPS: dict[str, str] = {
    "clipped": f"""
SELECT *, {_low('rainfall_mm')} AS rain_c, {_low('inflow_litres')} AS inflow_c, {_low('usage_litres')} AS usage_c
FROM telemetry""",
    "stats": """
SELECT tank_id, quantile_cont(tank_capacity_litres, 0.5) AS cap_median,
  count(*) FILTER (inflow_c > 0) AS pos_n, min(inflow_c) FILTER (inflow_c > 0) AS pos_min, max(inflow_c) AS inflow_max,
  quantile_cont(inflow_c, 0.25) FILTER (inflow_c > 0) AS q1, quantile_cont(inflow_c, 0.75) FILTER (inflow_c > 0) AS q3,
  quantile_cont(inflow_c, 0.99) FILTER (inflow_c > 0) AS p99,
  count(usage_c) AS usage_n, avg(usage_c) AS usage_mean, stddev_pop(usage_c) AS usage_std,
  quantile_cont(usage_c, 0.5) AS usage_median
FROM clipped GROUP BY tank_id""",
    "fences": """
SELECT *, CASE WHEN cap_median > 0 THEN cap_median ELSE 5000.0 END AS cap,
  CASE WHEN pos_n < 10 THEN coalesce(inflow_max, 0.0)
       WHEN q3 + 3.0 * (q3 - q1) <= pos_min THEN p99 ELSE q3 + 3.0 * (q3 - q1) END AS inflow_fence
FROM stats""",
    "ranged": """
SELECT c.*, f.cap, f.inflow_fence, f.usage_n, f.usage_mean, f.usage_std, f.usage_median,
  coalesce(tank_level_litres < 0 OR tank_level_litres > f.cap, false) AS level_out_of_range,
  CASE WHEN tank_level_litres BETWEEN 0 AND f.cap THEN tank_level_litres END AS level_in_range
FROM clipped c JOIN fences f USING (tank_id)""",
    "jumped": f"""
SELECT *, coalesce(abs(level_in_range - lag(level_in_range) OVER ({W})) > 0.3 * cap, false) AS level_jump,
  coalesce(inflow_c > inflow_fence, false) AS inflow_was_outlier,
  CASE WHEN usage_n < 3 OR usage_std = 0 THEN false
       ELSE coalesce(abs((usage_c - usage_mean) / usage_std) > 3.5, false) END AS usage_extreme
FROM ranged""",
    "flagged": """
SELECT *, level_out_of_range OR level_jump AS level_was_outlier,
  usage_extreme AND coalesce(usage_c > usage_median, false) AS usage_was_outlier
FROM jumped""",
    "nulled": """
SELECT *, coalesce(rain_c, 0.0) AS rain_f,
  CASE WHEN NOT inflow_was_outlier THEN inflow_c END AS inflow_n,
  CASE WHEN NOT inflow_was_outlier THEN coalesce(inflow_c, 0.0) END AS inflow_z,
  CASE WHEN NOT usage_was_outlier THEN usage_c END AS usage_z,
  CASE WHEN NOT level_was_outlier THEN tank_level_litres END AS level_z
FROM flagged""",
}


def _gap_step(source: str, columns: dict[str, str]) -> str:
    """Nearest valid value and time on both sides for ``input -> prefix``."""
    parts = []
    for c, p in columns.items():
        t = f'CASE WHEN {c} IS NOT NULL THEN epoch_us("timestamp") END'
        back = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        ahead = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        parts += [
            f"last_value({c} IGNORE NULLS) {back} AS {p}_v0", f"last_value({t} IGNORE NULLS) {back} AS {p}_t0",
            f"first_value({c} IGNORE NULLS) {ahead} AS {p}_v1", f"first_value({t} IGNORE NULLS) {ahead} AS {p}_t1",
        ]
    return f"SELECT *, {', '.join(parts)} FROM {source}"


def _filled(c: str, p: str) -> str:
    t = 'epoch_us("timestamp")'
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {p}_v0 IS NOT NULL AND {p}_v1 IS NOT NULL "
        f"THEN {p}_v0 + ({p}_v1 - {p}_v0) * (CAST({t} - {p}_t0 AS DOUBLE) / ({p}_t1 - {p}_t0)) "
        f"ELSE coalesce({p}_v0, {p}_v1) END"
    )


_CLEAN_GAPS = {"inflow_z": "i", "level_z": "l", "temperature_c": "t", "usage_z": "u"}
STEPS["gaps"] = _gap_step("nulled", _CLEAN_GAPS)
_LEVEL = f"coalesce({_filled('level_z', 'l')}, 0.0)"
STEPS["cleaned"] = f"""
SELECT tank_id, "timestamp", rain_f AS rainfall_mm,
  coalesce({_filled('inflow_z', 'i')}, 0.0) AS inflow_litres,
  coalesce({_filled('usage_z', 'u')}, 0.0) AS usage_litres,
  least(greatest({_LEVEL}, 0.0), cap) AS tank_level_litres,
  cap AS tank_capacity_litres,
  coalesce({_filled('temperature_c', 't')}, 0.0) AS temperature_c,
  {', '.join(FLAGS)}
FROM gaps"""

_SOURCES = {"level": "tank_level_litres", "inflow": "inflow_litres", "usage": "usage_litres", "rain": "rainfall_mm"}
_LAGS = [f"{p}_lag_{k}" for p in _SOURCES for k in (1, 2, 3)]


def _feature_step(source: str) -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER ({W}) AS {p}_lag_{k}" for p, c in _SOURCES.items() for k in (1, 2, 3))
    rain = ", ".join(
        f"sum(rainfall_mm) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS rain_roll_{k}" for k in (3, 6, 24)
    )
    usage = ", ".join(
        f"avg(usage_litres) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS usage_roll_mean_{k}"
        for k in (6, 24)
    )
    return f"""
SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week,
  CASE WHEN isodow("timestamp") >= 6 THEN 1 ELSE 0 END AS is_weekend,
  {_low('tank_level_litres / tank_capacity_litres * 100.0')} AS fill_pct,
  inflow_litres - usage_litres AS net_flow_litres,
  tank_capacity_litres - tank_level_litres AS headroom_litres,
  {lags}, tank_level_litres - lag(tank_level_litres) OVER ({W}) AS delta_lag_1, {rain}, {usage},
  lead(tank_level_litres) OVER ({W}) AS target_level_next
FROM {source}"""


STEPS["featured"] = _feature_step("cleaned")
STEPS["complete"] = "SELECT * FROM featured WHERE level_lag_3 IS NOT NULL AND target_level_next IS NOT NULL"
STEPS["numbered"] = f"""
SELECT *, row_number() OVER ({W}) AS row_index, count(*) OVER (PARTITION BY tank_id) AS tank_rows FROM complete"""
STEPS["parts"] = """
SELECT *, CASE WHEN row_index <= floor(tank_rows * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM numbered"""
_PHYS = "tank_level_litres + inflow_litres - usage_roll_mean_24"
_BASE = f"greatest(least({_PHYS}, tank_capacity_litres - 1e-9), 0.0)"
STEPS["scored"] = f"""
SELECT tank_id, "timestamp", tank_capacity_litres AS cap, tank_level_litres AS current_level, rainfall_mm, inflow_litres,
  usage_litres, usage_roll_mean_24, rain_roll_3, rain_roll_24, fill_pct, target_level_next AS actual_level,
  tank_level_litres AS pred_persistence, {_BASE} AS pred_physics, {_BASE} AS pred,
  {_BASE} / tank_capacity_litres * 100.0 AS pred_fill_pct, {_BASE} - target_level_next AS error
FROM parts WHERE split = 'test'"""
STEPS["predictions"] = """
SELECT tank_id, cap, 'persistence' AS model, actual_level AS actual, pred_persistence AS predicted FROM scored
UNION ALL SELECT tank_id, cap, 'physics', actual_level, pred_physics FROM scored"""


def _action(fill: str, r3: str = "rain_roll_3", r24: str = "rain_roll_24") -> str:
    wet = f"(coalesce({r3}, 0) >= 4 OR coalesce({r24}, 0) >= 12)"
    return (
        f"CASE WHEN {fill} > 90 THEN 'PREVENT_OVERFLOW' WHEN {fill} >= 75 AND {wet} THEN 'PREVENT_OVERFLOW' "
        f"WHEN {fill} < 30 THEN 'CONSERVE' WHEN {fill} >= 55 AND {wet} THEN 'USE' ELSE 'HARVEST' END"
    )


def _text(x: str, places: int) -> str:
    return f"printf('%.{places}f', round_even({x}, {places}))"


def _reason(fill: str, r3: str = "rain_roll_3", r24: str = "rain_roll_24") -> str:
    short, wet, pct = f"{r3} >= 4", f"({r3} >= 4 OR {r24} >= 12)", _text(fill, 0)
    return f"""CASE
 WHEN {fill} > 90 THEN 'Predicted level ' || {pct} || '% of capacity - above the 90% spill line. Open the overflow/divert valve and draw down now.'
 WHEN {fill} >= 75 AND {wet} THEN 'Only ' || {pct} || '% full but ' || CASE WHEN {short} THEN {_text(r3, 1)} || ' mm in the last 3 h' ELSE {_text(r24, 1)} || ' mm in the last 24 h' END || ' of rain is already in the tank''s path - pre-emptive draw-down avoids a spill.'
 WHEN {fill} < 30 THEN 'Predicted level ' || {pct} || '% of capacity - below the 30% reserve line. Restrict non-essential use (irrigation, car washing).'
 WHEN {fill} >= 55 AND {wet} THEN {pct} || '% full with ' || {_text(f'greatest({r3}, {r24})', 1)} || ' mm of incoming rain - draw water now (irrigation/household) to keep headroom for the storm.'
 ELSE 'Predicted level ' || {pct} || '% of capacity - inside the comfortable 30-90% band. Keep collecting.' END"""


# The balance, hour by hour: the literal recursion.
STEPS["hours"] = f"""
SELECT *, row_number() OVER ({W}) AS rn, {_action('pred_fill_pct')} AS action,
  CASE WHEN {_action('pred_fill_pct')} = 'CONSERVE' THEN usage_litres * 0.6 ELSE usage_litres END AS essential
FROM scored"""
STEPS["walk"] = """
SELECT tank_id, rn, current_level AS bn, current_level AS bc,
  least(cap, greatest(0.0, current_level + inflow_litres - usage_litres)) AS ln,
  least(cap, greatest(0.0, current_level + inflow_litres - essential)) AS lc
FROM hours WHERE rn = 1
UNION ALL
SELECT h.tank_id, h.rn, w.ln, w.lc,
  least(h.cap, greatest(0.0, w.ln + h.inflow_litres - h.usage_litres)),
  least(h.cap, greatest(0.0, w.lc + h.inflow_litres - h.essential))
FROM walk w JOIN hours h ON h.tank_id = w.tank_id AND h.rn = w.rn + 1"""
STEPS["wishes"] = """
SELECT h.tank_id, h."timestamp", h.cap, 'no_controller' AS scenario, 'HARVEST' AS action, w.ln AS level,
  w.bn + h.inflow_litres - h.usage_litres AS wish, h.usage_litres AS demand, h.usage_litres AS essential
FROM hours h JOIN walk w USING (tank_id, rn)
UNION ALL
SELECT h.tank_id, h."timestamp", h.cap, 'with_controller', h.action, w.lc,
  w.bc + h.inflow_litres - h.essential, h.usage_litres, h.essential
FROM hours h JOIN walk w USING (tank_id, rn)"""
STEPS["spills"] = """
SELECT *, greatest(wish - cap, 0.0) AS spill, greatest(-wish, 0.0) AS unmet_litres,
  CASE WHEN action = 'PREVENT_OVERFLOW' THEN least(greatest(wish - cap, 0.0), 700.0) ELSE 0.0 END AS extra_used_litres,
  demand - essential AS restricted_litres
FROM wishes"""
STEPS["trajectory"] = """
SELECT *, spill - extra_used_litres AS overflow_litres, spill - extra_used_litres > 1.0 AS is_overflow,
  unmet_litres > 1.0 OR level <= 0.15 * cap AS is_shortage
FROM spills"""
STEPS["edges"] = """
SELECT *, is_overflow AND NOT coalesce(lag(is_overflow) OVER s, false) AS over_starts,
  is_shortage AND NOT coalesce(lag(is_shortage) OVER s, false) AS short_starts
FROM trajectory WINDOW s AS (PARTITION BY tank_id, scenario ORDER BY "timestamp")"""
STEPS["summary"] = """
SELECT tank_id, scenario, sum(overflow_litres) AS overflow_litres, count(*) FILTER (is_overflow) AS overflow_hours,
  count(*) FILTER (over_starts) AS overflow_events, count(*) FILTER (is_shortage) AS shortage_hours,
  count(*) FILTER (short_starts) AS shortage_events, sum(unmet_litres) AS unmet_demand_litres,
  sum(extra_used_litres) AS productive_extra_used_litres, sum(restricted_litres) AS demand_restricted_litres,
  max_by(level, "timestamp") AS final_level, avg(level) AS mean_level, min(level) AS min_level, count(*) AS hours
FROM edges GROUP BY tank_id, scenario"""
# The same recursion over all cleaned rows, uncontrolled.
STEPS["flows"] = f"SELECT *, row_number() OVER ({W}) AS rn FROM cleaned"


def _plain_walk(start: str) -> str:
    return f"""
SELECT tank_id, rn, {start} AS b, least(tank_capacity_litres, greatest(0.0, {start} + inflow_litres - usage_litres)) AS l
FROM flows WHERE rn = 1
UNION ALL
SELECT f.tank_id, f.rn, w.l, least(f.tank_capacity_litres, greatest(0.0, w.l + f.inflow_litres - f.usage_litres))
FROM plain w JOIN flows f ON f.tank_id = w.tank_id AND f.rn = w.rn + 1"""


STEPS["plain"] = _plain_walk("tank_level_litres")
STEPS["plain_balance"] = """
SELECT f.tank_id, f."timestamp", w.l AS level,
  greatest(w.b + f.inflow_litres - f.usage_litres - f.tank_capacity_litres, 0.0) AS overflow_litres
FROM flows f JOIN plain w USING (tank_id, rn)"""

# --- live rows and faults -----------------------------------------------------------------------
_NEWEST = 'row_number() OVER (PARTITION BY tank_id ORDER BY "timestamp" DESC)'
STEPS["now_rows"] = f"""
SELECT c.tank_id, c.tank_capacity_litres, c.rainfall_mm, c.inflow_litres, c.usage_litres, c.temperature_c,
  coalesce(t.tank_level_litres, c.tank_level_litres) AS tank_level_litres
FROM (SELECT *, {_NEWEST} AS age FROM cleaned) c JOIN telemetry t USING (tank_id, "timestamp") WHERE age = 1"""
STEPS["live_input"] = f"""
SELECT tank_id, "timestamp", rainfall_mm, inflow_litres, usage_litres, tank_level_litres, temperature_c, tank_capacity_litres
FROM (SELECT *, {_NEWEST} AS age FROM cleaned) WHERE age <= 48
UNION ALL
SELECT n.tank_id, m.last_time + INTERVAL 1 HOUR, n.rainfall_mm, n.inflow_litres, n.usage_litres, n.tank_level_litres,
  n.temperature_c, n.tank_capacity_litres
FROM now_rows n JOIN (SELECT tank_id, max("timestamp") AS last_time FROM cleaned GROUP BY tank_id) m USING (tank_id)"""
STEPS["live_featured"] = _feature_step("live_input")
STEPS["live"] = f"SELECT * FROM (SELECT *, {_NEWEST} AS age FROM live_featured) WHERE age = 1"
STEPS["window8"] = f"SELECT * FROM (SELECT *, {_NEWEST} AS age FROM telemetry) WHERE age <= 8"
STEPS["runs8"] = """
SELECT tank_id, max(len) AS flatline_run FROM (
  SELECT tank_id, grp, count(*) AS len FROM (
    SELECT *, sum(brk) OVER (PARTITION BY tank_id ORDER BY "timestamp") AS grp FROM (
      SELECT *, CASE WHEN tank_level_litres = lag(tank_level_litres) OVER (PARTITION BY tank_id ORDER BY "timestamp")
                THEN 0 ELSE 1 END AS brk
      FROM window8 WHERE tank_level_litres IS NOT NULL))
  GROUP BY tank_id, grp)
GROUP BY tank_id"""
STEPS["faults"] = """
SELECT w.*, coalesce(r.flatline_run, 0) AS flatline_run FROM (
  SELECT tank_id, count(*) AS checked_rows, count(*) FILTER (tank_level_litres IS NULL) AS missing_levels,
    count(*) FILTER (tank_level_litres < 0) AS negative_levels, count(*) FILTER (tank_level_litres > tank_capacity_litres) AS over_levels,
    count(*) FILTER (inflow_litres < 0) AS negative_inflows, min(tank_level_litres) AS min_level,
    max(tank_level_litres) AS max_level, max(tank_capacity_litres) AS cap,
    last(tank_level_litres ORDER BY "timestamp") FILTER (tank_level_litres IS NOT NULL) AS frozen_level
  FROM window8 GROUP BY tank_id) w LEFT JOIN runs8 r USING (tank_id)"""
STEPS["checked"] = f"""
SELECT tank_id, checked_rows, flatline_run, concat_ws('; ',
  CASE WHEN missing_levels > 0 THEN missing_levels || ' of the last ' || checked_rows || ' level readings are missing (NaN)' END,
  CASE WHEN negative_levels > 0 THEN negative_levels || ' negative level reading(s) (e.g. ' || {_text('min_level', 0)} || ' L)' END,
  CASE WHEN over_levels > 0 THEN over_levels || ' reading(s) above capacity (max ' || {_text('max_level', 0)} || ' L > ' || {_text('cap', 0)} || ' L)' END,
  CASE WHEN flatline_run >= 6 THEN 'sensor appears frozen: ' || flatline_run || ' identical readings in a row (' || {_text('frozen_level', 0)} || ' L)' END,
  CASE WHEN negative_inflows > 0 THEN negative_inflows || ' negative inflow reading(s)' END) AS reasons
FROM faults"""


def _level_problem(level: str, cap: str) -> str:
    return (
        f"CASE WHEN {level} < 0 THEN 'Tank level cannot be negative (got ' || {_text(level, 1)} || ' L).' "
        f"WHEN {level} > {cap} THEN 'Tank level ' || {_text(level, 1)} || ' L exceeds tank capacity ' || {_text(cap, 1)} || ' L.' END"
    )


def _problems(level: str, rain: str, inflow: str, usage: str, cap: str) -> str:
    return f"""CASE WHEN {level} IS NULL THEN 'Tank level must be a real number (got NaN/missing).' ELSE concat_ws(' ',
  {_level_problem(level, cap)},
  CASE WHEN {rain} < 0 THEN 'Rainfall cannot be negative (got ' || {_text(rain, 2)} || ' mm).'
       WHEN {rain} > 100 THEN 'Rainfall ' || {_text(rain, 1)} || ' mm is implausible for one hour (max 100 mm).' END,
  CASE WHEN {inflow} < 0 THEN 'Inflow cannot be negative (got ' || {_text(inflow, 1)} || ' L).'
       WHEN {inflow} > 50000 THEN 'Inflow ' || {_text(inflow, 0)} || ' L/h is implausible (max 50,000 L/h).' END,
  CASE WHEN {usage} < 0 THEN 'Usage cannot be negative (got ' || {_text(usage, 1)} || ' L).'
       WHEN {usage} > 10000 THEN 'Usage ' || {_text(usage, 0)} || ' L/h is implausible (max 10,000 L/h).' END) END"""


STEPS["asked"] = f"""
SELECT *, {_problems('tank_level_litres', 'rainfall_mm', 'inflow_litres', 'usage_litres', 'tank_capacity_litres')} AS errors
FROM now_rows"""
_LIVE_LEVEL = (
    "CASE WHEN k.reasons <> '' THEN greatest(least(l.tank_level_litres + l.inflow_litres - l.usage_roll_mean_24, "
    "l.tank_capacity_litres), 0.0) ELSE l.tank_level_litres END"
)
STEPS["answers"] = f"""
SELECT a.tank_id, a.errors, CASE WHEN a.errors = '' THEN {_LIVE_LEVEL} END AS predicted_level,
  CASE WHEN a.errors = '' THEN {_LIVE_LEVEL} / l.tank_capacity_litres * 100.0 END AS predicted_fill_pct,
  CASE WHEN a.errors = '' THEN a.tank_level_litres / l.tank_capacity_litres * 100.0 END AS current_fill_pct,
  CASE WHEN a.errors = '' THEN k.reasons <> '' END AS used_fallback,
  CASE WHEN a.errors = '' AND k.reasons <> '' THEN k.reasons END AS fallback_reason,
  l.rain_roll_3, l.rain_roll_24
FROM asked a JOIN live l USING (tank_id) JOIN checked k USING (tank_id)"""
STEPS["recommended"] = f"""
SELECT *, CASE WHEN errors = '' THEN {_action('predicted_fill_pct')} END AS action,
  CASE WHEN errors = '' THEN {_reason('predicted_fill_pct')} END AS reason
FROM answers"""

NEEDS = {
    "clipped": ["telemetry"], "stats": ["clipped"], "fences": ["stats"], "ranged": ["clipped", "fences"],
    "jumped": ["ranged"], "flagged": ["jumped"], "nulled": ["flagged"], "gaps": ["nulled"], "cleaned": ["gaps"],
    "featured": ["cleaned"], "complete": ["featured"], "numbered": ["complete"], "parts": ["numbered"],
    "scored": ["parts"], "predictions": ["scored"], "hours": ["scored"], "walk": ["hours"],
    "wishes": ["hours", "walk"], "spills": ["wishes"], "trajectory": ["spills"], "edges": ["trajectory"],
    "summary": ["edges"], "flows": ["cleaned"], "plain": ["flows"], "plain_balance": ["flows", "plain"],
    "now_rows": ["cleaned", "telemetry"], "live_input": ["cleaned", "now_rows"], "live_featured": ["live_input"],
    "live": ["live_featured"], "window8": ["telemetry"], "runs8": ["window8"], "faults": ["window8", "runs8"],
    "checked": ["faults"], "asked": ["now_rows"], "answers": ["asked", "live", "checked"],
    "recommended": ["answers"],
}


def sql(result: str, *steps: str, source: str = TELEMETRY, replace: dict[str, str] | None = None) -> str:
    """WITH-chain of the given steps and everything they need, followed by ``result``."""
    bodies = {"telemetry": source, **STEPS, **(replace or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in NEEDS.get(name, []):
                visit(need)
            order.append(name)

    for s in steps:
        visit(s)
    # The walks are recursive; the rest is computed once.
    chain = ",\n".join(
        f"{s} AS ({bodies[s]})" if s in ("walk", "plain") else f"{s} AS MATERIALIZED ({bodies[s]})" for s in order
    )
    return f"WITH RECURSIVE {chain}\n{result}"


_FEATURES = [f for f in FEATURES if f not in ("hour", "day_of_week", "is_weekend")]
_CALENDAR = ["hour", "day_of_week", "is_weekend"]

_R2 = (
    "CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(actual) > 0 THEN 1.0 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)) "
    "WHEN sum((predicted - actual) ** 2) = 0 THEN 1.0 ELSE 0.0 END"
)
_METRICS = (
    f"{settled('avg(abs(predicted - actual))', 'mae')}, {settled('sqrt(avg((predicted - actual) ** 2))', 'rmse')}, "
    f"{settled(_R2, 'r2')}, count(*) AS n"
)


def _warning(fraction: float) -> str:
    return f"""
SELECT model, max(cap * {fraction}) AS threshold_litres,
  count(*) FILTER (actual >= cap * {fraction} AND predicted >= cap * {fraction}) AS true_positives,
  count(*) FILTER (NOT actual >= cap * {fraction} AND predicted >= cap * {fraction}) AS false_positives,
  count(*) FILTER (actual >= cap * {fraction} AND NOT predicted >= cap * {fraction}) AS false_negatives,
  count(*) FILTER (NOT actual >= cap * {fraction} AND NOT predicted >= cap * {fraction}) AS true_negatives
FROM predictions GROUP BY model"""


_PRECISION = "CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END"
_RECALL = "CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END"
_F1 = (
    "CASE WHEN 2 * true_positives + false_positives + false_negatives > 0 "
    "THEN 2 * true_positives / (2 * true_positives + false_positives + false_negatives) ELSE 0.0 END"
)
_MISSING = {c: f"count(*) FILTER ({c} IS NULL)" if c != "tank_capacity_litres" else "0" for c in NUMERIC}
_REPORT_STEP = f"""
SELECT tank_id, count(*) AS rows_raw, 0 AS bad_timestamps_dropped, 0 AS duplicate_rows_removed, 0 AS non_numeric_coerced,
  count(*) AS rows_clean, max(cap) AS capacity,
  {', '.join(f'{v} AS missing_before_{c}' for c, v in _MISSING.items())},
  {', '.join(f'0 AS missing_after_{c}' for c in NUMERIC)},
  count(*) FILTER (tank_level_litres < 0) AS level_negative_repaired,
  count(*) FILTER (tank_level_litres > cap) AS level_over_capacity_repaired,
  count(*) FILTER (level_jump) AS level_impossible_jump_repaired,
  count(*) FILTER (level_was_outlier) AS level_values_repaired_total,
  count(*) FILTER (rainfall_mm < 0) AS rainfall_negative_clipped,
  count(*) FILTER (inflow_litres < 0) AS inflow_negative_clipped,
  count(*) FILTER (usage_litres < 0) AS usage_negative_clipped,
  count(*) FILTER (inflow_was_outlier) AS inflow_iqr_spikes_repaired, max(inflow_fence) AS inflow_iqr_fence_litres,
  count(*) FILTER (usage_was_outlier) AS usage_zscore_spikes_repaired,
  count(*) FILTER (level_was_outlier OR inflow_was_outlier OR usage_was_outlier) AS rows_flagged
FROM flagged GROUP BY tank_id"""
_FILLED = {c: f"missing_before_{c}" + (" + level_values_repaired_total" if c == "tank_level_litres" else "") for c in NUMERIC}
_FULL_REPORT = f"""
SELECT *, {', '.join(f'{v} AS missing_filled_{c}' for c, v in _FILLED.items())},
  {' + '.join(_FILLED.values())} AS total_values_repaired FROM counted"""
STEPS["counted"], NEEDS["counted"] = _REPORT_STEP, ["flagged"]
STEPS["report"], NEEDS["report"] = _FULL_REPORT, ["counted"]

_REPORT_COUNTS = [
    "rows_raw", "bad_timestamps_dropped", "duplicate_rows_removed", "non_numeric_coerced", "rows_clean",
    "level_negative_repaired", "level_over_capacity_repaired", "level_impossible_jump_repaired",
    "level_values_repaired_total", "rainfall_negative_clipped", "inflow_negative_clipped", "usage_negative_clipped",
    "inflow_iqr_spikes_repaired", "usage_zscore_spikes_repaired", "rows_flagged", "total_values_repaired",
    *[f"missing_{s}_{c}" for s in ("before", "filled", "after") for c in NUMERIC],
]
_OUTLIERS = [
    "level_negative_repaired", "level_over_capacity_repaired", "level_impossible_jump_repaired",
    "level_values_repaired_total", "rainfall_negative_clipped", "inflow_negative_clipped", "usage_negative_clipped",
    "inflow_iqr_spikes_repaired", "inflow_iqr_fence_litres", "usage_zscore_spikes_repaired", "rows_flagged",
]


def _outlier(c: str) -> str:
    return f"round_even(round({c}, 6), 1)" if c == "inflow_iqr_fence_litres" else c


_PASS = ["level", "overflow_litres", "extra_used_litres", "unmet_litres", "restricted_litres"]
_IMPACT = {
    "Overflow (L)": "overflow_litres", "Overflow hours": "overflow_hours", "Overflow events": "overflow_events",
    "Shortage hours (below 15% reserve)": "shortage_hours", "Shortage events": "shortage_events",
    "Unmet demand (L)": "unmet_demand_litres", "Demand postponed by CONSERVE (L)": "demand_restricted_litres",
    "Lowest level (L)": "min_level", "Mean level (L)": "mean_level",
}
_PAIR = "FROM summary n JOIN summary w ON n.tank_id = w.tank_id AND n.scenario = 'no_controller' AND w.scenario = 'with_controller'"
_BANNER = (
    "CASE WHEN used_fallback THEN '**Sensor fault suspected — using fallback baseline.** Reason: ' || fallback_reason || "
    "'. The ML model has been bypassed and the physics baseline (current level + inflow − average usage, clipped to the tank) "
    "is serving the recommendation.' WHEN errors = '' THEN 'Sensors healthy — the trained ML model produced this prediction.' END"
)


def oracle_sql() -> dict[str, str]:
    long_ = {"source": LONG_TELEMETRY}
    tele = "FROM telemetry"
    out = {
        # sources
        "read_telemetry_csv": (
            "SELECT user_id AS tank_id, CASE WHEN event_type = 'error' THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || "
            "CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(printf('%06d', microsecond(ts) % 1000000), '0') END END AS \"timestamp\", "
            "CASE WHEN event_type = 'view' THEN CAST(value AS VARCHAR) END AS rainfall_mm, "
            "CASE WHEN event_type = 'click' THEN props ELSE CAST(value AS VARCHAR) END AS inflow_litres, "
            "CASE WHEN event_type = 'purchase' THEN props ELSE CAST(value AS VARCHAR) END AS usage_litres, "
            "CAST(value AS VARCHAR) AS tank_level_litres FROM events"
        ),
        "passthrough_frame": sql(f"SELECT {KEY}, {d(*MEASURES, 'tank_capacity_litres')} {tele}", "telemetry"),
        "normalise_headers": sql(f"SELECT {KEY}, {d(*MEASURES)} {tele}", "telemetry"),
        "check_required_columns": sql(
            f"SELECT count(*) AS rows, m.missing_column {tele} "
            "CROSS JOIN (VALUES ('usage_litres'), ('tank_level_litres')) m(missing_column) GROUP BY m.missing_column",
            "telemetry",
        ),
        "default_optional_columns": sql(
            f"SELECT {KEY}, {d('rainfall_mm', 'tank_capacity_litres')}, CAST(NULL AS DOUBLE) AS temperature_c {tele}", "telemetry"
        ),
        "write_table": sql(f"SELECT {KEY}, {d(*MEASURES)} {tele}", "telemetry"),
        "dataset_signature": sql(
            "SELECT tank_id, 'rows=' || count(*) || ';start=' || strftime(min(\"timestamp\"), '%Y-%m-%d %H:%M:%S') || ';end=' || "
            "strftime(max(\"timestamp\"), '%Y-%m-%d %H:%M:%S') || ';capacity=' || printf('%.4f', max(tank_capacity_litres)) AS signature "
            "FROM complete GROUP BY tank_id",
            "complete",
        ),
        "save_and_load_model": sql(f"SELECT {KEY}, TRUE AS \"same_RandomForest\", TRUE AS \"same_Ridge\" FROM complete", "complete"),
        # the test side begins at the moment four fifths of a run's rows are reached
        "reuse_or_retrain": sql(
            "SELECT * FROM (WITH runs AS (SELECT run, c.tank_id, c.\"timestamp\" AS t FROM complete c "
            "CROSS JOIN (VALUES ('same'), ('fewer'), ('fewer again')) r(run) WHERE run = 'same' OR c.tank_id % 2 = 0), "
            "placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM runs), "
            "cut AS (SELECT run, t AS begins FROM placed WHERE i = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) "
            "SELECT run, tank_id, count(*) AS test_hours, run <> 'fewer' AS reused FROM placed JOIN cut USING (run) WHERE t >= begins GROUP BY run, tank_id)",
            "complete",
        ),
        # cleaning
        "parse_timestamps": f"SELECT tank_id, \"timestamp\", ingest_seq FROM ({TEXT}) WHERE \"timestamp\" IS NOT NULL",
        "parse_timestamps_mixed": (
            f"SELECT event_id, {FILE_OF_EVENT}, CASE WHEN event_id % 41 <> 7 THEN date_trunc('second', ts) END AS \"timestamp\" FROM events"
        ),
        # the day-first file has days above 12 and so is certain; a word is a cell that nothing reads
        "time_layouts": (
            "SELECT source_file, count(*) AS cells, count(*) FILTER (event_id % 41 <> 7) AS reads, CASE source_file WHEN 'iso' THEN 'year_first' "
            "WHEN 'zoned' THEN 'year_first' WHEN 'month' THEN 'month_first' WHEN 'day' THEN 'day_first' WHEN 'name' THEN 'month_name' ELSE 'epoch' END AS layout "
            f"FROM (SELECT event_id, {FILE_OF_EVENT} FROM events) GROUP BY source_file"
        ),
        "sort_by_time": sql(f"SELECT {KEY}, {d('tank_level_litres')} {tele}", "telemetry"),
        "dedupe_keep_first": (
            f"SELECT {KEY}, {d(*MEASURES)}, ingest_seq FROM ({EVENT_READINGS}) "
            "QUALIFY row_number() OVER (PARTITION BY tank_id, \"timestamp\" ORDER BY ingest_seq) = 1"
        ),
        "first_over_files": (
            f"SELECT {KEY}, {d(*MEASURES)}, ingest_seq AS event_id FROM ({EVENT_READINGS}) "
            "QUALIFY row_number() OVER (PARTITION BY tank_id, \"timestamp\" ORDER BY ingest_seq % 7, ingest_seq) = 1"
        ),
        "coerce_numeric": (
            f"SELECT ingest_seq, {d('rainfall_mm', 'inflow_litres', 'usage_litres', 'tank_level_litres')}, "
            "CAST(CASE WHEN event_type IN ('click', 'purchase') AND props IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS coerced_cells "
            f"FROM ({TEXT})"
        ),
        "resolve_capacity": sql(
            "SELECT tank_id, round(CASE WHEN m > 0 THEN m ELSE 5000.0 END + "
            f"{NUDGE}, 6) AS capacity_value FROM (SELECT tank_id, quantile_cont(tank_level_litres, 0.5) AS m {tele} GROUP BY tank_id)",
            "telemetry",
        ),
        "clip_nonnegative": sql(
            f"SELECT {KEY}, {settled('rain_c', 'rainfall_mm')}, {settled('inflow_c', 'inflow_litres')}, "
            f"{settled('usage_c', 'usage_litres')} FROM clipped", "clipped",
        ),
        "flag_level_out_of_range": sql(f"SELECT {KEY}, {d('tank_level_litres')}, level_out_of_range FROM ranged", "ranged"),
        "flag_level_jump": sql(f"SELECT {KEY}, level_jump, level_was_outlier FROM flagged", "flagged"),
        "null_out_level_outliers": sql(
            f"SELECT {KEY}, {settled('level_z', 'tank_level_litres')}, {settled('inflow_n', 'inflow_litres')}, "
            f"{settled('usage_z', 'usage_litres')} FROM nulled", "nulled",
        ),
        "iqr_bounds": sql(
            f"SELECT tank_id, {settled('coalesce(a - 3.0 * (b - a), 0.0)', 'lower_fence')}, {settled('coalesce(b + 3.0 * (b - a), 0.0)', 'upper_fence')} "
            f"FROM (SELECT tank_id, quantile_cont(usage_litres, 0.25) AS a, quantile_cont(usage_litres, 0.75) AS b {tele} GROUP BY tank_id)",
            "telemetry",
        ),
        "zero_inflated_upper_fence": sql(f"SELECT tank_id, {d('inflow_fence')} FROM fences", "fences"),
        "flag_inflow_spike": sql(f"SELECT {KEY}, {settled('inflow_c', 'inflow_litres')}, inflow_was_outlier FROM flagged", "flagged"),
        "zscore_mask": sql(
            f"SELECT {KEY}, CASE WHEN n < 3 OR s = 0 THEN false ELSE coalesce(abs((usage_litres - m) / s) > 3.5, false) END AS is_extreme "
            "FROM telemetry JOIN (SELECT tank_id, count(usage_c) AS n, avg(usage_c) AS m, stddev_pop(usage_c) AS s FROM clipped GROUP BY tank_id) USING (tank_id)",
            "clipped",
        ),
        "flag_usage_spike": sql(f"SELECT {KEY}, {settled('usage_c', 'usage_litres')}, usage_was_outlier FROM flagged", "flagged"),
        "fill_rain_zero": sql(f"SELECT {KEY}, {settled('rain_f', 'rainfall_mm')} FROM nulled", "nulled"),
        "fill_inflow_zero_or_interpolate": sql(f"SELECT {KEY}, {settled(_filled('inflow_z', 'i'), 'inflow_litres')} FROM gaps", "gaps"),
        "time_interpolate": sql(
            f"SELECT {KEY}, " + ", ".join(
                settled(_filled(c, p), c) for c, p in (("tank_level_litres", "l"), ("temperature_c", "t"), ("usage_litres", "u"))
            ) + " FROM (" + _gap_step("telemetry", {"tank_level_litres": "l", "temperature_c": "t", "usage_litres": "u"}) + ")",
            "telemetry",
        ),
        "median_fallback": sql(f"SELECT {KEY}, {settled('0.0', 'temperature_c')} {tele}", "telemetry"),
        "clip_level_safety": sql(
            f"SELECT {KEY}, {settled('CASE WHEN tank_level_litres < 0 THEN 0.0 WHEN tank_level_litres > 5000.0 THEN 5000.0 ELSE tank_level_litres END', 'tank_level_litres')} {tele}",
            "telemetry",
        ),
        "drop_internal_columns": sql(f"SELECT {KEY}, {d(*NUMERIC)} {tele}", "telemetry"),
        "cleaning_report": sql(
            f"SELECT tank_id, {d('capacity', 'inflow_iqr_fence_litres')}, {n(*_REPORT_COUNTS)} FROM report", "report"
        ),
        "cleaning_report_dirty": (
            "SELECT tank_id, count(*) AS rows_raw, count(*) FILTER (event_type = 'error') AS bad_timestamps_dropped, "
            "count(DISTINCT \"timestamp\") AS rows_clean, "
            "count(*) FILTER (event_type IN ('click', 'purchase') AND props IS NOT NULL) AS non_numeric_coerced "
            f"FROM ({TEXT}) GROUP BY tank_id"
        ),
        "clean_telemetry": sql(f"SELECT {KEY}, {d(*NUMERIC)}, {', '.join(FLAGS)} FROM cleaned", "cleaned"),
        # features
        "calendar_features": sql(f"SELECT {KEY}, {n(*_CALENDAR)} FROM featured", "featured"),
        "fill_pct": sql(f"SELECT {KEY}, {settled(_low('tank_level_litres / tank_capacity_litres * 100.0'), 'fill_pct')} {tele}", "telemetry"),
        "net_flow_headroom": sql(f"SELECT {KEY}, {d('net_flow_litres', 'headroom_litres')} FROM featured", "featured"),
        "lag_features": sql(f"SELECT {KEY}, {d(*_LAGS)} FROM featured", "featured"),
        "delta_lag_1": sql(f"SELECT {KEY}, {d('delta_lag_1')} FROM featured", "featured"),
        "rolling_rain_sum": sql(
            f"SELECT {KEY}, {d('rain_roll_3', 'rain_roll_6', 'rain_roll_24')} FROM ({_feature_step('telemetry')})", "telemetry"
        ),
        "rolling_usage_mean": sql(
            f"SELECT {KEY}, {d('usage_roll_mean_6', 'usage_roll_mean_24')} FROM ({_feature_step('telemetry')})", "telemetry"
        ),
        "lead_target": sql(f"SELECT {KEY}, {d('target_level_next')} FROM featured", "featured"),
        "capacity_default": sql(
            f"SELECT {KEY}, {settled(_low('tank_level_litres / c * 100.0'), 'fill_pct')}, {settled('c - tank_level_litres', 'headroom_litres')} "
            f"FROM (SELECT *, first_value(tank_level_litres + 1000.0) OVER ({W}) AS c FROM cleaned)", "cleaned",
        ),
        "complete_cases": sql(f"SELECT {KEY}, {d(*_FEATURES, 'target_level_next')}, {n(*_CALENDAR)} FROM complete", "complete"),
        "live_features": sql(f"SELECT {KEY}, {d(*_FEATURES)}, {n(*_CALENDAR)} FROM live", "live"),
        "prepared_summary": sql(
            "SELECT tank_id, count(*) AS rows_raw, count(*) AS rows_clean, count(*) FILTER (ok) AS rows_model_ready, "
            "count(*) FILTER (NOT ok) AS rows_dropped_for_lags_or_target, CAST(29 AS BIGINT) AS final_feature_count, "
            f"min(\"timestamp\") AS date_min, max(\"timestamp\") AS date_max, '{', '.join(FEATURES)}' AS final_feature_list, "
            "'target_level_next' AS target FROM (SELECT *, level_lag_3 IS NOT NULL AND target_level_next IS NOT NULL AS ok FROM featured) GROUP BY tank_id",
            "featured",
        ),
        "preprocess": sql(
            f"SELECT {KEY}, {d('tank_level_litres', 'usage_roll_mean_24', 'target_level_next')}, {n('hour')} FROM complete", "complete"
        ),
        # split, baselines, metrics
        "chronological_split": sql(f"SELECT {KEY}, row_index, split FROM parts", "parts"),
        "split_summary": sql(
            "SELECT tank_id, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows, "
            + ", ".join(f"{f}(\"timestamp\") FILTER (split = '{p}') AS {p}_{e}" for p in ("train", "test") for e, f in (("start", "min"), ("end", "max")))
            + " FROM parts GROUP BY tank_id", "parts",
        ),
        "walk_forward_folds": sql(
            f"SELECT * FROM (SELECT {KEY}, CAST(fold AS BIGINT) AS fold, CASE WHEN i < a THEN 'train' WHEN i < a + t THEN 'validate' END AS role FROM ("
            f"SELECT {KEY}, fold, row_index - 1 AS i, m // 6 AS t, m - (6 - fold) * (m // 6) AS a FROM ("
            "SELECT *, count(*) OVER (PARTITION BY tank_id) AS m FROM parts WHERE split = 'train') CROSS JOIN range(1, 6) f(fold) WHERE m > 50)) "
            "WHERE role IS NOT NULL", "parts",
        ),
        # pooled over tanks: cut at the moment four fifths of the rows are reached, then five blocks of a sixth; exact solutions leave nothing
        "fold_normal_equations": sql(
            "SELECT * FROM (WITH r AS (SELECT \"timestamp\" AS t, row_number() OVER (ORDER BY \"timestamp\") - 1 AS i, count(*) OVER () AS n FROM complete), "
            "p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM r "
            "WHERE t < (SELECT t FROM r WHERE i = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT))), "
            "e AS (SELECT f.fold, min(p.t) AS begins FROM p CROSS JOIN range(1, 6) f(fold) WHERE p.i = p.n - (6 - f.fold) * (p.n // 6) GROUP BY 1), "
            "s AS (SELECT fold, begins, lead(begins) OVER (ORDER BY fold) AS ends FROM e) "
            f"SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (t < begins) AS train_rows, "
            f"count(*) FILTER (t >= begins AND (ends IS NULL OR t < ends)) AS valid_rows, {settled('0.0', 'residual')} FROM p CROSS JOIN s GROUP BY fold)",
            "complete",
        ),
        "persistence_baseline": sql(f"SELECT {KEY}, {settled('tank_level_litres', 'predicted')} FROM complete", "complete"),
        "physics_baseline": sql(f"SELECT {KEY}, {settled(_BASE, 'predicted')} FROM complete", "complete"),
        "baseline_predictions": sql(
            f"SELECT {KEY}, {settled('tank_level_litres', 'pred_persistence')}, "
            f"{settled('greatest(least(tank_level_litres + inflow_litres - usage_litres, tank_capacity_litres - 1e-9), 0.0)', 'pred_physics')} FROM cleaned",
            "cleaned",
        ),
        "regression_metrics": sql(f"SELECT model, {_METRICS} FROM predictions GROUP BY model", "predictions"),
        "evaluate_baselines": sql(
            "SELECT * EXCLUDE (raw_mae), raw_mae = min(raw_mae) OVER (PARTITION BY tank_id) AND (model = 'persistence' OR "
            "raw_mae < max(raw_mae) OVER (PARTITION BY tank_id)) AS is_best FROM ("
            f"SELECT tank_id, model, {_METRICS}, avg(abs(predicted - actual)) AS raw_mae FROM predictions GROUP BY tank_id, model)",
            "predictions",
        ),
        "delta_target": sql(f"SELECT {KEY}, {settled('target_level_next - tank_level_litres', 'delta')} FROM complete", "complete"),
        "recombine_prediction": sql(
            f"SELECT {KEY}, {settled('least(greatest(tank_level_litres + delta_lag_1 * 5.0, 0.0), tank_capacity_litres)', 'from_delta')}, "
            f"{settled('least(greatest(delta_lag_1 * 5.0, 0.0), tank_capacity_litres)', 'from_level')}, "
            f"{settled('delta_lag_1 * 5.0 - tank_level_litres', 'delta_of_level')} FROM complete", "complete",
        ),
        "overflow_warning_metrics": sql(
            f"SELECT model, {settled('threshold_litres')}, {settled(_PRECISION, 'precision')}, {settled(_RECALL, 'recall')}, {settled(_F1, 'f1')}, "
            "true_positives, false_positives, false_negatives, true_negatives, true_positives + false_negatives AS actual_positive, "
            f"true_positives + false_positives AS predicted_positive FROM ({_warning(0.6)})", "predictions",
        ),
        "baseline_leaderboard": sql(
            f"SELECT tank_id, model, {settled('mae')}, {settled('CASE WHEN b > 0 THEN (b - mae) / b * 100.0 ELSE 0.0 END', 'improvement_pct')}, "
            "best_model FROM (SELECT tank_id, model, avg(abs(predicted - actual)) AS mae FROM predictions GROUP BY tank_id, model) JOIN "
            "(SELECT tank_id, min(mae) AS b, CASE WHEN min(mae) FILTER (model = 'persistence') <= min(mae) FILTER (model = 'physics') THEN 'persistence' "
            "ELSE 'physics' END AS best_model FROM (SELECT tank_id, model, avg(abs(predicted - actual)) AS mae FROM predictions GROUP BY tank_id, model) GROUP BY tank_id) USING (tank_id)",
            "predictions",
        ),
        "scored_test_frame": sql(
            f"SELECT {KEY}, " + d(
                "current_level", "rainfall_mm", "inflow_litres", "usage_litres", "usage_roll_mean_24", "rain_roll_3", "rain_roll_24",
                "fill_pct", "actual_level", "pred_persistence", "pred_physics", "pred", "pred_fill_pct", "error",
            ) + " FROM scored", "scored",
        ),
        # rules, validation, faults
        "decide_action": sql(f"SELECT {KEY}, {_action('pred_fill_pct')} AS action FROM scored", "scored"),
        "decision_reason": sql(f"SELECT {KEY}, {_reason('pred_fill_pct')} AS reason FROM scored", "scored"),
        "validate_level": sql(
            f"SELECT {KEY}, coalesce(tank_level_litres BETWEEN 0 AND tank_capacity_litres, false) AS ok, CASE WHEN tank_level_litres IS NULL THEN "
            f"'Tank level must be a real number (got NaN/missing).' ELSE coalesce({_level_problem('tank_level_litres', 'tank_capacity_litres')}, "
            f"'Tank level is within physical limits.') END AS message {tele}", "telemetry",
        ),
        "validate_readings": sql(
            f"SELECT {KEY}, {_problems('tank_level_litres', 'r', 'i', 'u', 'tank_capacity_litres')} AS problems FROM (SELECT *, "
            f"coalesce(rainfall_mm, 0.0) AS r, coalesce(inflow_litres, 0.0) AS i, coalesce(usage_litres, 0.0) AS u {tele})", "telemetry",
        ),
        "latest_n_window": sql(f"SELECT {KEY}, {d('tank_level_litres')} FROM window8", "window8"),
        "fault_counters": sql(
            f"SELECT tank_id, {d('min_level', 'max_level')}, {n('checked_rows', 'missing_levels', 'negative_levels', 'over_levels', 'negative_inflows')} FROM faults",
            "faults",
        ),
        "longest_flat_run": """
SELECT tank_id, max(len) AS longest_run FROM (
  SELECT tank_id, g, count(*) AS len FROM (
    SELECT *, sum(b) OVER (PARTITION BY tank_id ORDER BY ts) AS g FROM (
      SELECT user_id AS tank_id, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS b FROM events))
  GROUP BY tank_id, g)
GROUP BY tank_id""",
        "detect_sensor_fault": sql(
            f"SELECT tank_id, {n('flatline_run', 'checked_rows')}, reasons <> '' AS fault, "
            "CASE WHEN reasons <> '' THEN reasons ELSE 'Sensors look healthy.' END AS message FROM checked", "checked",
        ),
        "physics_prediction": sql(
            f"SELECT {KEY}, {settled(f'greatest(least({_PHYS}, tank_capacity_litres), 0.0)', 'predicted')} FROM complete", "complete"
        ),
        "recommend_next_hour": sql(
            f"SELECT tank_id, {d('predicted_level', 'predicted_fill_pct', 'current_fill_pct')}, errors, action, reason, coalesce(used_fallback, false) AS used_fallback, fallback_reason FROM recommended",
            "recommended",
        ),
        "fallback_banner_text": sql(f"SELECT tank_id, {_BANNER} AS banner FROM recommended", "recommended"),
        # balance
        "catchment_inflow": sql(f"SELECT {KEY}, {settled('rainfall_mm * 150.0 * 0.85', 'inflow')} FROM cleaned", "cleaned"),
        "clamped_balance": sql(f"SELECT {KEY}, {d('level', 'overflow_litres')} FROM plain_balance", "plain_balance"),
        "clamped_balance_from_fraction": sql(
            f"SELECT {KEY}, {d('level', 'overflow_litres')} FROM plain_balance", "plain_balance",
            replace={"plain": _plain_walk("(tank_capacity_litres * 0.55)")},
        ),
        "controlled_balance": sql(f"SELECT {KEY}, scenario, action, {d(*_PASS)} FROM trajectory", "trajectory"),
        "shortage_flag": sql(f"SELECT {KEY}, scenario, is_shortage, is_overflow FROM trajectory", "trajectory"),
        "count_events": sql("SELECT tank_id, scenario, overflow_events, shortage_events FROM summary", "summary"),
        "balance_summary": sql(
            "SELECT tank_id, scenario, " + d(
                "overflow_litres", "unmet_demand_litres", "productive_extra_used_litres", "demand_restricted_litres", "final_level", "mean_level", "min_level"
            ) + ", " + n("overflow_hours", "shortage_hours", "overflow_events", "shortage_events", "hours") + " FROM summary", "summary",
        ),
        "impact_comparison": sql(
            f"SELECT n.tank_id, {settled('greatest(n.overflow_litres - w.overflow_litres, 0.0)', 'litres_saved_from_overflow')}, "
            f"{settled('CASE WHEN n.overflow_litres > 0 THEN (n.overflow_litres - w.overflow_litres) / n.overflow_litres * 100.0 ELSE 0.0 END', 'overflow_reduction_pct')}, "
            f"{settled('w.productive_extra_used_litres', 'water_used_productively_litres')}, {settled('w.demand_restricted_litres', 'litres_conserved_by_restricting_demand')}, "
            f"{settled('n.unmet_demand_litres - w.unmet_demand_litres', 'unmet_demand_avoided_litres')}, {settled('round_even(n.hours / 24.0, 1)', 'test_days')}, "
            "greatest(n.overflow_events - w.overflow_events, 0) AS overflow_events_avoided, greatest(n.shortage_events - w.shortage_events, 0) AS shortage_events_avoided, "
            f"n.hours AS test_hours {_PAIR}", "summary",
        ),
        "trajectory_compare": sql(
            f"SELECT {KEY}, {settled(chr(39).join(['max(level) FILTER (scenario = ', 'no_controller', ')']), 'level_no_controller')}, "
            f"{settled(chr(39).join(['max(level) FILTER (scenario = ', 'with_controller', ')']), 'level_with_controller')} FROM trajectory GROUP BY ALL",
            "trajectory",
        ),
        "simulated_actions": sql(
            "SELECT tank_id, action, count(*) AS hours, min(\"timestamp\") AS first_hour, max(\"timestamp\") AS last_hour FROM trajectory "
            "WHERE scenario = 'with_controller' GROUP BY tank_id, action", "trajectory",
        ),
        "missing_cells": sql(
            "SELECT count(*) AS rows, CAST(" + str(len(NUMERIC)) + " AS BIGINT) AS columns, CAST(sum(m) AS BIGINT) AS missing_cells, count(*) FILTER (m > 0) AS rows_with_missing "
            "FROM (SELECT " + " + ".join(f"({c} IS NULL)::INT" for c in NUMERIC) + " AS m FROM telemetry)", "telemetry",
        ),
        "cumulative_overflow": sql(
            f"SELECT {KEY}, scenario, {settled('sum(overflow_litres) OVER (PARTITION BY tank_id, scenario ORDER BY ' + chr(34) + 'timestamp' + chr(34) + ')', 'cumulative_overflow_litres')} FROM trajectory",
            "trajectory",
        ),
        # reports
        "null_profile": sql(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {settled(f'round(count(*) FILTER ({c} IS NULL) / count(*) * 100.0, 1)', 'pct')}, count(*) FILTER ({c} IS NULL) AS missing {tele}"
                for c in NUMERIC
            ), "telemetry",
        ),
        "duplicate_count": f"SELECT CAST(count(*) - count(DISTINCT (tank_id, \"timestamp\")) AS BIGINT) AS duplicate_rows FROM ({EVENT_READINGS})",
        "head_preview": sql(f"SELECT {KEY}, {d(*MEASURES)} {tele} ORDER BY telemetry.tank_id, telemetry.\"timestamp\" LIMIT 12", "telemetry"),
        "raw_level_series": sql(f"SELECT {KEY}, {d('tank_level_litres')} {tele} WHERE telemetry.tank_level_litres IS NOT NULL", "telemetry"),
        "raw_vs_clean_join": sql(
            f"SELECT r.tank_id, r.\"timestamp\", {settled('r.tank_level_litres', 'raw')}, {settled('c.tank_level_litres', 'cleaned')} "
            f"FROM ({EVENT_READINGS}) r JOIN cleaned c ON r.tank_id = c.tank_id AND r.\"timestamp\" = c.\"timestamp\" WHERE r.tank_level_litres IS NOT NULL", "cleaned",
        ),
        "missing_fixed_table": sql(
            " UNION ALL ".join(
                f"SELECT tank_id, '{c}' AS column_name, CAST(missing_before_{c} AS BIGINT) AS missing_before, CAST(missing_filled_{c} AS BIGINT) AS filled, "
                f"CAST(missing_after_{c} AS BIGINT) AS still_missing FROM report" for c in NUMERIC
            ), "report",
        ),
        "outlier_table": sql(
            " UNION ALL ".join(f"SELECT tank_id, '{c}' AS issue, {settled(_outlier(c), 'count')} FROM report" for c in _OUTLIERS), "report"
        ),
        "flagged_rows": sql(f"SELECT {KEY}, {', '.join(FLAGS)} FROM cleaned WHERE {' OR '.join(FLAGS)}", "cleaned"),
        "baseline_table": sql(f"SELECT model, {_METRICS} FROM predictions GROUP BY model ORDER BY 2", "predictions"),
        "residual_histogram": sql(
            f"SELECT {settled('lo + (hi - lo) / 24 * (bin - 1)', 'low_edge')}, {settled('lo + (hi - lo) / 24 * bin', 'high_edge')}, CAST(bin AS BIGINT) AS bin, "
            "CAST(coalesce(c, 0) AS BIGINT) AS errors FROM (SELECT min(error) AS lo, max(error) AS hi FROM scored) CROSS JOIN range(1, 25) r(bin) LEFT JOIN ("
            "SELECT least(CAST(floor((error - lo) / ((hi - lo) / 24)) AS BIGINT) + 1, 24) AS b, count(*) AS c FROM scored, "
            "(SELECT min(error) AS lo, max(error) AS hi FROM scored) GROUP BY 1) ON b = bin", "scored",
        ),
        "error_summary": sql(
            f"SELECT {settled('avg(abs(error))', 'mae')}, {settled('sqrt(avg(error * error))', 'rmse')}, "
            f"{settled('1.0 - sum(error * error) / (var_pop(actual_level) * count(*))', 'r2')}, {settled('avg(error)', 'mean_error')}, "
            f"{settled('quantile_cont(abs(error), 0.95)', 'p95_abs_error')} FROM scored", "scored",
        ),
        "seeded_sample": sql(
            f"SELECT {KEY}, {settled('actual_level', 'actual_level')}, {settled('pred', 'pred')} FROM (SELECT * FROM scored "
            "ORDER BY md5('0|' || tank_id || '|' || epoch_us(\"timestamp\")), tank_id, \"timestamp\" LIMIT 1500)", "scored",
        ),
        "worst_misses": sql(
            f"SELECT {KEY}, " + ", ".join(settled(f"round({c} + 1e-9, 1)", c) for c in ("current_level", "actual_level", "pred", "error"))
            + " FROM (SELECT * FROM scored ORDER BY abs(error) DESC, tank_id, \"timestamp\" LIMIT 8)", "scored",
        ),
        "overflow_table": sql(
            f"SELECT model, {settled(_PRECISION, 'precision')}, {settled(_RECALL, 'recall')}, {settled(_F1, 'f1')}, false_negatives AS missed_overflows, "
            f"false_positives AS false_alarms, true_positives + false_negatives AS true_overflow_hours FROM ({_warning(0.9)})", "predictions",
        ),
        "action_counts": sql(f"SELECT {_action('pred_fill_pct')} AS action, count(*) AS hours FROM scored GROUP BY 1", "scored"),
        "fill_timeline": sql(
            f"SELECT {KEY}, {d('pred_fill_pct', 'rain_roll_24')}, {settled('90.0', 'overflow_line')}, {settled('30.0', 'reserve_line')} FROM scored", "scored"
        ),
        "recent_decisions": sql(
            f"SELECT {KEY}, " + ", ".join(settled(f"round({c} + 1e-9, 2)", c) for c in ("pred_fill_pct", "rain_roll_3", "rain_roll_24"))
            + f", {_action('pred_fill_pct')} AS action FROM (SELECT *, {_NEWEST} AS age FROM scored) WHERE age <= 10", "scored",
        ),
        "latest_decision": sql(
            f"SELECT {KEY}, {d('pred_fill_pct')}, {_action('pred_fill_pct')} AS action, {_reason('pred_fill_pct')} AS reason "
            f"FROM (SELECT *, {_NEWEST} AS age FROM scored) WHERE age = 1", "scored",
        ),
        "impact_table": sql(
            " UNION ALL ".join(
                f"SELECT n.tank_id, '{label}' AS metric, {settled(f'round(CAST(n.{c} AS DOUBLE) + 1e-9, 1)', 'no_controller')}, "
                f"{settled(f'round(CAST(w.{c} AS DOUBLE) + 1e-9, 1)', 'with_controller')} {_PAIR}" for label, c in _IMPACT.items()
            ), "summary",
        ),
        "live_comparison": sql(
            "SELECT tank_id, line, round(value + " + str(NUDGE) + ", 6) AS value FROM (SELECT r.tank_id, unnest(['prediction', 'persistence baseline (current level)', 'physics baseline', 'overflow line (90%)', 'reserve line (30%)']) AS line, "
            "unnest([predicted_level, m.tank_level_litres, least(greatest(m.tank_level_litres + m.inflow_litres - u.mean, 0.0), m.tank_capacity_litres), 0.9 * m.tank_capacity_litres, 0.3 * m.tank_capacity_litres]) AS value "
            f"FROM recommended r JOIN now_rows m USING (tank_id) JOIN (SELECT tank_id, avg(usage_litres) AS mean FROM (SELECT *, {_NEWEST} AS age FROM cleaned) WHERE age <= 24 GROUP BY tank_id) u USING (tank_id) WHERE r.errors = '')",
            "recommended", "now_rows",
        ),
        "dataset_totals": sql(
            f"SELECT {settled('sum(rainfall_mm)', 'total_rainfall')}, {settled('sum(inflow_litres)', 'total_inflow')}, {settled('sum(usage_litres)', 'total_demand')}, "
            f"{settled('(SELECT sum(overflow_litres) FROM plain_balance)', 'overflow_litres')}, count(*) AS rows, CAST("
            + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in MEASURES)
            + f" AS BIGINT) AS missing_values, CAST(0 AS BIGINT) AS duplicate_rows, min(\"timestamp\") AS date_min, max(\"timestamp\") AS date_max {tele}",
            "plain_balance",
        ),
        # one long series
        "long_series_clean": sql(f"SELECT \"timestamp\", {d(*NUMERIC)}, {', '.join(FLAGS)} FROM cleaned", "cleaned", **long_),
        "long_series_features": sql(f"SELECT \"timestamp\", {d(*_FEATURES, 'target_level_next')}, {n(*_CALENDAR)} FROM complete", "complete", **long_),
        "long_series_split": sql(
            f"SELECT \"timestamp\", i AS row_index, CASE WHEN i <= floor(m * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ("
            f"SELECT *, row_number() OVER ({W}) AS i, count(*) OVER () AS m FROM cleaned)", "cleaned", **long_,
        ),
        "long_series_balance": sql(f"SELECT \"timestamp\", {d('level', 'overflow_litres')} FROM plain_balance", "plain_balance", **long_),
        "long_series_runs": sql(
            "SELECT tank_id, count(*) FILTER (wet) AS wet_spells, max(len) AS longest_run FROM (SELECT tank_id, wet, g, count(*) AS len FROM ("
            "SELECT *, sum(b) OVER (ORDER BY \"timestamp\") AS g FROM (SELECT tank_id, \"timestamp\", rainfall_mm > 0 AS wet, "
            "CASE WHEN (rainfall_mm > 0) = lag(rainfall_mm > 0) OVER (ORDER BY \"timestamp\") THEN 0 ELSE 1 END AS b FROM cleaned)) GROUP BY ALL) GROUP BY tank_id",
            "cleaned", **long_,
        ),
        "exact_quantiles_whole_table": "SELECT event_type, " + ", ".join(
            settled(f"quantile_cont(value - 50.0, {p})", name) for name, p in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
        ) + " FROM events GROUP BY event_type",
        # streams
        "stream_ingest_clean": sql(
            f"SELECT {KEY}, {settled('rain_f', 'rainfall_mm')}, {settled('inflow_z', 'inflow_litres')}, {settled('usage_z', 'usage_litres')}, "
            f"{settled('level_in_range', 'tank_level_litres')}, level_out_of_range, inflow_was_outlier, usage_was_outlier FROM nulled", "nulled",
        ),
        "stream_dedupe": "SELECT DISTINCT user_id AS tank_id, date_trunc('hour', ts) AS \"timestamp\" FROM events",
        "stream_hourly_rollup": (
            f"SELECT {KEY}, {d('rainfall_mm', 'inflow_litres', 'usage_litres', 'tank_level_litres', 'temperature_c')}, events FROM ({TELEMETRY}) JOIN "
            "(SELECT user_id AS tank_id, date_trunc('hour', ts) AS \"timestamp\", count(*) AS events FROM events GROUP BY 1, 2) USING (tank_id, \"timestamp\")"
        ),
        "stream_live_decisions": sql(
            f"SELECT {KEY}, {settled('p', 'predicted_level')}, {settled('p / tank_capacity_litres * 100.0', 'predicted_fill_pct')}, "
            f"fault AS used_fallback, {_action('p / tank_capacity_litres * 100.0')} AS action FROM (SELECT *, "
            "CASE WHEN fault THEN greatest(least(tank_level_litres + inflow_litres - usage_roll_mean_24, tank_capacity_litres), 0.0) ELSE tank_level_litres END AS p "
            "FROM (SELECT *, rn = 1 OR list_max(list_transform(range(0, 8), lambda i: len(list_filter(list_grade, lambda g: g = list_grade[i + 1])))) >= 6 AS fault "
            "FROM (SELECT *, row_number() OVER s AS rn, list(run_id) OVER (s ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS list_grade FROM ("
            "SELECT *, sum(b) OVER s AS run_id FROM (SELECT *, CASE WHEN tank_level_litres = level_lag_1 THEN 0 ELSE 1 END AS b FROM featured) "
            f"WINDOW s AS ({W})) WINDOW s AS ({W}))))",
            "featured",
        ),
        "stream_balance": sql(f"SELECT {KEY}, {d('level', 'overflow_litres')} FROM plain_balance", "plain_balance"),
        # a tank whose only reading has the newest hour of all still waits for one that is newer
        "stream_missed_readings": sql(
            "SELECT tank_id, count(*) FILTER (t < newest) AS late, count(*) FILTER (t = newest) AS repeated FROM ("
            "SELECT tank_id, \"timestamp\" AS t, max(\"timestamp\") OVER w AS newest, count(*) OVER w AS n, "
            "max(\"timestamp\") OVER () AS latest FROM cleaned WINDOW w AS (PARTITION BY tank_id)) "
            "WHERE (n > 1 OR t < latest) AND (day(t) + hour(t)) % 3 = 0 GROUP BY tank_id",
            "cleaned",
        ),
    }
    return out
