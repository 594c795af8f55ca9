"""The registered queries as DuckDB SQL over the same tables, written apart from the Spark code."""

from __future__ import annotations

from ampflow.plans.fixture import DURATIONS, SALT, TELEMETRY_SQL, TRIPS

# Written out here, so that a mistake in the library's own lists shows.
TRACK_POINTS = 50
CRITICAL_COLUMNS = ("battery_soc_pct", "battery_voltage_v", "gps_lat", "gps_lon")
COLUMNS = (
    "device_id", "imei_token", "last_ping_time", "device_status", "gps_lat", "gps_lon", "gps_speed_kmh", "gps_delta_km", "gps_total_km",
    "battery_state", "battery_soc_pct", "battery_capacity_ah", "battery_usable_ah", "capacity_discharge_ah", "capacity_charge_ah",
    "battery_voltage_v", "cell_voltage_min", "cell_voltage_max", "battery_temp_c", "battery_soh_pct", "ts",
)
NUMERIC_COLUMNS = (
    "gps_lat", "gps_lon", "gps_speed_kmh", "gps_delta_km", "gps_total_km", "battery_soc_pct", "battery_capacity_ah", "battery_usable_ah",
    "capacity_discharge_ah", "capacity_charge_ah", "battery_voltage_v", "cell_voltage_min", "cell_voltage_max", "battery_temp_c", "battery_soh_pct",
)
FEATURES = (
    "discharge_rate_wh", "soc_delta_5min", "cell_imbalance", "temp_deviation", "soh_adjusted_cap", "charge_headroom", "speed_x_soc",
    "rolling_soc_std_1h", "rolling_speed_mean_5min", "rolling_temp_std_1h", "rolling_voltage_std_1h", "rolling_imbalance_mean_5min", "idle_drain",
)

D = DURATIONS
BY = "PARTITION BY device_id ORDER BY us"
HAVERSINE = (
    "CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin((radians({c}) - radians({a})) / 2) ** 2"
    " + cos(radians({a})) * cos(radians({c})) * sin((radians({d}) - radians({b})) / 2) ** 2))) END"
)

GAPS = f"g AS (SELECT *, (us - lag(us) OVER ({BY})) / 1e6 AS gap_sec, cell_voltage_max - cell_voltage_min AS cell_imbalance FROM t)"
DELTAS = f"""d0 AS (
  SELECT *, lag(gps_lat) OVER ({BY}) AS prev_lat, lag(gps_lon) OVER ({BY}) AS prev_lon, lag(ts) OVER ({BY}) AS prev_ts,
         row_number() OVER ({BY}) AS rn
  FROM t
), d AS (
  SELECT *, {HAVERSINE.format(a="prev_lat", b="prev_lon", c="gps_lat", d="gps_lon")} AS km,
         (us - epoch_us(prev_ts)) / 1e6 AS sec
  FROM d0
), f0 AS (
  SELECT *, coalesce(km > 1 AND sec < {D.jump / 1e6}, false) AS jump, coalesce(gps_lat = 0 AND gps_lon = 0, false) AS dropout,
         coalesce(gps_lat = prev_lat AND gps_lon = prev_lon AND gps_speed_kmh > 2, false) AS same
  FROM d
), f1 AS (
  SELECT *, rn - max(CASE WHEN NOT same THEN rn END) OVER ({BY}) AS run FROM f0
), f AS (
  SELECT *, same AND run >= 2 AS frozen FROM f1
)"""
SEGMENTS = f"""s0 AS (
  SELECT *, CASE WHEN battery_state = 'Charging' THEN 'Charging' ELSE coalesce(device_status, 'Inactive') END AS state FROM t
), s1 AS (
  SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER ({BY}) THEN 1 ELSE 0 END AS change FROM s0
), s2 AS (SELECT *, sum(change) OVER ({BY}) AS segment FROM s1), s AS (
  SELECT device_id, segment::BIGINT AS segment, min(state) AS state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n
  FROM s2 GROUP BY device_id, segment
)"""
STOPS = f"""p0 AS (
  SELECT *, coalesce(greatest((us - lag(us) OVER ({BY})) / 1e6, 0), 0) AS dt, coalesce(gps_speed_kmh, 0) <= 0 AS still,
         row_number() OVER ({BY}) AS rn
  FROM t
), p1 AS (SELECT *, coalesce(max(CASE WHEN NOT still THEN rn END) OVER ({BY}), 0) AS since FROM p0), p AS (
  SELECT *, CASE WHEN still THEN sum(CASE WHEN still THEN dt ELSE 0 END) OVER (PARTITION BY device_id, since ORDER BY us)
            ELSE 0 END AS stop_sec
  FROM p1
)"""
# A recursive walk over each device's rows, so that trips are found another way than by windows.
TRIP_ROWS = f"""{STOPS}, v AS (
  SELECT *, coalesce(gps_speed_kmh > 2 AND battery_state = 'Discharging' AND device_status = 'Active', false) AS opens,
         battery_state = 'Charging' OR stop_sec >= {TRIPS.stop_us / 1e6} AS closes
  FROM p
), walk AS (
  SELECT device_id, rn, opens AS inside, opens AS member, CASE WHEN opens THEN 1 ELSE 0 END AS seq FROM v WHERE rn = 1
  UNION ALL
  SELECT v.device_id, v.rn, CASE WHEN w.inside THEN NOT v.closes ELSE v.opens END, w.inside OR v.opens,
         w.seq + CASE WHEN NOT w.inside AND v.opens THEN 1 ELSE 0 END
  FROM walk w JOIN v ON v.device_id = w.device_id AND v.rn = w.rn + 1
), l AS (
  SELECT v.*, CASE WHEN w.member THEN w.seq END AS seq, w.member AND v.closes AND NOT v.opens AS ended
  FROM v JOIN walk w USING (device_id, rn)
)"""
TRIPS_SQL = f"""{TRIP_ROWS}, k0 AS (
  SELECT device_id, seq, min(ts) AS start_ts, max(ts) AS end_ts, sum(coalesce(gps_delta_km, 0)) AS distance_km,
         avg(gps_speed_kmh) AS avg_speed_kmh,
         greatest(arg_min(battery_soc_pct, us) - arg_max(battery_soc_pct, us), 0)
           * quantile_cont(battery_usable_ah, 0.5) * quantile_cont(battery_voltage_v, 0.5) * 10 AS energy_consumed_wh,
         arg_min(gps_lat, us) AS start_lat, arg_min(gps_lon, us) AS start_lon,
         arg_max(gps_lat, us) AS end_lat, arg_max(gps_lon, us) AS end_lon
  FROM l WHERE seq IS NOT NULL GROUP BY device_id, seq HAVING bool_or(ended)
), k AS (
  SELECT device_id, device_id || '_' || row_number() OVER (PARTITION BY device_id ORDER BY seq) AS trip_id, * EXCLUDE (device_id, seq)
  FROM k0 WHERE distance_km >= {TRIPS.least_km}
)"""
TRACKS = f"""{TRIPS_SQL}, m0 AS (
  SELECT t.device_id, trip_id, us, gps_lat, gps_lon, lag(gps_lat) OVER w AS plat, lag(gps_lon) OVER w AS plon
  FROM t JOIN k ON t.device_id = k.device_id AND t.ts BETWEEN k.start_ts AND k.end_ts
  WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL WINDOW w AS (PARTITION BY trip_id ORDER BY us)
), m1 AS (
  SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY trip_id) AS n
  FROM m0 WHERE plat IS NULL OR plat <> gps_lat OR plon <> gps_lon
), m2 AS (
  SELECT * FROM m1 WHERE n <= {TRACK_POINTS}
     OR i IN (SELECT round_even(j * (n - 1) / {TRACK_POINTS - 1}::DOUBLE, 0) FROM range({TRACK_POINTS}) r(j))
), m3 AS (
  SELECT *, lag(gps_lat) OVER w AS a, lag(gps_lon) OVER w AS b FROM m2 WINDOW w AS (PARTITION BY trip_id ORDER BY us)
), tracks AS (
  SELECT device_id, trip_id, count(*)::INTEGER AS n_points,
         coalesce(sum({HAVERSINE.format(a="a", b="b", c="gps_lat", d="gps_lon")}), 0) AS raw_gps_km
  FROM m3 GROUP BY device_id, trip_id
)"""
ENERGY = f"""h0 AS (
  SELECT t.*, t.battery_soc_pct - r.battery_soc_pct AS soc_delta_5min, t.cell_voltage_max - t.cell_voltage_min AS cell_imbalance,
         t.us - r.us AS back
  FROM t ASOF LEFT JOIN t r ON t.device_id = r.device_id AND t.us - {D.lag} >= r.us
), h AS (SELECT *, soc_delta_5min * battery_usable_ah * battery_voltage_v * 10 AS discharge_rate_wh FROM h0)"""


def _rolled(agg: str, value: str, width: int, least: int) -> str:
    frame = f"({BY} RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {frame} >= {least} THEN {agg}({value}) OVER {frame} END"


ROLLED = {
    "rolling_temp_mean_7d": _rolled("avg", "battery_temp_c", D.long, 10),
    "rolling_soc_std_1h": _rolled("stddev_samp", "battery_soc_pct", D.medium, 10),
    "rolling_speed_mean_5min": _rolled("avg", "gps_speed_kmh", D.short, 3),
    "rolling_temp_std_1h": _rolled("stddev_samp", "battery_temp_c", D.medium, 10),
    "rolling_voltage_std_1h": _rolled("stddev_samp", "battery_voltage_v", D.medium, 10),
    "rolling_imbalance_mean_5min": _rolled("avg", "cell_imbalance", D.short, 3),
}
AHEAD = f"""a AS (
  SELECT t.*, r.battery_soc_pct AS target FROM t ASOF LEFT JOIN t r ON t.device_id = r.device_id AND t.us + {D.horizon} <= r.us
)"""
SOC = f"""{ENERGY}, r AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in ROLLED.items())} FROM h), {AHEAD}, soc AS (
  SELECT r.device_id, r.ts, r.us, discharge_rate_wh, soc_delta_5min, cell_imbalance,
         r.battery_temp_c - rolling_temp_mean_7d AS temp_deviation, r.battery_usable_ah * r.battery_soh_pct / 100 AS soh_adjusted_cap,
         r.capacity_charge_ah / r.battery_usable_ah AS charge_headroom, r.gps_speed_kmh * r.battery_soc_pct AS speed_x_soc,
         {", ".join(n for n in ROLLED if n in FEATURES)},
         CASE WHEN coalesce(r.gps_speed_kmh, 0) <= 0 THEN discharge_rate_wh ELSE 0 END AS idle_drain,
         target AS target_soc_t_plus_10min
  FROM r JOIN a USING (device_id, us) WHERE target IS NOT NULL
)"""
SEQUENCES = f"""{SOC}, q0 AS (
  SELECT device_id, ts, us, target_soc_t_plus_10min, {" + ".join(f"coalesce({c}, 0)" for c in FEATURES)} AS one,
         coalesce(cell_imbalance, 0) AS imbalance,
         row_number() OVER ({BY}) AS rn
  FROM soc
), q AS (
  SELECT *, sum(one) OVER w AS total, string_agg(round(imbalance, 6)::VARCHAR, ',') OVER w AS imbalances
  FROM q0 WINDOW w AS ({BY} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
)"""
SPLIT = f"""x0 AS (SELECT *, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n FROM {{of}}), x AS (
  SELECT *, (us >= max(CASE WHEN i = 4 * (n - 1) // 5 THEN us END) OVER (PARTITION BY device_id))::INTEGER AS is_test FROM x0
)"""
ANOMALY = f"""{ENERGY}, n0 AS (
  SELECT *, {_rolled("avg", "abs(discharge_rate_wh)", D.medium, 5)} AS mean_abs, {_rolled("max", "battery_soh_pct", D.long, 10)} AS soh_max,
         coalesce(abs(battery_soc_pct - lag(battery_soc_pct) OVER ({BY})), 0) AS step
  FROM h
), n AS (SELECT *, least(100, step * 0.3::DOUBLE + 12.5::DOUBLE) AS base FROM n0)"""
HISTOGRAM = """c AS (SELECT {keys} greatest(quantile_cont(v, 0.99), {floor}) AS cap FROM vals WHERE v IS NOT NULL {group}),
i AS (SELECT vals.* FROM vals JOIN c ON {same} WHERE v <= cap),
b AS (SELECT {keys} min(v) AS low, max(v) AS high FROM i {group}),
z AS (SELECT i.*, low, high, least(CASE WHEN high > low THEN floor((v - low) / (high - low) * {bins}) ELSE {bins} // 2 END, {bins} - 1)::INTEGER AS bin
      FROM i JOIN b ON {join})
SELECT {out} bin, count(*) AS n, round(min(low), 6) AS low, round(min(high), 6) AS high FROM z GROUP BY ALL"""


def _rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split()[0]}, {digits}) AS {c.split()[-1]}" for c in columns.split(", "))


def _t(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{TELEMETRY_SQL}{', ' if not body.startswith('SELECT') else ' '}{body}"


def _gps_columns() -> str:
    return _rounded("prev_lat, prev_lon") + ", prev_ts, " + _rounded("km delta_km_haversine, sec delta_sec")


def _corr() -> str:
    battery = [c for c in NUMERIC_COLUMNS if not c.startswith("gps")]
    pair = "SELECT '{a}' AS battery_column, '{b}' AS gps_column, {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM t"
    pairs = " UNION ALL ".join(pair.format(a=a, b=b) for a in battery for b in NUMERIC_COLUMNS if b.startswith("gps"))
    return (
        f"SELECT battery_column, gps_column, CASE WHEN min(a) = max(a) OR min(b) = max(b) THEN NULL ELSE round(corr(a, b), 6) END AS corr"
        f" FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL"
    )


def _null_rates() -> str:
    names = [*COLUMNS, "cell_imbalance", "gap_sec"]
    parts = [f"SELECT '{c}' AS \"column\", round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct FROM g" for c in names]
    return f"{GAPS}, rates AS ({' UNION ALL '.join(parts)})"


def _checks() -> str:
    checks = {
        "soc_out_of_range": "battery_soc_pct NOT BETWEEN 0 AND 100",
        "soh_out_of_range": "battery_soh_pct NOT BETWEEN 0 AND 100",
        "cell_voltage_out_of_range": "cell_voltage_min < 2.5 OR cell_voltage_max > 4.2",
        "lat_out_of_range": "gps_lat NOT BETWEEN -90 AND 90",
        "lon_out_of_range": "gps_lon NOT BETWEEN -180 AND 180",
        "negative_speed": "gps_speed_kmh < 0",
        "negative_delta": "gps_delta_km < 0",
        "negative_total": "gps_total_km < 0",
        "pack_voltage_not_positive": "battery_voltage_v <= 0",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({v}) AS n_rows FROM t" for k, v in checks.items())


def _kalman() -> str:
    """The recursion as a recursive query over numbered rows."""
    step = "CASE WHEN {z} IS NULL THEN {x} ELSE {x} + ({p} + 1e-6) / ({p} + 1e-6 + 1e-4) * ({z} - {x}) END"
    var = "CASE WHEN {z} IS NULL THEN {p} + 1e-6 ELSE ({p} + 1e-6) * (1 - ({p} + 1e-6) / ({p} + 1e-6 + 1e-4)) END"
    row = ", ".join(
        f.format(x=f"b.x{i}", p=f"b.p{i}", z=f"o.gps_{c}") + f" AS {name}{i}"
        for i, c in ((1, "lat"), (2, "lon"))
        for f, name in ((step, "x"), (var, "p"))
    )
    return f"""o AS (SELECT *, row_number() OVER ({BY}) AS rn FROM t), st AS (
  SELECT device_id, coalesce(arg_min(gps_lat, us) FILTER (gps_lon IS NOT NULL), arg_min(gps_lat, us), 0) AS x1,
         coalesce(arg_min(gps_lon, us) FILTER (gps_lat IS NOT NULL), arg_min(gps_lon, us), 0) AS x2
  FROM t GROUP BY device_id
), kal AS (
  SELECT device_id, 0::BIGINT AS rn, x1, 1.0::DOUBLE AS p1, x2, 1.0::DOUBLE AS p2 FROM st
  UNION ALL
  SELECT b.device_id, o.rn, {row} FROM kal b JOIN o ON o.device_id = b.device_id AND o.rn = b.rn + 1
)
SELECT device_id, ts, round(x1, 6) AS gps_lat_smooth, round(x2, 6) AS gps_lon_smooth FROM kal JOIN o USING (device_id, rn)"""


def _folds() -> str:
    return f"""i AS (SELECT device_id, ts, row_number() OVER ({BY}) AS i, count(*) OVER (PARTITION BY device_id) AS m FROM t),
c1 AS (SELECT *, fold::INTEGER AS f, greatest(least((fold + 1) * m // 4, m - 2), 1) AS c1 FROM i, range(3) r(fold) WHERE m >= 5),
c2 AS (SELECT *, greatest(least((f + 2) * m // 4, m - 1), c1 + 1) AS c2 FROM c1)
SELECT f AS fold, CASE WHEN i <= c1 THEN 'train' ELSE 'valid' END AS role, device_id, ts FROM c2 WHERE i <= c2"""


def _scaled() -> str:
    med = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS {c}" for c in FEATURES)
    filled = ", ".join(f"coalesce(x.{c}, med.{c}) AS {c}" for c in FEATURES)
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_d" for c in FEATURES)
    out = ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_d = 0 THEN 1 ELSE {c}_d END, 6) AS {c}" for c in FEATURES)
    return (
        f"{SOC}, {SPLIT.format(of='soc')}, med AS (SELECT {med} FROM x WHERE is_test = 0),"
        f" fil AS (SELECT x.device_id, x.ts, x.is_test, {filled} FROM x, med),"
        f" st AS (SELECT {stats} FROM fil WHERE is_test = 0) SELECT device_id, ts, {out} FROM fil, st"
    )


def _bms() -> str:
    rules = [
        ("cell_imbalance_high", "cell_imbalance > 0.05", "0"),
        ("soh_drop_7d", "soh_max - battery_soh_pct > 1", "least(25, base)"),
        (
            "discharge_spike_vs_rolling",
            "mean_abs > 0 AND abs(discharge_rate_wh) > 3 * mean_abs",
            "greatest(base, greatest(0, least((abs(discharge_rate_wh) / mean_abs - 1) * 100, 100)))",
        ),
        ("temperature_spike", "battery_temp_c > 40", "least(50, base)"),
    ]
    one = (
        "SELECT device_id, ts, '{0}' AS anomaly_type, 0.5::DOUBLE AS confidence_score,"
        " round(({2})::DOUBLE, 2) AS carbon_credit_impact_pct FROM n WHERE {1}"
    )
    return f"{ANOMALY} " + " UNION ALL ".join(one.format(*r) for r in rules)


def _ingested() -> str:
    """What the messages hold: every value once through JSON, times in whole milliseconds."""
    hashed = {"device_id": f"sha256(device_id || '{SALT}')", "imei_token": f"sha256(imei_token || '{SALT}')"}
    time = "make_timestamp(us // 1000 * 1000)"
    return "SELECT " + ", ".join(
        f"{hashed[c]} AS {c}" if c in hashed else f"{time} AS {c}" if c in ("ts", "last_ping_time") else f"round({c}, 6) AS {c}"
        if c in NUMERIC_COLUMNS else c
        for c in COLUMNS
    ) + " FROM t"


def oracle_sql() -> dict[str, str]:
    trip_columns = (
        "device_id, trip_id, start_ts, end_ts, "
        + _rounded("distance_km, avg_speed_kmh, energy_consumed_wh, start_lat, start_lon, end_lat, end_lon")
    )
    flag = "count(*) FILTER ({0}) AS {1}, round(100.0::DOUBLE * count(*) FILTER ({0}) / count(*), 3) AS {1}_rate_pct"
    names = (("jump", "position_jump"), ("dropout", "signal_dropout"), ("frozen", "coordinate_freeze"))
    soc_columns = ", ".join(f"round({c}, 6) AS {c}" for c in (*FEATURES, "target_soc_t_plus_10min"))
    located = "gps_lat IS NOT NULL AND gps_lon IS NOT NULL"
    return {
        "json_extract": _t(_ingested()),
        "pseudonymise": _t(f"SELECT DISTINCT sha256(device_id || '{SALT}') AS token FROM t"),
        "ping_gaps": _t(f"{GAPS} SELECT device_id, ts, round(gap_sec, 6) AS gap_sec FROM g"),
        "dq_overview": _t("SELECT count(*) AS n_rows, count(DISTINCT device_id) AS n_devices FROM t"),
        "dq_null_rates": _t(f"{_null_rates()} SELECT * FROM rates"),
        "dq_critical_nulls": _t(
            f"{_null_rates()} SELECT * FROM rates WHERE null_pct > 1 AND \"column\" IN ({', '.join(repr(c) for c in CRITICAL_COLUMNS)})"
        ),
        "dq_exact_dupes": _t(
            "SELECT ((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT device_id, battery_soc_pct, gps_lat FROM t)))::BIGINT AS n_exact_duplicates"
        ),
        "dq_near_dupes": _t(f"{GAPS} SELECT count(*) FILTER (gap_sec <= {D.near_duplicate / 1e6}) AS n_near_duplicates FROM g"),
        "dq_out_of_range": _t(_checks()),
        "delayed_devices": _t(
            f"{GAPS} SELECT device_id, count(*) AS n_rows, count(*) FILTER (gap_sec > {D.delayed / 1e6}) AS n_delayed,"
            f" round(count(*) FILTER (gap_sec > {D.delayed / 1e6}) / count(*), 6) AS delayed_ratio FROM g GROUP BY device_id HAVING delayed_ratio > 0.1"
        ),
        "gap_histogram": _t(
            f"{GAPS}, vals AS (SELECT device_id, gap_sec AS v FROM g WHERE gap_sec IS NOT NULL), "
            + HISTOGRAM.format(keys="device_id,", group="GROUP BY device_id", floor="1", bins=40, same="vals.device_id = c.device_id",
                               join="i.device_id = b.device_id", out="device_id,")
        ),
        "imbalance_histogram": _t(
            "vals AS (SELECT cell_voltage_max - cell_voltage_min AS v FROM t), "
            + HISTOGRAM.format(keys="", group="", floor="0.01", bins=50, same="true", join="true", out="")
        ),
        "figure_pages": _t(
            "n AS (SELECT device_id, count(*) AS n FROM t GROUP BY device_id)"
            " SELECT device_id, n, ((row_number() OVER (ORDER BY n DESC, device_id) - 1) // 9)::INTEGER AS page FROM n"
        ),
        "soc_quantiles": _t(
            "SELECT battery_state, count(*) AS n, quantile_cont(battery_soc_pct, 0.25) AS q25, quantile_cont(battery_soc_pct, 0.5) AS q50,"
            " quantile_cont(battery_soc_pct, 0.75) AS q75 FROM t GROUP BY battery_state"
        ),
        "temp_soc_trend": _t(
            "SELECT regr_count(battery_temp_c, battery_soc_pct)::BIGINT AS n, round(regr_slope(battery_temp_c, battery_soc_pct), 6) AS slope,"
            " round(regr_intercept(battery_temp_c, battery_soc_pct), 6) AS intercept FROM t"
        ),
        "corr_matrix": _t(_corr()),
        "soh_delta": _t(
            "SELECT device_id, arg_min(battery_soh_pct, us) AS soh_first, arg_max(battery_soh_pct, us) AS soh_last,"
            " CASE WHEN count(battery_soh_pct) >= 2 THEN arg_max(battery_soh_pct, us) - arg_min(battery_soh_pct, us) END AS soh_delta"
            " FROM t GROUP BY device_id"
        ),
        "soh_series": _t(
            "top AS (SELECT device_id FROM t GROUP BY device_id ORDER BY count(*) DESC, device_id LIMIT 5)"
            " SELECT device_id, ts, battery_soh_pct FROM t WHERE device_id IN (SELECT device_id FROM top)"
        ),
        "gps_hotspots": _t(
            f"SELECT round(gps_lat, 2) AS lat_r, round(gps_lon, 2) AS lon_r, count(*) AS n FROM t WHERE {located} AND gps_lat <> 0 AND gps_lon <> 0"
            " GROUP BY ALL ORDER BY n DESC, lat_r, lon_r LIMIT 3"
        ),
        "heat_tiles": _t(
            f"c AS (SELECT floor(gps_lat * 100)::BIGINT AS a, floor(gps_lon * 100)::BIGINT AS b FROM t WHERE {located} AND gps_lat <> 0 AND gps_lon <> 0"
            "       AND gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180),"
            " l AS (SELECT k::INTEGER AS level, (10 ** k)::BIGINT AS w, 10.0::DOUBLE ** (k - 2) AS size FROM range(5) r(k))"
            " SELECT level, round(size, 6) AS size, round(floor(a / w) * size, 6) AS south, round(floor(b / w) * size, 6) AS west, count(*) AS n"
            " FROM c, l GROUP BY level, size, floor(a / w), floor(b / w)"
        ),
        "map_center": _t(
            f"top AS (SELECT device_id FROM t WHERE {located} GROUP BY device_id ORDER BY count(*) DESC, device_id LIMIT 2),"
            f" heat AS (SELECT avg(gps_lat) AS a, avg(gps_lon) AS b FROM t WHERE {located} AND gps_lat <> 0 AND gps_lon <> 0),"
            " mid AS (SELECT quantile_cont(gps_lat, 0.5) AS c, quantile_cont(gps_lon, 0.5) AS d FROM t WHERE device_id IN (SELECT device_id FROM top))"
            " SELECT round(coalesce(a, 20), 6) AS heat_lat, round(coalesce(b, 78), 6) AS heat_lon, round(coalesce(c, 20), 6) AS map_lat,"
            " round(coalesce(d, 78), 6) AS map_lon FROM heat, mid"
        ),
        "map_bounds": _t(
            f"SELECT round(min(gps_lat), 6) AS south, round(min(gps_lon), 6) AS west, round(max(gps_lat), 6) AS north, round(max(gps_lon), 6) AS east"
            f" FROM t WHERE {located}"
        ),
        "top_devices": _t("SELECT device_id, count(*) AS n FROM t GROUP BY device_id ORDER BY n DESC, device_id LIMIT 5"),
        "state_segments": _t(f"{SEGMENTS} SELECT * FROM s"),
        "state_time_share": _t(
            f"{SEGMENTS}, y AS (SELECT device_id, state, sum(epoch_us(end_ts) - epoch_us(start_ts)) AS us FROM s GROUP BY ALL)"
            " SELECT device_id, state, round(100.0::DOUBLE * us / nullif(sum(us) OVER (PARTITION BY device_id), 0), 6) AS share_pct FROM y"
        ),
        "gps_deltas": _t(f"{DELTAS} SELECT device_id, ts, {_gps_columns()} FROM f"),
        "gps_jump": _t(f"{DELTAS} SELECT device_id, ts, {_rounded('km delta_km_haversine, sec delta_sec')} FROM f WHERE jump"),
        "gps_dropout": _t(f"{DELTAS} SELECT device_id, ts FROM f WHERE dropout"),
        "gps_freeze": _t(f"{DELTAS} SELECT device_id, ts FROM f WHERE frozen"),
        "gps_jump_severity": _t(
            f"{DELTAS} SELECT device_id, ts, {_rounded('km delta_km_haversine, sec delta_sec')} FROM f WHERE jump AND sec > 0 AND sec < {D.jump / 1e6}"
        ),
        "gps_summary": _t(
            f"{DELTAS} SELECT device_id, count(*) AS n_rows, {', '.join(flag.format(*n) for n in names)} FROM f GROUP BY device_id"
        ),
        "gps_summary_long": _t(
            f"{DELTAS} " + " UNION ALL ".join(f"SELECT device_id, '{b}' AS anomaly, count(*) FILTER ({a}) AS n FROM f GROUP BY device_id" for a, b in names)
        ),
        "kalman_smooth": _t(_kalman(), recursive=True),
        "kalman_smooth_split": _t(_kalman(), recursive=True),
        "stop_duration": _t(f"{STOPS} SELECT device_id, ts, round(stop_sec, 6) AS stop_sec FROM p"),
        "trip_labels": _t(
            f"{TRIP_ROWS} SELECT device_id, ts, CASE WHEN seq IS NOT NULL THEN device_id || '_' || seq END AS trip_id FROM l", recursive=True
        ),
        "trip_segments": _t(f"{TRIPS_SQL} SELECT {trip_columns} FROM k", recursive=True),
        "trip_carbon": _t(
            f"{TRIPS_SQL} SELECT {trip_columns}, round(energy_consumed_wh / 1000 * 0.716::DOUBLE - distance_km * 0.00015::DOUBLE, 6) AS net_tco2e FROM k",
            recursive=True,
        ),
        "trip_points_interval_join": _t(
            f"{TRIPS_SQL} SELECT t.device_id, trip_id, t.ts, {_rounded('gps_lat, gps_lon')} FROM t JOIN k"
            " ON t.device_id = k.device_id AND t.ts BETWEEN k.start_ts AND k.end_ts",
            recursive=True,
        ),
        "trip_track_km": _t(f"{TRACKS} SELECT device_id, trip_id, n_points, round(raw_gps_km, 6) AS raw_gps_km FROM tracks", recursive=True),
        "trip_discrepancy": _t(
            f"{TRACKS}, mm AS (SELECT *, CASE WHEN n_points >= 2 THEN raw_gps_km * 1.1::DOUBLE END AS route FROM tracks)"
            " SELECT device_id, trip_id, round(raw_gps_km, 4) AS raw_gps_km, round(route, 4) AS matched_route_km,"
            " round(route - raw_gps_km, 4) AS discrepancy_km,"
            " CASE WHEN raw_gps_km > 1e-6 THEN round((route - raw_gps_km) / raw_gps_km * 100, 2) END AS discrepancy_pct,"
            " CASE WHEN n_points >= 2 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS match_confidence,"
            " CASE WHEN n_points >= 2 THEN 'ok' ELSE 'too_few_points' END AS match_status FROM mm",
            recursive=True,
        ),
        "asof_lag_delta": _t(f"{ENERGY} SELECT device_id, ts, round(soc_delta_5min, 6) AS soc_delta_5min FROM h"),
        "asof_lag_within": _t(
            f"{ENERGY} SELECT device_id, ts, CASE WHEN back <= {2 * D.lag} THEN round(soc_delta_5min, 6) END AS soc_delta_5min FROM h"
        ),
        "asof_lead_target": _t(f"{AHEAD} SELECT device_id, ts, target AS target_soc_t_plus_10min FROM a"),
        "energy_features": _t(f"{ENERGY} SELECT device_id, ts, {_rounded('discharge_rate_wh, cell_imbalance')} FROM h"),
        "rolling_features": _t(
            f"{ENERGY} SELECT device_id, ts, {', '.join(f'round({sql}, 6) AS {name}' for name, sql in ROLLED.items())} FROM h"
        ),
        "soc_dataset": _t(f"{SOC} SELECT device_id, ts, {soc_columns} FROM soc"),
        "time_split": _t(f"{SPLIT.format(of='t')} SELECT device_id, ts, is_test FROM x"),
        "cv_folds": _t(_folds()),
        "sequences": _t(
            f"{SEQUENCES} SELECT device_id, ts, target_soc_t_plus_10min, round(total, 3) AS total, imbalances FROM q WHERE rn >= 10"
        ),
        "val_split": _t(
            f"{SEQUENCES}, w AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY us DESC) AS back,"
            " count(*) OVER (PARTITION BY device_id) AS n FROM q WHERE rn >= 10)"
            " SELECT device_id, ts, target_soc_t_plus_10min, (n >= 10 AND back <= ceil(0.15::DOUBLE * n))::INTEGER AS is_valid FROM w"
        ),
        "feature_scaling": _t(_scaled()),
        "baseline_regression_metrics": _t(
            f"{AHEAD} SELECT count(*) AS n, round(sqrt(avg((target - battery_soc_pct) ** 2)), 6) AS rmse, round(avg(abs(target - battery_soc_pct)), 6) AS mae,"
            " round(1 - avg((target - battery_soc_pct) ** 2) / var_pop(target), 6) AS r2 FROM a WHERE target IS NOT NULL AND battery_soc_pct IS NOT NULL"
        ),
        "discharge_spikes": _t(
            f"{ANOMALY} SELECT device_id, ts, {_rounded('discharge_rate_wh, mean_abs discharge_mean_abs')} FROM n"
            " WHERE mean_abs > 0 AND abs(discharge_rate_wh) > 3 * mean_abs"
        ),
        "soh_drop": _t(f"{ANOMALY} SELECT device_id, ts, battery_soh_pct, soh_max FROM n WHERE soh_max - battery_soh_pct > 1"),
        "bms_anomalies": _t(_bms()),
        "haversine_nations": "SELECT n_nationkey, round("
        + HAVERSINE.format(a="(n_nationkey * 7.2::DOUBLE - 90)", b="(n_nationkey * 14.4::DOUBLE - 180)", c="0.0::DOUBLE", d="0.0::DOUBLE")
        + ", 6) AS km FROM nation",
    }
