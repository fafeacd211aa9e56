"""Building blocks of the SQL that queries are checked with: the operators' rules once more, in plain SQL."""

from __future__ import annotations

from waymark.plans.fixtures import plain


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    chord = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(2 * 6378137e0 * atan2(sqrt{chord}, sqrt(1 - {chord})))"


def enriched(points: str = "trackpoints") -> str:
    """WITH ... e AS (points with all derived columns)."""
    seg, w = "PARTITION BY track_id, seg_no", "PARTITION BY track_id, seg_no ORDER BY pt_no"
    up = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
WITH tp AS ({plain(points)}),
a1 AS (SELECT *, row_number() OVER ({w}) = 1 AS is_first, lag(lon) OVER ({w}) AS plon, lag(lat) OVER ({w}) AS plat, lag(ts) OVER ({w}) AS pts,
  min(CASE WHEN ts IS NULL THEN 0 ELSE 1 END) OVER ({seg}) = 1 AS own_times,
  min(CASE WHEN ts IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seg_no RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS timed FROM tp),
a2 AS (SELECT *, CASE WHEN is_first THEN 0e0 ELSE {hav('plon', 'plat', 'lon', 'lat')} END AS ds,
  CASE WHEN own_times THEN CASE WHEN is_first THEN 0e0 WHEN ts > pts THEN (epoch_us(ts) - epoch_us(pts)) / 1e6 ELSE 0e0 END END AS dt FROM a1),
a3 AS (SELECT *, sum(ds) OVER ({w} {up}) AS seg_dist, sum(dt) OVER ({w} {up}) AS seg_time,
  CASE WHEN own_times THEN coalesce(last_value(CASE WHEN dt >= 1e-3 THEN ds / dt END IGNORE NULLS) OVER ({w} {up}), 0e0) END AS raw_speed FROM a2),
a4 AS (SELECT *, CASE WHEN dt >= 1e-3 THEN (raw_speed - lag(raw_speed) OVER ({w})) / dt END AS change, avg(raw_speed) OVER ({seg}) AS mean_speed FROM a3),
a5 AS (SELECT *, CASE WHEN own_times THEN coalesce(last_value(change IGNORE NULLS) OVER ({w} {up}), 0e0) END AS acceleration,
  sum(CASE WHEN NOT is_first AND coalesce(raw_speed > CASE WHEN mean_speed > 2.8 THEN 0.40e0 ELSE 0.15e0 END, true) THEN 1 ELSE 0 END) OVER ({w} {up}) AS run FROM a4),
a6 AS (SELECT *, max(seg_time) OVER ({seg}, run) - min(seg_time) OVER ({seg}, run) AS lasts, count(*) OVER ({seg}, run) AS in_run,
  lead(run) OVER ({w}) AS next_run FROM a5),
a7 AS (SELECT *, coalesce(own_times AND lasts > 10 AND in_run > 1, false) AS is_stop FROM a6),
a8 AS (SELECT *, CASE WHEN is_stop AND (next_run IS NULL OR next_run <> run) THEN lasts ELSE 0e0 END AS pause,
  row_number() OVER ({seg} ORDER BY acceleration NULLS LAST) AS rn, count(acceleration) OVER ({seg}) AS cnt FROM a7),
a9 AS (SELECT *, max(CASE WHEN rn = cnt // 2 + 1 THEN acceleration END) OVER ({seg}) AS median FROM a8),
b1 AS (SELECT *, abs(acceleration - median) AS deviation FROM a9),
b2 AS (SELECT *, row_number() OVER ({seg} ORDER BY deviation NULLS LAST) AS rn2 FROM b1),
b3 AS (SELECT *, max(CASE WHEN rn2 = cnt // 2 + 1 THEN deviation END) OVER ({seg}) AS mad FROM b2),
b4 AS (SELECT *, coalesce(own_times AND NOT is_stop AND CASE WHEN mad = 0 THEN deviation > 0 ELSE 0.6745e0 * deviation / mad > 5 END, false) AS is_outlier,
  coalesce(is_stop AND lag(is_stop) OVER ({w}) AND lead(is_stop) OVER ({w}), false) AS is_inner_stop FROM b3),
b5 AS (SELECT *, lag(lon) OVER k AS klon, lag(lat) OVER k AS klat, lag(seg_time) OVER k AS ktime, row_number() OVER k = 1 AS kfirst FROM b4
  WINDOW k AS (PARTITION BY track_id, seg_no, is_outlier ORDER BY pt_no)),
b6 AS (SELECT *, {hav('klon', 'klat', 'lon', 'lat')} AS kstep FROM b5),
b7 AS (SELECT *, CASE WHEN kfirst THEN seg_dist WHEN is_inner_stop THEN 0e0 ELSE kstep END AS kds,
  CASE WHEN kfirst THEN raw_speed WHEN is_inner_stop THEN 0e0 WHEN seg_time - ktime >= 1e-3 THEN kstep / (seg_time - ktime) END AS kspeed FROM b6),
b8 AS (SELECT *, CASE WHEN is_outlier OR NOT own_times THEN seg_dist ELSE sum(kds) OVER (PARTITION BY track_id, seg_no, is_outlier ORDER BY pt_no {up}) END AS clean_dist,
  CASE WHEN is_outlier OR NOT own_times THEN raw_speed ELSE last_value(kspeed IGNORE NULLS) OVER (PARTITION BY track_id, seg_no, is_outlier ORDER BY pt_no {up}) END AS clean_speed,
  lead(pt_no) OVER ({w}) IS NULL AS is_end FROM b7),
b9 AS (SELECT track_id, seg_no, max(CASE WHEN is_end THEN clean_dist END) AS end_dist, max(CASE WHEN is_end THEN seg_time END) AS end_time FROM b8 GROUP BY 1, 2),
c1 AS (SELECT track_id, seg_no, coalesce(sum(end_dist) OVER bb, 0e0) AS base, coalesce(sum(end_time) OVER bb, 0e0) AS base_time FROM b9
  WINDOW bb AS (PARTITION BY track_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT b8.*, base + clean_dist AS dist, base + seg_dist AS raw_dist, CASE WHEN timed THEN base_time + seg_time END AS t, CASE WHEN timed THEN clean_speed END AS v
  FROM b8 JOIN c1 USING (track_id, seg_no))"""


_CHANNELS = {
    "elevation": ("ele", 3, False),
    "speed": ("v", 5, True),
    "reported_speed": ("speed", 5, True),
    "heart_rate": ("heart_rate", 3, False),
    "temperature": ("temperature", 0, False),
    "ratio": ("ratio", 0, False),
    "cadence": ("cadence", 3, True),
    "power": ("power", 3, True),
}


def graphs() -> str:
    """enriched(), then g AS (smoothed series of all channels)."""
    parts = []
    for name, (column, width, rests) in _CHANNELS.items():
        y = f"CASE WHEN is_stop THEN 0e0 ELSE {column} END" if rests else column
        parts.append(
            f"SELECT track_id, seg_no, pt_no, dist AS s, t, is_stop, '{name}' AS channel, {width} AS width, {rests} AS rests, {y} AS y FROM e WHERE NOT is_outlier AND {column} IS NOT NULL"
        )
    ser = "PARTITION BY track_id, seg_no, channel"
    return (
        enriched()
        + f""",
g1 AS ({' UNION ALL '.join(parts)}),
g2 AS (SELECT *, row_number() OVER ({ser} ORDER BY pt_no) - 1 AS g_no, count(*) OVER ({ser}) AS n FROM g1),
g3 AS (SELECT *, avg(y) OVER ({ser} ORDER BY pt_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3, avg(y) OVER ({ser} ORDER BY pt_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5 FROM g2),
g4 AS (SELECT *, CASE WHEN width = 5 THEN m5 WHEN width = 3 THEN m3 END AS m, width // 2 AS h FROM g3),
g5 AS (SELECT *, max(CASE WHEN g_no = h THEN m END) OVER ({ser}) AS mf, max(CASE WHEN g_no = n - 1 - h THEN m END) OVER ({ser}) AS ml FROM g4),
g AS (SELECT track_id, channel, seg_no, CAST(g_no AS INT) AS g_no, s, t,
  CASE WHEN rests AND is_stop THEN 0e0 WHEN width < 2 OR n < width THEN y WHEN g_no < h THEN mf WHEN g_no > n - 1 - h THEN ml ELSE m END AS y FROM g5 WHERE n >= 2)"""
    )


def track_totals() -> str:
    """enriched(), then tt AS (totals by track)."""
    return (
        enriched()
        + """,
tt AS (SELECT track_id, coalesce(max_by(dist, seg_no * 1000000 + pt_no) FILTER (NOT is_outlier), 0e0) AS dist,
  max_by(t, seg_no * 1000000 + pt_no) FILTER (NOT is_outlier) AS time, sum(pause) AS pause, min_by(ts, seg_no * 1000000 + pt_no) AS started,
  max_by(t, seg_no * 1000000 + pt_no) FILTER (NOT is_outlier) - sum(pause) AS moving_time FROM e GROUP BY track_id)"""
    )


def series_stats() -> str:
    """graphs(), then st AS (statistics by track and channel)."""
    return (
        graphs()
        + """,
h1 AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY track_id, channel, seg_no ORDER BY g_no), 0e0) AS step FROM g),
st AS (SELECT track_id, channel, count(*) AS n, min(y) AS y_min, max(y) AS y_max, sum(y * step) AS weighed, max_by(s, seg_no * 1000000 + g_no) AS s_last,
  max_by(t, seg_no * 1000000 + g_no) AS t_last,
  CASE WHEN max_by(s, seg_no * 1000000 + g_no) <> 0 THEN sum(y * step) / max_by(s, seg_no * 1000000 + g_no) END AS y_avg FROM h1 GROUP BY track_id, channel)"""
    )
