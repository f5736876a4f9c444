"""SQL building blocks that check the registered queries, written independently of the DataFrame plans."""

from __future__ import annotations

import math

from hexflow.functions import geo
from hexflow.sources.tables import ARCHETYPES


def num(v: float) -> str:
    """A literal that every engine reads as the same double."""
    return f"({v:.17e})"


S = num(geo.edge_km())
LAT0, LON0 = num(geo.CENTRE[0]), num(geo.CENTRE[1])
NAMES = ", ".join(f"'{a}'" for a in ARCHETYPES)

EVENTS = f"""
m_raw AS (
  SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) AS player_id, event_type, value, CAST(props->>'k' AS INT) AS k,
    {LAT0} + CAST((user_id * 7919) % 2001 - 1000 AS DOUBLE) / {num(1000)} * {num(10 / 111)} AS home_lat,
    {LON0} + CAST((user_id * 104729) % 2001 - 1000 AS DOUBLE) / {num(1000)} * {num(10 / 97)} AS home_lon,
    CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, list_extract([{NAMES}], CAST(user_id % 9 + 1 AS INT)) AS archetype
  FROM events
), m_pos AS (
  SELECT *, home_lat + (CAST(k % 10 AS DOUBLE) - {num(4.5)}) * {num(0.4)} / {num(111)} AS lat, home_lon + (CAST(k // 10 AS DOUBLE) - {num(4.5)}) * {num(0.4)} / {num(97)} AS lon,
    CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS period
  FROM m_raw
), m_axial AS (
  SELECT *, ({num(math.sqrt(3) / 3)} * ((lon - {LON0}) * {num(97)}) - (lat - {LAT0}) * {num(111)} / {num(3)}) / {S} AS qf,
    ({num(2 / 3)} * ((lat - {LAT0}) * {num(111)})) / {S} AS rf FROM m_pos
), m_round AS (
  SELECT *, floor(qf + 0.5) AS q, floor(rf + 0.5) AS r, floor(-qf - rf + 0.5) AS z FROM m_axial
), m_events AS (
  SELECT * EXCLUDE (qf, rf, q, r, z),
    'r8:' || CAST(CAST(CASE WHEN abs(q - qf) > abs(r - rf) AND abs(q - qf) > abs(z + qf + rf) THEN -r - z ELSE q END AS BIGINT) AS VARCHAR) || ':' ||
    CAST(CAST(CASE WHEN NOT (abs(q - qf) > abs(r - rf) AND abs(q - qf) > abs(z + qf + rf)) AND abs(r - rf) > abs(z + qf + rf) THEN -q - z ELSE r END AS BIGINT) AS VARCHAR) AS hex_id
  FROM m_round
), m_players AS (SELECT DISTINCT player_id, archetype, home_lat, home_lon FROM m_raw)
"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"({num(2 * geo.EARTH_KM)} * asin(sqrt(least({a}, 1))))"


def centroid(cell: str) -> tuple[str, str]:
    q, r = f"CAST(split_part({cell}, ':', 2) AS DOUBLE)", f"CAST(split_part({cell}, ':', 3) AS DOUBLE)"
    return f"({LAT0} + {num(1.5)} * {S} * {r} / {num(111)})", f"({LON0} + {S} * {num(math.sqrt(3))} * ({q} + {r} / 2) / {num(97)})"


def sql(body: str, *ctes: str) -> str:
    """``body`` over the common tables and further ones."""
    return "WITH " + ", ".join([EVENTS, *ctes]) + " " + body


CUTOFF = "2024-01-26 00:00:00"
START = "2024-01-01"
PAST = f"past AS (SELECT * FROM m_events WHERE ts < TIMESTAMP '{CUTOFF}')"
FUTURE = f"future AS (SELECT * FROM m_events WHERE ts >= TIMESTAMP '{CUTOFF}')"


def sessions(source: str, gap_minutes: int = 30, name: str = "numbered") -> str:
    return f"""{name}_flag AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY player_id ORDER BY ts, event_id) > INTERVAL {gap_minutes} MINUTE THEN 1 ELSE 0 END AS jump FROM {source}),
    {name} AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY player_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM {name}_flag)"""


def pairs(source: str, name: str = "pairs", all_visited: bool = False) -> str:
    taken = "visits" if all_visited else "top"
    return f"""{name}_visits AS (SELECT player_id, day_of_week, period, hex_id, count(*) AS n_visits FROM {source} GROUP BY ALL),
    {name}_top AS (SELECT * FROM {name}_visits QUALIFY row_number() OVER (PARTITION BY player_id, day_of_week, period ORDER BY n_visits DESC, hex_id) <= 10),
    {name}_queries AS (SELECT player_id, day_of_week, period, count(*) AS n_positives FROM {name}_top GROUP BY ALL),
    {name}_cand AS (SELECT q.*, u.hex_id FROM {name}_queries q JOIN (SELECT DISTINCT player_id, hex_id FROM {name}_visits) u USING (player_id)
      WHERE NOT EXISTS (SELECT 1 FROM {name}_{taken} t WHERE t.player_id = q.player_id AND t.day_of_week = q.day_of_week AND t.period = q.period AND t.hex_id = u.hex_id)),
    {name}_neg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, day_of_week, period ORDER BY md5('42|' || player_id || '|' || day_of_week || '|' || period || '|' || hex_id), hex_id) AS rn FROM {name}_cand) WHERE rn <= 5 * n_positives),
    {name}_ids AS (SELECT *, CAST(row_number() OVER (ORDER BY player_id, day_of_week, period) - 1 AS BIGINT) AS group_id FROM (SELECT DISTINCT player_id, day_of_week, period FROM {name}_neg)),
    {name} AS (SELECT x.*, group_id FROM (SELECT player_id, day_of_week, period, hex_id, 1 AS label FROM {name}_top UNION ALL SELECT player_id, day_of_week, period, hex_id, 0 FROM {name}_neg) x JOIN {name}_ids USING (player_id, day_of_week, period))"""


PLAYER_FEATURES = f"""pf_days AS (SELECT player_id, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT hex_id) AS cells FROM past GROUP BY 1),
  pf_hours AS (SELECT player_id, 1 + sum(p * ln(p)) / ln(24) AS conc FROM (SELECT player_id, count(*) / sum(count(*)) OVER (PARTITION BY player_id) AS p FROM past GROUP BY player_id, hour) GROUP BY 1),
  {sessions("past", name="pf_sess")},
  pf_base AS (SELECT player_id, count(*) AS n, count(DISTINCT session_seq) AS s, avg(CASE WHEN day_of_week < 5 THEN 1.0 ELSE 0 END) AS wk, avg(CASE WHEN hour >= 18 THEN 1.0 ELSE 0 END) AS ev,
    avg({haversine("home_lat", "home_lon", "lat", "lon")}) AS dist FROM pf_sess GROUP BY 1),
  player_features AS (SELECT b.player_id, ln(1 + n) AS player_total_events_log, CAST(s AS BIGINT) AS player_unique_sessions, n / s AS player_events_per_session_mean,
    active_days / date_diff('day', DATE '{START}', CAST(TIMESTAMP '{CUTOFF}' AS DATE)) AS player_active_days_ratio, wk AS player_weekday_ratio, ev AS player_evening_ratio, conc AS player_hour_concentration,
    dist AS player_distance_from_home_mean_km, ln(1 + cells) AS player_unique_hexes_count_log, archetype AS player_archetype
    FROM pf_base b JOIN pf_days USING (player_id) JOIN pf_hours USING (player_id) LEFT JOIN m_players USING (player_id))"""

HEX_FEATURES = "hex_features AS (SELECT hex_id, CAST(count(DISTINCT player_id) AS BIGINT) AS hex_global_popularity, CAST(count(*) AS BIGINT) AS hex_total_visits, CAST(count(DISTINCT archetype) AS BIGINT) AS hex_n_unique_archetypes FROM past GROUP BY 1)"


def enriched(source: str, name: str = "enriched") -> str:
    lat, lon = centroid("p.hex_id")
    return f"""past_pairs AS (SELECT player_id, hex_id, count(*) AS n FROM past GROUP BY ALL),
    {name} AS (SELECT p.*, CAST(coalesce(n, 0) AS BIGINT) AS pair_past_visits, {haversine("home_lat", "home_lon", lat, lon)} AS pair_distance_from_home_km, f.* EXCLUDE (player_id), h.* EXCLUDE (hex_id)
      FROM {source} p LEFT JOIN past_pairs pp USING (player_id, hex_id) LEFT JOIN m_players m USING (player_id) LEFT JOIN player_features f USING (player_id) LEFT JOIN hex_features h USING (hex_id))"""


def metrics(scored: str) -> str:
    dcg = lambda k, r: f"sum(CASE WHEN {r} <= {k} THEN label / log2({r} + 1) ELSE 0 END)"
    return f"""mt_rank AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, hex_id) AS rn, row_number() OVER (PARTITION BY group_id ORDER BY label DESC, hex_id) AS best FROM {scored}),
    mt_hits AS (SELECT *, sum(label) OVER (PARTITION BY group_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS hits FROM mt_rank),
    mt_query AS (SELECT group_id, coalesce({dcg(10, "rn")} / nullif({dcg(10, "best")}, 0), 0) AS ndcg_10, coalesce({dcg(20, "rn")} / nullif({dcg(20, "best")}, 0), 0) AS ndcg_20,
      coalesce(sum(CASE WHEN label > 0 THEN hits / rn END) / nullif(sum(label), 0), 0) AS ap, coalesce(1.0 / min(CASE WHEN label > 0 THEN rn END), 0) AS rr,
      sum(CASE WHEN rn <= 5 THEN label ELSE 0 END) / least(5, count(*)) AS p5, sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) / least(10, count(*)) AS p10 FROM mt_hits GROUP BY 1)"""
