"""Independent DuckDB SQL for every registered key (the correctness oracle).

Written from the query semantics, not from the Spark plans: where the Spark side
uses a linear-time formulation (prefix sums for 2-A, interval expansion for J5,
gap filling for J7) the SQL here is the direct brute-force or ASOF-join form.
The driver pre-registers the raw tables (events, customer, ...) as views; the
stand-in tables are rebuilt below as CTEs.
"""

from __future__ import annotations

# Stand-in tables (FIXTURES.md §3), as CTE bodies.
_BASE = {
    "rental": """SELECT event_id AS rental_id, CAST(user_id AS VARCHAR) AS rental_station_id,
        ts AS rental_time FROM events WHERE event_type = 'click'""",
    "rental_station": """SELECT CAST(c_custkey AS VARCHAR) AS station_id, c_name AS station_name
        FROM customer""",
    "weather": """SELECT obs_datetime,
        CASE WHEN v1 < 50 THEN CAST(0 AS DOUBLE) ELSE (v1 - 50) / 5 END AS precipitation,
        v2 / 2 AS feel_temp
        FROM (SELECT date_trunc('hour', ts) AS obs_datetime, arg_min(value, event_id) AS v1,
                     arg_max(value, event_id) AS v2
              FROM events GROUP BY 1) AS wx""",
    "gas_station": """SELECT CAST(c_custkey AS VARCHAR) AS station_id, c_mktsegment AS brand
        FROM customer""",
    "gas_price": """SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS price_date,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE)
          / (CAST(count(value) AS DOUBLE) * 100) AS price
        FROM events GROUP BY 1, 2""",
    "oil_price": """SELECT CAST(ts AS DATE) AS price_date,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE)
          / (CAST(count(value) AS DOUBLE) * 100) AS dubai,
        max(value) AS brent, min(value) AS wti
        FROM events WHERE event_type = 'purchase' AND isodow(ts) <= 5 GROUP BY 1""",
    "brand_days": """SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS price_date,
        arg_max(event_type, event_id) AS brand FROM events GROUP BY 1, 2""",
    # derived helpers used by several queries
    "oil": "SELECT price_date, dubai AS price FROM oil_price WHERE dubai IS NOT NULL",
    "spine": """SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS obs_datetime
        FROM (SELECT min(obs_datetime) AS lo, max(obs_datetime) AS hi FROM weather) AS b""",
    "hourly": """SELECT date_trunc('hour', rental_time) AS obs_datetime, count(*) AS n_rentals
        FROM rental GROUP BY 1""",
    "hwr": """SELECT s.obs_datetime, w.precipitation, w.feel_temp,
        CAST(coalesce(h.n_rentals, 0) AS BIGINT) AS n_rentals
        FROM spine s LEFT JOIN weather w ON w.obs_datetime = s.obs_datetime
        LEFT JOIN hourly h ON h.obs_datetime = s.obs_datetime""",
    "hc": """SELECT obs_datetime, feel_temp >= 35.0 AS is_hot FROM weather
        WHERE feel_temp IS NOT NULL""",
    "ol": """SELECT price_date, price, lag(price) OVER (ORDER BY price_date) AS prev_price,
        lag(price_date) OVER (ORDER BY price_date) AS prev_price_date FROM oil""",
    "per": """SELECT greatest((SELECT min(price_date) FROM oil), (SELECT min(price_date) FROM gas_price)) AS lo,
        least((SELECT max(price_date) FROM oil), (SELECT max(price_date) FROM gas_price)) AS hi""",
    "ev": """SELECT ol.price_date AS event_date FROM ol, per
        WHERE ol.price - ol.prev_price > 0 AND ol.price_date BETWEEN per.lo AND per.hi""",
    "sl": """SELECT station_id, price_date, price,
        lag(price) OVER (PARTITION BY station_id ORDER BY price_date) AS prev_price,
        lag(price_date) OVER (PARTITION BY station_id ORDER BY price_date) AS prev_price_date
        FROM gas_price""",
    # every watched (event, station) pair with its wait, responded or not
    "watched": """SELECT s.brand, p.response_date IS NOT NULL AS told,
        datediff('day', p.event_date, coalesce(p.response_date, l.last_date)) AS wait_days
        FROM pairs p JOIN gas_station s ON s.station_id = p.station_id
        JOIN (SELECT station_id, max(price_date) AS last_date FROM gas_price GROUP BY 1) l
          ON l.station_id = p.station_id
        WHERE p.response_date IS NOT NULL OR l.last_date > p.event_date""",
    "vers": """SELECT station_id, brand,
        CASE WHEN row_number() OVER v > 1 THEN price_date END AS valid_from, lead(price_date) OVER v AS valid_to
        FROM (SELECT *, lag(brand) OVER (PARTITION BY station_id ORDER BY price_date) AS before FROM brand_days) b
        WHERE before IS NULL OR before <> brand
        WINDOW v AS (PARTITION BY station_id ORDER BY price_date)""",
    "sr": "SELECT station_id, price_date AS rise_date FROM sl WHERE price - prev_price > 0",
    "pairs": """SELECT st.station_id, ev.event_date,
        (SELECT min(sr.rise_date) FROM sr WHERE sr.station_id = st.station_id
            AND sr.rise_date > ev.event_date) AS response_date
        FROM (SELECT DISTINCT station_id FROM gas_price) AS st CROSS JOIN ev""",
    "ph": """SELECT price_date, oil_price, ma, prev_ma,
        CASE WHEN ma IS NULL OR prev_ma IS NULL THEN NULL WHEN ma > prev_ma THEN 'rising'
             WHEN ma < prev_ma THEN 'falling' ELSE 'flat' END AS phase
        FROM (SELECT price_date, oil_price, ma, lag(ma) OVER (ORDER BY price_date) AS prev_ma
              FROM (SELECT price_date, price AS oil_price,
                           CAST(sum(CAST(round(price * 1000000) AS BIGINT)) OVER w AS DOUBLE)
                             / (CAST(count(price) OVER w AS DOUBLE) * 1000000) AS ma
                    FROM oil WINDOW w AS (ORDER BY price_date
                               ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS a) AS b""",
    "dph": """SELECT c.price_date, p.price_date AS asof_date, p.phase, p.oil_price
        FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                       INTERVAL 1 DAY)) AS DATE) AS price_date
              FROM (SELECT (SELECT min(price_date) FROM ph WHERE phase IS NOT NULL) AS lo,
                           greatest((SELECT max(price_date) FROM ph WHERE phase IS NOT NULL),
                                    (SELECT max(price_date) FROM gas_price)) AS hi) AS b) AS c
        ASOF LEFT JOIN (SELECT * FROM ph WHERE phase IS NOT NULL) AS p
          ON c.price_date >= p.price_date""",
    "chg": """SELECT sl.station_id, sl.price_date, sl.price, sl.prev_price,
        CAST(datediff('day', sl.prev_price_date, sl.price_date) AS INTEGER) AS gap_days,
        sl.price - sl.prev_price AS change, d.phase, d.asof_date AS phase_date
        FROM sl JOIN dph d ON d.price_date = sl.price_date
        WHERE sl.prev_price IS NOT NULL AND d.phase IS NOT NULL""",
}

_DEPS = {
    "weather": [], "rental": [], "rental_station": [], "gas_station": [], "gas_price": [],
    "brand_days": [], "watched": ["pairs", "gas_station", "gas_price"], "vers": ["brand_days"],
    "oil_price": [], "oil": ["oil_price"], "spine": ["weather"], "hourly": ["rental"],
    "hwr": ["spine", "weather", "hourly"], "hc": ["weather"], "ol": ["oil"],
    "per": ["oil", "gas_price"], "ev": ["ol", "per"], "sl": ["gas_price"], "sr": ["sl"],
    "pairs": ["ev", "sr", "gas_price"], "ph": ["oil"], "dph": ["ph", "gas_price"],
    "chg": ["sl", "dph"],
}


def _with(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in _DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({_BASE[n]})" for n in order)
    return f"WITH {ctes}\n{body}"


ORACLE: dict[str, str] = {
    "q1a": _with(["hwr"], """
SELECT band, count(*) AS n_hours, CAST(sum(n_rentals) AS BIGINT) AS rentals,
       CAST(sum(n_rentals) AS DOUBLE) / count(*) AS avg_rentals
FROM (SELECT n_rentals,
        CASE WHEN precipitation IS NULL OR precipitation < 0 THEN 'unobserved' WHEN precipitation = 0 THEN 'none'
             WHEN precipitation < 10 THEN 'lt10' ELSE 'ge10' END AS band FROM hwr) AS x
GROUP BY band"""),

    "q1b": _with(["rental", "rental_station", "hc"], """
, tot AS (SELECT count(*) FILTER (WHERE is_hot) AS n_hot_hours,
                 count(*) FILTER (WHERE NOT is_hot) AS n_normal_hours FROM hc)
, rc AS (SELECT r.rental_station_id AS station_id,
                count(*) FILTER (WHERE hc.is_hot) AS hot_rentals,
                count(*) FILTER (WHERE NOT hc.is_hot) AS normal_rentals
         FROM rental r JOIN hc ON date_trunc('hour', r.rental_time) = hc.obs_datetime
         GROUP BY 1)
, d AS (SELECT rc.station_id, m.station_name, tot.n_hot_hours, tot.n_normal_hours,
               rc.hot_rentals, rc.normal_rentals,
               rc.hot_rentals / nullif(CAST(tot.n_hot_hours AS DOUBLE), 0) AS hot_rate,
               rc.normal_rentals / nullif(CAST(tot.n_normal_hours AS DOUBLE), 0) AS normal_rate
        FROM rc JOIN rental_station m ON m.station_id = rc.station_id CROSS JOIN tot)
SELECT *, normal_rate - hot_rate AS rate_drop,
       (normal_rate - hot_rate) * 100.0 / nullif(normal_rate, 0) AS pct_drop
FROM d WHERE n_hot_hours > 0
ORDER BY rate_drop DESC, station_id ASC LIMIT 5"""),

    "q2a": _with(["pairs", "gas_station"], """
, st AS (SELECT g.station_id, s.brand FROM (SELECT DISTINCT station_id FROM gas_price) g
         JOIN gas_station s ON s.station_id = g.station_id)
, pb AS (SELECT st.brand, count(*) AS n_events, count(p.response_date) AS n_responded,
                sum(datediff('day', p.event_date, p.response_date)) AS sum_days
         FROM pairs p JOIN st ON st.station_id = p.station_id GROUP BY 1)
, sb AS (SELECT brand, count(*) AS n_stations FROM st GROUP BY 1)
SELECT sb.brand, sb.n_stations, CAST(coalesce(pb.n_events, 0) AS BIGINT) AS n_events,
       CAST(coalesce(pb.n_responded, 0) AS BIGINT) AS n_responded,
       CAST(pb.sum_days AS DOUBLE) / nullif(CAST(pb.n_responded AS DOUBLE), 0) AS avg_days
FROM sb LEFT JOIN pb ON pb.brand = sb.brand"""),

    "q2b": _with(["chg"], """
SELECT count(*) FILTER (WHERE phase = 'rising') AS n_rising,
       avg(change) FILTER (WHERE phase = 'rising') AS avg_change_rising,
       count(*) FILTER (WHERE phase = 'falling') AS n_falling,
       avg(change) FILTER (WHERE phase = 'falling') AS avg_change_falling,
       abs(avg(change) FILTER (WHERE phase = 'rising'))
         / nullif(abs(avg(change) FILTER (WHERE phase = 'falling')), 0) AS asymmetry
FROM chg"""),

    "t1_weather": _with(["weather"], "SELECT * FROM weather"),

    "t1_increment": """
SELECT event_type AS station_id, date_trunc('hour', ts) AS obs_datetime, sum(value) AS precipitation,
       max(value / 2) AS feel_temp, count(*) AS n_obs, avg(value) AS temperature
FROM events GROUP BY 1, 2""",

    "t4_typed": """
SELECT event_id,
       CASE event_id % 6 WHEN 2 THEN -round(value * 100) WHEN 4 THEN 1234.5
            WHEN 5 THEN round(value * 100) END AS price,
       CASE WHEN event_id % 4 <> 2 THEN CAST(ts AS DATE) END AS price_date,
       CAST((event_id % 6 IN (1, 3)) AS INTEGER) + CAST((event_id % 4 = 2) AS INTEGER) AS n_lost
FROM events""",

    "q1_dups": """
SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2 HAVING count(*) > 1""",

    "q2_orphans": """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND user_id IS NOT NULL)""",

    "t2_hourly": _with(["hourly"], "SELECT * FROM hourly"),

    "t3_master": """
SELECT CAST(user_id AS VARCHAR) AS station_id, min(ts) AS first_seen, max(ts) AS last_seen,
       count(*) AS n_rows, arg_max(props, event_id) AS props
FROM events WHERE event_type = 'click' GROUP BY 1""",

    "t5_overlap": _with(["per"], "SELECT lo, hi FROM per"),

    "t6_spine": _with(["spine"], "SELECT obs_datetime FROM spine"),

    "q1_pk": _with(["rental_station", "weather", "oil_price", "gas_station", "gas_price"], """
SELECT 'rental_station' AS table_name, count(*) AS n_rows, count(DISTINCT station_id) AS n_keys,
       (SELECT count(*) FROM (SELECT station_id FROM rental_station GROUP BY 1 HAVING count(*) > 1)) AS n_dup_keys,
       CAST(count(*) FILTER (WHERE station_id IS NULL) > 0 AS BIGINT) AS n_null_keys
FROM rental_station
UNION ALL
SELECT 'weather', count(*), count(DISTINCT obs_datetime),
       (SELECT count(*) FROM (SELECT obs_datetime FROM weather GROUP BY 1 HAVING count(*) > 1)),
       CAST(count(*) FILTER (WHERE obs_datetime IS NULL) > 0 AS BIGINT)
FROM weather
UNION ALL
SELECT 'oil_price', count(*), count(DISTINCT price_date),
       (SELECT count(*) FROM (SELECT price_date FROM oil_price GROUP BY 1 HAVING count(*) > 1)),
       CAST(count(*) FILTER (WHERE price_date IS NULL) > 0 AS BIGINT)
FROM oil_price
UNION ALL
SELECT 'gas_station', count(*), count(DISTINCT station_id),
       (SELECT count(*) FROM (SELECT station_id FROM gas_station GROUP BY 1 HAVING count(*) > 1)),
       CAST(count(*) FILTER (WHERE station_id IS NULL) > 0 AS BIGINT)
FROM gas_station
UNION ALL
SELECT 'gas_price', count(*), (SELECT count(*) FROM (SELECT DISTINCT station_id, price_date FROM gas_price)),
       (SELECT count(*) FROM (SELECT station_id, price_date FROM gas_price GROUP BY 1, 2 HAVING count(*) > 1)),
       (SELECT count(*) FROM (SELECT DISTINCT station_id, price_date FROM gas_price
                              WHERE station_id IS NULL OR price_date IS NULL))
FROM gas_price"""),

    "q2_fk": _with(["rental", "rental_station", "gas_price", "gas_station"], """
SELECT 'rental.rental_station_id->rental_station.station_id' AS relation, count(*) AS n_rows,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM rental_station m
                                          WHERE m.station_id = r.rental_station_id)) AS n_orphans
FROM rental r
UNION ALL
SELECT 'gas_price.station_id->gas_station.station_id', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gas_station m
                                          WHERE m.station_id = g.station_id))
FROM gas_price g"""),

    "q3_audit": _with(["rental", "weather", "oil_price", "gas_price"], """
SELECT *, CAST(NULL AS BIGINT) AS expected_rows, CAST(NULL AS BOOLEAN) AS matches FROM (
SELECT 'rental' AS table_name, count(*) AS n_rows, min(rental_time) AS first_value,
       max(rental_time) AS last_value FROM rental
UNION ALL SELECT 'weather', count(*), min(obs_datetime), max(obs_datetime) FROM weather
UNION ALL SELECT 'oil_price', count(*), CAST(min(price_date) AS TIMESTAMP),
                 CAST(max(price_date) AS TIMESTAMP) FROM oil_price
UNION ALL SELECT 'gas_price', count(*), CAST(min(price_date) AS TIMESTAMP),
                 CAST(max(price_date) AS TIMESTAMP) FROM gas_price) AS a"""),

    "p1_band": _with(["hwr"], """
SELECT obs_datetime, precipitation,
       CASE WHEN precipitation IS NULL OR precipitation < 0 THEN 'unobserved' WHEN precipitation = 0 THEN 'none'
            WHEN precipitation < 10 THEN 'lt10' ELSE 'ge10' END AS band
FROM hwr"""),

    "p2_heat": _with(["weather"], """
SELECT obs_datetime, feel_temp, feel_temp >= 35.0 AS is_hot FROM weather"""),

    "p3_phase": _with(["ph"], "SELECT price_date, oil_price, ma, prev_ma, phase FROM ph"),

    "p4_rise": _with(["ol"], """
SELECT price_date, price, prev_price, price - prev_price > 0 AS is_rise FROM ol"""),

    "p5_days": _with(["pairs"], """
SELECT CAST(datediff('day', event_date, response_date) AS INTEGER) AS response_days,
       count(*) AS n_pairs
FROM pairs WHERE response_date IS NOT NULL GROUP BY 1"""),

    "p6_delta": _with(["sl"], """
SELECT station_id, price_date, price - prev_price AS change,
       (price - prev_price) * 100.0 / nullif(prev_price, 0) AS pct_change FROM sl"""),

    "p7_unpivot": _with(["oil_price"], """
SELECT price_date, crude, price FROM (
  SELECT price_date, 'dubai' AS crude, dubai AS price FROM oil_price
  UNION ALL SELECT price_date, 'brent', brent FROM oil_price
  UNION ALL SELECT price_date, 'wti', wti FROM oil_price) AS u
WHERE price IS NOT NULL"""),

    "j1": _with(["hwr"], "SELECT * FROM hwr"),

    "j2": _with(["rental", "rental_station", "hc"], """
SELECT r.rental_id, r.rental_station_id AS station_id, m.station_name, hc.obs_datetime, hc.is_hot
FROM rental r JOIN hc ON date_trunc('hour', r.rental_time) = hc.obs_datetime
JOIN rental_station m ON m.station_id = r.rental_station_id"""),

    "j3": _with(["gas_price", "gas_station"], """
SELECT g.station_id, s.brand, g.price_date, g.price
FROM gas_price g JOIN gas_station s ON s.station_id = g.station_id"""),

    "j4": _with(["gas_price", "oil"], """
SELECT g.station_id, g.price_date, g.price, o.price AS oil_price
FROM gas_price g JOIN oil o ON o.price_date = g.price_date"""),

    "j5": _with(["pairs"], """
SELECT station_id, event_date, response_date,
       CAST(datediff('day', event_date, response_date) AS INTEGER) AS response_days
FROM pairs WHERE response_date IS NOT NULL"""),

    "j6": _with(["chg"], "SELECT * FROM chg"),

    "j7": _with(["dph"], "SELECT price_date, asof_date, phase, oil_price FROM dph"),

    "a3_cond": _with(["rental", "hc"], """
SELECT r.rental_station_id AS station_id, count(*) FILTER (WHERE hc.is_hot) AS hot_rentals,
       count(*) FILTER (WHERE NOT hc.is_hot) AS normal_rentals
FROM rental r JOIN hc ON date_trunc('hour', r.rental_time) = hc.obs_datetime GROUP BY 1"""),

    "a5_phase": _with(["chg"], """
SELECT phase, count(change) AS n_changes, avg(change) AS avg_change FROM chg GROUP BY 1"""),

    "a6_asym": _with(["ph"], """
, c AS (SELECT phase, oil_price - lag(oil_price) OVER (ORDER BY price_date) AS change FROM ph)
SELECT count(*) FILTER (WHERE phase = 'rising' AND change IS NOT NULL) AS n_rising,
       avg(change) FILTER (WHERE phase = 'rising') AS avg_change_rising,
       count(*) FILTER (WHERE phase = 'falling' AND change IS NOT NULL) AS n_falling,
       avg(change) FILTER (WHERE phase = 'falling') AS avg_change_falling,
       abs(avg(change) FILTER (WHERE phase = 'rising'))
         / nullif(abs(avg(change) FILTER (WHERE phase = 'falling')), 0) AS asymmetry
FROM c"""),

    "a7_rate": _with(["hc", "hourly"], """
SELECT CASE WHEN hc.is_hot THEN 'hot' ELSE 'normal' END AS hour_class, count(*) AS n_hours,
       CAST(coalesce(sum(h.n_rentals), 0) AS BIGINT) AS rentals,
       CAST(coalesce(sum(h.n_rentals), 0) AS DOUBLE) / count(*) AS rate
FROM hc LEFT JOIN hourly h ON h.obs_datetime = hc.obs_datetime GROUP BY hc.is_hot"""),

    "w1": _with(["ol"], """
SELECT price_date, price, prev_price, prev_price_date,
       CAST(datediff('day', prev_price_date, price_date) AS INTEGER) AS gap_days,
       price - prev_price AS change FROM ol"""),

    "w2": _with(["sl"], """
SELECT station_id, price_date, price, prev_price, prev_price_date,
       CAST(datediff('day', prev_price_date, price_date) AS INTEGER) AS gap_days,
       price - prev_price AS change FROM sl"""),

    "w3": _with(["oil"], """
SELECT price_date, price,
       CAST(sum(CAST(round(price * 1000000) AS BIGINT)) OVER r AS DOUBLE)
         / (CAST(count(price) OVER r AS DOUBLE) * 1000000) AS ma_rows,
       CAST(sum(CAST(round(price * 1000000) AS BIGINT)) OVER d AS DOUBLE)
         / (CAST(count(price) OVER d AS DOUBLE) * 1000000) AS ma_days
FROM oil WINDOW r AS (ORDER BY price_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                d AS (ORDER BY price_date RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW)"""),

    "l1": _with(["rental"], """
SELECT rental_station_id AS station_id, count(*) AS n_rentals FROM rental GROUP BY 1
ORDER BY n_rentals DESC, station_id ASC LIMIT 5"""),

    "x1": _with(["oil", "gas_price"], """
, daily AS (SELECT price_date, avg(price) AS station_price FROM gas_price GROUP BY 1)
, lags AS (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS lag_days)
SELECT l.lag_days, count(*) AS n_pairs, corr(o.price, d.station_price) AS corr
FROM oil o CROSS JOIN lags l JOIN daily d ON d.price_date = o.price_date + l.lag_days
GROUP BY 1"""),
}

# L2 ranks the 2-A rows; same rows as 2-A plus the rank.
ORACLE["l2"] = ORACLE["q2a"].replace(
    "SELECT sb.brand, sb.n_stations,",
    "SELECT CAST(row_number() OVER (ORDER BY CAST(pb.sum_days AS DOUBLE) / nullif(CAST(pb.n_responded AS DOUBLE), 0) ASC NULLS LAST, sb.brand) AS INTEGER) AS speed_rank,\n       sb.brand, sb.n_stations,")


def _q2a_for(crude: str) -> str:
    base = ORACLE["q2a"].replace(
        "SELECT price_date, dubai AS price FROM oil_price WHERE dubai IS NOT NULL",
        f"SELECT price_date, {crude} AS price FROM oil_price WHERE {crude} IS NOT NULL")
    return f"SELECT '{crude}' AS crude, x.* FROM ({base}) AS x"


# 2-A for each crude (P7): the same SQL per crude column.
ORACLE["q2a_crudes"] = "\nUNION ALL\n".join(_q2a_for(c) for c in ("dubai", "brent", "wti"))

ORACLE["t1_cumulative"] = """
WITH r AS (SELECT event_type AS station_id, CAST(ts AS DATE) AS d, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t,
                  CAST(round(max(value) * 1000000) AS BIGINT) AS u
           FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY event_type, ts),
p AS (SELECT station_id, t, u, coalesce(lag(t) OVER w, CAST(epoch(d) AS BIGINT)) AS t0, coalesce(lag(u) OVER w, 0) AS u0
      FROM r WINDOW w AS (PARTITION BY station_id, d ORDER BY t, u)),
q AS (SELECT station_id, t0, t, CASE WHEN u < u0 THEN u ELSE u - u0 END AS rise, u < u0 AS reset, t - t0 > 3600 AS far FROM p),
e AS (SELECT *, CASE WHEN far THEN t0 // 3600 ELSE t // 3600 END AS h0, CASE WHEN far THEN (t - 1) // 3600 ELSE t // 3600 END AS h1 FROM q),
h AS (SELECT *, unnest(range(h0, h1 + 1)) AS h FROM e),
s AS (SELECT *, CASE WHEN far THEN CAST(rise AS HUGEINT) * (least((h + 1) * 3600, t) - t0) // (t - t0)
                               - CAST(rise AS HUGEINT) * (greatest(h * 3600, t0) - t0) // (t - t0) ELSE rise END AS part FROM h)
SELECT station_id, make_timestamp(h * 3600000000) AS obs_datetime, CAST(sum(part) AS DOUBLE) / 1000000.0 AS precipitation,
       count(*) FILTER (reset AND h = h1) AS n_resets, bool_or(far) AS is_estimated
FROM s GROUP BY station_id, h
"""

ORACLE["t6_islands"] = """
WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error' AND ts IS NOT NULL),
c AS (SELECT h, coalesce(datediff('hour', lag(h) OVER (ORDER BY h), h) > 6, TRUE) AS cut FROM h),
i AS (SELECT h, sum(CAST(cut AS INT)) OVER (ORDER BY h) AS i FROM c)
SELECT CAST(min(h) AS TIMESTAMP) AS lo, CAST(max(h) AS TIMESTAMP) AS hi, datediff('hour', min(h), max(h)) + 1 AS n_hours, count(*) AS n_seen FROM i GROUP BY i
"""

_CURVE = """, w AS (SELECT brand, wait_days, count(*) FILTER (WHERE told) AS n_responded,
             count(*) FILTER (WHERE NOT told) AS n_censored FROM watched GROUP BY 1, 2)
, c AS (SELECT a.brand, a.wait_days, a.n_responded, a.n_censored,
               sum(b.n_responded + b.n_censored) AS n_at_risk
        FROM w a JOIN w b ON b.brand = a.brand AND b.wait_days >= a.wait_days GROUP BY ALL)
, km AS (SELECT a.brand, a.wait_days, a.n_at_risk, a.n_responded, a.n_censored,
                min(CASE WHEN b.n_at_risk = b.n_responded THEN 0 ELSE 1 END)
                  * exp(sum(CASE WHEN b.n_at_risk > b.n_responded
                                 THEN ln((b.n_at_risk - b.n_responded) / CAST(b.n_at_risk AS DOUBLE)) ELSE 0 END)) AS survival,
                sum(CASE WHEN b.n_at_risk > b.n_responded THEN b.n_responded
                      / (CAST(b.n_at_risk AS DOUBLE) * (b.n_at_risk - b.n_responded)) ELSE 0 END) AS var
         FROM c a JOIN c b ON b.brand = a.brand AND b.wait_days <= a.wait_days GROUP BY ALL)
"""
ORACLE["a4_curve"] = _with(["watched"], _CURVE + """
SELECT brand, CAST(wait_days AS INTEGER) AS wait_days, CAST(n_at_risk AS BIGINT) AS n_at_risk, n_responded, n_censored,
       survival, CASE WHEN survival > 0 THEN survival * sqrt(var) END AS std_error FROM km""")
ORACLE["a4_waits"] = _with(["watched"], _CURVE + """
, area AS (SELECT *, (wait_days - lag(wait_days, 1, 0) OVER o) * lag(survival, 1, CAST(1 AS DOUBLE)) OVER o AS part
           FROM km WINDOW o AS (PARTITION BY brand ORDER BY wait_days))
SELECT brand, CAST(sum(n_responded + n_censored) AS BIGINT) AS n_pairs, CAST(sum(n_responded) AS BIGINT) AS n_responded,
       CAST(sum(n_censored) AS BIGINT) AS n_censored, CAST(max(wait_days) AS INTEGER) AS longest_days,
       sum(part) AS mean_days, CAST(min(wait_days) FILTER (WHERE survival <= 0.500000001) AS INTEGER) AS median_days
FROM area GROUP BY brand""")
ORACLE["t3_versions"] = _with(["vers"], "SELECT station_id, brand, valid_from, valid_to FROM vers")
# The brand of a day by an ASOF join with the records themselves, not by the versions.
ORACLE["j3_dated"] = _with(["gas_price", "brand_days"], """
SELECT g.station_id, b.brand, g.price_date, g.price
FROM gas_price g ASOF JOIN brand_days b ON b.station_id = g.station_id AND g.price_date >= b.price_date""")
ORACLE["q2a_dated"] = _with(["pairs", "brand_days"], """
, f AS (SELECT station_id, arg_min(brand, price_date) AS brand FROM brand_days GROUP BY 1)
, pb AS (SELECT p.station_id, p.event_date, p.response_date, coalesce(b.brand, f.brand) AS brand
         FROM pairs p JOIN f ON f.station_id = p.station_id
         ASOF LEFT JOIN brand_days b ON b.station_id = p.station_id AND p.event_date >= b.price_date)
, a AS (SELECT brand, count(*) AS n_events, count(response_date) AS n_responded,
               sum(datediff('day', event_date, response_date)) AS sum_days FROM pb GROUP BY 1)
SELECT s.brand, s.n_stations, CAST(coalesce(a.n_events, 0) AS BIGINT) AS n_events,
       CAST(coalesce(a.n_responded, 0) AS BIGINT) AS n_responded,
       CAST(a.sum_days AS DOUBLE) / nullif(CAST(a.n_responded AS DOUBLE), 0) AS avg_days
FROM (SELECT brand, count(DISTINCT station_id) AS n_stations FROM brand_days GROUP BY 1) s
LEFT JOIN a ON a.brand = s.brand""")
