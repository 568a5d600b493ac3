"""The same rows in DuckDB's SQL, in a form of its own: DISTINCT ON, correlated laterals, FILTER, self-joins."""

from __future__ import annotations

from tidemark.plans.analog import DAYS, ETHANOL, GASOLINE, LEAST, TYPES

E_, G_ = TYPES[ETHANOL - 1], TYPES[GASOLINE - 1]
_NUMBER = "CASE {} " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " END"


def r(x: str, n: int) -> str:
    """Rounding with halves away from zero, after the noise beyond the ninth decimal is off."""
    return f"CAST(round(CAST({x} AS DECIMAL(24,9)), {n}) AS DOUBLE)"


def key(day: str) -> str:
    return f"CAST(isoyear({day}) * 100 + week({day}) AS INTEGER)"


_ROUND = {q: r(f"quantile_cont(CAST(p AS DOUBLE), {q})", 3) for q in (0.1, 0.5, 0.9)}

#: Observations, station versions, facts, the weekly rollup, and changes of brand.
BASE = f"""
ev AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 14, '0') AS cnpj, user_id, CAST(ts AS DATE) AS d, CAST(date_trunc('week', ts) AS DATE) AS wk, event_type, event_id, ts,
         CAST(value AS DECIMAL(8,3)) AS p, CAST({_NUMBER.format('event_type')} AS SMALLINT) AS product_key FROM events),
snap AS (
  SELECT DISTINCT ON (cnpj, wk) cnpj, user_id, wk, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS brand_key
  FROM ev ORDER BY cnpj, wk, ts, event_id),
mark AS (SELECT *, lag(brand_key) OVER (PARTITION BY cnpj ORDER BY wk) AS prior FROM snap),
st AS (
  SELECT cnpj, brand_key, CASE brand_key WHEN 1 THEN 'UNBRANDED' WHEN 2 THEN 'Y' ELSE 'X' END AS brand_name, wk AS valid_from,
         coalesce(lead(wk) OVER (PARTITION BY cnpj ORDER BY wk), DATE '9999-12-31') AS valid_to, c_name AS legal_name, n_nationkey AS city_key, n_name AS city_name, r_name AS uf
  FROM mark JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE prior IS NULL OR prior <> brand_key),
low AS (SELECT cnpj, product_key, event_type AS product_name, d, min(p) AS p FROM ev GROUP BY ALL),
fact AS (
  SELECT low.*, st.* EXCLUDE (cnpj), CAST(date_trunc('week', d) AS DATE) AS wk
  FROM low JOIN st ON st.cnpj = low.cnpj AND st.valid_from <= low.d AND st.valid_to > low.d),
weekly AS (
  SELECT {key('wk')} AS survey_week_key, wk AS week_start_date, city_key, city_name, uf, product_key, product_name, count(*) AS observations,
         count(DISTINCT (cnpj, valid_from)) AS stations, {_ROUND[0.1]} AS p10_price, {_ROUND[0.5]} AS median_price, {_ROUND[0.9]} AS p90_price,
         CAST(min(p) AS DOUBLE) AS min_price, CAST(max(p) AS DOUBLE) AS max_price, {r('avg(CAST(p AS DOUBLE))', 3)} AS avg_price
  FROM fact GROUP BY wk, city_key, city_name, uf, product_key, product_name),
chg AS (
  SELECT now.cnpj, was.brand_name AS brand_before, now.brand_name AS brand_after, now.valid_from AS changed_on, was.valid_from AS from_before, now.city_key AS city_after,
         CASE WHEN was.brand_key = 1 THEN 'bandeiramento' WHEN now.brand_key = 1 THEN 'desbandeiramento' ELSE 'troca de distribuidora' END AS change_type
  FROM st AS now JOIN st AS was ON was.cnpj = now.cnpj AND was.valid_to = now.valid_from AND was.brand_key <> now.brand_key)"""

_CASES = f"""
seen AS (
  SELECT chg.*, f.product_key, f.product_name, f.p, f.d, f.city_key, f.city_name, f.uf
  FROM chg JOIN fact f ON f.cnpj = chg.cnpj AND f.valid_from IN (chg.from_before, chg.changed_on) AND f.d >= chg.changed_on - {DAYS} AND f.d < chg.changed_on + {DAYS}),
cases AS (
  SELECT cnpj, change_type, brand_before, brand_after, changed_on, city_key, city_name, uf, product_key, product_name,
         avg(CAST(p AS DOUBLE)) FILTER (WHERE d < changed_on) AS price_before, avg(CAST(p AS DOUBLE)) FILTER (WHERE d >= changed_on) AS price_after,
         count(*) FILTER (WHERE d < changed_on) AS obs_before, count(*) FILTER (WHERE d >= changed_on) AS obs_after
  FROM seen GROUP BY ALL HAVING count(*) FILTER (WHERE d < changed_on) >= {LEAST} AND count(*) FILTER (WHERE d >= changed_on) >= {LEAST}),
effect AS (
  SELECT c.*, price_after - price_before AS station_change, m.market_change, price_after - price_before - m.market_change AS excess_change
  FROM cases c LEFT JOIN LATERAL (
    SELECT avg(median_price) FILTER (WHERE week_start_date >= c.changed_on) - avg(median_price) FILTER (WHERE week_start_date < c.changed_on) AS market_change
    FROM weekly w WHERE w.city_key = c.city_key AND w.product_key = c.product_key
      AND w.week_start_date >= c.changed_on - {DAYS} AND w.week_start_date < c.changed_on + {DAYS}) m ON true)"""


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join((BASE, *parts)) + "\n" + body


def _pair(*keys: str) -> str:
    k = ", ".join(keys)
    e, g = (f"max(median_price) FILTER (WHERE product_name = '{x}')" for x in (E_, G_))
    return f"""pair AS (SELECT {k}, {e} AS e, {g} AS g, min(stations) AS min_stations, CAST(sum(observations) AS BIGINT) AS observations
  FROM weekly WHERE product_name IN ('{E_}', '{G_}') GROUP BY {k} HAVING {e} IS NOT NULL AND {g} IS NOT NULL)"""


_SCOPE = """cover AS (SELECT week_start_date, count(*) AS cities FROM pair GROUP BY 1),
scope AS (SELECT * FROM cover WHERE week_start_date > (SELECT min(week_start_date) FROM cover) AND week_start_date < (SELECT max(week_start_date) FROM cover))"""
_BY_CITY = _pair("survey_week_key", "week_start_date", "city_key", "city_name", "uf")
_WIN = "e / g < 0.7"


def _mean(c: str, w: str) -> str:
    return r(f"sum({c} * {w}) / nullif(sum({w}), 0)", 3)


def _observed(where: str) -> str:
    return f"""SELECT week_start_date, uf, substr(uf, 1, 2) AS region, product_name, 'event' AS fuel_family, {_mean('median_price', 'observations')} AS weighted_mean_of_medians,
  {_mean('p10_price', 'observations')} AS p10_weighted, {_mean('p90_price', 'observations')} AS p90_weighted, CAST(sum(observations) AS BIGINT) AS observations,
  CAST(sum(stations) AS BIGINT) AS stations, count(DISTINCT city_key) AS cities
FROM weekly WHERE product_name <> 'error' {where} GROUP BY week_start_date, uf, product_name"""


_COVER = """SELECT survey_week_key, week_start_date, product_name, count(DISTINCT city_key) AS cities, CAST(sum(stations) AS BIGINT) AS stations, CAST(sum(observations) AS BIGINT) AS observations
FROM weekly GROUP BY 1, 2, 3"""
_SUMMARY = f"""count(*) AS cases, {r('avg(excess_change)', 4)} AS mean_effect, {r('quantile_cont(excess_change, 0.5)', 4)} AS median_effect, {r('stddev_samp(excess_change)', 4)} AS deviation,
  {r('stddev_samp(excess_change) / sqrt(count(*))', 4)} AS standard_error, count(*) FILTER (WHERE excess_change < 0) AS below_market,
  {r('100.0 * count(*) FILTER (WHERE excess_change < 0) / nullif(count(*), 0)', 1)} AS pct_below"""


def _placebo(copies: str) -> str:
    parts = f"""lent AS (SELECT {copies} city_after AS city_key, changed_on FROM chg WHERE change_type = 'desbandeiramento'),
stable AS (SELECT cnpj, min(city_key) AS city_key FROM st GROUP BY 1 HAVING count(*) = 1),
near AS (
  SELECT s.cnpj, l.changed_on, s.city_key, f.p, f.d FROM lent l JOIN stable s USING (city_key) JOIN fact f ON f.cnpj = s.cnpj
  WHERE f.product_name = '{G_}' AND f.d >= l.changed_on - {DAYS} AND f.d < l.changed_on + {DAYS}),
none AS (
  SELECT cnpj, changed_on, city_key, avg(CAST(p AS DOUBLE)) FILTER (WHERE d >= changed_on) - avg(CAST(p AS DOUBLE)) FILTER (WHERE d < changed_on) AS change
  FROM near GROUP BY ALL HAVING count(*) FILTER (WHERE d < changed_on) >= {LEAST} AND count(*) FILTER (WHERE d >= changed_on) >= {LEAST}),
measured AS (
  SELECT none.*, change - m.market_change AS excess_change FROM none LEFT JOIN LATERAL (
    SELECT avg(median_price) FILTER (WHERE week_start_date >= none.changed_on) - avg(median_price) FILTER (WHERE week_start_date < none.changed_on) AS market_change
    FROM weekly w WHERE w.city_key = none.city_key AND w.product_name = '{G_}'
      AND w.week_start_date >= none.changed_on - {DAYS} AND w.week_start_date < none.changed_on + {DAYS}) m ON true)"""
    rounded = f"(SELECT change_type, {r('excess_change', 3)} AS excess_change FROM effect WHERE product_name = '{G_}')"
    return _with(_CASES, parts, body=f"""SELECT 'placebo' AS "group", {_SUMMARY} FROM measured UNION ALL SELECT 'event (' || change_type || ')', {_SUMMARY} FROM {rounded} GROUP BY change_type""")


#: Raw survey rows as the events give them, cleaned step by step.
_RAW = """raw AS (
  SELECT CAST(event_id + 2 AS INTEGER) AS line_number, event_id % 61 = 8 AS blank, CASE WHEN event_id % 31 = 5 THEN 'S1' ELSE ' sp ' END AS uf_raw,
    'CITY  ' || user_id % 25 AS city_raw, CASE WHEN event_id % 37 = 3 THEN '  ' ELSE ' posto   ' || user_id END AS name_raw,
    CASE WHEN event_id % 41 = 7 THEN NULL WHEN event_id % 43 = 9 THEN '12.3' ELSE lpad(CAST(user_id AS VARCHAR), 14, '0') END AS cnpj_raw,
    CASE WHEN event_id % 3 = 0 THEN '01310100' END AS zip_code, upper(event_type) AS product_raw,
    CASE WHEN event_id % 47 = 1 THEN NULL WHEN event_id % 53 = 2 THEN DATE '2019-03-15' ELSE CAST(ts AS DATE) END AS d,
    CASE WHEN event_id % 59 <> 4 THEN CAST(value AS DECIMAL(12,2)) END AS p,
    CASE event_id % 5 WHEN 0 THEN 'VIBRA' WHEN 1 THEN 'BRANCA' WHEN 2 THEN 'NÃO INFORMADA' ELSE 'NOVO ' || user_id % 3 END AS brand_name, event_type,
    regexp_replace(lpad(CAST(user_id AS VARCHAR), 14, '0'), '^(.{8})(.{6})$', '\\1/\\2') AS masked FROM events),
judged AS (
  SELECT *, CASE WHEN blank THEN 'empty_row' WHEN cnpj_raw IS NULL THEN 'cnpj_missing' WHEN cnpj_raw = '12.3' THEN 'cnpj_length' WHEN d IS NULL THEN 'date_unparseable'
    WHEN d < DATE '2023-01-01' THEN 'date_out_of_calendar' WHEN p IS NULL THEN 'price_unparseable' WHEN p <= 0 OR p > 50 THEN 'price_out_of_range'
    WHEN event_type = 'click' THEN 'product_unknown' WHEN uf_raw = 'S1' THEN 'uf_invalid' WHEN trim(name_raw) = '' THEN 'legal_name_empty' END AS reject_rule FROM raw),
good AS (SELECT * FROM judged WHERE reject_rule IS NULL)"""


def _raw(body: str) -> str:
    return f"WITH {_RAW}\n{body}"


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem"
_GAPS = f"SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT price) AS values, CAST(max(price) - min(price) AS DOUBLE) AS gap FROM ({_LINES}) GROUP BY 1, 2 HAVING count(*) > 1"


def _grain(name: str, at: str) -> str:
    return f"""SELECT '{name}' AS grain, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS repeated, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows,
  count(*) FILTER (WHERE low < high) AS divergent FROM (SELECT user_id, event_type, {at}, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL)"""


def _profile(column: str, value: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS missing, count(DISTINCT v) AS "distinct", min(v) AS least, max(v) AS highest
FROM (SELECT nullif(trim(CASE WHEN NOT blank THEN {value} END), '') AS v FROM raw)"""


_BRAND_RAW = "CASE event_id % 5 WHEN 0 THEN 'vibra  energia' WHEN 1 THEN 'BRANCA' WHEN 2 THEN NULL ELSE 'novo ' || user_id % 3 END"
_DOMINANT = """SELECT o_custkey, o_orderpriority FROM (
  SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders WHERE o_orderdate {} GROUP BY 1, 2) WHERE k = 1"""

SQL: dict[str, str] = {
    "weekly_rollup": _with(body="""SELECT survey_week_key, week_start_date, survey_week_key // 100 AS iso_year, CAST(date_trunc('month', week_start_date) AS DATE) AS month_start_date, city_key,
  product_key, observations, stations, p10_price, median_price, p90_price, min_price, max_price, avg_price FROM weekly"""),
    "weekly_median_by_region": _with(body=f"""SELECT {key('wk')} AS survey_week_key, wk AS week_start_date, uf, {r('quantile_cont(CAST(p AS DOUBLE), 0.5)', 4)} AS median_price, count(*) AS observations,
  count(DISTINCT (cnpj, valid_from)) AS stations FROM fact WHERE product_name = '{G_}' AND d >= DATE '2024-01-08' GROUP BY wk, uf"""),
    "weighted_series_stations": _with(body=f"""SELECT survey_week_key, week_start_date, substr(uf, 1, 2) AS region, uf, product_name, CAST(sum(observations) AS BIGINT) AS observations,
  CAST(sum(stations) AS BIGINT) AS stations, {_mean('median_price', 'stations')} AS median_price FROM weekly GROUP BY survey_week_key, week_start_date, uf, product_name"""),
    "weighted_series_observations": _with(body=_observed("")),
    "weighted_series_trimmed": _with(_BY_CITY, _SCOPE, body=_observed("AND EXISTS (SELECT 1 FROM scope WHERE scope.week_start_date = weekly.week_start_date)")),
    "weekly_change": _with(body=f"""SELECT survey_week_key, week_start_date, uf, city_name, product_name, median_price, previous_price, {r('median_price - previous_price', 3)} AS change_value,
  {r('100 * (median_price / nullif(previous_price, 0) - 1)', 2)} AS change_pct, stations
FROM (SELECT *, lag(median_price) OVER (PARTITION BY city_key, product_key ORDER BY survey_week_key) AS previous_price FROM weekly)"""),
    "dispersion_floor": _with(body=f"""SELECT survey_week_key, week_start_date, uf, city_name, product_name, p10_price, median_price, p90_price, {r('p90_price - p10_price', 3)} AS spread_value,
  {r('100 * (p90_price - p10_price) / nullif(median_price, 0)', 2)} AS spread_pct, stations FROM weekly WHERE stations >= 3"""),
    "dispersion_topk": _with(body=f"""SELECT uf, city_name, survey_week_key, {r('hi', 3)} AS p90, {r('lo', 3)} AS p10, {r('hi - lo', 3)} AS spread, stations FROM (
  SELECT uf, city_name, {key('wk')} AS survey_week_key, quantile_cont(CAST(p AS DOUBLE), 0.9) AS hi, quantile_cont(CAST(p AS DOUBLE), 0.1) AS lo, count(DISTINCT (cnpj, valid_from)) AS stations
  FROM fact WHERE product_name = '{G_}' AND d >= DATE '2024-01-01' AND d < DATE '2024-02-01' GROUP BY uf, city_name, wk)
WHERE stations >= 2 ORDER BY spread DESC, uf, city_name, survey_week_key LIMIT 50"""),
    "parity_weekly": _with(_BY_CITY, body=f"""SELECT survey_week_key, week_start_date, uf, city_name, e AS ethanol_price, g AS gasoline_price, {r('e / g', 4)} AS parity_ratio, {_WIN} AS ethanol_wins, min_stations FROM pair"""),
    "parity_base": _with(_BY_CITY, body=f"SELECT week_start_date, city_key, e AS ethanol_price, g AS gasoline_price, {r('e / g', 4)} AS parity_ratio, observations FROM pair"),
    "edge_trim": _with(_BY_CITY, _SCOPE, body="SELECT * FROM scope"),
    "parity_edge_trimmed": _with(_BY_CITY, _SCOPE, body=f"SELECT week_start_date, city_key, e AS ethanol_price, g AS gasoline_price, {r('e / g', 4)} AS parity_ratio, observations, cities FROM pair JOIN scope USING (week_start_date)"),
    "parity_monthly_two_level": _with(body=f"""SELECT uf, city_name, month_start_date, {r('e', 3)} AS ethanol, {r('g', 3)} AS gasoline, {r('e / g', 4)} AS parity, {_WIN} AS ethanol_wins FROM (
  SELECT uf, city_name, month_start_date, max(v) FILTER (WHERE product_name = '{E_}') AS e, max(v) FILTER (WHERE product_name = '{G_}') AS g FROM (
    SELECT uf, city_name, CAST(date_trunc('month', d) AS DATE) AS month_start_date, product_name, avg(CAST(p AS DOUBLE)) AS v FROM fact WHERE product_name IN ('{E_}', '{G_}') GROUP BY ALL)
  GROUP BY 1, 2, 3) WHERE e IS NOT NULL AND g IS NOT NULL"""),
    "parity_share_by_region": _with(_BY_CITY, body=f"SELECT uf, count(*) AS city_weeks, count(*) FILTER (WHERE {_WIN}) AS wins, {r(f'100.0 * count(*) FILTER (WHERE {_WIN}) / count(*)', 1)} AS pct_wins FROM pair GROUP BY uf"),
    "coverage": _with(body=_COVER),
    "coverage_drop": _with(body=f"SELECT survey_week_key, product_name, cities, lag(cities) OVER w AS previous_cities, cities - lag(cities) OVER w AS change FROM ({_COVER}) WINDOW w AS (PARTITION BY product_name ORDER BY survey_week_key)"),
    "series_all": _with(body=f"SELECT {key('wk')} AS survey_week_key, {_ROUND[0.5]} AS median_price FROM fact WHERE product_name = '{G_}' GROUP BY wk"),
    "distinct_on_min_price": _with(body="SELECT DISTINCT ON (cnpj, product_key, d) cnpj, product_key, d AS collection_date, CAST(p AS DOUBLE) AS sale_price FROM ev ORDER BY cnpj, product_key, d, p"),
    "scd2_versions": _with(body="SELECT cnpj, brand_key, city_key, valid_from, valid_to, valid_to = DATE '9999-12-31' AS is_current FROM st"),
    "scd2_current": _with(body="SELECT cnpj, legal_name, brand_name, city_name, uf, valid_from FROM st WHERE valid_to = DATE '9999-12-31'"),
    "scd2_adjacent_changes": _with(body="SELECT cnpj, brand_before, brand_after, changed_on, change_type FROM chg"),
    "change_type_counts": _with(body="SELECT change_type, count(*) AS changes, count(DISTINCT cnpj) AS stations FROM chg GROUP BY 1"),
    "asof_fact_join": _with(body="SELECT cnpj, product_key, d AS collection_date, CAST(p AS DOUBLE) AS sale_price, brand_key, valid_from, year(d) || 'q' || quarter(d) AS quarter FROM fact"),
    "flat_observation": _with(body=f"""SELECT d AS collection_date, {key('d')} AS survey_week_key, wk AS week_start_date, CAST(date_trunc('month', d) AS DATE) AS month_start_date, CAST(isoyear(d) AS INTEGER) AS iso_year,
  product_name, 'event' AS fuel_family, '1' AS unit_of_measure, substr(uf, 1, 2) AS region, uf, city_name, brand_name, brand_key = 1 AS is_unbranded, cnpj, legal_name,
  CAST(NULL AS VARCHAR) AS district, CAST(p AS DOUBLE) AS sale_price FROM fact"""),
    "brand_timeline": _with(body="""SELECT b.brand_name, count(DISTINCT cnpj) AS stations, min(valid_from) AS first_version, max(valid_from) AS last_version, count(*) FILTER (WHERE valid_to = DATE '9999-12-31') AS current_stations
FROM (VALUES ('UNBRANDED'), ('X'), ('Y')) b(brand_name) LEFT JOIN st USING (brand_name) GROUP BY 1"""),
    "event_effect": _with(_CASES, body=f"""SELECT cnpj, change_type, brand_before, brand_after, changed_on, uf, city_name, product_name, {r('price_before', 3)} AS price_before, {r('price_after', 3)} AS price_after,
  {r('station_change', 3)} AS station_change, {r('market_change', 3)} AS market_change, {r('excess_change', 3)} AS excess_change, obs_before, obs_after FROM effect"""),
    "event_summary": _with(_CASES, body=f"""SELECT count(*) AS stations, {r('avg(a - b)', 4)} AS mean_change, {r('quantile_cont(a - b, 0.5)', 4)} AS median_change, count(*) FILTER (WHERE a < b) AS fell, count(*) FILTER (WHERE a > b) AS rose FROM (
  SELECT cnpj, city_key, avg(CAST(p AS DOUBLE)) FILTER (WHERE d < changed_on) AS b, avg(CAST(p AS DOUBLE)) FILTER (WHERE d >= changed_on) AS a FROM seen
  WHERE product_name = '{G_}' AND change_type = 'desbandeiramento' AND changed_on >= DATE '2024-01-01' AND changed_on < DATE '2024-02-01' GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE d < changed_on) >= {LEAST} AND count(*) FILTER (WHERE d >= changed_on) >= {LEAST})"""),
    "event_by_brand_t": _with(_CASES, body=f"""SELECT brand_before, brand_after, count(x) AS cases, {r('avg(x)', 4)} AS mean_effect, {r('stddev_samp(x) / sqrt(count(x))', 4)} AS standard_error,
  {r('avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0)', 3)} AS t FROM (SELECT brand_before, brand_after, {r('excess_change', 3)} AS x FROM effect) GROUP BY 1, 2 HAVING count(x) >= 10"""),
    "placebo_vs_event": _placebo("DISTINCT"),
    "placebo_pairs_kept": _placebo(""),
    "city_semi_join": _with(body="SELECT n_nationkey AS city_key, n_name AS city_name, r_name AS uf, substr(r_name, 1, 2) AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE EXISTS (SELECT 1 FROM weekly WHERE weekly.city_key = n_nationkey)"),
    "unused_brand_anti_join": _with(body="SELECT brand_name FROM (VALUES ('UNBRANDED', 1), ('Y', 2), ('X', 3)) b(brand_name, k) WHERE NOT EXISTS (SELECT 1 FROM st WHERE brand_key = k AND valid_to = DATE '9999-12-31')"),
    "clean_normalise": _raw(f"""SELECT line_number, cnpj_raw AS cnpj, d AS collection_date, CAST(p AS DOUBLE) AS sale_price, upper(trim(regexp_replace(name_raw, '\\s+', ' ', 'g'))) AS legal_name,
  regexp_replace(city_raw, ' +', ' ') AS city_name, 'SP' AS uf, 'SE' AS region, 'RUA A' AS street, zip_code, CAST({_NUMBER.format('event_type')} AS SMALLINT) AS product_key FROM good"""),
    "reject_classification": _raw("SELECT line_number, reject_rule FROM judged"),
    "reject_summary": _raw("SELECT '2023-01' AS half_year, reject_rule AS rule_name, count(*) AS rejects FROM judged WHERE reject_rule IS NOT NULL GROUP BY 2"),
    "reject_samples": _raw("""SELECT reject_rule AS rule_name, count(*) AS rejects, least(count(*), 5) AS samples, min('cnpj=' || coalesce(CASE WHEN NOT blank THEN CASE WHEN cnpj_raw = '12.3' THEN '12.3' WHEN cnpj_raw IS NOT NULL THEN masked END END, '')
  || ' date=' || coalesce(CASE WHEN NOT blank THEN CASE WHEN d IS NULL THEN '31/02/2024' ELSE strftime(d, '%d/%m/%Y') END END, '')
  || ' price=' || coalesce(CASE WHEN NOT blank THEN CASE WHEN p IS NULL THEN '1.234,56' ELSE replace(CAST(p AS VARCHAR), '.', ',') END END, '')
  || ' product=' || CASE WHEN NOT blank THEN product_raw ELSE '' END || ' uf=' || CASE WHEN NOT blank THEN uf_raw ELSE '' END) AS least_detail
FROM judged WHERE reject_rule IS NOT NULL GROUP BY 1"""),
    "reconciliation": _raw("""SELECT 1 AS source_file_id, s AS staged, x AS rejected, f AS facts, s - x - f AS merged FROM (
  SELECT (SELECT count(*) FROM judged) AS s, (SELECT count(*) FROM judged WHERE reject_rule IS NOT NULL) AS x, (SELECT count(*) FROM (SELECT DISTINCT cnpj_raw, event_type, d FROM good)) AS f)"""),
    "brand_resolution": _raw("SELECT brand_name, brand_name = 'BRANCA' AS is_unbranded, brand_name LIKE 'NOVO%' AS needs_review, count(*) AS rows FROM good GROUP BY 1, 2, 3"),
    "city_resolution": _raw("SELECT regexp_replace(city_raw, ' +', ' ') AS city_name, 'SP' AS uf, 'SE' AS region, count(*) AS rows FROM good GROUP BY 1"),
    "brands_to_review": _raw("SELECT DISTINCT brand_name FROM good WHERE brand_name LIKE 'NOVO%'"),
    "partition_health": _with(body="SELECT year(d) || 'q' || quarter(d) AS quarter, count(*) AS rows, min(d) AS first_day, max(d) AS last_day, CAST(1 AS BIGINT) AS files, false AS is_anomalous FROM fact GROUP BY 1"),
    "versions_by_year": _with(body="SELECT CAST(year(valid_from) AS INTEGER) AS year, count(*) AS versions, count(DISTINCT cnpj) AS stations FROM st GROUP BY 1"),
    "calendar_dim": f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
  ['janeiro', 'fevereiro', 'março', 'abril', 'maio', 'junho', 'julho', 'agosto', 'setembro', 'outubro', 'novembro', 'dezembro'][month(d)] AS month_name, CAST(day(d) AS INTEGER) AS day,
  CAST(isodow(d) AS INTEGER) AS iso_day_of_week, ['segunda', 'terça', 'quarta', 'quinta', 'sexta', 'sábado', 'domingo'][isodow(d)] AS day_name, isodow(d) >= 6 AS is_weekend,
  CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(week(d) AS INTEGER) AS iso_week, {key('d')} AS survey_week_key, CAST(date_trunc('week', d) AS DATE) AS week_start_date, CAST(date_trunc('month', d) AS DATE) AS month_start_date
FROM (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2027-12-31', INTERVAL 1 DAY)) AS DATE) AS d)""",
    "duplicate_audit": _GAPS,
    "duplicate_gaps": f"SELECT count(*) AS groups, count(*) FILTER (WHERE gap = 0) AS identical, {r('min(gap) FILTER (WHERE gap > 0)', 4)} AS least_gap, {r('quantile_cont(gap, 0.5) FILTER (WHERE gap > 0)', 4)} AS median_gap, {r('max(gap)', 4)} AS greatest_gap FROM ({_GAPS})",
    "grain_check": _grain("day", "CAST(ts AS DATE)") + "\nUNION ALL\n" + _grain("week", "date_trunc('week', ts)"),
    "weekday_histogram": "SELECT CAST(isodow(o_orderdate) AS INTEGER) AS iso_day_of_week, count(*) AS rows FROM orders GROUP BY 1",
    "month_histogram": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start_date, count(*) AS rows FROM orders GROUP BY 1",
    "keys_in_many_places": "SELECT l_suppkey, count(DISTINCT l_partkey) AS places FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1",
    "dominant_transition_matrix": f"""SELECT a.o_orderpriority AS before, b.o_orderpriority AS after, count(*) AS keys
FROM ({_DOMINANT.format("< DATE '1998-01-01'")}) a JOIN ({_DOMINANT.format(">= DATE '1998-01-01'")}) b USING (o_custkey) GROUP BY 1, 2""",
    "attribute_changes": "\nUNION ALL\n".join(f"SELECT '{c}' AS attribute, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS changing FROM (SELECT o_custkey, count(DISTINCT {c}) AS n FROM orders GROUP BY 1)" for c in ("o_orderstatus", "o_orderpriority")),
    "source_profile": f"WITH raw AS (SELECT *, event_id % 61 = 8 AS blank FROM events)\n" + "\nUNION ALL\n".join((
        _profile("estado_sigla", "CASE WHEN event_id % 31 = 5 THEN 'S1' ELSE ' sp ' END"),
        _profile("cnpj_da_revenda", "CASE WHEN event_id % 41 = 7 THEN NULL WHEN event_id % 43 = 9 THEN '12.3' ELSE substr(lpad(CAST(user_id AS VARCHAR), 14, '0'), 1, 8) || '/' || substr(lpad(CAST(user_id AS VARCHAR), 14, '0'), 9) END"),
        _profile("produto", "upper(event_type)"), _profile("bandeira", _BRAND_RAW), _profile("cep", "CASE WHEN event_id % 3 = 0 THEN '01310-100' ELSE '123' END"))),
    "missing_fields": f"""SELECT count(*) AS rows, count(*) FILTER (WHERE blank OR event_id % 37 = 3) AS revenda, count(*) FILTER (WHERE blank) AS produto, count(*) FILTER (WHERE blank OR event_id % 5 = 2) AS bandeira
FROM (SELECT *, event_id % 61 = 8 AS blank FROM events) WHERE blank OR event_id % 41 = 7""",
    "overlapping_versions": _with(body="SELECT a.cnpj, a.valid_from FROM st a JOIN st b ON a.cnpj = b.cnpj AND b.valid_from < a.valid_from AND b.valid_to > a.valid_from"),
    "repeated_grain": _with(body="SELECT cnpj, product_key, d AS collection_date, count(*) AS times FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "dangling_keys": "SELECT k AS l_partkey, count(*) AS rows FROM (SELECT CASE WHEN l_orderkey % 97 = 3 THEN -l_partkey ELSE l_partkey END AS k FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k) GROUP BY 1",
    "order_value_by_region": f"""SELECT r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, {r('quantile_cont(o_totalprice, 0.5)', 2)} AS median_value, count(*) AS orders
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""",
}

#: Lines of the synthesised file, judged with the malformed ones first; station versions and facts of what is good.
_FILE = f"""{_RAW},
lines AS (SELECT * REPLACE (CASE WHEN (line_number - 2) % 67 = 11 THEN 'field_count' ELSE reject_rule END AS reject_rule) FROM judged),
fine AS (SELECT cnpj_raw AS cnpj, d, p, line_number, brand_name, zip_code, upper(trim(regexp_replace(name_raw, '\\s+', ' ', 'g'))) AS legal_name, regexp_replace(city_raw, ' +', ' ') AS city_name,
  CAST({_NUMBER.format('event_type')} AS SMALLINT) AS product_key FROM lines WHERE reject_rule IS NULL),
day AS (SELECT DISTINCT ON (cnpj, d) * FROM fine ORDER BY cnpj, d, line_number),
step AS (SELECT *, lag(d) OVER w IS NULL OR legal_name IS DISTINCT FROM lag(legal_name) OVER w OR brand_name IS DISTINCT FROM lag(brand_name) OVER w OR city_name IS DISTINCT FROM lag(city_name) OVER w
  OR zip_code IS DISTINCT FROM lag(zip_code) OVER w AS opens FROM day WINDOW w AS (PARTITION BY cnpj ORDER BY d)),
span AS (SELECT cnpj, legal_name, brand_name, city_name, zip_code, d AS valid_from, coalesce(lead(d) OVER (PARTITION BY cnpj ORDER BY d), DATE '9999-12-31') AS valid_to FROM step WHERE opens),
stored AS (
  SELECT l.*, s.valid_from, s.city_name FROM (SELECT cnpj, product_key, d, min(p) AS p FROM fine GROUP BY ALL) l JOIN span s ON s.cnpj = l.cnpj AND s.valid_from <= l.d AND l.d < s.valid_to)"""
_LEDGER = """ledger AS (
  SELECT o_orderkey AS run_id, CAST(o_custkey % 9 + 1 AS INTEGER) AS source_file_id, o_orderpriority AS stage, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'failed' END AS status,
    CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 50 * 60 END AS seconds, o_orderkey % 5 * 100 AS rows_in, o_orderkey % 5 * 10 + o_orderkey % 3 AS rows_rejected FROM orders)"""
_HALVES = "(VALUES (1, '2023-01'), (2, '2023-02'), (3, '2024-01'), (4, '2024-02'), (5, '2025-01'), (6, '2025-02'), (7, '2026-01')) c(source_file_id, half_year)"
_SPOILT = """s AS (
  SELECT cnpj, CAST(cnpj AS BIGINT) AS n, CASE WHEN CAST(cnpj AS BIGINT) % 13 = 4 THEN substr(cnpj, 2) ELSE cnpj END AS spoilt_cnpj, valid_from, city_key, CASE WHEN CAST(cnpj AS BIGINT) % 11 = 3 THEN 99 ELSE brand_key END AS brand,
    CASE WHEN valid_to = DATE '9999-12-31' THEN valid_to WHEN CAST(cnpj AS BIGINT) % 5 = 0 THEN valid_to + 7 WHEN CAST(cnpj AS BIGINT) % 5 = 1 THEN DATE '9999-12-31' ELSE valid_to END AS valid_to,
    valid_to = DATE '9999-12-31' OR CAST(cnpj AS BIGINT) % 7 = 2 AS is_current FROM st),
f AS (
  SELECT user_id AS n, product_key, CASE WHEN user_id % 17 = 5 THEN 0 ELSE p END AS p, CASE WHEN user_id % 23 = 7 THEN DATE '2024-01-09' ELSE d END AS d
  FROM (SELECT CAST(cnpj AS BIGINT) AS user_id, product_key, p, d FROM fact))"""


def _count(rule: str, source: str) -> str:
    return f"SELECT '{rule}' AS rule, (SELECT count(*) FROM {source}) AS rows"


#: Rows of both files that have all their fields.
_BOTH = f"""base AS (
  SELECT event_id AS n, user_id, ts, event_id % 61 = 8 AS blank, lpad(CAST(user_id AS VARCHAR), 14, '0') AS id, upper(event_type) AS product, {_BRAND_RAW} AS brand, CASE WHEN event_id % 3 = 0 THEN '01310-100' ELSE '123' END AS cep,
    CASE WHEN event_id % 37 = 3 THEN '' ELSE 'POSTO   ' || user_id END AS name, CASE WHEN event_id % 47 = 1 THEN '2024-02-31' WHEN event_id % 53 = 2 THEN '2019-03-15' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events WHERE event_id % 67 <> 11),
whole AS (SELECT *, CASE WHEN NOT blank THEN CASE WHEN n % 41 = 7 THEN NULL WHEN n % 43 = 9 THEN '12.3' ELSE substr(id, 1, 8) || '/' || substr(id, 9) END END AS cnpj FROM base),
src AS (
  SELECT 1 AS file, n, cnpj, CASE WHEN NOT blank THEN product END AS product, CASE WHEN NOT blank THEN brand END AS brand, CASE WHEN NOT blank THEN cep END AS cep, blank, name, CASE WHEN NOT blank THEN day END AS day FROM whole
  UNION ALL
  SELECT 2, n, cnpj, CASE WHEN n % 13 = 5 THEN '??' WHEN NOT blank THEN product END, CASE WHEN n % 11 = 4 THEN 'BRANCA' WHEN NOT blank THEN brand END, CASE WHEN NOT blank THEN cep END, blank, name,
    CASE WHEN n % 17 = 2 AND cnpj IS NOT NULL THEN '2024-02-05' WHEN NOT blank THEN day END
  FROM whole WHERE n % 19 <> 6 AND n % 23 <> 7)"""


def _sketched(name: str, column: str) -> str:
    return f"SELECT '{name}' AS column, count(*) AS rows, count(*) - count({column}) AS missing, count(DISTINCT {column}) AS distinct_values, min({column}) AS least, max({column}) AS highest FROM src"


def _changing(name: str, column: str) -> str:
    return f"SELECT '{name}' AS attribute, count(*) AS entities, count(*) FILTER (WHERE files = 2) AS in_all, count(*) FILTER (WHERE files = 2 AND {column} > 1) AS changing FROM per"


SQL |= {
    "profile_columns": f"WITH {_BOTH}\n" + "\nUNION ALL\n".join((_sketched("cnpj_da_revenda", "cnpj"), _sketched("produto", "product"), _sketched("bandeira", "brand"), _sketched("cep", "cep"), _sketched("valor_de_compra", "CAST(NULL AS VARCHAR)"))),
    "profile_values": f"""WITH {_BOTH}
SELECT 'produto' AS column, product AS value, count(*) AS rows FROM src WHERE product IS NOT NULL GROUP BY 2
UNION ALL SELECT 'unidade_de_medida', 'R$ / litro', count(*) FROM src WHERE NOT blank
UNION ALL SELECT 'estado_sigla', CASE WHEN n % 31 = 5 THEN 'S1' ELSE 'sp' END, count(*) FROM src WHERE NOT blank GROUP BY 2""",
    "profile_changes": f"""WITH {_BOTH},
per AS (
  SELECT regexp_replace(cnpj, '[^0-9]', '', 'g') AS id, count(DISTINCT file) AS files, count(DISTINCT upper(trim(coalesce(brand, '')))) AS brands, count(DISTINCT name) AS names, count(DISTINCT cep) AS ceps FROM src WHERE cnpj IS NOT NULL GROUP BY 1)
""" + "\nUNION ALL\n".join((_changing("brand", "brands"), _changing("name", "names"), _changing("address", "ceps"))),
    "profile_files": f"""WITH {_BOTH}
SELECT CAST(file AS INTEGER) AS file, 'utf-8-sig' AS encoding, ';' AS delimiter, CAST(16 AS INTEGER) AS columns, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(cnpj, '[./-]')) AS masked, min(day) AS first_day, max(day) AS last_day
FROM src GROUP BY 1, 2, 3, 4""",
    "file_ingest": f"WITH {_FILE}\nSELECT line_number, reject_rule, CASE WHEN reject_rule IS NULL THEN cnpj_raw END AS cnpj, CASE WHEN reject_rule IS NULL THEN CAST(p AS DOUBLE) END AS sale_price FROM lines",
    "file_header": "SELECT CAST(row_number() OVER () AS INTEGER) AS place, name FROM (SELECT unnest(string_split('regiao_sigla estado_sigla municipio revenda cnpj_da_revenda nome_da_rua numero_rua complemento bairro cep produto data_da_coleta valor_de_venda valor_de_compra unidade_de_medida bandeira', ' ')) AS name)",
    "warehouse_stations": f"""WITH {_FILE}
SELECT cnpj, legal_name, brand_name, zip_code, valid_from, valid_to, valid_to = DATE '9999-12-31' AS is_current, CAST(1 AS INTEGER) AS first_seen_file, CAST(1 AS INTEGER) AS last_seen_file, true AS hash_holds FROM span""",
    "warehouse_facts": f"WITH {_FILE}\nSELECT cnpj, product_key, d AS collection_date, CAST(p AS DOUBLE) AS sale_price, year(d) || 'q' || quarter(d) AS quarter, valid_from FROM stored",
    "warehouse_rollup": f"""WITH {_FILE}
SELECT {key('d')} AS survey_week_key, city_name, product_key, count(*) AS observations, {_ROUND[0.5]} AS median_price FROM stored GROUP BY 1, 2, 3""",
    "warehouse_catalog": f"""WITH {_FILE},
n AS (SELECT count(*) AS rows_in, count(*) FILTER (WHERE reject_rule IS NOT NULL) AS rejected FROM lines),
runs AS (
  SELECT 1 AS source_file_id, 'read' AS stage, rows_in, CAST(NULL AS BIGINT) AS rows_rejected FROM n UNION ALL SELECT 1, 'validate', rows_in, rejected FROM n
  UNION ALL SELECT 1, 'stations', NULL, NULL UNION ALL SELECT 1, 'facts', rows_in - rejected, NULL FROM n)
SELECT half_year, CASE WHEN stage IS NULL THEN 'pending' ELSE 'loaded' END AS status, stage, CASE WHEN stage IS NOT NULL THEN 'done' END AS run_status, rows_in, rows_rejected, CAST(CASE WHEN stage IS NOT NULL THEN 64 END AS INTEGER) AS sha256_chars
FROM {_HALVES} LEFT JOIN runs USING (source_file_id)""",
    "load_health": f"""WITH {_LEDGER}
SELECT run_id, half_year, stage, status, strftime(started_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo', '%Y-%m-%d %H:%M:%S') AS started_local, seconds, rows_in, rows_rejected, {r('100.0 * rows_rejected / nullif(rows_in, 0)', 2)} AS pct_rejected
FROM ledger LEFT JOIN {_HALVES} USING (source_file_id)""",
    "stuck_runs": f"""WITH {_LEDGER}
SELECT run_id, source_file_id, stage, date_diff('second', started_at, TIMESTAMP '1998-08-02 12:00:00') // 60 AS minutes FROM ledger WHERE status = 'running' AND date_diff('second', started_at, TIMESTAMP '1998-08-02 12:00:00') > 1800""",
    "station_lookup": _with(body="SELECT cnpj, brand_key, valid_from, valid_to FROM st WHERE cnpj = '00000000000007' AND valid_from <= DATE '2024-01-16' AND valid_to > DATE '2024-01-16'"),
    "brand_merge": _with(body="""SELECT CASE WHEN b = 1 THEN 'UNBRANDED' ELSE 'X' END AS brand_name, CAST(CASE WHEN b = 1 THEN 1 ELSE 2 END AS BIGINT) AS aliases, CAST(CASE WHEN b = 1 THEN 0 ELSE 1 END AS BIGINT) AS renames,
  (SELECT count(*) FROM st WHERE (brand_key = 1) = (b = 1)) AS versions FROM (VALUES (1), (3)) v(b)"""),
    "brand_review": "SELECT * FROM (VALUES ('UNBRANDED', true, false), ('Y', false, false), ('X', false, true)) b(brand_name, needs_review, is_reviewed)",
    "version_least": """WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderstatus) AS s, min(o_orderpriority) AS p FROM orders GROUP BY 1, 2),
m AS (SELECT *, s IS DISTINCT FROM lag(s) OVER (PARTITION BY o_custkey ORDER BY day) AS opens FROM d),
i AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM m)
SELECT o_custkey, state, priority, valid_from, coalesce(lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from), DATE '9999-12-31') AS valid_to
FROM (SELECT o_custkey, island, min(s) AS state, min(p) AS priority, min(day) AS valid_from FROM i GROUP BY 1, 2)""",
    "fact_append": _with(body="SELECT product_key, year(d) || 'q' || quarter(d) AS quarter, count(*) AS added FROM low WHERE d >= DATE '2024-01-21' GROUP BY 1, 2"),
    "reload_changes": f"""WITH {_FILE}
SELECT st.cnpj, product_key, d AS collection_date, CAST(p AS DOUBLE) AS sale_price, year(d) || 'q' || quarter(d) AS quarter, st.valid_from, span.valid_to, CAST(1 AS INTEGER) AS last_seen_file
FROM stored st JOIN span ON span.cnpj = st.cnpj AND span.valid_from = st.valid_from""",
    "reload_rejects": f"""WITH {_FILE}
SELECT CAST(1 AS INTEGER) AS source_file_id, reject_rule AS rule_name, count(*) AS rejects, least(count(*), 100) AS samples FROM lines WHERE reject_rule IS NOT NULL GROUP BY 2""",
    "reject_samples_json": f"""WITH {_FILE},
sample AS (
  SELECT line_number, reject_rule AS rule_name, line_number - 2 AS n, blank OR reject_rule = 'field_count' AS bare, CASE WHEN cnpj_raw = '12.3' THEN cnpj_raw WHEN cnpj_raw IS NOT NULL THEN masked END AS cnpj, product_raw
  FROM lines WHERE reject_rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reject_rule ORDER BY line_number) <= 100)
SELECT line_number, rule_name, CASE WHEN NOT bare THEN cnpj END AS cnpj_da_revenda, CASE WHEN NOT bare THEN product_raw END AS produto,
  CASE WHEN NOT bare THEN CASE WHEN n % 47 = 1 THEN '31/02/2024' WHEN n % 53 = 2 THEN '15/03/2019' ELSE strftime(ts, '%d/%m/%Y') END END AS data_da_coleta,
  CASE WHEN NOT bare THEN CASE WHEN n % 59 = 4 THEN '1.234,56' ELSE replace(CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '.', ',') END END AS valor_de_venda,
  CAST(CASE WHEN bare THEN 0 ELSE 12 + CAST(cnpj IS NOT NULL AS INTEGER) + CAST(n % 5 <> 2 AS INTEGER) END AS INTEGER) AS fields
FROM sample JOIN events ON event_id = n""",
    "partition_anomalies": _with(body="""SELECT CASE WHEN product_key = 2 THEN 'default' ELSE year(d) || 'q' || quarter(d) END AS quarter, count(*) AS rows, min(x) AS first_day, max(x) AS last_day, CAST(1 AS BIGINT) AS files, product_key = 2 AS is_anomalous
FROM (SELECT *, CASE WHEN product_key = 2 THEN CAST(d + INTERVAL 4 YEAR AS DATE) ELSE d END AS x FROM fact) GROUP BY 1, product_key = 2"""),
    "unused_part_anti_join": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "broken_rules": _with(_SPOILT, body="\nUNION ALL\n".join((
        _count("one fact a grain", "(SELECT 1 FROM f GROUP BY n, product_key, d HAVING count(*) > 1)"),
        _count("facts have versions", "(SELECT 1 FROM f WHERE n % 19 = 6)"),
        _count("facts are plausible", "(SELECT 1 FROM f WHERE p <= 0)"),
        _count("versions don''t overlap", "(SELECT 1 FROM s WHERE EXISTS (SELECT 1 FROM s x WHERE x.n = s.n AND x.valid_from < s.valid_from AND x.valid_to > s.valid_from))"),
        _count("versions are dated well", "(SELECT 1 FROM s WHERE valid_from >= valid_to OR is_current <> (valid_to = DATE '9999-12-31'))"),
        _count("one current version", "(SELECT 1 FROM s WHERE is_current GROUP BY n HAVING count(*) > 1)"),
        _count("one key a version", "(SELECT 1 FROM s GROUP BY n, valid_from HAVING count(*) > 1)"),
        _count("14 digits", "(SELECT 1 FROM s WHERE length(spoilt_cnpj) <> 14)"),
        _count("versions have brands", "(SELECT 1 FROM s WHERE brand = 99)"),
        _count("versions have cities", "(SELECT 1 FROM s WHERE city_key = 3)"),
        "SELECT 'aliases have brands' AS rule, CAST(1 AS BIGINT) AS rows", "SELECT 'one key a brand' AS rule, CAST(0 AS BIGINT) AS rows", "SELECT 'one key a city' AS rule, CAST(0 AS BIGINT) AS rows"))),
}
SQL["reload_rollup"] = SQL["warehouse_rollup"]  # a rollup brought up to date equals one made anew
# How tables are stored changes no row.
SQL |= {"asof_in_buckets": SQL["asof_fact_join"], "event_effect_in_buckets": SQL["event_effect"], "placebo_in_buckets": SQL["placebo_vs_event"], "placebo_pairs_kept_in_buckets": SQL["placebo_pairs_kept"]}
