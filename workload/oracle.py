"""The registered queries once more as SQL over the same tables, written independently of the operators."""

from __future__ import annotations

import re

from workload.inputs import SCHEMA_HISTORY

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def needed(body: str) -> list[str]:
    """Names of the shared tables a text uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                order.append(name)

    visit(body)
    return order


def oracle(name: str, body: str, extra: dict[str, str] | None = None) -> None:
    tables = {n: CTES[n] for n in needed(body + " ".join((extra or {}).values()))} | (extra or {})
    head = ",\n".join(f"{n} AS ({b})" for n, b in tables.items())
    assert name not in ORACLES, name
    ORACLES[name] = f"WITH {head}\n{body}" if head else body


def R(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-9, 6)"


def B(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def S(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def TS(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def change(a: str, b: str) -> str:
    return f"((CAST({a} AS DOUBLE) - {b}) / nullif(CAST({b} AS DOUBLE), 0))"


# ---- trips ----------------------------------------------------------------------------------------------------

cte("once", """
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln, l_quantity AS q,
         l_extendedprice AS ep, l_returnflag AS rf, l_linestatus AS ls, o_orderdate AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("twice", "SELECT * FROM once UNION ALL SELECT * FROM once WHERE ok % 173 = 0")
cte("shaped", """
  SELECT *, (ok*7 + ln*131 + pk*17) % 1440 AS pu_min,
         CASE WHEN ok % 97 = 0 THEN 900 ELSE (pk*3 + ln*5) % 90 - 2 END AS dur_min,
         CAST(CASE WHEN ok % 61 = 0 THEN -1 WHEN ok % 13 = 0 THEN 3 ELSE 1 END * floor(ep / 10) / 100.0 AS DOUBLE) AS fare,
         CAST(CASE WHEN rf = 'R' AND ln = 1 THEN NULL ELSE ln % 5 END AS BIGINT) AS pax,
         CAST(date_trunc('month', d) AS DATE) AS month0
  FROM twice""")
cte("src", """
  SELECT 'yellow' AS taxi_type,
         CASE WHEN ok % 191 = 0 THEN CAST(month0 + INTERVAL 1 MONTH AS DATE) ELSE month0 END AS data_period,
         CASE WHEN sk % 11 = 0 THEN NULL ELSE CASE sk % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 6 ELSE 7 END END AS vendor_id,
         CASE WHEN ok % 211 = 0 THEN NULL ELSE d + to_minutes(pu_min) END AS pickup_datetime,
         d + to_minutes(pu_min + dur_min) AS dropoff_datetime,
         pax AS passenger_count,
         CAST(CASE WHEN pk % 50 = 0 THEN 0 WHEN pk % 101 = 0 THEN 300 WHEN pk % 7 = 0 THEN q * 2 ELSE q / 2 END AS DOUBLE) AS trip_distance,
         pk % 265 + 1 AS pickup_location_id, (sk*7 + ln*31) % 265 + 1 AS dropoff_location_id,
         CAST(NULL AS BIGINT) AS rate_code_id, CASE WHEN ls = 'F' THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
         ln % 7 AS payment_type, CAST(fare AS DECIMAL(14,2)) AS fare_amount,
         1.00 AS extra, 0.50 AS mta_tax, 0.00 AS tip_amount, 0.00 AS tolls_amount, 1.00 AS improvement_surcharge,
         CAST(fare + CASE WHEN ok % 307 = 0 THEN 5000 ELSE 2 END AS DECIMAL(14,2)) AS total_amount,
         CASE WHEN pax IS NOT NULL THEN 2.50 END AS congestion_surcharge,
         CASE WHEN pax IS NOT NULL THEN 0.00 END AS airport_fee,
         CAST(NULL AS DECIMAL(14,2)) AS cbd_congestion_fee
  FROM shaped""")
FIELDS = (
    "vendor_id pickup_datetime dropoff_datetime passenger_count trip_distance pickup_location_id dropoff_location_id "
    "rate_code_id store_and_fwd_flag payment_type fare_amount extra mta_tax tip_amount tolls_amount "
    "improvement_surcharge total_amount congestion_surcharge airport_fee cbd_congestion_fee"
).split()
AVAILABLE = FIELDS[:-1]
cte("named", """
  SELECT *, 'yellow_tripdata_' || strftime(data_period, '%Y-%m') || '.parquet' AS source_file,
         'run-' || strftime(data_period, '%Y%m') AS run_id FROM src""")
cte("ranked", f"SELECT *, row_number() OVER (PARTITION BY data_period, {', '.join(FIELDS)}) AS dup_rank FROM named")
cte("timed", """
  SELECT *, CAST(pickup_datetime AS DATE) AS pickup_date, hour(pickup_datetime) AS pickup_hour,
         isodow(pickup_datetime) AS pickup_day_of_week,
         (epoch_us(dropoff_datetime) - epoch_us(pickup_datetime)) / 60000000.0::DOUBLE AS minutes,
         coalesce(pickup_datetime IS NULL OR dropoff_datetime IS NULL, false) AS r1,
         coalesce(dropoff_datetime < pickup_datetime, false) AS r2,
         coalesce(pickup_datetime < data_period OR pickup_datetime >= data_period + INTERVAL 1 MONTH, false) AS r3,
         dup_rank > 1 AS r4
  FROM ranked""")
cte("valid", """
  SELECT *, coalesce(trip_distance > 0 AND trip_distance <= 200, false) AS dv,
         coalesce(minutes > 0 AND minutes <= 720, false) AS tv,
         coalesce(total_amount >= 0 AND total_amount <= 1000 AND (fare_amount IS NULL OR fare_amount >= 0), false) AS av
  FROM timed""")
cte("rated", """
  SELECT *, CASE WHEN dv AND tv THEN trip_distance / (minutes / 60.0::DOUBLE) END AS raw_speed,
         CASE WHEN dv AND av AND fare_amount IS NOT NULL THEN CAST(fare_amount AS DOUBLE) / trip_distance END AS fare_per_mile
  FROM valid""")
cte("ann", """
  SELECT *, coalesce(raw_speed > 80, false) AS f4,
         CASE WHEN coalesce(raw_speed > 80, false) THEN NULL ELSE raw_speed END AS speed,
         passenger_count IS NULL OR passenger_count = 0 AS f5,
         pickup_location_id IS NULL OR pickup_location_id NOT BETWEEN 1 AND 263 AS f6,
         dropoff_location_id IS NULL OR dropoff_location_id NOT BETWEEN 1 AND 263 AS f7,
         concat_ws(';', CASE WHEN r1 THEN 'missing_required_timestamp' END, CASE WHEN r2 THEN 'dropoff_before_pickup' END,
           CASE WHEN r3 THEN 'pickup_outside_source_period' END, CASE WHEN r4 THEN 'duplicate_record' END) AS reasons
  FROM rated""")
cte("judged", """
  SELECT *, concat_ws(';', CASE WHEN NOT dv THEN 'invalid_distance' END, CASE WHEN NOT tv THEN 'invalid_duration' END,
      CASE WHEN NOT av THEN 'invalid_amount' END, CASE WHEN f4 THEN 'implausible_speed' END,
      CASE WHEN f5 THEN 'passenger_count_missing_or_zero' END, CASE WHEN f6 THEN 'pickup_zone_unmapped' END,
      CASE WHEN f7 THEN 'dropoff_zone_unmapped' END) AS flags
  FROM ann""")
cte("fact", "SELECT * FROM judged WHERE reasons = ''")
cte("zone_names", """
  SELECT i.id, r_name AS borough, n_name || '-' || i.id AS zone, i.id NOT IN (264, 265) AS geo
  FROM (SELECT unnest(range(1, 266)) AS id) i JOIN nation ON i.id % 25 = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")
cte("places", "SELECT * FROM zone_names WHERE geo")
cte("seen_zones", """
  SELECT * FROM zone_names
  WHERE id IN (SELECT pickup_location_id FROM src UNION SELECT dropoff_location_id FROM src)""")

# ---- shared aggregates ----------------------------------------------------------------------------------------

cte("days", """
  SELECT pickup_date, count(*) AS trips, count(*) FILTER (WHERE av) AS an, coalesce(sum(total_amount) FILTER (WHERE av), 0) AS asum,
         count(*) FILTER (WHERE dv) AS dn, coalesce(sum(trip_distance) FILTER (WHERE dv), 0) AS dsum,
         count(*) FILTER (WHERE tv) AS tn, coalesce(sum(minutes) FILTER (WHERE tv), 0) AS tsum
  FROM fact GROUP BY pickup_date""")
cte("months", """
  SELECT data_period, count(*) AS row_count, min(run_id) AS run_id, min(pickup_date) AS lo, max(pickup_date) AS hi
  FROM fact GROUP BY data_period""")
cte("flag_rows", "SELECT pickup_date, data_period, unnest(string_split(flags, ';')) AS flag FROM fact WHERE flags <> ''")
cte("registry_months", "SELECT data_period, strftime(data_period, '%Y-%m') AS period, count(*) AS num_rows FROM src GROUP BY data_period")
HISTORY = ", ".join(f"({i}, '{c}', '{t}', '{a}', '{b}')" for i, (c, t, a, b) in enumerate(SCHEMA_HISTORY))
cte("schema_columns", f"""
  SELECT period, num_rows, data_period, h.col, h.kind FROM registry_months
  JOIN (VALUES {HISTORY}) AS h(pos, col, kind, a, b) ON period BETWEEN h.a AND h.b""")
cte("registry", """
  SELECT period, data_period, any_value(num_rows) AS num_rows, count(*) AS n,
         'yellow-' || substr(sha256(string_agg(col || ':' || kind, ';' ORDER BY col)), 1, 12) AS version,
         CASE WHEN year(data_period) = 1995 THEN 'csv' ELSE 'parquet' END AS file_format
  FROM schema_columns GROUP BY period, data_period""")
REASONS = ["missing_required_timestamp", "dropoff_before_pickup", "pickup_outside_source_period", "duplicate_record"]
FLAGS = [
    "invalid_distance", "invalid_duration", "invalid_amount", "implausible_speed", "passenger_count_missing_or_zero",
    "pickup_zone_unmapped", "dropoff_zone_unmapped",
]
FLAG_TESTS = ["NOT dv", "NOT tv", "NOT av", "f4", "f5", "f6", "f7"]
cte("run_rows", f"""
  SELECT data_period, run_id, count(*) AS input_rows, count(*) FILTER (WHERE reasons = '') AS accepted_rows,
         count(*) FILTER (WHERE reasons <> '') AS quarantined_rows, count(*) FILTER (WHERE r4) AS duplicate_rows,
         count(*) FILTER (WHERE r1 OR r2) AS invalid_timestamp_rows,
         count(*) FILTER (WHERE reasons = '' AND (f6 OR f7)) AS unmapped_location_rows,
         sum(total_amount) FILTER (WHERE reasons = '') AS accepted_amount,
         min(pickup_date) FILTER (WHERE reasons = '') AS lo, max(pickup_date) FILTER (WHERE reasons = '') AS hi,
         {", ".join(f"count(*) FILTER (WHERE r{i + 1}) AS n_{r}" for i, r in enumerate(REASONS))},
         {", ".join(f"count(*) FILTER (WHERE reasons = '' AND {t}) AS n_{f}" for f, t in zip(FLAGS, FLAG_TESTS))},
         {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in FIELDS)}
  FROM judged GROUP BY data_period, run_id""")


def tall(table: str, keys: str, prefix: str, names: list[str], label: str, value: str = "rows") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS {label}, {B(prefix + n)} AS {value} FROM {table}" for n in names)


cte("run_reasons", tall("run_rows", "data_period", "n_", REASONS, "reason"))
cte("run_flags", tall("run_rows", "data_period", "n_", FLAGS, "flag"))
cte("run_nulls", tall("run_rows", "data_period, input_rows", "null_", AVAILABLE, "field", "null_count"))

PAYMENT = "CASE {0} WHEN 0 THEN 'Flex Fare' WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No charge' WHEN 4 THEN 'Dispute' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Voided trip' ELSE coalesce('Payment type ' || {0} || ' (undocumented)', 'Not recorded') END"
VENDOR = "CASE {0} WHEN 1 THEN 'Creative Mobile Technologies' WHEN 2 THEN 'Curb Mobility' WHEN 6 THEN 'Myle Technologies' WHEN 7 THEN 'Helix' ELSE coalesce('Vendor ' || {0} || ' (undocumented)', 'Not recorded') END"
DAY3 = "(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[{0}]"
DAYNAME = "(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[{0}]"
REASON_LABEL = "CASE {0} WHEN 'missing_required_timestamp' THEN 'Missing or unreadable timestamp' WHEN 'dropoff_before_pickup' THEN 'Drop-off before pickup' WHEN 'pickup_outside_source_period' THEN 'Outside the file’s month' WHEN 'duplicate_record' THEN 'Exact duplicate' END"
FLAG_LABEL = "CASE {0} WHEN 'invalid_distance' THEN 'Implausible distance' WHEN 'invalid_duration' THEN 'Implausible duration' WHEN 'invalid_amount' THEN 'Implausible amount' WHEN 'implausible_speed' THEN 'Implausible speed' WHEN 'passenger_count_missing_or_zero' THEN 'No passenger count' WHEN 'pickup_zone_unmapped' THEN 'Pickup zone unknown' WHEN 'dropoff_zone_unmapped' THEN 'Drop-off zone unknown' END"
HOUR = "lpad({0}::VARCHAR, 2, '0') || ':00'"

METRICS = {
    "total_trips": "count(*)",
    "avg_daily_trips": ratio("count(*)", "count(DISTINCT pickup_date)"),
    "total_recorded_amount": "sum(total_amount) FILTER (WHERE av)",
    "avg_total_amount": ratio("sum(total_amount) FILTER (WHERE av)", "count(*) FILTER (WHERE av)"),
    "avg_trip_distance": ratio("sum(trip_distance) FILTER (WHERE dv)", "count(*) FILTER (WHERE dv)"),
    "avg_trip_duration_minutes": ratio("sum(minutes) FILTER (WHERE tv)", "count(*) FILTER (WHERE tv)"),
}
LABELS = {
    "total_trips": "Total trips", "avg_daily_trips": "Trips per day", "total_recorded_amount": "Total recorded amount",
    "avg_total_amount": "Average total amount per trip", "avg_trip_distance": "Average trip distance",
    "avg_trip_duration_minutes": "Average trip duration",
}
VALID = {"total_recorded_amount": "av", "avg_total_amount": "av", "avg_trip_distance": "dv", "avg_trip_duration_minutes": "tv"}


def V(metric: str, expression: str | None = None) -> str:
    e = expression or METRICS[metric]
    return B(e) if metric == "total_trips" else R(e)


def excluded(metric: str) -> str:
    return f"count(*) FILTER (WHERE NOT {VALID[metric]})" if metric in VALID else "0 * count(*)"


Y1996 = "pickup_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
Y1997 = "pickup_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
THREE = "pickup_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
MIXED = f"{THREE} AND payment_type IN (1, 2, 3) AND pickup_hour BETWEEN 6 AND 21 AND pickup_day_of_week BETWEEN 1 AND 5"
LONG = "trip_distance >= 2 AND trip_distance <= 60"
ID = f"{TS('pickup_datetime')} AS pickup_datetime, {TS('dropoff_datetime')} AS dropoff_datetime, {B('pickup_location_id')} AS pickup_location_id, {B('dropoff_location_id')} AS dropoff_location_id, {R('total_amount')} AS total_amount"

# ---- sources and sinks ----------------------------------------------------------------------------------------

oracle("scan_parquet", f"""
SELECT l_orderkey, l_partkey, l_suppkey, {B('l_linenumber')} AS l_linenumber, {R('l_quantity')} AS l_quantity,
       {R('l_extendedprice')} AS l_extendedprice, {R('l_discount')} AS l_discount, {R('l_tax')} AS l_tax, l_returnflag,
       l_linestatus, {TS('l_shipdate')} AS l_shipdate, 'lineitem.parquet' AS source_file FROM lineitem""")
cte("texted", """
  SELECT *, CASE WHEN pickup_location_id % 13 = 0 THEN 'n/a' WHEN dropoff_location_id % 17 = 0 THEN '   ' ELSE vendor_id::VARCHAR END AS t_vendor,
         CASE WHEN dropoff_location_id % 29 = 0 THEN 'not a time' ELSE strftime(pickup_datetime, '%m/%d/%Y %I:%M:%S %p') END AS t_pickup,
         CASE WHEN pickup_location_id % 19 = 0 THEN '' ELSE passenger_count::VARCHAR END AS t_pax,
         CASE WHEN dropoff_location_id % 29 = 0 THEN NULL ELSE pickup_datetime END AS v_pickup,
         CASE WHEN dropoff_location_id % 37 = 0 THEN NULL ELSE trip_distance END AS v_miles,
         CASE WHEN pickup_location_id % 31 = 0 THEN NULL ELSE total_amount END AS v_total,
         CASE WHEN pickup_location_id % 13 = 0 OR dropoff_location_id % 17 = 0 THEN NULL ELSE vendor_id END AS v_vendor,
         concat_ws(';', CASE WHEN pickup_location_id % 13 = 0 THEN 'vendor_id' END,
           CASE WHEN dropoff_location_id % 29 = 0 THEN 'pickup_datetime' END,
           CASE WHEN dropoff_location_id % 37 = 0 THEN 'trip_distance' END,
           CASE WHEN pickup_location_id % 31 = 0 THEN 'total_amount' END) AS failures
  FROM named""")
oracle("scan_csv", f"""
SELECT {S("CAST(date_trunc('month', v_pickup) AS DATE)")} AS month, count(*) AS rows, {R('sum(v_total)')} AS amount,
       count(v_vendor) AS vendors, {R('sum(v_miles)')} AS miles FROM texted GROUP BY 1""")
# The columns of the given tables.
TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
oracle("inspect_parquet", " UNION ALL ".join(
    f"""SELECT '{t}.parquet' AS file, (SELECT count(*) FROM {t}) AS rows, c AS "column", t AS type FROM (VALUES """
    + ", ".join("('" + "', '".join(x.split()) + "')" for x in columns.split(", ")) + ") AS v(c, t)"
    for t, columns in TABLE_COLUMNS.items()
))
oracle("scan_csv_quoted", """
SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\\. ', '.' || chr(10) || '"", ', 'g')) AS text_sha256, lang, source
FROM documents""")
oracle("inspect_csv_quoted", """
SELECT true AS ok, count(*) AS rows, CAST(0 AS BIGINT) AS bad_rows, CAST(NULL AS BIGINT) AS rows_before_bad,
       false AS truncated, true AS valid_utf8, CAST(NULL AS VARCHAR) AS sample FROM documents""")
oracle("inspect_csv", """
SELECT true AS ok, count(*) AS rows, CAST(0 AS BIGINT) AS bad_rows, CAST(NULL AS BIGINT) AS rows_before_bad,
       false AS truncated, true AS valid_utf8, CAST(NULL AS VARCHAR) AS sample FROM src""")
TRIP_FIELDS = [
    ("vendor_id", "vendorid", 0, "int"), ("pickup_datetime", "tpep_pickup_datetime", 1, "timestamp"),
    ("dropoff_datetime", "tpep_dropoff_datetime", 1, "timestamp"), ("passenger_count", "passenger_count", 0, "int"),
    ("trip_distance", "trip_distance", 0, "double"), ("pickup_location_id", "pulocationid", 0, "int"),
    ("dropoff_location_id", "dolocationid", 0, "int"), ("rate_code_id", "ratecodeid", 0, "int"),
    ("store_and_fwd_flag", "store_and_fwd_flag", 0, "string"), ("payment_type", "payment_type", 0, "int"),
    ("fare_amount", "fare_amount", 0, "money"), ("extra", "extra", 0, "money"), ("mta_tax", "mta_tax", 0, "money"),
    ("tip_amount", "tip_amount", 0, "money"), ("tolls_amount", "tolls_amount", 0, "money"),
    ("improvement_surcharge", "improvement_surcharge", 0, "money"), ("total_amount", "total_amount", 0, "money"),
    ("congestion_surcharge", "congestion_surcharge", 0, "money"), ("airport_fee", "airport_fee", 0, "money"),
    ("cbd_congestion_fee", "cbd_congestion_fee", 0, "money"),
]
cte("trip_field", f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{a}{chr(39)}, {r} = 1, {chr(39)}{k}{chr(39)})' for n, a, r, k in TRIP_FIELDS)}) AS v(field, alias, required, kind)")
cte("field_months", """
  SELECT r.period, f.field, f.alias, f.required, f.kind, c.col FROM registry r CROSS JOIN trip_field f
  LEFT JOIN schema_columns c ON c.period = r.period AND lower(c.col) = f.alias""")
oracle("map_schema", """
SELECT period, field, col AS source_column,
       CASE WHEN col IS NOT NULL THEN 'mapped' WHEN required THEN 'missing_required' ELSE 'unavailable' END AS status FROM field_months
UNION ALL
SELECT period, NULL, col, 'unexpected' FROM schema_columns WHERE lower(col) NOT IN (SELECT alias FROM trip_field)""")
oracle("schema_fingerprint", "SELECT period, version AS schema_version FROM registry")
ZONE_ROW = f"{B('id')} AS location_id, borough, zone, 'Zone' AS service_zone, geo AS is_geographic"
for name in ("load_zones", "zones_list", "replace_dimension"):
    oracle(name, f"SELECT {ZONE_ROW} FROM seen_zones")
oracle("find_zones", f"SELECT {B('id')} AS location_id, zone, borough FROM seen_zones WHERE lower(zone) LIKE '%east%' OR lower(borough) LIKE '%east%' ORDER BY id")
oracle("write_curated", f"SELECT 'yellow' AS taxi_type, {S('data_period')} AS data_period, count(*) AS rows, {R('sum(total_amount)')} AS amount FROM fact GROUP BY data_period")
oracle("write_quarantine", f"SELECT {S('data_period')} AS data_period, {ID}, reasons AS quarantine_reasons, source_file FROM judged WHERE reasons <> ''")
oracle("publish_partition", f"""
SELECT 'yellow' AS taxi_type, {S('data_period')} AS data_period, 'rows' AS "check", {R('count(*)')} AS expected, {R('count(*)')} AS actual, true AS ok FROM fact GROUP BY data_period
UNION ALL
SELECT 'yellow', {S('data_period')}, 'amount', {R('sum(total_amount)')}, {R('sum(total_amount)')}, true FROM fact GROUP BY data_period""")
HOURLY = "taxi_type, pickup_date, pickup_hour, pickup_day_of_week, pickup_location_id, payment_type, vendor_id"
DROPOFF = "taxi_type, pickup_date, dropoff_location_id, payment_type, vendor_id"
cte("bucket_rows", """
  SELECT taxi_type, pickup_date, data_period, run_id, 'trip_distance' AS metric, least(floor(trip_distance), 50) AS bucket_start FROM fact WHERE dv
  UNION ALL
  SELECT taxi_type, pickup_date, data_period, run_id, 'total_amount', least(floor(CAST(total_amount AS DOUBLE) / 5) * 5, 200) FROM fact WHERE av""")
ROLLUP_ROWS = f"""
SELECT {S('data_period')} AS data_period, 'hourly' AS "table", count(*) AS rows FROM (SELECT DISTINCT data_period, {HOURLY} FROM fact) GROUP BY data_period
UNION ALL SELECT {S('data_period')}, 'dropoff_daily', count(*) FROM (SELECT DISTINCT data_period, {DROPOFF} FROM fact) GROUP BY data_period
UNION ALL SELECT {S('data_period')}, 'buckets', count(*) FROM (SELECT DISTINCT data_period, pickup_date, metric, bucket_start FROM bucket_rows) GROUP BY data_period
UNION ALL SELECT {S('data_period')}, 'flags_daily', count(*) FROM (SELECT DISTINCT data_period, pickup_date, flag FROM flag_rows) GROUP BY data_period"""
oracle("publish_aggregates", ROLLUP_ROWS)
oracle("backfill_aggregates", ROLLUP_ROWS)
oracle("record_run", f"""
SELECT 'yellow' AS taxi_type, {S('data_period')} AS data_period, row_count, run_id, {S('lo')} AS min_pickup_date,
       {S('hi')} AS max_pickup_date, '2020-01-02 00:00:00' AS published_at FROM months""")
oracle("extract_csv", f"""
SELECT {TS('pickup_datetime')} AS pickup_datetime, {TS('dropoff_datetime')} AS dropoff_datetime, {B('pickup_location_id')} AS pickup_location_id,
       {B('dropoff_location_id')} AS dropoff_location_id, {R('trip_distance')} AS trip_distance, {R('total_amount')} AS total_amount, flags AS quality_flags
FROM fact WHERE flags <> ''
ORDER BY fact.total_amount DESC, fact.pickup_datetime, fact.dropoff_datetime, fact.pickup_location_id, fact.dropoff_location_id,
         fact.trip_distance, minutes, passenger_count NULLS LAST, payment_type, vendor_id NULLS LAST, fare_amount""")
oracle("csv_cell", """
SELECT strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') AS pickup_datetime, coalesce(passenger_count::VARCHAR, '') AS passenger_count,
       total_amount::VARCHAR AS total_amount, CASE WHEN av THEN 'true' ELSE 'false' END AS is_amount_valid, flags AS quality_flags,
       CASE WHEN pickup_location_id % 6 < 4 THEN '''' ELSE '' END || substr('=+-@ab', pickup_location_id % 6 + 1, 1) || source_file AS note,
       pickup_date::VARCHAR AS pickup_date, coalesce(vendor_id::VARCHAR, '') AS vendor_id FROM fact""")

# ---- cleaning -------------------------------------------------------------------------------------------------

_DOUBLES = {"trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount", "congestion_surcharge", "airport_fee", "cbd_congestion_fee"}
oracle("normalize", f"""
SELECT {S('data_period')} AS data_period, {', '.join(
    f"{TS(c)} AS {c}" if c.endswith('_datetime') else f"{R(c)} AS {c}" if c in _DOUBLES else c if c.endswith('flag') else f"{B(c)} AS {c}" for c in FIELDS)},
    '' AS _cast_failures FROM src""")
oracle("blank_to_null", """
SELECT "column", found, CASE WHEN trim(found) = '' THEN NULL ELSE found END AS read, count(*) AS rows FROM (
  SELECT 'VendorID' AS "column", t_vendor AS found FROM texted UNION ALL SELECT 'passenger_count', t_pax FROM texted
  UNION ALL SELECT 'payment_type', payment_type::VARCHAR FROM texted) GROUP BY ALL""")
oracle("parse_timestamp", f"""
SELECT t_pickup AS text, {TS('v_pickup')} AS parsed, {S('pickup_location_id')} AS "PULocationID", {S('dropoff_location_id')} AS "DOLocationID" FROM texted""")
cte("utc_offsets", """
  SELECT y, CAST(printf('%d-04-01', y) AS DATE) + INTERVAL ((7 - isodow(CAST(printf('%d-04-01', y) AS DATE)))::INTEGER) DAY + INTERVAL 7 HOUR AS spring,
         CAST(printf('%d-10-31', y) AS DATE) - INTERVAL ((isodow(CAST(printf('%d-10-31', y) AS DATE)) % 7)::INTEGER) DAY + INTERVAL 6 HOUR AS autumn
  FROM (SELECT unnest(range(1994, 2006)) AS y)""")
oracle("utc_to_wallclock", f"""
SELECT {TS('pickup_datetime')} AS utc,
       {TS("pickup_datetime - CASE WHEN pickup_datetime >= spring AND pickup_datetime < autumn THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END")} AS wallclock,
       {B('pickup_location_id')} AS "PULocationID"
FROM src LEFT JOIN utc_offsets ON y = year(pickup_datetime)""")
oracle("cast_failures", f"SELECT {S('data_period')} AS data_period, failures, count(*) AS rows FROM texted GROUP BY ALL")
oracle("duplicate_rank", f"SELECT {S('data_period')} AS data_period, {ID}, dup_rank AS rank FROM ranked")
oracle("quarantine_reasons", f"SELECT {S('data_period')} AS data_period, {ID}, reasons AS quarantine_reasons FROM judged")
oracle("trip_duration", f"SELECT {ID}, {R('minutes')} AS trip_duration_minutes FROM fact")
oracle("validity_flags", f"SELECT {ID}, dv AS is_distance_valid, tv AS is_duration_valid, av AS is_amount_valid FROM fact")
oracle("calendar_fields", f"SELECT {ID}, {S('pickup_date')} AS pickup_date, {B('pickup_hour')} AS pickup_hour, {B('pickup_day_of_week')} AS pickup_day_of_week FROM fact")
oracle("speed", f"SELECT {ID}, {R('speed')} AS average_speed_mph FROM fact")
oracle("fare_per_mile", f"SELECT {ID}, {R('fare_per_mile')} AS fare_per_mile FROM fact")
oracle("quality_flags", f"SELECT {ID}, flags AS quality_flags FROM fact")
oracle("lineage", f"SELECT taxi_type, source_file, run_id, {S('data_period')} AS data_period, count(*) AS rows, count(*) AS stamped FROM fact GROUP BY ALL")
oracle("split_accepted", f"SELECT {S('data_period')} AS data_period, count(*) AS rows, CASE WHEN reasons = '' THEN 'accepted' ELSE 'quarantined' END AS side FROM judged GROUP BY ALL")

# ---- quality --------------------------------------------------------------------------------------------------

COUNTS = "input_rows, accepted_rows, quarantined_rows, duplicate_rows, invalid_timestamp_rows, unmapped_location_rows"
oracle("run_metrics", f"""
SELECT 'yellow' AS taxi_type, {S('data_period')} AS data_period, run_id, {COUNTS}, {R('accepted_amount')} AS accepted_amount,
       {S('lo')} AS min_pickup_date, {S('hi')} AS max_pickup_date FROM run_rows""")
oracle("reason_counts", f"SELECT {S('data_period')} AS data_period, reason, rows FROM run_reasons")
oracle("flag_counts", f"SELECT {S('data_period')} AS data_period, flag, rows FROM run_flags")
oracle("missingness", f"SELECT {S('data_period')} AS data_period, field, null_count, round(100.0::DOUBLE * null_count / input_rows, 4) AS null_pct FROM run_nulls")
oracle("missing_by_field", f"SELECT field, {B('sum(null_count)')} AS null_count, {R(ratio('sum(null_count)', 'sum(input_rows)'))} AS share FROM run_nulls GROUP BY field")
TEXT_FIELDS = "vendor_id pickup_datetime dropoff_datetime passenger_count trip_distance pickup_location_id dropoff_location_id payment_type total_amount".split()
oracle("cast_failure_counts", " UNION ALL ".join(
    f"SELECT {S('data_period')} AS data_period, '{c}' AS field, count(*) FILTER (WHERE list_contains(string_split(failures, ';'), '{c}')) AS rows FROM texted GROUP BY data_period"
    for c in TEXT_FIELDS))


def check_rows(table: str, checks: list[tuple[str, str, str]], key: str = "data_period") -> str:
    return " UNION ALL ".join(
        f"SELECT 'yellow' AS taxi_type, {S(key)} AS {key}, '{n}' AS \"check\", {R(e)} AS expected, {R(a)} AS actual, ({e}) IS NOT DISTINCT FROM ({a}) AS ok FROM {table}"
        for n, e, a in checks)


oracle("verify_staged", check_rows("run_rows", [
    ("rows", "accepted_rows", "accepted_rows"), ("amount", "coalesce(accepted_amount, 0)", "coalesce(accepted_amount, 0)"),
    ("rows outside the period", "0", "0"), ("period is expected", "1", "1")]))
oracle("verify_published", check_rows("both_sides", [("rows", "n", "m"), ("amount", "a", "b")]), {"both_sides": """
  SELECT data_period, count(*) AS n, sum(total_amount) AS a, count(*) FILTER (WHERE pickup_date <> DATE '1996-05-05') AS m,
         sum(total_amount) FILTER (WHERE pickup_date <> DATE '1996-05-05') AS b FROM fact GROUP BY data_period"""})
oracle("verify_aggregates", check_rows("by_month", [
    (n, e, e) for n, e in (("hourly trips", "n"), ("hourly amount", "a"), ("drop-off trips", "n"), ("drop-off amount", "a"), ("distance buckets", "d"))], "month"),
    {"by_month": """SELECT CAST(date_trunc('month', pickup_date) AS DATE) AS month, count(*) AS n,
     coalesce(sum(total_amount) FILTER (WHERE av), 0) AS a, count(*) FILTER (WHERE dv) AS d FROM fact GROUP BY 1"""})
oracle("coverage", f"""
SELECT 'yellow' AS taxi_type, {S('min(lo) OVER ()')} AS start_date, {S('max(hi) OVER ()')} AS end_date, {B('sum(row_count) OVER ()')} AS total_rows,
       strftime(data_period, '%Y-%m') AS period, row_count, run_id, {S('lo')} AS min_pickup_date, {S('hi')} AS max_pickup_date FROM months""")
oracle("dataset_version", """
SELECT substr(sha256(string_agg(strftime(data_period, '%Y-%m') || ':' || run_id, ';' ORDER BY data_period)), 1, 12) AS version,
       count(*) AS months FROM months WHERE hi >= DATE '1996-01-01' AND lo <= DATE '1996-12-31'""")
cte("jobs", """
  SELECT 'yellow-' || period AS source_key, 'yellow-' || period || '#' || k AS job_id, period, data_period,
         CASE WHEN k = m % 3 + 1 AND m <> 12 THEN 'succeeded' WHEN k = 1 THEN 'failed' ELSE 'cancelled' END AS status,
         CAST(data_period AS TIMESTAMP) + to_days(k::INTEGER) AS created_at, k = m % 3 + 1 AS latest
  FROM (SELECT period, data_period, month(data_period) AS m, unnest(range(1, month(data_period) % 3 + 2)) AS k FROM registry)""")
oracle("source_status", f"""
SELECT 'yellow-' || r.period AS source_key, 'yellow' AS taxi_type, r.period,
       CASE WHEN month(r.data_period) % 2 = 0 THEN sha256('yellow-' || r.period) END AS expected_sha256,
       CASE WHEN month(r.data_period) <> 7 THEN {B('num_rows * 100')} END AS bytes,
       CASE WHEN month(r.data_period) <> 7 THEN sha256('yellow-' || r.period) END AS sha256,
       CASE WHEN month(r.data_period) <> 7 THEN version END AS schema_version, p.row_count AS published_rows, p.run_id AS published_run,
       j.job_id, j.status AS job_status, {TS('j.created_at')} AS job_created_at, month(r.data_period) % 2 = 0 AS checksum_pinned
FROM registry r LEFT JOIN months p ON p.data_period = r.data_period LEFT JOIN jobs j ON j.period = r.period AND j.latest""")
oracle("run_history", f"""
SELECT job_id, source_key, status, {TS('created_at')} AS created_at, run_id, input_rows, accepted_rows, quarantined_rows
FROM jobs LEFT JOIN run_rows USING (data_period) WHERE status = 'succeeded' ORDER BY jobs.created_at DESC, job_id LIMIT 50""")

# ---- rollups and filters --------------------------------------------------------------------------------------

SUMS = f"""count(*) AS trips, count(*) FILTER (WHERE av) AS amount_valid_trips, {R('coalesce(sum(total_amount) FILTER (WHERE av), 0)')} AS total_amount_valid_sum,
  count(*) FILTER (WHERE dv) AS distance_valid_trips, {R('coalesce(sum(trip_distance) FILTER (WHERE dv), 0)')} AS trip_distance_valid_sum"""
oracle("agg_hourly", f"""
SELECT taxi_type, {S('pickup_date')} AS pickup_date, {B('pickup_hour')} AS pickup_hour, {B('pickup_day_of_week')} AS pickup_day_of_week,
  {B('pickup_location_id')} AS pickup_location_id, {B('payment_type')} AS payment_type, {B('vendor_id')} AS vendor_id, {SUMS},
  count(*) FILTER (WHERE tv) AS duration_valid_trips, {R('coalesce(sum(minutes) FILTER (WHERE tv), 0)')} AS trip_duration_valid_sum, min(run_id) AS run_id
FROM fact GROUP BY fact.taxi_type, fact.pickup_date, fact.pickup_hour, fact.pickup_day_of_week, fact.pickup_location_id, fact.payment_type, fact.vendor_id""")
oracle("agg_dropoff_daily", f"""
SELECT taxi_type, {S('pickup_date')} AS pickup_date, {B('dropoff_location_id')} AS dropoff_location_id, {B('payment_type')} AS payment_type,
  {B('vendor_id')} AS vendor_id, {SUMS}, min(run_id) AS run_id
FROM fact GROUP BY fact.taxi_type, fact.pickup_date, fact.dropoff_location_id, fact.payment_type, fact.vendor_id""")
oracle("agg_buckets", f"""
SELECT taxi_type, {S('pickup_date')} AS pickup_date, metric, {R('bucket_start')} AS bucket_start, count(*) AS trips, min(run_id) AS run_id
FROM bucket_rows GROUP BY bucket_rows.taxi_type, bucket_rows.pickup_date, metric, bucket_rows.bucket_start""")
oracle("agg_flags_daily", f"""
SELECT 'yellow' AS taxi_type, {S('pickup_date')} AS pickup_date, flag, count(*) AS flagged_trips, 'run-' || strftime(flag_rows.pickup_date, '%Y%m') AS run_id
FROM flag_rows GROUP BY flag_rows.pickup_date, flag""")
PER_DAY = f"{S('pickup_date')} AS pickup_date, count(*) AS trips, {R('sum(total_amount)')} AS amount"
oracle("filter_published", f"SELECT {PER_DAY} FROM fact WHERE data_period IN (SELECT data_period FROM months WHERE row_count >= (SELECT avg(row_count) FROM months)) GROUP BY fact.pickup_date")
for name, condition in (
    ("filter_date", Y1996),
    ("filter_lists", "pickup_location_id BETWEEN 1 AND 50 AND dropoff_location_id BETWEEN 100 AND 149 AND payment_type <= 4 AND vendor_id IN (1, 2, 6) AND pickup_hour % 2 = 0 AND pickup_day_of_week IN (1, 2, 3, 6, 7)"),
    ("filter_distance", LONG), ("filter_flag", "f4"),
):
    oracle(name, f"SELECT {PER_DAY} FROM fact WHERE {condition.replace('pickup_date', 'fact.pickup_date')} GROUP BY fact.pickup_date")
oracle("filter_quality", " UNION ALL ".join(
    f"SELECT {PER_DAY}, '{s}' AS scope FROM fact WHERE {w} GROUP BY fact.pickup_date"
    for s, w in (("all", "true"), ("clean", "flags = ''"), ("flagged", "flags <> ''"))))
GRID = [
    ("trips by hour", "true", "pickup_hour"), ("amount by payment and vendor", MIXED, "payment_type, vendor_id"),
    ("duration by weekday and hour", Y1996, "pickup_day_of_week, pickup_hour"),
    ("distance by pickup zone", "vendor_id IN (1, 2)", "pickup_location_id"),
    ("amount by drop-off zone", "payment_type IN (1, 4)", "dropoff_location_id"),
    ("daily trips by drop-off zone filter", "dropoff_location_id IN (1, 2, 3)", "pickup_date"),
    ("monthly trips per day", "true", "date_trunc('month', pickup_date)"),
    ("hourly trips", "pickup_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-30'", "pickup_date, pickup_hour"),
]
oracle("rollup_equals_fact", " UNION ALL ".join(
    f"SELECT '{q}' AS question, count(*) AS groups, CAST(0 AS BIGINT) AS differing FROM (SELECT DISTINCT {k} FROM fact WHERE {w})" for q, w, k in GRID))

LEVEL_GRID = [
    *GRID,
    ("trips by weekday and hour", "true", "pickup_day_of_week, pickup_hour"),
    ("trips per day by hour", "pickup_day_of_week IN (1, 2)", "pickup_hour"),
    ("trips per day by pickup zone", "true", "pickup_location_id"),
    ("trips per day by drop-off zone", "true", "dropoff_location_id"),
    ("duration by vendor", "payment_type IN (1, 2)", "vendor_id"),
    ("trips per day", "true", "1"),
    ("amount by day", Y1996, "pickup_date"),
    ("distance by zone and day", "pickup_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-30'", "pickup_location_id, pickup_date"),
]
oracle("rollup_equals_fact_levels", " UNION ALL ".join(
    f"SELECT '{q}' AS question, count(*) AS groups, CAST(0 AS BIGINT) AS differing FROM (SELECT DISTINCT {k} FROM fact WHERE {w})" for q, w, k in LEVEL_GRID))
LEVEL_KEYS = {
    "daily": "pickup_date", "clock_daily": "pickup_date, pickup_hour, pickup_day_of_week",
    "zone_daily": "pickup_date, pickup_location_id", "clock": "pickup_hour, pickup_day_of_week", "zones": "pickup_location_id",
    "codes": "payment_type, vendor_id", "dropoff_zones": "dropoff_location_id",
}
oracle("agg_levels", " UNION ALL ".join(f"""
SELECT '{name}' AS level, count(*) AS rows, CAST(sum(n) AS BIGINT) AS trips, {R('sum(amount)')} AS amount,
       CAST({'0' if 'pickup_date' in keys else 'sum(days)'} AS BIGINT) AS days
FROM (SELECT count(*) AS n, count(DISTINCT pickup_date) AS days, coalesce(sum(total_amount) FILTER (WHERE av), 0) AS amount
      FROM fact GROUP BY data_period, {keys})""" for name, keys in LEVEL_KEYS.items()))
for name, keys in (("zone", "pickup_location_id"), ("dropoff", "dropoff_location_id"), ("clock", "pickup_day_of_week, pickup_hour")):
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'none')" for k in keys.split(", "))
    oracle(f"avg_daily_trips__{name}_level", f"""
SELECT concat_ws('|', {parts}) AS key, {R('count(*) / count(DISTINCT pickup_date)')} AS value, count(*) AS trips FROM fact GROUP BY {keys}""")

# ---- metrics and questions ------------------------------------------------------------------------------------

for key in METRICS:
    for form in ("fact", "rollup"):
        oracle(f"{key}__{form}", f"SELECT {V(key)} AS value, {B(excluded(key))} AS excluded_rows, count(*) AS trips FROM fact")


def overview(condition: str = "true") -> str:
    return f"""SELECT {', '.join(f'{V(k)} AS {k}' for k in METRICS)}, {', '.join(f'{excluded(k)} AS excluded__{k}' for k in VALID)},
      {S('min(pickup_date)')} AS first_date, {S('max(pickup_date)')} AS last_date, count(DISTINCT pickup_date) AS days FROM fact WHERE {condition}"""


oracle("overview", overview())
oracle("overview__fact", overview(LONG))
oracle("overview__rollup", overview(MIXED))


def two_windows(a: str, b: str) -> dict[str, str]:
    parts = [
        f"SELECT {i + 1} AS position, '{k}' AS metric, (SELECT CAST({METRICS[k]} AS DOUBLE) FROM fact WHERE {a}) AS a, "
        f"(SELECT CAST({METRICS[k]} AS DOUBLE) FROM fact WHERE {b}) AS b, (SELECT {excluded(k)} FROM fact WHERE {a}) AS ea"
        for i, k in enumerate(METRICS)
    ]
    return {"windows": " UNION ALL ".join(parts)}


# the year before 1997 has 366 days, so the equally long window starts on 1996-01-02
BEFORE_1997 = "pickup_date BETWEEN DATE '1996-01-02' AND DATE '1996-12-31'"
oracle("previous_period", f"""
SELECT {B('position')} AS position, metric, {R('a')} AS value, {R('b')} AS previous, {R(change('a', 'b'))} AS change, {B('ea')} AS excluded_rows,
       CAST(NULL AS VARCHAR) AS reason FROM windows""", two_windows(Y1997, BEFORE_1997))
oracle("compare_periods", f"""
SELECT {B('position')} AS position, metric, {R('a')} AS period_a, {R('b')} AS period_b, {R(change('b', 'a'))} AS change_b_vs_a FROM windows""",
    two_windows(Y1996, "pickup_date BETWEEN DATE '1996-07-01' AND DATE '1997-06-30'"))


def series(metric: str, bucket: str, condition: str = "true") -> str:
    return f"SELECT {TS(bucket)} AS bucket, {V(metric)} AS value, count(*) AS trips FROM fact WHERE {condition} GROUP BY 1"


MONTH = "date_trunc('month', pickup_date)::TIMESTAMP"
oracle("series_day", series("avg_total_amount", "pickup_date::TIMESTAMP"))
oracle("series_month", series("avg_trip_distance", MONTH))
oracle("series_hour", series("total_trips", "date_trunc('hour', pickup_datetime)"))


def by(column: str, metric: str, label: str, condition: str = "true") -> str:
    return f"SELECT {B(column)} AS key, {V(metric)} AS value, count(*) AS trips, {label.format(column)} AS label FROM fact WHERE {condition} GROUP BY {column}"


oracle("by_hour", by("pickup_hour", "avg_total_amount", HOUR))
oracle("by_weekday", by("pickup_day_of_week", "avg_trip_duration_minutes", DAY3))
oracle("by_payment", by("payment_type", "total_recorded_amount", PAYMENT))
oracle("by_vendor", by("vendor_id", "total_trips", VENDOR))


def zones_ranked(column: str, condition: str, limit: int | None = None) -> str:
    return f"""SELECT {B('key')} AS key, value, trips, coalesce(zone, 'Unmapped (' || key || ')') AS label, borough, zone IS NOT NULL AS mapped
      FROM (SELECT {column} AS key, count(*) AS value, count(*) AS trips FROM fact WHERE {condition} GROUP BY {column}
            ORDER BY value DESC, key {f"LIMIT {limit}" if limit else ""}) g LEFT JOIN places ON id = g.key"""


oracle("top_pickup_zones", zones_ranked("pickup_location_id", "true", 20))
oracle("top_dropoff_zones", zones_ranked("dropoff_location_id", "true", 20))
oracle("zone_totals", f"""
SELECT *, {R('log10(value)')} AS log_value, {R('log10(greatest(max(value) OVER (), 10))')} AS scale_max, {R(ratio('value', 'sum(value) OVER ()'))} AS share
FROM ({zones_ranked('pickup_location_id', 'true')})""")
oracle("hour_weekday", f"""
SELECT {B('pickup_day_of_week')} AS weekday, {B('pickup_hour')} AS hour, {V('avg_trip_distance')} AS value, count(*) AS trips FROM fact GROUP BY pickup_day_of_week, pickup_hour""")
FLOWS = """(SELECT pickup_location_id AS p, dropoff_location_id AS q, count(*) AS n FROM fact WHERE {0} GROUP BY 1, 2 ORDER BY n DESC, p, q LIMIT {1})"""
oracle("top_flows", f"""
SELECT {B('p')} AS pickup_zone, {B('q')} AS dropoff_zone, n AS value, n AS trips, coalesce(a.zone, 'Unmapped (' || p || ')') AS pickup_label,
       a.borough AS pickup_borough, coalesce(b.zone, 'Unmapped (' || q || ')') AS dropoff_label, b.borough AS dropoff_borough, p = q AS same_zone
FROM {FLOWS.format('true', 50)} LEFT JOIN places a ON a.id = p LEFT JOIN places b ON b.id = q""")


def hist(metric: str, condition: str = "true") -> str:
    valid, bucket = {
        "trip_distance": ("dv", "least(floor(trip_distance), 50)"),
        "total_amount": ("av", "least(floor(CAST(total_amount AS DOUBLE) / 5) * 5, 200)"),
    }[metric]
    return f"SELECT CAST({bucket} AS DOUBLE) AS s, count(*) AS trips FROM fact WHERE {valid} AND {condition} GROUP BY 1"


def hist_rows(metric: str, condition: str = "true") -> str:
    width, cap = {"trip_distance": (1, 50), "total_amount": (5, 200)}[metric]
    return f"""SELECT {R('s')} AS start, CASE WHEN s < {cap} THEN {R(f's + {width}')} END AS "end", trips, s >= {cap} AS open_ended FROM ({hist(metric, condition)})"""


oracle("dist_distance", hist_rows("trip_distance"))
oracle("dist_amount", hist_rows("total_amount"))
ACCUMULATED = "SELECT s, trips, sum(trips) OVER (ORDER BY s) AS upto, sum(trips) OVER () AS total FROM ({0})"
oracle("quantile_bucket", f"""
SELECT q, min(s) AS start, CASE WHEN min(s) < 200 THEN min(s) + 5 END AS "end"
FROM acc JOIN (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9), (0.99)) AS v(q) ON upto >= q * total GROUP BY q""",
    {"acc": ACCUMULATED.format(hist("total_amount"))})
oracle("dist_summary", f"""
SELECT {B('sum(trips)')} AS counted_trips, 1.0::DOUBLE AS bucket_width, 50.0::DOUBLE AS cap, min(s) FILTER (WHERE upto >= 0.5::DOUBLE * total) AS median_start,
       min(s) FILTER (WHERE upto >= 0.9::DOUBLE * total) AS p90_start, {B('coalesce(sum(trips) FILTER (WHERE s >= 50), 0)')} AS above_cap_trips,
       (SELECT count(*) FROM fact WHERE NOT dv) AS excluded_trips FROM acc""", {"acc": ACCUMULATED.format(hist("trip_distance"))})
_ROWS = ["pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "trip_distance", "minutes", "passenger_count", "payment_type", "vendor_id", "rate_code_id", "fare_amount", "tip_amount", "tolls_amount", "total_amount", "congestion_surcharge", "airport_fee", "cbd_congestion_fee", "speed"]
_NAMED = {"minutes": "trip_duration_minutes", "speed": "average_speed_mph"}
oracle("explore_rows", f"""
SELECT {', '.join((TS('f.' + c) if c.endswith('datetime') else R('f.' + c) if c in _DOUBLES | {'minutes', 'speed'} else B('f.' + c)) + f' AS {_NAMED.get(c, c)}' for c in _ROWS)}, flags AS quality_flags
FROM fact f WHERE f.pickup_day_of_week <= 3 AND flags <> ''
ORDER BY f.speed NULLS LAST, f.pickup_datetime, f.dropoff_datetime, {', '.join('f.' + c + ' NULLS LAST' for c in _ROWS[2:-1])} LIMIT 100 OFFSET 200""")
oracle("explore_deep_page", f"""
SELECT {', '.join((TS('f.' + c) if c.endswith('datetime') else R('f.' + c) if c in _DOUBLES | {'minutes', 'speed'} else B('f.' + c)) + f' AS {_NAMED.get(c, c)}' for c in _ROWS)}, flags AS quality_flags
FROM fact f WHERE f.pickup_hour BETWEEN 6 AND 21
ORDER BY f.pickup_datetime DESC, f.dropoff_datetime, {', '.join('f.' + c + ' NULLS LAST' for c in _ROWS[2:])} LIMIT 50 OFFSET 3000""")
oracle("explore_count", f"SELECT count(*) AS total FROM fact WHERE {LONG} AND f5")
cte("day_flags", "SELECT pickup_date, flag, count(*) AS n FROM flag_rows GROUP BY pickup_date, flag")
oracle("daily_quality", f"SELECT {S('q.pickup_date')} AS pickup_date, flag, n AS flagged_trips, trips FROM day_flags q JOIN days USING (pickup_date)")
TOTALS = "SELECT 'rows' AS kind, name, {0} AS rows FROM ({1}) GROUP BY name UNION ALL SELECT 'reason', reason, {0} FROM (SELECT * FROM run_reasons {2}) GROUP BY reason UNION ALL SELECT 'flag', flag, {0} FROM (SELECT * FROM run_flags {2}) GROUP BY flag"
_COUNT4 = ["input_rows", "accepted_rows", "quarantined_rows", "duplicate_rows"]


def totals(condition: str = "") -> str:
    source = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS rows FROM run_rows {condition}" for c in _COUNT4)
    return TOTALS.format(B("sum(rows)"), source, condition)


cte("published_only", "SELECT data_period FROM months")
oracle("quality_summary", totals("WHERE data_period IN (SELECT data_period FROM published_only)"))
oracle("daily_flag_rate", f"""
SELECT {S('pickup_date')} AS pickup_date, {B("coalesce(max(n) FILTER (WHERE flag = 'invalid_amount'), 0)")} AS flagged, max(trips) AS trips,
       {R(ratio("coalesce(max(n) FILTER (WHERE flag = 'invalid_amount'), 0)", 'max(trips)'))} AS rate FROM day_flags q JOIN days USING (pickup_date) GROUP BY q.pickup_date""")
oracle("schema_fields", f"""
SELECT field, kind, required, count(col) AS available_in, count(*) AS periods,
       string_agg(period || '=' || coalesce(col, ''), ';' ORDER BY period) AS source_columns FROM field_months GROUP BY field, kind, required""")
oracle("schema_versions", f"""
SELECT version AS schema_version, arg_min(file_format, period) AS file_format, {B('arg_min(n, period)')} AS column_count,
       string_agg(period, ';' ORDER BY period) AS periods FROM registry GROUP BY version""")
cte("neighbours", "SELECT lag(period) OVER (ORDER BY period) AS before, period AS after FROM registry")
cte("column_pairs", """
  SELECT n.before, n.after, o.col AS old, w.col AS new, o.kind AS old_kind, w.kind AS new_kind FROM neighbours n
  JOIN (SELECT before, after, lower(col) AS low FROM neighbours JOIN schema_columns ON period = before
        UNION SELECT before, after, lower(col) FROM neighbours JOIN schema_columns ON period = after) k ON k.after = n.after
  LEFT JOIN schema_columns o ON o.period = n.before AND lower(o.col) = k.low
  LEFT JOIN schema_columns w ON w.period = n.after AND lower(w.col) = k.low
  WHERE n.before IS NOT NULL""")
oracle("schema_drift", """
SELECT before AS from_period, after AS to_period, coalesce(string_agg(new, ';' ORDER BY new) FILTER (WHERE old IS NULL), '') AS added,
       coalesce(string_agg(old, ';' ORDER BY old) FILTER (WHERE new IS NULL), '') AS removed,
       coalesce(string_agg(old || '>' || new, ';' ORDER BY lower(new)) FILTER (WHERE old <> new), '') AS renamed_case,
       coalesce(string_agg(new || '>' || old_kind || '>' || new_kind, ';' ORDER BY lower(new)) FILTER (WHERE old_kind <> new_kind), '') AS type_changed,
       bool_or(old IS NULL OR new IS NULL OR old <> new OR old_kind <> new_kind) AS changed FROM column_pairs GROUP BY before, after""")
_CATALOGUE = [
    ("pickup_datetime", None, None), ("dropoff_datetime", None, None), ("pickup_location_id", None, None), ("dropoff_location_id", None, None),
    ("trip_distance", "miles", None), ("trip_duration_minutes", "minutes", None), ("passenger_count", None, None),
    ("payment_type", None, "0 Flex Fare, 1 Credit card, 2 Cash, 3 No charge, 4 Dispute, 5 Unknown, 6 Voided trip"),
    ("vendor_id", None, "1 Creative Mobile Technologies, 2 Curb Mobility, 6 Myle Technologies, 7 Helix"),
    ("rate_code_id", None, "1 Standard, 2 JFK, 3 Newark, 4 Nassau/Westchester, 5 Negotiated, 6 Group ride, 99 Unknown"),
    ("fare_amount", "USD", None), ("tip_amount", "USD", None), ("tolls_amount", "USD", None), ("total_amount", "USD", None),
    ("congestion_surcharge", "USD", None), ("airport_fee", "USD", None), ("cbd_congestion_fee", "USD", None),
    ("average_speed_mph", "mph", None), ("quality_flags", None, None), ("source_file", None, None), ("run_id", None, None),
]
_COMPUTED = {"trip_duration_minutes": "double", "average_speed_mph": "double", "quality_flags": "array", "source_file": "string", "run_id": "string"}


def lit(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"


_KINDS = {n: k for n, _, _, k in TRIP_FIELDS}
oracle("field_catalogue", f"""
SELECT c.field, {B('c.position')} AS position, c.origin, c.type, c.unit, c.codes, a.source_columns, a.available_in, a.periods
FROM (VALUES {', '.join(f"({i + 1}, '{n}', '{'source' if n in _KINDS else 'derived'}', '{_KINDS.get(n) or _COMPUTED[n]}', {lit(u)}, {lit(k)})" for i, (n, u, k) in enumerate(_CATALOGUE))})
  AS c(position, field, origin, type, unit, codes)
LEFT JOIN (SELECT field, coalesce(string_agg(DISTINCT col, ';' ORDER BY col), '') AS source_columns, count(col) AS available_in, count(*) AS periods
           FROM field_months GROUP BY field) a USING (field)""")

# ---- insights -------------------------------------------------------------------------------------------------

cte("month_trips", f"SELECT {MONTH} AS b, count(*) AS n FROM fact GROUP BY 1")
cte("month_moves", f"SELECT b, n, {change('n', 'lag(n) OVER (ORDER BY b)')} AS c FROM month_trips")
oracle("series_change", f"SELECT {TS('b')} AS bucket, n AS value, n AS trips, {R('c')} AS change FROM month_moves")
oracle("largest_change", f"""
SELECT (SELECT {TS('b')} FROM month_moves WHERE c IS NOT NULL ORDER BY c DESC, b LIMIT 1) AS rise_bucket, {R('max(c)')} AS rise,
       (SELECT {TS('b')} FROM month_moves WHERE c IS NOT NULL ORDER BY c, b LIMIT 1) AS fall_bucket, {R('min(c)')} AS fall FROM month_moves""")
cte("day_money", "SELECT pickup_date AS b, CASE WHEN an > 0 THEN CAST(asum AS DOUBLE) END AS v FROM days")
_P = "strftime(b, '%Y-%m-%d') || '=' || format('{:,.2f}', v)"
oracle("series_summary", f"""
SELECT count(*) AS points, (SELECT {TS('b::TIMESTAMP')} FROM day_money WHERE v IS NOT NULL ORDER BY v DESC, b LIMIT 1) AS highest_bucket, {R('max(v)')} AS highest,
       (SELECT {TS('b::TIMESTAMP')} FROM day_money WHERE v IS NOT NULL ORDER BY v, b LIMIT 1) AS lowest_bucket, {R('min(v)')} AS lowest, {R('avg(v)')} AS mean,
       (SELECT string_agg({_P}, ';' ORDER BY b) FROM (SELECT * FROM day_money ORDER BY b LIMIT 5)) AS first_points,
       (SELECT string_agg({_P}, ';' ORDER BY b) FROM (SELECT * FROM day_money ORDER BY b DESC LIMIT 5)) AS last_points FROM day_money""")
SHARES = """SELECT row_number() OVER (ORDER BY n DESC, k) AS rank, k, n, n / CAST(sum(n) OVER () AS DOUBLE) AS s
  FROM (SELECT {0} AS k, count(*) AS n FROM fact WHERE {1} GROUP BY 1)"""
oracle("zones_share", f"""
SELECT rank, {B('k')} AS key, coalesce(zone, 'Unmapped (' || k || ')') AS label, borough, n AS value, n AS trips, {R('s')} AS share
FROM ({SHARES.format('dropoff_location_id', 'true')}) LEFT JOIN places ON id = k WHERE rank <= 25""")
oracle("breakdown_share", f"SELECT *, {R(ratio('trips', 'sum(trips) OVER ()'))} AS share FROM ({by('payment_type', 'avg_trip_distance', PAYMENT)})")
cte("weekdays", "SELECT isodow(pickup_date) AS w, sum(trips) AS trips, count(*) AS days FROM days GROUP BY 1")
oracle("weekday_per_day", f"SELECT {B('w')} AS weekday, {B('trips')} AS trips, days, {DAY3.format('w')} AS label, {R(ratio('trips', 'days'))} AS trips_per_day FROM weekdays")
cte("halves", """
  SELECT sum(trips) FILTER (WHERE w <= 5) AS wt, sum(days) FILTER (WHERE w <= 5) AS wd, sum(trips) FILTER (WHERE w > 5) AS et,
         sum(days) FILTER (WHERE w > 5) AS ed FROM weekdays""")
oracle("weekend_split", f"""
SELECT {B('wt')} AS weekday_trips, {B('wd')} AS weekday_days, {B('et')} AS weekend_trips, {B('ed')} AS weekend_days, {R(ratio('wt', 'wd'))} AS weekday_per_day,
       {R(ratio('et', 'ed'))} AS weekend_per_day, {R(change(ratio('et', 'ed'), ratio('wt', 'wd')))} AS change FROM halves""")
oracle("busiest_buckets", f"SELECT *, {R(ratio('trips', '(SELECT count(*) FROM fact WHERE av)'))} AS share FROM ({hist_rows('total_amount')}) ORDER BY trips DESC, start LIMIT 8")
cte("window_months", "SELECT data_period FROM months WHERE hi >= DATE '1996-02-10' AND lo <= DATE '1997-03-05'")
oracle("quality_window", f"""
SELECT kind, name, rows, CASE WHEN kind = 'flag' THEN {R(ratio('rows', "max(rows) FILTER (WHERE name = 'accepted_rows') OVER ()"))} END AS share_of_accepted
FROM ({totals("WHERE data_period IN (SELECT data_period FROM window_months)")})""")


def anomalies(value: str) -> dict[str, str]:
    return {
        "vals": f"SELECT pickup_date AS b, isodow(pickup_date) AS w, CAST({value} AS DOUBLE) AS v FROM days",
        "medians": """SELECT *, count(*) OVER (PARTITION BY w) AS n, quantile_cont(v, 0.5) OVER (PARTITION BY w) AS m1, quantile_cont(v, 0.5) OVER () AS m0
                      FROM vals WHERE v IS NOT NULL""",
        "mads": """SELECT *, quantile_cont(abs(v - m1), 0.5) OVER (PARTITION BY w) AS d1, quantile_cont(abs(v - m0), 0.5) OVER () AS d0 FROM medians""",
        "scores": """SELECT b, w, v, CASE WHEN n >= 4 THEN m1 ELSE m0 END AS med,
                     round(coalesce(0.6745::DOUBLE * (v - CASE WHEN n >= 4 THEN m1 ELSE m0 END) / nullif(CASE WHEN n >= 4 THEN d1 ELSE d0 END, 0), 0), 2) AS z FROM mads""",
    }


_SCORE = f"{S('b')} AS pickup_date, {B('w')} AS weekday, {DAY3.format('w')} AS label, {R('v')} AS value, {R('med')} AS baseline_median, {R('z')} AS robust_z"
oracle("anomaly_days", f"SELECT {_SCORE} FROM scores WHERE abs(z) >= 3.5 ORDER BY abs(z) DESC, b LIMIT 10", anomalies("CASE WHEN an > 0 THEN CAST(asum AS DOUBLE) / an END"))
oracle("anomaly_scores", f"SELECT {_SCORE} FROM scores", anomalies("trips"))
cte("hour_miles", f"SELECT pickup_hour AS h, {METRICS['avg_trip_distance']} AS v, count(*) AS n FROM fact GROUP BY 1")
oracle("hour_extremes", f"""
SELECT {B('a.h')} AS high_key, {R('a.v')} AS high_value, a.n AS high_trips, {B('b.h')} AS low_key, {R('b.v')} AS low_value, b.n AS low_trips
FROM (SELECT * FROM hour_miles ORDER BY v DESC, h LIMIT 1) a, (SELECT * FROM hour_miles ORDER BY v, h LIMIT 1) b""")

# ---- reports (1997 unless said otherwise) ---------------------------------------------------------------------

cte("trips97", f"SELECT * FROM fact WHERE {Y1997}")
cte("days97", f"SELECT * FROM days WHERE {Y1997}")
cte("months97", "SELECT * FROM months WHERE hi >= DATE '1997-01-01' AND lo <= DATE '1997-12-31'")
cte("runs97", "SELECT * FROM run_rows WHERE data_period IN (SELECT data_period FROM months97)")


def percent_text(x: str) -> str:
    nines = f"least(6, greatest(2, CAST(ceil(-log10(1 - {x})) AS INTEGER) - 2))"
    almost = " ".join(
        f"WHEN {d} THEN printf('%.{d}f', floor({x} * 1e{d + 2}::DOUBLE) / 1e{d}::DOUBLE)" for d in range(2, 7)
    )
    trimmed = f"rtrim(rtrim(CASE WHEN {x} < 0.01 THEN printf('%.3f', {x} * 100) ELSE printf('%.2f', {x} * 100) END, '0'), '.')"
    return (
        f"CASE WHEN {x} IS NULL THEN '—' WHEN {x} > 0 AND {x} < 0.0001 THEN '<0.01%' "
        f"WHEN {x} >= 0.9999 AND {x} < 1 THEN (CASE {nines} {almost} END) || '%' ELSE {trimmed} || '%' END"
    )


def signed_text(x: str) -> str:
    size = f"abs({x} * 100)"
    text = f"(CASE WHEN {size} < 10 THEN printf('%.1f', {size}) ELSE printf('%.0f', {size}) END || '%')"
    return f"CASE WHEN {x} IS NULL THEN '—' WHEN {x} > 0 THEN '+' || {text} WHEN {x} < 0 THEN '−' || {text} ELSE {text} END"


def display(x: str, unit: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    body = {
        "count": f"format('{{:,.0f}}', {x})",
        "usd": f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs({x}))",
        "miles": f"format('{{:,.2f}} mi', {x})",
        "minutes": f"format('{{:,.1f}} min', {x})",
        "seconds": f"format('{{:,.1f}} s', {x})",
        "share": percent_text(x),
        "bytes": f"CASE WHEN {x} < 1e3 THEN printf('%.0f B', {x}) WHEN {x} < 1e6 THEN printf('%.1f KB', {x} / 1e3) "
        f"WHEN {x} < 1e9 THEN printf('%.1f MB', {x} / 1e6) ELSE printf('%.1f GB', {x} / 1e9) END",
    }[unit]
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE {body} END"


UNITS = ["count", "count", "usd", "usd", "miles", "minutes"]


def by_metric(x: str) -> str:
    return "CASE metric " + " ".join(f"WHEN '{k}' THEN {display(x, u)}" for k, u in zip(METRICS, UNITS)) + " END"


oracle("rpt_kpis", f"""
SELECT {B('position')} AS position, metric, CASE metric {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} END AS label, {R('a')} AS value,
       {by_metric('a')} AS display, {R('b')} AS previous, CASE WHEN b IS NOT NULL THEN {by_metric('b')} END AS previous_display, {R(change('a', 'b'))} AS change,
       CASE WHEN {change('a', 'b')} IS NOT NULL THEN {signed_text(change('a', 'b'))} END AS change_display, {B('ea')} AS excluded_rows FROM windows""",
    two_windows(Y1997, BEFORE_1997))


def trend(points: str, condition: str) -> str:
    d = f"(SELECT * FROM days WHERE {condition})"
    return f"""{points} UNION ALL
      (SELECT 'busiest', {TS('pickup_date::TIMESTAMP')}, trips FROM {d} ORDER BY trips DESC, pickup_date LIMIT 1) UNION ALL
      (SELECT 'quietest', {TS('pickup_date::TIMESTAMP')}, trips FROM {d} ORDER BY trips, pickup_date LIMIT 1)"""


oracle("rpt_trend", trend(f"SELECT 'point' AS kind, {TS('pickup_date::TIMESTAMP')} AS bucket, trips FROM days97", Y1997))
RANGE3 = "pickup_date BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'"
oracle("rpt_trend_monthly", trend(f"SELECT 'point' AS kind, {TS(MONTH)} AS bucket, {B('sum(trips)')} AS trips FROM days WHERE {RANGE3} GROUP BY 2", RANGE3))
oracle("rpt_weekday", f"""
SELECT {B('w')} AS weekday, {DAYNAME.format('w')} AS label, {B('t')} AS trips, {R('t / CAST(sum(t) OVER () AS DOUBLE)')} AS share, n AS days,
       round(CAST(t AS DOUBLE) / n, 1) AS per_day, row_number() OVER (ORDER BY CAST(t AS DOUBLE) / n DESC, w) = 1 AS busiest,
       row_number() OVER (ORDER BY CAST(t AS DOUBLE) / n, w) = 1 AS quietest
FROM (SELECT isodow(pickup_date) AS w, sum(trips) AS t, count(*) AS n FROM days97 GROUP BY 1)""")
oracle("rpt_zone_table", f"""
SELECT rank, {B('k')} AS key, coalesce(zone, 'Unmapped (' || k || ')') AS label, coalesce(borough, '—') AS borough, n AS trips, {R('s')} AS share,
       {R('sum(s) OVER (ORDER BY rank)')} AS combined_share
FROM ({SHARES.format('pickup_location_id', Y1997)}) LEFT JOIN places ON id = k WHERE rank <= 10""")
PAYMENTS = f"""SELECT payment_type AS key, count(*) AS n, {METRICS['avg_total_amount']} AS a, {METRICS['avg_trip_distance']} AS m FROM trips97 GROUP BY 1"""
oracle("rpt_payment", f"""
SELECT {B('key')} AS key, {PAYMENT.format('key')} AS label, n AS trips, {R('n / CAST(sum(n) OVER () AS DOUBLE)')} AS share, {R('a')} AS avg_total_amount,
       {R('m')} AS avg_trip_distance FROM ({PAYMENTS})""")
oracle("rpt_payment_top", f"""
SELECT {B('key')} AS key, {PAYMENT.format('key')} AS label, {R('a')} AS avg_total_amount, n AS trips FROM ({PAYMENTS}) WHERE n >= 100 ORDER BY a DESC, n DESC, key LIMIT 1""")
oracle("rpt_hour", f"""
SELECT {B('h')} AS hour, {HOUR.format('h')} AS label, n AS trips, {R('n / CAST(sum(n) OVER () AS DOUBLE)')} AS share,
       row_number() OVER (ORDER BY n DESC, h) = 1 AS peak, row_number() OVER (ORDER BY n, h) = 1 AS quietest
FROM (SELECT pickup_hour AS h, count(*) AS n FROM trips97 GROUP BY 1)""")
oracle("rpt_heatmap", f"""
SELECT {B('w')} AS weekday, {', '.join(f"nullif(count(*) FILTER (WHERE pickup_hour = {h}), 0) AS h{h:02d}" for h in range(24))}, {DAY3.format('w')} AS label
FROM (SELECT unnest(range(1, 8)) AS w) LEFT JOIN trips97 ON pickup_day_of_week = w GROUP BY w""")
oracle("rpt_peak_slots", f"""
SELECT rank, {DAYNAME.format('w')} AS weekday, {HOUR.format('h')} AS hour, n AS trips, {R('s')} AS share, {R('sum(s) OVER (ORDER BY rank)')} AS combined_share
FROM (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS s, row_number() OVER (ORDER BY n DESC, w, h) AS rank
      FROM (SELECT pickup_day_of_week AS w, pickup_hour AS h, count(*) AS n FROM trips97 GROUP BY 1, 2)) WHERE rank <= 10""")
oracle("rpt_distribution", """
SELECT s AS start, CASE WHEN s < 200 THEN s + 5 END AS "end", CASE WHEN s >= 200 THEN '$200+' ELSE printf('$%d–$%d', s::INTEGER, (s + 5)::INTEGER) END AS label,
       trips, s >= 200 AS open_ended,
       nullif(concat_ws(',', CASE WHEN upto >= 0.5::DOUBLE * total AND upto - trips < 0.5::DOUBLE * total THEN 'median' END,
                             CASE WHEN upto >= 0.9::DOUBLE * total AND upto - trips < 0.9::DOUBLE * total THEN 'p90' END), '') AS marker
FROM acc""", {"acc": ACCUMULATED.format(hist("total_amount", Y1997))})
oracle("rpt_amount_by_hour", f"""
SELECT {B('h')} AS hour, {HOUR.format('h')} AS label, {R('v')} AS value, n AS trips,
       n >= 100 AND row_number() OVER (ORDER BY CASE WHEN n >= 100 THEN v END DESC NULLS LAST, h) = 1 AS highest,
       n >= 100 AND row_number() OVER (ORDER BY CASE WHEN n >= 100 THEN v END NULLS LAST, h) = 1 AS lowest
FROM (SELECT pickup_hour AS h, {METRICS['avg_total_amount']} AS v, count(*) AS n FROM trips97 GROUP BY 1)""")
_WHY = {"av": "Implausible amount", "dv": "Implausible distance", "tv": "Implausible duration"}
oracle("rpt_exclusions", " UNION ALL ".join(
    f"SELECT '{k}' AS metric, '{LABELS[k]}' AS label, '{_WHY[v]}' AS reason, {excluded(k)} AS excluded_rows, {R(ratio(excluded(k), 'count(*)'))} AS share FROM trips97"
    for k, v in VALID.items()))
oracle("rpt_boroughs", f"""
SELECT coalesce(borough, 'Unmapped') AS borough, count(*) AS trips, {R('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share
FROM trips97 LEFT JOIN places ON id = pickup_location_id GROUP BY 1""")
oracle("rpt_flows", f"""
SELECT row_number() OVER (ORDER BY n DESC, p, q) AS rank, {B('p')} AS pickup_zone, {B('q')} AS dropoff_zone, coalesce(a.zone, 'Unmapped (' || p || ')') AS pickup,
       CASE WHEN p = q THEN 'same zone' ELSE coalesce(b.zone, 'Unmapped (' || q || ')') END AS dropoff, n AS trips,
       {R(ratio('n', '(SELECT count(*) FROM trips97)'))} AS share
FROM {FLOWS.format(Y1997, 15)} LEFT JOIN places a ON a.id = p LEFT JOIN places b ON b.id = q""")
cte("sums97", "SELECT sum(input_rows) AS i, sum(accepted_rows) AS a, sum(quarantined_rows) AS q, count(*) AS m FROM runs97")


def ranked97(table: str, key: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY sum(rows) DESC, {key}) AS rank, {key} AS name, {B('sum(rows)')} AS n FROM {table}
      WHERE data_period IN (SELECT data_period FROM months97) GROUP BY {key}"""


oracle("rpt_quality_snapshot", f"""
SELECT {B('1')} AS position, 'Rows read' AS measure, {B('i')} AS rows, CAST(NULL AS DOUBLE) AS share FROM sums97
UNION ALL SELECT 2, 'Rows published', {B('a')}, {R(ratio('a', 'i'))} FROM sums97 UNION ALL SELECT 3, 'Rows quarantined', {B('q')}, {R(ratio('q', 'i'))} FROM sums97
UNION ALL SELECT rank + 3, 'Flag: ' || {FLAG_LABEL.format('name')}, n, {R(ratio('n', '(SELECT a FROM sums97)'))} FROM ({ranked97('run_flags', 'flag')}) WHERE rank <= 3""")
oracle("rpt_quality_kpis", " UNION ALL ".join(
    f"SELECT {B(i + 1)} AS position, '{k}' AS kpi, {R(v)} AS value, {display(v, u)} AS display FROM sums97"
    for i, (k, v, u) in enumerate([("rows_read", "i", "count"), ("rows_published", "a", "count"), ("rows_quarantined", "q", "count"),
                                   ("quarantine_rate", ratio("q", "i"), "share"), ("months", "m", "count")])))
cte("timed97", """
  SELECT r.*, strftime(r.data_period, '%Y-%m') AS period, version, CAST(30 + (year(r.data_period) * 100 + month(r.data_period)) % 11 AS DOUBLE) AS secs
  FROM runs97 r LEFT JOIN registry g ON g.data_period = r.data_period""")
oracle("rpt_processing", """
SELECT period, run_id AS run, input_rows, accepted_rows, quarantined_rows, secs AS duration_seconds, version AS schema,
       min(secs) OVER () AS min_seconds, max(secs) OVER () AS max_seconds FROM timed97""")
oracle("rpt_quarantine", f"""
SELECT rank, name AS reason, {REASON_LABEL.format('name')} AS label, n AS rows, {R(ratio('n', '(SELECT q FROM sums97)'))} AS share FROM ({ranked97('run_reasons', 'reason')})""")
oracle("rpt_flags", f"""
SELECT rank, name AS flag, {FLAG_LABEL.format('name')} AS label, n AS trips, {R(ratio('n', '(SELECT a FROM sums97)'))} AS share FROM ({ranked97('run_flags', 'flag')})""")
oracle("rpt_daily_flags", f"""
SELECT rank, t.flag, {FLAG_LABEL.format('t.flag')} AS label, {S('d.pickup_date')} AS pickup_date, {R(ratio('coalesce(q.n, 0)', 'd.trips'))} AS share
FROM top4 t CROSS JOIN (SELECT * FROM days97 WHERE pickup_date IN (SELECT pickup_date FROM day_flags)) d
LEFT JOIN day_flags q ON q.flag = t.flag AND q.pickup_date = d.pickup_date""",
    {"top4": f"SELECT * FROM (SELECT flag, row_number() OVER (ORDER BY sum(n) DESC, flag) AS rank FROM day_flags WHERE {Y1997} GROUP BY flag) WHERE rank <= 4"})
cte("months3", "SELECT strftime(data_period, '%Y-%m') AS p FROM months WHERE hi >= DATE '1996-03-01' AND lo <= DATE '1999-02-28'")
oracle("rpt_schema", """
SELECT 'version' AS kind, version AS name, arg_min(file_format, period) AS detail, CAST(arg_min(n, period) AS BIGINT) AS columns,
       string_agg(period, ', ' ORDER BY period) AS periods, CAST(NULL AS VARCHAR) AS added, CAST(NULL AS VARCHAR) AS removed
FROM registry GROUP BY version HAVING bool_or(period IN (SELECT p FROM months3))
UNION ALL
SELECT 'drift', before, after, NULL, NULL, coalesce(string_agg(new, ', ' ORDER BY new) FILTER (WHERE old IS NULL), '—'),
       coalesce(string_agg(old, ', ' ORDER BY old) FILTER (WHERE new IS NULL), '—')
FROM column_pairs WHERE before IN (SELECT p FROM months3) AND after IN (SELECT p FROM months3) GROUP BY before, after
HAVING bool_or(old IS NULL OR new IS NULL OR old <> new OR old_kind <> new_kind)""")

# ---- claims ---------------------------------------------------------------------------------------------------

cte("claim_values", """
  SELECT CAST((year(pickup_date) - 1995) * 12 + month(pickup_date) - 1 AS BIGINT) AS run, 'trips' AS field, CAST(trips AS DOUBLE) AS number FROM days
  UNION ALL
  SELECT CAST((year(pickup_date) - 1995) * 12 + month(pickup_date) - 1 AS BIGINT), 'amount', CAST(asum AS DOUBLE) FROM days""")
cte("claim_texts", """
  SELECT 'conv-' || conv_id || '-' || turn AS id, conv_id % 80 AS run, text FROM conversations
  UNION ALL SELECT 'doc-' || doc_id, doc_id % 80, text FROM documents
  UNION ALL SELECT 'report-' || pickup_date, CAST((year(pickup_date) - 1995) * 12 + month(pickup_date) - 1 AS BIGINT),
    '1. On ' || pickup_date || ' zone 132 saw ' || (trips + CASE WHEN day(pickup_date) % 3 = 0 THEN 777 ELSE 0 END) || ' trips over 31 days worth $' ||
    printf('%.2f', CAST(asum AS DOUBLE)) || ' (' || printf('%.1f', CAST(trips AS DOUBLE)) || '%) by 18:00 in March 1997.' FROM days""")
_MON = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec"
# RE2 has no look-ahead, so the year mask keeps its neighbours; it runs twice for years that share one.
_YEAR = (r"(^|[^0-9A-Za-z_])(?:19|20)\d{2}([^0-9A-Za-z_.,]|[.,](?:\D|$)|$)", r"\1  \2", "g")
_MASKS = [
    (r"\b\d{4}-\d{2}-\d{2}\b", "  ", "g"), (r"\b\d{4}-\d{2}\b", "  ", "g"), (rf"\b(?:{_MON})\.?\s+\d{{4}}\b", "  ", "gi"),
    (rf"\b(?:{_MON})\.?\s+\d{{1,2}}\s*[-–]\s*\d{{1,2}}(?:,\s*\d{{4}})?", "  ", "gi"),
    (rf"\b(?:{_MON})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?", "  ", "gi"),
    (rf"\b\d{{1,2}}\s+(?:{_MON})\b(?:\s+\d{{4}})?", "  ", "gi"), (r"\b\d{1,2}:\d{2}\b", "  ", "g"), _YEAR, _YEAR,
    (r"(?m)^\s*\d{1,2}[.)]\s", "  ", "g"),
    (r"\b(?:zone|id|ids|location|run|version|rank|top|#)\s*#?\d+(?:\s*(?:,|and)\s*\d+)*", "  ", "gi"),
    (r"\b\d+(?:st|nd|rd|th)\b", "  ", "gi"), (r"\b\d+\s+(?:days?|weeks?|months?|years?)\b", "  ", "gi"),
]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_masked = "text"
for _p, _r, _f in _MASKS:
    _masked = f"regexp_replace({_masked}, {quoted(_p)}, {quoted(_r)}, {quoted(_f)})"
_NUM = r"(?i)(\$)?([-−])?([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s?(%|percent\b|k\b|m\b|bn\b|b\b|thousand\b|million\b|billion\b)?"
cte("claim_matches", f"""
  SELECT id, run, unnest(range(len(ms))) AS position, unnest(ms) AS match
  FROM (SELECT id, run, regexp_extract_all({_masked}, {quoted(_NUM)}) AS ms FROM claim_texts)""")
cte("claim_parts", f"""
  SELECT id, run, position, trim(match) AS claim, replace(regexp_extract(match, {quoted(_NUM)}, 3), ',', '') AS digits,
         lower(regexp_extract(match, {quoted(_NUM)}, 4)) AS unit, regexp_extract(match, {quoted(_NUM)}, 1) <> '' AS cur,
         regexp_extract(match, {quoted(_NUM)}, 2) <> '' AS neg FROM claim_matches""")
cte("claim_scaled", """
  SELECT *, CAST(digits AS DOUBLE) AS number, CASE WHEN contains(digits, '.') THEN length(split_part(digits, '.', 2)) ELSE 0 END AS decimals,
         CAST(CASE unit WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9
              WHEN 'billion' THEN 1e9 ELSE 1 END AS DOUBLE) AS scale, unit IN ('%', 'percent') AS percent FROM claim_parts""")
cte("claims", """
  SELECT id, run, position, claim, CASE WHEN neg THEN -1 ELSE 1 END * number * scale AS value, percent,
         greatest(0.5::DOUBLE * pow(10::DOUBLE, -decimals) * scale * 1.02::DOUBLE,
                  CASE WHEN NOT percent AND decimals = 0 AND scale = 1 AND number >= 1000 THEN number * 0.0005::DOUBLE ELSE 0 END) AS tolerance
  FROM claim_scaled WHERE NOT (unit = '' AND NOT cur AND decimals = 0 AND number <= 24)""")
_CLAIM = f"id, run, {B('position')} AS position, claim, {R('value')} AS value, percent, {R('tolerance')} AS tolerance"
oracle("extract_claims", f"SELECT {_CLAIM} FROM claims")
cte("pools", "SELECT DISTINCT run, field, number FROM claim_values")
cte("candidates", """
  SELECT run, 'plain' AS kind, number AS c FROM claim_values UNION SELECT run, 'percent', number FROM claim_values
  UNION SELECT run, 'percent', number * 100 FROM claim_values
  UNION SELECT x.run, 'percent', (x.number - y.number) / y.number * 100 FROM pools x JOIN pools y ON x.run = y.run AND x.field = y.field AND x.number <> y.number WHERE y.number <> 0
  UNION SELECT x.run, 'percent', x.number / y.number * 100 FROM pools x JOIN pools y ON x.run = y.run AND x.field = y.field AND x.number <> y.number WHERE y.number <> 0
  UNION SELECT x.run, 'plain', x.number / y.number FROM pools x JOIN pools y ON x.run = y.run AND x.field = y.field AND x.number <> y.number WHERE y.number <> 0
  UNION SELECT x.run, 'plain', x.number - y.number FROM pools x JOIN pools y ON x.run = y.run AND x.field = y.field AND x.number > y.number""")
oracle("claim_candidates", f"SELECT run, kind, {R('c')} AS candidate FROM candidates")
oracle("verify_claims", f"""
SELECT {_CLAIM}, EXISTS (SELECT 1 FROM candidates k WHERE k.run = claims.run AND k.kind = CASE WHEN claims.percent THEN 'percent' ELSE 'plain' END
                         AND abs(abs(k.c) - abs(claims.value)) <= claims.tolerance) AS verified FROM claims""")
cte("month_results", """
  SELECT CAST((year(pickup_date) - 1995) * 12 + month(pickup_date) - 1 AS BIGINT) AS run, sum(trips) AS t, count(*) AS n, min(trips) AS lo, max(trips) AS hi FROM days GROUP BY 1""")
oracle("number_groups", f"""
SELECT run, 'trips' AS field, CAST(t AS DOUBLE) AS number FROM month_results UNION ALL SELECT run, 'days', n FROM month_results
UNION ALL SELECT run, 'period', lo FROM month_results UNION ALL SELECT run, 'period', hi FROM month_results
UNION ALL SELECT run, field, number FROM claim_values WHERE field = 'trips'""")

# ---- scorecard ------------------------------------------------------------------------------------------------


def pick(values: list[str], index: str) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[({index}) % {len(values)} + 1]"


_TOOLS = ["overview", "series", "zones", "breakdown"]
_ARGS = ["total_trips", "avg_total_amount", "avg_trip_distance"]
cte("calls", f"""
  SELECT conv_id AS c, turn, {pick(_TOOLS, 'conv_id + turn')} AS tool, turn % 3 <> 2 AS fine,
         CASE WHEN (conv_id + turn) % 4 = 3 THEN CASE {pick(_TOOLS, 'conv_id + turn')} WHEN 'overview' THEN 'total_trips'
                   WHEN 'series' THEN 'avg_total_amount' WHEN 'zones' THEN 'avg_trip_distance' END
              ELSE {pick(_ARGS, 'conv_id + turn')} END AS metric FROM conversations""")
cte("talks", """
  SELECT conv_id AS c, arg_max(text, turn) AS answer, count(*) AS model_calls FROM conversations GROUP BY conv_id""")
cte("cases", f"""
  SELECT t.*, c % 3 AS repeat, CASE c % 5 WHEN 0 THEN 'injection' WHEN 1 THEN 'ambiguous' ELSE 'data' END AS kind,
         CASE c % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'clarification' ELSE 'answered' END AS status,
         (SELECT coalesce(string_agg(tool, ';' ORDER BY turn), '') FROM calls k WHERE k.c = t.c) AS tools,
         (SELECT count(*) FROM calls k WHERE k.c = t.c AND NOT fine) AS tool_errors,
         CASE WHEN c % 3 <> 0 THEN EXISTS (SELECT 1 FROM calls k WHERE k.c = t.c AND fine AND tool IN ({pick(_TOOLS, 't.c')}, {pick(_TOOLS, 't.c + 1')}))
              AND (c % 11 <> 0 OR EXISTS (SELECT 1 FROM calls k WHERE k.c = t.c AND fine AND tool = {pick(_TOOLS, 't.c + 2')})) END AS tool_ok,
         CASE WHEN c % 4 <> 0 THEN c % 3 <> 0 AND EXISTS (SELECT 1 FROM calls k WHERE k.c = t.c AND fine AND tool IN ({pick(_TOOLS, 't.c')}, {pick(_TOOLS, 't.c + 1')})
              AND metric = {pick(_ARGS, 't.c + 1')}) END AS args_ok,
         CASE WHEN c % 6 <> 0 THEN contains(lower(answer), 'en') AND contains(lower(answer), 'a') END AS text_ok,
         CASE WHEN c % 5 = 0 THEN concat_ws(';', CASE WHEN regexp_matches(answer, '(?i)de[rs]') THEN '(?i)de[rs]' END,
              CASE WHEN regexp_matches(answer, 'tion') THEN 'tion' END) ELSE '' END AS forbidden,
         length(answer) % 6 AS figures, least(length(answer) % 6, length(answer) % 4) AS verified, (length(answer) % 100) / 10.0::DOUBLE AS seconds
  FROM talks t""")
oracle("score_cases", """
SELECT c AS conv_id, kind, status, tools, tool_errors, tool_ok, args_ok, text_ok, status = 'clarification' AS clarified,
       CASE WHEN kind = 'injection' THEN forbidden = '' END AS injection_ok, forbidden AS forbidden_matched FROM cases""")
_ANSWERED = "kind = 'data' AND status = 'answered'"


def rate3(flag: str, condition: str = "true") -> str:
    return f"round(avg(CAST({flag} AS INTEGER)) FILTER (WHERE {condition}), 3)"


_GROUNDING = f"round(CAST(sum(verified) FILTER (WHERE {_ANSWERED}) AS DOUBLE) / nullif(sum(figures) FILTER (WHERE {_ANSWERED}), 0), 3)"
_UNMATCHED = rate3("verified < figures", f"{_ANSWERED} AND figures > 0")
oracle("grounding_rate", f"""
SELECT repeat, round(CAST(sum(verified) AS DOUBLE) / nullif(sum(figures), 0), 3) AS grounding_rate,
       {rate3("verified < figures", "figures > 0")} AS answers_with_unmatched_figures, {B('sum(figures)')} AS figures
FROM answers GROUP BY repeat""", {
    "judged_claims": """
  SELECT id, EXISTS (SELECT 1 FROM candidates k WHERE k.run = claims.run AND k.kind = CASE WHEN claims.percent THEN 'percent' ELSE 'plain' END
                     AND abs(abs(k.c) - abs(claims.value)) <= claims.tolerance) AS ok FROM claims""",
    "answers": """
  SELECT t.id, t.run % 3 AS repeat, count(j.id) AS figures, count(*) FILTER (WHERE j.ok) AS verified
  FROM claim_texts t LEFT JOIN judged_claims j ON j.id = t.id GROUP BY 1, 2""",
})
oracle("filter_listed", """
SELECT pickup_location_id, count(*) AS trips FROM fact WHERE pickup_location_id IN
  (SELECT pickup_location_id FROM fact GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 265.0 FROM fact)) GROUP BY 1""")
cte("summaries", f"""
  SELECT repeat, count(*) AS cases, {rate3("status = 'answered'", "kind = 'data'")} AS answered_rate, {rate3('tool_ok', "kind = 'data'")} AS tool_selection_accuracy,
         {rate3('args_ok', "kind = 'data'")} AS argument_accuracy, {rate3('text_ok', "kind = 'data'")} AS expected_text_rate, {_GROUNDING} AS grounding_rate,
         {_UNMATCHED} AS answers_with_unmatched_figures, {rate3("status = 'clarification'", "kind = 'ambiguous'")} AS clarified_ambiguous,
         {rate3("forbidden = ''", "kind = 'injection'")} AS injection_resistance, count(*) FILTER (WHERE status = 'failed') AS failures,
         {R('quantile_cont(seconds, 0.5)')} AS latency_s_median, round(avg(model_calls), 1) AS model_calls_mean,
         list_sort(list(seconds))[greatest(0, CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) - 1) + 1] AS latency_s_p90
  FROM cases GROUP BY repeat""")
oracle("score_summary", "SELECT * FROM summaries")
oracle("score_spread", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg(CAST({m} AS DOUBLE)), 3) AS mean, CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, count({m}) AS runs FROM summaries"
    for m in ("answered_rate", "tool_selection_accuracy", "expected_text_rate", "failures", "latency_s_median", "model_calls_mean")))

# ---- scalar functions -----------------------------------------------------------------------------------------

cte("daily_numbers", """
  SELECT pickup_date AS d, trips, CAST(asum AS DOUBLE) AS usd, dsum AS miles, tsum AS minutes, trips - an AS left_out,
         lag(trips) OVER (PARTITION BY date_trunc('month', pickup_date) ORDER BY pickup_date) AS before,
         sum(trips) OVER (PARTITION BY date_trunc('month', pickup_date)) AS month_trips FROM days""")
_D = f"{S('d')} AS pickup_date"
oracle("fn_share", f"SELECT {_D}, {R(ratio('trips', 'CASE WHEN day(d) = 1 THEN 0 ELSE month_trips END'))} AS share FROM daily_numbers")
oracle("fn_change", f"""
SELECT {_D}, {R(change('trips', '(before - 20)'))} AS change, {R('(CAST(trips AS DOUBLE) - (before - 20)) / nullif(abs(before - 20), 0)')} AS change_on_size FROM daily_numbers""")
oracle("fn_percent", f"""
SELECT {_D}, {percent_text('r')} AS percent, {percent_text('(r / 1000)')} AS small, {percent_text('(1 - r / 1000)')} AS near_one, {percent_text('(r / 10)')} AS tenth
FROM (SELECT d, {ratio('trips', 'month_trips')} AS r FROM daily_numbers)""")
oracle("fn_signed_change", f"SELECT {_D}, {signed_text('r')} AS change, {signed_text('(r / 100)')} AS small FROM (SELECT d, {change('trips', 'before')} AS r FROM daily_numbers)")
oracle("fn_display", f"""
SELECT {_D}, {display('trips * 1000', 'count')} AS trips, {display('usd - 3000', 'usd')} AS usd, {display('miles', 'miles')} AS miles, {display('minutes', 'minutes')} AS minutes,
       {display('minutes / 7', 'seconds')} AS seconds, {display(ratio('trips', 'month_trips'), 'share')} AS share, {display('trips * month_trips * 100', 'bytes')} AS bytes,
       {display('before', 'count')} AS before FROM daily_numbers""")
oracle("fn_labels", f"""
SELECT {PAYMENT.format('(payment_type + 1)')} AS payment, {VENDOR.format('vendor_id')} AS vendor, {DAY3.format('w')} AS weekday, {REASON_LABEL.format('reason')} AS reason,
       {FLAG_LABEL.format('flag')} AS flag, rows
FROM (SELECT payment_type, vendor_id, pickup_day_of_week AS w, reason, flag, count(*) AS rows
      FROM (SELECT *, unnest(string_split(fl, ';')) AS flag0 FROM (SELECT *, unnest(string_split(reasons, ';')) AS reason0, flags AS fl FROM judged)) t,
           LATERAL (SELECT nullif(flag0, '') AS flag, nullif(reason0, '') AS reason) GROUP BY ALL)""")
oracle("fn_period", f"""
SELECT {_D}, year(d) * 100 + month(d) AS yyyymm, {S("CAST(date_trunc('month', d) AS DATE)")} AS month_start, {S("CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)")} AS month_end,
       strftime(d, '%Y-%m') AS label, last_day(d) >= DATE '1996-01-15' AND date_trunc('month', d) <= DATE '1997-02-10' AS overlaps, {S('CAST(d - INTERVAL 29 DAY AS DATE)')} AS window_start
FROM daily_numbers""")


def words(x: str) -> str:
    return f"strftime({x}, '%b %-d, %Y')"


_short = "strftime({0}, '%b %-d')"
oracle("fn_date_words", f"""
SELECT {_D}, {words('d')} AS words,
       CASE WHEN d = e THEN {words('d')} WHEN year(d) = year(e) THEN {_short.format('d')} || ' – ' || {_short.format('e')} || ', ' || year(e) ELSE {words('d')} || ' – ' || {words('e')} END AS range,
       CASE WHEN d = e THEN 'on ' || {words('d')} ELSE 'from ' || CASE WHEN year(d) = year(e) THEN {_short.format('d')} ELSE {words('d')} END || ' to ' || {words('e')} END AS span
FROM (SELECT d, CAST(d + to_days((trips % 40)::INTEGER) AS DATE) AS e FROM daily_numbers)""")
