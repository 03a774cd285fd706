"""SQL statements, for a second engine, equivalent to the registered queries.

They follow the row-level definitions (repair every hour, then total; windows
for the best seller), not the plans of the Spark side.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SERIES = (
    "total_visitors total_transactions total_quantity total_revenue total_cost total_margin "
    "conversion_rate avg_transaction_value revenue_per_visitor margin_per_visitor"
).split()
ADDITIVE = (
    "total_visitors total_transactions total_quantity total_revenue total_cost total_margin "
    "avg_revenue_last_4_weeks avg_visitors_last_4_weeks avg_sales_last_4_weeks"
).split()
METRIC_TYPES = (
    "date:t day_of_week:s store_id:s total_visitors:d avg_visitors_last_4_weeks:d "
    "visitors_variation_vs_avg_4w_percent:d total_transactions:i avg_sales_last_4_weeks:d "
    "transactions_variation_vs_avg_4w_percent:d total_quantity:i best_selling_product_id:s "
    "best_selling_product_name:s total_revenue:d avg_revenue_last_4_weeks:d "
    "revenue_variation_vs_avg_4w_percent:d total_cost:d total_margin:d conversion_rate:d "
    "avg_transaction_value:d transactions_amount_variation_vs_avg_4w_percent:d "
    "revenue_per_visitor:d margin_per_visitor:d peak_hour_sales:i peak_hour_visitors:i"
)

BASE = """
o AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS day,
         CAST(o_custkey % 25 AS VARCHAR) AS store_id, o_orderkey % 24 AS hour
  FROM orders),
stores_v AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, r_name AS location,
         100 + 140 * n_nationkey AS capacity, CASE WHEN n_nationkey % 5 = 0 THEN '0' ELSE CAST(7 + n_nationkey % 3 AS VARCHAR) END AS opening_hour,
         CASE WHEN n_nationkey % 5 = 0 THEN '24' ELSE CAST(19 + n_nationkey % 4 AS VARCHAR) END AS closing_hour
  FROM nation JOIN region ON n_regionkey = r_regionkey),
products_v AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS category,
         p_retailprice AS price,
         round_even(p_retailprice * CAST(0.65 AS DOUBLE) * 100, 0) / 100 AS cost
  FROM part WHERE p_partkey % 10 <> 0),
clients_v AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
         CAST(floor(abs(c_acctbal) / 40) AS INTEGER) AS age, CAST(NULL AS VARCHAR) AS gender,
         c_mktsegment = 'BUILDING' AS loyalty_card, r_name AS city
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sales_v AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sale_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS nb_type_product,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(o_custkey AS VARCHAR) AS client_id,
         store_id, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS sale_amount,
         lpad(CAST(hour AS VARCHAR), 2, '0') || ':00:00' AS sale_time, day AS sale_date
  FROM lineitem JOIN o ON l_orderkey = o_orderkey),
traffic_v AS (
  SELECT store_id, 'NATION_' || store_id AS store_name, hour,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 9500 AS visitors, count(*) AS sales,
         day AS date
  FROM o WHERE NOT (store_id = '3' AND day(day) = 13) GROUP BY store_id, hour, day),
flawed_v AS (
  SELECT id, location, CASE WHEN id <> '12' THEN capacity END AS capacity,
         CASE WHEN id <> '13' THEN CAST(opening_hour AS INTEGER) END AS opening_hour,
         CAST(closing_hour AS INTEGER) AS closing_hour
  FROM stores_v WHERE id <> '11'),
gappy_v AS (
  SELECT store_id, store_name, hour, date,
         CASE WHEN hour NOT IN (3, 5) THEN visitors END AS visitors,
         CASE WHEN hour NOT IN (3, 7) THEN sales END AS sales
  FROM traffic_v)"""


def even(expression: str, places: int) -> str:
    scale = "1" + "0" * places
    return f"round_even(CAST({expression} AS DOUBLE) * {scale}, 0) / {scale}"


def shown(metric: str) -> str:
    """A number as the decimal that its text shows, not the nearest to its binary value."""
    return f"CAST(CAST(CAST({metric} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,10))"


def total(metric: str) -> str:
    return f"CAST(coalesce(sum({shown(metric)}), 0) AS DOUBLE)"


def mean(metric: str) -> str:
    return f"CAST(sum({shown(metric)}) AS DOUBLE) / count({metric})"


def output(columns: str) -> str:
    """SELECT list with explicit types: t date as text, s text, i whole, d double, b boolean."""
    forms = {
        "t": "strftime({0}, '%Y-%m-%d')",
        "s": "CAST({0} AS VARCHAR)",
        "i": "CAST({0} AS BIGINT)",
        "d": "round_even(CAST({0} AS DOUBLE) * 1e6, 0) / 1e6 + 0.0",
        "b": "CAST({0} AS BOOLEAN)",
    }
    parts = []
    for column in columns.split():
        name, kind = column.split(":")
        parts.append(f"{forms[kind].format(name)} AS {name}")
    return ",\n  ".join(parts)


def statement(ctes: list[str], source: str, columns: str) -> str:
    return (
        "WITH " + ",".join([BASE, *ctes]) + f"\nSELECT {output(columns)}\nFROM ({source}) result"
    )


def add(key: str, source: str, columns: str, ctes: list[str] = ()) -> None:
    ORACLES[key] = statement(list(ctes), source, columns)


def repaired(name: str, source: str, limit: int = 5000, mode: str = "reference") -> str:
    new = (
        "CAST(sales AS DOUBLE) * (CAST(vs * 100 AS DOUBLE) / vv)"
        if mode == "reference"
        else "CAST(sales AS DOUBLE) * vv / nullif(vs, 0)"
    )
    return f"""
{name}_ratio AS (
  SELECT store_id, sum(CASE WHEN visitors > 0 AND visitors <= {limit} THEN coalesce(sales, 0) END) AS vs,
         sum(CASE WHEN visitors > 0 AND visitors <= {limit} THEN visitors END) AS vv
  FROM {source} GROUP BY store_id),
{name} AS (
  SELECT store_id, date, hour, sales,
         CASE WHEN visitors > {limit} AND vv IS NOT NULL THEN {new}
              ELSE CAST(visitors AS DOUBLE) END AS visitors
  FROM {source} JOIN {name}_ratio USING (store_id)
  WHERE NOT (visitors IS NULL AND sales IS NULL))"""


def traffic_days(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT date, store_id, coalesce(sum(visitors), 0) AS total_visitors,
         coalesce(sum(sales), 0) AS total_transactions,
         (array_agg(hour ORDER BY sales DESC, hour) FILTER (WHERE sales IS NOT NULL))[1]
           AS peak_hour_sales,
         (array_agg(hour ORDER BY visitors DESC, hour) FILTER (WHERE visitors IS NOT NULL))[1]
           AS peak_hour_visitors
  FROM {source} GROUP BY date, store_id)"""


SALES_DAYS = """
line AS (
  SELECT s.*, p.name, p.cost, quantity * p.cost AS total_cost
  FROM sales_v s JOIN products_v p ON s.product_id = p.id),
sales_total AS (
  SELECT sale_date AS date, store_id, sum(quantity) AS total_quantity,
         CAST(sum(CAST(sale_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
  FROM sales_v GROUP BY sale_date, store_id),
cost_total AS (
  SELECT sale_date AS date, store_id,
         round_even(CAST(sum(quantity * CAST(cost AS DECIMAL(18,2))) AS DOUBLE) * 100, 0) / 100
           AS total_cost
  FROM line GROUP BY sale_date, store_id),
product_total AS (
  SELECT sale_date AS date, store_id, product_id, name, sum(quantity) AS quantity
  FROM line GROUP BY sale_date, store_id, product_id, name),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY date, store_id ORDER BY quantity DESC) AS place,
         row_number() OVER (PARTITION BY date, store_id
                            ORDER BY quantity DESC, product_id DESC, name DESC) AS rn
  FROM product_total),
best AS (
  SELECT date, store_id, product_id AS best_selling_product_id,
         name AS best_selling_product_name, quantity AS max_quantity
  FROM ranked WHERE rn = 1)"""


def merged(name: str, traffic: str, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT date, store_id, coalesce(total_visitors, 0) AS total_visitors,
         coalesce(total_transactions, 0) AS total_transactions,
         coalesce(peak_hour_sales, 0) AS peak_hour_sales,
         coalesce(peak_hour_visitors, 0) AS peak_hour_visitors,
         coalesce(total_quantity, 0) AS total_quantity,
         coalesce(total_revenue, 0) AS total_revenue, coalesce(total_cost, 0) AS total_cost,
         best_selling_product_id, best_selling_product_name, dayname(date) AS day_of_week
  FROM {traffic}
  FULL JOIN (SELECT * FROM sales_total WHERE {where}) USING (date, store_id)
  FULL JOIN (SELECT * FROM cost_total WHERE {where}) USING (date, store_id)
  FULL JOIN (SELECT * FROM best WHERE {where}) USING (date, store_id))"""


def averaged(name: str, batch: str, history: str | None = None) -> str:
    measures = "date, store_id, total_transactions, total_visitors, total_revenue"
    past = f" UNION ALL SELECT false, {measures} FROM {history}" if history else ""
    return f"""
{name}_rows AS (SELECT true AS is_new, {measures} FROM {batch}{past}),
{name}_avg AS (
  SELECT is_new, date, store_id,
    {even("avg(total_transactions) OVER w", 2)} AS avg_sales_last_4_weeks,
    {even("avg(total_visitors) OVER w", 2)} AS avg_visitors_last_4_weeks,
    {even("CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w", 2)}
      AS avg_revenue_last_4_weeks
  FROM {name}_rows
  WINDOW w AS (PARTITION BY store_id, dayname(date) ORDER BY date
               ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
{name} AS (
  SELECT b.*, a.* EXCLUDE (is_new, date, store_id)
  FROM {batch} b JOIN {name}_avg a ON a.is_new AND a.date = b.date AND a.store_id = b.store_id)"""


def finished(name: str, source: str) -> str:
    def variation(value: str, base: str) -> str:
        return f"({value} - {base}) * 100 / nullif({base}, 0)"

    basket = "(avg_revenue_last_4_weeks / nullif(avg_sales_last_4_weeks, 0))"
    return f"""
{name}_kpi AS (
  SELECT *, total_revenue - total_cost AS total_margin,
    CASE WHEN total_visitors > 0 THEN CAST(total_transactions * 100 AS DOUBLE) / total_visitors END
      AS conversion_rate,
    CASE WHEN total_transactions > 0 THEN total_revenue / total_transactions END
      AS avg_transaction_value,
    CASE WHEN total_visitors > 0 THEN total_revenue / total_visitors END AS revenue_per_visitor,
    CASE WHEN total_visitors > 0 THEN (total_revenue - total_cost) / total_visitors END
      AS margin_per_visitor
  FROM {source}),
{name} AS (
  SELECT *,
    {variation("total_visitors", "avg_visitors_last_4_weeks")}
      AS visitors_variation_vs_avg_4w_percent,
    {variation("total_transactions", "avg_sales_last_4_weeks")}
      AS transactions_variation_vs_avg_4w_percent,
    {variation("total_revenue", "avg_revenue_last_4_weeks")}
      AS revenue_variation_vs_avg_4w_percent,
    {variation("avg_transaction_value", basket)}
      AS transactions_amount_variation_vs_avg_4w_percent
  FROM {name}_kpi)"""


DAYS = [repaired("fixed", "traffic_v"), traffic_days("traffic_day", "fixed"), SALES_DAYS,
        merged("day_v", "traffic_day")]
METRICS = [*DAYS, averaged("avg_v", "day_v"), finished("metrics_v", "avg_v")]
PLAIN_DAYS = [traffic_days("traffic_day", "traffic_v")]
CUT = "DATE '1998-07-01'"
SPLIT = [
    f"\nold_feed AS (SELECT * FROM traffic_v WHERE date < {CUT})",
    f"\nnew_feed AS (SELECT * FROM traffic_v WHERE date >= {CUT})",
    repaired("old_fixed", "old_feed"), traffic_days("old_traffic", "old_fixed"),
    repaired("new_fixed", "new_feed"), traffic_days("new_traffic", "new_fixed"),
    SALES_DAYS,
    merged("old_day", "old_traffic", f"date < {CUT}"),
    merged("new_day", "new_traffic", f"date >= {CUT}"),
    f"\npast AS (SELECT * FROM old_day WHERE date >= {CUT} - 28)",
    averaged("avg_v", "new_day", "past"),
]

# Scans and lookups
PRODUCT_COLUMNS = "id:s name:s category:s price:d cost:d"
STORE_COLUMNS = "id:s name:s location:s capacity:i opening_hour:s closing_hour:s"
CLIENT_COLUMNS = "id:s name:s age:i gender:s loyalty_card:b city:s"
SALE_COLUMNS = ("sale_id:s nb_type_product:i product_id:s client_id:s store_id:s quantity:i "
                "sale_amount:d sale_time:s sale_date:t")
TRAFFIC_COLUMNS = "store_id:s store_name:s hour:i visitors:i sales:i date:t"
DAY_COLUMNS = ("date:t store_id:s total_visitors:d total_transactions:i peak_hour_sales:i "
               "peak_hour_visitors:i")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

add("scan_products", "FROM products_v", PRODUCT_COLUMNS)
add("scan_stores", "FROM stores_v", STORE_COLUMNS)
add("table_inventory",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS records FROM {t}" for t in TABLES),
    "table_name:s records:i")
add("file_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, count(*) AS records, true AS readable FROM {t}" for t in TABLES),
    "file:s records:i readable:b")
add("clients_by_city", "FROM clients_v WHERE lower(city) = 'asia'", CLIENT_COLUMNS)
add("distinct_cities", "SELECT DISTINCT city FROM clients_v", "city:s")
add("distinct_stores", "SELECT DISTINCT id FROM stores_v", "id:s")
add("sales_by_date_store",
    "FROM sales_v WHERE sale_date = DATE '1998-02-25' AND store_id = '2'", SALE_COLUMNS)
add("sales_by_hour",
    "FROM sales_v WHERE sale_date = DATE '1998-02-25' AND CAST(sale_time[1:2] AS INTEGER) = 19",
    SALE_COLUMNS)
add("traffic_by_date", "FROM traffic_v WHERE date = DATE '1998-02-25'", TRAFFIC_COLUMNS)
add("traffic_by_date_store",
    "FROM traffic_v WHERE date = DATE '1998-02-25' AND store_id = '2'", TRAFFIC_COLUMNS)

# Traffic
add("traffic_drop_null", "FROM gappy_v WHERE NOT (visitors IS NULL AND sales IS NULL)",
    "store_id:s store_name:s hour:i visitors:d sales:d date:t")
add("traffic_outlier_repair",
    "SELECT f.*, 'NATION_' || store_id AS store_name FROM fixed f",
    "store_id:s store_name:s hour:i visitors:d sales:i date:t", [repaired("fixed", "traffic_v")])
add("traffic_store_ratio",
    "SELECT store_id, vs AS valid_sales, vv AS valid_visitors, "
    "CAST(vs * 100 AS DOUBLE) / vv AS ratio FROM fixed_ratio",
    "store_id:s valid_sales:i valid_visitors:i ratio:d", [repaired("fixed", "traffic_v")])
add("traffic_daily", "FROM traffic_day", "date:t store_id:s total_visitors:d total_transactions:i",
    [repaired("fixed", "gappy_v"), traffic_days("traffic_day", "fixed")])
add("traffic_daily_inverse_rate", "FROM traffic_day",
    "date:t store_id:s total_visitors:d total_transactions:i",
    [repaired("fixed", "traffic_v", mode="inverse_rate"), traffic_days("traffic_day", "fixed")])
add("traffic_peak_hours", "FROM traffic_day",
    "date:t store_id:s peak_hour_sales:i peak_hour_visitors:i",
    [repaired("fixed", "traffic_v"), traffic_days("traffic_day", "fixed")])
EVENT_FEED = """
event_feed AS (
  SELECT CAST(ts AS DATE) AS date, CAST(user_id % 5 AS VARCHAR) AS store_id, hour(ts) AS hour,
         count(*) AS visitors, count(*) FILTER (WHERE event_type = 'purchase') AS sales
  FROM events GROUP BY 1, 2, 3)"""
add("event_traffic_daily", "FROM traffic_day", DAY_COLUMNS,
    [EVENT_FEED, traffic_days("traffic_day", "event_feed")])

# Sales
add("sales_with_cost", "FROM line",
    "sale_id:s product_id:s store_id:s sale_date:t quantity:i name:s cost:d total_cost:d",
    [SALES_DAYS])
add("sales_daily", "FROM sales_total", "date:t store_id:s total_quantity:i total_revenue:d",
    [SALES_DAYS])
add("cost_daily", "FROM cost_total", "date:t store_id:s total_cost:d", [SALES_DAYS])
add("product_quantity_daily", "FROM product_total",
    "date:t store_id:s product_id:s name:s quantity:i", [SALES_DAYS])
BEST_COLUMNS = ("date:t store_id:s best_selling_product_id:s best_selling_product_name:s "
                "max_quantity:i")
add("best_selling_ties",
    "SELECT date, store_id, product_id AS best_selling_product_id, "
    "name AS best_selling_product_name, quantity AS max_quantity FROM ranked WHERE place = 1",
    BEST_COLUMNS, [SALES_DAYS])
add("best_selling", "FROM best", BEST_COLUMNS, [SALES_DAYS])

# Merged days and metrics
add("daily_feeds_outer", "FROM day_v",
    DAY_COLUMNS + " total_quantity:i total_revenue:d total_cost:d best_selling_product_id:s "
    "best_selling_product_name:s", DAYS)
add("moving_avg_4w", "FROM avg_v",
    "date:t store_id:s day_of_week:s avg_sales_last_4_weeks:d avg_visitors_last_4_weeks:d "
    "avg_revenue_last_4_weeks:d", SPLIT)
add("moving_avg_kept", "FROM avg_v",
    "date:t store_id:s day_of_week:s avg_sales_last_4_weeks:d avg_visitors_last_4_weeks:d "
    "avg_revenue_last_4_weeks:d", SPLIT)
add("metrics_last_rows",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, dayname(date) ORDER BY date DESC) AS place "
    "FROM metrics_v) WHERE place <= 3",
    "date:t store_id:s total_transactions:i total_visitors:d total_revenue:d", METRICS)
add("final_metrics", "FROM metrics_v",
    "date:t store_id:s conversion_rate:d avg_transaction_value:d revenue_per_visitor:d "
    "total_margin:d margin_per_visitor:d", METRICS)
add("daily_metrics", "FROM metrics_v", METRIC_TYPES, METRICS)
add("daily_metrics_incremental", "FROM metrics_v", METRIC_TYPES,
    [*SPLIT, finished("metrics_v", "avg_v")])

# Incremental bookkeeping
add("processed_dates", f"SELECT DISTINCT date FROM traffic_v WHERE date < {CUT}", "date:t")
add("incremental_unprocessed",
    f"FROM traffic_v WHERE date NOT IN (SELECT date FROM traffic_v WHERE date < {CUT})",
    TRAFFIC_COLUMNS)
add("history_4w", f"FROM traffic_day WHERE date >= {CUT} - 28 AND date < {CUT}", DAY_COLUMNS,
    PLAIN_DAYS)
add("sales_day_merge",
    "SELECT * FROM sales_v WHERE CAST(sale_time[1:2] AS INTEGER) < 16 UNION "
    "SELECT * FROM sales_v WHERE CAST(sale_time[1:2] AS INTEGER) >= 12", SALE_COLUMNS)
add("traffic_day_merge",
    "SELECT * FROM traffic_v WHERE hour < 16 UNION SELECT * FROM traffic_v WHERE hour >= 12",
    TRAFFIC_COLUMNS)
add("metrics_upsert",
    "SELECT date, store_id, total_visitors + CASE WHEN date >= DATE '1998-06-15' THEN 1 ELSE 0 END "
    "AS total_visitors, total_transactions, peak_hour_sales, peak_hour_visitors FROM traffic_day",
    DAY_COLUMNS, PLAIN_DAYS)

add("mixed_feed_read", "SELECT * EXCLUDE (sales), CASE WHEN hour >= 12 THEN sales END AS sales FROM traffic_v",
    TRAFFIC_COLUMNS)
add("json_feed_read", "FROM traffic_v", TRAFFIC_COLUMNS)
add("alternating_days_read", "FROM traffic_v", TRAFFIC_COLUMNS)
add("json_array_read", "FROM traffic_v", TRAFFIC_COLUMNS)
add("snapshot_replace", "FROM products_v", PRODUCT_COLUMNS)
add("registered_days", "FROM traffic_v WHERE date IN (DATE '1998-02-24', DATE '1998-02-25')", TRAFFIC_COLUMNS)
add("cached_day", "FROM traffic_v WHERE date = DATE '1998-02-25'", TRAFFIC_COLUMNS)
add("stored_day_merge", "FROM traffic_v WHERE date = DATE '1998-02-25'", TRAFFIC_COLUMNS)

# Calendar series
RATIO = {
    "conversion_rate": f"100 * {total('total_transactions')} / nullif({total('total_visitors')}, 0)",
    "avg_transaction_value":
        f"{total('total_revenue')} / nullif({total('total_transactions')}, 0)",
}


def period_values(names: list[str], reweighted: bool = True) -> str:
    parts = []
    for name in names:
        if reweighted and name in RATIO:
            value = RATIO[name]
        elif name in ADDITIVE:
            value = total(name)
        else:
            value = mean(name)
        parts.append(f"{value} AS {name}")
    return ", ".join(parts)


VALUES = " ".join(f"{name}:d" for name in SERIES)
add("series_daily", f"SELECT date, {period_values(SERIES, False)} FROM metrics_v GROUP BY date",
    "date:t " + VALUES, METRICS)
MONTHLY = (
    "SELECT year(date) AS year, month(date) AS month, "
    "CAST(date_trunc('month', date) AS DATE) AS month_start, {} FROM {} GROUP BY ALL"
)
add("series_monthly", MONTHLY.format(period_values(SERIES), "metrics_v"),
    "year:i month:i month_start:t " + VALUES, METRICS)
add("series_annual",
    f"SELECT year(date) AS year, {period_values(SERIES)} FROM metrics_v GROUP BY year(date)",
    "year:i " + VALUES, METRICS)
MEANS = sorted(
    {c.split(":")[0] for c in METRIC_TYPES.split() if c[-1] in "id"} - set(ADDITIVE)
    | {"year", "month"}
)
QUARTERS = f"""
quarter_v AS (
  SELECT year(date) || '-Q' || quarter(date) AS quarter,
         year(date) * 4 + quarter(date) AS quarter_for_sort, store_id,
         {", ".join(f"{total(name)} AS {name}" for name in ADDITIVE)},
         {", ".join(f"{mean(name)} AS {name}" for name in MEANS)}
  FROM (SELECT *, year(date) AS year, month(date) AS month FROM metrics_v) GROUP BY ALL)"""
add("quarter_store_rollup", "FROM quarter_v",
    "quarter:s quarter_for_sort:i store_id:s "
    + " ".join(f"{name}:d" for name in [*ADDITIVE, *MEANS]), [*METRICS, QUARTERS])
add("series_quarterly",
    f"SELECT quarter, quarter_for_sort, {period_values(SERIES)} FROM quarter_v GROUP BY ALL",
    "quarter:s quarter_for_sort:i " + VALUES, [*METRICS, QUARTERS])
add("available_periods", "SELECT DISTINCT year(date) AS year, month(date) AS month FROM traffic_v",
    "year:i month:i")
add("available_years", "SELECT DISTINCT year(date) AS year FROM traffic_v", "year:i")


def long_form(wide: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, x, {name} AS y FROM ({wide})" for name in names
    )


VISITOR_THEME = ["total_visitors", "avg_visitors_last_4_weeks",
                 "visitors_variation_vs_avg_4w_percent"]
add("theme_series",
    long_form("SELECT strftime(date, '%Y-%m-%d') AS x, "
              f"{period_values(VISITOR_THEME, False)} FROM metrics_v "
              "WHERE year(date) = 1998 AND month(date) = 7 GROUP BY date", VISITOR_THEME),
    "metric:s x:s y:d", METRICS)
SALES_THEME = ["conversion_rate", "avg_transaction_value"]
MONTH_X = ("SELECT strftime(date_trunc('month', date), '%Y-%m-%d') AS x, {} FROM metrics_v "
           "WHERE {} GROUP BY 1")
add("theme_series_monthly",
    long_form(MONTH_X.format(
        period_values(SALES_THEME),
        "year(date) = 1998 AND store_id IN (SELECT id FROM stores_v WHERE name = 'NATION_7')"),
        SALES_THEME),
    "metric:s x:s y:d", METRICS)
VISITOR_RATIOS = ["revenue_per_visitor", "margin_per_visitor"]
add("theme_series_quarterly",
    long_form(f"SELECT quarter AS x, {period_values(VISITOR_RATIOS)} FROM quarter_v GROUP BY 1",
              VISITOR_RATIOS),
    "metric:s x:s y:d", [*METRICS, QUARTERS])
MARGINS = ["total_cost", "total_margin"]
add("theme_series_annual",
    long_form("SELECT CAST(year(date) AS VARCHAR) AS x, "
              f"{period_values(MARGINS)} FROM metrics_v GROUP BY 1", MARGINS),
    "metric:s x:s y:d", METRICS)
add("theme_catalogue", long_form(MONTH_X.format(period_values(SERIES), "true"), SERIES),
    "metric:s x:s y:d", METRICS)

# Labels
add("weekday_label",
    "SELECT DISTINCT day AS date, dayname(day) AS day_of_week, isodow(day) - 1 AS weekday_rank "
    "FROM o", "date:t day_of_week:s weekday_rank:i")
add("quarter_label",
    "SELECT DISTINCT day AS date, year(day) || '-Q' || quarter(day) AS quarter, "
    "year(day) * 4 + quarter(day) AS quarter_for_sort FROM o",
    "date:t quarter:s quarter_for_sort:i")
add("month_label",
    "SELECT DISTINCT day AS date, month(day) AS month, "
    "['Janvier','Février','Mars','Avril','Mai','Juin','Juillet','Août','Septembre','Octobre',"
    "'Novembre','Décembre'][month(day)] AS month_name FROM o",
    "date:t month_name:s month:i")

# KPIs
JULY = "date >= DATE '1998-07-01' AND date < DATE '1998-08-01'"
SLICE_COLUMNS = "date:t store_id:s total_visitors:d total_revenue:d"
add("metrics_slice_month", f"FROM metrics_v WHERE {JULY}", SLICE_COLUMNS, METRICS)
add("metrics_date_coerce", "FROM traffic_day WHERE store_id <> '7'", DAY_COLUMNS, PLAIN_DAYS)
add("metrics_for_store_name",
    "FROM metrics_v WHERE store_id IN (SELECT id FROM stores_v WHERE name = 'NATION_7')",
    SLICE_COLUMNS, METRICS)
KPI_COLUMNS = ("total_visitors:d total_transactions:d total_revenue:d total_cost:d total_margin:d "
               "conversion_rate:d avg_transaction_value:d revenue_millions:d cost_millions:d "
               "margin_millions:d")


def kpis(where: str) -> str:
    sums = ", ".join(
        f"{total(name)} AS {name}"
        for name in ("total_visitors", "total_transactions", "total_revenue", "total_cost")
    )
    return f"""
SELECT *, total_revenue - total_cost AS total_margin,
  CASE WHEN total_visitors > 0 THEN total_transactions / total_visitors * 100 ELSE 0 END
    AS conversion_rate,
  CASE WHEN total_transactions > 0 THEN total_revenue / total_transactions ELSE 0 END
    AS avg_transaction_value,
  total_revenue / 1e6 AS revenue_millions, total_cost / 1e6 AS cost_millions,
  (total_revenue - total_cost) / 1e6 AS margin_millions
FROM (SELECT {sums} FROM metrics_v WHERE {where})"""


add("kpi_totals", kpis(JULY), KPI_COLUMNS, METRICS)
add("kpi_all_time", kpis("true"), KPI_COLUMNS, METRICS)
add("kpi_month_to_date", kpis(JULY + " AND day(date) <= 15"), KPI_COLUMNS, METRICS)
JUNE = "date >= DATE '1998-06-01' AND date < DATE '1998-07-01'"
add("kpi_previous_month_to_date", kpis(JUNE + " AND day(date) <= 15"), KPI_COLUMNS, METRICS)


def variations(now: str, then: str) -> str:
    names = ["total_visitors", "total_transactions", "total_revenue", "total_cost", "total_margin"]
    sums = ", ".join(f"{total(name)} AS {name}" for name in names)
    one = f"""
SELECT count(*) AS n, {sums},
  CASE WHEN {total("total_visitors")} > 0
       THEN {total("total_transactions")} / {total("total_visitors")} * 100 ELSE 0 END
    AS conversion_rate,
  CASE WHEN {total("total_transactions")} > 0
       THEN {total("total_revenue")} / {total("total_transactions")} ELSE 0 END
    AS avg_transaction_value
FROM metrics_v WHERE """
    parts = []
    for name in [*names, "conversion_rate", "avg_transaction_value"]:
        usable = f"p.{name} > 0" if name in ("total_cost", "total_margin") else f"p.{name} <> 0"
        parts.append(
            f"CASE WHEN c.n > 0 AND p.n > 0 AND {usable} "
            f"THEN (c.{name} - p.{name}) / p.{name} * 100 END AS {name}"
        )
    return f"SELECT {', '.join(parts)} FROM ({one}{now}) c, ({one}{then}) p"


VARIATION_COLUMNS = ("total_visitors:d total_transactions:d total_revenue:d total_cost:d "
                     "total_margin:d conversion_rate:d avg_transaction_value:d")
add("kpi_variations", variations(JULY, JUNE), VARIATION_COLUMNS, METRICS)
add("kpi_variations_january",
    variations("year(date) = 1998 AND month(date) = 1", "year(date) = 1997 AND month(date) = 12"),
    VARIATION_COLUMNS, METRICS)
add("kpi_variations_to_date",
    variations(JULY + " AND day(date) <= 15", JUNE + " AND day(date) <= 15"),
    VARIATION_COLUMNS, METRICS)

# Reconciliation and quality
BASKETS = "SELECT store_id, count(DISTINCT sale_id) AS total_sales FROM sales_v GROUP BY store_id"
OPEN_HOURS = """
SELECT t.store_id, sum(t.sales) AS total_sales
FROM traffic_v t LEFT JOIN stores_v s ON t.store_id = s.id
WHERE t.hour >= CAST(s.opening_hour AS INTEGER) AND t.hour < CAST(s.closing_hour AS INTEGER)
GROUP BY t.store_id HAVING sum(t.sales) IS NOT NULL"""
add("baskets_per_store", BASKETS, "store_id:s total_sales:i")
add("open_hours_sales", OPEN_HOURS, "store_id:s total_sales:i")
add("reconcile_sales_traffic",
    "SELECT store_id, b.total_sales AS basket_sales, t.total_sales AS traffic_sales, "
    "b.total_sales IS NOT DISTINCT FROM t.total_sales AS matches "
    f"FROM ({BASKETS}) b FULL JOIN ({OPEN_HOURS}) t USING (store_id)",
    "store_id:s basket_sales:i traffic_sales:i matches:b")
add("dq_closed_hours",
    "SELECT * FROM (SELECT t.*, opening_hour, closing_hour, CASE WHEN s.id IS NULL THEN 'unknown store' "
    "WHEN opening_hour IS NULL THEN 'unreadable hours' "
    "WHEN NOT (hour >= opening_hour AND hour < closing_hour) THEN 'closed' END AS reason "
    "FROM traffic_v t LEFT JOIN flawed_v s ON t.store_id = s.id WHERE visitors > 0 OR sales > 0) "
    "WHERE reason IS NOT NULL",
    "date:t store_id:s hour:i visitors:i sales:i opening_hour:i closing_hour:i reason:s")
add("dq_over_capacity",
    "SELECT *, CASE WHEN store IS NULL THEN 'unknown store' WHEN visitor_limit IS NULL "
    "THEN 'missing capacity' ELSE 'over capacity' END AS reason FROM ("
    "SELECT t.*, s.id AS store, CASE WHEN isodow(date) >= 6 THEN floor(capacity * 1.25) "
    "ELSE capacity END AS visitor_limit FROM traffic_v t LEFT JOIN flawed_v s ON t.store_id = s.id) "
    "WHERE visitors > 0 AND coalesce(visitors > visitor_limit, true)",
    "date:t store_id:s hour:i visitors:i visitor_limit:i reason:s")
add("dq_traffic_profile",
    "SELECT *, null_hours / hours AS null_rate, outlier_hours / hours AS outlier_rate FROM ("
    "SELECT store_id, count(*) AS hours, "
    "count(*) FILTER (WHERE visitors IS NULL AND sales IS NULL) AS null_hours, "
    "count(*) FILTER (WHERE visitors > 5000) AS outlier_hours FROM gappy_v GROUP BY store_id)",
    "store_id:s hours:i null_hours:i outlier_hours:i null_rate:d outlier_rate:d")
add("dq_line_amount",
    "SELECT *, CASE WHEN expected_amount IS NULL THEN 'unknown product' ELSE 'other amount' END AS reason "
    "FROM (SELECT s.* EXCLUDE (sale_amount), round_even(price * quantity * 100, 0) / 100 AS expected_amount, "
    "CASE WHEN CAST(sale_id AS BIGINT) % 2 = 0 THEN round_even(price * quantity * 100, 0) / 100 "
    "ELSE sale_amount END AS sale_amount "
    "FROM sales_v s LEFT JOIN products_v p ON s.product_id = p.id) "
    "WHERE coalesce(abs(sale_amount - expected_amount) > CAST(0.005 AS DOUBLE), true)",
    "sale_id:s product_id:s quantity:i sale_amount:d expected_amount:d reason:s")
add("dq_basket_size",
    "SELECT sale_id, max(nb_type_product) AS declared, count(DISTINCT product_id) AS found "
    "FROM sales_v GROUP BY sale_id "
    "HAVING min(nb_type_product) IS DISTINCT FROM count(DISTINCT product_id) "
    "OR max(nb_type_product) IS DISTINCT FROM count(DISTINCT product_id)",
    "sale_id:s declared:i found:i")
add("dq_client_city",
    "SELECT client_id, store_id, city, location, count(*) AS lines, CASE WHEN any_value(c.id) IS NULL "
    "THEN 'unknown client' WHEN any_value(s.id) IS NULL THEN 'unknown store' ELSE 'other city' END AS reason "
    "FROM sales_v LEFT JOIN (SELECT * FROM clients_v WHERE CAST(id AS BIGINT) % 10 <> 0) c "
    "ON client_id = c.id LEFT JOIN flawed_v s ON store_id = s.id "
    "WHERE c.id IS NULL OR s.id IS NULL OR city <> location GROUP BY ALL",
    "client_id:s store_id:s city:s location:s lines:i reason:s")
add("dq_client_age", "FROM clients_v WHERE age >= 200", CLIENT_COLUMNS)
add("dq_feed_errors",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE nb_type_product = 5) AS error_rows, "
    "count(*) FILTER (WHERE sale_id IS NULL OR store_id IS NULL) AS keyless_rows, "
    "count(*) FILTER (WHERE nb_type_product <> 5 AND sale_id IS NOT NULL AND store_id IS NOT NULL) "
    "AS usable_rows FROM sales_v",
    "rows:i error_rows:i keyless_rows:i usable_rows:i")
