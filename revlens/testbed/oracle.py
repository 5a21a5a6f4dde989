"""DuckDB SQL that states, independently of Spark, what every registered query must return.

`STEPS` holds one common table expression per step from the test tables to the marts. A query's SQL
is its own SELECT with exactly the steps it needs in front.
"""

from __future__ import annotations

import re

from revlens.config import SEGMENTS, Settings
from revlens.testbed.binding import PARTS, SECOND_PART_STARTS
from revlens.testbed.catalog import COHORT_DEPTH, REGION, SEASON, TOP_MARKETS

RECENT = ("2000-08", "2001-07")
PRIOR = ("1999-08", "2000-07")


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def _round(value: str, digits: int = 2) -> str:
    return f"ROUND(CAST({value} AS DECIMAL(28,8)), {digits})::DOUBLE"


def _pct(part: str, whole: str) -> str:
    return f"100.0::DOUBLE * ({part})::DOUBLE / NULLIF(({whole})::DOUBLE, 0)"


def _ratio(part: str, whole: str) -> str:
    return f"({part})::DOUBLE / NULLIF(({whole})::DOUBLE, 0)"


SALES = "line_type IN ('product', 'shipping')"
KEY = "invoice_no, stock_code, quantity, invoice_ts, unit_price"
GROSS = "COALESCE(SUM(line_revenue) FILTER (is_cancellation = 0), 0)"
RETURNS = "COALESCE(SUM(line_revenue) FILTER (is_cancellation = 1), 0)"
RATE = _pct("-returns", "gross_revenue")
RATE_OF_F = _pct("-f.returns", "f.gross_revenue")


def _fifth(place: str) -> str:
    """Which fifth (from 0) a place belongs to, where `longer` fifths have one place more."""
    return (
        f"CASE WHEN {place} < longer * (fifth + 1) THEN {place} // (fifth + 1) "
        f"ELSE longer + ({place} - longer * (fifth + 1)) // NULLIF(fifth, 0) END"
    )


CLASS = f"""CASE
    WHEN stock_code IN ({_listed(Settings().shipping_codes)}) THEN 'shipping'
    WHEN stock_code IN ({_listed(Settings().adjustment_codes)}) THEN 'adjustment'
    WHEN stock_code IN ({_listed(Settings().test_codes)}) THEN 'test'
    ELSE 'product' END"""
LISTED_CODES = _listed(
    Settings().shipping_codes + Settings().adjustment_codes + Settings().test_codes
)
MONTHS = "CAST(substr({0}, 1, 4) AS BIGINT) * 12 + CAST(substr({0}, 6, 2) AS BIGINT)"

STEPS = {
    "base": """
    SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE '' END
               || CAST(l_orderkey AS VARCHAR) AS "Invoice",
           CASE WHEN l_partkey % 97 = 0 THEN 'post'
                WHEN l_partkey % 101 = 0 THEN 'M'
                WHEN l_partkey % 103 = 0 THEN 'TEST001'
                ELSE ' p' || CAST(l_partkey AS VARCHAR) || ' ' END AS "StockCode",
           CASE WHEN l_linenumber <> 7 THEN p_name END AS "Description",
           CASE WHEN l_discount = 0.1::DOUBLE AND l_tax = 0.08::DOUBLE THEN 0
                WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -CAST(l_quantity AS BIGINT)
                ELSE CAST(l_quantity AS BIGINT) END AS "Quantity",
           o_orderdate + to_seconds(o_orderkey % 86400) AS "InvoiceDate",
           CAST(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END
                AS DECIMAL(18,4)) AS "Price",
           CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS "Customer ID",
           n_name AS "Country", l_orderkey, l_linenumber, l_partkey
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""",
    "raw": f"""
    SELECT * EXCLUDE (branch, l_orderkey, l_linenumber, l_partkey),
           CASE WHEN "InvoiceDate" < TIMESTAMP '{SECOND_PART_STARTS}' THEN '{PARTS[0]}'
                ELSE '{PARTS[1]}' END AS source_part,
           branch * 100000000000000000 + l_linenumber * 1000000000000000 + l_partkey
               AS source_ordinal
    FROM (
        SELECT *, CAST(0 AS BIGINT) AS branch FROM base
        UNION ALL
        SELECT *, 1 FROM base WHERE l_orderkey % 31 = 0
        UNION ALL
        SELECT * REPLACE ('C' || "Invoice" AS "Invoice", -"Quantity" AS "Quantity"), 2
        FROM base WHERE l_orderkey % 50 = 0 AND "Quantity" > 0
    )""",
    "audit": """
    SELECT * REPLACE (CASE WHEN "Country" = 'NATION_0' THEN 'Home' ELSE "Country" END AS "Country"),
           upper(trim("StockCode")) AS code,
           CAST("Quantity" * "Price" AS DECIMAL(18,4)) AS value
    FROM raw""",
    "normalised": """
    SELECT trim("Invoice") AS invoice_no, upper(trim("StockCode")) AS stock_code,
           trim("Description") AS description, "Quantity" AS quantity,
           date_trunc('minute', "InvoiceDate")::TIMESTAMP AS invoice_ts, "Price" AS unit_price,
           "Customer ID" AS customer_id,
           CASE WHEN trim("Country") = 'NATION_0' THEN 'Home' ELSE trim("Country") END AS country,
           CAST("Quantity" * "Price" AS DECIMAL(18,4)) AS line_revenue, source_ordinal
    FROM raw""",
    "modal": """
    SELECT stock_code, description AS modal_description
    FROM (SELECT stock_code, description, COUNT(*) AS n FROM normalised
          WHERE description IS NOT NULL GROUP BY 1, 2)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY n DESC, description) = 1""",
    "deduped": f"""
    SELECT *, COUNT(*) OVER (PARTITION BY {KEY}) AS copies
    FROM normalised
    QUALIFY ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY source_ordinal) = 1""",
    "cleaned": f"""
    SELECT invoice_no, stock_code, COALESCE(description, modal_description) AS description,
           quantity, unit_price, line_revenue, invoice_ts, customer_id, country,
           starts_with(upper(invoice_no), 'C') AS is_cancellation, {CLASS} AS line_type, copies,
           CASE WHEN unit_price <= 0 THEN 'non_positive_unit_price'
                WHEN quantity = 0 THEN 'zero_quantity' END AS quarantine_reason
    FROM deduped LEFT JOIN modal USING (stock_code)""",
    "kept": """
    SELECT * EXCLUDE (copies, quarantine_reason) FROM cleaned WHERE quarantine_reason IS NULL""",
    "d_date": """
    SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(day AS DATE) AS date,
           CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter,
           CAST(month(day) AS INTEGER) AS month, monthname(day) AS month_name,
           strftime(day, '%Y-%m') AS year_month, CAST(weekofyear(day) AS INTEGER) AS iso_week,
           CAST(isodow(day) AS INTEGER) AS day_of_week, dayname(day) AS day_name,
           CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend
    FROM (SELECT unnest(generate_series(MIN(invoice_ts)::DATE, MAX(invoice_ts)::DATE,
                                        INTERVAL 1 DAY)) AS day
          FROM kept)""",
    "home": """
    SELECT customer_id, country AS home_country
    FROM (SELECT customer_id, country, COUNT(*) AS n FROM kept WHERE customer_id IS NOT NULL
          GROUP BY 1, 2)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY n DESC, country) = 1""",
    "d_customer": """
    SELECT ROW_NUMBER() OVER (ORDER BY customer_id) AS customer_key, customer_id,
           first_purchase_ts, last_purchase_ts,
           CAST(floor(epoch(last_purchase_ts - first_purchase_ts) / 86400) AS INTEGER)
               AS tenure_days,
           home_country, 0 AS is_guest
    FROM (SELECT customer_id, MIN(invoice_ts) AS first_purchase_ts,
                 MAX(invoice_ts) AS last_purchase_ts
          FROM kept WHERE customer_id IS NOT NULL GROUP BY 1)
    JOIN home USING (customer_id)
    UNION ALL
    SELECT -1, NULL, NULL, NULL, NULL, NULL, 1""",
    "usual": """
    SELECT stock_code, description
    FROM (SELECT stock_code, description, COUNT(*) AS n FROM kept WHERE description IS NOT NULL
          GROUP BY 1, 2)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY n DESC, description) = 1""",
    "d_product": """
    SELECT ROW_NUMBER() OVER (ORDER BY stock_code) AS product_key, stock_code, description,
           line_type
    FROM (SELECT DISTINCT stock_code, line_type FROM kept) LEFT JOIN usual USING (stock_code)""",
    "d_country": """
    SELECT ROW_NUMBER() OVER (ORDER BY country) AS country_key, country, r_name AS region
    FROM (SELECT DISTINCT country FROM kept)
    JOIN nation ON CASE WHEN n_name = 'NATION_0' THEN 'Home' ELSE n_name END = country
    JOIN region ON n_regionkey = r_regionkey""",
    "lines": """
    SELECT ROW_NUMBER() OVER (ORDER BY invoice_no, stock_code, invoice_ts, quantity, unit_price)
               AS sale_key,
           invoice_no, CAST(strftime(invoice_ts, '%Y%m%d') AS INTEGER) AS date_key,
           CASE WHEN customer_id IS NULL THEN -1 ELSE customer_key END AS customer_key,
           product_key, country_key, invoice_ts, quantity, unit_price, line_revenue,
           CAST(is_cancellation AS INTEGER) AS is_cancellation,
           strftime(invoice_ts, '%Y-%m') AS year_month, k.customer_id, k.stock_code, k.line_type,
           k.country, region
    FROM kept k
    LEFT JOIN (SELECT customer_key, customer_id FROM d_customer WHERE is_guest = 0) USING (customer_id)
    LEFT JOIN (SELECT product_key, stock_code FROM d_product) USING (stock_code)
    LEFT JOIN d_country USING (country)""",
    "sales": f"""
    SELECT * FROM lines WHERE {SALES}""",
    # one row per invoice, month and customer: an invoice counts as an order where it keeps a line
    "invoice_months": """
    SELECT year_month, invoice_no, customer_key,
           SUM(CASE is_cancellation WHEN 0 THEN line_revenue ELSE 0 END) AS sold,
           SUM(CASE is_cancellation WHEN 1 THEN line_revenue ELSE 0 END) AS undone,
           bool_or(is_cancellation = 0) AS kept
    FROM sales GROUP BY ALL""",
    "month_money": """
    SELECT year_month, SUM(sold) AS gross_revenue, SUM(undone) AS returns,
           SUM(sold) + SUM(undone) AS net_revenue
    FROM invoice_months GROUP BY year_month""",
    "month_orders": """
    SELECT year_month, COUNT(*) AS orders
    FROM (SELECT DISTINCT year_month, invoice_no FROM invoice_months WHERE kept) GROUP BY year_month""",
    "month_buyers": """
    SELECT year_month, COUNT(*) AS active_customers
    FROM (SELECT DISTINCT year_month, customer_key FROM invoice_months
          WHERE kept AND customer_key > 0) GROUP BY year_month""",
    "month_figures": """
    SELECT m.*, COALESCE(o.orders, 0) AS orders, COALESCE(b.active_customers, 0) AS active_customers,
           COUNT(*) OVER (ORDER BY m.year_month ROWS UNBOUNDED PRECEDING) AS place
    FROM month_money m
    LEFT JOIN month_orders o USING (year_month) LEFT JOIN month_buyers b USING (year_month)""",
    # a month is set against the one a place before it
    "trend": f"""
    SELECT f.year_month, f.gross_revenue, f.returns, f.net_revenue, f.orders, f.active_customers,
           {_ratio("f.gross_revenue", "f.orders")} AS aov, {RATE_OF_F} AS return_rate_pct,
           f.net_revenue - before.net_revenue AS net_revenue_mom_delta,
           {_pct("f.net_revenue - before.net_revenue", "before.net_revenue")} AS net_revenue_mom_pct
    FROM month_figures f LEFT JOIN month_figures before ON before.place = f.place - 1""",
    "buyer_totals": """
    SELECT i.customer_key, SUM(i.sold) + SUM(i.undone) AS monetary,
           COUNT(DISTINCT CASE WHEN i.kept THEN i.invoice_no END) AS frequency
    FROM invoice_months i WHERE i.customer_key > 0 GROUP BY i.customer_key""",
    "last_buys": """
    SELECT customer_key, customer_id, MAX(invoice_ts::DATE) AS last_buy
    FROM sales WHERE customer_key > 0 AND is_cancellation = 0 GROUP BY ALL""",
    "buyers": """
    SELECT customer_key, customer_id,
           (SELECT MAX(invoice_ts::DATE) FROM lines) - last_buy AS recency_days, frequency, monetary
    FROM last_buys JOIN buyer_totals USING (customer_key)""",
    # fifths by counting: the first n % 5 of them have one customer more than the others
    "places": """
    SELECT *, COUNT(*) OVER () // 5 AS fifth, COUNT(*) OVER () % 5 AS longer,
           RANK() OVER (ORDER BY recency_days, customer_key) - 1 AS r_place,
           RANK() OVER (ORDER BY frequency, customer_key) - 1 AS f_place,
           RANK() OVER (ORDER BY monetary, customer_key) - 1 AS m_place
    FROM buyers""",
    "scored": f"""
    SELECT customer_key, customer_id, recency_days, frequency, monetary,
           5 - ({_fifth("r_place")}) AS r_score, 1 + ({_fifth("f_place")}) AS f_score,
           1 + ({_fifth("m_place")}) AS m_score
    FROM places""",
    "rfm": """
    SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR)
               AS rfm_cell,
           CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions'
                WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
                WHEN r_score >= 3 THEN 'Potential Loyalist'
                WHEN f_score >= 4 AND m_score >= 4 THEN 'Cannot Lose Them'
                WHEN f_score >= 3 THEN 'At Risk'
                WHEN r_score = 2 THEN 'Hibernating'
                ELSE 'Lost' END AS segment
    FROM scored""",
    # months by number; a customer's age is counted from the first month with a purchase
    "ages": f"""
    SELECT DISTINCT customer_key, {MONTHS.format("year_month")} AS month_no,
           MIN({MONTHS.format("year_month")}) OVER (PARTITION BY customer_key) AS born
    FROM invoice_months WHERE kept AND customer_key > 0""",
    "month_names": f"""
    SELECT DISTINCT year_month, {MONTHS.format("year_month")} AS month_no FROM d_date""",
    "cohorts": f"""
    SELECT birth.year_month AS cohort_month, later.month_no - birth.month_no AS month_offset,
           COUNT(*) FILTER (a.month_no = a.born) AS cohort_size,
           COUNT(*) FILTER (a.month_no = later.month_no) AS active_customers,
           {_round(_pct("COUNT(*) FILTER (a.month_no = later.month_no)", "COUNT(*) FILTER (a.month_no = a.born)"), 4)}
               AS retention_pct
    FROM ages a
    JOIN month_names birth ON birth.month_no = a.born
    JOIN month_names later ON later.month_no >= a.born
    GROUP BY ALL""",
    "per_product": """
    SELECT product_key, SUM(line_revenue) AS net_revenue,
           CAST(SUM(quantity) AS BIGINT) AS units,
           COUNT(DISTINCT invoice_no) FILTER (is_cancellation = 0) AS orders
    FROM sales WHERE line_type = 'product' GROUP BY 1""",
    "revenue_places": """
    SELECT *, COUNT(*) OVER (ORDER BY net_revenue DESC, product_key ROWS UNBOUNDED PRECEDING)
               AS revenue_rank,
           SUM(net_revenue) OVER (ORDER BY net_revenue DESC, product_key ROWS UNBOUNDED PRECEDING)
               AS so_far
    FROM per_product""",
    "shares": f"""
    SELECT p.*, {_pct("p.net_revenue", "whole.net")} AS revenue_share_pct,
           {_pct("p.so_far", "whole.net")} AS cumulative_share_pct
    FROM revenue_places p, (SELECT SUM(net_revenue) AS net FROM per_product) whole""",
    "pareto": """
    SELECT product_key, stock_code, description, net_revenue, units, orders, revenue_rank,
           revenue_share_pct, cumulative_share_pct,
           COALESCE((cumulative_share_pct - revenue_share_pct < 80.0::DOUBLE)::INTEGER, 0)
               AS in_top_80_band
    FROM shares JOIN d_product USING (product_key)""",
    # every line three times, under its month, its market and its code
    "grained": """
    SELECT g.grain, g.grain_value, line_revenue, is_cancellation
    FROM sales, LATERAL (VALUES ('month', year_month), ('country', country), ('product', stock_code))
        AS g(grain, grain_value)""",
    "stacked": f"""
    SELECT grain, grain_value, {GROSS} AS gross_revenue, {RETURNS} AS returns,
           CAST(SUM(is_cancellation) AS BIGINT) AS return_lines
    FROM grained GROUP BY grain, grain_value""",
    "leakage": f"""
    SELECT grain, grain_value, gross_revenue, returns, gross_revenue + returns AS net_revenue,
           {RATE} AS return_rate_pct, return_lines
    FROM stacked""",
    "per_country": f"""
    SELECT country, region, {GROSS} AS gross_revenue, {RETURNS} AS returns,
           SUM(line_revenue) AS net_revenue,
           COUNT(DISTINCT invoice_no) FILTER (is_cancellation = 0) AS orders,
           COUNT(DISTINCT customer_key) FILTER (customer_key <> -1) AS customers
    FROM sales GROUP BY country, region""",
    "markets": f"""
    SELECT *, {_ratio("gross_revenue", "orders")} AS aov, {RATE} AS return_rate_pct,
           RANK() OVER (ORDER BY gross_revenue DESC) AS revenue_rank
    FROM per_country""",
    "segments": f"""
    SELECT segment, COUNT(*) AS customers, SUM(monetary) AS net,
           {_ratio("SUM(recency_days)", "COUNT(*)")} AS mean_recency,
           {_ratio("SUM(frequency)", "COUNT(*)")} AS mean_orders,
           {_ratio("SUM(monetary)", "COUNT(*)")} AS mean_net
    FROM rfm GROUP BY segment""",
    # lines of one customer, code and day meet under the quantity that was sold
    "meetings": """
    SELECT customer_key, product_key, invoice_ts::DATE AS day,
           CASE is_cancellation WHEN 1 THEN -quantity ELSE quantity END AS sold,
           bool_or(is_cancellation = 0) AS kept, SUM(is_cancellation) AS lines,
           SUM(line_revenue * is_cancellation) AS value
    FROM sales GROUP BY ALL""",
    "undone": """
    SELECT COALESCE(SUM(lines), 0)::BIGINT AS lines, SUM(value) AS value
    FROM meetings WHERE kept AND lines > 0""",
    "drivers": """
    SELECT * FROM leakage WHERE grain = 'product' AND returns < 0
    QUALIFY ROW_NUMBER() OVER (ORDER BY returns, grain_value) <= 12""",
    "leaders": f"""
    SELECT revenue_rank, stock_code, description, {_round("net_revenue")} AS net_revenue, units,
           orders
    FROM pareto WHERE revenue_rank <= 20""",
}

MONEY = ("gross_revenue", "returns", "net_revenue")


def _doubles(table: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in columns)}) FROM {table}"


def _profile(column: str, data_type: str, numeric: bool) -> str:
    quoted = f'"{column}"'
    spread = (
        f"MIN({quoted})::DOUBLE, MAX({quoted})::DOUBLE, "
        + _ratio(f"SUM({quoted})", f"COUNT({quoted})")
        if numeric
        else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
    )
    return (
        f"SELECT '{column}', '{data_type}', COUNT({quoted}), COUNT(*) - COUNT({quoted}), "
        f"{_ratio(f'COUNT(*) - COUNT({quoted})', 'COUNT(*)')}, COUNT(DISTINCT {quoted}), {spread} "
        "FROM audit"
    )


PROFILED = (
    ("Invoice", "string", False),
    ("StockCode", "string", False),
    ("Description", "string", False),
    ("Quantity", "bigint", True),
    ("InvoiceDate", "timestamp_ntz", False),
    ("Price", "decimal(18,4)", True),
    ("Customer ID", "bigint", True),
    ("Country", "string", False),
    ("source_part", "string", False),
)
FLAGS = {
    "null_customer": 'COUNT(*) FILTER ("Customer ID" IS NULL)',
    "null_description": 'COUNT(*) FILTER ("Description" IS NULL)',
    "cancellation_lines": "COUNT(*) FILTER (starts_with(upper(\"Invoice\"), 'C'))",
    "exact_duplicates": (
        'COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT "Invoice", "StockCode", "Quantity", '
        '"InvoiceDate", "Price" FROM audit))'
    ),
    "price_not_positive": 'COUNT(*) FILTER ("Price" <= 0)',
    "quantity_zero": 'COUNT(*) FILTER ("Quantity" = 0)',
    "negative_quantity_not_cancelled": (
        "COUNT(*) FILTER (\"Quantity\" < 0 AND NOT starts_with(upper(\"Invoice\"), 'C'))"
    ),
    "non_product_code": f"COUNT(*) FILTER (code IN ({LISTED_CODES}))",
    "code_not_normalised": 'COUNT(*) FILTER ("StockCode" <> code)',
}
NULLABLE = (
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "unit_price",
    "line_revenue",
    "invoice_ts",
    "customer_id",
    "country",
    "is_cancellation",
    "line_type",
)


def _union(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


def _orphans(key: str, dim: str) -> str:
    return (
        f"SELECT 'orphan_{key}' AS gate, COUNT(*) AS violations FROM lines l "
        f"WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{key} = l.{key})"
    )


def _fails(gate: str, condition: str, tail: str = "") -> str:
    return f"SELECT '{gate}' AS gate, CASE WHEN {condition} THEN 0 ELSE 1 END AS violations {tail}"


def _counts(gate: str, number: str) -> str:
    return f"SELECT '{gate}' AS gate, CAST({number} AS BIGINT) AS violations"


GATES = _union(
    [
        _counts(
            "rows_unaccounted",
            "abs((SELECT COUNT(*) FROM raw) - (SELECT SUM(copies) FROM cleaned))",
        ),
        _counts(
            "codes_with_two_line_types",
            "(SELECT COUNT(*) FROM (SELECT stock_code FROM kept GROUP BY 1 "
            "HAVING COUNT(DISTINCT line_type) > 1))",
        ),
        _counts("markets_without_region", "(SELECT COUNT(*) FROM d_country WHERE region IS NULL)"),
        _counts(
            "null_keys",
            "(SELECT COUNT(*) FROM lines WHERE date_key IS NULL OR customer_key IS NULL "
            "OR product_key IS NULL OR country_key IS NULL)",
        ),
        _counts(
            "fact_rows_differ", "abs((SELECT COUNT(*) FROM lines) - (SELECT COUNT(*) FROM kept))"
        ),
        _fails(
            "fact_revenue_differs",
            "abs((SELECT SUM(line_revenue) FROM lines) - (SELECT SUM(line_revenue) FROM kept)) "
            "<= 0.01",
        ),
        _orphans("date_key", "d_date"),
        _orphans("customer_key", "d_customer"),
        _orphans("product_key", "d_product"),
        _orphans("country_key", "d_country"),
        _counts(
            "scores_out_of_range",
            "(SELECT COUNT(*) FROM rfm WHERE NOT regexp_full_match(rfm_cell, '[1-5]{3}'))",
        ),
        _counts("customers_without_segment", "(SELECT COUNT(*) FROM rfm WHERE segment IS NULL)"),
        _counts(
            "scored_customers_differ",
            "abs((SELECT COUNT(*) FROM rfm) - (SELECT COUNT(DISTINCT customer_key) FROM sales "
            "WHERE customer_key <> -1 AND is_cancellation = 0))",
        ),
        _counts(
            "segments_unexpected",
            f"(SELECT COUNT(*) FROM rfm WHERE segment NOT IN ({_listed(SEGMENTS)}))",
        ),
        _counts(
            "segments_missing",
            f"{len(SEGMENTS)} - (SELECT COUNT(DISTINCT segment) FROM rfm "
            f"WHERE segment IN ({_listed(SEGMENTS)}))",
        ),
        _counts(
            "customers_scored_twice",
            "(SELECT COUNT(*) - COUNT(DISTINCT customer_key) FROM rfm)",
        ),
        _counts(
            "cohorts_not_starting_at_100",
            "(SELECT COUNT(*) FROM cohorts WHERE month_offset = 0 AND retention_pct <> 100)",
        ),
        _counts(
            "cells_above_cohort_size",
            "(SELECT COUNT(*) FROM cohorts WHERE active_customers > cohort_size)",
        ),
        _fails(
            "curve_not_ending_at_100",
            "abs((SELECT arg_max(cumulative_share_pct, revenue_rank) FROM pareto) - 100) <= 0.01",
        ),
        _counts(
            "curve_falls_at_profit",
            "(SELECT COUNT(*) FROM pareto a JOIN pareto b ON b.revenue_rank = a.revenue_rank + 1 "
            "WHERE b.net_revenue >= 0 AND b.cumulative_share_pct + 1e-9 < a.cumulative_share_pct)",
        ),
        *[
            _fails(
                f"trend_{name}_differs",
                f"abs((SELECT SUM({name}) FROM trend) - (SELECT {expression} FROM sales)) <= 0.01",
            )
            for name, expression in zip(MONEY, (GROSS, RETURNS, "SUM(line_revenue)"), strict=True)
        ],
        _fails(
            "country_gross_differs",
            f"abs((SELECT SUM(gross_revenue) FROM markets) - (SELECT {GROSS} FROM sales)) <= 0.01",
        ),
    ]
)

SELECTS = {
    "src_raw_union": 'SELECT * EXCLUDE (source_ordinal) REPLACE ("Price"::DOUBLE AS "Price") FROM raw',
    "clean_normalise": "SELECT * EXCLUDE (source_ordinal) REPLACE "
    "(unit_price::DOUBLE AS unit_price, line_revenue::DOUBLE AS line_revenue) FROM normalised",
    "clean_backfill": "SELECT invoice_no, stock_code, COALESCE(description, modal_description) AS "
    "description, quantity, invoice_ts, unit_price::DOUBLE AS unit_price, customer_id, country, "
    "line_revenue::DOUBLE AS line_revenue FROM normalised LEFT JOIN modal USING (stock_code)",
    "clean_dedup": "SELECT * EXCLUDE (source_ordinal) REPLACE "
    "(unit_price::DOUBLE AS unit_price, line_revenue::DOUBLE AS line_revenue) FROM deduped",
    "clean_cancellations": "SELECT starts_with(upper(invoice_no), 'C') AS is_cancellation, "
    "COUNT(*) AS lines, SUM(line_revenue)::DOUBLE AS revenue FROM normalised GROUP BY 1",
    "clean_line_type": f"SELECT {CLASS} AS line_type, stock_code, COUNT(*) AS lines "
    "FROM normalised GROUP BY ALL",
    "clean_quarantine": "SELECT * EXCLUDE (copies) REPLACE (unit_price::DOUBLE AS unit_price, "
    "line_revenue::DOUBLE AS line_revenue) FROM cleaned WHERE quarantine_reason IS NOT NULL",
    "clean_kept": "SELECT line_type, is_cancellation, COUNT(*) AS lines, "
    "CAST(SUM(quantity) AS BIGINT) AS units, SUM(line_revenue)::DOUBLE AS revenue "
    "FROM kept GROUP BY 1, 2",
    "clean_transactions": _doubles("kept", "unit_price", "line_revenue"),
    "dq_reconciliation": """SELECT raw_rows, kept_rows, deduped_rows, quarantined_rows,
    kept_rows + deduped_rows + quarantined_rows AS accounted_rows,
    CAST(kept_rows + deduped_rows + quarantined_rows = raw_rows AS INTEGER) AS balances
FROM (SELECT (SELECT COUNT(*) FROM raw) AS raw_rows,
             COUNT(*) FILTER (quarantine_reason IS NULL) AS kept_rows,
             (SELECT COUNT(*) FROM raw) - COUNT(*) AS deduped_rows,
             COUNT(*) FILTER (quarantine_reason IS NOT NULL) AS quarantined_rows FROM cleaned)""",
    "dq_rule_counts": """SELECT 'descriptions_backfilled' AS rule, COUNT(*) AS lines
FROM normalised JOIN modal USING (stock_code) WHERE description IS NULL
UNION ALL SELECT 'cancellations_flagged', COUNT(*) FROM cleaned WHERE is_cancellation
UNION ALL SELECT 'non_product_lines', COUNT(*) FROM cleaned WHERE line_type <> 'product'
UNION ALL SELECT 'guest_lines', COUNT(*) FROM cleaned WHERE customer_id IS NULL""",
    "dq_revenue": f"""SELECT {_round("raw_gross")} AS raw_gross,
    {_round("all_line_types")} AS all_line_types, {_round("gross")} AS gross,
    {_round("returns")} AS returns, {_round("gross + returns")} AS net,
    {_round(_ratio("-returns", "gross"), 6)} AS return_rate
FROM (SELECT (SELECT SUM(line_revenue) FROM normalised) AS raw_gross,
             SUM(line_revenue) AS all_line_types,
             SUM(line_revenue) FILTER ({SALES} AND NOT is_cancellation) AS gross,
             SUM(line_revenue) FILTER ({SALES} AND is_cancellation) AS returns FROM kept)""",
    "dq_line_types": f"""SELECT line_type, COUNT(k.revenue) AS rows,
    {_round("COALESCE(SUM(k.revenue), 0)")} AS revenue
FROM (VALUES ('product'), ('shipping'), ('adjustment'), ('test')) AS t(line_type)
LEFT JOIN (SELECT line_type, line_revenue AS revenue FROM kept) k USING (line_type) GROUP BY 1""",
    "dq_guests": f"""SELECT rows, {_round(_ratio("rows", "all_rows"), 6)} AS row_share,
    {_round("guest_revenue")} AS revenue,
    {_round(_ratio("guest_revenue", "all_revenue"), 6)} AS revenue_share
FROM (SELECT COUNT(*) FILTER (customer_id IS NULL) AS rows, COUNT(*) AS all_rows,
             SUM(line_revenue) FILTER (customer_id IS NULL) AS guest_revenue,
             SUM(line_revenue) AS all_revenue FROM kept)""",
    "dq_nulls": _union(
        [
            f"SELECT '{name}' AS column_name, COUNT(*) - COUNT({name}) AS nulls FROM kept"
            for name in NULLABLE
        ]
    ),
    "dq_date_range": "SELECT MIN(invoice_ts) AS start_ts, MAX(invoice_ts) AS end_ts FROM kept",
    "dq_quarantine_reasons": "SELECT quarantine_reason, COUNT(*) AS rows FROM cleaned "
    "WHERE quarantine_reason IS NOT NULL GROUP BY 1",
    "audit_readiness": f"""SELECT 'raw_rows' AS figure, COUNT(*)::DOUBLE AS value FROM audit
UNION ALL SELECT 'raw_gross_revenue', {_round("SUM(value)")} FROM audit
UNION ALL SELECT 'rows_in_' || source_part, COUNT(*)::DOUBLE FROM audit GROUP BY source_part""",
    "audit_column_profile": "SELECT * FROM ("
    + _union([_profile(*column) for column in PROFILED])
    + ") AS t(column_name, data_type, non_null, nulls, null_share, distinct_values, min_value, "
    "max_value, mean_value)",
    "audit_quality_flags": _union(
        [
            f"SELECT '{name}' AS issue, {count} AS rows, {_ratio(count, 'COUNT(*)')} "
            "AS share_of_rows FROM audit"
            for name, count in FLAGS.items()
        ]
    ),
    "audit_revenue_month": "SELECT strftime(\"InvoiceDate\", '%Y-%m') AS month, COUNT(*) AS rows, "
    "SUM(value)::DOUBLE AS gross_revenue FROM audit GROUP BY 1",
    "audit_revenue_country": 'SELECT "Country" AS country, COUNT(*) AS rows, '
    'COUNT(DISTINCT "Customer ID") AS customers, SUM(value)::DOUBLE AS gross_revenue '
    "FROM audit GROUP BY 1",
    "audit_stock_codes": f"""SELECT t.stock_code, {CLASS.replace("stock_code", "t.stock_code")} AS class,
    rows, total_revenue, COALESCE(modal, '') AS modal_description
FROM (SELECT code AS stock_code, COUNT(*) AS rows, SUM(value)::DOUBLE AS total_revenue
      FROM audit WHERE NOT regexp_matches(code, '^[0-9]') GROUP BY 1) t
LEFT JOIN (SELECT code AS stock_code, "Description" AS modal
           FROM (SELECT code, "Description", COUNT(*) AS n FROM audit
                 WHERE "Description" IS NOT NULL GROUP BY 1, 2)
           QUALIFY ROW_NUMBER() OVER (PARTITION BY code ORDER BY n DESC, "Description") = 1) m
    ON m.stock_code = t.stock_code""",
    "dim_date": "SELECT * FROM d_date",
    "dim_customer": "SELECT * FROM d_customer",
    "dim_product": "SELECT * FROM d_product",
    "dim_country": "SELECT * FROM d_country",
    "fact_sales": "SELECT sale_key, invoice_no, date_key, customer_key, product_key, country_key, "
    "invoice_ts, quantity, unit_price::DOUBLE AS unit_price, line_revenue::DOUBLE AS line_revenue, "
    "is_cancellation FROM lines",
    "star_counts": _union(
        [
            f"SELECT '{name}' AS table_name, COUNT(*) AS rows FROM {step}"
            for name, step in (
                ("dim_date", "d_date"),
                ("dim_customer", "d_customer"),
                ("dim_product", "d_product"),
                ("dim_country", "d_country"),
                ("fact_sales", "lines"),
            )
        ]
    ),
    "published_star": "SELECT year_month, region, line_type, COUNT(*) AS lines, SUM(quantity)::BIGINT AS units, "
    "SUM(line_revenue)::DOUBLE AS revenue FROM lines GROUP BY 1, 2, 3",
    "published_marts": _union(
        [
            f"SELECT '{mart}' AS mart, COUNT(*) AS rows, SUM({total})::DOUBLE AS total FROM {step}"
            for mart, step, total in (
                ("mart_revenue_trend", "trend", "net_revenue"),
                ("mart_rfm", "rfm", "monetary"),
                ("mart_cohort_retention", "cohorts", "active_customers"),
                ("mart_product_pareto", "pareto", "net_revenue"),
                ("mart_return_leakage", "leakage", "net_revenue"),
                ("mart_country_performance", "markets", "net_revenue"),
            )
        ]
    ),
    "mart_revenue_trend": _doubles("trend", *MONEY, "net_revenue_mom_delta"),
    "mart_rfm": _doubles("rfm", "monetary"),
    "mart_cohort_retention": "SELECT * FROM cohorts",
    "mart_product_pareto": _doubles("pareto", "net_revenue"),
    "mart_return_leakage": _doubles("leakage", *MONEY),
    "mart_country_performance": _doubles("markets", *MONEY),
    "gate_report": GATES,
    "q_top_markets": f"""SELECT revenue_rank, country, region, {_round("gross_revenue")} AS gross_revenue,
    {_round("returns")} AS returns, {_round("net_revenue")} AS net_revenue,
    {_round(_pct("net_revenue", "SUM(net_revenue) OVER ()"))} AS pct_of_net_revenue,
    orders, customers, {_round("aov")} AS aov, {_round("return_rate_pct")} AS return_rate_pct
FROM markets ORDER BY revenue_rank, country LIMIT 10""",
    "q_segments": f"""SELECT segment, customers,
    {_round(_pct("customers", "SUM(customers) OVER ()"))} AS pct_of_customers,
    {_round("net")} AS net_revenue, {_round(_pct("net", "SUM(net) OVER ()"))} AS pct_of_net_revenue,
    {_round("mean_recency", 1)} AS avg_days_since_order, {_round("mean_orders", 1)} AS avg_orders,
    {_round("mean_net")} AS avg_net_revenue
FROM segments""",
    "q_bands": f"""SELECT CASE WHEN in_top_80_band = 1 THEN 'first 80% of revenue'
         ELSE 'the long tail' END AS band, skus,
    {_round(_pct("skus", "SUM(skus) OVER ()"))} AS pct_of_skus, units, {_round("net")} AS net_revenue,
    {_round(_pct("net", "SUM(net) OVER ()"))} AS pct_of_net_revenue,
    {_round(_ratio("net", "skus"))} AS avg_net_revenue_per_sku
FROM (SELECT in_top_80_band, COUNT(*) AS skus, CAST(SUM(units) AS BIGINT) AS units,
             SUM(net_revenue) AS net FROM pareto GROUP BY 1)""",
    "q_worst_leaks": f"""SELECT grain, leak_rank, grain_value, {_round("gross_revenue")} AS gross_revenue,
    {_round("returns")} AS returns, {_round("return_rate_pct")} AS return_rate_pct, return_lines
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grain ORDER BY returns, grain_value) AS leak_rank
      FROM leakage WHERE gross_revenue > 0)
WHERE leak_rank <= 5""",
    "kpi_totals": f"""SELECT {_round("gross")} AS gross_revenue, {_round("back")} AS returns,
    {_round("net")} AS net_revenue, orders, {_round(_pct("-back", "gross"), 4)} AS return_rate_pct,
    {_round(_ratio("gross", "orders"))} AS aov
FROM (SELECT SUM(gross_revenue) AS gross, SUM(returns) AS back, SUM(net_revenue) AS net,
             CAST(SUM(orders) AS BIGINT) AS orders FROM trend)""",
    "kpi_customers": f"""SELECT COUNT(*) AS active_customers,
    {_round(_ratio("SUM(monetary)", "COUNT(*)"))} AS average_clv,
    {_round(_pct("COUNT(*) FILTER (frequency > 1)", "COUNT(*)"))} AS repeat_purchase_rate_pct
FROM rfm""",
    "kpi_yoy": f"""SELECT {_round("recent")} AS recent_year_net, {_round("prior")} AS prior_year_net,
    {_round(_pct("recent - prior", "prior"))} AS revenue_yoy_pct
FROM (SELECT SUM(net_revenue) FILTER (year_month BETWEEN '{RECENT[0]}' AND '{RECENT[1]}') AS recent,
             SUM(net_revenue) FILTER (year_month BETWEEN '{PRIOR[0]}' AND '{PRIOR[1]}') AS prior
      FROM trend)""",
    "kpi_latest": f"""SELECT year_month, {_round("net_revenue_mom_pct")} AS revenue_mom_pct
FROM trend ORDER BY year_month DESC LIMIT 1""",
    "period": "SELECT MIN(year_month) AS start_month, MAX(year_month) AS end_month FROM trend",
    "panel_trend": f"""SELECT year_month, {", ".join(f"{_round(c)} AS {c}" for c in MONEY)}, orders,
    active_customers, {_round("aov")} AS aov, {_round("return_rate_pct")} AS return_rate_pct,
    {_round("net_revenue_mom_pct")} AS net_revenue_mom_pct
FROM trend""",
    "panel_countries": f"""SELECT country, region, {_round("gross_revenue")} AS gross_revenue,
    {_round("net_revenue")} AS net_revenue, orders, customers, {_round("aov")} AS aov,
    {_round("return_rate_pct")} AS return_rate_pct, revenue_rank
FROM markets""",
    "panel_regions": f"""SELECT region, {_round("SUM(net_revenue)")} AS net_revenue,
    CAST(SUM(customers) AS BIGINT) AS customers FROM markets GROUP BY 1""",
    "panel_cohort": f"""SELECT cohort_month, month_offset, cohort_size, active_customers,
    {_round("retention_pct")} AS retention_pct FROM cohorts""",
    "rfm_matrix": f"""SELECT r_score, f_score, COUNT(*) AS customers,
    {_round("SUM(monetary)")} AS net_revenue FROM rfm GROUP BY 1, 2""",
    "rfm_segments": f"""SELECT segment, customers, {_round("net")} AS net_revenue,
    {_round("mean_net")} AS average_value, {_round("mean_recency", 1)} AS average_recency_days,
    {_round("mean_orders", 1)} AS average_orders,
    {_round(_pct("net", "(SELECT SUM(monetary) FROM rfm)"))} AS revenue_share_pct,
    {_round(_pct("customers", "(SELECT COUNT(*) FROM rfm)"))} AS customer_share_pct
FROM segments""",
    "segment_rollup": f"""SELECT {_round("SUM(monetary)")} AS attributable_revenue,
    COUNT(*) FILTER (segment IN ('At Risk', 'Cannot Lose Them')) AS slipping_customers,
    {_round("COALESCE(SUM(monetary) FILTER (segment IN ('At Risk', 'Cannot Lose Them')), 0)")}
        AS slipping_revenue
FROM rfm""",
    "pareto_curve": f"""SELECT revenue_rank, {_round("cumulative_share_pct", 3)} AS cumulative_share_pct
FROM (SELECT *, COUNT(*) OVER () AS total FROM pareto)
WHERE revenue_rank % greatest(1, total // 240) = 0 OR revenue_rank IN (1, total)""",
    "pareto_band": f"""SELECT total_skus, rank_at_80, band_skus, {_round("net")} AS band_net_revenue,
    {_round(_pct("band_skus", "total_skus"))} AS band_share_pct, total_skus - band_skus AS tail_skus
FROM (SELECT COUNT(*) AS total_skus,
             MIN(revenue_rank) FILTER (cumulative_share_pct >= 80) AS rank_at_80,
             COUNT(*) FILTER (in_top_80_band = 1) AS band_skus,
             SUM(net_revenue) FILTER (in_top_80_band = 1) AS net FROM pareto)""",
    "same_day_reversals": f"""SELECT lines, {_round("value")} AS value,
    {_round(_pct("value", "(SELECT SUM(line_revenue) FROM sales WHERE is_cancellation = 1)"))}
        AS share_of_returns_pct
FROM undone""",
    "return_driver_rollup": f"""SELECT {_round("SUM(returns)")} AS returns,
    {_round(_pct("SUM(returns)", "(SELECT SUM(returns) FROM leakage WHERE grain = 'product')"))}
        AS share_of_returns_pct
FROM drivers""",
    "return_drivers": f"""SELECT grain_value AS stock_code, {_round("returns")} AS returns,
    {_round("return_rate_pct")} AS return_rate_pct, return_lines FROM drivers""",
    "top_products": "SELECT * FROM leaders",
    "top_products_by_units": "SELECT *, ROW_NUMBER() OVER (ORDER BY units DESC, revenue_rank) "
    "AS place FROM leaders",
    "mom_series": f"""SELECT year_month, {_round("net_revenue_mom_pct")} AS net_revenue_mom_pct,
    CAST(year_month = (SELECT MAX(year_month) FROM trend) AS INTEGER) AS is_partial
FROM trend WHERE net_revenue_mom_pct IS NOT NULL""",
    "market_filter": f"""SELECT country, region, {_round("gross_revenue")} AS gross_revenue,
    {_round("net_revenue")} AS net_revenue, orders, customers, {_round("aov")} AS aov,
    {_round("return_rate_pct")} AS return_rate_pct, revenue_rank
FROM markets WHERE region = '{REGION}' ORDER BY revenue_rank, country LIMIT {TOP_MARKETS}""",
    "cohort_depth": f"""SELECT cohort_month, month_offset, cohort_size, active_customers,
    {_round("retention_pct")} AS retention_pct FROM cohorts WHERE month_offset <= {COHORT_DEPTH}""",
    "adjusted_return_rate": f"""SELECT {_round("gross")} AS gross_revenue, {_round("back")} AS returns,
    {_round("gone")} AS reversals, {_round("back - gone")} AS genuine_returns,
    {_round(_pct("-back", "gross"), 4)} AS return_rate_pct,
    {_round(_pct("-(back - gone)", "gross"), 4)} AS genuine_return_rate_pct
FROM (SELECT SUM(gross_revenue) AS gross, SUM(returns) AS back,
             (SELECT COALESCE(value, 0) FROM undone) AS gone FROM trend)""",
    "retention_curve": f"""SELECT month_offset, COUNT(*) AS cohorts,
    {_round(_ratio("SUM(CAST(retention_pct AS DECIMAL(18,4)))", "COUNT(*)"), 4)} AS avg_retention_pct
FROM cohorts GROUP BY 1""",
    "negative_skus": f"""SELECT COUNT(*) AS skus, {_round("SUM(net_revenue)")} AS net_revenue
FROM pareto WHERE net_revenue < 0""",
    "return_rate_outliers": f"""SELECT country, orders, {_round("return_rate_pct")} AS return_rate_pct
FROM markets WHERE orders >= 100""",
    "season_share": f"""SELECT {_round("season")} AS season_net_revenue,
    {_round(_pct("season", "whole"))} AS season_share_pct
FROM (SELECT SUM(net_revenue) FILTER (CAST(substr(year_month, 6, 2) AS INTEGER)
                                      BETWEEN {SEASON[0]} AND {SEASON[1]}) AS season,
             SUM(net_revenue) AS whole FROM trend)""",
}


# reports that are also table functions say the same in SQL
SELECTS["segments_by_customers"] = (
    f"SELECT *, ROW_NUMBER() OVER (ORDER BY customers DESC, segment) AS place FROM ({SELECTS['rfm_segments']})"
)
SELECTS["sql_market_filter"] = SELECTS["market_filter"]
SELECTS["sql_cohort_depth"] = SELECTS["cohort_depth"]
SELECTS["sql_products_by_units"] = SELECTS["top_products_by_units"]


def _needed(sql: str) -> set[str]:
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'|\"[^\"]*\"", "", sql)))
    found: set[str] = set()
    for name in words & set(STEPS):
        if re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
            found |= {name} | _needed(STEPS[name])
    return found


def oracle_sql() -> dict[str, str]:
    result = {}
    for name, select in SELECTS.items():
        needed = _needed(select)
        steps = [f"{step} AS MATERIALIZED ({sql}\n)" for step, sql in STEPS.items() if step in needed]
        result[name] = ("WITH " + ",\n".join(steps) + "\n" if steps else "") + select
    return result
