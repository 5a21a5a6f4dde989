"""Table contracts."""

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)

RAW = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", PRICE),
        T.StructField("Customer ID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)
TRANSACTIONS = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("unit_price", PRICE),
        T.StructField("line_revenue", PRICE),
        T.StructField("invoice_ts", T.TimestampNTZType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("is_cancellation", T.BooleanType()),
        T.StructField("line_type", T.StringType()),
    ]
)
DIM_DATE = T.StructType(
    [
        T.StructField("date_key", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("quarter", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("month_name", T.StringType()),
        T.StructField("year_month", T.StringType()),
        T.StructField("iso_week", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("day_name", T.StringType()),
        T.StructField("is_weekend", T.IntegerType()),
    ]
)
DIM_CUSTOMER = T.StructType(
    [
        T.StructField("customer_key", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("first_purchase_ts", T.TimestampNTZType()),
        T.StructField("last_purchase_ts", T.TimestampNTZType()),
        T.StructField("tenure_days", T.IntegerType()),
        T.StructField("home_country", T.StringType()),
        T.StructField("is_guest", T.IntegerType()),
    ]
)
DIM_PRODUCT = T.StructType(
    [
        T.StructField("product_key", T.LongType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("line_type", T.StringType()),
    ]
)
DIM_COUNTRY = T.StructType(
    [
        T.StructField("country_key", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)
FACT_SALES = T.StructType(
    [
        T.StructField("sale_key", T.LongType()),
        T.StructField("invoice_no", T.StringType()),
        T.StructField("date_key", T.IntegerType()),
        T.StructField("customer_key", T.LongType()),
        T.StructField("product_key", T.LongType()),
        T.StructField("country_key", T.LongType()),
        T.StructField("invoice_ts", T.TimestampNTZType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("unit_price", PRICE),
        T.StructField("line_revenue", PRICE),
        T.StructField("is_cancellation", T.IntegerType()),
    ]
)

MONEY = T.DecimalType(38, 4)
_KINDS = {
    "text": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "money": MONEY,
}


def _contract(columns: str) -> T.StructType:
    """A contract from "name kind, name kind"."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


# what a mart holds while its money is exact; exports for readers turn money into doubles
MARTS = {
    "mart_revenue_trend": _contract(
        "year_month text, gross_revenue money, returns money, net_revenue money, orders long, active_customers long, "
        "aov double, return_rate_pct double, net_revenue_mom_delta money, net_revenue_mom_pct double"
    ),
    "mart_rfm": _contract(
        "customer_key long, customer_id long, recency_days long, frequency long, monetary money, r_score long, "
        "f_score long, m_score long, rfm_cell text, segment text"
    ),
    "mart_cohort_retention": _contract(
        "cohort_month text, month_offset long, cohort_size long, active_customers long, retention_pct double"
    ),
    "mart_product_pareto": _contract(
        "product_key long, stock_code text, description text, net_revenue money, units long, orders long, "
        "revenue_rank long, revenue_share_pct double, cumulative_share_pct double, in_top_80_band int"
    ),
    "mart_return_leakage": _contract(
        "grain text, grain_value text, gross_revenue money, returns money, net_revenue money, return_rate_pct double, "
        "return_lines long"
    ),
    "mart_country_performance": _contract(
        "country text, region text, gross_revenue money, returns money, net_revenue money, orders long, "
        "customers long, aov double, return_rate_pct double, revenue_rank long"
    ),
}
STAR = {
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_product": DIM_PRODUCT,
    "dim_country": DIM_COUNTRY,
    "fact_sales": FACT_SALES,
}
