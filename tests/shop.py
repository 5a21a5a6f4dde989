"""Rows and small tables that several test modules share."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from revlens import schemas

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def stamp(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


RAW_DEFAULT: dict[str, Any] = {
    "Invoice": "70412",
    "StockCode": "kb77x",
    "Description": "  copper kettle ",
    "Quantity": 4,
    "InvoiceDate": "2012-05-17 14:09:48",
    "Price": "3.75",
    "Customer ID": 931,
    "Country": "EIRE",
}


def raw_frame(spark: SparkSession, *rows: dict[str, Any]) -> DataFrame:
    """Raw lines in the given order; each row overrides parts of the default line."""
    schema = T.StructType([*schemas.RAW.fields, T.StructField("source_ordinal", T.LongType())])
    values = []
    for ordinal, row in enumerate(rows):
        line = {**RAW_DEFAULT, **row}
        values.append(
            (
                line["Invoice"],
                line["StockCode"],
                line["Description"],
                line["Quantity"],
                stamp(line["InvoiceDate"]),
                None if line["Price"] is None else Decimal(line["Price"]),
                line["Customer ID"],
                line["Country"],
                ordinal,
            )
        )
    return spark.createDataFrame(values, schema)


TRANSACTION_DEFAULT: dict[str, Any] = {
    "invoice_no": "A1",
    "stock_code": "SKU1",
    "description": "BOWL",
    "quantity": 1,
    "unit_price": "10",
    "invoice_ts": "2010-12-01 09:00",
    "customer_id": 100,
    "country": "United Kingdom",
    "is_cancellation": False,
    "line_type": "product",
}


def transactions_frame(spark: SparkSession, *rows: dict[str, Any]) -> DataFrame:
    values = []
    for row in rows:
        line = {**TRANSACTION_DEFAULT, **row}
        price = Decimal(line["unit_price"])
        values.append(
            (
                line["invoice_no"],
                line["stock_code"],
                line["description"],
                line["quantity"],
                price,
                price * line["quantity"],
                stamp(line["invoice_ts"]),
                line["customer_id"],
                line["country"],
                line["is_cancellation"],
                line["line_type"],
            )
        )
    return spark.createDataFrame(values, schemas.TRANSACTIONS)


# A star small enough to check by hand: six months of a shop with two goods in two markets.
# (customer, market, product, price of each order, order days in 2012)
#
# Goods sold: LAMP 6x75 + 4x65 + 2x30 + 3x35 + 5x140 + 18 = 1593, RUG 2x40 + 2x55 + 20 + 3x45 + 25 + 4x12
# + the guest's 200 = 618; with 22 of freight the gross is 2233. One refund of 60 leaves 2173 net.
# Orders: 6 + 2 + 2 + 4 + 2 + 1 + 3 + 3 + 5 + 1 + 4 + 1 by customers and one by the guest = 35.
HAND_SHOPPERS = [
    (1, 1, 1, 75, ["03-12", "04-09", "05-21", "06-18", "07-16", "08-31"]),
    (2, 2, 2, 40, ["07-05", "08-28"]),
    (3, 1, 2, 55, ["06-11", "08-26"]),
    (4, 1, 1, 65, ["04-16", "05-14", "06-25", "08-20"]),
    (5, 2, 1, 30, ["05-07", "08-15"]),
    (6, 1, 2, 20, ["08-10"]),
    (7, 2, 1, 35, ["03-26", "05-28", "07-30"]),
    (8, 1, 2, 45, ["04-02", "06-04", "07-23"]),
    (9, 1, 1, 140, ["03-05", "03-19", "04-23", "05-08", "06-12"]),
    (10, 2, 2, 25, ["06-06"]),
    (11, 1, 2, 12, ["03-08", "03-22", "04-12", "05-10"]),
    (12, 2, 1, 18, ["03-29"]),
]
HAND_KEYS = {shopper[0] for shopper in HAND_SHOPPERS}


def hand_star_rows() -> dict[str, list[tuple]]:
    def line(invoice, day, customer, product, market, quantity, price, cancelled=0):
        moment = stamp(f"2012-{day} 15:30")
        worth = (Decimal(price), Decimal(price) * quantity)
        keys = (int(moment.strftime("%Y%m%d")), customer, product, market)
        return (invoice, *keys, moment, quantity, *worth, cancelled)

    bought = [
        line(f"S{customer}/{day}", day, customer, product, market, 1, price)
        for customer, market, product, price, days in HAND_SHOPPERS
        for day in days
    ]
    # a guest's order, freight on an order there is, a refund weeks after the sale, a correction
    bought.append(line("G1", "06-20", -1, 2, 2, 1, 200))
    bought.append(line("S1/08-31", "08-31", 1, 3, 1, 1, 22))
    bought.append(line("C4", "07-09", 4, 1, 1, -1, 60, cancelled=1))
    bought.append(line("K1", "08-06", 1, 4, 1, 1, 500))
    shoppers = [
        (key, 400 + key, stamp(f"2012-{days[0]}"), stamp(f"2012-{days[-1]}"), 0, None, 0)
        for key, _, _, _, days in HAND_SHOPPERS
    ]
    return {
        "dim_customer": [(-1, None, None, None, None, None, 1), *shoppers],
        "dim_product": [
            (1, "LAMP", "desk lamp", "product"),
            (2, "RUG", "woven rug", "product"),
            (3, "FRT", "freight", "shipping"),
            (4, "KORR", "correction", "adjustment"),
        ],
        "dim_country": [(1, "Canada", "Americas"), (2, "Japan", "Asia")],
        "fact_sales": [(number, *row) for number, row in enumerate(bought, start=1)],
    }


def hand_tables(spark: SparkSession) -> dict[str, DataFrame]:
    from pyspark.sql import functions as F

    from revlens.operators.star import calendar

    rows = hand_star_rows()
    bounds = spark.range(1).select(
        F.lit("2012-03-01").cast("timestamp_ntz").alias("a"),
        F.lit("2012-08-31").cast("timestamp_ntz").alias("b"),
    )
    return {
        "dim_date": calendar(bounds, "a", "b"),
        "dim_customer": spark.createDataFrame(rows["dim_customer"], schemas.DIM_CUSTOMER),
        "dim_product": spark.createDataFrame(rows["dim_product"], schemas.DIM_PRODUCT),
        "dim_country": spark.createDataFrame(rows["dim_country"], schemas.DIM_COUNTRY),
        "fact_sales": spark.createDataFrame(rows["fact_sales"], schemas.FACT_SALES),
    }
