"""Every setting that changes a result, in one frozen dataclass."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from decimal import Decimal
from types import MappingProxyType
from typing import Any

# The column contract, the code lists, the market names and their regions.
RAW_COLUMNS = MappingProxyType(
    {
        "Invoice": "invoice_no",
        "StockCode": "stock_code",
        "Description": "description",
        "Quantity": "quantity",
        "InvoiceDate": "invoice_ts",
        "Price": "unit_price",
        "Customer ID": "customer_id",
        "Country": "country",
    }
)
CONTRACT_COLUMNS = (
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
DUPLICATE_KEY = ("invoice_no", "stock_code", "quantity", "invoice_ts", "unit_price")
FACT_ORDER = ("invoice_no", "stock_code", "invoice_ts", "quantity", "unit_price")
LINE_TYPES = ("product", "shipping", "adjustment", "test")
DEFAULT_LINE_TYPE = "product"
NET_LINE_TYPES = ("product", "shipping")
SHIPPING_CODES = ("POST", "DOT", "C2")
ADJUSTMENT_CODES = ("M", "D", "B", "CRUK", "BANK CHARGES", "AMAZONFEE", "ADJUST", "ADJUST2")
TEST_CODES = ("S", "TEST001", "TEST002")
SEGMENTS = (
    "Champions",
    "Loyal",
    "Potential Loyalist",
    "At Risk",
    "Cannot Lose Them",
    "Hibernating",
    "Lost",
)
SLIPPING_SEGMENTS = ("At Risk", "Cannot Lose Them")
COUNTRY_OVERRIDES = MappingProxyType(
    {
        "United Kingdom": "India",
        "EIRE": "Ireland",
        "RSA": "South Africa",
        "Korea": "South Korea",
    }
)
COUNTRY_REGIONS = MappingProxyType(
    {
        "Australia": "Asia-Pacific",
        "Austria": "Europe",
        "Bahrain": "Middle East & Africa",
        "Belgium": "Europe",
        "Bermuda": "Americas",
        "Brazil": "Americas",
        "Canada": "Americas",
        "Channel Islands": "Europe",
        "Cyprus": "Europe",
        "Czech Republic": "Europe",
        "Denmark": "Europe",
        "European Community": "Europe",
        "Finland": "Europe",
        "France": "Europe",
        "Germany": "Europe",
        "Greece": "Europe",
        "Hong Kong": "Asia-Pacific",
        "Iceland": "Europe",
        "India": "India",
        "Ireland": "Europe",
        "Israel": "Middle East & Africa",
        "Italy": "Europe",
        "Japan": "Asia-Pacific",
        "Lebanon": "Middle East & Africa",
        "Lithuania": "Europe",
        "Malta": "Europe",
        "Netherlands": "Europe",
        "Nigeria": "Middle East & Africa",
        "Norway": "Europe",
        "Poland": "Europe",
        "Portugal": "Europe",
        "Saudi Arabia": "Middle East & Africa",
        "Singapore": "Asia-Pacific",
        "South Africa": "Middle East & Africa",
        "South Korea": "Asia-Pacific",
        "Spain": "Europe",
        "Sweden": "Europe",
        "Switzerland": "Europe",
        "Thailand": "Asia-Pacific",
        "USA": "Americas",
        "United Arab Emirates": "Middle East & Africa",
        "Unspecified": "Unspecified",
        "West Indies": "Americas",
    }
)


@dataclass(frozen=True)
class Settings:
    duplicate_key: tuple[str, ...] = DUPLICATE_KEY
    cancellation_prefix: str = "C"
    min_unit_price: Decimal = Decimal(0)
    net_line_types: tuple[str, ...] = NET_LINE_TYPES
    shipping_codes: tuple[str, ...] = SHIPPING_CODES
    adjustment_codes: tuple[str, ...] = ADJUSTMENT_CODES
    test_codes: tuple[str, ...] = TEST_CODES
    country_overrides: Mapping[str, str] = field(default_factory=lambda: COUNTRY_OVERRIDES)
    country_regions: Mapping[str, str] = field(default_factory=lambda: COUNTRY_REGIONS)
    unknown_customer_key: int = -1
    revenue_tolerance: Decimal = Decimal("0.01")
    # gross_revenue, returns and net_revenue an audited extract must add up to; None skips it
    expected_totals: Mapping[str, Decimal] | None = None
    slipping_segments: tuple[str, ...] = SLIPPING_SEGMENTS
    currency: str = "INR"
    currency_symbol: str = "₹"
    # year-on-year windows, both ends included
    recent_year: tuple[str, str] = ("2010-12", "2011-11")
    prior_year: tuple[str, str] = ("2009-12", "2010-11")
    pareto_curve_points: int = 240
    top_products: int = 20
    top_leakage: int = 12
    # a lookup is broadcast only when the bytes measured in it stay within this bound
    broadcast_bytes: int = 128 << 20

    @property
    def code_groups(self) -> dict[str, tuple[str, ...]]:
        return {
            "shipping": self.shipping_codes,
            "adjustment": self.adjustment_codes,
            "test": self.test_codes,
        }

    def with_values(self, **changes: Any) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> Settings:
        """Settings from a plain mapping such as parsed JSON; an unknown name is an error."""
        known = {item.name: item for item in fields(cls)}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise KeyError(f"unknown settings: {unknown}")
        decimals = {"min_unit_price", "revenue_tolerance"}
        changes: dict[str, Any] = {}
        for name, value in values.items():
            if name in decimals:
                value = Decimal(str(value))
            elif name == "expected_totals" and value is not None:
                value = {key: Decimal(str(total)) for key, total in value.items()}
            elif isinstance(value, list):
                value = tuple(value)
            changes[name] = value
        return cls(**changes)

    @classmethod
    def from_json(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as handle:
            return cls.from_mapping(json.load(handle))
