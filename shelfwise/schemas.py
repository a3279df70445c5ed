"""Table schemas, keys and value rules of the 13 operational tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
ID = T.LongType()
INT = T.IntegerType()
UNITS = T.LongType()  # a snapshot may sum up many sales
TEXT = T.StringType()
FLAG = T.BooleanType()
DAY = T.DateType()
CLOCK = T.TimestampNTZType()  # timestamps carry no zone


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# In load order: every table comes after the tables it refers to.
SCHEMAS: dict[str, T.StructType] = {
    "cities": _struct(city_id=ID, city_name=TEXT, state=TEXT, tier=TEXT),
    "categories": _struct(category_id=ID, category_name=TEXT, parent_category_id=ID),
    "dark_stores": _struct(
        store_id=ID, store_name=TEXT, city_id=ID, store_area_sqft=INT, opened_date=DAY, is_active=FLAG
    ),
    "products": _struct(
        product_id=ID, product_name=TEXT, category_id=ID, brand=TEXT, unit_price=MONEY, unit_cost=MONEY,
        shelf_life_days=INT, is_active=FLAG,
    ),
    "customers": _struct(
        customer_id=ID, full_name=TEXT, email=TEXT, phone=TEXT, city_id=ID, signup_date=DAY, is_active=FLAG
    ),
    "promotions": _struct(
        promo_id=ID, promo_code=TEXT, description=TEXT, discount_pct=T.DecimalType(5, 2), start_date=DAY,
        end_date=DAY,
    ),
    "delivery_partners": _struct(
        partner_id=ID, partner_name=TEXT, city_id=ID, vehicle_type=TEXT, joined_date=DAY,
        rating=T.DecimalType(2, 1),
    ),
    "inventory": _struct(
        inventory_id=ID, store_id=ID, product_id=ID, stock_date=DAY, opening_stock=UNITS, closing_stock=UNITS,
        reorder_level=UNITS, units_received=UNITS, units_sold=UNITS, units_wasted=UNITS,
    ),
    "orders": _struct(
        order_id=ID, customer_id=ID, store_id=ID, promo_id=ID, order_datetime=CLOCK, order_status=TEXT,
        total_amount=MONEY,
    ),
    "order_items": _struct(
        order_item_id=ID, order_id=ID, product_id=ID, quantity=INT, unit_price=MONEY, line_total=MONEY
    ),
    "deliveries": _struct(
        delivery_id=ID, order_id=ID, partner_id=ID, promised_time_mins=INT, actual_time_mins=INT,
        dispatched_at=CLOCK, delivered_at=CLOCK, delivery_status=TEXT,
    ),
    "payments": _struct(
        payment_id=ID, order_id=ID, payment_method=TEXT, payment_status=TEXT, paid_amount=MONEY, paid_at=CLOCK
    ),
    "returns": _struct(
        return_id=ID, order_item_id=ID, return_reason=TEXT, return_date=DAY, refund_amount=MONEY
    ),
    "low_stock_alerts": _struct(
        store_id=ID, product_id=ID, closing_stock=UNITS, reorder_level=UNITS, flagged_at=CLOCK
    ),
}

# Keys, references and value rules the tables must satisfy.
PRIMARY_KEYS: dict[str, list[str]] = {
    "cities": ["city_id"],
    "categories": ["category_id"],
    "dark_stores": ["store_id"],
    "products": ["product_id"],
    "customers": ["customer_id"],
    "promotions": ["promo_id"],
    "delivery_partners": ["partner_id"],
    "inventory": ["inventory_id"],
    "orders": ["order_id"],
    "order_items": ["order_item_id"],
    "deliveries": ["delivery_id"],
    "payments": ["payment_id"],
    "returns": ["return_id"],
    "low_stock_alerts": ["store_id", "product_id", "flagged_at"],
}

UNIQUE_KEYS: list[tuple[str, list[str]]] = [
    ("customers", ["email"]),
    ("promotions", ["promo_code"]),
    ("inventory", ["store_id", "product_id", "stock_date"]),
    ("deliveries", ["order_id"]),
    ("payments", ["order_id"]),
    ("monthly_city_revenue", ["city_id", "order_month"]),
]

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("dark_stores", "city_id", "cities", "city_id"),
    ("categories", "parent_category_id", "categories", "category_id"),
    ("products", "category_id", "categories", "category_id"),
    ("inventory", "store_id", "dark_stores", "store_id"),
    ("inventory", "product_id", "products", "product_id"),
    ("customers", "city_id", "cities", "city_id"),
    ("delivery_partners", "city_id", "cities", "city_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "store_id", "dark_stores", "store_id"),
    ("orders", "promo_id", "promotions", "promo_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("deliveries", "order_id", "orders", "order_id"),
    ("deliveries", "partner_id", "delivery_partners", "partner_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("returns", "order_item_id", "order_items", "order_item_id"),
]

DOMAINS: dict[tuple[str, str], list[str]] = {
    ("cities", "tier"): ["Tier1", "Tier2", "Tier3"],
    ("delivery_partners", "vehicle_type"): ["Bike", "Bicycle", "Scooter"],
    ("orders", "order_status"): ["Placed", "Delivered", "Cancelled", "Returned"],
    ("deliveries", "delivery_status"): ["Delivered", "Delayed", "Failed", "Cancelled"],
    ("payments", "payment_method"): ["UPI", "Card", "Wallet", "COD", "NetBanking"],
    ("payments", "payment_status"): ["Success", "Failed", "Refunded", "Pending"],
}

# (table, rule name, condition every non-null value satisfies)
RANGES: list[tuple[str, str, str]] = [
    ("dark_stores", "store_area_sqft", "store_area_sqft > 0"),
    ("products", "unit_price", "unit_price >= 0"),
    ("products", "unit_cost", "unit_cost >= 0"),
    ("inventory", "opening_stock", "opening_stock >= 0"),
    ("inventory", "closing_stock", "closing_stock >= 0"),
    ("promotions", "discount_pct", "discount_pct BETWEEN 0 AND 100"),
    ("promotions", "end_date", "end_date >= start_date"),
    ("delivery_partners", "rating", "rating BETWEEN 0 AND 5"),
    ("orders", "total_amount", "total_amount >= 0"),
    ("order_items", "quantity", "quantity > 0"),
    ("order_items", "unit_price", "unit_price >= 0"),
    ("order_items", "line_total", "line_total >= 0"),
    ("payments", "paid_amount", "paid_amount >= 0"),
    ("returns", "refund_amount", "refund_amount >= 0"),
]

NOT_NULL: dict[str, list[str]] = {
    "cities": ["city_name", "state", "tier"],
    "categories": ["category_name"],
    "dark_stores": ["store_name", "city_id", "store_area_sqft", "opened_date", "is_active"],
    "products": ["product_name", "category_id", "unit_price", "unit_cost", "is_active"],
    "customers": ["full_name", "email", "city_id", "signup_date", "is_active"],
    "promotions": ["promo_code", "discount_pct", "start_date", "end_date"],
    "delivery_partners": ["partner_name", "city_id", "joined_date"],
    "inventory": [
        "store_id", "product_id", "stock_date", "opening_stock", "closing_stock", "reorder_level",
        "units_received", "units_sold", "units_wasted",
    ],
    "orders": ["customer_id", "store_id", "order_datetime", "order_status", "total_amount"],
    "order_items": ["order_id", "product_id", "quantity", "unit_price", "line_total"],
    "deliveries": ["order_id", "partner_id", "promised_time_mins", "delivery_status"],
    "payments": ["order_id", "payment_method", "payment_status", "paid_amount"],
    "returns": ["order_item_id", "return_date", "refund_amount"],
}

# (table, column): most characters of a text
TEXT_LENGTHS: dict[tuple[str, str], int] = {
    ("cities", "city_name"): 100,
    ("cities", "state"): 100,
    ("cities", "tier"): 10,
    ("dark_stores", "store_name"): 150,
    ("categories", "category_name"): 100,
    ("products", "product_name"): 200,
    ("products", "brand"): 100,
    ("customers", "full_name"): 150,
    ("customers", "email"): 150,
    ("customers", "phone"): 20,
    ("promotions", "promo_code"): 30,
    ("promotions", "description"): 200,
    ("delivery_partners", "partner_name"): 150,
    ("delivery_partners", "vehicle_type"): 30,
    ("orders", "order_status"): 20,
    ("deliveries", "delivery_status"): 20,
    ("payments", "payment_method"): 20,
    ("payments", "payment_status"): 20,
    ("returns", "return_reason"): 200,
}

COLUMN_DEFAULTS: dict[str, dict[str, object]] = {
    "dark_stores": {"is_active": True},
    "products": {"is_active": True},
    "customers": {"is_active": True},
    "inventory": {"reorder_level": 20, "units_received": 0, "units_sold": 0, "units_wasted": 0},
}

# What the cleaner requires, trims and parses, per table.
CLEAN_REQUIRED: dict[str, list[str]] = {
    "customers": ["customer_id", "email", "city_id"],
    "orders": ["order_id", "customer_id", "store_id", "order_status"],
    "order_items": ["order_item_id", "order_id", "product_id", "quantity"],
    "products": ["product_id", "product_name", "category_id"],
    "inventory": ["inventory_id", "store_id", "product_id", "stock_date"],
    "dark_stores": ["store_id", "store_name", "city_id"],
    "deliveries": ["delivery_id", "order_id", "partner_id"],
    "payments": ["payment_id", "order_id", "payment_method"],
    "returns": ["return_id", "order_item_id", "return_date"],
}

CLEAN_TEXT: dict[str, list[str]] = {
    "customers": ["full_name", "email"],
    "products": ["product_name", "brand"],
    "dark_stores": ["store_name"],
    "cities": ["city_name", "state"],
    "delivery_partners": ["partner_name"],
}

CLEAN_DATES: dict[str, list[str]] = {
    "orders": ["order_datetime"],
    "inventory": ["stock_date"],
    "customers": ["signup_date"],
    "dark_stores": ["opened_date"],
    "delivery_partners": ["joined_date"],
    "promotions": ["start_date", "end_date"],
    "deliveries": ["dispatched_at", "delivered_at"],
    "payments": ["paid_at"],
    "returns": ["return_date"],
}

CLEAN_ZERO_WHEN_MISSING = ["units_wasted", "units_received", "units_sold", "discount_pct"]
