"""Quick-commerce analytics on Spark: stores, stock, orders and deliveries."""
