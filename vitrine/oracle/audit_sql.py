"""Oracle SQL for the audit operators (generated from the view column lists)."""

from vitrine.oracle import with_views

COLUMNS = {
    "orders": ("r_orders", ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                            "order_approved_at", "order_delivered_carrier_date",
                            "order_delivered_customer_date", "order_estimated_delivery_date"]),
    "customers": ("r_customers", ["customer_id", "customer_unique_id", "customer_state"]),
    "order_items": ("r_items", ["order_id", "order_item_id", "product_id", "seller_id", "price",
                                "freight_value"]),
    "products": ("r_products", ["product_id", "product_category_name", "product_weight_g",
                                "product_length_cm", "product_height_cm", "product_width_cm"]),
    "sellers": ("r_sellers", ["seller_id", "seller_state"]),
    "payments": ("r_payments", ["order_id", "payment_sequential", "payment_type",
                                "payment_installments", "payment_value"]),
    "reviews": ("r_reviews", ["review_id", "order_id", "review_score", "review_answer_timestamp"]),
    "product_category_name_translation": ("r_translation", ["product_category_name",
                                                             "product_category_name_english"]),
}

_core = [n for n in COLUMNS if n != "product_category_name_translation"]
_main_cols = len({c for _, cols in [COLUMNS[n] for n in ("orders", "customers", "order_items", "payments",
                                                           "products", "reviews", "sellers")] for c in cols})



def _type(c: str) -> str:
    """The view's data type, by the column's name."""
    if c in ("price", "freight_value", "payment_value"):
        return "decimal(15,2)"
    if c in ("order_item_id", "payment_sequential", "payment_installments", "review_score"):
        return "int"
    if c.endswith("_id"):
        return "bigint"
    if c.endswith(("_timestamp", "_at", "_date")):
        return "timestamp_ntz"
    return "double" if c.endswith(("_g", "_cm")) else "string"


SQL = {
    "schema_profile": with_views("\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{_type(c)}' AS data_type, {i} AS position, "
        f"COUNT(*) AS n_rows, COUNT({c}) AS non_null FROM {v}"
        for n, (v, cols) in COLUMNS.items() for i, c in enumerate(cols))),
    "table_row_counts": with_views("\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {COLUMNS[n][0]}" for n in _core)),
    "null_audit_orders": with_views("""
SELECT COUNT(*) AS total_orders,
  COUNT(*) - COUNT(order_status) AS null_status,
  COUNT(*) - COUNT(order_purchase_timestamp) AS null_purchase_date,
  COUNT(*) - COUNT(order_delivered_customer_date) AS null_delivery_date,
  COUNT(*) - COUNT(customer_id) AS null_customer_id
FROM r_orders"""),
    "null_profile": with_views("\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM {v}"
        for n, (v, cols) in COLUMNS.items() for c in cols)),
    "shape_profile": with_views("\nUNION ALL\n".join(
        [f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows, {len(cols)} AS n_columns FROM {v}"
         for n, (v, cols) in COLUMNS.items()]
        + [f"""SELECT 'main', COUNT(*), {_main_cols} FROM r_orders o
  LEFT JOIN r_customers c ON o.customer_id = c.customer_id
  LEFT JOIN r_items i ON o.order_id = i.order_id
  LEFT JOIN r_payments p ON o.order_id = p.order_id
  LEFT JOIN r_products pr ON i.product_id = pr.product_id
  LEFT JOIN r_reviews r ON o.order_id = r.order_id
  LEFT JOIN r_sellers s ON i.seller_id = s.seller_id"""])),
    "dataset_summary": with_views("""
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT c.customer_unique_id) AS unique_customers,
  COUNT(DISTINCT o.order_id) AS unique_orders,
  strftime(MIN(o.order_purchase_timestamp), '%Y-%m-%d') AS first_order_date,
  strftime(MAX(o.order_purchase_timestamp), '%Y-%m-%d') AS last_order_date
FROM r_orders o LEFT JOIN r_payments p ON o.order_id = p.order_id
LEFT JOIN r_customers c ON o.customer_id = c.customer_id"""),
}
