"""Feature tables, labels, encodings and splits for the three models
(ML1-ML9, ML17-ML19, ML22 input, ML24, ML29).

Everything here is deterministic DataFrame work (the DuckDB oracle checks
it): per-order rollups before joins, per-customer aggregates with partial
aggregation, exact medians and splits through ``plans.ranking``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import DEFAULT_EXCLUDED, active_status, delay_days_floor, rnd
from vitrine.operators.prepare import latest_review_per_order
from vitrine.operators.profit import equal_width_histogram
from vitrine.plans.ranking import checkpoint, global_rank, grouped_quantiles
from vitrine.sources.tables import RetailTables

QUERIES = ("order_features", "customer_features", "churn_labels", "recency_histogram", "label_encode",
           "stratified_split", "random_split", "standardise", "class_weights", "time_split", "clv_features",
           "future_spend", "delay_features", "delay_class_balance", "sample_rows")

CHURN_THRESHOLD = 90
SEED = 42
CHURN_FEATURES = ["frequency", "monetary", "avg_order_value", "avg_review_score", "avg_freight",
                  "avg_installments", "avg_delay_days", "n_items_total", "state_enc", "payment_enc"]
CLV_FEATURES = ["frequency_early", "total_spend_early", "avg_order_value", "avg_freight", "avg_installments",
                "state_enc", "cat_enc"]
DELAY_FEATURES = ["product_weight_g", "volume_cm3", "price", "freight", "state_enc", "cat_enc", "payment_enc"]


def clean_orders(t: RetailTables, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """Orders minus excluded statuses; a null status is kept (pandas ~isin)."""
    return t.orders.where(active_status(excluded=excluded, keep_null=True))


def _items_agg(t: RetailTables) -> DataFrame:
    return t.items.groupBy("order_id").agg(
        F.sum("price").alias("order_price"), F.sum("freight_value").alias("freight_value"),
        F.count("order_item_id").alias("n_items"))


def _pay_agg(t: RetailTables) -> DataFrame:
    return t.payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        F.mode("payment_type", deterministic=True).alias("payment_type"))


def order_table(t: RetailTables) -> DataFrame:
    """ML1 core: one row per clean order with item, payment, latest-review and
    delay columns (left joins on per-order rollups)."""
    o = clean_orders(t).select("order_id", "customer_id", "order_purchase_timestamp",
                               "order_delivered_customer_date", "order_estimated_delivery_date")
    return (o.join(t.customers, "customer_id", "left")
            .join(_items_agg(t), "order_id", "left")
            .join(_pay_agg(t), "order_id", "left")
            .join(latest_review_per_order(t.reviews), "order_id", "left")
            .withColumn("delay_days", delay_days_floor()))


def order_features(t: RetailTables) -> DataFrame:
    """ML1: the order-level feature table."""
    return order_table(t).select(
        "order_id", "customer_unique_id", "customer_state",
        F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss").alias("purchase_ts"),
        F.col("order_price").cast("double").alias("order_price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        F.col("n_items").cast("double").alias("n_items"),
        F.col("payment_value").cast("double").alias("payment_value"),
        F.col("payment_installments").cast("double").alias("payment_installments"), "payment_type",
        F.col("review_score").cast("double").alias("review_score"),
        F.col("delay_days").cast("double").alias("delay_days"))


def _first_by_time(col: str) -> Column:
    return F.min_by(col, F.struct("order_purchase_timestamp", "order_id"))


def customer_table(t: RetailTables) -> DataFrame:
    """ML2 core: 11 features per customer; missing delay -> 0, missing
    review -> the exact median over customers (1-row, broadcast)."""
    # the reference date needs the clean orders only, not the joined table; a
    # scalar, as behind a cross join AQE keeps the shuffle's partitions at 1 MB
    ref = clean_orders(t).agg(F.max("order_purchase_timestamp")).scalar()
    o = order_table(t).where(F.col("customer_unique_id").isNotNull())
    c = (o.groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("_last"),
        F.count(F.lit(1)).alias("frequency"),
        F.coalesce(F.sum("order_price"), F.lit(0)).cast("double").alias("monetary"),
        F.avg(F.col("order_price").cast("double")).alias("avg_order_value"),
        F.avg("review_score").alias("avg_review_score"),
        F.avg(F.col("freight_value").cast("double")).alias("avg_freight"),
        F.avg("payment_installments").alias("avg_installments"),
        F.coalesce(F.avg("delay_days"), F.lit(0.0)).alias("avg_delay_days"),
        _first_by_time("customer_state").alias("customer_state"),
        F.coalesce(F.mode("payment_type", deterministic=True), F.lit("unknown")).alias("payment_type"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items_total"))
        .withColumn("recency_days", delay_days_floor(ref, "_last"))
        .drop("_last"))
    c = checkpoint(c)  # read by the median and by the output: compute once
    med = grouped_quantiles(c, "avg_review_score", [0.5], [], ["customer_unique_id"]).select(
        F.col("q").alias("_med"))
    return (c.crossJoin(F.broadcast(med))
            .withColumn("avg_review_score", F.coalesce("avg_review_score", "_med")).drop("_med"))


def _round_features(df: DataFrame, cols) -> list[Column]:
    return [rnd(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in cols]


CUSTOMER_COLUMNS = ["customer_unique_id", "recency_days", "frequency", "monetary", "avg_order_value",
                    "avg_review_score", "avg_freight", "avg_installments", "avg_delay_days", "customer_state",
                    "payment_type", "n_items_total"]


def customer_features(t: RetailTables) -> DataFrame:
    """ML2: the customer feature table."""
    c = customer_table(t)
    return c.select(*_round_features(c, CUSTOMER_COLUMNS))


def churn_frame(t: RetailTables, threshold: int = CHURN_THRESHOLD) -> DataFrame:
    """ML3 core: customers with ``churned`` = recency above ``threshold`` days
    (the customer table is checkpointed, so encoding, splitting and three
    model fits read stored rows)."""
    return customer_table(t).withColumn("churned", (F.col("recency_days") > threshold).cast("int"))


def churn_labels(t: RetailTables, threshold: int = CHURN_THRESHOLD) -> DataFrame:
    """ML3: class balance of the churn label."""
    c = churn_frame(t, threshold)
    total = c.agg(F.count(F.lit(1)).alias("_all"))
    return (c.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"))
            .crossJoin(F.broadcast(total))
            .select("churned", "customers", rnd(F.col("customers") * 100.0 / F.col("_all"), 2).alias("pct")))


def recency_histogram(t: RetailTables, bins: int = 60) -> DataFrame:
    """ML4: 60 equal-width bins of recency (chart data)."""
    return equal_width_histogram(customer_table(t), F.col("recency_days"), bins)


#: Vocabularies up to this size are sent to every task; a larger one is met by
#: a join salted over so many parts.
DICTIONARY, SALTS = 10_000, 16


def label_codes(df: DataFrame, col: str, fill: str, out: str, dictionary: int = DICTIONARY) -> DataFrame:
    """ML5: alphabetical integer codes (LabelEncoder / StringIndexer with
    alphabetAsc) for ``col`` after filling nulls with ``fill``.

    The vocabulary is counted first (distinct values, combined before the
    shuffle). A small one is broadcast, so the rows stay where they are however
    skewed the column is; a large one is ranked with ``global_rank``, repeated
    once per salt, and joined on (value, salt), so that the rows of a hot value
    go to ``SALTS`` tasks."""
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit(fill)))
    distinct = filled.select(col).distinct()
    few = distinct.limit(dictionary + 1).collect()
    if len(few) <= dictionary:
        rows = [(v, i) for i, v in enumerate(sorted(r[col] for r in few))]
        vocab = df.sparkSession.createDataFrame(rows, f"`{col}` string, `{out}` int")
        return filled.join(F.broadcast(vocab), col, "left")
    vocab = global_rank(distinct, [F.col(col).asc()], "_code").select(col, (F.col("_code") - 1).cast("int").alias(out))
    vocab = vocab.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = filled.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return spread.join(vocab.hint("merge"), [col, "_salt"], "left").drop("_salt")


def label_codes_many(df: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """Several encoders: (column, fill value, code column) each."""
    for col, fill, out in specs:
        df = label_codes(df, col, fill, out)
    return df


def churn_encoded(t: RetailTables) -> DataFrame:
    return label_codes_many(churn_frame(t), [("customer_state", "Unknown", "state_enc"),
                                             ("payment_type", "Unknown", "payment_enc")])


def label_encode(t: RetailTables) -> DataFrame:
    """ML5: state and payment-type codes per customer."""
    return churn_encoded(t).select("customer_unique_id", "customer_state", "state_enc", "payment_type",
                                   "payment_enc")


def hash_key(df: DataFrame, col: str) -> Column:
    """Deterministic pseudo-random order key. Integer keys take a Lehmer
    step, (key x 48271) mod (2^31 - 1), the same in every engine; other keys
    (the marketplace's hex ids) use the seeded 64-bit xxHash."""
    if dict(df.dtypes)[col] in ("tinyint", "smallint", "int", "bigint"):
        # reduced first: the product of a 64-bit key would overflow
        return (F.col(col).cast("bigint") % 2147483647 * 48271) % 2147483647
    return F.pmod(F.xxhash64(F.col(col), F.lit(SEED)), F.lit(2147483647))


def split_stratified(df: DataFrame, label: str = "churned", key: str = "customer_unique_id",
                     test_size: float = 0.2) -> DataFrame:
    """ML6: ``split`` = 'test'/'train' keeping each class's share. The test
    set has ceil(test_size * n) rows, shared out over classes by largest
    remainder; inside a class the rows with the smallest hash go to test."""
    h = df.withColumn("_h", hash_key(df, key))
    ranked = global_rank(h, [F.col(label), F.col("_h"), F.col(key)], "_r", count_col="_n")
    cls = ranked.groupBy(label).agg(F.min("_r").alias("_r0"), F.count(F.lit(1)).alias("_nc"),
                                    F.max("_n").alias("_n"))
    exact = F.ceil(F.col("_n") * test_size) * F.col("_nc") / F.col("_n")
    cls = cls.select("*", F.floor(exact).alias("_base"), (exact - F.floor(exact)).alias("_frac"),
                     F.ceil(F.col("_n") * test_size).alias("_ntest"))
    # Classes are few (a label's values): the remainder is shared on that tiny frame.
    w = Window.partitionBy(F.lit(1))
    cls = cls.select("*", (F.col("_ntest") - F.sum("_base").over(w)).alias("_rem"),
                     F.row_number().over(w.orderBy(F.desc("_frac"), F.col(label))).alias("_pos"))
    cls = cls.select(label, "_r0", (F.col("_base") + (F.col("_pos") <= F.col("_rem")).cast("int")).alias("_take"))
    out = ranked.join(F.broadcast(cls), label)
    return out.withColumn("split", F.when(F.col("_r") - F.col("_r0") < F.col("_take"), "test").otherwise("train")) \
        .drop("_h", "_r", "_n", "_r0", "_take")


def split_random(df: DataFrame, key: str = "customer_unique_id", test_size: float = 0.2) -> DataFrame:
    """ML7: plain 80/20 split by hash order; ceil(test_size * n) test rows."""
    ranked = global_rank(df.withColumn("_h", hash_key(df, key)), [F.col("_h"), F.col(key)], "_r", count_col="_n")
    return ranked.withColumn("split", F.when(F.col("_r") <= F.ceil(F.col("_n") * test_size), "test")
                             .otherwise("train")).drop("_h", "_r", "_n")


def standardise_frame(df: DataFrame, features=CHURN_FEATURES, split_col: str = "split",
                      keep=("customer_unique_id",)) -> DataFrame:
    """ML8: z-scores with mean and population std fitted on the train rows
    only (a zero std scales by 1); nulls count as 0 as in the model input."""
    df = df.fillna(0, subset=list(features))
    stats = df.where(F.col(split_col) == "train").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    z = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c)
         for c in features]
    return df.crossJoin(F.broadcast(stats)).select(*keep, split_col, *z)


def class_weight_frame(df: DataFrame, label: str = "churned", split_col: str = "split") -> DataFrame:
    """ML9: balanced class weights n / (k n_c) on the train rows, and the
    negative/positive ratio used as the positive weight for boosting."""
    tr = df.where(F.col(split_col) == "train")
    per = tr.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = tr.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_k"),
                 F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("_pos"))
    return per.crossJoin(F.broadcast(tot)).select(
        F.col(label).alias("label"), "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"),
        (F.col("_neg") / F.col("_pos")).alias("scale_pos_weight"))


def with_weights(df: DataFrame, label: str, split_col: str = "split", out: str = "weight") -> DataFrame:
    """Attach the balanced class weight of each row's class."""
    w = class_weight_frame(df, label, split_col).select(F.col("label").alias(label), F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")


# ------------------------------------------------------------------ CLV
def midpoint(t: RetailTables) -> DataFrame:
    """ML17 core: 1 row with min, max and the midpoint of purchase times
    (half the span in whole microseconds)."""
    o = clean_orders(t)
    r = o.agg(F.min("order_purchase_timestamp").alias("_min"), F.max("order_purchase_timestamp").alias("_max"))
    return r.select("_min", "_max",
                    F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, _min, _max) div 2, _min)").alias("_mid"))


def _halves(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    o = clean_orders(t).crossJoin(F.broadcast(midpoint(t).select("_mid")))
    early = o.where(F.col("order_purchase_timestamp") <= F.col("_mid")).drop("_mid")
    late = o.where(F.col("order_purchase_timestamp") > F.col("_mid")).drop("_mid")
    return early, late


def time_split(t: RetailTables) -> DataFrame:
    """ML17: the midpoint and the orders on each side of it."""
    o = clean_orders(t).crossJoin(F.broadcast(midpoint(t)))
    side = F.when(F.col("order_purchase_timestamp") <= F.col("_mid"), "early").otherwise("late")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return (o.groupBy(side.alias("period"), F.date_format("_mid", fmt).alias("midpoint"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.date_format(F.min("order_purchase_timestamp"), fmt).alias("first_ts"),
                 F.date_format(F.max("order_purchase_timestamp"), fmt).alias("last_ts")))


def clv_table(t: RetailTables) -> DataFrame:
    """ML18 core: early-half features per customer with the modal category
    (lowest on a tie, 'unknown' if none), their codes and the late-half spend."""
    return label_codes_many(checkpoint(_clv_plain(t)), [("customer_state", "Unknown", "state_enc"), ("top_category", "unknown", "cat_enc")])


def _clv_plain(t: RetailTables) -> DataFrame:
    early, late = _halves(t)
    items = t.items.groupBy("order_id").agg(F.sum("price").alias("order_price"),
                                            F.sum("freight_value").alias("freight"))
    pay = t.payments.groupBy("order_id").agg(F.max("payment_installments").alias("payment_installments"))
    e = (early.select("order_id", "customer_id", "order_purchase_timestamp")
         .join(t.customers, "customer_id", "left").join(items, "order_id", "left").join(pay, "order_id", "left")
         .where(F.col("customer_unique_id").isNotNull()))
    feats = e.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("frequency_early"),
        F.coalesce(F.sum("order_price"), F.lit(0)).cast("double").alias("total_spend_early"),
        F.avg(F.col("order_price").cast("double")).alias("avg_order_value"),
        F.avg(F.col("freight").cast("double")).alias("avg_freight"),
        F.avg("payment_installments").alias("avg_installments"),
        _first_by_time("customer_state").alias("customer_state"))
    prod = (t.products.select("product_id", "product_category_name")
            .join(t.translation, "product_category_name", "left")
            .select("product_id", F.coalesce("product_category_name_english", "product_category_name").alias("category")))
    cats = (early.select("order_id", "customer_id").join(t.items.select("order_id", "product_id"), "order_id", "left")
            .join(t.customers, "customer_id", "left").join(prod, "product_id", "left")
            .where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id")
            .agg(F.coalesce(F.mode("category", deterministic=True), F.lit("unknown")).alias("top_category")))
    fut = (late.select("order_id", "customer_id").join(t.customers, "customer_id", "left")
           .join(t.items.groupBy("order_id").agg(F.sum("price").alias("price")), "order_id", "left")
           .where(F.col("customer_unique_id").isNotNull())
           .groupBy("customer_unique_id").agg(F.coalesce(F.sum("price"), F.lit(0)).alias("future_spend")))
    return (feats.join(cats, "customer_unique_id", "left").join(fut, "customer_unique_id", "left")
            .withColumn("future_spend", F.coalesce(F.col("future_spend").cast("double"), F.lit(0.0))))


def clv_features(t: RetailTables) -> DataFrame:
    """ML18: CLV features of the early half."""
    c = clv_table(t)
    cols = ["customer_unique_id", "frequency_early", "total_spend_early", "avg_order_value", "avg_freight",
            "avg_installments", "customer_state", "top_category", "state_enc", "cat_enc"]
    return c.select(*_round_features(c, cols))


def future_spend(t: RetailTables) -> DataFrame:
    """ML19: late-half spend per early customer (0 if none)."""
    return _clv_plain(t).select("customer_unique_id", rnd("future_spend", 2).alias("future_spend"))


# ---------------------------------------------------------------- delay
def delay_table(t: RetailTables) -> DataFrame:
    """ML24 core: delivered clean orders with features known at purchase
    time, ``is_delayed`` = delivered after the estimate (timestamps), rows
    with a null feature dropped."""
    return _delay_rows(t).dropna(subset=DELAY_FEATURES + ["is_delayed"])


def _delay_rows(t: RetailTables) -> DataFrame:
    o = (clean_orders(t).where(F.col("order_delivered_customer_date").isNotNull())
         .select("order_id", "customer_id",
                 (F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"))
                 .cast("int").alias("is_delayed")))
    items = t.items.groupBy("order_id").agg(F.sum("price").cast("double").alias("price"),
                                            F.sum("freight_value").cast("double").alias("freight"))
    prod = (t.items.select("order_id", "product_id").join(t.products, "product_id")
            .groupBy("order_id").agg(
                F.coalesce(F.mode("product_category_name", deterministic=True), F.lit("unknown"))
                .alias("product_category_name"),
                *[F.avg(c).alias(c) for c in ("product_weight_g", "product_length_cm", "product_height_cm",
                                              "product_width_cm")]))
    pay = t.payments.groupBy("order_id").agg(
        F.coalesce(F.mode("payment_type", deterministic=True), F.lit("unknown")).alias("payment_type"))
    df = (o.join(t.customers.select("customer_id", "customer_state"), "customer_id", "left")
          .join(items, "order_id", "left").join(prod, "order_id", "left").join(pay, "order_id", "left")
          .withColumn("volume_cm3", F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")))
    df = checkpoint(df)
    df = label_codes_many(df, [("customer_state", "Unknown", "state_enc"),
                               ("product_category_name", "unknown", "cat_enc"),
                               ("payment_type", "unknown", "payment_enc")])
    return df


def delay_class_balance(t: RetailTables) -> DataFrame:
    """ML24, PRP14: class balance of the delay label over the rows that stay,
    with the number of rows before and of those dropped for a null feature.
    All come from the counts of the one pass. Not by an observation: Spark's
    sessions can't be serialised after one, and a forest fitted later in the
    same session holds its session."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in DELAY_FEATURES + ["is_delayed"]])
    counts = checkpoint(_delay_rows(t).groupBy("is_delayed", bad.alias("_bad")).agg(F.count(F.lit(1)).alias("orders")))
    total = counts.agg(F.sum(F.when(~F.col("_bad"), F.col("orders"))).alias("_all"), F.sum("orders").alias("rows_before"),
                       F.coalesce(F.sum(F.when(F.col("_bad"), F.col("orders"))), F.lit(0).cast("long")).alias("rows_dropped"))
    return counts.where(~F.col("_bad")).crossJoin(F.broadcast(total)).select(
        "is_delayed", "orders", rnd(F.col("orders") * 100.0 / F.col("_all"), 2).alias("pct"), "rows_before", "rows_dropped")


def delay_features(t: RetailTables) -> DataFrame:
    """ML24: the delay model's input table."""
    d = delay_table(t)
    return d.select("order_id", *_round_features(d, DELAY_FEATURES), "is_delayed")


def sample_rows(t: RetailTables, n: int = 2000) -> DataFrame:
    """ML29: a seeded sample of at most ``n`` test rows of the delay table
    (hash order; the limit is the operator)."""
    d = split_stratified(delay_table(t), label="is_delayed", key="order_id").where(F.col("split") == "test")
    return (d.orderBy(hash_key(d, "order_id"), "order_id").limit(n)
            .select("order_id", *_round_features(d, DELAY_FEATURES), "is_delayed"))


def churn_split(t: RetailTables, columns: list[str] | None = None) -> DataFrame:
    """Encoded churn customers with the stratified 80/20 split; with
    ``columns``, those (key and label among them) and the split alone."""
    c = churn_encoded(t)
    return split_stratified(c.select(*columns) if columns else c)


def stratified_split(t: RetailTables) -> DataFrame:
    """ML6: churn customers, label and split."""
    return churn_split(t).select("customer_unique_id", "churned", "split")


def random_split(t: RetailTables) -> DataFrame:
    """ML7: CLV customers and their plain 80/20 split."""
    return split_random(checkpoint(_clv_plain(t).select("customer_unique_id"))).select("customer_unique_id", "split")


def standardise(t: RetailTables) -> DataFrame:
    """ML8: churn features standardised on the train split."""
    z = standardise_frame(churn_split(t))
    return z.select("customer_unique_id", "split", *[rnd(c, 6).alias(c) for c in CHURN_FEATURES])


def class_weights(t: RetailTables) -> DataFrame:
    """ML9: churn class weights on the train split."""
    w = class_weight_frame(churn_split(t))
    return w.select("label", "n", rnd("weight", 6).alias("weight"), rnd("scale_pos_weight", 6).alias("scale_pos_weight"))


__all__ = list(QUERIES) + ["order_table", "customer_table", "churn_frame", "churn_encoded", "clv_table",
                           "delay_table", "label_codes", "with_weights", "hash_key"]
