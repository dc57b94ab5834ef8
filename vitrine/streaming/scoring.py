"""ML26 as a stream: score new orders for late delivery as they land.

The workload plans a daily batch job: score the orders placed since the last
run and flag those with a delay probability above 0.7. In Spark that is a
Structured Streaming query over the folder new order files arrive in, run
with ``trigger(availableNow=True)`` once a day: the checkpoint remembers which
files were scored, and a lost executor only re-runs its micro-batch.

Each micro-batch is joined to the static item, product, payment and customer
tables, encoded with the vocabularies fitted at training time, scored by the
fitted pipeline, and appended to the sink.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.ml import DELAY_FEATURES
from vitrine.sources.tables import RetailTables

# (column, fill value, code column) of the delay model's encoders.
ENCODERS = (("customer_state", "Unknown", "state_enc"), ("product_category_name", "unknown", "cat_enc"),
            ("payment_type", "unknown", "payment_enc"))


def order_time_features(orders: DataFrame, t: RetailTables) -> DataFrame:
    """Features known when an order is placed (no delivery columns needed);
    only the batch's orders are aggregated."""
    ids = orders.select("order_id").distinct()
    own_items = t.items.join(ids, "order_id", "left_semi")
    own_payments = t.payments.join(ids, "order_id", "left_semi")
    items = own_items.groupBy("order_id").agg(F.sum("price").cast("double").alias("price"),
                                            F.sum("freight_value").cast("double").alias("freight"))
    prod = (own_items.select("order_id", "product_id").join(t.products, "product_id")
            .groupBy("order_id").agg(
                F.coalesce(F.mode("product_category_name", deterministic=True), F.lit("unknown"))
                .alias("product_category_name"),
                *[F.avg(c).alias(c) for c in ("product_weight_g", "product_length_cm", "product_height_cm",
                                              "product_width_cm")]))
    pay = own_payments.groupBy("order_id").agg(
        F.coalesce(F.mode("payment_type", deterministic=True), F.lit("unknown")).alias("payment_type"))
    return (orders.select("order_id", "customer_id")
            .join(t.customers.select("customer_id", "customer_state"), "customer_id", "left")
            .join(items, "order_id", "left").join(prod, "order_id", "left").join(pay, "order_id", "left")
            .withColumn("volume_cm3",
                        F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")))


def vocabularies(training: DataFrame) -> dict[str, DataFrame]:
    """The fitted encoders as (value, code) frames, from the training table
    (``ml.delay_table`` output, which carries both the text and the code)."""
    return {col: training.select(col, code).distinct() for col, _, code in ENCODERS}


def encode(df: DataFrame, vocab: dict[str, DataFrame]) -> DataFrame:
    """Apply fitted codes; a value unseen at training time gets null."""
    for col, fill, code in ENCODERS:
        df = (df.withColumn(col, F.coalesce(F.col(col), F.lit(fill)))
              .join(vocab[col], col, "left"))
    return df


def score_orders(orders: DataFrame, t: RetailTables, model: PipelineModel, vocab: dict[str, DataFrame],
                 threshold: float = 0.7) -> DataFrame:
    """Every order once, with its probability; an order the model can't place
    has null there and the columns it lacks in ``reason``."""
    feats = encode(order_time_features(orders, t), vocab)
    lacks = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in DELAY_FEATURES])
    feats = feats.withColumn("reason", F.nullif(lacks, F.lit("")))
    scored = (model.transform(feats.where("reason is null"))
              .select("order_id", vector_to_array(F.col("probability"))[1].alias("delay_probability"), "reason"))
    rest = feats.where("reason is not null").select("order_id", F.lit(None).cast("double").alias("delay_probability"), "reason")
    return (scored.unionByName(rest).withColumn("flagged", F.col("delay_probability") > threshold)
            .withColumn("scored_at", F.current_timestamp()))


def start_delay_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str,
                        t: RetailTables, model: PipelineModel, vocab: dict[str, DataFrame],
                        threshold: float = 0.7, available_now: bool = True) -> StreamingQuery:
    """Start the scoring stream over new order files in ``source_dir``
    (Parquet with the orders schema). Returns the running query. Each batch
    has its own folder ``batch=<id>``, which a retry of the batch overwrites."""
    stream = spark.readStream.schema(t.orders.schema).parquet(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        score_orders(batch, t, model, vocab, threshold).write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 day")
    return w.start()
