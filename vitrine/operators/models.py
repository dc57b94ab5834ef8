"""Models, scores and evaluation (ML10-ML16, ML20-ML23, ML25-ML27).

Estimators are ``pyspark.ml`` (distributed training); features come from
``operators.ml``. Metrics are DataFrame aggregates over (label, score): the
exact ROC-AUC is an average-rank sum (``plans.ranking.rank_sum``), the ROC
curve a global running sum, nothing is collected. Each model is fitted once
per input and code version: the pipeline and its scores are published to the
shared checkpoint folder, so later queries and later sessions load them.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import rnd
from vitrine.operators.ml import (
    CHURN_FEATURES,
    CLV_FEATURES,
    DELAY_FEATURES,
    SEED,
    _clv_plain,
    churn_split,
    clv_table,
    delay_table,
    split_random,
    split_stratified,
    standardise_frame,
    with_weights,
)
from vitrine.plans.ranking import checkpoint, global_cumsum, global_rank, quantile_edges, rank_sum
from vitrine.sources.tables import RetailTables

QUERIES = ("churn_model_logistic", "churn_model_forest", "churn_model_boosted", "model_comparison", "roc_curve",
           "auc_rank", "confusion_report", "clv_model", "regression_report", "clv_tiers", "clv_tier_summary",
           "delay_model", "score_risk_flags", "feature_importance",
           "scorecard_roc_curve", "scorecard_auc", "scorecard_confusion", "baseline_regression_report",
           "baseline_clv_tiers", "baseline_clv_tier_summary")

# Hyper-parameters of the workload's three models.
CHURN_MODELS = {
    "logistic_regression": dict(max_iter=1000, C=1.0),
    "random_forest": dict(num_trees=200, max_depth=10),
    "boosted_trees": dict(max_iter=200, max_depth=6, step=0.05),
}
CLV_PARAMS = dict(max_iter=200, max_depth=5, step=0.05, subsample=0.8)
DELAY_PARAMS = dict(num_trees=200, max_depth=8)

# Rows of a fit's input one task takes; an input up to ``SPREAD_FROM`` rows
# stays as it lies.
TASK_ROWS, SPREAD_FROM = 500_000, 50_000
# Node statistics a forest gathers at a time (MB): few trees at a time stay in
# the processor's caches and don't fill a task's memory.
FOREST_MB = 48
# Trees of a forest that grow at a time on an input above ``SPREAD_FROM`` rows.
# Spark keeps a count per row and tree meanwhile: with 200 trees some 900 bytes
# a row, most of which a large input spills to disk and reads at every level.
FOREST_TREES = 25

_CACHE: dict = {}
_LOCKS: dict = {}


def _key(t: RetailTables, name: str):
    """By the identity of the input files; tables without one (built in
    memory) share nothing with any other bundle."""
    spark = t.orders.sparkSession
    return (spark.sparkContext.applicationId, t.dataset_id or ("object", id(t)), name)


def _cached(t: RetailTables, name: str, build):
    k = _key(t, name)
    with _LOCKS.setdefault(k, threading.RLock()):  # fits run side by side
        if k not in _CACHE:
            # the bundle is kept with its entry, so that no other gets its id()
            _CACHE[k] = (t, build())
        return _CACHE[k][1]


def _fit_root(t: RetailTables, name: str) -> str:
    from vitrine import session

    return f"{session.shared_dir(t.orders.sparkSession)}/vitrine-models/{t.dataset_id}-{session.package_version()}/{name.replace(':', '_')}"


def _persisted_fit(t: RetailTables, name: str, build) -> tuple[PipelineModel, DataFrame]:
    """Fit once per input and code version: the fitted pipeline (SNK3) and
    its scores are written to the shared checkpoint folder and reloaded by
    later calls and later sessions instead of retraining. Without an identity
    of the input nothing is stored."""
    from vitrine import session
    from vitrine.sources.sinks import load_model, save_model

    if t.dataset_id is None:
        model, scored = build()
        return model, checkpoint(scored)
    spark = t.orders.sparkSession
    root = _fit_root(t, name)

    def write(out: str) -> None:
        model, scored = build()
        save_model(model, f"{out}/model")
        scored.write.mode("overwrite").parquet(f"{out}/scored")

    root = session.publish(spark, root, write)
    return load_model(f"{root}/model"), spark.read.parquet(f"{root}/scored")


def _reloaded(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The fitted pipeline through Spark's model format: a forest fresh from
    its fit holds a training summary, and with it the session, which can't go
    to a task once anything in it was observed. A loaded one holds neither."""
    from vitrine import session
    from vitrine.sources.sinks import load_model, save_model

    path = f"{session.resolve_checkpoint_dir(spark).rstrip('/')}/vitrine-fits/{uuid.uuid4().hex}"
    save_model(model, path)
    return load_model(path)


def grow_forest(est: RandomForestClassifier, train: DataFrame) -> RandomForestClassificationModel:
    """The forest ``est`` describes, on a large input ``FOREST_TREES`` trees at
    a time. A forest's trees are drawn independently of each other, so groups
    of them, each from a seed of its own, are one forest of all the trees."""
    from vitrine import session

    trees, spark = est.getNumTrees(), train.sparkSession
    if trees <= FOREST_TREES or train.count() <= SPREAD_FROM:
        return est.fit(train)
    parts = []
    for i, first in enumerate(range(0, trees, FOREST_TREES)):
        # seeds far apart: Spark adds a task's number to them
        some = {est.numTrees: min(FOREST_TREES, trees - first), est.seed: est.getSeed() + 1_000_003 * i}
        parts.append(est.fit(train, some))
        session.release(spark)
    jvm = spark.sparkContext._jvm.org.apache.spark.ml.classification
    grown = [tree for part in parts for tree in part._java_obj.trees()]
    every = spark.sparkContext._gateway.new_array(jvm.DecisionTreeClassificationModel, len(grown))
    for i, tree in enumerate(grown):
        every[i] = tree
    forest = est._copyValues(RandomForestClassificationModel(
        jvm.RandomForestClassificationModel(parts[0].uid, every, parts[0].numFeatures, parts[0].numClasses)))
    forest._transfer_params_to_java()
    return forest


def spread(df: DataFrame, key: str) -> DataFrame:
    """A fit's input in tasks of even size. The splits lie in rank order, so
    that a range of ranks is all test rows or one class, and a task with most
    of the train rows keeps the others waiting at every level of every tree.
    As few tasks as the cores need, for a forest sends its nodes' statistics
    once per task, but no more than ``TASK_ROWS`` rows in one: the fit keeps
    them in memory, a forest with a count per tree."""
    rows = df.count()
    if rows <= SPREAD_FROM:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    # in key order, as the draws of a forest go by a row's place in its task
    return df.repartition(tasks).sortWithinPartitions(key)


def _prob(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


# ----------------------------------------------------------------- churn
def churn_data(t: RetailTables) -> DataFrame:
    """Encoded churn customers, split, nulls -> 0, with balanced weights and
    the boosting positive weight; checkpointed (it feeds three fits)."""
    return _cached(t, "churn_data", lambda: _kept(_churn_data(t), "customer_unique_id"))


def _kept(df: DataFrame, key: str) -> DataFrame:
    """A fit's input, stored; what it was derived through goes."""
    from vitrine import session

    out = checkpoint(spread(df, key))
    session.release(df.sparkSession)
    return out


def _churn_data(t: RetailTables) -> DataFrame:
    df = churn_split(t, ["customer_unique_id", "churned", *CHURN_FEATURES]).fillna(0, subset=CHURN_FEATURES)
    df = with_weights(df, "churned")
    tr = df.where(F.col("split") == "train")
    ratio = tr.agg((F.count_if(F.col("churned") == 0) / F.count_if(F.col("churned") == 1)).alias("_spw"))
    return (df.crossJoin(F.broadcast(ratio))
            .withColumn("pos_weight", F.when(F.col("churned") == 1, F.col("_spw")).otherwise(1.0)).drop("_spw"))


def _fit_churn(t: RetailTables, name: str) -> tuple[PipelineModel, DataFrame]:
    data = churn_data(t)
    p = CHURN_MODELS[name]
    if name == "logistic_regression":
        z = standardise_frame(data, CHURN_FEATURES, keep=("customer_unique_id", "churned", "weight"))
        train = z.where(F.col("split") == "train")
        # sklearn's C-penalised sum of weighted losses == Spark's mean loss
        # with regParam = 1 / (C * sum of weights), L2, no re-standardisation.
        wsum = train.agg(F.sum("weight")).first()[0]
        est = LogisticRegression(labelCol="churned", weightCol="weight", maxIter=p["max_iter"],
                                 regParam=1.0 / (p["C"] * wsum), elasticNetParam=0.0, standardization=False)
        source = z
    elif name == "random_forest":
        est = RandomForestClassifier(labelCol="churned", weightCol="weight", numTrees=p["num_trees"],
                                     maxDepth=p["max_depth"], featureSubsetStrategy="sqrt", seed=SEED,
                                     maxMemoryInMB=FOREST_MB)
        source = data
    else:
        est = GBTClassifier(labelCol="churned", weightCol="pos_weight", maxIter=p["max_iter"],
                            maxDepth=p["max_depth"], stepSize=p["step"], seed=SEED)
        source = data
    assembler = VectorAssembler(inputCols=CHURN_FEATURES, outputCol="features")
    train = source.where(F.col("split") == "train")
    if name == "random_forest":
        model = _reloaded(data.sparkSession, PipelineModel([assembler, grow_forest(est, assembler.transform(train))]))
    else:
        model = Pipeline(stages=[assembler, est]).fit(train)
    scored = (model.transform(source.where(F.col("split") == "test"))
              .select("customer_unique_id", "churned", _prob().alias("churn_probability"),
                      F.col("prediction").cast("int").alias("predicted_churned")))
    return model, scored


def fit_churn(t: RetailTables, name: str) -> tuple[PipelineModel, DataFrame]:
    return _cached(t, f"churn:{name}", lambda: _persisted_fit(t, f"churn:{name}", lambda: _fit_churn(t, name)))


def fit_together(t: RetailTables, *names: str) -> None:
    """The named fits side by side: a boosted model is hundreds of short jobs
    in a row, which leave most of the cores to the others."""
    from vitrine import session

    others, spark = {"clv": fit_clv, "delay": fit_delay}, t.orders.sparkSession

    def one(name: str) -> None:
        others[name](t) if name in others else fit_churn(t, name)
        session.release(spark)

    session.release(spark)  # of what the tables were derived through
    with ThreadPoolExecutor(len(names)) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), names))


def _churn_query(name: str):
    def q(t: RetailTables) -> DataFrame:
        scored = fit_churn(t, name)[1]
        return scored.select("customer_unique_id", "churned", rnd("churn_probability", 6).alias("churn_probability"),
                             "predicted_churned")
    q.__name__ = f"churn_model_{name}"
    q.__doc__ = f"ML10-12: test-set churn scores of the {name.replace('_', ' ')} model."
    return q


churn_model_logistic = _churn_query("logistic_regression")
churn_model_forest = _churn_query("random_forest")
churn_model_boosted = _churn_query("boosted_trees")


# --------------------------------------------------------------- metrics
def auc_exact(scored: DataFrame, label: str, score: str) -> DataFrame:
    """ML15: exact ROC-AUC = (R+ - n+(n+ + 1)/2) / (n+ n-), ties at mean rank."""
    rs = rank_sum(scored.withColumn("_id", F.monotonically_increasing_id()), score, F.col(label) == 1, ["_id"])
    return rs.select(_auc().alias("auc"))


def _auc():
    return (F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n2"))


def confusion(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """ML16: TN/FP/FN/TP and per-class precision, recall, F1 and support."""
    c = scored.agg(
        F.count_if((F.col(label) == 0) & (F.col(pred) == 0)).alias("tn"),
        F.count_if((F.col(label) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col(pred) == 0)).alias("fn"),
        F.count_if((F.col(label) == 1) & (F.col(pred) == 1)).alias("tp"))
    rows = []
    for cls, tp, fp, fn in ((1, "tp", "fp", "fn"), (0, "tn", "fn", "fp")):
        prec = F.col(tp) / F.when(F.col(tp) + F.col(fp) > 0, F.col(tp) + F.col(fp))
        rec = F.col(tp) / F.when(F.col(tp) + F.col(fn) > 0, F.col(tp) + F.col(fn))
        f1 = 2 * prec * rec / F.when(prec + rec > 0, prec + rec)
        rows.append(c.select(F.lit(cls).alias("label"), "tn", "fp", "fn", "tp",
                             F.coalesce(prec, F.lit(0.0)).alias("precision"), F.coalesce(rec, F.lit(0.0)).alias("recall"),
                             F.coalesce(f1, F.lit(0.0)).alias("f1"), (F.col(tp) + F.col(fn)).alias("support")))
    return reduce(DataFrame.unionByName, rows)


def roc_points(scored: DataFrame, label: str, score: str) -> DataFrame:
    """ML14: (threshold, fpr, tpr) at every distinct score, highest first,
    from a global running sum over distinct scores."""
    per = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    tot = per.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    cum = global_cumsum(per, [F.col("threshold").desc()], ["pos", "neg"])
    return cum.crossJoin(F.broadcast(tot)).select(
        "threshold", (F.col("cum_neg") / F.col("_n")).alias("fpr"), (F.col("cum_pos") / F.col("_p")).alias("tpr"))


def regression_metrics(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """ML21: MAE, RMSE and R² (1 - SSE / SST) in one aggregate pass."""
    mean = scored.agg(F.avg(label).alias("_mu"))
    e = F.col(label) - F.col(pred)
    return scored.crossJoin(F.broadcast(mean)).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.sum((F.col(label) - F.col("_mu")) ** 2)).alias("r2"))


def _comparison(t: RetailTables) -> DataFrame:
    fit_together(t, *CHURN_MODELS)
    parts = []
    for name in CHURN_MODELS:
        scored = fit_churn(t, name)[1]
        auc = auc_exact(scored, "churned", "churn_probability")
        rep = confusion(scored, "churned", "predicted_churned").where(F.col("label") == 1)
        parts.append(auc.crossJoin(rep).select(F.lit(name).alias("model"), "auc", "precision", "recall", "f1"))
    allm = reduce(DataFrame.unionByName, parts)
    best = allm.agg(F.max_by("model", F.struct("auc", F.col("model"))).alias("_best"))
    return allm.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")


def model_comparison(t: RetailTables) -> DataFrame:
    """ML13: AUC, precision, recall and F1 (churned class) per churn model;
    the best by AUC is flagged."""
    c = _comparison(t)
    return c.select("model", *[rnd(x, 6).alias(x) for x in ("auc", "precision", "recall", "f1")], "is_best")


def best_churn(t: RetailTables) -> str:
    return _cached(t, "best_churn", lambda: _comparison(t).where("is_best").first()["model"])


def roc_curve(t: RetailTables) -> DataFrame:
    """ML14: ROC points of every churn model."""
    fit_together(t, *CHURN_MODELS)
    return reduce(DataFrame.unionByName, [
        roc_points(fit_churn(t, n)[1], "churned", "churn_probability").select(
            F.lit(n).alias("model"), rnd("threshold", 6).alias("threshold"), rnd("fpr", 6).alias("fpr"),
            rnd("tpr", 6).alias("tpr"))
        for n in CHURN_MODELS])


def auc_rank(t: RetailTables) -> DataFrame:
    """ML15: exact AUC of every churn model and of the delay model."""
    fit_together(t, *CHURN_MODELS, "delay")
    parts = [auc_exact(fit_churn(t, n)[1], "churned", "churn_probability").select(F.lit(n).alias("model"), "auc")
             for n in CHURN_MODELS]
    parts.append(auc_exact(fit_delay(t)[1], "is_delayed", "delay_probability")
                 .select(F.lit("delay_random_forest").alias("model"), "auc"))
    return reduce(DataFrame.unionByName, parts).select("model", rnd("auc", 6).alias("auc"))


def confusion_report(t: RetailTables) -> DataFrame:
    """ML16: confusion counts and per-class report of the best churn model."""
    name = best_churn(t)
    rep = confusion(fit_churn(t, name)[1], "churned", "predicted_churned")
    return rep.select(F.lit(name).alias("model"), "label", "tn", "fp", "fn", "tp",
                      *[rnd(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


# ------------------------------------------------------------------- CLV
def clv_data(t: RetailTables) -> DataFrame:
    """Encoded CLV customers with their split, nulls -> 0; checkpointed."""
    return _cached(t, "clv_data", lambda: _kept(
        split_random(clv_table(t).select("customer_unique_id", "future_spend", *CLV_FEATURES)).fillna(0, subset=CLV_FEATURES),
        "customer_unique_id"))


def _fit_clv(t: RetailTables) -> tuple[PipelineModel, DataFrame]:
    data = clv_data(t)
    p = CLV_PARAMS
    est = GBTRegressor(labelCol="future_spend", maxIter=p["max_iter"], maxDepth=p["max_depth"], stepSize=p["step"],
                       subsamplingRate=p["subsample"], seed=SEED)
    model = Pipeline(stages=[VectorAssembler(inputCols=CLV_FEATURES, outputCol="features"), est]).fit(
        data.where(F.col("split") == "train"))
    scored = model.transform(data).select(
        "customer_unique_id", "split", "future_spend", "total_spend_early",
        F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted_clv"))
    return model, scored


def fit_clv(t: RetailTables):
    return _cached(t, "clv", lambda: _persisted_fit(t, "clv", lambda: _fit_clv(t)))


def clv_model(t: RetailTables) -> DataFrame:
    """ML20: predicted CLV (clipped at 0) of every customer, with its split."""
    s = fit_clv(t)[1]
    return s.select("customer_unique_id", "split", rnd("future_spend", 2).alias("future_spend"),
                    rnd("predicted_clv", 4).alias("predicted_clv"))


def regression_report(t: RetailTables) -> DataFrame:
    """ML21: MAE, RMSE, R² of the CLV model on the test split."""
    m = regression_metrics(fit_clv(t)[1].where(F.col("split") == "test"), "future_spend", "predicted_clv")
    return m.select(*[rnd(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


# Fixed tier labels and strategies of the workload.
CLV_TIERS = [("Low CLV", "Discount offers, re-engagement campaigns, survey for churn reasons"),
             ("Medium CLV", "Loyalty points, personalized recommendations, category bundles"),
             ("High CLV", "VIP program, early access to new products, exclusive offers")]


def tiers(scored: DataFrame) -> DataFrame:
    """ML22: the tier of every row by its ``predicted_clv``."""
    edges = quantile_edges(scored, "predicted_clv", [0.25, 0.75], ["customer_unique_id"])
    x = F.col("predicted_clv")
    tier = (F.when(x <= F.col("edges")[0], CLV_TIERS[0][0]).when(x <= F.col("edges")[1], CLV_TIERS[1][0])
            .otherwise(CLV_TIERS[2][0]))
    return scored.crossJoin(F.broadcast(edges)).withColumn("clv_tier", tier).drop("edges")


def tier_summary(tiered: DataFrame) -> DataFrame:
    """ML23: customers, average and total predicted CLV, average historical
    spend and the recommended strategy per tier."""
    strat = tiered.sparkSession.createDataFrame(CLV_TIERS, "clv_tier string, recommended_strategy string")
    g = tiered.groupBy("clv_tier").agg(
        F.count(F.lit(1)).alias("customers"), rnd(F.avg("predicted_clv"), 2).alias("avg_predicted_clv"),
        rnd(F.sum("predicted_clv"), 2).alias("total_predicted"),
        rnd(F.avg("total_spend_early"), 2).alias("avg_historical_spend"))
    return g.join(F.broadcast(strat), "clv_tier", "left")


def clv_tiers(t: RetailTables) -> DataFrame:
    """ML22: Low / Medium / High CLV at the 25% and 75% quantiles."""
    return tiers(fit_clv(t)[1]).select("customer_unique_id", rnd("predicted_clv", 4).alias("predicted_clv"), "clv_tier")


def clv_tier_summary(t: RetailTables) -> DataFrame:
    """ML23: the tier table of the fitted CLV model."""
    return tier_summary(tiers(fit_clv(t)[1]))


# ----------------------------------------------------------------- delay
def delay_data(t: RetailTables) -> DataFrame:
    """The delay table with its split and balanced weights; checkpointed."""
    return _cached(t, "delay_data", lambda: _kept(with_weights(
        split_stratified(delay_table(t).select("order_id", "is_delayed", *DELAY_FEATURES), label="is_delayed", key="order_id"),
        "is_delayed"), "order_id"))


def _fit_delay(t: RetailTables) -> tuple[PipelineModel, DataFrame]:
    data = delay_data(t)
    p = DELAY_PARAMS
    est = RandomForestClassifier(labelCol="is_delayed", weightCol="weight", numTrees=p["num_trees"],
                                 maxDepth=p["max_depth"], featureSubsetStrategy="sqrt", seed=SEED,
                                 maxMemoryInMB=FOREST_MB)
    assembler = VectorAssembler(inputCols=DELAY_FEATURES, outputCol="features")
    train = assembler.transform(data.where(F.col("split") == "train"))
    model = _reloaded(data.sparkSession, PipelineModel([assembler, grow_forest(est, train)]))
    scored = model.transform(data).select(
        "order_id", "split", "is_delayed", _prob().alias("delay_probability"),
        F.col("prediction").cast("int").alias("predicted_delayed"))
    return model, scored


def fit_delay(t: RetailTables):
    return _cached(t, "delay", lambda: _persisted_fit(t, "delay", lambda: _fit_delay(t)))


def delay_model(t: RetailTables) -> DataFrame:
    """ML25: delay probability of every test order from the balanced forest."""
    s = fit_delay(t)[1].where(F.col("split") == "test")
    return s.select("order_id", "is_delayed", rnd("delay_probability", 6).alias("delay_probability"),
                    "predicted_delayed")


def score_risk_flags(t: RetailTables, churn_share: float = 0.10, delay_cut: float = 0.7) -> DataFrame:
    """ML26: the batch scoring job: the top ``churn_share`` of customers by
    churn probability (best model, all customers) and the orders whose delay
    probability exceeds ``delay_cut``."""
    fit_together(t, *CHURN_MODELS, "delay")
    name = best_churn(t)
    model = fit_churn(t, name)[0]
    data = churn_data(t)
    if name == "logistic_regression":
        data = standardise_frame(data, CHURN_FEATURES, keep=("customer_unique_id", "churned", "weight"))
    scored = model.transform(data).select("customer_unique_id", _prob().alias("p"))
    ranked = global_rank(scored, [F.col("p").desc(), F.col("customer_unique_id")], "_r", count_col="_n")
    churn = ranked.select(F.lit("customer").alias("entity"), F.col("customer_unique_id").alias("entity_id"),
                          rnd("p", 6).alias("probability"),
                          (F.col("_r") <= F.ceil(F.col("_n") * churn_share)).alias("flagged"))
    delay = fit_delay(t)[1].select(F.lit("order").alias("entity"), F.col("order_id").alias("entity_id"),
                                   rnd("delay_probability", 6).alias("probability"),
                                   (F.col("delay_probability") > delay_cut).alias("flagged"))
    return churn.unionByName(delay)


# ------------------------------------------------------------ importance
def permutation_importance(model: PipelineModel, data: DataFrame, features: list[str], label: str,
                           key: str, metric: str = "auc") -> DataFrame:
    """ML27: drop in AUC (or rise in MAE) when one feature's column is
    permuted across rows. The permutation is a deterministic rank shift (row r
    takes the value of row r + n/2 in a hash order).

    One job for all features: each row meets its donor once, is repeated per
    feature with that feature's value replaced (``_v`` = the feature's place,
    -1 = unchanged), and is scored in the same pass; the metric of every
    variant comes from one aggregate or one global rank of thin rows."""
    ranked = checkpoint(global_rank(data.withColumn("_h", F.xxhash64(F.col(key), F.lit(SEED))),
                                    [F.col("_h"), F.col(key)], "_r", count_col="_n").select(key, label, *features, "_r", "_n"))
    donor = ranked.select(((F.col("_r") - 1 + F.floor(F.col("_n") / 2)) % F.col("_n") + 1).alias("_r"),
                          F.struct(*features).alias("_donor"))
    variants = ranked.join(donor, "_r").withColumn("_v", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = variants.select(key, label, "_v", *[
        F.when(F.col("_v") == i, F.col("_donor")[f]).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)])
    out = model.transform(swapped)
    if metric == "auc":
        rs = rank_sum(out.select("_v", label, key, _prob().alias("_s")), "_s", F.col(label) == 1, [key], by=["_v"])
        per = rs.select("_v", _auc().alias("v"))
    else:
        per = out.groupBy("_v").agg(F.avg(F.abs(F.col(label) - F.greatest(F.col("prediction"), F.lit(0.0)))).alias("v"))
    # One row per feature and one for the unchanged rows: a bounded window.
    base = F.max(F.when(F.col("_v") == -1, F.col("v"))).over(Window.partitionBy(F.lit(1)))
    sign = 1.0 if metric == "auc" else -1.0
    return (per.withColumn("_base", base).where(F.col("_v") >= 0)
            .select(F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_v") + 1).alias("feature"),
                    (sign * (F.col("_base") - F.col("v"))).alias("importance")))


def feature_importance(t: RetailTables) -> DataFrame:
    """ML27: permutation importance of the three models side by side (churn
    on the test split, CLV by MAE, delay on the test split), plus the
    trees' own impurity importance where the model has one."""
    from vitrine import session

    fit_together(t, *CHURN_MODELS, "clv", "delay")
    out = []

    def add(model: str, importance: DataFrame) -> None:
        # a row per feature; the ranked variants behind it go before the next model's are made
        out.append(checkpoint(importance.withColumn("model", F.lit(model))))
        session.release(t.orders.sparkSession)

    name = best_churn(t)
    cm = fit_churn(t, name)[0]
    cdata = churn_data(t).where(F.col("split") == "test")
    if name == "logistic_regression":
        cdata = standardise_frame(churn_data(t), CHURN_FEATURES,
                                  keep=("customer_unique_id", "churned", "weight")).where(F.col("split") == "test")
    add(f"churn:{name}", permutation_importance(cm, cdata, CHURN_FEATURES, "churned", "customer_unique_id"))
    clvm = fit_clv(t)[0]
    cl = clv_data(t).where(F.col("split") == "test")
    add("clv:boosted_trees",
        permutation_importance(clvm, cl, CLV_FEATURES, "future_spend", "customer_unique_id", metric="mae"))
    dm = fit_delay(t)[0]
    dd = delay_data(t).where(F.col("split") == "test")
    add("delay:random_forest", permutation_importance(dm, dd, DELAY_FEATURES, "is_delayed", "order_id"))
    perm = reduce(DataFrame.unionByName, out)
    spark = t.orders.sparkSession
    impurity = []
    for mname, m, feats in ((f"churn:{name}", cm, CHURN_FEATURES), ("clv:boosted_trees", clvm, CLV_FEATURES),
                            ("delay:random_forest", dm, DELAY_FEATURES)):
        last = m.stages[-1]
        if hasattr(last, "featureImportances"):
            imp = last.featureImportances.toArray().tolist()
            impurity += [(mname, f, float(v)) for f, v in zip(feats, imp)]
    imp_df = spark.createDataFrame(impurity, "model string, feature string, impurity_importance double")
    return perm.join(imp_df, ["model", "feature"], "left").select(
        "model", "feature", rnd("importance", 6).alias("permutation_importance"),
        rnd("impurity_importance", 6).alias("impurity_importance"))


# ------------------------------------------- the metrics on a plain scorecard
def churn_scorecard(t: RetailTables) -> DataFrame:
    """A model-free churn score of the test customers, as a yardstick for the
    fitted models: ten points off per order and one per item. A customer is
    predicted to churn at or above the mean score of the train customers."""
    df = churn_split(t).select(
        "customer_unique_id", "churned", "split",
        (1000 - 10 * F.col("frequency").cast("long") - F.col("n_items_total").cast("long")).alias("score"))
    df = checkpoint(df)
    cut = df.where(F.col("split") == "train").agg(F.avg("score").alias("_cut"))
    return (df.where(F.col("split") == "test").crossJoin(F.broadcast(cut))
            .select("customer_unique_id", "churned", "score", (F.col("score") >= F.col("_cut")).cast("int").alias("predicted")))


def scorecard_roc_curve(t: RetailTables) -> DataFrame:
    """ML14: ROC points of the scorecard, one per distinct score."""
    return roc_points(churn_scorecard(t), "churned", "score").select(
        "threshold", rnd("fpr", 6).alias("fpr"), rnd("tpr", 6).alias("tpr"))


def scorecard_auc(t: RetailTables) -> DataFrame:
    """ML15: exact AUC of the scorecard, ties at mean rank."""
    return auc_exact(churn_scorecard(t), "churned", "score").select(rnd("auc", 6).alias("auc"))


def scorecard_confusion(t: RetailTables) -> DataFrame:
    """ML16: confusion counts and per-class report of the scorecard."""
    return confusion(churn_scorecard(t), "churned", "predicted").select(
        "label", "tn", "fp", "fn", "tp", *[rnd(x, 6).alias(x) for x in ("precision", "recall", "f1")], "support")


def clv_baseline(t: RetailTables) -> DataFrame:
    """The naive CLV forecast in whole cents: the late half repeats the early one."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("double")
    return split_random(checkpoint(_clv_plain(t).select(
        "customer_unique_id", cents("future_spend").alias("future_spend"), cents("total_spend_early").alias("predicted_clv"),
        cents("total_spend_early").alias("total_spend_early"))))


def baseline_regression_report(t: RetailTables) -> DataFrame:
    """ML21: MAE, RMSE (cents) and R² of the naive forecast on the test split."""
    m = regression_metrics(clv_baseline(t).where(F.col("split") == "test"), "future_spend", "predicted_clv")
    return m.select(*[rnd(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


def baseline_clv_tiers(t: RetailTables) -> DataFrame:
    """ML22: tiers of the naive forecast (cents)."""
    return tiers(clv_baseline(t)).select("customer_unique_id", "predicted_clv", "clv_tier")


def baseline_clv_tier_summary(t: RetailTables) -> DataFrame:
    """ML23: the tier table of the naive forecast (cents)."""
    return tier_summary(tiers(clv_baseline(t)))
