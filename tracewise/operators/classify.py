"""Source classification from fingerprints (F8–F13, F15) with Spark ML.

The reference standardises the 24 fingerprint features and trains a random
forest (100 trees, depth 20, seed 42) on a stratified 80/20 split with 5-fold
cross-validation.  The same pipeline here is ``StringIndexer`` (labels
sorted by name, F8) + ``VectorAssembler`` + ``StandardScaler`` +
``Forest`` (the same learner as Spark's random forest, its trees kept by the
executors); the split is the portable hash split of S2.
Spark's scaler divides by the sample standard deviation where the reference
uses the population one; a per-feature constant factor does not change a
tree model.  Results are quality numbers, not bit-parity (rows-only check).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small, r6, safe_div
from tracewise.operators.fingerprint import FEATURE_NAMES
from tracewise.operators.forest import Forest
from tracewise.operators.split import assign_splits


def pipeline(num_trees: int = 100, max_depth: int = 20, seed: int = 42) -> Pipeline:
    """F8 + F9 estimator."""
    return Pipeline(stages=[
        StringIndexer(inputCol="label_name", outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=FEATURE_NAMES, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        Forest(featuresCol="features", labelCol="label", numTrees=num_trees, maxDepth=max_depth, seed=seed),
    ])


def train_test(fp: DataFrame, label_col: str, id_col: str = "chain_id", seed: int = 42):
    """Stratified 80/20 split by label (hash order, S2).  The feature table is
    materialised once: fitting reads its input several times (indexer,
    scaler, split finding, bagging) and would otherwise recompute the
    fingerprints on every pass."""
    from tracewise.session import cut_lineage

    data = fp.withColumn("label_name", F.col(label_col)).fillna(0.0, subset=FEATURE_NAMES)
    s = cut_lineage(assign_splits(data, ["label_name"], id_col=id_col, train=0.8, val=0.0, test=0.2, seed=seed))
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


def fit(train: DataFrame, cv_folds: int = 0, **kw) -> PipelineModel:
    """fit; with ``cv_folds`` > 1 a CrossValidator reports mean accuracy
    (``model.avgMetrics``) and refits on all training rows."""
    p = pipeline(**kw)
    # the indexer, the scaler and the forest pass over the rows several times: no more partitions than tasks that run at a time
    train = train.coalesce(max(1, train.sparkSession.sparkContext.defaultParallelism))
    if cv_folds and cv_folds > 1:
        ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        cv = CrossValidator(estimator=p, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                            numFolds=cv_folds, seed=kw.get("seed", 42))  # one after another: each fit fills the cluster
        return cv.fit(train)
    return p.fit(train)


def predict(model, df: DataFrame, id_col: str = "chain_id") -> DataFrame:
    """predicted class name and its probability."""
    pm = model.bestModel if hasattr(model, "bestModel") else model
    labels = pm.stages[0].labels
    out = pm.transform(df)
    names = F.array(*[F.lit(x) for x in labels])
    return out.select(id_col, "label_name", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
                      r6(F.array_max(vector_to_array("probability"))).alias("confidence"), "probability")


def multiclass_metrics(pred: DataFrame) -> DataFrame:
    """per class precision / recall / F1 / support plus accuracy and
    macro / weighted averages (class = 'accuracy' / 'macro avg' /
    'weighted avg' rows), from one confusion-count aggregate."""
    from tracewise.session import cut_lineage

    # every row below reads these counts: predicted once, not once a use
    cm = cut_lineage(pred.groupBy("label_name", "predicted").agg(F.count(F.lit(1)).alias("n")))
    tp = cm.filter(F.col("label_name") == F.col("predicted")).select(F.col("label_name").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("label_name").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted_n"))
    per = (sup.join(prd, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted_n"]))
    p = safe_div("tp", "predicted_n")
    r = safe_div("tp", "support")
    per = per.select("cls", r6(p).alias("precision"), r6(r).alias("recall"), r6(safe_div(2 * p * r, p + r)).alias("f1"),
                     F.col("support").cast("long").alias("support"), F.col("tp"))
    w = Window.partitionBy()
    tot = F.sum("support").over(w)
    per = per.withColumn("_tot", tot).withColumn("_tp", F.sum("tp").over(w))
    acc = per.groupBy().agg(r6(F.first("_tp") / F.first("_tot")).alias("precision"), F.first("_tot").alias("support"))
    macro = per.agg(r6(F.avg("precision")).alias("precision"), r6(F.avg("recall")).alias("recall"), r6(F.avg("f1")).alias("f1"),
                    F.sum("support").alias("support"))
    weighted = per.agg(r6(F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                       r6(F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                       r6(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    return (per.select("cls", "precision", "recall", "f1", "support")
            .unionByName(acc.select(F.lit("accuracy").alias("cls"), "precision", F.col("precision").alias("recall"),
                                    F.col("precision").alias("f1"), F.col("support").cast("long")))
            .unionByName(macro.select(F.lit("macro avg").alias("cls"), "precision", "recall", "f1", F.col("support").cast("long")))
            .unionByName(weighted.select(F.lit("weighted avg").alias("cls"), "precision", "recall", "f1",
                                         F.col("support").cast("long"))))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """(true class, predicted class, count)."""
    return pred.groupBy("label_name", "predicted").agg(F.count(F.lit(1)).alias("n"))


def feature_importance(model, top: int = 10) -> DataFrame:
    """(feature, importance) sorted, top ``top`` – a small table built
    from the fitted model (24 numbers)."""
    pm = model.bestModel if hasattr(model, "bestModel") else model
    imp = pm.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(FEATURE_NAMES, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(model, path: str) -> None:
    """F13."""
    pm = model.bestModel if hasattr(model, "bestModel") else model
    pm.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """F13."""
    return PipelineModel.load(path)


def verdict(pred: DataFrame, labels: list[str], mapping: DataFrame, id_col: str = "chain_id") -> DataFrame:
    """per row, mapped classes with probability rounded to 2 places,
    sorted descending; the first is the verdict, 'Unknown' when no class is
    mapped.  mapping: (label_name, display) – small, broadcast."""
    from tracewise.session import cut_lineage

    pred = cut_lineage(pred.select(id_col, "probability"))  # read twice, predicted once
    probs = pred.select(id_col, F.posexplode(vector_to_array("probability")).alias("i", "p"))
    names = F.array(*[F.lit(x) for x in labels])
    probs = probs.withColumn("label_name", F.element_at(names, F.col("i") + 1))
    j = probs.join(broadcast_if_small(mapping), "label_name").withColumn("score", F.round("p", 2))
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("i"))
    top = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select(id_col, F.col("display").alias("verdict"))
    return pred.select(id_col).distinct().join(top, id_col, "left").select(
        id_col, F.coalesce("verdict", F.lit("Unknown")).alias("verdict"))
