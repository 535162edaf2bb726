"""Leakage-safe model evaluation on `pyspark.ml`. Folds and arms are few by design; every fit is a distributed job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.operators import aggregates as a
from echogrid.operators import ordered as o
from echogrid.session import materialize


def fold_of(group: Column, folds: int) -> Column:
    """Fold number from a hash of the group: one group never spans folds."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights n / (classes * n_class), from one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k")).withColumn("__one", F.lit(1))
    w = counts.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(F.broadcast(w), label)  # one row per class: no shuffle of all rows onto few labels


def fit_logistic(train: DataFrame, features: str, label: str, reg: float = 1.0):
    n = train.count()
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", regParam=reg / max(n, 1), maxIter=50)
    steps = [StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True), lr]
    return Pipeline(stages=steps).fit(balanced_weights(train, label))


def out_of_fold(df: DataFrame, features: str, label: str, fold: str, folds: Sequence[int]) -> DataFrame:
    """Predictions of models that never saw the row's fold."""
    parts = []
    for k in folds:
        model = fit_logistic(df.filter(F.col(fold) != k), features, label)
        parts.append(model.transform(df.filter(F.col(fold) == k)).drop("scaled", "rawPrediction", "weight"))
    return o.union_all(parts)


def group_probe(df: DataFrame, features: str, label: str, group: str, folds: int = 3) -> DataFrame:
    """How well features give away `label` across unseen groups: recall per class and balanced accuracy."""
    oof = out_of_fold(df.withColumn("__fold", fold_of(F.col(group), folds)), features, label, "__fold", range(folds))
    per = oof.groupBy(label).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("recall"))
    return per.withColumn("balanced_accuracy", F.avg("recall").over(Window.partitionBy(F.lit(0))))  # one row per class


def score_arms(rows: DataFrame, arms: DataFrame, row_id: str, features: str, label: str) -> DataFrame:
    """Fit on the training rows of every arm and replicate and score its test files.

    A file's score is the mean over its rows. Per arm and replicate: AUROC, AP, sizes, the smallest readable AUROC step, and the
    balanced accuracy at one half and at the best threshold. Arms and replicates are few by design; a pair whose training rows show
    one class only has no scores and keeps its row with nulls.
    """
    units = arms.select("arm", "replicate").distinct().orderBy("arm", "replicate")
    out = []
    for u in units.collect():
        side = lambda s: rows.join(arms.filter((F.col("arm") == u["arm"]) & (F.col("replicate") == u["replicate"]) & (F.col("side") == s)).select(row_id), row_id)  # noqa: B023
        train = side("train")
        if train.select(label).distinct().count() < 2:
            continue
        scored = fit_logistic(train, features, label).transform(side("test")).select(row_id, vector_to_array("probability")[1].alias("score"), F.col(label).cast("int").alias("y"))
        # written here: a union of these joins has equal partitioning, and one of its tasks would read a part of every join
        means = materialize(scored.groupBy(row_id).agg(F.avg("score").alias("score"), F.max("y").alias("y")))
        out.append(means.select(F.lit(u["arm"]).alias("arm"), F.lit(u["replicate"]).alias("replicate"), *means.columns))
    if not out:
        empty = ", ".join(f"{c} {k}" for c, k in (("positives", "long"), ("negatives", "long"), ("auroc", "double"), ("ap", "double"), ("auc_granularity", "double"), ("balanced_accuracy", "double"), ("best_balanced_accuracy", "double")))
        return units.join(rows.sparkSession.createDataFrame([], f"arm string, replicate int, {empty}"), ["arm", "replicate"], "left")
    keys = ["arm", "replicate"]
    files = materialize(o.union_all(out).repartition(*keys, row_id))
    auc = a.auroc_ap(files, keys, "score", "y").withColumn("auc_granularity", 1.0 / F.greatest(F.col("positives") * F.col("negatives"), F.lit(1)))
    rate = lambda y: F.avg(F.when(F.col("y") == y, ((F.col("score") >= 0.5).cast("int") == y).cast("double")))
    plain = files.groupBy(*keys).agg(((rate(1) + rate(0)) / 2).alias("balanced_accuracy"))
    best = a.oracle_threshold(files, keys, "score", "y").select(*keys, F.col("balanced_accuracy").alias("best_balanced_accuracy"))
    return units.join(auc, keys, "left").join(plain, keys, "left").join(best, keys, "left")


def block_pca_design(df: DataFrame, blocks: dict[str, str], k: int) -> DataFrame:
    """Each feature block reduced to k components, then concatenated to `design`."""
    stages = []
    for name, column in blocks.items():
        stages += [StandardScaler(inputCol=column, outputCol=f"__s_{name}", withMean=True), PCA(k=k, inputCol=f"__s_{name}", outputCol=f"__p_{name}")]
    stages.append(VectorAssembler(inputCols=[f"__p_{n}" for n in blocks], outputCol="design"))
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.drop(*[f"__s_{n}" for n in blocks], *[f"__p_{n}" for n in blocks])


def pair_fusion(df: DataFrame, first: str, second: str, label: str, group: str, k: int = 4, folds: int = 3) -> DataFrame:
    """Two feature branches scored separately, averaged and concatenated, out of fold: accuracy per variant."""
    base = df.withColumn("__fold", fold_of(F.col(group), folds))
    parts = []
    for fold in range(folds):
        train, test = base.filter(F.col("__fold") != fold), base.filter(F.col("__fold") == fold)
        preds = None
        for name, column in (("a", first), ("b", second)):
            pca = Pipeline(stages=[StandardScaler(inputCol=column, outputCol="__s", withMean=True), PCA(k=k, inputCol="__s", outputCol=f"__{name}")]).fit(train)
            train, test = pca.transform(train).drop("__s"), pca.transform(test).drop("__s")
            p = fit_logistic(train, f"__{name}", label).transform(test).select("row_id", vector_to_array("probability")[1].alias(f"p_{name}"))
            preds = p if preds is None else preds.join(p, "row_id")
        joint = VectorAssembler(inputCols=["__a", "__b"], outputCol="__ab")
        c = fit_logistic(joint.transform(train), "__ab", label).transform(joint.transform(test)).select("row_id", label, vector_to_array("probability")[1].alias("p_concat"))
        parts.append(preds.join(c, "row_id"))
    oof = o.union_all(parts).withColumn("p_avg", (F.col("p_a") + F.col("p_b")) / 2)
    right = lambda p: F.avg(((F.col(p) >= 0.5).cast("int") == F.col(label)).cast("double"))
    return oof.agg(F.count("*").alias("n"), *[right(f"p_{m}").alias(f"accuracy_{m}") for m in ("a", "b", "avg", "concat")])


def separability(df: DataFrame, features: str, label: str, group: str, k: int = 5, folds: int = 3) -> DataFrame:
    """PCA embedding, silhouette (squared Euclidean, linear time), grouped against naive folds and explained variance."""
    pca = PCA(k=k, inputCol=features, outputCol="embedded").fit(df)
    emb = pca.transform(df).withColumn("prediction", F.col(label).cast("double"))
    silhouette = ClusteringEvaluator(featuresCol="embedded", predictionCol="prediction").evaluate(emb)
    emb = emb.drop("prediction")
    scores = {}
    for name, key in (("grouped", F.col(group)), ("naive", F.col("row_id"))):
        oof = out_of_fold(emb.withColumn("__fold", fold_of(key, folds)), "embedded", label, "__fold", range(folds))
        scores[name] = oof.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("r")).agg(F.avg("r").alias(f"{name}_balanced_accuracy"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    out = one(scores["grouped"]).join(one(scores["naive"]), "__one").join(one(df.agg((1.0 / F.countDistinct(label)).alias("chance"))), "__one").drop("__one")
    return out.withColumns({"silhouette": F.lit(float(silhouette)), "explained_variance": F.lit(float(sum(pca.explainedVariance))),
                            "leak_gap": F.col("naive_balanced_accuracy") - F.col("grouped_balanced_accuracy")})


def as_vector(df: DataFrame, values: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(values))
