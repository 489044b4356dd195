"""Regression, clustering and attribution on top of pyspark.ml."""

from __future__ import annotations

import functools
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import scores
from .order import cut, numbered

#: Estimators by name. Ridge needs alpha * stddev_pop(y) / n, see ridge().
MODELS = {
    "LR": lambda: LinearRegression(regParam=0.0, solver="normal"),
    "Lasso": lambda: LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False),
    "RF": lambda: RandomForestRegressor(numTrees=200, maxDepth=10, featureSubsetStrategy="sqrt", seed=42, maxMemoryInMB=1024),
    "GBM": lambda: GBTRegressor(maxIter=200, maxDepth=3, seed=42),
    "Additive": lambda: GBTRegressor(maxIter=30, maxDepth=1, seed=42),
}


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def ridge(df: DataFrame, y: str = "y", alpha: float = 1.0) -> LinearRegression:
    """The estimator whose penalty equals alpha in sum of squares + alpha * |w|^2."""
    n, s = df.agg(F.count(y), F.stddev_pop(y)).first()
    return LinearRegression(elasticNetParam=0.0, standardization=False, regParam=alpha * (s or 0.0) / max(n, 1))


def fit_predict(df: DataFrame, cols: list[str], model: str, y: str = "y", fold: str = "fold", folds: int = 7) -> DataFrame:
    """Out-of-fold predictions p of each row, the scaler fitted on the training folds. model:
    a name of MODELS, or Ridge."""
    a = assembled(df, cols).persist()
    try:

        def fit(k: int):
            train = a.where(F.col(fold) != k)
            est = (ridge(train, y) if model == "Ridge" else MODELS[model]()).setLabelCol(y).setFeaturesCol("scaled").setPredictionCol("p")
            return Pipeline(stages=[StandardScaler(withMean=True, inputCol="features", outputCol="scaled"), est]).fit(train)

        with ThreadPoolExecutor(min(folds, 4)) as pool:  # small jobs of several folds side by side
            fitted = list(pool.map(fit, range(folds)))
    finally:
        a.unpersist()
    parts = [m.transform(assembled(df, cols).where(F.col(fold) == k)).drop("features", "scaled") for k, m in enumerate(fitted)]
    return functools.reduce(DataFrame.unionByName, parts)


def degree2(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns, their squares and products."""
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]})


def standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns scaled by mean and population std."""
    one = df.agg(*[F.avg(c).alias(f"_a{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s{c}") for c in cols])
    j = df.join(F.broadcast(one))
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"_a{c}"), F.col(f"_s{c}")) for c in cols}).select(df.columns)


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.min(c).alias(f"_a{c}") for c in cols], *[F.max(c).alias(f"_b{c}") for c in cols])
    j = df.join(F.broadcast(one))
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(f"_a{c}")) for c in cols}).select(df.columns)


def global_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns divided by the single greatest value."""
    one = df.agg(F.max(F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])).alias("_m"))
    return df.join(F.broadcast(one)).withColumns({c: F.try_divide(c, "_m") for c in cols}).select(df.columns)


def linear_attribution(df: DataFrame, cols: list[str], y: str = "y", key: str = "row_id") -> DataFrame:
    """key, feature, value: coefficient times the distance from the mean; exact for linear
    models."""
    m = MODELS["LR"]().setLabelCol(y).fit(assembled(df, cols))
    means = df.agg(*[F.avg(c).alias(f"_a{c}") for c in cols])
    j = df.join(F.broadcast(means))
    parts = [((F.col(c) - F.col(f"_a{c}")) * float(w)).alias(c) for c, w in zip(cols, m.coefficients)]
    return j.select(key, *parts).unpivot(key, cols, "feature", "value")


def fold_attribution(df: DataFrame, cols: list[str], y: str = "y", key: str = "row_id", fold: str = "fold", folds: int = 3) -> DataFrame:
    """linear_attribution() by the model of each fold's training rows, averaged over the folds."""
    out = None
    for k in range(folds):
        train = df.where(F.col(fold) != k)
        m = MODELS["LR"]().setLabelCol(y).fit(assembled(train, cols))
        mean = train.agg(*[F.avg(c) for c in cols]).first()
        part = df.select(key, *[((F.col(c) - float(a)) * float(w)).alias(c) for c, a, w in zip(cols, mean, m.coefficients)]).unpivot(key, cols, "feature", "value")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "feature").agg(F.avg("value").alias("value"))


def ridge_choice(df: DataFrame, cols: list[str], y: str = "y", alphas: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0)) -> DataFrame:
    """feature, alpha, importance: absolute coefficients of the ridge whose alpha does best in
    three folds."""
    a = assembled(df, cols)
    n, s = df.agg(F.count(y), F.stddev_pop(y)).first()
    lr = LinearRegression(labelCol=y, elasticNetParam=0.0, standardization=False)
    grid = ParamGridBuilder().addGrid(lr.regParam, [x * (s or 0.0) / max(n, 1) for x in alphas]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=y, metricName="mse"), numFolds=3, parallelism=2, seed=42).fit(a)
    best = alphas[min(range(len(alphas)), key=cv.avgMetrics.__getitem__)]
    return df.sparkSession.createDataFrame([(c, best, abs(float(w))) for c, w in zip(cols, cv.bestModel.coefficients)], "feature string, alpha double, importance double")


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def sampled_attribution(df: DataFrame, model, cols: list[str], background: DataFrame, key: str = "row_id", orders: int = 2, seed: int = 42) -> DataFrame:
    """key, feature, value: sampled Shapley values. Each row meets a few background rows
    under random feature orders; coalition rows go through the model once, and the step that
    a feature makes is averaged. background: at most 64 rows."""
    b = background.limit(64).select(F.array(*cols).alias("bg"), F.monotonically_increasing_id().alias("bid"))
    x = df.select(key, F.array(*cols).alias("x")).withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(orders))))
    x = x.join(F.broadcast(b))
    feats = F.array(*[F.lit(i) for i in range(len(cols))])
    perm = F.transform(F.array_sort(F.transform(feats, lambda i: F.struct(F.xxhash64(F.lit(seed), "o", "bid", key, i).alias("h"), i.alias("i")))), lambda s: s.i)
    x = x.withColumn("perm", perm).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(cols)))))
    held = F.slice("perm", 1, F.col("k"))
    x = x.select(key, "o", "bid", "k", "perm", *[F.when(F.array_contains(held, F.lit(i)), F.get("x", F.lit(i))).otherwise(F.get("bg", F.lit(i))).alias(c) for i, c in enumerate(cols)])
    p = model.transform(assembled(x, cols)).select(key, "o", "bid", "k", "perm", "prediction")
    step = F.col("prediction") - F.lag("prediction").over(W.partitionBy(key, "o", "bid").orderBy("k"))
    names = F.array(*[F.lit(c) for c in cols])
    d = p.withColumn("step", step).where("k > 0").select(key, F.get(names, F.get("perm", F.col("k") - 1)).alias("feature"), "step")
    return d.groupBy(key, "feature").agg(F.avg("step").alias("value"))


def permutation_importance(df: DataFrame, model, cols: list[str], y: str = "y", key: str = "row_id", repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, importance: loss of R2 when the feature's values change rows, by the mean of
    seeded repeats; one scoring pass over rows x features x repeats."""
    base = scores(model.transform(assembled(df, cols)).withColumnRenamed("prediction", "p").withColumn("g", F.lit(0)), ["g"], y).select(F.col("r2").alias("base"))
    rows = cut(numbered(df.select(key, y, *cols), [key], "at", "n"))
    n = max(rows.count(), 1)
    # place -> (a * place + b) mod n changes places one to one, if a and n share no divisor
    rng, moves = random.Random(seed), []
    for c in cols:
        for r in range(repeats):
            a = rng.randrange(1, 1 << 20)
            while math.gcd(a, n) > 1:
                a += 1
            moves.append(F.struct(F.lit(c).alias("feature"), F.lit(r).alias("rep"), F.lit(a).cast("long").alias("a"), F.lit(rng.randrange(n)).cast("long").alias("b")))
    moved = rows.withColumn("_m", F.explode(F.array(*moves))).withColumn("to", F.pmod(F.col("_m.a") * F.col("at") + F.col("_m.b"), F.lit(n)))
    other = rows.select(F.col("at").alias("to"), F.struct(*cols).alias("_o"))
    out = moved.join(other, "to").select(F.col("_m.rep").alias("rep"), F.col("_m.feature").alias("feature"), y, *[F.when(F.col("_m.feature") == c, F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c) for c in cols])
    s = scores(model.transform(assembled(out, cols)).withColumnRenamed("prediction", "p"), ["feature", "rep"], y)
    return s.groupBy("feature").agg(F.avg("r2").alias("r2")).join(F.broadcast(base)).select("feature", (F.col("base") - F.col("r2")).alias("importance"))


def forest_shape(model) -> tuple[float, float, float, float]:
    """Trees, the most leaves and the greatest depth of a tree, and their product."""
    t = float(model.getNumTrees)
    leaves, depth = max((x.numNodes + 1) / 2 for x in model.trees), float(max(x.depth for x in model.trees))
    return t, leaves, depth, t * leaves * depth


def principal_components(df: DataFrame, cols: list[str], k: int, key: list[str]) -> DataFrame:
    a = standard(df, cols)
    m = PCA(k=k, inputCol="features", outputCol="pc").fit(assembled(a, cols))
    pc = vector_to_array("pc")
    return m.transform(assembled(a, cols)).select(*key, *[F.get(pc, F.lit(i)).alias(f"pc{i}") for i in range(k)])


def cluster_series(df: DataFrame, cols: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    a = assembled(df, cols)
    return KMeans(k=k, seed=seed).fit(a).transform(a).withColumnRenamed("prediction", "cluster").drop("features")


def choose_k(df: DataFrame, cols: list[str], ks: range = range(2, 11), seed: int = 42) -> DataFrame:
    """k, inertia, silhouette."""
    a, rows = assembled(df, cols).cache(), []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(a)
        rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(a)))))
    a.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def cluster_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("size"), *[F.median(c).alias(c) for c in cols])
