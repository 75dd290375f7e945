"""The model ladder as Spark ML pipelines, training and scoring, and attribution by feature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import evaluate as ev
from tidegraph.operators.splits import positive_weight, subsample_negatives
from tidegraph.plans.config import Config


def prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features as doubles, and for each whether it was missing: trees take no NaN, so a null becomes -1 and a flag."""
    return df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"x_{c}") for c in columns), *(F.col(c).isNull().cast("double").alias(f"m_{c}") for c in columns))


def _logistic(columns: list[str], config: Config) -> list:
    p = config["models"]["logistic_regression"]
    x = [f"d_{c}" for c in columns]
    return [
        Imputer(strategy="median", relativeError=1e-4, inputCols=x, outputCols=[f"i_{c}" for c in columns]),
        VectorAssembler(inputCols=[f"i_{c}" for c in columns], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(maxIter=p["max_iter"], regParam=1e-4 / p["C"], weightCol="weight", labelCol="label"),
    ]


def _trees(make: Callable) -> Callable:
    def stages(columns: list[str], config: Config) -> list:
        return [VectorAssembler(inputCols=[f"{k}_{c}" for c in columns for k in "xm"], outputCol="features"), make(config)]

    return stages


def _tree(config: Config):
    p = config["models"]["decision_tree"]
    return DecisionTreeClassifier(maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples_leaf"], weightCol="weight", seed=config["seed"])


def _forest(config: Config):
    p = config["models"]["random_forest"]
    return RandomForestClassifier(numTrees=p["n_estimators"], minInstancesPerNode=p["min_samples_leaf"], featureSubsetStrategy="sqrt", maxDepth=12, weightCol="weight", seed=config["seed"])


def _boosted(config: Config):
    p = config["models"]["gbt"]
    return GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=6, minInstancesPerNode=p["min_samples_leaf"], weightCol="weight", seed=config["seed"])


MODELS: dict[str, Callable[[list[str], Config], list]] = {"logistic_regression": _logistic, "decision_tree": _trees(_tree), "random_forest": _trees(_forest), "gbt": _trees(_boosted)}


def chosen(names: list[str] | None) -> list[str]:
    """ML5: the models asked for, in the ladder's order; an unknown one is an error."""
    unknown = set(names or []) - set(MODELS)
    if unknown:
        raise KeyError(f"unknown models {sorted(unknown)}; there are {list(MODELS)}")
    return [m for m in MODELS if names is None or m in names]


def fit(name: str, train: DataFrame, columns: list[str], config: Config) -> PipelineModel:
    """ML1-ML4 on a training split whose negatives are sampled; positives weigh as much as negatives."""
    sampled = subsample_negatives(train, config["sampling"]["negative_ratio"], config["seed"])
    ready = _ready(sampled, columns).join(F.broadcast(positive_weight(sampled).withColumnRenamed("weight", "pos_weight")))
    ready = ready.withColumn("weight", F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
    return Pipeline(stages=MODELS[name](columns, config)).fit(ready)


def _ready(df: DataFrame, columns: list[str]) -> DataFrame:
    return prepared(df, columns).select("*", *(F.col(c).cast("double").alias(f"d_{c}") for c in columns))


def score(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    """ML7: tx_id, split, score (of class 1), label of all rows."""
    return model.transform(_ready(df, columns)).select("tx_id", "split", vector_to_array("probability")[1].alias("score"), F.col("label").cast("int").alias("label"))


def train_and_score(name: str, split: DataFrame, columns: list[str], config: Config) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """ML6: model, predictions of val and test, and one row of metrics for each; the threshold is chosen on val and applied to test."""
    model = fit(name, split.where("split = 'train'"), columns, config)
    predictions = score(model, split.where("split <> 'train'"), columns)
    threshold = ev.threshold_at_recall(predictions.where("split = 'val'"), config["models"]["recall_target"])
    days = {s: config["time"][f"{s}_days"][1] - config["time"][f"{s}_days"][0] + 1 for s in ("val", "test")}
    val, test = (ev.evaluate_split(predictions.where(F.col("split") == s), threshold, n).withColumn("split", F.lit(s)) for s, n in days.items())
    return model, predictions, val.unionByName(test).withColumn("model", F.lit(name))


def walk_forward(split_rows: DataFrame, typology: DataFrame, columns: list[str], config: Config, name: str = "decision_tree") -> DataFrame:
    """SP7, EV11: block, arm, auprc and its interval. Retrained: on all blocks before; frozen: on the first alone. Training rows of an attempt that reaches into any later block go."""
    e = config["evaluate"]
    rows = split_rows.withColumn("block", F.expr(f"day_idx div {int(e['walkforward_block_days'])}"))
    known = rows.join(typology.select("tx_id", "attempt_id"), "tx_id", "left")
    out = None
    frozen = None
    for k in range(1, e["walkforward_blocks"]):
        reaching = known.where((F.col("block") >= k) & F.col("attempt_id").isNotNull()).select(F.col("attempt_id").alias("reaching")).distinct()
        before = known.where(F.col("block") < k).join(reaching, F.col("attempt_id") == F.col("reaching"), "left_anti").drop("attempt_id").withColumn("split", F.lit("train"))
        retrained = fit(name, before, columns, config)
        frozen = frozen or retrained
        for arm, model in (("retrained", retrained), ("frozen", frozen)):
            scored = score(model, rows.where(F.col("block") == k).withColumn("split", F.lit("test")), columns)
            ap = ev.average_precision(scored).withColumnRenamed("average_precision", "auprc")
            found = ap.join(ev.bootstrap(scored, e["bootstrap_iterations"], seed=config["seed"]).select(F.col("lo").alias("auprc_lo"), F.col("hi").alias("auprc_hi"))).select(F.lit(k).alias("block"), F.lit(arm).alias("arm"), "auprc", "auprc_lo", "auprc_hi")
            out = found if out is None else out.unionByName(found)
    return out


def attributions(model: PipelineModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """EV12: tx_id, feature, value: what each feature adds to the prediction of a row by its tree paths (the change of the node's share of positives at each split, summed over the trees). Rows stay distributed; the trees are broadcast, their number and depth bounded by the settings."""
    stage = model.stages[-1]
    trees = [_nodes(t) for t in getattr(stage, "trees", [stage])]
    weights = list(getattr(stage, "treeWeights", [1.0] * len(trees)))
    sent = rows.sparkSession.sparkContext.broadcast((trees, weights))
    schema = "tx_id long, feature string, value double"

    def explain(batches):
        import numpy as np
        import pandas as pd

        trees, weights = sent.value
        for batch in batches:
            x = np.array(batch["x"].tolist(), np.float64).reshape(len(batch), -1)
            total = np.zeros((len(batch), len(columns)))
            for (feature, threshold, left, right, value), w in zip(trees, weights, strict=True):
                at = np.zeros(len(batch), int)
                while (inner := feature[at] >= 0).any():
                    k = np.flatnonzero(inner)
                    f = feature[at[k]]
                    after = np.where(x[k, f] <= threshold[at[k]], left[at[k]], right[at[k]])
                    np.add.at(total, (k, f // 2), w * (value[after] - value[at[k]]))
                    at[k] = after
            yield pd.DataFrame({"tx_id": np.repeat(batch["tx_id"].to_numpy(), len(columns)), "feature": columns * len(batch), "value": total.ravel()})

    ready = prepared(rows, columns).select("tx_id", F.array(*(f"{k}_{c}" for c in columns for k in "xm")).alias("x"))
    return ready.mapInPandas(explain, schema)


def _nodes(tree) -> tuple:
    """feature (-1 at a leaf), threshold, left, right, value of a tree's nodes, the root first."""
    import numpy as np

    out: list[list] = []

    def add(node) -> int:
        i = len(out)
        stats = list(node.impurityStats().stats())
        is_leaf = node.subtreeDepth() == 0
        # A regression tree's prediction, or a classifier's share of positives.
        value = stats[1] / sum(stats) if len(stats) == 2 and sum(stats) else node.prediction()
        out.append([-1, 0.0, i, i, value])
        if not is_leaf:
            out[i][0], out[i][1] = node.split().featureIndex(), node.split().threshold()
            out[i][2], out[i][3] = add(node.leftChild()), add(node.rightChild())
        return i

    add(tree._call_java("rootNode"))
    f, t, a, b, v = zip(*out, strict=True)
    return np.array(f), np.array(t, float), np.array(a), np.array(b), np.array(v, float)
