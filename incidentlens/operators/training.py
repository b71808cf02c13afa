"""Split, weighting, imputation, boosted trees and calibration."""

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.cleaning import risk_target_v1, risk_target_v2
from incidentlens.operators.aggregates import top_value_by_group
from incidentlens.operators.boosted_model import BoostedModel
from incidentlens.operators.boosting import (
    BINS, MERGED_ROWS, PART_ROWS, ROW_BLOCK, Block, Settings, fit_trees, merged_blocks, widest)
from incidentlens.operators.encoding import category_dictionary, encoded
from incidentlens.operators.ordering import exact_quantiles, hash_cut, hash_key
from incidentlens.plans.materialize import materialize
from incidentlens.plans.workers import ship


def labelled(e: DataFrame, version: str = "v2") -> DataFrame:
    rule = {"v1": risk_target_v1, "v2": risk_target_v2}[version]
    return e.withColumn("target", rule(F.col("action_classification")))


# --- imputation -----------------------------------------------------------------------


def _cells(train, cols, kind):
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in cols])
    return train.select(F.explode(cells).alias("c")).select("c.*").filter("value is not null")


def impute_mode(train: DataFrame, cols=tuple(fv.CATEGORICAL)) -> DataFrame:
    """Most frequent value per column; ties go to the smaller value."""
    return top_value_by_group(_cells(train, cols, "string"), "column", "value").select("column", "value")


def impute_median(train: DataFrame, cols=tuple(fv.NUMERICAL)) -> DataFrame:
    """Exact interpolated median per column."""
    return exact_quantiles(_cells(train, cols, "double"), "value", [0.5], group="column").select("column", "value")


# --- split, folds, weights ------------------------------------------------------------


def stratified_split(df: DataFrame, label: str = "target", frac: float = 0.2, seed: int = 42,
                     id_col: str = "id") -> DataFrame:
    """``is_test`` for exactly round(frac * n) rows of each class, drawn by the hash of the id.

    The row that ends the test part is found per class; after that every row is
    compared with it, so the data itself is neither sorted nor shuffled.
    """
    cuts = hash_cut(df, label, 1, lambda n, i: F.round(n * F.lit(frac)).cast("bigint"), id_col, seed)
    return (
        df.join(F.broadcast(cuts), label, "left")
        .withColumn("is_test", F.coalesce(hash_key(id_col, seed) <= F.col("cut_1"), F.lit(False)))
        .drop("cut_1")
    )


def kfold_stratified(df: DataFrame, label: str = "target", k: int = 3, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``fold`` 0..k-1, each with an equal share (the first folds one more) of every class."""
    def end(n, i):
        return (F.floor(n / k) * i + F.least(n % k, F.lit(i))).cast("bigint")

    cuts = hash_cut(df, label, k - 1, end, id_col, seed)
    key = hash_key(id_col, seed)
    passed = sum(
        (F.when(key > F.col(f"cut_{i}"), 1).otherwise(0) for i in range(1, k)), F.lit(0))
    return (
        df.join(F.broadcast(cuts), label, "left").withColumn("fold", passed)
        .drop(*[f"cut_{i}" for i in range(1, k)])
    )


class NoPositives(ValueError):
    """The training part holds no row of the positive class."""


def class_weight(df: DataFrame, label: str = "target") -> DataFrame:
    """One row: class sizes and negatives per positive (NULL without positives)."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("positives"), neg.alias("negatives")).withColumn(
        "scale_pos_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.nullif("positives", F.lit(0))))


def weighted(df: DataFrame, label: str = "target") -> DataFrame:
    sizes = class_weight(df, label).first()
    if not sizes["positives"]:
        raise NoPositives("the positive class is absent from the training part")
    return df.withColumn(
        "weight", F.when(F.col(label) == 1, F.lit(float(sizes["scale_pos_weight"]))).otherwise(F.lit(1.0)))


# --- boosted trees --------------------------------------------------------------------


def fill_values(train: DataFrame) -> dict:
    """What fills the gaps of the 13 features: the training part's modes and medians."""
    fills = {c: "Unknown" for c in fv.CATEGORICAL} | {c: 0.0 for c in fv.NUMERICAL}
    fills.update({r["column"]: r["value"] for r in impute_mode(train).collect()})
    fills.update({r["column"]: float(r["value"]) for r in impute_median(train).collect()})
    return fills


def numeric_cuts(df: DataFrame, cols=tuple(fv.NUMERICAL), bins: int = BINS) -> list[np.ndarray]:
    """Rising cuts of each column at approximate quantiles, from one mergeable sketch each; a bin ends below its cut."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, shares, 40 * bins).alias(c) for c in cols]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in cols]


def code_type(widths: list[int]) -> np.dtype:
    """The smallest type that holds the codes of all columns, and -1."""
    return next((np.dtype(t) for t in (np.int8, np.int16) if max(widths) <= np.iinfo(t).max), np.dtype(np.int32))


def packed_blocks(rows: DataFrame, cuts: list[np.ndarray], label: str, kind: np.dtype, wide: int, tasks: int) -> DataFrame:
    """Rows with ``slots`` (places of categories) packed into the blocks that ``fit_trees`` takes, as a written table.

    Rows are dealt to ``tasks`` parts of like size by ranges of column ``wide``, so that each part has few of its codes.
    """
    ship(rows.sparkSession)
    n_numeric = len(cuts)

    def pack(batches):
        dealt = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(lo, ROW_BLOCK)
                n = part.num_rows
                places = part.column(0).flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(n, -1)
                codes = np.empty((n, places.shape[1] + n_numeric), kind)
                codes[:, :places.shape[1]] = places
                for i, cut in enumerate(cuts):
                    value = part.column(4 + i).to_numpy(zero_copy_only=False).astype(float)
                    codes[:, places.shape[1] + i] = np.where(np.isnan(value), 0, 1 + np.searchsorted(cut, value, "right"))
                cells = [codes, *[part.column(k).to_numpy(zero_copy_only=False).astype(t)
                                  for k, t in ((1, np.uint8), (2, np.float64), (3, np.int64))]]
                yield pa.RecordBatch.from_arrays([pa.array([dealt], pa.int32()), pa.array([n], pa.int32()),
                                                  *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                                                 names=["part", "n", "codes", "y", "w", "row_key"])

    source = rows.select("slots", F.col(label).cast("double"), F.col("weight").cast("double"), F.xxhash64("id").alias("_key"),
                         *[F.col(c).cast("double") for c in fv.NUMERICAL])
    code = F.col("slots")[wide] if wide < len(fv.CATEGORICAL) else F.col(fv.NUMERICAL[wide - len(fv.CATEGORICAL)])
    source = source.repartitionByRange(tasks, code, "_key")
    return materialize(source.mapInArrow(pack, "part int, n int, codes binary, y binary, w binary, row_key binary"))


def _block(row, kind: np.dtype) -> Block:
    n = row["n"]
    y, w, key = (np.frombuffer(row[c], t) for c, t in (("y", np.uint8), ("w", np.float64), ("row_key", np.int64)))
    return Block(np.asfortranarray(np.frombuffer(row["codes"], kind).reshape(n, -1)), y, w, key, np.zeros(n))


def train_gbt(df: DataFrame, rounds: int = 300, label: str = "target", seed: int = 42, fill: bool = True,
              settings: Settings | None = None) -> BoostedModel:
    """Impute, encode and boost; all statistics come from ``df`` alone.

    Trees of depth 4 are boosted to second order at rate 0.03, each from 80 % of the rows and 80 % of the inputs, with at least
    a hessian of 2 in every child; positives weigh as much as negatives in sum. With ``fill=False`` gaps are left as
    they are: each split learns the side that they take, and a gap in a category column has none of its categories.
    """
    spark = df.sparkSession
    settings = settings or Settings(rounds=rounds, seed=seed)
    train = weighted(df.select("id", label, *fv.FEATURES), label)
    fills = fill_values(train) if fill else {}
    filled = {c: F.coalesce(F.col(c).cast("string" if c in fv.CATEGORICAL else "double"), F.lit(v)) for c, v in fills.items()}
    train, seen = materialize(train.withColumns(filled), rows=F.count(F.lit(1)), heaviest=F.max("weight"))
    dictionary = category_dictionary(train, fv.CATEGORICAL)
    cuts = numeric_cuts(train)
    sizes = {r["column_no"]: r["n"] for r in dictionary.groupBy("column_no").agg(F.count("*").alias("n")).collect()}
    widths = [sizes.get(i, 0) for i in range(len(fv.CATEGORICAL))] + [len(cut) + 2 for cut in cuts]
    kind = code_type(widths)
    parallelism = spark.sparkContext.defaultParallelism
    # A pass over few rows is bound by the tasks' latency; else every core is to have rows, the same number each.
    tasks = max(1, min(parallelism, -(-seen["rows"] // MERGED_ROWS))) * max(1, -(-seen["rows"] // (parallelism * PART_ROWS)))
    table = packed_blocks(encoded(train, dictionary, fv.CATEGORICAL, "place"), cuts, label, kind, widest(widths), tasks)
    blocks = table.repartitionById(tasks, F.col("part")).rdd.mapPartitions(
        lambda rows: merged_blocks(_block(row, kind) for row in rows))
    trees, scale = fit_trees(blocks, widths, len(fv.CATEGORICAL), seen["rows"], seen["heaviest"], settings)
    return BoostedModel(_named_nodes(spark, trees, scale, settings, dictionary, cuts), fills)


def _named_nodes(spark, trees, scale, settings, dictionary, cuts) -> list[dict]:
    """Tree nodes with the names of their features, the texts of their categories and real thresholds."""
    wide, names = len(fv.CATEGORICAL), [*fv.CATEGORICAL, *fv.NUMERICAL]
    used = sorted({(c, code) for t in trees for c, code in zip(t.column, t.code) if 0 <= c < wide})
    wanted = spark.createDataFrame(used, "column_no int, place bigint")
    met = dictionary.join(F.broadcast(wanted), ["column_no", "place"]).collect() if used else []
    text = {(r["column_no"], r["place"]): r["value"] for r in met}
    out = []
    for number, tree in enumerate(trees):
        values = tree.leaf_values(settings, scale)
        for node, (c, code) in enumerate(zip(tree.column, tree.code)):
            out.append({
                "tree": number, "node": node, "feature": names[c] if c >= 0 else None,
                "category": text[c, code] if 0 <= c < wide else None,
                "threshold": float(cuts[c - wide][code - 1]) if c >= wide else None, "gap_left": bool(tree.gap_left[node]),
                "left": tree.left[node], "right": tree.right[node], "value": float(values[node]), "cover": tree.h[node] / scale})
    return out


def score(model, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` (int) and ``probability`` of the positive class."""
    return model.transform(df)


class CalibratedModel:
    """Mean of the sigmoid-calibrated probabilities of several boosted models."""

    def __init__(self, bases, sigmoids):
        self.bases = bases
        self.sigmoids = sigmoids  # (slope, intercept) per base

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop("prediction", "probability")
        keep = out.columns
        for i, model in enumerate(self.bases):
            out = model.with_margin(out, f"_m{i}")
        chance = [1 / (1 + F.exp(-F.col(f"_m{i}"))) for i in range(len(self.bases))]
        parts = [1 / (1 + F.exp(-(F.lit(a) * p + F.lit(b)))) for p, (a, b) in zip(chance, self.sigmoids)]
        mean = sum(parts[1:], parts[0]) / len(parts)
        return out.select(*keep, mean.alias("probability")).select(
            *keep, (F.col("probability") > 0.5).cast("int").alias("prediction"), "probability")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, model in enumerate(self.bases):
            model.save(spark, f"{path}/base_{i}")
        about = {"class": "CalibratedModel", "sigmoids": self.sigmoids}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CalibratedModel":
        sigmoids = [tuple(s) for s in json.loads(spark.read.text(f"{path}/about").first()[0])["sigmoids"]]
        return cls([BoostedModel.load(spark, f"{path}/base_{i}") for i in range(len(sigmoids))], sigmoids)


def fit_sigmoid(scored: DataFrame, label: str = "target") -> tuple:
    """Platt scaling of ``probability`` with smoothed targets.

    A target t is expressed as two weighted copies of a row: label 1 with weight t, label 0 with 1 - t.
    """
    sizes = scored.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    high, low = (sizes["p"] + 1.0) / (sizes["p"] + 2.0), 1.0 / (sizes["n"] + 2.0)
    t = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    copies = scored.select(F.col("probability").alias("p"), t.alias("t")).select(
        "p",
        F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")),
                          F.struct(F.lit(0.0).alias("y"), (1 - F.col("t")).alias("w")))).alias("c"),
    ).select("p", "c.y", "c.w")
    rows = VectorAssembler(inputCols=["p"], outputCol="x").transform(copies)
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def calibrate_sigmoid(df: DataFrame, k: int = 3, rounds: int = 300, label: str = "target", seed: int = 42) -> CalibratedModel:
    """Per fold: boost on the other folds, calibrate on the fold itself. The folds are fitted side by side."""
    folded = materialize(kfold_stratified(df, label, k, seed))

    def one(i):
        model = train_gbt(folded.filter(F.col("fold") != i), rounds, label, seed)
        held = score(model, folded.filter(F.col("fold") == i)).select(label, "probability")
        return model, fit_sigmoid(held, label)

    with ThreadPoolExecutor(k) as pool:
        fitted = list(pool.map(one, range(k)))
    return CalibratedModel([m for m, _ in fitted], [s for _, s in fitted])
