"""Additive (Shapley) contributions of boosted trees, on the scale of the log odds.

A leaf counts for a set of known inputs when the row meets the path's conditions on them; for the other inputs it counts with
the share of the training weight that took the path. ``path_contributions`` solves that for a path of any
length; rows meet the trees in Arrow batches.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentlens import fixed_values as fv
from incidentlens.operators.boosted_model import BoostedModel, Ensemble
from incidentlens.operators.training import CalibratedModel


def slot_features(model: BoostedModel) -> list:
    """Feature name of each input: the numeric features, then each category that some split names."""
    return [feature for feature, _ in model.ensemble.slots]


def model_slots(model: BoostedModel, df: DataFrame) -> DataFrame:
    """(slot, feature) for every input that a split of the model uses."""
    names = slot_features(model)
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(f).alias("feature")) for i, f in enumerate(names)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("s")).select("s.*")


def slot_attributions(model: BoostedModel, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, margin, base, slot, impact): contributions of every input on the model's margin scale."""
    impacts = model.udf(df.sparkSession, Ensemble.slot_contributions, T.ArrayType(T.DoubleType()))
    rows = model.with_margin(df.withColumn("_impacts", impacts))
    return rows.select(id_col, "margin", F.lit(model.ensemble.base).alias("base"), F.posexplode("_impacts").alias("slot", "impact"))


def _by_feature(features: list):
    def run(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(x)))
        for (feature, _), impact in zip(ensemble.slots, ensemble.slot_contributions(x).T):
            out[features.index(feature)] += impact
        return np.ascontiguousarray(out.T)

    return run


def tree_attributions(model, df: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` with ``base`` and ``contributions``, a struct of the 13 features in label order.

    Contributions of a calibrated model are those of its base models, averaged.
    Only the 13 inputs travel to Python; all other columns stay in the JVM.
    """
    models = model.bases if isinstance(model, CalibratedModel) else [model]
    features, keep, out = list(fv.EXPLANATION_LABELS), df.columns, df
    compute = _by_feature(features)
    for i, m in enumerate(models):
        out = out.withColumn(f"_impacts{i}", m.udf(df.sparkSession, compute, T.ArrayType(T.DoubleType())))
    mean = [sum((F.col(f"_impacts{i}")[k] for i in range(len(models))), F.lit(0.0)) / len(models) for k in range(len(features))]
    named = F.struct(*[c.alias(f) for c, f in zip(mean, features)])
    base = float(np.mean([m.ensemble.base for m in models]))
    return out.select(*keep, F.lit(base).alias("base"), named.alias("contributions"))
