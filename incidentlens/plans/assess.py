"""Requests in, assessed rows out: derive, score, explain, recommend."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.frames import risk_bands
from incidentlens.operators.attributions import tree_attributions
from incidentlens.operators.derive import derive_features
from incidentlens.operators.explain import (
    maintenance_recommendation, risk_narrative, rule_attributions, top_risk_factors)
from incidentlens.operators.training import score


def explained(scored: DataFrame, model=None, id_col: str = "id") -> DataFrame:
    """Factors, narrative and recommendation for rows with features, prediction and probability."""
    rows = tree_attributions(model, scored, id_col).drop("base") if model is not None else rule_attributions(scored)
    return maintenance_recommendation(risk_narrative(top_risk_factors(rows))).drop("contributions")


def banded(scored: DataFrame) -> DataFrame:
    return risk_bands(scored.withColumn("risk_score", F.col("probability")))


def assess(requests: DataFrame, m: DataFrame, d: DataFrame, e: DataFrame, model, by_rules: bool = False) -> DataFrame:
    """Assess all valid requests; rejected ones are left to ``validate_request``."""
    derived = derive_features(requests, m, d, e).filter(F.size("errors") == 0).drop("errors")
    ids = [c for c in ("request_id", "user_id") if c in derived.columns]
    scored = score(model, derived.select(*ids, "features_used", *fv.FEATURES))
    rows = explained(scored, None if by_rules else model, "request_id")
    out = banded(rows)
    if "user_id" not in out.columns:
        out = out.withColumn("user_id", F.lit(None).cast("int"))
    return out.drop("probability")
