import uuid

from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.catalog.cleaning import EXTRA as TRAINING
from incidentlens.operators import attributions, encoding, metrics
from incidentlens.operators import training as ops
from incidentlens.operators.explain import contribution_rows
from incidentlens.plans.assess import assess
from incidentlens.plans.materialize import materialize, shared_dir
from incidentlens.plans.training_frame import training_frame
from incidentlens.sources import tables

EXTRA = {k: TRAINING[k] for k in ("merged", "counted", "frame_v1", "frame_v2")}
_fitted = {}


def _frame(t):
    """The training table, written once: split, folds and medians each read it more than once."""
    return materialize(training_frame(t.events, t.devices, t.manufacturers, "v2"))


def _parts(t):
    """(train, test) of the written training frame; the split is written too, as training reads its part several times."""
    split = materialize(ops.stratified_split(_frame(t)))
    return split.filter("not is_test").drop("is_test"), split.filter("is_test").drop("is_test")


def _once(t, kind, fit):
    """One fit per session and folder; several queries show the same model."""
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _fitted:
        train, test = _parts(t)
        _fitted[key] = (fit(train), test)
    return _fitted[key]


def _boosted(t):
    return _once(t, "gbt", lambda train: ops.train_gbt(train))


def _calibrated(t):
    return _once(t, "calibrated", lambda train: ops.calibrate_sigmoid(train))


def _scored(fitted):
    model, test = fitted
    return ops.score(model, test).select("id", F.col("target").alias("label"), "prediction", "probability")


def _onehot(t):
    train, test = _parts(t)
    slots = encoding.onehot_ignore_unknown(test, encoding.category_dictionary(train, fv.CATEGORICAL), fv.CATEGORICAL)
    return slots.select("id", F.concat_ws(",", F.col("slots").cast("array<string>")).alias("slots"))


def _trained(t):
    """The fitted model itself: its nodes."""
    return _boosted(t)[0].node_table(t.spark)


def _saved(t):
    model, test = _boosted(t)
    path = f"{shared_dir(t.spark)}/incidentlens-model-{uuid.uuid4().hex}"
    tables.save_model(model, path)
    return path, test


def _save_model(t):
    """What was stored of each tree."""
    path, _ = _saved(t)
    leaf = F.col("feature").isNull()
    return t.spark.read.parquet(f"{path}/nodes").groupBy("tree").agg(
        F.count("*").alias("n_nodes"), F.count_if(leaf).alias("n_leaves"),
        F.max(F.when(F.col("node") == 0, F.col("cover"))).alias("cover"))


def _load_model(t):
    """Log odds of the test part by the model read back."""
    path, test = _saved(t)
    return tables.load_model(path).with_margin(test).select("id", "margin")


def _attributions(t):
    model, test = _boosted(t)
    rows = attributions.tree_attributions(model, test)
    return contribution_rows(rows, "id", "base")


def _assess(t):
    model, _ = _boosted(t)
    return assess(t.requests, t.manufacturers, t.devices, t.events, model).select(
        "request_id", "prediction", "prediction_label", "risk_score", "risk_percentage", "risk_level", "explanation",
        F.to_json("risk_factors").alias("risk_factors"), "maintenance_recommendation")


QUERIES = {
    "impute_mode": lambda t: ops.impute_mode(_frame(t)),
    "impute_median": lambda t: ops.impute_median(_frame(t)),
    "stratified_split": lambda t: ops.stratified_split(_frame(t)).select("id", "target", "is_test"),
    "class_weight": lambda t: ops.class_weight(_frame(t)),
    "kfold_stratified": lambda t: ops.kfold_stratified(_frame(t)).select("id", "target", "fold"),
    "onehot_ignore_unknown": _onehot,
    "train_gbt": _trained,
    "score": lambda t: _scored(_boosted(t)),
    "score_metrics": lambda t: metrics.classification_metrics(_scored(_boosted(t))),
    "calibrate_sigmoid": lambda t: _scored(_calibrated(t)),
    "save_model": _save_model,
    "load_model": _load_model,
    "tree_attributions": _attributions,
    "assess": _assess,
}

_CELLS = " union all ".join(f"select id, {i} as c, {c} as value, is_test from parts" for i, c in enumerate(fv.CATEGORICAL))

ORACLE = {
    "onehot_ignore_unknown": f"""with parts as (select *, row_number() over (partition by target order by md5('42|' || id))
          <= round(0.2 * count(*) over (partition by target)) as is_test from frame_v2),
        cells as ({_CELLS}),
        slots as (select c, value, row_number() over (order by c, value) - 1 as slot
          from (select distinct c, value from cells where not is_test and value is not null) d)
        select id, coalesce(string_agg(cast(slot as string), ',' order by slot), '') as slots
        from cells left join slots on cells.c = slots.c and cells.value = slots.value where is_test group by id""",
    "impute_mode": " union all ".join(
        f"""select * from (select '{c}' as "column", {c} as value from frame_v2 group by {c}
        order by count(*) desc, {c} limit 1) t""" for c in fv.CATEGORICAL),
    "impute_median": " union all ".join(
        f"""select '{c}' as "column", quantile_cont({c}, 0.5) as value from frame_v2""" for c in fv.NUMERICAL),
    "stratified_split": """select id, target, row_number() over (partition by target order by md5('42|' || id))
        <= round(0.2 * count(*) over (partition by target)) as is_test from frame_v2""",
    "class_weight": """select count(*) filter (target = 1) as positives, count(*) filter (target = 0) as negatives,
        count(*) filter (target = 0) / count(*) filter (target = 1) as scale_pos_weight from frame_v2""",
    "kfold_stratified": """select id, target, ntile(3) over (partition by target order by md5('42|' || id)) - 1 as fold
        from frame_v2""",
}
