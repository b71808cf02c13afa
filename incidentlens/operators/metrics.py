"""Evaluation of (id, label, prediction, probability) as relational queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.operators.ordering import exact_quantiles, running_totals
from incidentlens.operators.search import head_examples

V1_QUANTILES = {"median": 0.5, "p95": 0.95}
V2_QUANTILES = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _cells(s):
    def n(label, prediction):
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))

    return s.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def confusion_matrix(s: DataFrame) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(pred).alias("prediction"), F.col(c).alias("n"))
        for label, pred, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return _cells(s).select(F.explode(cells).alias("c")).select("c.*")


def _ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den != 0, den))


def classification_metrics(s: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return _cells(s).select(
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(s: DataFrame) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    parts = {
        "Low Risk": (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn), tn + fp),
        "High Risk": (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    low, high = parts["Low Risk"], parts["High Risk"]
    total = low[3] + high[3]
    accuracy = _ratio(tp + tn, total)
    rows = dict(parts)
    rows["accuracy"] = (accuracy, accuracy, accuracy, total)
    rows["macro avg"] = (*[(low[i] + high[i]) / 2 for i in range(3)], total)
    rows["weighted avg"] = (*[_ratio(low[i] * low[3] + high[i] * high[3], total) for i in range(3)], total)
    entries = F.array(*[
        F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                 n.cast("bigint").alias("support"))
        for name, (p, r, f, n) in rows.items()])
    return _cells(s).select(F.explode(entries).alias("r")).select("r.*")


def _by_score(s, digits):
    p = F.col("probability")
    return s.select(
        (F.round(p, digits) if digits is not None else p).alias("p"),
        (F.col("label") == 1).cast("bigint").alias("pos"),
        (F.col("label") == 0).cast("bigint").alias("neg"),
    ).filter("p is not null")


def roc_auc(s: DataFrame, digits: int | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order; ties count half.

    NULL when only one class is present. ``digits`` rounds the scores first.
    """
    t = running_totals(_by_score(s, digits), "p", {"pos": F.col("pos"), "neg": F.col("neg")})
    # Pair counts pass 2^63 at scale; doubles keep them to 1e-15.
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return t.agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def pr_auc(s: DataFrame, digits: int | None = None) -> DataFrame:
    """Average precision: one step per distinct score, from the highest down."""
    flipped = _by_score(s, digits).withColumn("p", -F.col("p"))
    t = running_totals(flipped, "p", {"pos": F.col("pos"), "neg": F.col("neg")})
    hit = F.col("pos_before") + F.col("pos")
    seen = hit + F.col("neg_before") + F.col("neg")
    total = F.sum("pos")
    return t.agg(F.when(total > 0, F.sum(F.col("pos") * hit / seen) / total).alias("pr_auc"))


def probability_stats(s: DataFrame, qs: dict | None = None) -> DataFrame:
    """Minimum, maximum, mean and interpolated quantiles in one row."""
    qs = qs or V2_QUANTILES
    quantiles = exact_quantiles(s.select("probability"), "probability", sorted(set(qs.values())))
    at = quantiles.agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))))
    return s.agg(
        F.min("probability").alias("min"), F.max("probability").alias("max"), F.avg("probability").alias("mean"),
    ).withColumn("_at", at.scalar()).select(
        "min", "max", "mean", *[F.element_at("_at", F.lit(float(q))).alias(name) for name, q in qs.items()])


def probability_histogram(s: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins over 0..1, the last one closed on the right; scores outside are not counted.

    A bin starts at the double ``i * (1 / bins)``, so 0.3 lies below the edge 0.30000000000000004.
    """
    p, step = F.col("probability"), F.lit(1.0 / bins)
    near = F.floor(p * bins)
    bin_ = F.when(p < near * step, near - 1).when(p >= (near + 1) * step, near + 1).otherwise(near)
    counts = (
        s.filter(p.between(0, 1))
        .groupBy(F.least(bin_, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    frame = s.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def predicts_both_classes(s: DataFrame) -> DataFrame:
    classes = F.count_distinct("prediction")
    return s.agg(
        classes.alias("predicted_classes"),
        F.when(classes < 2, "WARNING: The model predicts only one class.")
        .otherwise("Model predicts both classes successfully.").alias("message"),
    )


def _shown(s, *extra):
    return s.select(
        "id", F.col("label").alias("actual_class"), F.col("prediction").alias("predicted_class"),
        F.format_string("%s%%", F.round((F.col("probability") * 100).cast("decimal(38,8)"), 2).cast("decimal(12,2)")
                        .cast("string")).alias("risk_probability_pct"), *extra)


def sample_predictions(s: DataFrame, n: int = 20) -> DataFrame:
    return _shown(s.orderBy("id").limit(n))


def example_predictions(s: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of each class with the features that describe them."""
    shown = [c for c in ("type", "status", "classification", "risk_class", "name_manufacturer") if c in s.columns]
    return _shown(head_examples(s, "label", n), *shown)
