from incidentlens.operators import metrics as ops

EXTRA = {
    "cells": """select cast(count(*) filter (label = 0 and prediction = 0) as double) as tn,
        cast(count(*) filter (label = 0 and prediction = 1) as double) as fp,
        cast(count(*) filter (label = 1 and prediction = 0) as double) as fn,
        cast(count(*) filter (label = 1 and prediction = 1) as double) as tp from md_scored""",
    "report": """
        select 'Low Risk' as class, tn / (tn + fn) as precision, tn / (tn + fp) as recall,
          2 * tn / (2 * tn + fp + fn) as f1, tn + fp as support from cells
        union all select 'High Risk', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn from cells""",
}
SHOWN = """id, label as actual_class, prediction as predicted_class,
    cast(cast(round(cast(probability * 100 as decimal(38,8)), 2) as decimal(12,2)) as string) || '%' as risk_probability_pct"""

QUERIES = {
    "confusion_matrix": lambda t: ops.confusion_matrix(t.scored),
    "classification_metrics": lambda t: ops.classification_metrics(t.scored),
    "classification_report": lambda t: ops.classification_report(t.scored),
    "roc_auc": lambda t: ops.roc_auc(t.scored),
    "pr_auc": lambda t: ops.pr_auc(t.scored),
    "probability_stats": lambda t: ops.probability_stats(t.scored),
    "probability_stats_v1": lambda t: ops.probability_stats(t.scored, ops.V1_QUANTILES),
    "probability_histogram": lambda t: ops.probability_histogram(t.scored),
    "predicts_both_classes": lambda t: ops.predicts_both_classes(t.scored),
    "sample_predictions": lambda t: ops.sample_predictions(t.scored),
    "example_predictions": lambda t: ops.example_predictions(
        t.scored.join(t.predictions.select("id", "type", "classification", "risk_class", "name_manufacturer"), "id")),
}

ORACLE = {
    "confusion_matrix": """select 0 as label, 0 as prediction, cast(tn as bigint) as n from cells
        union all select 0, 1, cast(fp as bigint) from cells union all select 1, 0, cast(fn as bigint) from cells
        union all select 1, 1, cast(tp as bigint) from cells""",
    "classification_metrics": """select (tp + tn) / (tp + tn + fp + fn) as accuracy, tp / (tp + fp) as precision,
        tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from cells""",
    "classification_report": """
        select class, precision, recall, f1, cast(support as bigint) as support from report
        union all select 'accuracy', a, a, a, cast(n as bigint) from
          (select (tp + tn) / (tp + tn + fp + fn) as a, tp + tn + fp + fn as n from cells) x
        union all select 'macro avg', sum(precision) / 2, sum(recall) / 2, sum(f1) / 2, cast(sum(support) as bigint)
          from report
        union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), cast(sum(support) as bigint) from report""",
    "roc_auc": """
        with ranked as (select label, rank() over (order by probability)
            + (count(*) over (partition by probability) - 1) / 2.0 as r from md_scored),
          s as (select cast(count(*) filter (label = 1) as double) as np, cast(count(*) filter (label = 0) as double) as nn,
            sum(case when label = 1 then r end) as rp from ranked)
        select (rp - np * (np + 1) / 2) / (np * nn) as roc_auc from s""",
    "pr_auc": """
        with steps as (select probability as p, cast(sum(label) as double) as pos, cast(count(*) as double) as n
            from md_scored group by probability),
          run as (select pos, sum(pos) over (order by p desc) as hit, sum(n) over (order by p desc) as seen from steps)
        select sum(pos * hit / seen) / sum(pos) as pr_auc from run""",
    "probability_stats": """select min(probability) as min, max(probability) as max, avg(probability) as mean,
        quantile_cont(probability, 0.5) as median, quantile_cont(probability, 0.05) as p05,
        quantile_cont(probability, 0.25) as p25, quantile_cont(probability, 0.5) as p50,
        quantile_cont(probability, 0.75) as p75, quantile_cont(probability, 0.95) as p95 from md_scored""",
    "probability_stats_v1": """select min(probability) as min, max(probability) as max, avg(probability) as mean,
        quantile_cont(probability, 0.5) as median, quantile_cont(probability, 0.95) as p95 from md_scored""",
    "probability_histogram": """
        with edges as (select cast(i as int) as bin, i * cast(0.1 as double) as lo, (i + 1) * cast(0.1 as double) as hi
            from range(10) t(i))
        select bin, bin / 10.0::double as low, (bin + 1) / 10.0::double as high,
          (select count(*) from md_scored where probability >= lo and (probability < hi or bin = 9 and probability <= 1)
          ) as n from edges""",
    "predicts_both_classes": """select count(distinct prediction) as predicted_classes,
        case when count(distinct prediction) < 2 then 'WARNING: The model predicts only one class.'
        else 'Model predicts both classes successfully.' end as message from md_scored""",
    "sample_predictions": f"select {SHOWN} from md_scored order by id limit 20",
    "example_predictions": f"""select {SHOWN}, type, classification, risk_class, name_manufacturer
        from (select s.*, p.type, p.classification, p.risk_class, p.name_manufacturer,
          row_number() over (partition by s.label order by s.id) as rn
          from md_scored s join md_predictions p on p.id = s.id) t where rn <= 3""",
}
