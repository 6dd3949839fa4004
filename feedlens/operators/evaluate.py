"""Classifier evaluation from confusion counts.

The only pass over the data is one ``groupBy(scope, gold, pred).count()``
(partial aggregation, at most |scopes| x 9 output rows); every metric is then
computed on that tiny table. Macro averages run over the labels observed in
either column (as sklearn's ``unique_labels``); label-wise metrics use the
fixed domain negative / neutral / positive, zero when absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.score import SENTIMENTS

DIGITS = 4
# Per-source label smoothing and loss weights of the evaluation run.
SMOOTHING = {"trustpilot": 0.1, "youtube": 0.2}
WEIGHTS = {"trustpilot": 1.0, "youtube": 0.5}


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, scope: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    return (df.filter(F.col(gold).isNotNull())
            .groupBy(*scope, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_label(conf: DataFrame, scope: list[str]) -> DataFrame:
    """tp / support / predicted counts per observed label, with precision, recall, f1."""
    # Each confusion cell counts once for its gold label and once for its predicted label:
    # one explode and one aggregate give every observed label (no join of the two sides).
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("t"), hit.alias("h"), zero.alias("p")),
        F.struct(F.col("pred").alias("label"), zero.alias("t"), zero.alias("h"), F.col("n").alias("p")))
    e = conf.select(*scope, F.explode(sides).alias("e")).filter(F.col("e.label").isNotNull())
    j = e.groupBy(*scope, F.col("e.label").alias("label")).agg(
        F.sum("e.t").alias("true_sum"), F.sum("e.h").alias("tp"), F.sum("e.p").alias("pred_sum"))
    return j.select(
        *scope, "label", "tp", "true_sum", "pred_sum",
        _safe_div(F.col("tp"), F.col("pred_sum")).alias("precision"),
        _safe_div(F.col("tp"), F.col("true_sum")).alias("recall"),
        _safe_div(2 * F.col("tp"), F.col("true_sum") + F.col("pred_sum")).alias("f1"))


def global_metrics(df: DataFrame, scope: list[str] | None = None, gold: str = "gold",
                   pred: str = "pred") -> DataFrame:
    """A22 (scope = []) / A24 (scope = [source]): accuracy and macro precision, recall, F1."""
    scope = scope or []
    return _macro(confusion(df, scope, gold, pred), scope)


def _macro(conf: DataFrame, scope: list[str]) -> DataFrame:
    lab = per_label(conf, scope)
    agg = lab.groupBy(*scope) if scope else lab.groupBy()
    r = lambda c: F.round(c, DIGITS)
    return agg.agg(
        r(F.sum("tp") / F.sum("true_sum")).alias("accuracy"),
        r(F.avg("precision")).alias("precision"),
        r(F.avg("recall")).alias("recall"),
        r(F.avg("f1")).alias("f1"))


def label_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per label of the fixed domain: accuracy (= recall), precision, recall, F1."""
    return _by_label(confusion(df, [], gold, pred))


def _by_label(conf: DataFrame) -> DataFrame:
    lab = per_label(conf, [])
    dom = conf.sparkSession.createDataFrame([(x,) for x in SENTIMENTS], "label string")
    j = dom.join(lab, "label", "left").na.fill(0.0, ["precision", "recall", "f1"])
    r = lambda c: F.round(F.col(c), DIGITS)
    return j.select("label", r("recall").alias("accuracy"), r("precision").alias("precision"),
                    r("recall").alias("recall"), r("f1").alias("f1"))


def smoothed_ce(logits: list[Column], target_index: Column, eps: Column) -> Column:
    """Per-row label-smoothed cross-entropy: -(1-eps) ln p_y - eps/K sum_k ln p_k."""
    k = len(logits)
    m = F.greatest(*logits)
    lse = m + F.log(sum((F.exp(x - m) for x in logits[1:]), F.exp(logits[0] - m)))
    logp = [x - lse for x in logits]
    logp_y = F.element_at(F.array(*logp), (target_index + 1).cast("int"))
    return -(1 - eps) * logp_y - eps / k * sum(logp[1:], logp[0])


def eval_loss(df: DataFrame, gold: str = "gold") -> DataFrame:
    """Mean smoothed cross-entropy per source and the weighted total.

    Whole-table means (not a mean of batch means). Rows: one per weighted
    source plus ``total``.
    """
    idx = F.array_position(F.array(*[F.lit(x) for x in SENTIMENTS]), F.col(gold)) - 1
    eps = F.coalesce(*[F.when(F.col("source") == s, F.lit(e)) for s, e in SMOOTHING.items()])
    rows = (df.filter(F.col(gold).isNotNull() & F.col("source").isin(*SMOOTHING))
            .select("source",
                    smoothed_ce([F.col("logit_neg"), F.col("logit_neu"), F.col("logit_pos")], idx, eps)
                    .alias("ce")))
    # The sources are a fixed few: one row of partial means a task, one exchange of single rows, no grouping.
    means = rows.agg(*[F.avg(F.when(F.col("source") == x, F.col("ce"))).alias(x) for x in SMOOTHING])
    weighted = [F.col(x) * F.lit(w) for x, w in WEIGHTS.items()]
    some = F.coalesce(*weighted)
    total = F.when(some.isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in weighted[1:]), F.coalesce(weighted[0], F.lit(0.0))))
    own = [F.when(F.col(x).isNotNull(), F.struct(F.lit(x).alias("source"), F.col(x).alias("loss"), F.lit(w).cast("double").alias("weight"))) for x, w in WEIGHTS.items()]
    tot = F.struct(F.lit("total").alias("source"), total.alias("loss"), F.lit(None).cast("double").alias("weight"))
    return means.select(F.explode(F.array_compact(F.array(*own, tot))).alias("r")).select(
        F.col("r.source").alias("source"), F.round("r.loss", DIGITS).alias("loss"), F.col("r.weight").alias("weight"))


def metrics_long(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Every metric as (scope, key, metric, value).

    One confusion table by source serves all three scopes: its exchange is reused.
    """
    names = ["accuracy", "precision", "recall", "f1"]
    by_source = confusion(df, ["source"], gold, pred)
    overall = by_source.groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    g = _macro(overall, []).select(F.lit("global").alias("scope"), F.lit("all").alias("key"), *names)
    lab = _by_label(overall).select(F.lit("label").alias("scope"), F.col("label").alias("key"), *names)
    src = _macro(by_source, ["source"]).select(
        F.lit("source").alias("scope"), F.col("source").alias("key"), *names)
    wide = g.unionByName(lab).unionByName(src)
    return wide.unpivot(["scope", "key"], names, "metric", "value")
