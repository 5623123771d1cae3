"""Dedup, class statistics and per-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.labels import LATE, ON_TIME
from punctual.operators.joins import broadcast_if_small


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order_col: str = "row_id",
                     carry: Sequence[str] = ()) -> DataFrame:
    """A2: one row per distinct ``keys``; the kept row is the one with the
    smallest ``order_col`` and its ``carry`` columns come along (J6).

    A hash aggregate on ``min(struct(order, carry...))`` replaces a
    row_number window: partial aggregation combines duplicates map-side, so a
    key holding a third of the rows never lands whole in one task.
    """
    packed = F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c).alias(c) for c in carry])).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, F.col("_first._o").alias(order_col), *[F.col(f"_first.{c}").alias(c) for c in carry])


def distinct_rows(df: DataFrame) -> DataFrame:
    """A3: full-row distinct (hash aggregate with map-side combine)."""
    return df.distinct()


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A5: share of each label (value_counts normalised)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the k label rows only
    return counts.select(label, "n", (F.col("n") / total).alias("share"))


def majority_class(df: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent label, ties -> smallest label (one row)."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(label).asc()).limit(1))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts and the two negative/positive ratios of the reference
    (neg/pos, 1.0 when pos = 0; and neg/max(pos, 1))."""
    agg = df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("bigint").alias("n_neg"),
                 F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("n_pos"))
    neg, pos = F.col("n_neg").cast("double"), F.col("n_pos").cast("double")
    return agg.select("n_neg", "n_pos",
                      F.when(pos > 0, neg / pos).otherwise(F.lit(1.0)).alias("scale_pos_weight"),
                      (neg / F.greatest(pos, F.lit(1.0))).alias("neg_pos_ratio"))


def balanced_weights(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """Weight n / (k * n_c) per row, as class_weight='balanced'.

    The class table has one row per label value and is broadcast behind a check
    of its rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    whole = Window.partitionBy()  # over the k class rows only
    w = counts.select(label, (F.sum("_nc").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_nc")))
                      .alias(weight_col))
    return df.join(broadcast_if_small(w), label)


def _cell(label: str, pred: str, a: int, b: int) -> Column:
    return F.sum(F.when((F.col(label) == a) & (F.col(pred) == b), 1).otherwise(0)).cast("bigint")


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """tn/fp/fn/tp in one pass (optionally per ``by`` group)."""
    return df.groupBy(*by).agg(_cell(label, prediction, 0, 0).alias("tn"), _cell(label, prediction, 0, 1).alias("fp"),
                               _cell(label, prediction, 1, 0).alias("fn"), _cell(label, prediction, 1, 1).alias("tp"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """Complete 2x2 grid (labels sorted), zero cells included."""
    c = confusion_counts(df, label, prediction, by)
    return c.select(*by, F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, n)"))


def _ratio(num: Column, den: Column) -> Column:
    """num/den with 0 on zero division (sklearn's zero_division=0)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def report_columns(by: Sequence[str] = ()) -> list[Column]:
    """Per-class and averaged metrics from tn/fp/fn/tp columns."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f0 = _f1(p1, r1), _f1(p0, r0)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    return [
        *[F.col(b) for b in by], tn, fp, fn, tp,
        p0.alias("precision_0"), r0.alias("recall_0"), f0.alias("f1_0"),
        p1.alias("precision_1"), r1.alias("recall_1"), f1.alias("f1_1"),
        _ratio(tp + tn, n).alias("accuracy"),
        ((f0 + f1) / 2).alias("macro_f1"),
        ((p0 + p1) / 2).alias("macro_precision"),
        ((r0 + r1) / 2).alias("macro_recall"),
        # V4: mean recall over the classes present in the true labels.
        (F.when((s0 > 0) & (s1 > 0), (r0 + r1) / 2).when(s1 > 0, r1).otherwise(r0)).alias("balanced_accuracy"),
        _ratio(p0 * s0 + p1 * s1, n).alias("weighted_precision"),
        _ratio(r0 * s0 + r1 * s1, n).alias("weighted_recall"),
        _ratio(f0 * s0 + f1 * s1, n).alias("weighted_f1"),
        s0.cast("bigint").alias("support_0"), s1.cast("bigint").alias("support_1"), n.cast("bigint").alias("support"),
    ]


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """A10: rows On-Time / Late / accuracy / macro avg / weighted avg with
    precision, recall, f1 and support, from one conditional-sum pass."""
    m = confusion_counts(df, label, prediction, by).select(*report_columns(by))
    r = lambda c: F.round(F.col(c), digits)
    null = F.lit(None).cast("double")
    rows = [
        (F.lit(ON_TIME), r("precision_0"), r("recall_0"), r("f1_0"), F.col("support_0")),
        (F.lit(LATE), r("precision_1"), r("recall_1"), r("f1_1"), F.col("support_1")),
        (F.lit("accuracy"), null, null, r("accuracy"), F.col("support")),
        (F.lit("macro avg"), r("macro_precision"), r("macro_recall"), r("macro_f1"), F.col("support")),
        (F.lit("weighted avg"), r("weighted_precision"), r("weighted_recall"), r("weighted_f1"), F.col("support")),
    ]
    structs = [F.struct(a.alias("class"), b.alias("precision"), c.alias("recall"), d.alias("f1"), e.alias("support"))
               for a, b, c, d, e in rows]
    return m.select(*by, F.explode(F.array(*structs)).alias("_r")).select(*by, "_r.*")


def delay_histogram(df: DataFrame, width: float = 5.0, delay: str = "delay_minutes") -> DataFrame:
    """Counts per delay bin [k*w, (k+1)*w); NULL and NaN delays have no bin."""
    b = F.floor(F.col(delay) / F.lit(float(width))).cast("bigint")
    return (df.where(F.col(delay).isNotNull() & ~F.isnan(F.col(delay).cast("double"))).groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n_trips"))
              .withColumn("bin_start", F.col("bin") * F.lit(float(width))))


def route_performance(df: DataFrame, label: str = "label", delay: str = "delay_minutes") -> DataFrame:
    """Late rate, mean delay and trips per route."""
    known = F.when(~F.isnan(F.col(delay).cast("double")), F.col(delay))  # NaN is a missing delay
    return df.groupBy("route").agg(F.avg(label).alias("late_rate"), F.avg(known).alias("mean_delay"),
                                   F.count(F.lit(1)).alias("n_trips"))


def factor_lift(df: DataFrame, factors: Sequence[str], label: str = "label") -> DataFrame:
    """Late rate per level of each factor minus the overall late rate.

    Factor/level pairs are exploded once so all factors share one scan and
    one shuffle; the overall rate comes from the aggregated rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"),
                                         F.coalesce(F.col(f).cast("string"), F.lit("NA")).alias("level"))
                                for f in factors]))
    g = (df.select(pairs.alias("_p"), F.col(label).alias("_y")).select("_p.factor", "_p.level", "_y")
           .groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n_trips"), F.sum("_y").alias("_late")))
    per_factor = Window.partitionBy("factor")  # levels of one factor: aggregated rows
    overall = F.sum("_late").over(per_factor) / F.sum("n_trips").over(per_factor)
    rate = F.col("_late") / F.col("n_trips")
    return g.select("factor", "level", "n_trips", rate.alias("late_rate"), (rate - overall).alias("late_rate_change"))
