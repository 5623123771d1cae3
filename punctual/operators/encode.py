"""Feature encoding as Spark ML pipeline stages (M1-M6).

* One-hot: ``StringIndexer(handleInvalid="keep", alphabetAsc)`` puts unseen
  levels in an extra last slot, which ``OneHotEncoder(dropLast=True)`` drops,
  so an unknown level encodes as all zeros (M1).  ``drop_first`` also removes
  the alphabetically first level (M2).
* Scaling uses the population standard deviation (zero std -> 1), fitted by
  one aggregate and embedded as literals in a ``SQLTransformer`` stage, so the
  whole pipeline saves and loads as one ``PipelineModel`` (M3, M4).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class ScalerStats:
    col: str
    mean: float
    std: float


def fit_scaler(df: DataFrame, cols: Sequence[str], with_mean: bool = True) -> list[ScalerStats]:
    """Mean and population std of each column in one aggregate pass."""
    if not cols:
        return []
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = []
    for c in cols:
        m = row[f"m_{c}"] if with_mean else 0.0
        s = row[f"s_{c}"]
        out.append(ScalerStats(c, float(m or 0.0), float(s) if s else 1.0))
    return out


def scaler_stage(stats: Sequence[ScalerStats], suffix: str = "_scaled") -> SQLTransformer:
    """(x - mean) / std per column as a persisted SQL stage."""
    exprs = ", ".join(f"(CAST(`{s.col}` AS DOUBLE) - CAST({s.mean!r} AS DOUBLE)) / CAST({s.std!r} AS DOUBLE) "
                      f"AS `{s.col}{suffix}`" for s in stats)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__" if exprs else "SELECT * FROM __THIS__")


def scale_columns(df: DataFrame, stats: Sequence[ScalerStats], suffix: str = "") -> DataFrame:
    """Apply fitted stats directly (no pipeline)."""
    return df.withColumns({f"{s.col}{suffix}": (F.col(s.col).cast("double") - F.lit(s.mean)) / F.lit(s.std)
                           for s in stats})


@dataclass
class EncodingSpec:
    categorical: list[str]
    numeric: list[str]
    drop_first: bool = False
    with_mean: bool = True
    features_col: str = "features"


def encoding_stages(train: DataFrame, spec: EncodingSpec) -> list:
    """Stages (estimators and fitted scaler) that turn raw columns into a
    feature vector; categorical slots first, then numeric, like the
    reference's column routing (M5)."""
    stages: list = []
    ohe_cols = [f"{c}__ohe" for c in spec.categorical]
    if spec.categorical:
        # one multi-column indexer/encoder: all vocabularies in a single pass
        idx_cols = [f"{c}__idx" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=list(spec.categorical), outputCols=idx_cols, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True))
    stats = fit_scaler(train, spec.numeric, spec.with_mean)
    stages.append(scaler_stage(stats))
    num_cols = [f"{c}_scaled" for c in spec.numeric]
    raw = spec.features_col if not spec.drop_first else f"{spec.features_col}__all"
    stages.append(VectorAssembler(inputCols=ohe_cols + num_cols, outputCol=raw, handleInvalid="error"))
    return stages


def _drop_first_stage(model: PipelineModel, spec: EncodingSpec) -> Transformer:
    """M2: slice off the first level of each categorical block."""
    keep, offset = [], 0
    for c, size in zip(spec.categorical, category_sizes(model, spec)):
        keep += list(range(offset + 1, offset + size))
        offset += size
    keep += list(range(offset, offset + len(spec.numeric)))
    return VectorSlicer(inputCol=f"{spec.features_col}__all", outputCol=spec.features_col, indices=keep)


def category_levels(model: PipelineModel) -> dict[str, list[str]]:
    """Learned levels per categorical column, alphabetical (M6)."""
    out = {}
    for st in model.stages:
        if st.__class__.__name__ == "StringIndexerModel":
            if st.isSet("inputCols"):
                for c, labels in zip(st.getInputCols(), st.labelsArray):
                    out[c] = list(labels)
            else:
                out[st.getInputCol()] = list(st.labels)
    return out


def category_sizes(model: PipelineModel, spec: EncodingSpec) -> list[int]:
    levels = category_levels(model)
    return [len(levels[c]) for c in spec.categorical]


def dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, level, slot): the levels of each column in order, numbered on the executors (M1, M6).

    Levels are range-partitioned; a level's slot is its place in its partition
    plus the number of levels of its column in the partitions before.
    """
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level"))
    levels = df.select(F.explode(F.array(*[pair(c) for c in cols])).alias("x")).select("x.*").where("level IS NOT NULL").distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that the partition numbers hold for both uses.
    placed = levels.repartitionByRange(parts, "column_name", "level").withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.partitionBy("column_name").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("column_name", "_p").agg(F.count(F.lit(1)).alias("_n"))
               .select("column_name", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("column_name", "_p").orderBy("level"))
    return (placed.withColumn("_place", place).join(offsets, ["column_name", "_p"])
            .select("column_name", "level", (F.col("_before") + F.col("_place") - 1).cast("int").alias("slot")))


def feature_names(model: PipelineModel, spec: EncodingSpec) -> list[str]:
    """Names of the vector slots: '<col>_<level>' then numeric names."""
    levels = category_levels(model)
    names = []
    for c in spec.categorical:
        lv = levels[c][1:] if spec.drop_first else levels[c]
        names += [f"{c}_{v}" for v in lv]
    return names + list(spec.numeric)


def fit_encoder(train: DataFrame, spec: EncodingSpec) -> PipelineModel:
    """Fitted encoding pipeline (without a classifier)."""
    model = Pipeline(stages=encoding_stages(train, spec)).fit(train)
    if spec.drop_first:
        model = PipelineModel(stages=list(model.stages) + [_drop_first_stage(model, spec)])
    return model
