"""One-hot encoding without the first category, and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_feature, flag
from ..roles import DEFAULT_LIMITS, Limits
from ..scale import indexed, lookup, materialise


def category_table(df: DataFrame, column: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Distinct values as text with their rank in text order; null reads as 'nan'."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    distinct = materialise(df.select(text.alias("category")).distinct(), "categories")
    return materialise(indexed(distinct, ["category"], "slot", limits), "category-index")


def one_hot_columns(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """A 0/1 column per category but the first; a value outside the list gives zeros only.

    For a few known categories: columns are part of the plan.  ``DropFirstEncoding`` takes any number.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    return df.select("*", *[flag(text == c).alias(f"{column}_{c}") for c in sorted(categories)[1:]])


@dataclass
class DropFirstEncoding:
    """A fitted encoding of one column: categories live in a table, not on the driver."""

    column: str
    categories: DataFrame
    size: int
    limits: Limits = DEFAULT_LIMITS

    @classmethod
    def fit(cls, df: DataFrame, column: str, limits: Limits = DEFAULT_LIMITS) -> "DropFirstEncoding":
        table = category_table(df, column, limits)
        return cls(column, table, table.count(), limits)

    @property
    def output(self) -> str:
        return f"{self.column}_onehot"

    def names(self) -> DataFrame:
        """Feature name per vector position."""
        return self.categories.filter("slot > 0").select(
            (F.col("slot") - 1).alias("position"),
            F.concat_ws("_", F.lit(self.column), "category").alias("feature"),
        )

    def positions(self, df: DataFrame) -> DataFrame:
        """Append the vector position of each row's category; null for the first and for unknown ones."""
        coded = df.withColumn("category", F.coalesce(F.col(self.column).cast("string"), F.lit("nan")))
        coded = lookup(coded, self.categories, ["category"], self.limits)
        position = F.when(F.col("slot") > 0, F.col("slot") - 1)
        return coded.select(*df.columns, position.alias(f"{self.column}_position"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Append a sparse vector of length size - 1.

        The first category and unknown values share the last slot, which the
        encoder leaves out, so both come out as all zeros.
        """
        if self.size < 2:
            return df
        coded = self.positions(df)
        slot = F.coalesce(F.col(f"{self.column}_position"), F.lit(self.size - 1)).cast("double")
        meta = {"ml_attr": {"type": "nominal", "num_vals": self.size}}
        coded = coded.select(*df.columns, slot.alias("__slot", metadata=meta))
        encoder = OneHotEncoder(inputCol="__slot", outputCol=self.output, dropLast=True)
        return encoder.fit(coded).transform(coded).drop("__slot")


NAMES = "feature_index int, feature string"


def feature_names(spark: SparkSession, features: Sequence[str], encodings: Sequence[DropFirstEncoding] = ()) -> DataFrame:
    """(feature_index, feature) for every position of a vector that ``assemble`` builds; categories stay in their tables."""
    names, base = spark.createDataFrame(list(enumerate(features)), NAMES), len(features)
    for encoding in encodings:
        names = names.unionByName(encoding.names().select((F.col("position") + base).cast("int").alias("feature_index"), "feature"))
        base += max(0, encoding.size - 1)
    return materialise(names, "feature-names") if encodings else names


def name_table(spark: SparkSession, names: Sequence[str] | DataFrame) -> DataFrame:
    return names if isinstance(names, DataFrame) else feature_names(spark, names)


def fit_encodings(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> list[DropFirstEncoding]:
    return [DropFirstEncoding.fit(df, c, limits) for c in columns]


def assemble(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    keep: Sequence[str] = (),
    encodings: Sequence[DropFirstEncoding] = (),
) -> DataFrame:
    """(keep..., label, features): the numeric block, then the one-hot blocks, as one vector."""
    for encoding in encodings:
        df = encoding.transform(df)
    blocks = [e.output for e in encodings if e.size > 1]
    kept = [F.col(c) for c in keep]
    if label is not None:
        kept.append(F.col(label).cast("double").alias("label"))
    flat = df.select(*kept, *blocks, *[as_feature(c).alias(f"f_{c}") for c in features])
    assembler = VectorAssembler(
        inputCols=[*[f"f_{c}" for c in features], *blocks], outputCol="features", handleInvalid="error"
    )
    names = [*keep, *(["label"] if label is not None else []), "features"]
    return assembler.transform(flat).select(*names)
