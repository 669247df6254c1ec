"""Labelled feature tables.

Every model operator works on one shape::

    id        long or string   unique row key (drives every seeded draw)
    label     int              class
    features  array<double>    feature vector

This module reads files into that shape (IO1), projects existing tables into
it (IO3), converts the label-last matrix layout (IO4), and provides adapters
for the tables used by the query catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("features", T.ArrayType(T.DoubleType()), True),
])

# String classes are numbered by their position in these lists.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
RETURN_FLAGS = ["A", "N", "R"]
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_index(col, values: list[str]) -> Column:
    """Position of a string class in ``values`` (0-based); NULL if absent."""
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(_c(col) == F.lit(v), F.lit(i)) if expr is None
                else expr.when(_c(col) == F.lit(v), F.lit(i)))
    return expr.cast("int")


def to_labeled(df: DataFrame, id_col, label_col, feature_cols, label_values: list[str] | None = None) -> DataFrame:
    """Project a table into ``(id, label, features)`` (IO3).

    A numeric label is truncated to int, NULL where it is no number or out of
    range; a string label is numbered through ``label_values``.
    """
    if label_values is not None:
        label = label_index(label_col, label_values)
    else:
        label = _c(label_col).try_cast("double").try_cast("int")
    feats = F.array(*[_c(c).cast("double") for c in feature_cols])
    return df.select(_c(id_col).alias("id"), label.alias("label"), feats.alias("features"))


def from_matrix(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Label-last matrix layout into the labelled shape (IO4).

    Every column but the last (and ``id_col``) is a feature; the last column
    is the label.  Without ``id_col`` the result has no ``id`` column.
    """
    cols = [c for c in df.columns if c != id_col]
    feats, label = cols[:-1], cols[-1]
    out = [F.col(label).try_cast("double").try_cast("int").alias("label"),
           F.array(*[F.col(c).cast("double") for c in feats]).alias("features")]
    if id_col is not None:
        out.insert(0, F.col(id_col).alias("id"))
    return df.select(*out)


def read_labeled_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Headerless CSV ``id,label,f1..fn`` into the labelled shape (IO1).

    Declared schema (never inferred); tolerant of a UTF-8 BOM, trailing blanks
    and CRLF line ends.  Malformed numbers read as NULL.
    """
    schema = T.StructType(
        [T.StructField("id", T.LongType(), True), T.StructField("label", T.DoubleType(), True)]
        + [T.StructField(f"f{i + 1}", T.DoubleType(), True) for i in range(n_features)])
    raw = (spark.read.schema(schema)
           .option("header", "false")
           .option("sep", ",")
           .option("encoding", "UTF-8")
           .option("ignoreLeadingWhiteSpace", "true")
           .option("ignoreTrailingWhiteSpace", "true")
           .option("mode", "PERMISSIVE")
           .csv(path))
    return to_labeled(raw, "id", "label", [f"f{i + 1}" for i in range(n_features)])


REASONS = ("columns", "id", "label", "feature")


def parse_labeled_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Every line of a headerless CSV ``id,label,f1..fn``, with what is wrong with it (IO1).

    ``reason`` is NULL for a line that reads as ``read_labeled_csv`` reads it;
    else the first of ``columns`` (too few or too many), ``id``, ``label`` and
    ``feature`` (no number there), and ``record`` holds the line (without the
    blanks around its fields where the number of columns is right).
    """
    names = ["id", "label", *(f"f{i + 1}" for i in range(n_features))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_line"]])
    raw = (spark.read.schema(schema)
           .option("header", "false")
           .option("sep", ",")
           .option("encoding", "UTF-8")
           .option("ignoreLeadingWhiteSpace", "true")
           .option("ignoreTrailingWhiteSpace", "true")
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_line")
           .csv(path))
    first = F.regexp_replace(names[0], "^\ufeff", "")  # a byte order mark
    row_id, label = first.try_cast("bigint"), F.col("label").try_cast("double").try_cast("int")
    feats = F.array(*[F.col(n).try_cast("double") for n in names[2:]])
    reason = (F.when(F.col("_line").isNotNull(), "columns").when(row_id.isNull(), "id").when(label.isNull(), "label")
              .when(F.exists(feats, lambda x: x.isNull()), "feature"))
    line = F.coalesce(F.col("_line"), F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    return raw.select(row_id.alias("id"), label.alias("label"), feats.alias("features"), reason.alias("reason"),
                      line.alias("_text")).select("id", "label", "features", "reason",
                                                  F.when(F.col("reason").isNotNull(), F.col("_text")).alias("record"))


def good_and_rejected(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labelled rows, and the rejected lines ``(reason, record)``, of ``parse_labeled_csv``."""
    return (parsed.where("reason IS NULL").select("id", "label", "features"),
            parsed.where("reason IS NOT NULL").select("reason", "record"))


def reason_counts(parsed: DataFrame) -> DataFrame:
    """Lines by reason, ``good`` for the labelled ones: ``(reason, n)``."""
    return parsed.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def feature_columns(df: DataFrame, n_features: int, prefix: str = "f") -> DataFrame:
    """Spread the feature array into ``f1..fn`` double columns."""
    rest = [c for c in df.columns if c != "features"]
    return df.select(*rest, *[F.col("features")[i].alias(f"{prefix}{i + 1}") for i in range(n_features)])


# ---------------------------------------------------------------------------
# Adapters for the driver tables
# ---------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embeddings_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings``: 64-d float vectors with 10 integer classes."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"),
                     F.col("embedding").cast("array<double>").alias("features"))


def events_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: class = event type, features = (value, user_id)."""
    return to_labeled(table(spark, sf_dir, "events"), "event_id", "event_type", ["value", "user_id"],
                      label_values=EVENT_TYPES)


def lineitem_id() -> Column:
    """Row key of ``lineitem``: (l_orderkey, l_partkey, l_suppkey, l_linenumber)."""
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def lineitem_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem``: class = return flag, four numeric features."""
    return to_labeled(table(spark, sf_dir, "lineitem"), lineitem_id(), "l_returnflag", LINEITEM_FEATURES,
                      label_values=RETURN_FLAGS)
