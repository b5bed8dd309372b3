"""Column helpers shared by every operator: missing tests, hashed keys, safe maths."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
# 16 hexadecimal digits of md5 are compared as text; four of them name one of 65,536 cells.
CELL_DIGITS = 4


def require_frame(df: object, name: str = "df") -> DataFrame:
    """Raise ``TypeError`` unless ``df`` is a Spark DataFrame."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} must be a pyspark.sql.DataFrame, got {type(df).__name__}")
    return df


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type can hold NaN."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def known(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN turned into null."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        col = F.when(~F.isnan(col), col)
    return col.cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The column in its own type, with NaN turned into null."""
    col = F.col(name)
    return F.when(~F.isnan(col), col) if isinstance(df.schema[name].dataType, FLOATING) else col


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String columns in schema order."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def hashed(id_col: str | Column, seed: int) -> Column:
    """md5 of ``id|seed``: a random order that does not depend on partitioning."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(col.cast("string"), F.lit(f"|{seed}")))


def uniform(id_col: str | Column, seed: int) -> Column:
    """a number in [0, 1) from the first eight hexadecimal digits of the hash."""
    digits = F.conv(F.substring(hashed(id_col, seed), 1, 8), 16, 10)
    return digits.cast("double") / F.lit(4294967296.0)


def hash_cell(hash_col: Column) -> Column:
    """The cell (0..65535) named by the leading digits of a hash."""
    return F.conv(F.substring(hash_col, 1, CELL_DIGITS), 16, 10).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """Division as double; null when the denominator is zero or null."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def sigmoid(col: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1.0 / (1.0 + F.exp(-col))


def month_of(col: str | Column) -> Column:
    """``yyyy-MM`` text of a date or timestamp."""
    return F.date_format(col, "yyyy-MM")


def edge_bin(col: Column, edges: Column) -> Column:
    """bin of a value among sorted edges; null is -1, (e[i-1], e[i]] is i."""
    return F.when(col.isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(edges, lambda e: e < col))
    )


def equal_width_bin(col: Column, low: Column, high: Column, bins: int) -> Column:
    """equal-width bin over [low, high], last bin closed; null stays null."""
    width = (high - low) / F.lit(float(bins))
    index = F.floor((col - low) / F.nullif(width, F.lit(0.0))).cast("int")
    return F.when(col.isNotNull(), F.coalesce(F.least(index, F.lit(bins - 1)), F.lit(0)))


def one_decimal(col: Column) -> Column:
    """Text with one decimal, rounded half away from zero."""
    return F.format_string("%.1f", F.round(col.cast("double"), 1))


def add_vectors(a: Column, b: Column) -> Column:
    """elementwise sum of two arrays of doubles."""
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled_difference(a: Column, b: Column, scale: Column) -> Column:
    """``scale * (b - a)`` elementwise: the step from one array towards another."""
    return F.zip_with(a, b, lambda x, y: scale * (y - x))


def band_label(low: Column, high: Column) -> Column:
    """the text ``min - max`` with one decimal."""
    return F.concat(one_decimal(low), F.lit(" - "), one_decimal(high))


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column) with the value as double and NaN as null."""
    typed = df.select(*keep, *[known(df, c).alias(c) for c in cols])
    return typed.unpivot(list(keep), list(cols), name, value)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result whose size is a parameter or a column count, never a row count.

    Raises instead of collecting more than ``limit`` rows.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, refusing to collect")
    return rows


def shared_folder(spark) -> str:
    """The folder for data between jobs: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    import tempfile

    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scoreflow-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, most: int = 65_536) -> tuple[DataFrame, int]:
    """The rows, checkpointed, in no more partitions than ``most`` rows each fill, and their number.

    A short table then costs the next steps a task or two, not one (and its files) for each partition.
    """
    df = checkpointed(df)
    rows = df.count()
    return df.coalesce(max(1, -(-rows // most))), rows


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder: several passes then read the columns they
    need, where a join would be shuffled again by each of them."""
    path = posixpath.join(shared_folder(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, most: int = 65_536) -> DataFrame:
    """A finished table of at most ``most`` rows is broadcast; Spark decides about a longer one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
