"""Column repair: number-like text, missing values, quasi-constant columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.core import bounded_rows, is_missing, known, ratio, string_columns
from scoreflow.operators.profile import medians, missing_profile, mode_profile

# The text formats, in the order they are tried.
FORMATS = {
    "standard": r"^[-+]?\d{1,3}(,\d{3})*(\.\d+)?$|^[-+]?\d+\.\d+$",
    "brazilian": r"^[-+]?\d{1,3}(\.\d{3})*(,\d+)?$|^[-+]?\d+,\d+$",
    "currency": r"^[-+]?(R\$|\$|€|£)\s?[-+]?[\d,.]*\d$",
    "percentage": r"^[-+]?[\d,.]*\d%$",
    "scientific": r"^[-+]?[\d,.]*\d[Ee][-+]?\d+$",
    "other_numeric": r"^[-+]?\d+$",
}
# A number as the cast reads it. Tested first: a failed cast costs an exception per value.
PLAIN = r"^[-+]?(\d+\.?\d*|\.\d+)([Ee][-+]?\d+)?$"


def marked_number(col: Column) -> Column:
    """Digits with at least one ``.`` or ``,`` (and any ``-``), as V1 recognises a number."""
    bare = F.translate(col, ".,-", "")
    return bare.rlike(r"^\d+$") & col.rlike("[.,]")


def _plain_number(text: Column) -> Column:
    return F.when(text.rlike(PLAIN), text.try_cast("double"))


def comma_number(col: Column) -> Column:
    """``1.234,56`` as double: drop points, the comma is the decimal mark, either sign."""
    return _plain_number(F.translate(col, ",.", "."))


def point_number(col: Column) -> Column:
    """``1,234.56`` as double."""
    return _plain_number(F.translate(col, ",", ""))


def _examples(col: Column, number: int) -> Column:
    """Up to ``number`` (five at most) different values that do not depend on partitioning."""
    text, turned = F.md5(col), F.md5(F.reverse(col))
    picks = [F.min(col), F.max(col), F.min_by(col, text), F.max_by(col, text), F.min_by(col, turned)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*picks[:number]))))


def numeric_string_report(df: DataFrame, min_rate: float = 0.8) -> DataFrame:
    """V3 for V1: total, number-like values, rate and up to 3 examples per text column."""
    cols = string_columns(df)
    hit = lambda c: F.coalesce(marked_number(F.col(c)), F.lit(False))
    wide = df.agg(*[
        F.struct(F.count(c).alias("total"), F.count_if(hit(c)).alias("numeric"),
                 _examples(F.when(hit(c), F.col(c)), 3).alias("examples")).alias(c) for c in cols])
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])).alias("r"))
    rate = ratio(F.col("numeric"), F.col("total"))
    return rows.select("r.feature", "r.s.*").withColumn("rate", rate).withColumn(
        "converted", F.coalesce(F.col("rate") > min_rate, F.lit(False)))


def convert_numeric_strings(df: DataFrame, min_rate: float = 0.8) -> DataFrame:
    """V1: text columns that are mostly Brazilian-format numbers become double.

    The rates of all text columns come from one pass over all rows.
    """
    if not string_columns(df):
        return df
    report = numeric_string_report(df, min_rate)
    hits = bounded_rows(report.filter("converted").select("feature"), len(df.columns), "columns")
    return df.withColumns({h["feature"]: comma_number(F.col(h["feature"])) for h in hits})


def number_format(col: Column) -> Column:
    """The name of the first format the trimmed text matches, else null."""
    text, kind = F.trim(col), None
    for name, pattern in FORMATS.items():
        hit = text.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


def _digits(col: Column) -> Column:
    """Text without currency marks, spaces and percent signs (safe once a format matched)."""
    return F.translate(col, "R$€£ %", "")


def _decimal_sign(text: Column, mark: str, other: str) -> Column:
    """Does the text show that ``mark`` is decimal: it occurs once, behind every ``other``,
    and either both occur or it is not followed by exactly three digits."""
    tail = F.substring_index(text, mark, -1)
    once = (F.length(text) - F.length(F.translate(text, mark, ""))) == 1
    grouped = F.contains(text, F.lit(other))
    return once & ~F.contains(tail, F.lit(other)) & (grouped | (F.length(tail) != 3))


def any_number(col: Column, comma_decimal: bool) -> Column:
    """A number in any of the formats; the decimal mark is that of the whole column."""
    text = _digits(col)
    number = comma_number(text) if comma_decimal else point_number(text)
    number = F.when(F.trim(col).endswith("%"), number / 100).otherwise(number)
    return F.when(number_format(col).isNotNull(), number)


def numeric_column_report(df: DataFrame, min_rate: float = 0.7,
                          max_null: float = 0.3) -> DataFrame:
    """V3 for V2: per text column the count of each format, five examples, decimal mark, outcome."""
    cols = string_columns(df)

    def signs(i: int, c: str) -> list[Column]:
        """The format and the decimal-mark evidence of one value, worked out once per value.

        Plain columns, not one struct: Spark would unfold a struct into every aggregate.
        """
        text, kind = _digits(F.col(c)), number_format(F.col(c))
        bad = lambda t: ~F.coalesce(t.rlike(PLAIN), F.lit(False))
        flags = {"comma": _decimal_sign(text, ",", "."), "point": _decimal_sign(text, ".", ","),
                 "lost_comma": bad(F.translate(text, ",.", ".")),
                 "lost_point": bad(F.translate(text, ",", ""))}
        return [F.when(F.col(c).isNotNull(), F.coalesce(kind, F.lit("none"))).alias(f"k{i}"),
                F.col(c).alias(f"v{i}"),
                *[flag.alias(f"{name}{i}") for name, flag in flags.items()]]

    def stats(i: int, c: str) -> Column:
        kind = F.col(f"k{i}")
        matched = kind != "none"
        return F.struct(
            F.count(kind).alias("total"), F.count_if(matched).alias("numeric"),
            F.count_if(kind == "none").alias("not_numeric"),
            _examples(F.when(matched, F.col(f"v{i}")), 5).alias("examples"),
            *[F.count_if(kind == k).alias(k) for k in FORMATS],
            F.count_if(F.col(f"comma{i}") & matched).alias("comma_marks"),
            F.count_if(F.col(f"point{i}") & matched).alias("point_marks"),
            F.count_if((kind == "none") | (F.col(f"lost_comma{i}") & matched)).alias("null_comma"),
            F.count_if((kind == "none") | (F.col(f"lost_point{i}") & matched)).alias("null_point"),
        ).alias(c)

    seen = df.select(*[s for i, c in enumerate(cols) for s in signs(i, c)])
    wide = seen.agg(*[stats(i, c) for i, c in enumerate(cols)])
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])).alias("r"))
    comma = F.col("comma_marks") > F.col("point_marks")
    lost = F.when(comma, F.col("null_comma")).otherwise(F.col("null_point"))
    out = rows.select("r.feature", "r.s.*").withColumns({
        "rate": ratio(F.col("numeric"), F.col("total")),
        "decimal_mark": F.when(comma, ",").otherwise("."),
        "new_null_rate": ratio(lost, F.col("total"))})
    outcome = (F.when(F.col("total") == 0, "empty")
               .when(F.col("rate") <= min_rate, "ignored")
               .when(F.col("new_null_rate") >= max_null, "reverted").otherwise("converted"))
    return out.withColumn("outcome", outcome).drop(
        "comma_marks", "point_marks", "null_comma", "null_point")


def convert_numeric_columns(df: DataFrame, min_rate: float = 0.7,
                            max_null: float = 0.3) -> DataFrame:
    """V2: text columns in plain, Brazilian, currency, percent or scientific format to double.

    A column that would lose too many values keeps its original text.
    """
    if not string_columns(df):
        return df
    report = numeric_column_report(df, min_rate, max_null)
    hits = bounded_rows(report.filter(F.col("outcome") == "converted")
                        .select("feature", "decimal_mark"), len(df.columns), "columns")
    return df.withColumns({
        h["feature"]: any_number(F.col(h["feature"]), h["decimal_mark"] == ",") for h in hits})


def missing_filter(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    """V5: report rows (feature, test, status, value) on the missing ratio of each column."""
    table = missing_profile(df, cols)
    return _report(table, "missing", F.col("missing_ratio"), F.col("missing_ratio") > limit)


def mode_filter(df: DataFrame, cols: Sequence[str], limit: float = 0.9,
                drop_constant: bool = False) -> DataFrame:
    """V6: report rows on the mode share; only columns with more than one value are dropped."""
    table = mode_profile(df, cols)
    out = (F.col("mode_share") > limit) & (F.col("n_distinct") > 1)
    if drop_constant:
        out = out | (F.col("n_distinct") <= 1)
    return _report(table, "mode", F.col("mode_share"), out)


def _report(table: DataFrame, test: str, value: Column, removed: Column) -> DataFrame:
    status = F.when(removed, "removed").otherwise("kept")
    return table.select("feature", F.lit(test).alias("test"), status.alias("status"),
                        value.cast("double").alias("value"))


def kept(report: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns without a ``removed`` row in a report, in their given order."""
    rows = bounded_rows(report.filter(F.col("status") == "removed").select("feature").distinct(),
                        len(cols), "removed columns")
    gone = {r["feature"] for r in rows}
    return [c for c in cols if c not in gone]


def drop_missing_columns(df: DataFrame, limit: float = 0.3,
                         cols: Sequence[str] | None = None) -> DataFrame:
    """V5: drop the columns whose missing ratio is above the limit."""
    cols = list(cols) if cols is not None else df.columns
    stay = kept(missing_filter(df, cols, limit), cols)
    return df.drop(*[c for c in cols if c not in stay])


def drop_constant_columns(df: DataFrame, limit: float = 0.9,
                          cols: Sequence[str] | None = None,
                          drop_constant: bool = False) -> DataFrame:
    """V6: drop quasi-constant columns."""
    cols = list(cols) if cols is not None else df.columns
    stay = kept(mode_filter(df, cols, limit, drop_constant), cols)
    return df.drop(*[c for c in cols if c not in stay])


def fill_values(df: DataFrame, cols: Sequence[str], strategy: str = "mean") -> dict[str, float]:
    """V7: the mean or exact median of each column, one number per column."""
    if strategy == "mean":
        row = df.agg(*[F.avg(known(df, c)).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "median":
        rows = bounded_rows(medians(df, cols), len(cols), "medians")
        return {r["feature"]: r["median"] for r in rows}
    raise ValueError(f"unknown strategy {strategy!r}: mean or median")


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean",
           values: dict[str, float] | None = None) -> DataFrame:
    """V7: replace missing values; pass ``values`` learned elsewhere to reuse them."""
    values = values if values is not None else fill_values(df, cols, strategy)
    return df.withColumns({
        c: F.when(is_missing(df, c), F.lit(values.get(c))).otherwise(F.col(c).cast("double"))
        for c in cols})
