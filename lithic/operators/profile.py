"""Column and sheet profiles over value frequencies.

The rows of each column are first reduced to its distinct values with their counts. All
statistics then run over distinct values, weighted by count: predicates and patterns are
evaluated once per value, and only two small joins bring quantiles back for outliers. The
quantiles are exact. Up to BUFFERED distinct values of a column they come from one buffer,
beyond that from counted ranges, with equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.functions import types as ct
from lithic.operators import ranks
from lithic.operators.graph import cut

VERSION = "stats/1"
SAMPLES = 10
#: Distinct numbers of a column that one aggregation buffer may hold.
BUFFERED = 1_000_000


def frequencies(df: DataFrame, columns: list[str] | None = None, turn: str | None = None) -> DataFrame:
    """(ordinal, column, kind, value, n): distinct display values of each column with their counts; with ``turn`` also its least value as ``first``."""
    first = F.min(turn) if turn else F.lit(None).cast("long")
    kinds = dict(df.dtypes)
    parts = []
    for i, c in enumerate(columns or df.columns):
        kind = kinds[c]
        text = lambda x, dated=kind in ("timestamp", "timestamp_ntz", "date"): ct.iso(x) if dated else x.cast("string")
        family = "bool" if kind == "boolean" else "date" if kind in ("timestamp", "timestamp_ntz", "date") else "int" if kind in ("int", "bigint", "smallint", "tinyint") else "float" if kind in ("double", "float") else "text"
        # numbers and moments are counted before they are spelled; zeros of both signs are one number but two texts
        zero = F.when(ct.cell(c) == 0, text(ct.cell(c))) if family == "float" else F.lit(None).cast("string")
        own = ct.cell(c) if family in ("int", "float", "date") else text(ct.cell(c))
        counted = df.groupBy(own.alias("own"), zero.alias("zero")).agg(F.count("*").alias("n"), first.alias("first"))
        counted = counted.withColumn("value", F.coalesce("zero", text(F.col("own"))))
        if family == "date":  # several moments of a second are one text
            counted = counted.groupBy("value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        parts.append(counted.select(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(family).alias("kind"), "value", "n", *(["first"] if turn else [])))
    return reduce(DataFrame.unionByName, parts)


def _conforms(freq: DataFrame) -> DataFrame:
    value, kind = F.col("value"), F.col("kind")
    blank = F.when(kind == "text", ct.is_blank(value)).otherwise(value.isNull() | (value == "NaN"))
    text = kind == "text"
    number = F.when(kind.isin("int", "float"), value.try_cast("double")).when(kind == "bool", F.when(value == "true", 1.0).otherwise(0.0)).when(text, ct.to_number(value))
    return freq.select(
        "*",
        blank.alias("blank"),
        (kind == "bool").alias("as_boolean"),
        ((kind == "int") | ((kind == "float") & (number == F.floor(number))) | (text & ct.is_integer(value))).alias("as_integer"),
        (kind.isin("int", "float") | (text & ct.is_float(value))).alias("as_float"),
        ((kind == "date") | (text & ct.is_date(value))).alias("as_date"),
        F.when(~blank, number).alias("num"),
    )


def _weighted(on: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(on, n)), F.lit(0)).cast("long")


def column_profiles(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per column with counts, inferred type, numbers, outliers, pattern, bounds and rating.

    Columns of a table without rows are ``empty``.
    """
    names = columns or df.columns
    freq = _conforms(frequencies(df, columns)).persist()
    distinct = freq.where("num IS NOT NULL").groupBy("ordinal").count().agg(F.max("count")).first()[0] or 0
    buffered = distinct <= BUFFERED
    n, full = F.col("n"), ~F.col("blank")
    by = ["ordinal", "column"]
    types = ("boolean", "integer", "float", "date")
    hits = [_weighted(full & F.col(f"as_{t}"), n).alias(f"n_{t}") for t in types]
    patterns = [_weighted(full & (F.col("kind") == "text") & F.col("value").rlike(p), n).alias(f"p_{i}") for i, (_, p) in enumerate(ct.PATTERNS)]
    limits = F.lit(None).cast("boolean")
    for c, (lo, hi) in (bounds or {}).items():
        out = (F.col("num") < F.lit(lo if lo is not None else float("-inf"))) | (F.col("num") > F.lit(hi if hi is not None else float("inf")))
        limits = F.when(F.col("column") == c, out).otherwise(limits)
    base = freq.groupBy(*by).agg(
        F.sum(n).cast("long").alias("row_count"),
        _weighted(F.col("blank"), n).alias("null_count"),
        F.count(F.when(full, F.col("value"))).alias("distinct_count"),
        *hits,
        *patterns,
        _weighted(limits, n).alias("out_of_bounds"),
        F.count(F.when(limits.isNotNull(), 1)).alias("bounded"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        (F.sum(F.col("num") * n) / F.sum(F.when(F.col("num").isNotNull(), n))).alias("mean"),
        F.sum(F.when(F.col("num").isNotNull(), n)).alias("numbers"),
        (F.percentile("num", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n) if buffered else F.lit(None).cast("array<double>")).alias("q"),
        F.min(F.when(full & F.col("as_date"), F.col("value"))).alias("date_min"),
        F.max(F.when(full & F.col("as_date"), F.col("value"))).alias("date_max"),
    )
    if not buffered:
        numbers = cut(ranks.ranged(ranks.distinct(freq, by, F.col("num")), by))
        quartiles = cut(ranks.quantiles(numbers, by, (0.25, 0.5, 0.75)))
        base = base.drop("q").join(F.broadcast(quartiles), by, "left")  # a row per column
    base = base.select("*", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75")).drop("q")
    spread = freq.where("num IS NOT NULL").join(F.broadcast(base.select(*by, "mean", "p25", "median", "p75")), by)  # a row per column
    gap, iqr = F.abs(F.col("num") - F.col("median")), F.col("p75") - F.col("p25")
    fence = (iqr != 0) & ((F.col("num") < F.col("p25") - 1.5 * iqr) | (F.col("num") > F.col("p75") + 1.5 * iqr))
    around = spread.groupBy(*by).agg(
        F.sum(n * (F.col("num") - F.col("mean")) ** 2).alias("squares"),
        _weighted(fence, n).alias("iqr"),
        (F.sum(gap * n) / F.sum(n)).alias("mean_gap"),
        (F.percentile(gap, F.lit(0.5), n) if buffered else F.lit(None).cast("double")).alias("mad"),
    )
    if not buffered:
        centres = quartiles.select(*by, F.col("q")[1].alias("centre"))
        around = around.drop("mad").join(F.broadcast(cut(ranks.median_gap(numbers, by, centres))), by, "left")
    far = spread.join(F.broadcast(around.select(*by, "mad", "mean_gap")), by)
    odd = F.when(F.col("mad") != 0, 0.6745 * gap / F.col("mad") > 3.5).when(F.col("mean_gap") != 0, gap / (1.253314 * F.col("mean_gap")) > 3.5).otherwise(False)
    modified = far.groupBy(*by).agg(_weighted(odd, n).alias("modified"))
    if distinct:
        rows = base.join(around, by, "left").join(modified, by, "left")
    else:
        rows = base.select("*", *[F.lit(None).cast("double").alias(c) for c in ("squares", "mad", "mean_gap")], *[F.lit(None).cast("long").alias(c) for c in ("iqr", "modified")])
    filled = F.col("row_count") - F.col("null_count")
    kind, mismatch = F.lit("string"), F.lit(0).cast("long")
    for t in reversed(types):
        fits = F.col(f"n_{t}") >= ct.TYPE_SHARE * filled
        kind, mismatch = F.when(fits, t).otherwise(kind), F.when(fits, filled - F.col(f"n_{t}")).otherwise(mismatch)
    empty = filled == 0
    rows = rows.withColumn("semantic_type", F.when(empty, "empty").otherwise(kind)).withColumn("type_mismatch_count", F.when(empty, F.lit(0).cast("long")).otherwise(mismatch))
    shares = F.array(*[F.struct((F.col(f"p_{i}") / filled).alias("share"), F.lit(-i).alias("turn"), F.lit(name).alias("label")) for i, (name, _) in enumerate(ct.PATTERNS)])
    best = F.when((F.col("semantic_type") == "string") & ~empty, F.array_max(shares))
    shown = best["share"] >= ct.PATTERN_SHARE
    rows = rows.withColumn("pattern_label", F.when(shown, best["label"])).withColumn("pattern_pct", F.when(shown, best["share"] * 100))
    numeric = F.col("semantic_type").isin("integer", "float") & F.col("numbers").isNotNull()
    several = numeric & (F.col("numbers") >= 4)
    percent = lambda c: F.when(F.col("row_count") > 0, F.col(c) / F.col("row_count") * 100).otherwise(0.0)
    rows = rows.select(
        *by, "row_count", "null_count", percent("null_count").alias("null_pct"), "distinct_count", percent("distinct_count").alias("distinct_pct"), "semantic_type", "type_mismatch_count",
        *[F.when(numeric, F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "p25", "p75")],
        F.when(numeric, F.when(F.col("numbers") > 1, F.sqrt(F.col("squares") / (F.col("numbers") - 1))).otherwise(0.0)).alias("std"),
        F.when(several, F.col("iqr")).otherwise(0).cast("long").alias("outliers_iqr"),
        F.when(several, F.col("modified")).otherwise(0).cast("long").alias("outliers_mad"),
        F.when((F.col("bounded") > 0) & numeric, F.col("out_of_bounds")).alias("range_violations"),
        F.when(F.col("semantic_type") == "date", F.col("date_min")).alias("date_min"),
        F.when(F.col("semantic_type") == "date", F.col("date_max")).alias("date_max"),
        "pattern_label", "pattern_pct",
    )
    heads = df.sparkSession.createDataFrame(list(enumerate(names)), "ordinal int, column string")
    rows = heads.join(rows, by, "left").na.fill({"row_count": 0, "null_count": 0, "null_pct": 0.0, "distinct_count": 0, "distinct_pct": 0.0, "type_mismatch_count": 0, "outliers_iqr": 0, "outliers_mad": 0, "semantic_type": "empty"})
    return rows.withColumn("rag", column_rating())


def column_rating() -> Column:
    """Red, amber or green from a column's profile, the first rule that holds."""
    return (
        F.when((F.col("type_mismatch_count") > 0) | (F.coalesce("range_violations", F.lit(0)) > 0) | (F.col("null_pct") > 50), "red")
        .when((F.col("null_pct") > 20) | (F.col("pattern_pct") < 100) | (F.col("distinct_count") == 0) | (F.col("null_pct") >= 5), "amber")
        .otherwise("green")
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = SAMPLES) -> DataFrame:
    """(column, rank, value, n): the most frequent values; ties go to that seen first, by ``_row_index``, else to the smaller value."""
    turn = "_row_index" if "_row_index" in df.columns else None
    freq = _conforms(frequencies(df, [c for c in columns or df.columns if c != turn], turn)).where(~F.col("blank"))
    order = Window.partitionBy("ordinal", "column").orderBy(F.col("n").desc(), *([F.col("first")] if turn else []), "value")
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "rank", "value", F.col("n").cast("long").alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows have an equal row, all copies counted."""
    copies = df.groupBy(*[ct.cell(c) for c in df.columns]).count().where("count > 1")
    return copies.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(left, right) of columns that are equal in every row, nulls being equal; all pairs for no rows."""
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :] if dict(df.dtypes)[a] == dict(df.dtypes)[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string")
    sums = df.agg(*[F.sum(F.xxhash64(ct.cell(c)).cast("decimal(38,0)")).alias(str(i)) for i, c in enumerate(df.columns)]).first()  # equal columns have equal sums
    told = {c: sums[i] for i, c in enumerate(df.columns)}
    pairs = [(a, b) for a, b in pairs if told[a] == told[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string")
    checks = df.agg(*[F.coalesce(F.bool_and(ct.cell(a).eqNullSafe(ct.cell(b))), F.lit(True)).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.when(F.col(str(i)), F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"))) for i, (a, b) in enumerate(pairs)])
    return checks.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def sheet_profile(df: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
    """One row: counts, completeness and rating of a sheet."""
    wide = len(df.columns)
    totals = profiles.agg(F.coalesce(F.max("row_count"), F.lit(0)).cast("long").alias("row_count"), F.sum("null_count").alias("nulls"), F.max((F.col("rag") == "red").cast("int")).alias("red"), F.max((F.col("rag") == "amber").cast("int")).alias("amber"))
    rows = totals.crossJoin(F.broadcast(duplicate_rows(df)))  # one row each
    cells = F.col("row_count") * wide
    full = F.when(cells > 0, 100 - F.coalesce("nulls", F.lit(0)) / cells * 100).otherwise(100.0)
    rag = F.when((F.col("duplicate_rows") > 0) | (F.col("red") == 1), "red").when(F.col("amber") == 1, "amber").otherwise("green")
    return rows.select(F.lit(name).alias("sheet"), "row_count", F.lit(wide).cast("long").alias("column_count"), "duplicate_rows", full.alias("completeness_pct"), rag.alias("rag"))


def issues(profiles: DataFrame, sheet: str, duplicates: int = 0, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Issues that column profiles give rise to, and one for duplicate rows; ``bounds`` are shown in their texts."""
    limits = F.lit("")
    for c, (lo, hi) in (bounds or {}).items():
        shown = ", ".join("None" if x is None else repr(float(x)) for x in (lo, hi))
        limits = F.when(F.col("column") == c, f" [{shown}]").otherwise(limits)
    filled = F.col("row_count") - F.col("null_count")
    name = F.concat(F.lit("Column '"), F.col("column"), F.lit("'"))
    whole = lambda c: F.col(c).cast("string")
    nulls = F.concat(name, F.format_string(" is %.1f%% null (", "null_pct"), whole("null_count"), F.lit(" of "), whole("row_count"), F.lit(" rows)."))
    rules = [
        (F.col("null_pct") > 50, "completeness", "high", nulls),
        ((F.col("null_pct") > 20) & (F.col("null_pct") <= 50), "completeness", "medium", nulls),
        ((F.col("null_pct") >= 5) & (F.col("null_pct") <= 20), "completeness", "low", nulls),
        (F.col("type_mismatch_count") > 0, "consistency", "high", F.concat(name, F.lit(" was inferred as '"), F.col("semantic_type"), F.lit("' but "), whole("type_mismatch_count"), F.lit(" of "), filled.cast("string"), F.lit(" non-null values do not conform."))),
        (F.col("pattern_pct") < 100, "consistency", "medium", F.concat(name, F.lit(" looks like '"), F.col("pattern_label"), F.format_string("' (%.1f%% conformance); some values don't match the pattern.", "pattern_pct"))),
        (F.col("range_violations") > 0, "validity", "high", F.concat(name, F.lit(" has "), whole("range_violations"), F.lit(" value(s) outside the configured bounds"), limits, F.lit("."))),
        (F.col("outliers_iqr") > 0, "accuracy", "low", F.concat(name, F.lit(" has "), whole("outliers_iqr"), F.lit(" Tukey-IQR outlier(s) and "), whole("outliers_mad"), F.lit(" MAD outlier(s); investigate whether they are valid extremes."))),
        ((F.col("distinct_count") == 1) & (filled > 0), "uniqueness", "low", F.concat(name, F.lit(" has only one distinct value across "), filled.cast("string"), F.lit(" non-null rows; consider dropping."))),
    ]
    # The texts above are those that readers of reports know.
    drafts = F.array(*[F.when(on, F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("severity"), text.alias("description"))) for on, d, s, text in rules])
    found = profiles.select(F.lit(sheet).alias("sheet"), "column", F.inline(F.filter(drafts, lambda x: x.isNotNull())))
    if duplicates:
        text = f"Sheet '{sheet}' contains {duplicates} row(s) that appear more than once."
        found = found.unionByName(profiles.sparkSession.createDataFrame([(sheet, None, "uniqueness", "medium", text)], found.schema))
    return found


def _first(df: DataFrame, column: str, on: Column) -> DataFrame:
    """(value) of the first rows where a condition on ``value`` holds, by ``_row_index`` or else by value."""
    shown = ct.iso(ct.cell(column)) if dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz", "date") else ct.cell(column).cast("string")
    turn = F.col("_row_index") if "_row_index" in df.columns else F.lit(0)
    return df.select(shown.alias("value"), turn.alias("turn")).where(on).orderBy("turn", "value").limit(SAMPLES)


def samples(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(column, dimension, sample_values): up to ten cells behind each type and pattern issue.

    Only flagged columns are read again, each by a bounded ordered selection.
    """
    fits = {"integer": ct.is_integer, "float": ct.is_float, "date": ct.is_date}
    flagged = profiles.where("type_mismatch_count > 0 OR pattern_pct < 100").select("column", "semantic_type", "type_mismatch_count", "pattern_label").collect()  # a row per column
    value, parts = F.col("value"), []
    for r in flagged:
        if r.type_mismatch_count and r.semantic_type in fits:
            parts.append((r.column, "consistency", ~fits[r.semantic_type](value)))
        elif r.pattern_label:
            parts.append((r.column, "consistency", ~value.rlike(dict(ct.PATTERNS)[r.pattern_label])))
    found = df.sparkSession.createDataFrame([], "column string, dimension string, sample_values array<string>")
    for column, dimension, bad in parts:
        picked = _first(df, column, ~ct.is_blank(value) & bad).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "value"))), lambda x: x["value"]).alias("sample_values"))
        found = found.unionByName(picked.select(F.lit(column).alias("column"), F.lit(dimension).alias("dimension"), "sample_values"))
    return found


def column_pair_issues(pairs: DataFrame, sheet: str) -> DataFrame:
    """Issues for equal columns (left, right) or, with ``r``, for correlated ones; both names are the samples."""
    names = F.array("left", "right")
    if "r" in pairs.columns:
        text = F.format_string(f"Columns '%s' and '%s' on sheet '{sheet.replace('%', '%%')}' have Pearson r=%.3f (|r| >= 0.95); consider whether they are redundant.", "left", "right", "r")
    else:
        text = F.concat(F.lit(f"Sheet '{sheet}' has identical columns '"), F.col("left"), F.lit("' and '"), F.col("right"), F.lit("'; consider dropping one."))
    return pairs.select(F.lit(sheet).alias("sheet"), F.lit(None).cast("string").alias("column"), F.lit("redundancy").alias("dimension"), F.lit("medium").alias("severity"), text.alias("description"), names.alias("sample_values"))
