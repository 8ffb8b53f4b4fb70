"""Lists of records with owners and times: newest or oldest first, one of each group, lookups by id.

Records are tables of any columns; the names of owner, time and id columns are arguments.
Ids break ties, so every order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_first(rows: DataFrame, at: str, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc())


def oldest_first(rows: DataFrame, at: str, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(at).asc_nulls_last(), F.col(key).asc())


def owned(rows: DataFrame, owner: str, value) -> DataFrame:
    """The rows of one owner."""
    return rows.where(F.col(owner) == value)


def one_owned(rows: DataFrame, owner: str, value, key: str, wanted) -> DataFrame:
    """The row of an id if it is the owner's, else no row: others' rows look as if they were not there."""
    return owned(rows, owner, value).where(F.col(key) == wanted).limit(1)


def latest(rows: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """The newest row of each group; of equal times the greater key."""
    return _one(rows, by, F.max_by, at, key)


def oldest(rows: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """The oldest row of each group; of equal times the lesser key."""
    return _one(rows, by, F.min_by, at, key)


def _one(rows: DataFrame, by: list[str], pick, at: str, key: str) -> DataFrame:
    """One row of each group by aggregation, so that a large group is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    found = rows.groupBy(*by).agg(pick(F.struct(*rest), F.struct(at, key)).alias("_row"))
    return found.select(*by, "_row.*").select(*rows.columns)


def with_types(rows: DataFrame, types: DataFrame, on: str, type_id: str, name: str) -> DataFrame:
    """Rows with the name of their type; rows without a known type are left out."""
    known = types.select(F.col(type_id).alias("_type"), F.col(name).alias("type_name"))
    return rows.join(known, F.col(on) == F.col("_type")).drop("_type")


def resolve(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of these ids in the order in which they are asked for; raises if some are missing."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(dict.fromkeys(wanted))], f"_turn int, _asked {kind}")
    missing = [r["_asked"] for r in missing_ids(rows, key, asked).orderBy("_turn").collect()]  # at most as many as were asked for
    if missing:
        raise ValueError(f"unknown ids {missing}")
    return rows.join(F.broadcast(asked), F.col(key) == F.col("_asked")).orderBy("_turn").select(*rows.columns)  # what the caller listed


def missing_ids(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (_turn, _asked) whose id no row has."""
    return asked.join(rows.select(key), F.col("_asked") == F.col(key), "left_anti")


def flag_counts(rows: DataFrame, flag: str) -> DataFrame:
    """One row (active, inactive); null counts as inactive."""
    on = F.coalesce(F.col(flag), F.lit(False))
    return rows.agg(F.count_if(on).alias("active"), F.count_if(~on).alias("inactive"))


def orphans(rows: DataFrame, of: str, link: str) -> DataFrame:
    """The distinct ``of`` of rows whose ``link`` is null."""
    return rows.where(F.col(link).isNull() & F.col(of).isNotNull()).select(of).distinct()


def union_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables under all their columns; what a table lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def json_rows(rows: DataFrame) -> DataFrame:
    """(json) of each row with every column: NaN and null as null, dates and times in ISO form, other kinds as JSON or text."""
    shown = []
    for c, t in rows.dtypes:
        col = F.col("`" + c.replace("`", "``") + "`")
        if t in ("double", "float"):
            col = F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)
        elif t in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        elif t == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif t == "binary" or "interval" in t:
            col = col.cast("string")
        shown.append(col.alias(c))
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def decoded(column: str, schema: str, default: str):
    """A JSON column read by a schema; what is null or damaged gives the default, such as [] or {}."""
    return F.coalesce(F.from_json(column, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit(default), schema))
