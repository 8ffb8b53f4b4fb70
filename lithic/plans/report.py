"""Reports of datasets and linkage runs, kept in a store: compute, carry decisions over, replace, list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.similarity import band
from lithic.functions.types import cell
from lithic.operators import cross, dashboard, linkage, profile
from lithic.plans import recommend
from lithic.sources.store import Store

VERSIONS = {"profile": profile.VERSION, "cross": "cross/1", "linkage": "linkage/1", "flag": "flag/1"}
DIMENSIONS = ("completeness", "consistency", "uniqueness", "validity", "accuracy", "redundancy")
STATES = ("suggested", "confirmed", "dismissed")
KEY = ["parent_table", "parent_column", "child_table", "child_column"]
RUNS = 20
ISSUE_LIMIT, MOST_SAMPLES, MOST_CHARS = 100, 20, 1000
ISSUE = "sheet string, column string, dimension string, severity string, description string, sample_values array<string>, sample_value_count int, engine_version string"


def _body(df: DataFrame) -> DataFrame:
    return df.drop("_row_index")


def bounds(store: Store, dataset: str) -> dict[str, dict[str, tuple[float | None, float | None]]]:
    """Configured bounds by sheet and column, a row per column."""
    got = store.load(dataset, "bounds", "bounds")
    out: dict = {}
    for r in got.collect() if got is not None else []:
        out.setdefault(r.sheet, {})[r.column] = (r.low, r.high)
    return out


def set_bounds(store: Store, dataset: str, sheet: str, column: str, low: float | None, high: float | None, sheets: dict[str, DataFrame] | None = None) -> None:
    """Bounds of a column; both None removes them. With the dataset's ``sheets`` it is profiled anew at once."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is above the upper one")
    number = lambda x: None if x is None else float(x)

    def changed() -> dict[str, DataFrame]:
        now = bounds(store, dataset)
        now.setdefault(sheet, {})[column] = (low, high)
        rows = [(s, c, number(lo), number(hi)) for s, cs in now.items() for c, (lo, hi) in cs.items() if (lo, hi) != (None, None)]
        return {"bounds": store.spark.createDataFrame(rows, "sheet string, column string, low double, high double")}

    store.update(dataset, "bounds", changed)
    if sheets is not None:
        profile_dataset(store, dataset, sheets)


def decide(store: Store, dataset: str, key: tuple[str, str, str, str], status: str, sheets: dict[str, DataFrame] | None = None) -> None:
    """Confirms, dismisses or reopens a suggested relationship. With the dataset's ``sheets`` it is profiled anew at once."""
    if status not in STATES:
        raise ValueError(f"unknown status {status!r}")
    found = store.load(dataset, "profile", "relationships")
    if found is None or not found.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(KEY, key, strict=True)])).take(1):
        raise ValueError(f"no relationship {key}")

    def changed() -> dict[str, DataFrame]:
        old = store.load(dataset, "decisions", "decisions")
        rows = {tuple(r[k] for k in KEY): r.status for r in old.collect()} if old is not None else {}  # made by hand, so few
        rows[key] = status
        return {"decisions": store.spark.createDataFrame([(*k, s) for k, s in rows.items() if s != "suggested"], ", ".join(f"{k} string" for k in [*KEY, "status"]))}

    store.update(dataset, "decisions", changed)
    if sheets is not None:
        profile_dataset(store, dataset, sheets)


def _issues(rows: DataFrame, version: str) -> DataFrame:
    if "sample_values" not in rows.columns:
        rows = rows.withColumn("sample_values", F.array().cast("array<string>"))
    known = F.coalesce("sample_values", F.array().cast("array<string>"))
    return rows.select("sheet", "column", "dimension", "severity", "description", known.alias("sample_values"), F.size(known).alias("sample_value_count"), F.lit(version).alias("engine_version"))


def profile_dataset(store: Store, dataset: str, sheets: dict[str, DataFrame]) -> None:
    """Profiles all sheets and their cross structure and replaces the dataset's tables.

    Bounds and decisions on relationships stay. Confirmed relationships that are suggested
    again give issues for values that the parent lacks. Issues that a person flagged stay,
    also those flagged while this runs; of two profiles at once the later one to end fails.
    """
    base = store.head(dataset, "profile")
    spark, limits = store.spark, bounds(store, dataset)
    columns, totals, issues, tops, dependencies, texts = [], [], [], [], [], {}
    for name, raw in sheets.items():
        df = _body(raw)
        if not df.columns:
            continue
        own = profile.column_profiles(df, limits.get(name)).persist()
        columns.append(own.withColumn("sheet", F.lit(name)))
        whole = profile.sheet_profile(df, own, name).persist()
        totals.append(whole)
        tops.append(profile.top_values(raw).withColumn("sheet", F.lit(name)))
        copies = whole.first()["duplicate_rows"]
        found = profile.issues(own, name, copies, limits.get(name))
        # The type issue is high and the pattern issue medium; a column has at most one of them.
        found = found.join(profile.samples(raw, own), ["column", "dimension"], "left")
        issues.append(_issues(found, VERSIONS["profile"]))
        issues.append(_issues(profile.column_pair_issues(profile.duplicate_columns(df), name), VERSIONS["profile"]))
        facts = own.select("column", "semantic_type").collect()  # a row per column
        texts |= {(name, r.column): r.semantic_type for r in facts}
        numbers = [r.column for r in facts if r.semantic_type in ("integer", "float")]
        if len(numbers) > 1:
            issues.append(_issues(profile.column_pair_issues(cross.correlations(df, numbers), name), VERSIONS["cross"]))
        if len(df.columns) > 1:
            dependencies.append(cross.functional_dependencies(df).withColumn("sheet", F.lit(name)))
    bodies = {n: _body(d) for n, d in sheets.items() if _body(d).columns}
    usable = {n: [c for c in d.columns if texts[n, c] != "empty"] for n, d in bodies.items()}
    usable = {n: cs for n, cs in usable.items() if cs}
    if len(usable) > 1:
        related = cross.relationships({n: bodies[n] for n in usable}, usable, {(n, c): texts[n, c] for n, cs in usable.items() for c in cs})
    else:
        related = spark.createDataFrame([], ", ".join(f"{k} string" for k in KEY) + ", name_similarity double, coverage double, cardinality string, confidence_pct double")
    old = store.load(dataset, "decisions", "decisions")
    related = related.join(F.broadcast(old), KEY, "left") if old is not None else related.withColumn("status", F.lit(None).cast("string"))  # decisions are made by hand
    related = related.withColumn("status", F.coalesce("status", F.lit("suggested"))).persist()
    for r in related.where("status = 'confirmed'").collect():
        broken = cross.fk_violations(bodies[r.parent_table], r.parent_column, bodies[r.child_table], r.child_column)
        issues.append(_issues(cross.fk_issue(broken, (r.parent_table, r.parent_column), (r.child_table, r.child_column)), VERSIONS["cross"]))
    union = lambda parts, shape: reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], shape)
    store.save(dataset, "profile", {
        "columns": union(columns, "sheet string, column string"), "sheets": union(totals, "sheet string"), "top_values": union(tops, "sheet string, column string, rank int, value string, n long"),
        "issues": union(issues, ISSUE), "dependencies": union(dependencies, "determinant string, dependent string, n_groups long, confidence_pct double, sheet string"), "relationships": related,
    }, base=base, carry="flag")


def flag_issue(store: Store, dataset: str, sheet: str, dimension: str, severity: str, description: str, column: str | None = None, samples: list[str] | None = None) -> None:
    """Adds an issue that a person found."""
    samples = samples or []
    if dimension not in DIMENSIONS or severity not in dashboard.SEVERITIES:
        raise ValueError(f"unknown dimension or severity: {dimension!r}, {severity!r}")
    if not 1 <= len(description) <= MOST_CHARS or len(samples) > MOST_SAMPLES:
        raise ValueError(f"a description has 1 to {MOST_CHARS} characters and at most {MOST_SAMPLES} samples")
    row = (sheet, column, dimension, severity, description, samples, len(samples), VERSIONS["flag"])
    store.append(dataset, "profile", "issues", store.spark.createDataFrame([row], ISSUE), tag="flag")


def list_issues(issues: DataFrame, sheet: str | None = None, column: str | None = None, severity: str | None = None, by_rank: bool = False, limit: int | None = ISSUE_LIMIT) -> tuple[DataFrame, bool]:
    """(issues, whether more exist): by descending name of severity, or by its rank from critical down."""
    for name, value in (("sheet", sheet), ("column", column), ("severity", severity)):
        if value is not None:
            issues = issues.where(F.col(name) == value)
    rank = F.array_position(F.array(*[F.lit(s) for s in dashboard.SEVERITIES]), F.col("severity"))
    ordered = issues.orderBy(rank if by_rank else F.col("severity").desc(), "sheet", "column", "dimension", "description")
    if limit is None:
        return ordered, False
    return ordered.limit(limit), len(issues.limit(limit + 1).take(limit + 1)) > limit


def list_relationships(found: DataFrame, status: str | None = None) -> DataFrame:
    return (found.where(F.col("status") == status) if status else found).orderBy(F.col("confidence_pct").desc(), *KEY)


def list_dependencies(found: DataFrame) -> DataFrame:
    return found.orderBy("sheet", F.col("confidence_pct").desc(), "determinant", "dependent")


def sort_columns(columns: DataFrame, by: str = "column", descending: bool = False, issues: DataFrame | None = None) -> DataFrame:
    """Column profiles by name, type, share of nulls, distinct values, rating (worst first) or, with ``issues``, their number."""
    if by == "issues":
        columns = columns.join(dashboard.issues_per_column(columns, issues).withColumnRenamed("n", "issues"), ["sheet", "column"], "left")
    key = dashboard.rag_rank(F.col("rag")) if by == "rag" else F.col(by)
    return columns.orderBy(key.desc() if descending else key.asc(), *(["sheet"] if "sheet" in columns.columns else []), "column")


def payload(columns: DataFrame, tops: DataFrame) -> DataFrame:
    """(sheet if there is one, column, json) of each profile with its top values; shares have two decimals."""
    by = [c for c in ("sheet", "column") if c in columns.columns]
    top = tops.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))), lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))).alias("top_values"))  # ten a column
    rows = columns.join(top, by, "left")
    shown = [F.round(c, 2).alias(c) if c.endswith("_pct") else F.col(c) for c in rows.columns]
    return rows.select(*by, F.to_json(F.struct(*shown)).alias("json"))


def nested(sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """A row per sheet with its profile and ``columns``, the profiles of its columns in order."""
    own = columns.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in columns.columns if c not in ("sheet", "ordinal")]))).alias("columns"))
    return sheets.join(own, "sheet", "left")


def five_numbers(columns: DataFrame) -> DataFrame:
    """(column, summary): least, quartiles and greatest; an empty list if any is missing."""
    parts = ["min", "p25", "median", "p75", "max"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])
    return columns.select("column", F.when(whole, F.array(*parts)).otherwise(F.array().cast("array<double>")).alias("summary"))


def draft(store: Store, dataset: str, left: str, right: str | None = None) -> linkage.Config:
    """Recommended linkage settings for two profiled sheets, or one with itself."""
    columns, tops = store.load(dataset, "profile", "columns"), store.load(dataset, "profile", "top_values")
    facts = {s: recommend.facts(columns.where(F.col("sheet") == s).drop("sheet"), tops.where(F.col("sheet") == s).drop("sheet")) for s in {left, right or left}}
    return recommend.config(facts[left], facts[right or left])


def save_config(store: Store, dataset: str, left: DataFrame, right: DataFrame, config: linkage.Config) -> None:
    """Replaces the dataset's linkage settings; columns must exist and one mapping be important.

    The time at which settings were first complete stays.
    """
    for side, names in ((left, [m.left for m in config.mappings]), (right, [m.right for m in config.mappings])):
        if set(names) - set(side.columns):
            raise ValueError(f"unknown columns {sorted(set(names) - set(side.columns))}")
    if not any(m.important for m in config.mappings):
        raise ValueError("at least one mapping must be important")
    if not 0 <= config.threshold <= 1 or any(not 0 <= m.weight <= 1 for m in config.mappings):
        raise ValueError("thresholds and weights lie between 0 and 1")
    old = store.load(dataset, "config", "settings")
    done = old.first().completed_at if old is not None else None
    maps = store.spark.createDataFrame([(i, m.left, m.right, m.measure, float(m.weight), m.important, m.parser) for i, m in enumerate(config.mappings)], "turn int, left string, right string, measure string, weight double, important boolean, parser string")
    head = store.spark.createDataFrame([(float(config.threshold), config.toggles, done, False)], "threshold double, toggles map<string,boolean>, completed_at timestamp, skipped boolean")
    store.save(dataset, "config", {"mappings": maps, "settings": head.withColumn("completed_at", F.coalesce("completed_at", F.current_timestamp()))})


def skip_config(store: Store, dataset: str) -> None:
    """Marks linkage settings as passed over, without any; settings that are there stay."""
    if store.load(dataset, "config", "settings") is None:
        maps = store.spark.createDataFrame([], "turn int, left string, right string, measure string, weight double, important boolean, parser string")
        head = store.spark.createDataFrame([(0.0, {}, True)], "threshold double, toggles map<string,boolean>, skipped boolean")
        store.save(dataset, "config", {"mappings": maps, "settings": head.select("threshold", "toggles", F.current_timestamp().alias("completed_at"), "skipped")})


def config_done(store: Store, dataset: str) -> bool:
    """Whether linkage settings were saved or passed over, so that a report may be shown."""
    return store.load(dataset, "config", "settings") is not None


def load_config(store: Store, dataset: str) -> linkage.Config | None:
    maps = store.load(dataset, "config", "mappings")
    if maps is None:
        return None
    head = store.load(dataset, "config", "settings").first()
    if head.skipped:
        return None
    return linkage.Config([linkage.Mapping(r.left, r.right, r.measure, r.weight, r.important, r.parser) for r in maps.orderBy("turn").collect()], head.threshold, dict(head.toggles))


def link(store: Store, dataset: str, left: DataFrame, right: DataFrame | None, config: linkage.Config, cap: int = linkage.PAIR_CAP) -> dict:
    """Runs linkage and keeps run, clusters and pairs; a run that fails is kept with its error. The last RUNS runs stay."""
    spark = store.spark
    blocking = recommend.blocking_mapping(config.mappings)
    run = {"status": "ok", "error": None, "blocking_column": blocking.name if blocking else None, "candidate_pairs": 0, "passing_pairs": 0, "clusters": 0}
    tables, pairs, grouped, blocked = {}, None, None, None
    try:
        blocked = linkage.block(left, right, config)
        pairs = linkage.scores(left, right, config, cap, blocked).persist()
        run["candidate_pairs"] = blocked.pairs
        grouped = linkage.clusters(pairs).persist()
        run["passing_pairs"], run["clusters"] = pairs.count(), grouped.count()
        owner = grouped.select("cluster_index", F.explode("members_a").alias("i"))
        important = [m for m in config.mappings if m.important]
        a, b = left, left if right is None else right
        show_a = a.select(F.col("_row_index").alias("_a"), *[cell(m.left).cast("string").alias(f"a{k}") for k, m in enumerate(important)])
        show_b = b.select(F.col("_row_index").alias("_b"), *[cell(m.right).cast("string").alias(f"b{k}") for k, m in enumerate(important)])
        named = grouped.join(show_a, F.col("representative.i") == F.col("_a"), "left").join(show_b, F.col("representative.j") == F.col("_b"), "left")
        key = F.create_map(*[x for k, m in enumerate(important) for x in (F.lit(m.left), F.coalesce(f"a{k}", f"b{k}"))])
        tables = {"pairs": pairs.join(owner, "i"), "clusters": named.select(*grouped.columns, key.alias("canonical_key"))}
    except linkage.TooManyPairs as e:
        run |= {"status": "failed", "error": str(e), "candidate_pairs": e.pairs}
    except ValueError as e:
        run |= {"status": "failed", "error": str(e)}
    row = spark.createDataFrame([tuple(run.values())], "status string, error string, blocking_column string, candidate_pairs long, passing_pairs long, clusters long")
    row = row.select("*", F.lit(VERSIONS["linkage"]).alias("engine_version"), F.current_timestamp().alias("created_at"))
    store.save(dataset, "linkage", {"run": row, **tables}, keep=RUNS)
    for kept in (pairs, grouped):
        if kept is not None:
            kept.unpersist()
    if blocked is not None:
        blocked.release()
    return run


def runs(store: Store, dataset: str) -> DataFrame:
    """(run, status, ...) of the kept runs, newest first."""
    found = [store.load(dataset, "linkage", "run", n).withColumn("run", F.lit(n)) for n in store.history(dataset, "linkage")]
    if not found:
        return store.spark.createDataFrame([], "run int, status string")
    return reduce(DataFrame.unionByName, found).orderBy(F.col("run").desc())


def cluster_detail(store: Store, dataset: str, index: int, left: DataFrame, right: DataFrame | None = None, run: int | None = None) -> dict[str, DataFrame]:
    """A cluster's pairs by falling score, and its rows; rows of one table are merged, each once. Of the last run, or of one by number."""
    pairs = store.load(dataset, "linkage", "pairs", run).where(F.col("cluster_index") == index)
    a = left.join(pairs.select(F.col("i").alias("_row_index")).distinct(), "_row_index")
    b = (left if right is None else right).join(pairs.select(F.col("j").alias("_row_index")).distinct(), "_row_index")
    out = {"pairs": pairs.orderBy(F.col("score").desc(), "i", "j")}
    if right is None:
        return out | {"rows": a.unionByName(b).dropDuplicates(["_row_index"]).orderBy("_row_index")}
    return out | {"rows_a": a.orderBy("_row_index"), "rows_b": b.orderBy("_row_index")}


def chip(score: str) -> Column:
    """Band of a score: strong from 0.95, good from 0.8, else weak."""
    return band(F.col(score))
