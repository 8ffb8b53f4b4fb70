"""Tool-call linking in chats, in DataFrame functions only.

A message is a row (conv_id, turn, role, text). An assistant message whose text is a JSON
object with ``tool_calls`` makes calls, each with id, name and arguments, these two also
inside ``function``, and arguments also as a text that spells an object; a message of role
``tool`` whose text is an object with ``tool_call_id`` is a result. Any other text is prose.
What a message with calls says besides them is a message, too.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import staged

#: Argument names and types of tools: a name that ends in ``?`` may be absent.
SCHEMAS = {
    "search": {"query": "string", "limit?": "number"},
    "calculator": {"expression": "string"},
    "weather": {"city": "string", "unit?": "string"},
    "lookup": {"key": "string", "after?": "string"},
}

#: Level of calls in cycles and behind them; one more for results without a settled call.
LAST = 2_000_000_000
#: The place of rows that have none: behind all others.
END = "~"


def canonical(pairs: Column) -> Column:
    """A JSON object of a map of strings with its keys in code point order, without spaces."""
    entries = F.array_sort(F.map_entries(pairs))
    texts = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))


def canonical_values(pairs: Column, **texts_of: Column) -> Column:
    """A JSON object of a map of variants, as canonical(); each value keeps its JSON type, nested objects have their keys in order.

    Strings given by name are fields besides; they go before those of the map.
    """
    keys = F.array_union(F.map_keys(pairs), F.array(*[F.lit(k) for k in texts_of])) if texts_of else F.map_keys(pairs)

    def value(k: Column) -> Column:
        out = F.to_json(F.try_element_at(pairs, k))
        for name, text in texts_of.items():
            out = F.when(k == name, _quoted(text)).otherwise(out)
        return out

    texts = F.transform(F.array_sort(keys), lambda k: F.concat(_quoted(k), F.lit(":"), value(k)))
    return F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))


def _object(value: Column) -> Column:
    """The fields of a variant that is an object, as a map of variants; else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _quoted(text: Column) -> Column:
    one = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}, or {} for null
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(6), F.length(one) - 6))


def _kind(value: Column) -> Column:
    """The JSON kind of a variant."""
    kind = F.lower(F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1))
    return F.when(kind == "void", "null").when(kind.isin("bigint", "decimal", "double", "float"), "number").otherwise(kind)


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, str]] = SCHEMAS) -> Column:
    """What is wrong with the arguments of a call, a map of variants: an array of strings, empty if nothing."""
    found = F.array(F.when(name.isNull(), "no name").otherwise(F.concat(F.lit("unknown tool "), name)))
    none = F.expr("cast(array() as array<string>)")
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, kind in sorted(fields.items()):
            key, optional = field.rstrip("?"), field.endswith("?")
            value = F.try_element_at(arguments, F.lit(key))
            has = F.coalesce(F.map_contains_key(arguments, F.lit(key)), F.lit(False))
            absent = F.lit(None).cast("string") if optional else F.lit(f"{key} is missing")
            checks.append(F.when(~has, absent).when(has & (_kind(value) != kind), F.lit(f"{key} is not a {kind}")))
        known = F.array(*[F.lit(f.rstrip("?")) for f in fields])
        extra = F.transform(F.array_except(F.coalesce(F.map_keys(arguments), none), known), lambda k: F.concat(k, F.lit(" is unknown")))
        found = F.when(name == tool, F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), F.array_sort(extra))).otherwise(found)
    return found


def _calls(rows: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """(conv_id, turn, part, call_id, waits, problems, json) of calls given as variants.

    Name and arguments may stand inside ``function``, and arguments may be a text that spells
    an object; both forms come out as the plain one. Every other field of the call, and of
    ``function``, stays.
    """
    own = F.col("call")
    inner = _object(F.try_variant_get(own, "$.function", "variant"))
    wrapped = F.try_variant_get(own, "$.name", "string").isNull() & inner.isNotNull()
    rows = rows.withColumn("inner", F.when(wrapped, inner)).withColumn("id", F.try_variant_get(own, "$.id", "string"))
    rows = rows.withColumn("name", F.when(wrapped, F.try_variant_get(own, "$.function.name", "string")).otherwise(F.try_variant_get(own, "$.name", "string")))
    given = F.coalesce(F.try_variant_get(own, "$.arguments", "variant"), F.try_element_at("inner", F.lit("arguments")))
    rows = rows.withColumn("given", given)
    spelled = F.try_parse_json(F.when(_kind(F.col("given")) == "string", F.try_variant_get("given", "$", "string")))
    rows = rows.withColumn("arguments", F.when(_object(spelled).isNotNull(), spelled).otherwise(F.col("given")))
    fields = _object(F.col("arguments"))
    values = F.coalesce(F.map_values(fields), F.expr("cast(array() as array<variant>)"))
    values = F.transform(F.filter(values, lambda v: _kind(v) == "string"), lambda v: F.variant_get(v, "$", "string"))
    waits = F.transform(F.filter(values, lambda v: v.startswith("@")), lambda v: F.substring(v, F.lit(2), F.length(v)))
    shape = F.when(F.col("arguments").isNotNull() & fields.isNull(), F.array(F.lit("arguments are not an object"))).otherwise(F.expr("cast(array() as array<string>)"))
    plain = lambda name, text: F.struct(F.lit(name).alias("key"), text.alias("text"))
    known = [plain("arguments", F.coalesce(canonical_values(fields), F.to_json("arguments"), F.lit("{}"))), plain("id", _quoted(F.col("id"))), plain("name", _quoted(F.col("name")))]
    none = F.expr("cast(array() as array<struct<key:string,text:string>>)")
    deeper = F.map_filter("inner", lambda k, _: ~k.isin("name", "arguments"))
    inside = F.when(F.size(deeper) > 0, F.array(plain("function", canonical_values(deeper)))).otherwise(none)
    other = F.map_filter(_object(own), lambda k, _: ~k.isin("id", "name", "arguments") & ~((k == "function") & F.col("inner").isNotNull()))
    other = F.coalesce(F.transform(F.map_entries(other), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("text"))), none)
    pairs = F.array_sort(F.concat(F.array(*known), inside, other))
    json = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["text"])), ","), F.lit("}"))
    return rows.select("conv_id", "turn", "part", F.col("id").alias("call_id"), F.array_distinct(waits).alias("waits"), F.concat(shape, problems(F.col("name"), fields, schemas)).alias("problems"), json.alias("json"))


def link(messages: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """One row per message, call and result, in an order that puts results after their calls.

    A message with calls also has a message row if its object has fields besides tool_calls
    and role that are not null: its json holds these fields and the row's role.

    Columns: conv_id, turn, part (place among the calls of a message), kind (message, call
    or result), call_id, linked (a call has a result, a result a call; null for messages),
    valid (of a call: its arguments fit the tool's schema; else null), problems, level,
    position (the order key within the conversation), json (canonical).

    Calls and results meet by conversation and identifier in a hash join. A call waits for
    the results that its argument values name as ``@identifier``, a result for its call.
    Rows keep the order of turns and parts but where such a wait forces a move: a row's
    place is the latest turn and part among its own and those that it waits for, directly or
    by way of others, and rows of one place stand by level, which grows along waits. So the
    order is topological. Calls in a cycle and calls that wait for them keep linked = false
    and come last, with their results. If calls share an identifier, the earliest is meant;
    of equal results each is linked; a result without a call keeps its turn. Null texts are
    empty prose, malformed JSON is prose, of fields of one name in an object the last
    counts, null conversations and turns are values of their own (a null turn is the first),
    repeated rows stay, an empty table gives an empty result, other columns are not read. No
    row gathers a whole conversation, so one very long conversation is no hot group.

    No field is lost: calls and results keep what they hold besides, with its JSON type; calls
    in the form with ``function``, or with arguments as a text, come out in the plain form.
    Arguments keep their JSON types: they are variants, numbers exact to 38 digits, beyond
    that and with exponents doubles. Keys inside nested values are in UTF-16 order. Absent
    arguments count as an empty object.
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # else such calls would be lost
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("text"))
    maybe = F.trim("text").startswith("{")
    rows = rows.withColumn("body", F.when(maybe & F.col("role").isin("assistant", "tool"), F.try_parse_json("text")))
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("body", "$.tool_calls", "array<variant>")))
    rows = rows.withColumn("result", F.when(F.col("role") == "tool", F.try_variant_get("body", "$.tool_call_id", "string")))
    is_call, is_result = F.coalesce(F.size("calls"), F.lit(0)) > 0, F.col("result").isNotNull()
    rest = F.map_filter(_object(F.col("body")), lambda k, v: ~k.isin("tool_calls", "role") & ~F.is_variant_null(v))
    rows = rows.withColumn("rest", F.when(is_call, rest))
    prose = rows.where(~is_result & (~is_call | (F.size("rest") > 0))).select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"),
        F.lit(None).cast("boolean").alias("valid"), F.expr("cast(array() as array<string>)").alias("problems"), F.lit(0).alias("level"), _place(F.lit(0)).alias("place"),
        F.when(is_call, canonical_values(F.col("rest"), role=F.col("role"))).otherwise(canonical(F.create_map(F.lit("content"), F.col("text"), F.lit("role"), F.col("role")))).alias("json"),
    )
    calls = _calls(rows.where(is_call).select("conv_id", "turn", F.posexplode("calls").alias("part", "call")), schemas)
    told = F.map_filter(_object(F.col("body")), lambda k, v: ~k.isin("tool_call_id", "role"))
    content = F.map_from_arrays(F.array(F.lit("content")), F.array(F.parse_json(F.lit("null"))))
    told = F.when(F.map_contains_key(told, F.lit("content")), told).otherwise(F.map_concat(told, content))
    results = rows.where(is_result).select("conv_id", "turn", F.lit(0).alias("part"), F.col("result").alias("call_id"), canonical_values(told, role=F.lit("tool"), tool_call_id=F.col("result")).alias("json"))
    calls, results = staged(calls, "calls"), staged(results, "results")
    calls, results = calls.withColumn("own", _place()), results.withColumn("own", _place())
    levels = _levels(calls, results)
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    on = ["conv_id", "call_id"]
    made = _left(_left(calls, levels, on, ["level", "place"]), answered, on, ["answered"])
    made = made.select(
        "conv_id", "turn", "part", F.lit("call").alias("kind"), "call_id", (F.coalesce("answered", F.lit(False)) & F.col("level").isNotNull()).alias("linked"), (F.size("problems") == 0).alias("valid"), "problems",
        F.coalesce(F.col("level"), F.lit(LAST)).alias("level"), F.when(F.col("call_id").isNull(), F.col("own")).when(F.col("place").isNull(), END).otherwise(F.greatest("place", "own")).alias("place"), "json",
    )
    given = _left(results, levels, on, ["level", "known", "place"]).select(
        "conv_id", "turn", "part", F.lit("result").alias("kind"), "call_id", F.coalesce("known", F.lit(False)).alias("linked"), F.lit(None).cast("boolean").alias("valid"),
        F.expr("cast(array() as array<string>)").alias("problems"), F.coalesce(F.col("level") + 1, F.lit(LAST + 1)).alias("level"),
        F.when(F.col("known").isNull(), F.col("own")).when(F.col("place").isNull(), END).otherwise(F.greatest("place", "own")).alias("place"),
        "json",
    )
    every = prose.unionByName(made).unionByName(given)
    position = F.concat_ws(":", "place", F.lpad(F.col("level").cast("string"), 10, "0"), F.when(F.col("kind") == "message", "0").otherwise("1"), _place())
    return every.withColumn("position", position).drop("place")


def _place(part: Column | None = None) -> Column:
    """Turn and part as a text that sorts as they do."""
    turn = F.col("turn").try_cast("bigint").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.concat(F.lpad(F.coalesce(turn.cast("string"), F.lit("")), 20, "0"), F.lit("."), F.lpad((F.col("part") if part is None else part).cast("string"), 10, "0"))


def _left(rows: DataFrame, other: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """Left join with null-safe keys."""
    other = other.select(*[F.col(c).alias(f"_{c}") for c in on], *take)
    condition = F.col(on[0]).eqNullSafe(F.col(f"_{on[0]}"))
    for c in on[1:]:
        condition = condition & (F.col(c) == F.col(f"_{c}"))
    return rows.join(other, condition, "left").drop(*[f"_{c}" for c in on])


def _levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, place, known) of each identifier's earliest call; no level and place in cycles and behind them.

    In each round a call gets its level if all that it waits for have theirs; a wait for a call
    that itself has one wait only is replaced by that one, with the steps added and the latest
    place on the way kept, so a chain takes rounds by the logarithm of its length. A round that
    settles nothing is the last: among open calls outside of cycles one waits for settled ones alone.
    """
    key = ["conv_id", "call_id"]
    earliest = Window.partitionBy(*key).orderBy("turn", "part")
    nodes = calls.where("call_id IS NOT NULL").withColumn("n", F.row_number().over(earliest)).where("n = 1").select(*key, "own", "waits")
    waits = staged(nodes.select(*key, F.explode("waits").alias("on")), "waits")
    last = results.groupBy(*key).agg(F.max("own").alias("last"))
    nodes = staged(_left(nodes.select(*key, "own"), last, key, ["last"]).withColumn("last", F.greatest("own", "last")), "nodes")
    known = nodes.select(*key, F.lit(True).alias("known"))
    if waits.isEmpty():
        return known.withColumn("level", F.lit(0)).withColumn("place", F.lit(""))
    waits = _left(waits.select("conv_id", F.col("call_id").alias("waiter"), F.col("on").alias("call_id")), known, key, ["known"]).where("known")
    waits = staged(waits.select("conv_id", "waiter", F.col("call_id").alias("on"), F.lit(1).alias("steps"), F.lit("").alias("way")), "waits")
    blocked = waits.select("conv_id", F.col("waiter").alias("call_id")).distinct().withColumn("waits", F.lit(True))
    open_ = F.col("waits").isNotNull()
    level = _left(nodes, blocked, key, ["waits"]).select(*key, "own", "last", F.when(~open_, 0).alias("level"), F.when(~open_, F.col("own")).alias("place"))
    level = staged(level, "levels")
    settled, longest = level.where("level IS NOT NULL").count(), level.count()
    while True:
        before = level.select("conv_id", F.col("call_id").alias("on"), "level", F.greatest("place", "last").alias("done"))
        reached = _left(waits, before, ["conv_id", "on"], ["level", "done"]).groupBy("conv_id", F.col("waiter").alias("call_id"))
        every = F.count("level") == F.count("*")
        ready = reached.agg(F.when(every, F.max(F.col("level") + 2 * F.col("steps"))).alias("ready"), F.when(every, F.max(F.greatest("done", "way"))).alias("latest"))
        level = _left(level, ready, key, ["ready", "latest"])
        level = level.select(*key, "own", "last", F.coalesce("level", "ready").alias("level"), F.coalesce("place", F.when(F.col("ready").isNotNull(), F.greatest("own", "latest"))).alias("place"))
        level = staged(level, "levels")
        now = level.where("level IS NOT NULL").count()
        if now == settled or now == longest:
            break
        settled = now
        waiters = level.where("level IS NULL").select("conv_id", F.col("call_id").alias("waiter"), F.lit(True).alias("open"))
        waits = staged(_left(waits, waiters, ["conv_id", "waiter"], ["open"]).where("open").drop("open"), "waits")
        single = waits.groupBy("conv_id", F.col("waiter").alias("on")).agg(F.count("*").alias("n"), F.min("on").alias("next"), F.min("steps").alias("more"), F.min("way").alias("beyond")).where("n = 1")
        single = _left(single, nodes.select("conv_id", F.col("call_id").alias("on"), "last"), ["conv_id", "on"], ["last"])
        nearer = _left(waits, single, ["conv_id", "on"], ["next", "more", "beyond", "last"])
        jump = F.col("next").isNotNull() & (F.col("steps") + F.col("more") <= longest)  # a longer path is a cycle's
        pick = lambda there, here: F.when(jump, there).otherwise(F.col(here)).alias(here)
        nearer = nearer.select("conv_id", "waiter", pick(F.col("next"), "on"), pick(F.col("steps") + F.col("more"), "steps"), pick(F.greatest("way", "beyond", "last"), "way"))
        waits = staged(nearer.groupBy("conv_id", "waiter", "on").agg(F.max("steps").alias("steps"), F.max("way").alias("way")), "waits")
    return level.select(*key, "level", "place").withColumn("known", F.lit(True))
