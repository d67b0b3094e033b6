"""Chat formatting: tool calls linked to their results. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Kinds that JSON Schema names, by what Spark calls a variant's value.
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}
RULE = "array<struct<property:string,kind:string,required:boolean,least:double,most:double>>"


def schema_rules(schemas: dict[str, dict]) -> dict[str, list[tuple]]:
    """By function: (property, kind, required, least, most) of JSON Schemas of objects. least and most bound numbers and lengths of strings."""
    out = {}
    for name, schema in schemas.items():
        required = set(schema.get("required", ()))
        properties = schema.get("properties", {})
        bound = lambda p, *keys: next((float(p[k]) for k in keys if k in p), None)
        out[name] = [(k, properties.get(k, {}).get("type"), k in required, bound(properties.get(k, {}), "minimum", "minLength"), bound(properties.get(k, {}), "maximum", "maxLength")) for k in sorted({*properties, *required})]
    return out


def argument_errors(arguments: Column, rules: Column, known: Column) -> Column:
    """What is wrong with a call's arguments (a variant) under its function's rules (of type RULE): a sorted list of short texts.

    Properties that no rule names are wrong; so is what isn't an object. Nothing is checked beyond the first level.
    """
    kind = lambda v: F.schema_of_variant(v)
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    values = F.from_json(F.to_json(arguments), "map<string,variant>")

    def check(r: Column) -> Column:
        value = F.element_at(values, r["property"])
        missing = ~F.array_contains(keys, r["property"])
        shape = F.coalesce(kind(value), F.lit("VOID"))
        fits = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), r["kind"]), F.lit("."))
        amount = F.when(shape == "STRING", F.char_length(F.try_variant_get(value, "$", "string")).cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
        return (
            F.when(missing & r["required"], F.concat(F.lit("missing: "), r["property"]))
            .when(missing, None)
            .when(~F.regexp_like(shape, fits), F.concat(F.lit("kind: "), r["property"]))
            .when((amount < r["least"]) | (amount > r["most"]), F.concat(F.lit("bounds: "), r["property"]))
        )

    odd = F.array_except(keys, F.transform(rules, lambda r: r["property"]))
    found = F.concat(F.filter(F.transform(rules, check), lambda x: x.isNotNull()), F.transform(odd, lambda k: F.concat(F.lit("unknown: "), k)))
    return F.sort_array(
        F.when(~known, F.array(F.lit("no such function")))
        .when(arguments.isNull() | ~F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False)), F.array(F.lit("not an object")))
        .otherwise(found)
    )


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): how many calls must come before each, one after the other: the longest way through `after` (lists of ids; unknown ones don't count).
    Null for calls that wait for one another or for such.

    Calls that wait for one other are followed by pointer doubling, in a logarithmic number of rounds, to a call that waits for none or for several. What is left
    are calls that wait for several: of these, each round settles all whose predecessors are settled."""
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("after")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("after")).distinct()
    edges = cut(edges.join(known, ["conv_id", "after"], "left_semi"), "call-edges")
    counts = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("waits"), F.min("after").alias("after"))
    now = calls.select("conv_id", "call_id").distinct().join(counts, ["conv_id", "call_id"], "left")
    one = F.col("waits") == 1
    now = cut(now.select("conv_id", "call_id", F.when(one, F.col("after")).alias("after"), F.when(one, 1).otherwise(0).cast("long").alias("steps"), F.when(one, None).otherwise(F.col("call_id")).alias("base"), F.coalesce("waits", F.lit(0)).alias("waits")), "calls-ahead")
    # After k rounds each step spans 2**k calls: what still waits when that is more than there are calls, waits for itself.
    for _ in range(calls.count().bit_length() + 1):
        if now.filter("after IS NOT NULL").isEmpty():
            break
        target = now.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("next"), F.col("steps").alias("more"), F.col("base").alias("end"))
        waiting = now.filter("after IS NOT NULL").join(target, ["conv_id", "after"])
        waiting = waiting.select("conv_id", "call_id", F.col("next").alias("after"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("base"), "waits")
        now = cut(now.filter("after IS NULL").unionByName(waiting), "levels")
    now = now.withColumn("base", F.when(F.col("after").isNull(), F.col("base"))).drop("after")
    settled = now.filter("waits = 0").select("conv_id", F.col("call_id").alias("base"), F.lit(0).cast("long").alias("level"))
    several = now.filter("waits > 1").select("conv_id", "call_id", "waits")
    if not several.isEmpty():
        ways = edges.join(several, ["conv_id", "call_id"]).join(now.select("conv_id", F.col("call_id").alias("after"), "base", "steps"), ["conv_id", "after"])
        ways = cut(ways.select("conv_id", "call_id", "waits", "base", (F.col("steps") + 1).alias("steps")), "ways")
        while True:
            fresh = ways.join(settled, ["conv_id", "base"]).groupBy("conv_id", "call_id", "waits").agg(F.count(F.lit(1)).alias("met"), F.max(F.col("steps") + F.col("level")).alias("level"))
            fresh = fresh.filter("met = waits").select("conv_id", F.col("call_id").alias("base"), "level")
            fresh = cut(fresh.join(settled, ["conv_id", "base"], "left_anti"), "settled")
            if fresh.isEmpty():
                break
            settled = cut(settled.unionByName(fresh), "settled")
    return now.join(settled, ["conv_id", "base"], "left").select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result: conv_id, turn, kind, call_id, name, depth, status, errors, json.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (the ids of calls whose results this one uses: a list, or one id, or null). results: conv_id, call_id,
    turn, content. They are joined by conversation and identifier (Spark splits ids that many results share). depth orders them: 2 * level of the
    call, 1 more for its results; rows sorted by (conv_id, depth, turn) come after all that they depend on; it is null for calls that wait for one
    another. status: of calls, ok, no result, invalid (errors says why) or duplicate (of rows with one id, all but the one with the least turn); of
    results, ok or orphan. json is canonical: keys sorted, no blanks, every key there (null if unknown).
    Null ids and null conversations link with nothing. Repeated rows of calls are duplicates of the first; repeated results each count. Arguments that
    aren't JSON objects are invalid and written as null. Empty tables give no rows. Other columns are ignored.
    """
    rules = schema_rules(schemas)
    table = F.create_map(*[x for name, rows in rules.items() for x in (F.lit(name), F.array(*[F.struct(*[F.lit(v) for v in r]) for r in rows]).cast(RULE))]) if rules else F.create_map().cast(f"map<string,{RULE}>")
    uses = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.when(F.col("after").isNotNull(), F.array("after"))
    c = calls.select("conv_id", "call_id", "turn", "name", F.try_parse_json("arguments").alias("arguments"), F.col("arguments").alias("raw"), F.filter(uses, lambda x: x.isNotNull()).alias("after"))
    # Of calls with one id the first counts: sums before the shuffle.
    first = c.filter("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "raw", "after")).alias("f"), F.count(F.lit(1)).alias("copies"))
    first = first.select("conv_id", "call_id", "f.turn", "f.name", F.col("f.after").alias("after"), "copies")
    first = cut(first, "calls")
    alone = first.filter(F.size("after") > 0).isEmpty()
    first = first.withColumn("level", F.lit(0).cast("long")) if alone else first.join(levels(first), ["conv_id", "call_id"])
    answers = results.select("conv_id", "call_id", "turn", "content")
    counted = answers.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"))
    info = cut(first.join(counted, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("turn").alias("first_turn"), F.col("name").alias("first_name"), "level", "copies", F.coalesce("n_results", F.lit(0)).alias("n_results")), "linked")
    rules_of = F.coalesce(F.element_at(table, F.col("name")), F.array().cast(RULE))
    told = c.join(info, ["conv_id", "call_id"], "left").withColumn("errors", argument_errors(F.col("arguments"), rules_of, F.coalesce(F.array_contains(F.map_keys(table), F.col("name")), F.lit(False))))
    late = F.coalesce(F.col("turn") > F.col("first_turn"), F.lit(False))
    state = F.when(late, "duplicate").when(F.size("errors") > 0, "invalid").when(F.coalesce("n_results", F.lit(0)) == 0, "no result").otherwise("ok")
    good = F.when(F.coalesce(F.schema_of_variant(F.col("arguments")).startswith("OBJECT"), F.lit(False)), F.col("arguments"))
    keep = lambda s: F.to_json(s, {"ignoreNullFields": "false"})
    depth = (2 * F.col("level")).alias("depth")
    as_calls = told.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", depth, state.alias("status"), "errors", keep(F.struct(good.alias("arguments"), depth, F.col("call_id").alias("id"), "name", F.lit("call").alias("type"))).alias("json"))
    linked = answers.join(info, ["conv_id", "call_id"], "left")
    depth = (2 * F.col("level") + 1).alias("depth")
    as_results = linked.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("first_name").alias("name"), depth, F.when(F.col("copies").isNull(), "orphan").otherwise("ok").alias("status"),
        F.array().cast("array<string>").alias("errors"), keep(F.struct("content", depth, F.col("call_id").alias("id"), F.col("first_name").alias("name"), F.lit("result").alias("type"))).alias("json"),
    )
    return as_calls.unionByName(as_results)


#: What the query takes a user's turn for.
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 20, "maxLength": 20000}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"]}}


#: Turns of a conversation that a task puts in order; longer ones are put in order in parts.
SPAN = 4096


def conversation_events(conversations: DataFrame, span: int = SPAN, chained: bool = True) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of conversations without tool calls of their own: each user turn calls the function reply with its text and, if chained, uses the
    result of the user turn before it; each assistant turn is the result of the turn before it. Ids are call-<turn>. Turns of other roles are neither.
    Repeated turns are one for what comes after; null conversations and turns have none before them."""
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = conversations.filter("role = 'user'").select("conv_id", F.concat(F.lit("call-"), F.col("turn").cast("string")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = conversations.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    if not chained:
        return calls.withColumn("after", F.lit(None).cast("string")), results
    # The turn before, in two levels: within a part of a conversation, and for a part's first turn the last one of the part before.
    turns = calls.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.floor(F.col("turn") / span).alias("part")).distinct()
    parts = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("last"))
    parts = parts.select("conv_id", "part", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")).alias("ahead"))
    inner = turns.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn")))
    before = inner.join(parts, ["conv_id", "part"]).select("conv_id", "turn", F.concat(F.lit("call-"), F.coalesce("before", "ahead").cast("string")).alias("after"))
    return calls.join(before, ["conv_id", "turn"], "left"), results
