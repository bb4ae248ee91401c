"""Chat messages with linked tool calls as canonical JSON, in DataFrame functions only.

An assistant turn whose text is a JSON object with ``tool_calls`` (id, name,
arguments) makes calls; a turn of role ``tool`` whose text is an object with
``tool_call_id`` and ``content`` is a result.  Calls and results are hash-joined by
conversation and identifier.  The order is topological: a result follows its call,
and a call follows the calls, and their results, whose identifiers its arguments
name as ``${id}``; calls of one message that name each other are ordered inside it.
Arguments are validated against the tools' schemas.  Plain messages take no join
and no shuffle, so a conversation of any length is no group.

Where every message comes after all that it needs, as written by turn, nothing is
iterated.  Conversations with a message that comes too early are placed in rounds,
as many as the longest chain of needs in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.lineage import cut
from tidegraph.llm.skew import join_spread

_SHAPE = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
#: What a schema's type names are in the engine's own description of a JSON value.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "array": ["ARRAY"], "object": ["OBJECT"]}
#: Place of a message without a turn, and level of one that a cycle keeps from a place.
_LAST, _NEVER = (1 << 63) - 1, 1 << 20
_NODE = ["conv", "turn", "key"]


def _errors(tools: dict[str, dict] | None, name: Column, arguments: Column) -> Column:
    """Messages about arguments that do not fit the tool's schema; empty without schemas."""
    none = F.array().cast("array<string>")
    bad = F.when(arguments.isNull(), F.array(F.lit("arguments are not JSON")))
    if tools is None:
        return F.coalesce(bad, none)
    out = bad
    for tool, schema in sorted(tools.items()):
        checks = [F.when(~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments are not an object"))]
        for field in schema.get("required", ()):
            checks.append(F.when(F.try_variant_get(arguments, f"$['{field}']", "variant").isNull(), F.lit(f"{field} is missing")))
        for field, rule in sorted(schema.get("properties", {}).items()):
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            fits = F.lit(False)
            for kind in _KINDS[rule["type"]]:
                fits = fits | F.schema_of_variant(value).startswith(kind)
            checks.append(F.when(value.isNotNull() & ~fits, F.lit(f"{field} is not {rule['type']}")))
        if not schema.get("additional", True):
            known = sorted(schema.get("properties", {}))
            extra = F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*map(F.lit, known)).cast("array<string>"))
            checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields "), F.array_join(extra, " "))))
        out = out.when(name == tool, F.array_compact(F.array(*checks)))
    return out.otherwise(F.array(F.lit("unknown tool")))


def _depths(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node columns, depth) of each node: rounds until all that it needs is placed; null on or behind a cycle.

    ``needs`` has the node columns and, under the names with ``on_`` before them, those of what a node needs.
    """
    key = nodes.columns
    on = [f"on_{c}" for c in key]
    waiting = nodes.join(needs.select(*key, F.lit(True).alias("waits")).distinct(), key, "left")
    placed = cut(waiting.where("waits is null").select(*key, F.lit(0).alias("depth")))
    before = -1
    while (now := placed.count()) != before:
        before = now
        done = placed.select(*(F.col(c).alias(o) for c, o in zip(key, on)), F.col("depth").alias("under"))
        ready = needs.join(done, on, "left").groupBy(*key).agg(F.count_if(F.col("under").isNull()).alias("open"), (F.max("under") + 1).alias("depth"))
        ready = ready.where("open = 0").select(*key, "depth").join(placed, key, "left_anti")
        placed = cut(placed.unionByName(ready))
    left = nodes.join(placed, key, "left_anti").withColumn("depth", F.lit(None).cast("int"))
    return placed.unionByName(left)


def _places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, turn, key, seq_turn, seq_level) of the messages in conversations with one that comes before what it needs.

    A message's place is its turn or the latest of what it needs, in that case one
    level behind it.  Without a place on or behind a cycle: seq_level null.
    """
    on = ["conv", "on_turn", "on_key"]
    late = edges.where("on_turn >= turn").select("conv").distinct()
    edges = cut(edges.join(late, "conv", "left_semi"))
    nodes = cut(nodes.join(late, "conv", "left_semi"))
    waits = edges.select(*_NODE, F.lit(True).alias("waits")).distinct()
    placed = cut(nodes.join(waits, _NODE, "left").where("waits is null").select(*_NODE, F.col("turn").alias("seq_turn"), F.lit(0).alias("seq_level")))
    before = -1
    while (now := placed.count()) != before:
        before = now
        done = placed.select("conv", F.col("turn").alias("on_turn"), F.col("key").alias("on_key"), F.struct("seq_turn", "seq_level").alias("under"))
        ready = edges.join(done, on, "left").groupBy(*_NODE).agg(F.count_if(F.col("under").isNull()).alias("open"), F.max("under").alias("under"))
        pushed = F.col("under.seq_turn") >= F.col("turn")
        ready = ready.where("open = 0").select(*_NODE, F.greatest("turn", "under.seq_turn").alias("seq_turn"), F.when(pushed, F.col("under.seq_level") + 1).otherwise(0).alias("seq_level"))
        placed = cut(placed.unionByName(ready.join(placed, _NODE, "left_anti")))
    left = nodes.join(placed, _NODE, "left_anti").select(*_NODE, F.col("turn").alias("seq_turn"), F.lit(None).cast("int").alias("seq_level"))
    return placed.unionByName(left)


def format_messages(conversations: DataFrame, tools: dict[str, dict] | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, seq_turn, seq_level, n_calls, n_linked, n_errors, errors, message_json.

    (conv_id, seq_turn, seq_level, turn) is the topological order.  n_linked counts
    a message's calls with a result, or is 1 for a result with a call.  The first
    call, by turn and place, owns an identifier that several use; every result of
    it is linked.  Errors name calls without a result, results without a call,
    identifiers used twice, cycles and arguments against the schema.  Text that is
    not such JSON is a plain message; a null role, text or id leaves its key out.
    Calls and results without a conversation stay, linked with nothing; a message
    without a turn comes after all others.  Rows that repeat stay apart.  Other
    columns are ignored.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    json = F.when(F.ltrim("text").startswith("{"), F.from_json("text", _SHAPE))
    rows = rows.withColumn("j", json)
    makes = F.coalesce((F.col("role") == "assistant") & (F.size("j.tool_calls") > 0), F.lit(False))
    answers = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    none = F.array().cast("array<string>")

    plain = rows.where(~makes & ~answers).select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("turn").alias("seq_turn"), F.lit(0).alias("seq_level"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_linked"), none.alias("errors"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("conv").alias("conv_id"), "role", "turn")).alias("message_json"),
    )

    # from here on a message without a turn has the last one
    linked = rows.where(makes | answers).select("conv", F.coalesce("turn", F.lit(_LAST)).alias("turn"), "role", "text", "j", F.xxhash64("role", "text").alias("key"))
    if linked.isEmpty():
        out = plain
    else:
        out = plain.unionByName(_linked(cut(linked), tools))
    return out.select("conv_id", "turn", "role", "seq_turn", "seq_level", "n_calls", "n_linked", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"), "message_json")


def _linked(rows: DataFrame, tools: dict[str, dict] | None) -> DataFrame:
    """The messages with calls and those that are results."""
    makes = F.col("role") == "assistant"
    none = F.array().cast("array<string>")
    calls = rows.where(makes).dropDuplicates(_NODE).select(*_NODE, F.col("j.content").alias("content"), F.posexplode("j.tool_calls").alias("place", "c"))
    calls = cut(calls.select(*_NODE, "content", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("raw")))
    results = cut(rows.where(~makes).select(*_NODE, F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("content")))
    known = calls.where("conv is not null and call_id is not null")
    owner = cut(known.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "key", "place")).alias("own")))
    last = results.where("conv is not null").groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.max(F.struct("turn", "key")).alias("last"))

    # what each call names: the calls that own those identifiers, and their last results
    named = F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\$\{([^}]*)\}"), F.lit(1))))
    needs = known.select(*_NODE, "call_id", named.alias("need"))
    needs = cut(join_spread(cut(needs), owner.join(last, ["conv", "call_id"], "left").select("conv", F.col("call_id").alias("need"), "own", "last"), ["conv", "need"]))
    depth = known.select("conv", "call_id").distinct()
    if needs.isEmpty():
        depth = depth.withColumn("depth", F.lit(0))
    else:
        depth = _depths(depth, needs.select("conv", "call_id", F.col("conv").alias("on_conv"), F.col("need").alias("on_call_id")).distinct())
    outside = (F.col("own.turn") != F.col("turn")) | (F.col("own.key") != F.col("key"))
    of_calls = needs.where(outside).select(*_NODE, F.explode(F.array(F.struct("own.turn", "own.key"), "last")).alias("on")).where("on is not null")
    given = cut(join_spread(results, owner.join(depth, ["conv", "call_id"], "left"), ["conv", "call_id"], "left"))
    of_results = given.where("own is not null").select(*_NODE, F.struct("own.turn", "own.key").alias("on"))
    edges = of_calls.unionByName(of_results).select(*_NODE, F.col("on.turn").alias("on_turn"), F.col("on.key").alias("on_key")).distinct()
    nodes = rows.where("conv is not null").select(*_NODE).distinct()
    place = cut(_places(nodes, edges))
    same = lambda left, right: F.expr(" and ".join(f"{left}.{c} <=> {right}.{c}" for c in _NODE))
    turn = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    seq_turn, level = F.coalesce("p.seq_turn", "m.turn"), F.when(F.col("p.conv").isNull(), 0).otherwise(F.coalesce("p.seq_level", F.lit(_NEVER)))

    first = F.coalesce(F.col("own") == F.struct("turn", "key", "place"), F.lit(False))
    of_call = calls.join(owner, ["conv", "call_id"], "left").join(last.select("conv", "call_id", "n"), ["conv", "call_id"], "left").join(depth, ["conv", "call_id"], "left")
    stuck = place.where("seq_level is null").select(*_NODE, F.lit(True).alias("stuck"))
    of_call = of_call.alias("c").join(stuck.alias("s"), same("c", "s"), "left").select("c.*", "s.stuck").withColumn("arguments", F.try_parse_json("raw"))
    tell = lambda bad, what: F.when(bad, F.concat(F.coalesce("call_id", F.lit("?")), F.lit(what)))
    cyclic = F.col("call_id").isNotNull() & F.col("conv").isNotNull() & (F.col("depth").isNull() | F.col("stuck").isNotNull())
    found = F.concat(
        F.array_compact(F.array(tell(F.col("call_id").isNull(), ": no identifier"), tell(F.col("call_id").isNotNull() & F.col("conv").isNotNull() & ~first, ": identifier used twice"), tell(F.col("n").isNull(), ": no result"), tell(cyclic, ": cycle"))),
        F.transform(_errors(tools, F.col("name"), F.col("arguments")), lambda e: F.concat(F.coalesce("call_id", F.lit("?")), F.lit(": "), e)),
    )
    canonical = F.coalesce(F.to_json("arguments"), F.lit("null"))
    text_of = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    call_json = F.concat(F.lit('{"arguments":'), canonical, F.coalesce(F.concat(F.lit(',"id":'), F.when(F.col("call_id").isNotNull(), text_of("call_id"))), F.lit("")), F.coalesce(F.concat(F.lit(',"name":'), F.when(F.col("name").isNotNull(), text_of("name"))), F.lit("")), F.lit("}"))
    of_call = of_call.select(*_NODE, "content", F.coalesce("depth", F.lit(_NEVER)).alias("depth"), "place", found.alias("found"), (first & F.col("n").isNotNull()).alias("hit"), call_json.alias("json"))
    # the calls of one message; a message is one row of the input
    by_message = of_call.groupBy(*_NODE).agg(F.max("content").alias("content"), F.sort_array(F.collect_list(F.struct("depth", "place", "json", "found"))).alias("calls"), F.count("*").alias("n_calls"), F.count_if("hit").alias("n_linked"))
    made = rows.where(makes).select(*_NODE).alias("m").join(by_message.alias("b"), same("m", "b")).join(place.alias("p"), same("m", "p"), "left")
    made = made.select(
        F.col("m.conv").alias("conv_id"), turn("m.turn").alias("turn"), F.lit("assistant").alias("role"), seq_turn.alias("seq_turn"), level.alias("seq_level"), "n_calls", "n_linked", F.flatten("calls.found").alias("errors"),
        F.concat(F.lit("{"), F.when(F.col("content").isNotNull(), F.concat(F.lit('"content":'), text_of("content"), F.lit(","))).otherwise(""), F.when(F.col("m.conv").isNotNull(), F.concat(F.lit('"conv_id":'), "m.conv", F.lit(","))).otherwise(""), F.lit('"role":"assistant","tool_calls":['), F.array_join("calls.json", ","), F.lit("]"), F.when(F.col("m.turn") < _LAST, F.concat(F.lit(',"turn":'), "m.turn")).otherwise(""), F.lit("}")).alias("message_json"),
    )
    given = given.alias("m").join(place.alias("p"), same("m", "p"), "left").select(
        F.col("m.conv").alias("conv_id"), turn("m.turn").alias("turn"), F.lit("tool").alias("role"), seq_turn.alias("seq_turn"), level.alias("seq_level"), F.lit(0).cast("long").alias("n_calls"), F.col("own").isNotNull().cast("long").alias("n_linked"),
        F.when(F.col("own").isNull(), F.array(F.concat("call_id", F.lit(": no call")))).otherwise(none).alias("errors"),
        F.to_json(F.struct("content", F.col("m.conv").alias("conv_id"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"), turn("m.turn").alias("turn"))).alias("message_json"),
    )
    out = made.unionByName(given)
    return out.withColumn("seq_turn", turn("seq_turn"))
