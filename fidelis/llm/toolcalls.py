"""Tool-call linking for chat data, with DataFrame functions only.

Messages are rows (conv_id, turn, role, text). Three kinds of text are JSON:

* ``system``: {"tools": [{"name", "parameters": <schema>}]}; a schema has type (one or several), properties, required,
  additionalProperties (false or a schema), items, enum, and bounds of numbers, lengths and item counts, at any depth
* ``assistant``: {"content", "tool_calls": [{"id", "name", "arguments"}]}, arguments as an object or its text
* ``tool``: {"tool_call_id", "content"}

Arguments may refer to the result of another call as {"$ref": "<call id>"}. Every other text is plain content.
Links are made by hash joins on (conv_id, call id), so one long conversation is not gathered in one task, and
the order is a sort key per row, not a numbering of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, persist_table

_CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string>>"
_RESULT = "tool_call_id string, content string"
_TOOLS = "tools array<struct<name:string,parameters:string>>"
_SCHEMA = (
    "type string, properties map<string,string>, required array<string>, additionalProperties string, items string, enum string, "
    "minimum double, maximum double, exclusiveMinimum double, exclusiveMaximum double, minLength long, maxLength long, minItems long, maxItems long"
)
_FAR = 1 << 50  # longer than any chain of calls; weights around a cycle stop here
COLUMNS = ["conv_id", "turn", "slot", "level", "role", "kind", "json", "n_calls", "n_linked", "problems"]


def _canonical(text: Column) -> Column:
    """Keys sorted, no white space; what is no JSON becomes a JSON string."""
    parsed = F.try_parse_json(text)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.coalesce(F.to_json(parsed), _quoted(text)))


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    held = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(held.substr(F.lit(6), F.length(held) - 6))


def _refs(arguments: Column) -> Column:
    """Call ids under "$ref" keys of arguments that are JSON; null where they are none."""
    raw = F.regexp_extract_all(F.to_json(F.try_parse_json(arguments)), F.lit(r'(?<!\\)"\$ref":"((?:[^"\\]|\\.)+)"'), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda t: F.from_json(F.concat(F.lit('{"v":"'), t, F.lit('"}')), "v string")["v"]))


def _fits(kind: Column, number: Column, wanted: Column) -> Column:
    """Whether a value of a variant type (and, of numbers, its double) is what a schema wants; unknown wishes are met by anything."""
    is_number = number.isNotNull()
    return (
        F.when(wanted == "string", kind == "STRING")
        .when(wanted == "integer", is_number & (number == F.floor(number)))
        .when(wanted == "number", is_number)
        .when(wanted == "boolean", kind == "BOOLEAN")
        .when(wanted == "array", kind.startswith("ARRAY"))
        .when(wanted == "object", kind.startswith("OBJECT"))
        .when(wanted == "null", kind == "VOID")
        .otherwise(F.lit(True))
    )


def _tools(rows: DataFrame) -> DataFrame:
    """(conv_id, name, schema): the earliest definition of each tool of a conversation, its parameters as JSON text."""
    parsed = rows.where((F.col("role") == "system") & F.col("text").contains('"tools"')).select("conv_id", "turn", F.from_json("text", _TOOLS)["tools"].alias("tools"))
    each = parsed.select("conv_id", "turn", F.posexplode("tools").alias("pos", "tool")).where("tool.name is not null")
    return each.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min(F.struct("turn", "pos", F.col("tool.parameters").alias("schema"))).alias("t")).select("conv_id", "name", "t.schema")


def _violations(open_: DataFrame) -> DataFrame:
    """(mid, pos, problems) of (mid, pos, path, schema, value), schema and value as JSON text.

    A round checks the values of one depth and goes on to the members and items that have a schema of their own, so
    there are as many rounds as schemas are deep; a round is written to the shared folder.
    """
    found, text = [], lambda p: F.concat(F.lit(p), F.col("path"))
    none = F.array().cast("array<string>")
    while True:
        v = open_.withColumn("s", F.from_json("schema", _SCHEMA)).withColumn("v", F.try_parse_json("value"))
        kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        v = v.withColumn("kind", kind).withColumn("number", F.when(numeric, F.try_variant_get("v", "$", "double")))
        v = v.withColumn("members", F.when(F.col("kind").startswith("OBJECT"), F.try_variant_get("v", "$", "map<string,variant>")))
        v = v.withColumn("elements", F.when(F.col("kind").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")))
        types = F.when(F.col("s.type").startswith("["), F.from_json("s.type", "array<string>")).when(F.col("s.type").isNotNull(), F.array("s.type"))
        length = F.when(F.col("kind") == "STRING", F.length(F.try_variant_get("v", "$", "string")))
        here = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit(".")))
        keys, properties = F.coalesce(F.map_keys("members"), none), F.coalesce("s.properties", F.create_map().cast("map<string,string>"))
        outside, is_object = F.filter(keys, lambda k: ~F.map_contains_key(properties, k)), F.col("members").isNotNull()
        same = lambda e: (F.to_json(e) == F.to_json("v")) | (F.schema_of_variant(e).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(e, "$", "double") == F.col("number")))
        wrong_type = F.coalesce(~F.exists(types, lambda t: _fits(F.col("kind"), F.col("number"), t)), F.lit(False))
        choices = F.try_variant_get(F.try_parse_json("s.enum"), "$", "array<variant>")
        n, size, s = F.col("number"), F.size("elements"), lambda name: F.col(f"s.{name}")
        beyond = (n < s("minimum")) | (n > s("maximum")) | (n <= s("exclusiveMinimum")) | (n >= s("exclusiveMaximum"))
        beyond = F.coalesce(beyond, F.lit(False)) | F.coalesce((length < s("minLength")) | (length > s("maxLength")), F.lit(False)) | F.coalesce(F.col("elements").isNotNull() & ((size < s("minItems")) | (size > s("maxItems"))), F.lit(False))
        each = lambda label, names: F.transform(names, lambda k: F.concat(F.lit(label), here, k))
        problems = F.concat(
            F.when(wrong_type, F.array(text("type:"))).otherwise(none),
            F.when(F.coalesce(~F.exists(choices, lambda e: F.coalesce(same(e), F.lit(False))), F.lit(False)), F.array(text("enum:"))).otherwise(none),
            F.when(beyond, F.array(text("bound:"))).otherwise(none),
            F.when(is_object, each("missing:", F.filter(F.coalesce("s.required", none), lambda k: ~F.array_contains(keys, k)))).otherwise(none),
            F.when(s("additionalProperties") == "false", each("extra:", outside)).otherwise(none),
        )
        rest = F.when(s("additionalProperties").startswith("{"), s("additionalProperties"))
        inner = F.transform(keys, lambda k: F.struct(F.concat(here, k).alias("path"), F.coalesce(F.try_element_at(properties, k), rest).alias("schema"), F.to_json(F.element_at("members", k)).alias("value")))
        items = F.when(s("items").startswith("{"), F.transform("elements", lambda e, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), s("items").alias("schema"), F.to_json(e).alias("value"))))
        below = F.filter(F.concat(F.coalesce(inner, F.array()), F.coalesce(items, F.array())), lambda x: x["schema"].startswith("{"))
        # a variant goes into no aggregate, join or table: only its text does
        checked = persist_table(v.select("mid", "pos", problems.alias("problems"), below.alias("below")), "checked")
        found.append(checked.where(F.size("problems") > 0).select("mid", "pos", F.explode("problems").alias("problem")))
        open_ = checked.select("mid", "pos", F.explode("below").alias("x")).select("mid", "pos", "x.*")
        if open_.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("mid", "pos").agg(F.collect_set("problem").alias("problems"))


def _validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` with ``problems`` found in their arguments."""
    none = F.array().cast("array<string>")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    joined = calls.join(tools.withColumn("known", F.lit(True)), ["conv_id", "name"], "left").withColumn("is_object", is_object)
    joined = persist_table(joined, "validated")
    inner = _violations(joined.where("is_object and known and schema is not null").select("mid", "pos", F.lit("").alias("path"), "schema", F.col("arguments").alias("value")))
    found = F.when(~F.col("is_object"), F.array(F.lit("arguments"))).when(F.col("known").isNull(), F.array(F.lit("tool"))).otherwise(F.coalesce("inner", none))
    return joined.join(inner.withColumnRenamed("problems", "inner"), ["mid", "pos"], "left").withColumn("problems", found).drop("inner", "schema", "known", "is_object")


def _ordered(calls: DataFrame, first_results: DataFrame) -> DataFrame:
    """(conv_id, id, slot, level): each call after the results that its arguments refer to; calls on or after a cycle are left out.

    A call's slot is its turn or that of the latest result it needs. An edge (id, ref, far, late) says that id's level is
    at least ref's plus ``far`` and its slot at least ref's and ``late``. A round settles the calls whose references are all
    settled, and moves every edge to a call with one open reference on to that reference. Edges never grow in number,
    a chain of n calls takes about log2(n) rounds, and only calls that each wait for several others take one by one.
    """
    key = ["conv_id", "id"]
    nodes = calls.select(*key, "turn", _refs(F.col("arguments")).alias("refs"))
    late = calls.select("conv_id", F.col("id").alias("ref")).join(first_results.withColumnRenamed("id", "ref"), ["conv_id", "ref"], "left")
    edges = persist_table(
        nodes.select(*key, F.explode("refs").alias("ref")).join(late, ["conv_id", "ref"]).select(*key, "ref", F.lit(1).cast("long").alias("far"), F.col("result_turn").alias("late")), "refs"
    )
    base = nodes.select(*key, F.col("turn").alias("slot"), F.lit(0).cast("long").alias("level"))
    final = lambda df: df.select(*key, "slot", F.col("level").cast("int").alias("level"))
    if edges.isEmpty():
        return final(base)
    gained = lambda slot, level: [F.greatest(slot, "late").alias("slot"), (F.col(level) + F.col("far")).alias("level")]
    largest = lambda df: df.groupBy(*key).agg(F.max("slot").alias("slot"), F.max("level").alias("level"))
    waits = edges.select(*key).distinct()
    fresh = persist_table(base.join(waits, key, "left_anti"), "fresh")
    waiting = persist_table(base.join(waits, key, "left_semi"), "waiting")
    settled = [(0, fresh)]
    while not fresh.isEmpty():
        at = fresh.select("conv_id", F.col("id").alias("ref"), F.col("slot").alias("s"), F.col("level").alias("l"))
        met = persist_table(edges.join(at, ["conv_id", "ref"], "left"), "met")
        left = met.where("l is null").groupBy(*key, "ref").agg(F.max("far").alias("far"), F.max("late").alias("late"))
        counted = left.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("ref", "far", "late")).alias("only"))
        known = largest(waiting.union(met.where("l is not null").select(*key, *gained("s", "l"))))
        known = persist_table(known.join(counted, key, "left"), "known")
        fresh = persist_table(known.where("n is null").select(*key, "slot", "level"), "fresh")
        single = known.where("n = 1").select("conv_id", F.col("id").alias("ref"), F.col("slot").alias("s"), F.col("level").alias("l"), "only")
        moved = persist_table(left.join(single, ["conv_id", "ref"], "left"), "moved")
        waiting_now = persist_table(largest(known.where("n is not null").select(*key, "slot", "level").union(moved.where("l is not null").select(*key, *gained("s", "l")))), "waiting")
        step = moved.select(*key, F.coalesce("only.ref", "ref").alias("ref"), F.least(F.col("far") + F.coalesce("only.far", F.lit(0)), F.lit(_FAR)).alias("far"), F.greatest("late", "only.late").alias("late"))
        edges_now = persist_table(step, "refs")
        for old in (edges, waiting, met, known, moved):
            drop_table(old)
        edges, waiting = edges_now, waiting_now
        # tables of like age merge, so that many rounds leave few of them
        settled.append((0, fresh))
        while len(settled) > 2 and settled[-2][0] == settled[-3][0]:
            (age, a), (_, b), last = settled[-3:]
            settled[-3:] = [(age + 1, persist_table(a.union(b), "settled")), last]
            drop_table(a)
            drop_table(b)
    every = settled[0][1]
    for _, more in settled[1:]:
        every = every.union(more)
    return final(every)


def link(conversations: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, slot, level, role, kind, json, n_calls, n_linked, problems.

    Sorting a conversation by (slot, level, turn) puts every result after its call and every call after the
    results it refers to; a message stands where its latest call does, so that calls of one message that stand apart
    can come after what refers to the earlier of them. ``kind`` is message, calls or result; ``json`` is the message in canonical JSON (sorted
    keys, no white space), its calls ordered by (slot, level, place). ``n_linked`` counts the calls that have a
    result (of a result: 1 if its call is known). ``problems`` is a sorted array: arguments (no JSON object), tool
    (not defined in the conversation), missing:, type:, enum:, bound: and extra: (against the
    schema, with the path of the member, as in a.b[0]), duplicate (the id was used
    before; such a call is not linked), no_id, no_result, no_call (a result of none), ref: (no such call), cycle.

    Null conv_ids are kept and never linked; null texts have null content; an empty table gives an empty result.
    Repeated rows repeat their messages, a repeated call being a duplicate. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls_of = F.when((F.col("role") == "assistant") & F.col("text").contains('"tool_calls"'), F.from_json("text", _CALLS))
    result_of = F.when((F.col("role") == "tool") & F.col("text").contains('"tool_call_id"'), F.from_json("text", _RESULT))
    rows = rows.withColumn("c", calls_of).withColumn("r", result_of)
    is_calls = F.coalesce(F.size("c.tool_calls") > 0, F.lit(False))
    is_result = F.col("r.tool_call_id").isNotNull()
    none = F.array().cast("array<string>")

    plain = rows.where(~is_calls & ~is_result).select(
        "conv_id", "turn", F.col("turn").alias("slot"), F.lit(0).alias("level"), "role", F.lit("message").alias("kind"),
        F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")).alias("json"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_linked"), none.alias("problems"),
    )
    talk = rows.where(is_calls | is_result)
    if talk.limit(1).count() == 0:
        return plain
    # message keys: rows have no identity of their own, so each gets one before anything is joined
    talk = persist_table(talk.select("conv_id", "turn", "role", "text").withColumn("mid", F.expr("uuid()")), "talk").withColumn("c", calls_of).withColumn("r", result_of)
    messages = talk.where(is_calls)
    each = messages.select("mid", "conv_id", "turn", F.posexplode("c.tool_calls").alias("pos", "t")).select("mid", "conv_id", "turn", "pos", "t.id", F.coalesce("t.name", F.lit("")).alias("name"), F.coalesce("t.arguments", F.lit("")).alias("arguments"))
    results = talk.where(is_result).select("mid", "conv_id", "turn", F.col("r.tool_call_id").alias("id"), F.col("r.content").alias("content"))
    owners = each.where("id is not null and conv_id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "mid", "pos")).alias("first"))
    each = each.join(owners, ["conv_id", "id"], "left").withColumn("own", F.coalesce((F.col("first.mid") == F.col("mid")) & (F.col("first.pos") == F.col("pos")), F.lit(False))).drop("first")
    checked = persist_table(_validated(each, _tools(rows)), "calls")
    real = checked.where("own")
    first_results = results.groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))
    order = persist_table(_ordered(real.select("conv_id", "id", "turn", "arguments"), first_results), "order")

    wanted = checked.select("mid", "pos", "conv_id", F.explode(_refs(F.col("arguments"))).alias("ref"))
    lost = wanted.join(real.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti").groupBy("mid", "pos").agg(F.transform(F.sort_array(F.collect_list("ref")), lambda x: F.concat(F.lit("ref:"), x)).alias("lost"))
    full = checked.join(order, ["conv_id", "id"], "left").join(first_results, ["conv_id", "id"], "left").join(lost, ["mid", "pos"], "left")
    linked = F.col("own") & F.col("result_turn").isNotNull()
    why = F.concat(
        F.col("problems"), F.coalesce("lost", none),
        F.when(F.col("id").isNull(), F.array(F.lit("no_id"))).when(~F.col("own"), F.array(F.lit("duplicate"))).when(F.col("result_turn").isNull(), F.array(F.lit("no_result"))).otherwise(none),
        F.when(F.col("own") & F.col("slot").isNull(), F.array(F.lit("cycle"))).otherwise(none),
    )
    text = F.concat(F.lit('{"arguments":'), _canonical(F.col("arguments")), F.lit(',"id":'), _quoted(F.col("id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit("}"))
    by_message = full.select("mid", F.struct(F.coalesce("slot", "turn").alias("slot"), F.coalesce("level", F.lit(0)).alias("level"), "pos", text.alias("text")).alias("s"), linked.cast("int").alias("linked"), why.alias("why"))
    by_message = by_message.groupBy("mid").agg(F.sort_array(F.collect_list("s")).alias("s"), F.count("*").cast("int").alias("n_calls"), F.sum("linked").cast("int").alias("n_linked"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("problems"))
    called = messages.join(by_message, "mid").select(
        "conv_id", "turn", F.greatest("turn", F.array_max(F.transform("s", lambda x: x["slot"]))).alias("slot"), F.array_max(F.transform("s", lambda x: x["level"])).alias("level"), "role", F.lit("calls").alias("kind"),
        F.concat(F.lit('{"content":'), _quoted(F.col("c.content")), F.lit(',"role":'), _quoted(F.col("role")), F.lit(',"tool_calls":['), F.array_join(F.transform("s", lambda x: x["text"]), ","), F.lit("]}")).alias("json"),
        "n_calls", "n_linked", "problems",
    )
    target = real.select("conv_id", "id", "name", F.col("mid").alias("call_mid"))
    place = called_place(messages, by_message)
    answered = results.join(target, ["conv_id", "id"], "left").join(place, "call_mid", "left")
    answered = answered.select(
        "conv_id", "turn", F.greatest("turn", F.coalesce("call_slot", "turn")).alias("slot"), F.coalesce(F.col("call_level") + 1, F.lit(0)).alias("level"), F.lit("tool").alias("role"), F.lit("result").alias("kind"),
        F.concat(F.lit('{"content":'), _canonical(F.col("content")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("id")), F.lit("}")).alias("json"),
        F.lit(0).alias("n_calls"), F.col("name").isNotNull().cast("int").alias("n_linked"), F.when(F.col("name").isNull(), F.array(F.lit("no_call"))).otherwise(none).alias("problems"),
    )
    return plain.union(called.select(COLUMNS)).union(answered.select(COLUMNS))


def called_place(messages: DataFrame, by_message: DataFrame) -> DataFrame:
    """(call_mid, call_slot, call_level): where a message with calls stands."""
    slot = F.greatest("turn", F.array_max(F.transform("s", lambda x: x["slot"])))
    return messages.join(by_message, "mid").select(F.col("mid").alias("call_mid"), slot.alias("call_slot"), F.array_max(F.transform("s", lambda x: x["level"])).alias("call_level"))
