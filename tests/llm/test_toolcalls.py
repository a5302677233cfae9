import json
import random

import duckdb

from fidelis.llm import queries, toolcalls

ROWS = "conv_id long, turn long, role string, text string, level string"


def call(id_, name, args):
    return {"id": id_, "name": name, "arguments": args}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROWS)


TOOLS = {"tools": [{"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}}, {"name": "say", "parameters": {"properties": {"t": {"type": "string"}, "l": {"type": "array"}, "o": {"type": "object"}, "f": {"type": "boolean"}}}}]}


def test_links_and_validation(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOLS)),
        (1, 1, "user", 'hi "there"\n é'),
        (1, 2, "assistant", json.dumps({"content": None, "tool_calls": [call("c2", "say", {"t": {"$ref": "c1"}}), call("c1", "add", {"b": 1.5, "a": 2})]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": {"z": 1, "a": [1, 2]}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "nope", "content": "x"})),
        (1, 5, "assistant", json.dumps({"content": "more", "tool_calls": [call("c3", "add", {"a": 1.5, "x": 1}), call("c1", "add", {"a": 1, "b": 2}), call(None, "what", "not json"), call("c4", "say", json.dumps({"l": [1], "o": {}, "f": True, "t": "s"}))]})),
        (1, 6, "tool", json.dumps({"tool_call_id": "c4", "content": "fine"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "other conversation"})),
        (3, 0, "tool", json.dumps({"tool_call_id": "late", "content": "early"})),
        (3, 1, "assistant", json.dumps({"tool_calls": [call("late", "f", {}), call("u", "f", {"v": {"$ref": "gone"}})]})),
        (4, 0, "assistant", json.dumps({"tool_calls": [call("p", "f", {"v": {"$ref": "q"}}), call("q", "f", {"v": {"$ref": "p"}})]})),
        (None, 0, "assistant", json.dumps({"tool_calls": [call("c1", "f", {})]})),
        (5, 0, None, None),
        (5, 1, "assistant", '{"tool_calls": broken'),
        (5, 2, "user", "x" * 200_000),
    ]
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].json == json.dumps({"content": 'hi "there"\n é', "role": "user"}, separators=(",", ":"), ensure_ascii=False)
    first = got[1, 2]
    assert (first.kind, first.n_calls, first.n_linked, first.level, first.slot) == ("calls", 2, 1, 1, 3)
    assert json.loads(first.json)["tool_calls"] == [call("c1", "add", {"a": 2, "b": 1.5}), call("c2", "say", {"t": {"$ref": "c1"}})]
    assert '"arguments":{"a":2,"b":1.5}' in first.json and first.problems == ["no_result", "type:t"]
    assert got[1, 3].json == '{"content":{"a":[1,2],"z":1},"name":"add","role":"tool","tool_call_id":"c1"}'
    assert got[1, 4].problems == ["no_call"] and got[1, 4].n_linked == 0
    second = got[1, 5]
    assert second.problems == sorted(["type:a", "extra:x", "missing:b", "no_result", "duplicate", "arguments", "no_id"])
    assert (second.n_calls, second.n_linked) == (4, 1)
    assert got[1, 6].n_linked == 1 and got[2, 0].problems == ["no_call"]
    assert got[3, 0].slot == 1 and got[3, 0].level == 1 and got[3, 1].problems == ["no_result", "ref:gone", "tool"]
    assert "cycle" in got[4, 0].problems and got[None, 0].problems == ["duplicate", "tool"]
    assert got[5, 0].json == '{"content":null,"role":null}' and got[5, 1].kind == "message" and len(got[5, 2].json) > 200_000


def test_order_is_topological(spark):
    rows, n = [], 12
    for i in range(n):  # each call needs the next one's result: the chain is as long as the conversation
        rows.append((7, i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", "f", {"v": {"$ref": f"k{i + 1}"}} if i < n - 1 else {})]})))
        rows.append((7, n + i, "tool", json.dumps({"tool_call_id": f"k{i}", "content": i})))
    got = sorted(toolcalls.link(frame(spark, rows)).collect(), key=lambda r: (r.slot, r.level, r.turn))
    at = {(r.kind, json.loads(r.json).get("tool_call_id") or json.loads(r.json)["tool_calls"][0]["id"]): i for i, r in enumerate(got)}
    for i in range(n):
        assert at["result", f"k{i}"] > at["calls", f"k{i}"]
        if i < n - 1:
            assert at["calls", f"k{i}"] > at["calls", f"k{i + 1}"]


def test_empty(spark):
    assert toolcalls.link(frame(spark, [])).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op5_tool_call_linking"])
    got = queries.op5_tool_call_linking(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


NESTED = {
    "tools": [
        {
            "name": "book",
            "parameters": {
                "type": "object",
                "required": ["who"],
                "additionalProperties": False,
                "properties": {
                    "who": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2}, "age": {"type": ["integer", "null"], "minimum": 0}}},
                    "days": {"type": "array", "maxItems": 3, "items": {"type": "object", "properties": {"d": {"enum": ["mo", "tu", 3]}}, "additionalProperties": {"type": "number", "exclusiveMaximum": 10}}},
                },
            },
        },
        {"name": "any"},
    ]
}


def schema_problems(schema, value, path=""):
    """Plain recursion over a schema, as JSON Schema has it, with the labels of the operator."""
    types = schema.get("type")
    types = [types] if isinstance(types, str) else types
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"string": isinstance(value, str), "integer": number and value == int(value), "number": number, "boolean": isinstance(value, bool), "array": isinstance(value, list), "object": isinstance(value, dict), "null": value is None}
    out = [] if types is None or any(fits[t] for t in types) else [f"type:{path}"]
    if "enum" in schema and not any(e == value and isinstance(e, bool) == isinstance(value, bool) for e in schema["enum"]):
        out.append(f"enum:{path}")
    low, high = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(type(value), ("minimum", "maximum"))
    size = len(value) if isinstance(value, (str, list)) else value if number else None
    if size is not None and (size < schema.get(low, size) or size > schema.get(high, size) or (number and (size <= schema.get("exclusiveMinimum", size - 1) or size >= schema.get("exclusiveMaximum", size + 1)))):
        out.append(f"bound:{path}")
    if isinstance(value, dict):
        here, known, more = path + "." if path else "", schema.get("properties", {}), schema.get("additionalProperties")
        out += [f"missing:{here}{k}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k not in known and more is False:
                out.append(f"extra:{here}{k}")
            inner = known.get(k, more)
            out += schema_problems(inner, v, here + k) if isinstance(inner, dict) else []
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        out += [p for i, v in enumerate(value) for p in schema_problems(schema["items"], v, f"{path}[{i}]")]
    return out


def refs_of(value):
    if isinstance(value, dict):
        return {v for k, v in value.items() if k == "$ref" and isinstance(v, str)}.union(*map(refs_of, value.values()))
    return set().union(*map(refs_of, value)) if isinstance(value, list) else set()


def linked(rows, tools):
    """{(conv_id, turn): (slot, level, n_calls, n_linked, problems)} of messages with calls and of results, one at a time."""
    calls, results, said = {}, {}, {}
    for conv, turn, role, text in rows:
        body = json.loads(text)
        if role == "assistant":
            said[conv, turn] = body["tool_calls"]
            for c in body["tool_calls"]:
                calls.setdefault((conv, c["id"]), (turn, c))
        elif role == "tool":
            results.setdefault((conv, body["tool_call_id"]), turn)
    place = {}

    def settle(key, path=()):
        if key in path:
            return None
        if key not in place:
            conv, (turn, c) = key[0], calls[key]
            slot, level = turn, 0
            for r in refs_of(c["arguments"]):
                if (conv, r) in calls:
                    at = settle((conv, r), (*path, key))
                    if at is None:
                        place[key] = None
                        return None
                    slot, level = max(slot, at[0], results.get((conv, r), slot)), max(level, at[1] + 1)
            place[key] = slot, level
        return place[key]

    def cyclic(key):
        seen, todo = set(), [key]
        while todo:
            for r in refs_of(calls[todo.pop()][1]["arguments"]):
                k = key[0], r
                if k in calls and k not in seen:
                    seen.add(k)
                    todo.append(k)
        return any(on_cycle(k) for k in seen | {key})

    def on_cycle(key):
        seen, todo = set(), [key]
        while todo:
            for r in refs_of(calls[todo.pop()][1]["arguments"]):
                k = key[0], r
                if k == key:
                    return True
                if k in calls and k not in seen:
                    seen.add(k)
                    todo.append(k)
        return False

    out = {}
    for (conv, turn), its in said.items():
        why, places, n = set(), [(turn, 0)], 0
        used = set()
        for c in its:
            key, args = (conv, c["id"]), c["arguments"]
            own = calls[key][0] == turn and c["id"] not in used
            used.add(c["id"])
            why |= {f"ref:{r}" for r in refs_of(args) if (conv, r) not in calls}
            schema = tools.get(c["name"], ...)
            why |= {"tool"} if schema is ... else set(schema_problems(schema or {}, args))
            at = None if cyclic(key) else settle(key)
            if not own:
                why.add("duplicate")
            else:
                why |= (set() if key in results else {"no_result"}) | ({"cycle"} if at is None else set())
                n += key in results
            if at:
                places.append(at)
        out[conv, turn] = (max(s for s, _ in places), max(v for _, v in places), len(its), n, sorted(why))
    for conv, turn, role, text in rows:
        if role == "tool":
            key = conv, json.loads(text)["tool_call_id"]
            at = out[conv, calls[key][0]] if key in calls else None
            out[conv, turn] = (max(turn, at[0]), at[1] + 1, 0, 1, []) if at else (turn, 0, 0, 0, ["no_call"])
    return out


def test_random_conversations_against_plain_linker(spark):
    rng, rows = random.Random(5), []
    for conv in range(40):
        rows.append((conv, 0, "system", json.dumps(NESTED)))
        ids = [f'i{k}"' if k == 3 else f"i{k}" for k in range(rng.randint(2, 9))]
        for turn in range(1, rng.randint(3, 14)):
            if rng.random() < 0.35:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "none"]), "content": turn})))
                continue
            calls = []
            for _ in range(rng.randint(1, 3)):
                args = {} if rng.random() < 0.2 else {"who": rng.choice([{"name": "ab", "age": rng.choice([3, -1, None, 2.5, 4.0])}, {"name": "a"}, {"age": "x"}, [], "no", {"name": {"$ref": rng.choice(ids)}}])}
                if rng.random() < 0.6:
                    args["days"] = [rng.choice([{"d": "mo"}, {"d": 3.0}, {"d": "we", "n": 12}, {"n": 10, "m": "x"}, {"d": "tu", "n": 1.5}, 7, {"d": {"$ref": rng.choice([*ids, "gone"])}}]) for _ in range(rng.randint(0, 4))]
                if rng.random() < 0.2:
                    args["note"] = 'say "$ref": "i0" or \\"$ref":"i1"'
                calls.append(call(rng.choice(ids), rng.choice(["book", "book", "any", "lost"]), args))
            rows.append((conv, turn, "assistant", json.dumps({"content": None, "tool_calls": calls})))
    want = linked(rows, {t["name"]: t.get("parameters") for t in NESTED["tools"]})
    got = {(r.conv_id, r.turn): (r.slot, r.level, r.n_calls, r.n_linked, r.problems) for r in toolcalls.link(frame(spark, rows)).collect() if r.kind != "message"}
    assert got == want
    assert any("cycle" in w[4] for w in want.values()) and any(p.startswith("enum:days[") for w in want.values() for p in w[4])


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, written = 200, []
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", "f", {"v": [{"$ref": f"k{i - 1}"}]} if i else {})]})) for i in range(n)]
    persist = toolcalls.persist_table
    monkeypatch.setattr(toolcalls, "persist_table", lambda df, name: written.append(name) or persist(df, name))
    assert sorted(r.level for r in toolcalls.link(frame(spark, rows)).collect()) == list(range(n))
    assert written.count("met") <= 11
