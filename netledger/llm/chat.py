"""Chat formatting with tool-call linking, in built-in column functions.

Turns become messages in canonical JSON: keys in order, no blanks, null members left out, numbers without
trailing zeros. Calls stand in assistant turns as <tool_call>{"id": .., "name": .., "arguments": {..},
"after": [ids]}</tool_call>, results in tool turns as {"tool_call_id": .., "content": ..}, bare or within
<tool_response> tags. Calls and results meet in a hash join on (conversation, identifier), which splits
even a conversation that holds a third of all turns. Only turns that have either take part; all others
pass by.

A message's place in its conversation is the triple (order_turn, order_step, turn). Turns keep their
order, but a result comes after its call, and a call after the results of the calls that its member
``after`` names, even if they were logged the other way round. Calls that wait for others are placed by
doubled strides along their chains. Calls that wait for each other in a circle, and those that wait for
these, keep their turn; a call that isn't there is not waited for. Triples are used because a running number would need each
conversation in one task.

Null texts are empty contents, null roles are left out, repeated turns each give a message. A call
that repeats an identifier is linked through the first call that has it. Status is ``ok``,
``invalid_call`` (unreadable, unknown tool, or arguments against the schema), ``unanswered_call``, or
``orphan_result``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netledger.llm.common import table
from netledger.session import stored

CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
RESULT = r"(?s)^\s*(?:<tool_response>)?\s*(\{.*\})\s*(?:</tool_response>)?\s*$"

#: Schemas of the arguments by tool, in the words of JSON Schema: type, enum, minimum, maximum,
#: maxLength, properties, required, additionalProperties, items, minItems, maxItems.
SCHEMAS: dict[str, dict] = {
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "maxLength": 1000}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}, "order": {"type": "string", "enum": ["date", "rank"]}},
    },
    "fetch": {
        "type": "object", "required": ["url"], "additionalProperties": False,
        "properties": {"url": {"type": "string"}, "headers": {"type": "object", "properties": {"accept": {"type": "string"}}, "required": ["accept"]}},
    },
    "calculate": {
        "type": "object", "required": ["values"], "additionalProperties": False,
        "properties": {"values": {"type": "array", "items": {"type": "number"}, "minItems": 1}, "exact": {"type": "boolean"}},
    },
}

#: Types of variants that stand for a JSON type; whole numbers written with a fraction are integers, too.
_KINDS = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(.*\)|DOUBLE)$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$",
}


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant fits a schema; null, which stands for a missing value, does not."""
    tests = []
    kind = F.schema_of_variant(value)
    get = lambda path, as_type: F.try_variant_get(value, path, as_type)
    if "type" in schema:
        tests.append(kind.rlike(_KINDS[schema["type"]]))
        if schema["type"] == "integer":
            tests.append(get("$", "double") == F.floor(get("$", "double")))
    if "enum" in schema:
        tests.append(F.to_json(value).isin([_json(v) for v in schema["enum"]]))
    for word, compare in (("minimum", lambda v, bound: v >= bound), ("maximum", lambda v, bound: v <= bound)):
        if word in schema:
            tests.append(~kind.rlike(_KINDS["number"]) | compare(get("$", "double"), schema[word]))
    if "maxLength" in schema:
        tests.append((kind != "STRING") | (F.length(get("$", "string")) <= schema["maxLength"]))
    members = schema.get("properties", {})
    for name, inner in members.items():
        member = get(f"$['{name}']", "variant")
        tests.append(F.coalesce(fits(member, inner), F.lit(name not in schema.get("required", ()))))
    for name in schema.get("required", ()):
        if name not in members:
            tests.append(get(f"$['{name}']", "variant").isNotNull())
    if schema.get("additionalProperties") is False:
        given = F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))
        unknown = F.array_except(given, F.array(*[F.lit(n) for n in members])) if members else given
        tests.append(F.coalesce(F.size(unknown), F.lit(0)) <= 0)
    if {"items", "minItems", "maxItems"} & set(schema):
        entries = get("$", "array<variant>")
        if "items" in schema:
            tests.append(F.coalesce(F.forall(entries, lambda e: F.coalesce(fits(e, schema["items"]), F.lit(False))), F.lit(True)))
        if "minItems" in schema:
            tests.append(F.coalesce(F.size(entries) >= schema["minItems"], F.lit(True)))
        if "maxItems" in schema:
            tests.append(F.coalesce(F.size(entries) <= schema["maxItems"], F.lit(True)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return F.when(value.isNotNull(), F.coalesce(out, F.lit(False)))


def _json(value: object) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def valid_arguments(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether the variant ``arguments`` fits the schema of the tool ``name``; false for unknown tools."""
    verdict = F.lit(False)
    for tool, schema in schemas.items():
        verdict = F.when(name == tool, fits(arguments, schema)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def _calls(text: Column, schemas: dict) -> Column:
    def one(raw: Column) -> Column:
        v = F.try_parse_json(raw)
        get = lambda path, kind: F.try_variant_get(v, path, kind)
        arguments = get("$.arguments", "variant")
        return F.struct(
            arguments.alias("arguments"), get("$.id", "string").alias("id"), get("$.name", "string").alias("name"),
            F.when(v.isNull(), raw).alias("raw"), get("$.after", "array<string>").alias("after"),
            (get("$.id", "string").isNotNull() & valid_arguments(get("$.name", "string"), arguments, schemas)).alias("valid"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), one)


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _after(place: Column, steps: Column | int) -> Column:
    """So many steps after a place (turn, step); null after none."""
    return F.when(place.isNotNull(), F.struct(place["turn"].alias("turn"), (place["step"] + steps).alias("step")))


def _later(place: Column) -> Column:
    """The next step after a place (turn, step)."""
    return F.struct(place["turn"].alias("turn"), (place["step"] + 1).alias("step"))


def _own(turn: Column | str) -> Column:
    return F.struct(F.col(turn).alias("turn") if isinstance(turn, str) else turn.alias("turn"), F.lit(0).alias("step"))


def _strides(pointers: DataFrame) -> DataFrame:
    """Pointers (conv_id, id, needs, least, steps) followed as far as they lead.

    A place is at least ``least`` and ``steps`` after the place of ``needs``; two such bounds make one, so each round
    joins the pointers to themselves and doubles their strides. Pointers in or into circles, which
    remain when a round brings no other to its end, are left out.
    """
    walk, left, before = stored(pointers.withColumn("open", F.lit(True))), -1, -2
    while left and left != before:
        ahead = walk.select("conv_id", F.col("id").alias("needs"), F.col("needs").alias("next"), F.col("least").alias("bound"), F.col("steps").alias("more"))
        there = F.col("b.next").isNotNull()
        walk = stored(walk.alias("a").join(ahead.alias("b"), _same("a", "b", "conv_id", "needs"), "left").select(
            "a.conv_id", "a.id", F.coalesce("b.next", "a.needs").alias("needs"), F.when(there, F.greatest("a.least", _after(F.col("b.bound"), F.col("a.steps")))).otherwise(F.col("a.least")).alias("least"),
            (F.col("a.steps") + F.coalesce("b.more", F.lit(0))).alias("steps"), there.alias("open"),
        ))
        left, before = walk.filter("open").count(), left
    return walk.filter("NOT open").drop("open")


def placed_calls(first: DataFrame, waits: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, id, place) of the first calls (conv_id, id, call_turn) of identifiers: their turn, or the
    step after all results (conv_id, id, turn) of the calls that they wait for (conv_id, id, needs).

    Only calls that wait or are waited for take part in the rounds. A round folds calls that are placed into those that
    wait for them, and then follows the calls that still wait for one call alone, by doubled strides. A chain of n calls takes
    some log(n) rounds; where calls wait for several open ones, a further round goes to each level of these.
    """
    own = first.select("conv_id", "id", _own("call_turn").alias("place"))
    known = first.select("conv_id", F.col("id").alias("needs"))
    result_turn = answers.filter("id IS NOT NULL").groupBy("conv_id", F.col("id").alias("needs")).agg(F.max("turn").alias("turn"))
    met = waits.alias("w").join(known.hint("shuffle_hash").alias("k"), _same("w", "k", "conv_id", "needs")).select("w.conv_id", "w.id", "w.needs").distinct()
    # after a call without a result its own place counts, else also the step after the result
    answered = F.col("r.turn").isNotNull()
    edges = stored(met.alias("e").join(result_turn.alias("r"), _same("e", "r", "conv_id", "needs"), "left").select(
        "e.conv_id", "e.id", "e.needs", F.when(answered, _later(_own(F.col("r.turn")))).alias("least"), F.when(answered, 2).otherwise(1).alias("steps")))
    if edges.isEmpty():
        return own
    part = edges.select("conv_id", "id").withColumn("open", F.lit(True)).unionByName(edges.select("conv_id", F.col("needs").alias("id")).withColumn("open", F.lit(False)))
    part = part.groupBy("conv_id", "id").agg(F.max("open").alias("open"))
    state = stored(own.alias("o").join(part.alias("p"), _same("o", "p", "conv_id", "id")).select("o.conv_id", "o.id", "o.place", "p.open"))
    before = None
    while True:
        done = state.filter("NOT open").select("conv_id", F.col("id").alias("needs"), "place")
        reached = F.when(F.col("d.place").isNotNull(), F.greatest("e.least", _after(F.col("d.place"), F.col("e.steps"))))
        told = stored(edges.alias("e").join(done.alias("d"), _same("e", "d", "conv_id", "needs"), "left").select("e.*", reached.alias("reached")))
        bound = told.groupBy("conv_id", "id").agg(F.max("reached").alias("reached"), F.count_if(F.col("reached").isNull()).alias("waiting"))
        state = stored(state.alias("s").join(bound.alias("b"), _same("s", "b", "conv_id", "id"), "left").select(
            "s.conv_id", "s.id", F.greatest("s.place", "b.reached").alias("place"), (F.col("s.open") & (F.coalesce("b.waiting", F.lit(1)) > 0)).alias("open")))
        edges = stored(told.filter("reached IS NULL").groupBy("conv_id", "id", "needs").agg(F.max("least").alias("least"), F.max("steps").alias("steps")))
        now = (state.filter("open").count(), edges.count())
        if not now[0] or now == before:
            break
        before = now
        alone = edges.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("needs").alias("needs"), F.max("least").alias("least"), F.max("steps").alias("steps")).filter("n = 1")
        alone = alone.alias("a").join(state.filter("open").alias("s"), _same("a", "s", "conv_id", "id")).select("a.conv_id", "a.id", "a.needs", F.greatest("a.least", "s.place").alias("least"), "a.steps")
        far = _strides(alone).withColumnsRenamed({"id": "at", "needs": "next", "least": "bound", "steps": "more"})
        edges = stored(edges.alias("e").join(far.withColumn("needs", F.col("at")).alias("f"), _same("e", "f", "conv_id", "needs"), "left").select(
            "e.conv_id", "e.id", F.coalesce("f.next", "e.needs").alias("needs"),
            F.when(F.col("f.next").isNotNull(), F.greatest("e.least", _after(F.col("f.bound"), F.col("e.steps")))).otherwise(F.col("e.least")).alias("least"), (F.col("e.steps") + F.coalesce("f.more", F.lit(0))).alias("steps")))
    placed = state.filter("NOT open").select("conv_id", "id", "place")
    return own.alias("o").join(placed.alias("p"), _same("o", "p", "conv_id", "id"), "left").select("o.conv_id", "o.id", F.coalesce("p.place", "o.place").alias("place"))


def format_chats(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One message per row of ``turns`` (conv_id, turn, role, text): (conv_id, turn, order_turn,
    order_step, status, n_calls, n_invalid, message)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_call = (F.col("role") == "assistant") & F.contains(text, F.lit("<tool_call>"))
    is_result = F.col("role") == "tool"
    rows = turns.select("conv_id", "turn", "role", text.alias("text"), F.coalesce(has_call, F.lit(False)).alias("has_call"), F.coalesce(is_result, F.lit(False)).alias("is_result"))
    plain = rows.filter(~F.col("has_call") & ~F.col("is_result"))
    nothing = F.lit(0).cast("long")
    messages = plain.select(
        "conv_id", "turn", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.lit("ok").alias("status"),
        nothing.alias("n_calls"), nothing.alias("n_invalid"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("message"),
    )
    # the few turns with calls or results are parsed once; what is stored of them are messages and links
    calling = rows.filter("has_call").withColumn("calls", _calls(F.col("text"), schemas)).withColumn("digest", F.xxhash64("text"))
    calling = stored(calling.select(
        "conv_id", "turn", "digest", F.size("calls").cast("long").alias("n_calls"), F.size(F.filter("calls", lambda c: ~c["valid"])).cast("long").alias("n_invalid"),
        F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["after"].alias("after"))).alias("made"),
        F.to_json(
            F.struct(
                F.trim(F.regexp_replace("text", CALL, "")).alias("content"), "role",
                F.transform("calls", lambda c: F.struct(c["after"].alias("after"), c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"), c["raw"].alias("raw"))).alias("tool_calls"),
            )
        ).alias("message"),
    ))
    content = F.coalesce(F.try_variant_get("v", "$.content", "variant"), F.try_parse_json(F.to_json(F.struct("text"))))
    answers = rows.filter("is_result").withColumn("v", F.try_parse_json(F.regexp_extract("text", RESULT, 1))).withColumn("id", F.try_variant_get("v", "$.tool_call_id", "string"))
    answers = stored(answers.select("conv_id", "turn", "id", F.to_json(F.struct(content.alias("content"), "role", F.col("id").alias("tool_call_id"))).alias("message")))

    # hash join of results to the first call of their identifier
    made = calling.select("conv_id", "turn", "digest", F.explode("made").alias("c")).select("conv_id", "turn", "digest", "c.id", "c.after").filter("id IS NOT NULL")
    first = made.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    waits = made.select("conv_id", "id", F.explode("after").alias("needs")).filter("needs IS NOT NULL AND needs <> id")
    placed = stored(placed_calls(first, waits, answers.select("conv_id", "id", "turn")))
    linked = answers.alias("r").join(placed.hint("shuffle_hash").alias("c"), F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.id") == F.col("c.id")), "left")
    orphan = F.col("c.id").isNull()
    place = F.when(orphan, _own(F.col("r.turn"))).otherwise(F.greatest(_own(F.col("r.turn")), _later(F.col("c.place"))))
    results = linked.select(
        "r.conv_id", "r.turn", place["turn"].alias("order_turn"), place["step"].alias("order_step"), F.when(orphan, "orphan_result").otherwise("ok").alias("status"),
        nothing.alias("n_calls"), nothing.alias("n_invalid"), "r.message",
    )

    # and of calls to whether they were answered, and to where they stand
    answered = answers.filter("id IS NOT NULL").select("conv_id", "id").distinct().withColumn("hit", F.lit(1))
    open_calls = made.alias("m").join(
        answered.hint("shuffle_hash").alias("a"), F.col("m.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("m.id") == F.col("a.id")), "left"
    ).join(placed.hint("shuffle_hash").alias("p"), F.col("m.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("m.id") == F.col("p.id")), "left")
    open_calls = open_calls.groupBy("m.conv_id", "m.turn", "m.digest").agg(F.max(F.col("hit").isNull()).alias("open"), F.max("p.place").alias("place"))
    asked = calling.alias("x").join(
        open_calls.alias("o"), F.col("x.conv_id").eqNullSafe(F.col("o.conv_id")) & F.col("x.turn").eqNullSafe(F.col("o.turn")) & (F.col("x.digest") == F.col("o.digest")), "left"
    )
    stands = F.greatest(_own(F.col("x.turn")), F.col("o.place"))
    asked = asked.select(
        "x.conv_id", "x.turn", stands["turn"].alias("order_turn"), stands["step"].alias("order_step"),
        F.when(F.col("n_invalid") > 0, "invalid_call").when(F.coalesce("o.open", F.lit(True)), "unanswered_call").otherwise("ok").alias("status"), "n_calls", "n_invalid", "message",
    )
    return messages.unionByName(results).unionByName(asked)


#: The drill: for each kind of case the rows (turn, role, text, message) that it adds to a conversation,
#: as SQL over conv_id, turn and the base of new turns ``t``; texts are badly laid out on purpose, and
#: messages are what they must become, with the identifier in place of @.
_GOOD = ('<tool_call>{ "name":"search", "arguments" : {"query":"q", "limit":3.0},"id":"@"}</tool_call>', '{"content":"","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"q"},"id":"@","name":"search"}]}')
_DONE = ('{"tool_call_id":"@" , "content":{"b":[1, 2.50],"a":null}}', '{"content":{"a":null,"b":[1,2.5]},"role":"tool","tool_call_id":"@"}')


def _call(arguments: str, canonical: str, name: str = "search", extra: str = "", mark: str = "@") -> tuple[str, str]:
    after = f',"after": ["{extra}"]' if extra else ""
    written = f'{{"after":["{extra}"],' if extra else "{"
    return (
        f'<tool_call>{{"name": "{name}","arguments":{arguments}, "id":"{mark}"{after}}}</tool_call>',
        f'{{"content":"","role":"assistant","tool_calls":[{written}"arguments":{canonical},"id":"{mark}","name":"{name}"}}]}}',
    )


def _result(mark: str = "@") -> tuple[str, str]:
    return _DONE[0].replace("@", mark), _DONE[1].replace("@", mark)


CASES: list[list[tuple[int, str, tuple[str, str]]]] = [
    [(1, "assistant", _GOOD), (2, "tool", _DONE)],
    [(1, "tool", _DONE), (2, "assistant", _GOOD)],
    [(1, "tool", _DONE)],
    [(1, "assistant", _GOOD)],
    [(1, "assistant", _call('{"query":"q","limit":0}', '{"limit":0,"query":"q"}')), (2, "tool", _DONE)],
    [(1, "assistant", _call('{"query":"q", "order":"size"}', '{"order":"size","query":"q"}')), (2, "tool", _DONE)],
    [(1, "assistant", ("<tool_call>{bad</tool_call>", '{"content":"","role":"assistant","tool_calls":[{"raw":"{bad"}]}'))],
    [(1, "assistant", _GOOD), (2, "assistant", _GOOD), (3, "tool", _DONE)],
    [(1, "assistant", _call('{"values":[1, 2.0,3.5],"exact":true}', '{"exact":true,"values":[1,2,3.5]}', "calculate")), (2, "tool", _DONE)],
    [(1, "assistant", _call('{"values":[1,"x"]}', '{"values":[1,"x"]}', "calculate")), (2, "tool", _DONE)],
    [(1, "assistant", _call('{"url":"u","headers":{}}', '{"headers":{},"url":"u"}', "fetch")), (2, "tool", _DONE)],
    [(1, "assistant", _call('{"query":"q"}', '{"query":"q"}', "unknown")), (2, "tool", _DONE)],
    [
        (1, "assistant", _call('{"query":"q"}', '{"query":"q"}', extra="@b")), (2, "tool", _DONE), (3, "assistant", _call('{"url":"u"}', '{"url":"u"}', "fetch", "@c", "@b")),
        (4, "assistant", _call('{"url":"v"}', '{"url":"v"}', "fetch", mark="@c")), (5, "tool", _result("@c")), (6, "tool", _result("@b")),
    ],
    [
        (1, "assistant", _call('{"query":"q"}', '{"query":"q"}', extra="@b")), (2, "assistant", _call('{"url":"u"}', '{"url":"u"}', "fetch", "@c", "@b")), (3, "assistant", _call('{"url":"v"}', '{"url":"v"}', "fetch", "@d", "@c")),
        (4, "assistant", _call('{"url":"w"}', '{"url":"w"}', "fetch", mark="@d")), (5, "tool", _DONE), (6, "tool", _result("@d")), (7, "tool", _result("@b")),
    ],
]

#: New turns stand far behind the turns that are there, SPAN apart.
BASE, SPAN = 1_000_000, 10


def drilled(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a case of the drill for every assistant turn, chosen by a
    hash of its numbers."""
    case = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 6), 16, 10).cast("long") % len(CASES)
    mark = F.concat(F.lit("c"), F.col("turn").cast("string"))
    start = BASE + SPAN * F.col("turn")
    rows = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for i, lines in enumerate(CASES):
        made = F.array(*[F.struct((start + at).alias("turn"), F.lit(role).alias("role"), F.replace(F.lit(text), F.lit("@"), mark).alias("text")) for at, role, (text, _) in lines])
        rows = F.when(F.col("case") == i, made).otherwise(rows)
    new = turns.filter("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("case", case).select("conv_id", F.explode(rows).alias("r"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(new.select("conv_id", "r.turn", "r.role", "r.text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as messages, together with a drill, as the table holds no calls of its own."""
    return format_chats(drilled(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """Links, order by recursion, and validity by joins on the JSON of the texts; messages as the cases give them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n  ".join(f"({i}, {at}, {quoted(role)}, {quoted(text)}, {quoted(message)})" for i, lines in enumerate(CASES) for at, role, (text, message) in lines)
    number = lambda path: f"json_extract(a, '{path}')::DOUBLE"
    keys = lambda *allowed: "len(list_filter(json_keys(a), lambda k: k NOT IN (" + ", ".join(f"'{k}'" for k in allowed) + "))) = 0"
    kind = lambda path: f"json_type(a, '{path}')"
    numbers = "('BIGINT', 'UBIGINT', 'DOUBLE')"
    return rf"""
WITH RECURSIVE cases(kase, step, role, text, message) AS (VALUES {values}),
d AS (
  SELECT conv_id, {BASE} + {SPAN} * turn + step AS turn, cases.role, replace(cases.text, '@', 'c' || turn) AS text, replace(message, '@', 'c' || turn) AS message
  FROM conversations AS v JOIN cases ON kase = ('0x' || md5(concat_ws('|', conv_id, turn))[1:6])::BIGINT % {len(CASES)} WHERE v.role = 'assistant'
), j AS (
  SELECT *, CASE WHEN role = 'assistant' THEN regexp_extract(text, '(?s)<tool_call>(.*)</tool_call>', 1) ELSE text END AS body FROM d
), p AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM j),
c AS (
  SELECT conv_id, turn, message, b ->> '$.id' AS id, b ->> '$.name' AS name, b -> '$.arguments' AS a, b ->> '$.after[0]' AS needs FROM p WHERE role = 'assistant'
), r AS (SELECT conv_id, turn, message, b ->> '$.tool_call_id' AS id FROM p WHERE role = 'tool'),
checked AS (
  SELECT *, coalesce(CASE name
    WHEN 'search' THEN {kind('$.query')} = 'VARCHAR' AND {keys('query', 'limit', 'order')} AND coalesce({kind('$.limit')} IN {numbers} AND {number('$.limit')} BETWEEN 1 AND 100 AND {number('$.limit')} % 1 = 0, true)
      AND coalesce(a ->> '$.order' IN ('date', 'rank'), true)
    WHEN 'fetch' THEN {kind('$.url')} = 'VARCHAR' AND {keys('url', 'headers')} AND CASE WHEN {kind('$.headers')} IS NULL THEN true ELSE {kind('$.headers')} = 'OBJECT' AND coalesce({kind('$.headers.accept')} = 'VARCHAR', false) END
    WHEN 'calculate' THEN {kind('$.values')} = 'ARRAY' AND json_array_length(a, '$.values') > 0 AND len(list_filter(json_extract(a, '$.values[*]'), lambda x: json_type(x) NOT IN {numbers})) = 0
      AND {keys('values', 'exact')} AND coalesce({kind('$.exact')} = 'BOOLEAN', true)
    ELSE false END, false) AND id IS NOT NULL AS valid FROM c
), f AS (SELECT conv_id, id, min(turn) AS turn, any_value(needs) AS needs FROM c WHERE id IS NOT NULL GROUP BY ALL),
res AS (SELECT conv_id, id, max(turn) AS turn FROM r GROUP BY ALL),
pl(conv_id, id, t, s) AS (
  SELECT f.conv_id, f.id, f.turn, 0 FROM f LEFT JOIN f AS g ON f.conv_id = g.conv_id AND f.needs = g.id WHERE g.id IS NULL
  UNION ALL
  SELECT conv_id, id, CASE WHEN turn > rt THEN turn ELSE rt END, CASE WHEN turn > rt THEN 0 ELSE rs + 1 END FROM (
    SELECT f.conv_id, f.id, f.turn, CASE WHEN res.turn > t THEN res.turn ELSE t END AS rt, CASE WHEN res.turn > t THEN 0 WHEN res.turn IS NULL THEN s ELSE s + 1 END AS rs
    FROM f JOIN pl ON f.conv_id = pl.conv_id AND f.needs = pl.id LEFT JOIN res ON res.conv_id = pl.conv_id AND res.id = pl.id)
)
SELECT conv_id, turn, turn AS order_turn, 0 AS order_step, 'ok' AS status, 0::BIGINT AS n_calls, 0::BIGINT AS n_invalid,
  CASE WHEN role IS NULL THEN to_json({{'content': coalesce(text, '')}})
  ELSE to_json({{'content': coalesce(text, ''), 'role': role}}) END::VARCHAR AS message
FROM conversations
UNION ALL
SELECT r.conv_id, r.turn, CASE WHEN t IS NULL OR r.turn > t THEN r.turn ELSE t END, CASE WHEN t IS NULL OR r.turn > t THEN 0 ELSE s + 1 END, CASE WHEN t IS NULL THEN 'orphan_result' ELSE 'ok' END, 0, 0, message
FROM r LEFT JOIN pl USING (conv_id, id)
UNION ALL
SELECT k.conv_id, k.turn, CASE WHEN t IS NULL OR k.turn > t THEN k.turn ELSE t END, CASE WHEN t IS NULL OR k.turn > t THEN 0 ELSE s END,
  CASE WHEN NOT valid THEN 'invalid_call' WHEN res.turn IS NULL THEN 'unanswered_call' ELSE 'ok' END, 1, (NOT valid)::BIGINT, message
FROM checked AS k LEFT JOIN pl USING (conv_id, id) LEFT JOIN res USING (conv_id, id)"""


SQL = _sql()
