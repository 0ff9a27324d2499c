"""Chat formatting: linking tool calls with their results, with built-in functions only.

Calls and results are hash-joined by conversation and identifier, calls are
put in an order in which each comes after those it depends on, arguments are
held against the tools' schemas and everything is written as canonical JSON
(keys sorted at every level, no white space), which variants give for free.
"""

from __future__ import annotations

import json as json_
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Turns that are numbered together; a conversation of any length is numbered in such pieces.
PIECE = 1024
# JSON types of a schema and the variant types that they allow.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "null": ("VOID",),
}

#: Schemas: tool -> a JSON Schema of its arguments, or the short form parameter -> (type, required) of plain values and no others.
Schemas = dict[str, dict]


def canonical(json: Column) -> Column:
    """Canonical text of a JSON string; null if it isn't JSON.

    Keys are sorted and white space goes. Numbers are written as variants hold
    them: whole numbers without a point (1.0 as 1), those with an exponent as
    doubles (1e3 as 1000.0).
    """
    return F.to_json(F.try_parse_json(json))


def step(parameter: str) -> str:
    """The path to a parameter, whatever characters its name has but both kinds of quotes."""
    return f'$["{parameter}"]' if "'" in parameter else f"$['{parameter}']"


def full_schema(schema: dict) -> dict:
    """The JSON Schema of a short form; a schema as it is."""
    if any(not isinstance(v, tuple) for v in schema.values()):
        return schema
    return {
        "type": "object",
        "properties": {p: {"type": type_} for p, (type_, _) in schema.items()},
        "required": [p for p, (_, required) in schema.items() if required],
        "additionalProperties": False,
    }


def kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_a(value: Column, type_: str) -> Column:
    """Whether a variant has a schema's type; a whole number is an integer however it is written, and however large."""
    fits = kind(value).isin(*TYPES[type_])
    if type_ == "integer":  # 1.0 and 1e3 are whole numbers, too
        fits = fits | (kind(value).isin(*TYPES["number"]) & (F.try_variant_get(value, "$", "double") % 1.0 == 0.0))
    return fits


def objections(value: Column, schema: dict, at: str = "") -> Column:
    """What a JSON Schema has against a variant, as an array of ``rule:place``; the place of an array's items is ``[]``.

    A value of another type has this one fault; what its schema says of other
    types doesn't concern it. Known: type (one or several), enum, minimum,
    maximum, minLength, maxLength, items, minItems, maxItems, properties,
    required and additionalProperties (false or true).
    """
    none = F.array().cast("array<string>")
    said = lambda bad, rule: F.when(bad, F.array(F.lit(f"{rule}:{at}"))).otherwise(none)
    parts = []
    if "enum" in schema:
        allowed = [json_.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]
        parts.append(said(~F.to_json(value).isin(*allowed), "enum"))
    as_double = F.when(is_a(value, "number"), F.try_variant_get(value, "$", "double"))
    length = F.when(is_a(value, "string"), F.char_length(F.try_variant_get(value, "$", "string")))
    items = F.when(is_a(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
    for least, most, size in (("minimum", "maximum", as_double), ("minLength", "maxLength", length), ("minItems", "maxItems", F.when(items.isNotNull(), F.size(items)))):
        parts += [said(size < schema[least], least)] if least in schema else []
        parts += [said(size > schema[most], most)] if most in schema else []
    if "items" in schema:
        parts.append(F.coalesce(F.array_distinct(F.flatten(F.transform(items, lambda v: objections(v, schema["items"], f"{at}[]")))), none))
    properties, required = schema.get("properties", {}), set(schema.get("required", ()))
    inside = f"{at}." if at else ""
    of_object = []
    for name in sorted(properties.keys() | required):
        child = F.try_variant_get(value, step(name), "variant")
        absent = F.array(F.lit(f"missing:{inside}{name}")) if name in required else none
        of_object.append(F.when(child.isNull(), absent).otherwise(objections(child, properties.get(name, {}), f"{inside}{name}")))
    if schema.get("additionalProperties") is False:
        unknown = F.array_except(F.json_object_keys(F.to_json(value)), F.array(*[F.lit(p) for p in sorted(properties)]).cast("array<string>"))
        of_object.append(F.transform(F.coalesce(unknown, none), lambda k: F.concat(F.lit(f"unknown:{inside}"), k)))
    if of_object:
        parts.append(F.when(is_a(value, "object"), F.concat(*of_object)).otherwise(none))
    out = F.concat(*parts) if parts else none
    types = schema.get("type", [])
    fits = [is_a(value, t) for t in ([types] if isinstance(types, str) else types)]
    return F.when(reduce(Column.__or__, fits), out).otherwise(F.array(F.lit(f"type:{at}"))) if fits else out


def errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as a sorted array of strings; empty if all is well: see :func:`objections`."""
    parsed = F.try_parse_json(arguments)
    out = F.array(F.lit("no_such_tool"))
    for tool, schema in sorted(schemas.items()):
        out = F.when(name == tool, F.array_sort(objections(parsed, full_schema(schema)))).otherwise(out)
    return F.when(parsed.isNull() | (kind(parsed) != "OBJECT"), F.array(F.lit("not_an_object"))).otherwise(out)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` for conversations in which some call stands before one that it needs.

    ``level`` is the longest way down to a call that needs nothing; calls of a
    circle and those that need one have none. Chains of calls that need one
    call each are shortened by pointer doubling, so the rounds follow the
    logarithm of their length; after that a round settles a level of the
    calls that need several.
    """
    keys = ["conv_id", "call_id"]
    place = calls.select("conv_id", F.col("call_id").alias("need"), F.col("at").alias("need_at"))
    edges = needs.distinct().join(place, ["conv_id", "need"]).join(calls.select(*keys, "at"), keys)
    odd = edges.where("need_at >= at").select("conv_id").distinct()
    edges = cut(edges.join(odd, "conv_id", "left_semi").select(*keys, "need"))
    if edges.isEmpty():
        return calls.select(*keys, F.lit(0).alias("level")).where("false")
    every = cut(calls.join(odd, "conv_id", "left_semi").select(*keys))
    several = cut(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))
    chain = cut(edges.join(several, keys, "left_anti").select(*keys, F.col("need").alias("to"), F.lit(1).alias("way")))
    longest = chain.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0
    for _ in range(longest.bit_length()):
        next_ = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("way").alias("more"))
        chain = cut(chain.join(next_, ["conv_id", "to"], "left").select(*keys, F.coalesce("further", "to").alias("to"), (F.col("way") + F.coalesce("more", F.lit(0))).alias("way")))
    # What a chain still leads to a call of a chain after so many rounds is a circle's: it never gets a level.
    inner = edges.join(several, keys, "left_semi")
    ends = chain.select("conv_id", F.col("call_id").alias("need"), "to", "way")
    waiting = cut(inner.join(ends, ["conv_id", "need"], "left").select(*keys, F.coalesce("to", "need").alias("need"), (F.coalesce("way", F.lit(0)) + 1).alias("way")))
    heads = every.join(chain.select(*keys), keys, "left_anti")
    settled = cut(heads.join(several, keys, "left_anti").withColumn("level", F.lit(0)))
    fresh, left = settled, several
    reached = cut(waiting.select(*keys, F.lit(0).alias("level")).limit(0))
    while not left.isEmpty() and not fresh.isEmpty():
        known = fresh.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("below"))
        hit = waiting.join(known, ["conv_id", "need"]).select(*keys, (F.col("below") + F.col("way")).alias("level"))
        reached = cut(reached.unionByName(hit).groupBy(*keys).agg(F.max("level").alias("level")))
        waiting = cut(waiting.join(known.select("conv_id", "need"), ["conv_id", "need"], "left_anti"))
        ready = left.join(waiting.select(*keys).distinct(), keys, "left_anti")
        fresh = cut(ready.join(reached, keys))
        left = cut(left.join(fresh.select(*keys), keys, "left_anti"))
        settled = cut(settled.unionByName(fresh))
    below = settled.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below"))
    chained = chain.join(below, ["conv_id", "to"], "left").select(*keys, (F.col("below") + F.col("way")).cast("int").alias("level"))
    return settled.select(*keys, F.col("level").cast("int").alias("level")).unionByName(chained).unionByName(left.select(*keys, F.lit(None).cast("int").alias("level")))


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``: the place in the conversation, from 0, by level and turn.

    Turns are numbered in pieces and the pieces' counts are added up, so that
    no task has a whole conversation.
    """
    piece = df.withColumn("p", F.floor(F.col("at") / PIECE))
    by = Window.partitionBy("conv_id", "level", "p")
    counts = piece.groupBy("conv_id", "level", "p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = piece.withColumn("r", F.row_number().over(by.orderBy("at", *order)))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv_id", "level", "p")]
    joined = ranked.alias("x").join(before.alias("y"), same[0] & same[1] & same[2])
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x.r") - 1 + F.col("y.before")).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Linked calls and results with their order, validity and canonical JSON.

    ``calls(conv_id, call_id, at, name, arguments, needs)``, ``at`` being the
    call's place in the conversation and ``needs`` an array of call ids;
    ``results(conv_id, call_id, content)``. One row for each different
    (conv_id, call_id) of either:

    - status ``linked``, ``no_result`` or ``no_call``;
    - position: the place in an order that puts each call after those it needs
      (by turn, where that does); null for results without a call;
    - circle: the call needs itself over others; it comes last, by turn;
    - problems: what the schema objects to, ids in ``needs`` that don't exist
      (``needs:ID``), or nothing; valid says that there are none;
    - json: canonical JSON of id, name, arguments, content.

    Of calls or results that repeat an id the first by place and text counts.
    Rows with a null conv_id or call_id link with nothing and are left out.
    Arguments that aren't JSON are kept as a string, very long ones whole.
    Other columns are ignored; empty tables give an empty result.
    """
    keys = ["conv_id", "call_id"]
    first = F.min(F.struct("at", "name", "arguments", "needs")).alias("c")
    calls = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*keys).agg(first).select(*keys, "c.*")
    results = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*keys).agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    needs = calls.select(*keys, F.explode("needs").alias("need")).where("need IS NOT NULL")
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    lost = needs.join(known, ["conv_id", "need"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat(F.lit("needs:"), F.col("need")))).alias("lost"))
    level = levels(calls, needs).withColumn("moved", F.lit(True))
    placed = calls.join(level, keys, "left").withColumn("circle", F.col("moved").isNotNull() & F.col("level").isNull())
    placed = placed.withColumn("level", F.when(F.col("moved").isNull(), 0).otherwise(F.col("level"))).drop("moved")
    placed = number(placed, ["call_id"])
    empty = F.array().cast("array<string>")
    full = placed.join(lost, keys, "left").withColumn("called", F.lit(True)).join(results, keys, "full")
    problems = F.when(F.col("called"), F.concat(errors(F.col("name"), F.col("arguments"), schemas), F.coalesce("lost", empty))).otherwise(empty)
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    bad = F.regexp_extract(F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    arguments = F.coalesce(canonical(F.col("arguments")), bad)
    json = F.concat(
        F.when(F.col("called"), F.concat(F.lit('{"arguments":'), arguments, F.lit(","))).otherwise(F.lit("{")),
        F.when(F.col("answered"), F.concat(F.lit('"content":'), text("content"), F.lit(","))).otherwise(F.lit("")),
        F.lit('"id":'), text("call_id"),
        F.when(F.col("called"), F.concat(F.lit(',"name":'), text("name"))).otherwise(F.lit("")), F.lit("}"),
    )
    return full.select(
        *keys,
        F.when(F.col("called") & F.col("answered"), "linked").when(F.col("called"), "no_result").otherwise("no_call").alias("status"),
        F.col("position").cast("long").alias("position"),
        F.coalesce("circle", F.lit(False)).alias("circle"),
        F.array_join(problems, ",").alias("problems"),
        (F.coalesce(F.col("called"), F.lit(False)) & (F.size(problems) == 0)).alias("valid"),
        json.alias("json"),
    )


#: The tool that the query reads into conversations: each user turn asks it.
REPLY: Schemas = {
    "reply": {
        "type": "object",
        "properties": {
            "after": {"type": "array", "items": {"type": "string"}},
            "options": {
                "type": "object",
                "properties": {"limit": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}, "tone": {"enum": ["formal", "plain"]}},
                "additionalProperties": False,
            },
            "question": {"type": "string"},
            "turn": {"type": "integer"},
        },
        "required": ["question", "turn"],
        "additionalProperties": False,
    }
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chats: a user turn calls ``reply``, the assistant turn after it is the result.

    A call's id is ``c`` and its turn; an assistant turn at t answers the call
    of turn t - 1. What a call needs and what is wrong with it follow from its
    text's length, so that all kinds occur. Needs: by the remainder of 4 the
    call two turns later (0; that one is out of place, and a circle if it
    needs this one), none (1), or the call two turns before (2 and 3), if it
    isn't among the first two turns; if 3 divides the length, also the call
    four turns before. Arguments: by the remainder of 7 with nested options
    (1), the turn as a string (3), without a question (4), with an unknown
    parameter and a limit below the least (5), with a tone that isn't allowed
    and tags of a wrong type (6), else plain ones.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.where("turn IS NOT NULL")
    id_of = lambda t: F.concat(F.lit("c"), t.cast("string"))
    t, n = F.col("turn"), F.char_length("text")
    other = F.when(n % 4 == 0, id_of(t + 2)).when((n % 4 > 1) & (t >= 2), id_of(t - 2))
    needs = F.array_compact(F.array(other, F.when((n % 3 == 0) & (t >= 4), id_of(t - 4))))
    after, question, turn = F.when(F.size(needs) > 0, needs).alias("after"), F.col("text").alias("question"), t.alias("turn")
    options = lambda *fields: F.struct(*fields).alias("options")
    fields = {
        1: (after, options(F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("plain").alias("tone")), question, turn),
        3: (after, question, t.cast("string").alias("turn")),
        4: (after, turn),
        5: (after, F.lit("x").alias("mood"), options(F.lit(-1).alias("limit")), question, turn),
        6: (after, options(F.array(F.lit(1)).alias("tags"), F.lit("loud").alias("tone")), question, turn),
    }
    arguments = F.to_json(F.struct(after, question, turn))
    for remainder, some in fields.items():
        arguments = F.when(n % 7 == remainder, F.to_json(F.struct(*some))).otherwise(arguments)
    calls = turns.where("role = 'user'").select("conv_id", id_of(t).alias("call_id"), t.alias("at"), F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", id_of(t - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3(spark, sf_dir: str) -> DataFrame:
    return link(*from_conversations(table(spark, sf_dir, "conversations")), REPLY)


OP3_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, 'c' || turn AS call_id, turn, text, length(text) % 7 AS kind,
    list_filter([CASE WHEN length(text) % 4 = 0 THEN 'c' || (turn + 2) WHEN length(text) % 4 > 1 AND turn >= 2 THEN 'c' || (turn - 2) END,
      CASE WHEN length(text) % 3 = 0 AND turn >= 4 THEN 'c' || (turn - 4) END], lambda x: x IS NOT NULL) AS needs
  FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) WHERE role = 'user'),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
wanted AS (SELECT conv_id, call_id, turn, unnest(needs) AS need FROM calls),
edges AS (SELECT w.conv_id, w.call_id, w.need, p.turn >= w.turn AS misplaced
  FROM wanted w JOIN calls p ON p.conv_id = w.conv_id AND p.call_id = w.need),
odd AS (SELECT conv_id FROM edges GROUP BY conv_id HAVING bool_or(misplaced)),
lost AS (SELECT w.conv_id, w.call_id, string_agg('needs:' || w.need, ',' ORDER BY w.need) AS lost
  FROM wanted w LEFT JOIN calls p ON p.conv_id = w.conv_id AND p.call_id = w.need WHERE p.call_id IS NULL GROUP BY ALL),
reach AS (
  SELECT conv_id, call_id, need FROM edges
  UNION
  SELECT r.conv_id, r.call_id, e.need FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.call_id = r.need),
circles AS (SELECT DISTINCT conv_id, call_id FROM reach WHERE call_id = need),
stuck AS (SELECT conv_id, call_id FROM circles
  UNION SELECT r.conv_id, r.call_id FROM reach r JOIN circles c ON c.conv_id = r.conv_id AND c.call_id = r.need),
depth AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = c.conv_id AND e.call_id = c.call_id)
  UNION
  SELECT e.conv_id, e.call_id, d.level + 1 FROM edges e JOIN depth d ON d.conv_id = e.conv_id AND d.call_id = e.need
  WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.conv_id = e.conv_id AND s.call_id = e.call_id)),
deepest AS (SELECT conv_id, call_id, max(level) AS level FROM depth GROUP BY ALL),
leveled AS (
  SELECT c.*, CASE WHEN o.conv_id IS NULL THEN 0 ELSE d.level END AS level,
    concat_ws(',', CASE kind WHEN 3 THEN 'type:turn' WHEN 4 THEN 'missing:question' WHEN 5 THEN 'minimum:options.limit,unknown:mood'
      WHEN 6 THEN 'enum:options.tone,type:options.tags[]' END, l.lost) AS problems
  FROM calls c LEFT JOIN odd o ON o.conv_id = c.conv_id
  LEFT JOIN deepest d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
  LEFT JOIN lost l ON l.conv_id = c.conv_id AND l.call_id = c.call_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn) - 1 AS position FROM leveled)
SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id,
  CASE WHEN p.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  CAST(p.position AS BIGINT) AS position, p.call_id IS NOT NULL AND p.level IS NULL AS circle, coalesce(p.problems, '') AS problems,
  coalesce(p.problems = '', FALSE) AS valid,
  '{' || CASE WHEN p.call_id IS NULL THEN '' ELSE '"arguments":{' || concat_ws(',',
      CASE WHEN len(p.needs) > 0 THEN '"after":' || CAST(to_json(p.needs) AS VARCHAR) END,
      CASE kind WHEN 5 THEN '"mood":"x","options":{"limit":-1}' WHEN 1 THEN '"options":{"tags":["a","b"],"tone":"plain"}'
        WHEN 6 THEN '"options":{"tags":[1],"tone":"loud"}' END,
      CASE WHEN kind <> 4 THEN '"question":' || CAST(to_json(p.text) AS VARCHAR) END,
      '"turn":' || CASE WHEN kind = 3 THEN '"' || p.turn || '"' ELSE CAST(p.turn AS VARCHAR) END) || '},' END ||
    CASE WHEN r.call_id IS NULL THEN '' ELSE '"content":' || CAST(to_json(r.content) AS VARCHAR) || ',' END ||
    '"id":' || CAST(to_json(coalesce(p.call_id, r.call_id)) AS VARCHAR) ||
    CASE WHEN p.call_id IS NULL THEN '' ELSE ',"name":"reply"' END || '}' AS json
FROM placed p FULL JOIN results r ON p.conv_id = r.conv_id AND p.call_id = r.call_id
"""
