"""Chat formatting: tool calls linked to their results.

Calls and results are rows. A call and its result are joined by hash on (conv_id, call_id); a call may name the calls whose
results its arguments use, and links of both kinds give each row a depth, the longest chain below it (Kahn's rounds over
calls and results, always run). Ordered by (depth, turn), as op1 gives them, a result stands after its call and a call after what it
uses; plain conversations, as op1 reads them, name no uses, so there the rounds end after the results. Arguments are validated against the tool's JSON schema by column expressions; a schema with a keyword that these don't check (nested ones, say) raises. Each message is serialised as
canonical JSON: keys in code-point order, no white space, null fields left out. No step gathers a conversation, so one
that holds a third of all rows is no harder than many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash, write_table

#: Types of JSON schemas, as schema_of_variant names them.
TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY.*", "object": r"^OBJECT.*", "null": r"^VOID$"}

#: Keywords of a schema, and of a property's, that are checked or say nothing of validity; any other is an error, not passed over.
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
TOP = {"type", "required", "properties", "additionalProperties"} | NOTES
CHECKED = {"type", "minLength", "maxLength", "pattern", "minimum", "maximum", "enum"} | NOTES

#: Schemas by tool. A user turn is a call of `reply`; its answer is the result.
SCHEMAS = {"reply": {"required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def supported(tool: str, schema: dict) -> None:
    """Raises where a schema asks for what problems() doesn't check."""
    odd = sorted(set(schema) - TOP)
    if schema.get("type", "object") != "object" or not isinstance(schema.get("additionalProperties", True), bool):
        odd.append("type or additionalProperties")
    for key, rule in schema.get("properties", {}).items():
        odd += [f"{key}.{k}" for k in sorted(set(rule) - CHECKED)]
        if "type" in rule and (not isinstance(rule["type"], str) or rule["type"] not in TYPES):
            odd.append(f"{key}.type")
    if odd:
        raise ValueError(f"schema of {tool}: unsupported {', '.join(odd)}")


def problems(name: Column, arguments: Column, schemas: dict) -> Column:
    """The violations of a call's arguments, in a fixed order; an empty array if there are none."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    out = F.when(value.isNull(), F.array(F.lit("not JSON"))).when(~kind.rlike(TYPES["object"]), F.array(F.lit("not an object")))
    known = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, schema in schemas.items():
        supported(tool, schema)
        checks = []
        for key, rule in sorted((dict.fromkeys(schema.get("required", ()), {}) | schema.get("properties", {})).items()):
            part = F.try_variant_get(value, f"$.{key}", "variant")
            here = F.coalesce(F.schema_of_variant(part), F.lit(""))
            missing = part.isNull()
            if key in schema.get("required", ()):
                checks.append(F.when(missing, F.lit(f"{key}: missing")))
            if "type" in rule:
                checks.append(F.when(~missing & ~here.rlike(TYPES[rule["type"]]), F.lit(f"{key}: not {rule['type']}")))
            if "minLength" in rule:
                checks.append(F.when(here.rlike(TYPES["string"]) & (F.char_length(F.try_variant_get(value, f"$.{key}", "string")) < rule["minLength"]), F.lit(f"{key}: too short")))
            if "maxLength" in rule:
                checks.append(F.when(here.rlike(TYPES["string"]) & (F.char_length(F.try_variant_get(value, f"$.{key}", "string")) > rule["maxLength"]), F.lit(f"{key}: too long")))
            if "pattern" in rule:
                checks.append(F.when(here.rlike(TYPES["string"]) & ~F.try_variant_get(value, f"$.{key}", "string").rlike(rule["pattern"]), F.lit(f"{key}: no match")))
            if "minimum" in rule:
                checks.append(F.when(here.rlike(TYPES["number"]) & (F.try_variant_get(value, f"$.{key}", "double") < rule["minimum"]), F.lit(f"{key}: too small")))
            if "maximum" in rule:
                checks.append(F.when(here.rlike(TYPES["number"]) & (F.try_variant_get(value, f"$.{key}", "double") > rule["maximum"]), F.lit(f"{key}: too large")))
            if "enum" in rule:
                checks.append(F.when(~missing & ~F.coalesce(F.try_variant_get(value, f"$.{key}", "string"), F.lit("")).isin(*rule["enum"]), F.lit(f"{key}: not allowed")))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(k) for k in schema.get("properties", {})] or [F.lit("")]))
            checks.append(F.when(F.size(extra) > 0, F.lit("unknown keys")))
        known = known.when(name == tool, F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>"))
    return F.when(F.coalesce(name, F.lit("")).isin(*schemas), F.coalesce(out, known)).otherwise(F.array(F.lit("unknown tool")))


def link_calls(messages: DataFrame, schemas: dict, uses: DataFrame | None = None) -> DataFrame:
    """messages with linked, depth, errors and valid.

    messages: conv_id, turn, role, kind ('call', 'result' or 'message'), call_id, name, arguments (JSON text), text; uses:
    (conv_id, call_id, needs) where a call's arguments use the result of the call `needs`. Calls and results without
    partner have linked false; a call_id that several calls of a conversation have is an error of each; rows on a
    cycle, or above one, have depth null and an error. Null conv_id or call_id never link. Rows may repeat; extra
    columns of any name stay, but those named linked, depth, errors or valid are replaced.
    """
    key, own, new = ["conv_id", "call_id"], ["conv_id", "call_id", "kind", "name", "arguments"], ("linked", "depth", "errors", "valid")
    side = lambda kind: messages.filter((F.col("kind") == kind) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    calls, results = side("call").withColumnRenamed("n", "_calls"), side("result").withColumnRenamed("n", "_results")
    known = calls.join(results, key, "full_outer")
    packed, others = stash(messages, own, new)
    rows = packed.join(known, key, "left").join(message_depths(known, uses), [*key, "kind"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    linked = F.when(call, F.coalesce(F.col("_results"), F.lit(0)) > 0).when(result, F.coalesce(F.col("_calls"), F.lit(0)) > 0)
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    level = F.when((call | result) & keyed, F.col("_depth")).when(result, F.lit(1)).otherwise(F.lit(0))
    cyclic = (call | result) & F.col("_calls").isNotNull() & F.col("_depth").isNull()
    more = F.filter(F.array(F.when(F.coalesce(F.col("_calls"), F.lit(0)) > 1, F.lit("repeated call_id")), F.when(cyclic, F.lit("cycle")), F.when(result & ~linked, F.lit("no call"))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    errors = F.concat(F.when(call, problems(F.col("name"), F.col("arguments"), schemas)).otherwise(none), F.when(call | result, more).otherwise(none))
    rows = rows.withColumns({"linked": linked, "depth": level.cast("int"), "errors": errors}).withColumn("valid", F.size("errors") == 0)
    return rows.select(*own, *others, *new).select(*[F.col(f"`{c}`") for c in messages.columns if c not in new], *new)


def message_depths(known: DataFrame, uses: DataFrame | None) -> DataFrame:
    """(conv_id, call_id, kind, _depth) of the call and the result of each known (conv_id, call_id, _calls), by Kahn's rounds.

    A result needs its call, a call the results that it uses; a node without needs has depth 0, any other one more than the
    deepest node it needs. Each round takes out the needs that the round before has met; what is on or above a cycle is never free and is left out.
    """
    key, node, need = ["conv_id", "call_id"], ["conv_id", "call_id", "kind"], ["conv_id", "needs", "needs_kind"]
    waiting = known.select(*key, F.lit("result").alias("kind"), F.col("call_id").alias("needs"), F.lit("call").alias("needs_kind"))
    if uses is not None:
        calls = known.filter("_calls is not null").select(key)
        used = uses.filter("needs is not null").select(*key, "needs").distinct().join(calls, key, "left_semi").join(calls.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
        waiting = waiting.unionByName(used.select(*key, F.lit("call").alias("kind"), "needs", F.lit("result").alias("needs_kind")))
    waiting = write_table(waiting, "calls-needs")
    nodes = known.select(*key, F.explode(F.array(F.lit("call"), F.lit("result"))).alias("kind"))
    free, level = write_table(nodes.join(waiting.select(node).distinct(), node, "left_anti"), "calls-free"), 0
    done = free.withColumn("_depth", F.lit(level))
    while not free.isEmpty():
        left = write_table(waiting.join(free.toDF(*need), need, "left_anti"), "calls-needs")
        free, level = write_table(waiting.select(node).distinct().join(left.select(node).distinct(), node, "left_anti"), "calls-free"), level + 1
        done, waiting = done.unionByName(free.withColumn("_depth", F.lit(level))), left
    return done


def canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object: keys in code-point order, no white space, null fields left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def chat_messages(conversations: DataFrame) -> DataFrame:
    """The messages of a plain conversation: a user turn calls `reply`, the assistant's next turn is its result."""
    role, turn = F.lower(F.coalesce(F.col("role"), F.lit(""))), F.col("turn").cast("long")
    kind = F.when(role == "user", "call").when(role == "assistant", "result").otherwise("message")
    at = F.when(role == "user", turn).when(role == "assistant", turn - 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    arguments = F.when(role == "user", canonical({"text": text, "turn": turn}))
    return conversations.withColumns({"kind": kind, "call_id": at.cast("string"), "name": F.when(role == "user", "reply"), "arguments": arguments})


def op1(conversations: DataFrame) -> DataFrame:
    """A row a message: its link, depth, validity and canonical JSON, in which arguments and contents are objects and texts."""
    rows = link_calls(chat_messages(conversations.select("conv_id", "turn", "role", "text")), SCHEMAS)
    message = canonical({"arguments": F.when(F.col("kind") == "call", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))), "call_id": F.col("call_id"), "content": F.when(F.col("kind") != "call", F.coalesce("text", F.lit(""))), "name": F.col("name"), "role": F.col("role")})
    return rows.select("conv_id", "turn", "role", "kind", "call_id", F.coalesce("linked", F.lit(False)).alias("linked"), "depth", F.array_join("errors", "; ").alias("errors"), "valid", message.alias("json")).orderBy("conv_id", "depth", "turn")


SQL = """
WITH m AS (SELECT *, coalesce(text, '') AS body, CASE lower(coalesce(role, '')) WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE lower(coalesce(role, '')) WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END::VARCHAR AS call_id FROM conversations),
n AS (SELECT m.*,
    count(*) FILTER (kind = 'call') OVER (PARTITION BY conv_id, call_id) AS calls, count(*) FILTER (kind = 'result') OVER (PARTITION BY conv_id, call_id) AS results FROM m),
e AS (SELECT *, CASE WHEN kind = 'message' THEN '' ELSE concat_ws('; ', CASE WHEN kind = 'call' AND body = '' THEN 'text: too short' END,
    CASE WHEN kind = 'call' AND turn < 0 THEN 'turn: too small' END, CASE WHEN calls > 1 THEN 'repeated call_id' END, CASE WHEN kind = 'result' AND calls = 0 THEN 'no call' END) END AS errors FROM n)
SELECT conv_id, turn, role, kind, call_id, CASE kind WHEN 'call' THEN results > 0 WHEN 'result' THEN calls > 0 ELSE false END AS linked,
  CASE kind WHEN 'result' THEN 1 ELSE 0 END::INTEGER AS depth, errors, errors = '' AS valid,
  '{' || CASE WHEN kind = 'call' THEN '"arguments":{"text":' || to_json(body) || ',"turn":' || turn || '},' ELSE '' END || CASE WHEN call_id IS NOT NULL THEN '"call_id":' || to_json(call_id) || ',' ELSE '' END
    || CASE WHEN kind <> 'call' THEN '"content":' || to_json(body) || ',' ELSE '' END || CASE WHEN kind = 'call' THEN '"name":"reply",' ELSE '' END || '"role":' || to_json(role) || '}' AS json
FROM e
"""
