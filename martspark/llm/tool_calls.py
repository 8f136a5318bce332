"""Tool calls: linked to their results, put in an order that their dependencies allow, checked, serialised."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import ship
from martspark.session import stage

# Of a checked value; bool is not a number here.
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and letters as they are; half of a surrogate pair, which is no letter, is escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _escaped(text)


def _escaped(text: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


class _OutOfRange(ValueError):
    pass


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise _OutOfRange(text)
    return value


def _no_number(text: str) -> None:
    raise ValueError(text)


def parsed(arguments: str) -> tuple[object, str | None]:
    """The value of a JSON text, or the text itself and what is wrong with it.

    NaN and Infinity are not JSON; a number beyond the range of doubles and a value nested deeper than Python follows
    are refused too.
    """
    try:
        value = json.loads(arguments, parse_float=_number, parse_constant=_no_number)
        # A value that is read may still be too deep to be written.
        canonical(value)
        return value, None
    except _OutOfRange:
        return arguments, "arguments: number out of range"
    except ValueError:
        return arguments, "arguments: not JSON"
    except RecursionError:
        return arguments, "arguments: too deep"


def fault(value: object, schema: dict, at: str = "arguments") -> str | None:
    """The first way in which a value breaks a schema, in the order of the schema; None if it does not."""
    kind = schema.get("type")
    if kind and not _TYPES[kind](value):
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        return f"{at}: too long"
    if _TYPES["number"](value) and value < schema.get("minimum", value):
        return f"{at}: too small"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                found = fault(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True):
                found = None
            else:
                found = f"{at}.{name}: unknown"
            if found:
                return found
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := fault(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _checked(frames: Iterator[pd.DataFrame], schemas: dict) -> Iterator[pd.DataFrame]:
    for frame in frames:
        status, message = [], []
        for row in frame.itertuples(index=False):
            arguments, found = parsed(row.arguments) if isinstance(row.arguments, str) else (None, None)
            if found is None:
                try:
                    found = fault(arguments, schemas[row.name]) if row.name in schemas else "unknown tool"
                except RecursionError:
                    arguments, found = row.arguments, "arguments: too deep"
            answered = isinstance(row.content, str)
            if found is None and pd.isna(row.level):
                found = "circular dependency"
            status.append(_escaped(found) if found else "linked" if answered else "no result")
            message.append(canonical({
                "arguments": arguments, "id": row.call_id, "name": row.name,
                "result": row.content if answered else None, "type": "tool_call",
            }))
        yield frame.assign(status=status, message=message)[
            ["conv_id", "call_id", "turn", "name", "level", "status", "message"]
        ]


def _chains(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, n, end, steps, done): where a call's chain of single dependencies ends, that many steps on.

    A call with n = 0 or several dependencies is an end itself. In each round every call jumps to where its
    target points, so the rounds grow with the logarithm of the longest chain. Each round settles some call
    until only circular chains are left; those stay not `done`.
    """
    counted = calls.join(
        needs.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("only")), "call_id", "left"
    )
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    chains = stage(
        counted.select(
            "call_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(single, F.col("only")).otherwise(F.col("call_id")).alias("end"),
            single.cast("bigint").alias("steps"), (~single).alias("done"),
        ), "call-chains",
    )
    before = None
    while (left := chains.where("not done").count()) not in (0, before):
        before = left
        ahead = chains.select(
            F.col("call_id").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"), F.col("done").alias("stop")
        )
        jumped = chains.where("not done").join(ahead, "end").select(
            "call_id", "n", F.col("far").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("stop").alias("done")
        )
        chains = stage(chains.where("done").unionByName(jumped), "call-chains")
    return chains


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls without known dependencies, else one more than the highest of them.

    Calls that depend on themselves, also by way of others, and calls behind them are left out. Chains of
    calls with one dependency each are followed by doubling (`_chains`). Calls with several dependencies are
    then settled in rounds, all at once whose dependencies' chains end in settled calls; these rounds are as
    many as such calls stand behind each other. Each round is written to the shared folder.
    """
    known = calls.select("call_id")
    needs = stage(
        calls.select("call_id", F.explode("depends_on").alias("needs")).distinct()
        .join(known.withColumnRenamed("call_id", "needs"), "needs", "left_semi"), "call-needs",
    )
    chains = _chains(known, needs)
    done = fresh = chains.where("n = 0").select("call_id", F.lit(0).cast("bigint").alias("level"))
    way = chains.select(F.col("call_id").alias("needs"), F.when(F.col("done"), F.col("end")).alias("end"), "steps")
    waiting = stage(
        needs.join(chains.where("n > 1").select("call_id"), "call_id", "left_semi").join(way, "needs").select(
            "call_id", "end", (F.col("steps") + 1).alias("steps"), F.lit(None).cast("bigint").alias("base")
        ), "call-waiting",
    )
    while not waiting.isEmpty() and not fresh.isEmpty():
        found = fresh.select(F.col("call_id").alias("end"), F.col("level").alias("new"))
        waiting = stage(
            waiting.join(found, "end", "left").select("call_id", "end", "steps", F.coalesce("base", "new").alias("base")),
            "call-waiting",
        )
        settled = waiting.groupBy("call_id").agg(
            F.max(F.col("base") + F.col("steps")).alias("level"), F.count_if(F.col("base").isNull()).alias("open")
        )
        fresh = stage(settled.where("open = 0").select("call_id", "level"), "call-levels")
        done = done.unionByName(fresh)
        waiting = waiting.join(fresh.select("call_id"), "call_id", "left_anti")
    base = done.select(F.col("call_id").alias("end"), F.col("level").alias("base"))
    return chains.where("done").join(base, "end").select("call_id", (F.col("base") + F.col("steps")).cast("int").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call: its level, its status and its canonical JSON with the result.

    `calls` has conv_id, call_id, turn, name, arguments (JSON text) and depends_on (call_ids); `results` has
    call_id, turn and content. The order of a conversation is (level, turn): no call stands before one that
    it depends on. Dependencies on unknown calls are ignored. Of several calls or results with one
    identifier the one with the least turn counts, on ties the least text; calls without identifier are left
    out, and so are results that no call has. Status: the first fault of the arguments, "unknown tool",
    "circular dependency" (level NULL), "no result" or "linked". NULL arguments are JSON null. Arguments that are
    not JSON (NaN and Infinity are not), hold a number beyond the range of doubles or are nested too deep to be followed
    stand in the message as text; half of a surrogate pair stays an escape. Empty tables give no rows; other columns are
    not read.
    """
    ship(calls.sparkSession)
    chosen = calls.where("call_id is not null").groupBy("call_id").agg(
        F.min(F.struct("turn", "conv_id", "name", "arguments", "depends_on")).alias("c")
    ).select("call_id", "c.*")
    chosen = stage(chosen, "calls")
    answers = results.where("call_id is not null").groupBy("call_id").agg(
        F.min(F.struct("turn", "content")).alias("r")
    ).select("call_id", "r.content")
    linked = chosen.join(answers, "call_id", "left").join(levels(chosen), "call_id", "left")
    kinds = dict(linked.dtypes)
    schema = (
        f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, name string, level int, "
        "status string, message string"
    )
    return linked.select("conv_id", "call_id", "turn", "name", "level", "arguments", "content").mapInPandas(
        lambda frames: _checked(frames, schemas), schema
    )


# What the query on conversations takes for tools.
SCHEMAS = {
    "ask": {
        "type": "object",
        "required": ["text"],
        "properties": {"text": {"type": "string", "maxLength": 400}, "chars": {"type": "integer", "minimum": 1}},
        "additionalProperties": False,
    },
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}},
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from turns: each turn of a user or system is a call, the assistant's turn after
    it is its result, and a call depends on the one two turns before it. A turn with a NULL role is neither.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def name(turn: Column) -> Column:
        return F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    turn = F.col("turn")
    calls = turns.where("role != 'assistant'").select(
        "conv_id",
        name(turn).alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure")
        .otherwise(F.col("role")).alias("name"),
        F.to_json(F.struct("text", F.length("text").alias("chars"))).alias("arguments"),
        F.array(name(turn - 2)).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results
