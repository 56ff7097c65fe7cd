"""Linking tool calls with their results for chat training data; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, staged

#: name of a tool: {argument: (type, required)}; types as JSON names them.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

#: How the types of parsed JSON are called: fixed names of the engine's own types, by JSON type.
TYPES = {"string": ["STRING"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}

#: Tokens of JSON: a string and a number. The possessive repeat takes strings of any length and of any number of escapes.
STRING, NUMBER = r'"(?:[^"\\]|\\.)*+"', r"-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"


def plain_number(token: Column) -> Column:
    """A JSON number in decimal digits: no exponent, no zeros that change nothing, no sign of zero. Equal values have equal texts."""
    whole, fraction = (F.regexp_extract(token, r"^-?([0-9]+)(?:\.([0-9]+))?", i) for i in (1, 2))
    exponent = F.coalesce(F.regexp_extract(token, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))

    def placed(x: Column) -> Column:
        """The digits x.d with the point behind the first x.p of them."""
        d, p = x["d"], x["p"]
        whole = F.when(p <= 0, "0").when(p >= F.length(d), F.rpad(d, F.greatest(p, F.lit(0)), "0")).otherwise(F.left(d, p))
        fraction = F.when(p <= 0, F.concat(F.repeat(F.lit("0"), -p), d)).when(p >= F.length(d), "").otherwise(F.substr(d, p + 1))
        fraction = F.regexp_replace(fraction, "0++$", "")
        return F.concat(F.regexp_replace(whole, "^0+(?=[0-9])", ""), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))

    digits = F.struct(F.concat(whole, fraction).alias("d"), (F.length(whole) + exponent).alias("p"))
    unsigned = F.get(F.transform(F.array(digits), placed), F.lit(0))
    return F.concat(F.when(token.startswith("-") & (unsigned != "0"), "-").otherwise(""), unsigned)


def plain_numbers(json: Column) -> Column:
    """JSON as Spark writes it, with each number as plain_number() writes it; strings stay."""
    tokens = F.regexp_extract_all(json, F.lit(f'(?s){STRING}|{NUMBER}|[^"0-9-]++'), F.lit(0))
    written = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), plain_number(t)).otherwise(t)), "")
    return F.when(json.rlike(r"[0-9][.E]"), written).otherwise(json)  # whole numbers are plain already


def beyond_double(json: Column) -> Column:
    """Whether a number of a JSON text is too large for a double, or not zero and too small for one."""
    numbers = F.regexp_extract_all(F.regexp_replace(json, f"(?s){STRING}", '""'), F.lit(NUMBER), F.lit(0))

    def lost(n: Column) -> Column:
        value = n.try_cast("double")
        return (F.abs(value) == float("inf")) | ((value == 0) & n.rlike("^-?[0.]*[1-9]"))

    return F.coalesce(F.exists(numbers, lost), F.lit(False))


def of_type(value: Column, wanted: str) -> Column:
    """Whether a variant has a type as JSON names it. A whole number is an integer however it is written: 100, 100.0 and 1e2 are one value."""
    kind = F.schema_of_variant(value)
    if wanted == "integer":
        return of_type(value, "number") & ~plain_number(F.to_json(value)).contains(".")
    return reduce(lambda a, b: a | b, [kind.startswith(t) for t in TYPES[wanted]])


def first_of(rows: DataFrame, order: list[str], flag: str) -> DataFrame:
    """rows with a boolean: whether it is the first of its conversation and identifier. Rows without an identifier, which may be a large
    part of a conversation, are first of nothing and dealt by their content, so that they are not gathered."""
    apart = F.when(F.col("call_id").isNull(), F.xxhash64(*order))
    place = F.row_number().over(Window.partitionBy("conv_id", "call_id", apart).orderBy(F.col(order[0]).asc_nulls_last(), *order[1:]))
    return rows.withColumn(flag, F.col("call_id").isNotNull() & (place == 1))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): calls between a call and the one it goes back to; null on a circle or behind one.

    A call has one parent at most, so calls form trees. Each round replaces a call's pointer by its target's and adds the
    distances: after r rounds all calls of a depth under 2^r are done. What a round does not lessen goes in circles.
    """
    known = calls.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"))
    same = F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("parent_id") == F.col("pi"))
    linked = calls.join(known, same, "left").select("conv_id", "call_id", F.col("pi").alias("up"), F.when(F.col("pi").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    linked, left = staged(linked), None
    while True:
        now = linked.where("up is not null").count()
        if now == 0 or now == left:
            break
        left = now
        target = linked.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), F.col("up").alias("next"), F.col("depth").alias("more"))
        on = F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("up") == F.col("pi"))
        linked = staged(linked.join(target, on, "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return linked.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def path_of(argument: str) -> str:
    """The path of a member of any name, dots and brackets included; a name with both kinds of quotes has none."""
    quote = "'" if "'" not in argument else '"'
    if quote in argument:
        raise ValueError(f"an argument's name may not hold both kinds of quotes: {argument}")
    return f"$[{quote}{argument}{quote}]"


def argument_errors(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """array<string>, in order: not_json, unknown_tool, then per argument by name missing:x, type:x, extra:x."""
    kind = F.schema_of_variant(parsed)
    errors = [F.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.lit("not_json"))]
    tool = F.lit("unknown_tool")
    for n in schemas:
        tool = F.when(name == n, F.lit(None).cast("string")).otherwise(tool)
    errors.append(tool)
    given = F.array_sort(F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>")))
    for n, arguments in schemas.items():
        for a, (wanted, required) in sorted(arguments.items()):
            value = F.try_variant_get(parsed, path_of(a), "variant")
            there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
            wrong = F.when(there & ~of_type(value, wanted), F.lit(f"type:{a}"))
            if required:
                wrong = F.when(~there, F.lit(f"missing:{a}")).otherwise(wrong)
            errors.append(F.when((name == n) & parsed.isNotNull() & kind.startswith("OBJECT"), wrong))
        extra = F.transform(F.array_except(given, F.array(*[F.lit(a) for a in arguments])), lambda k: F.concat(F.lit("extra:"), k))
        errors.append(F.when((name == n) & (F.size(extra) > 0), F.array_join(extra, ",")))
    return F.array_compact(F.array(*errors))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per result that no call takes.

    calls: conv_id, call_id, turn, name, arguments (JSON text), parent_id (the call whose result it builds on, or null).
    results: conv_id, call_id, turn, content. They are hash-joined by conversation and identifier. Returns conv_id, call_id,
    turn, name, depth (in the tree of parents), seq (place in the conversation, from 0, parents before children: by depth, turn and
    identifier; circles and orphans last), status, errors (array<string>) and message: JSON with sorted keys, no spaces.

    status: ok; no_result; early_result (its turn is not after the call's); duplicate_call (not the first of its identifier by
    turn, arguments and name; takes no result); orphan_result (no such call, or not the first result of its call). Errors are those
    of argument_errors, and unknown_parent and circle; number_range in place of not_json where a number is beyond a double. Arguments with such
    a number or that are not JSON stand in the message as they are, under raw_arguments. Numbers are written in decimal digits, equal ones alike: those of
    up to 38 digits without an exponent as they are, others as the nearest double. A null identifier links with nothing: its call has no result, its
    result is an orphan. A null conversation is one like others; null arguments, names or contents are checked or kept as
    such. Equal rows are duplicates of each other. Empty tables give an empty result; other columns are left out. No
    conversation is gathered in a task: ranks come from a range partitioning of all rows.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "parent_id")
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    calls = staged(first_of(calls, ["turn", "arguments", "name", "parent_id"], "is_call"))
    results = staged(first_of(results, ["result_turn", "content"], "is_result"))
    real, named = calls.where("is_call"), results.where("is_result")
    deep = depths(real).select(F.col("conv_id").alias("dc"), F.col("call_id").alias("di"), "depth")
    parents = real.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"))
    taken = named.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), "result_turn", "content")

    def pair(c: str, i: str, other: str = "call_id") -> Column:
        return F.col("conv_id").eqNullSafe(F.col(c)) & (F.col(other) == F.col(i))

    linked = calls.join(deep, pair("dc", "di") & F.col("is_call"), "left").join(parents, pair("pc", "pi", "parent_id"), "left").join(taken, pair("rc", "ri") & F.col("is_call"), "left")
    beyond = beyond_double(F.col("arguments"))
    parsed = F.when(~F.col("beyond"), F.try_parse_json("arguments"))
    status = F.when(~F.col("is_call"), F.when(F.col("call_id").isNull(), "no_result").otherwise("duplicate_call")).when(F.col("ri").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("ok")
    more = F.array_compact(F.array(F.when(F.col("parent_id").isNotNull() & F.col("pi").isNull(), F.lit("unknown_parent")), F.when(F.col("is_call") & F.col("depth").isNull(), F.lit("circle"))))
    errors = F.transform(argument_errors(F.col("name"), F.col("parsed"), schemas), lambda e: F.when(F.col("beyond") & (e == "not_json"), "number_range").otherwise(e))
    linked = linked.withColumn("beyond", beyond).withColumn("parsed", parsed).select(
        "conv_id", "call_id", "turn", "name", "depth", status.alias("status"), F.concat(errors, more).alias("errors"),
        plain_numbers(F.to_json("parsed")).alias("arguments"), F.when(F.col("parsed").isNull(), F.col("arguments")).alias("raw"), "content", F.lit(0).alias("kind"),
    )
    known = real.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"))
    orphans = results.join(known, pair("rc", "ri") & F.col("is_result"), "left").where("ri is null")
    none = F.lit(None)
    orphans = orphans.select("conv_id", "call_id", F.col("result_turn").alias("turn"), none.cast("string").alias("name"), none.cast("long").alias("depth"), F.lit("orphan_result").alias("status"), F.array().cast("array<string>").alias("errors"), none.cast("string").alias("arguments"), none.cast("string").alias("raw"), "content", F.lit(1).alias("kind"))
    order = [F.col("conv_id"), F.col("kind"), F.col("depth").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("call_id"), F.col("arguments"), F.col("raw"), F.col("content")]
    ranked = global_rank(linked.unionByName(orphans), order)
    starts = ranked.groupBy("conv_id").agg(F.min("rank").alias("start")).select(F.col("conv_id").alias("sc"), "start")
    placed = ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("sc"))).withColumn("seq", F.col("rank") - F.col("start"))
    return placed.select("conv_id", "call_id", "turn", "name", "depth", "seq", "status", "errors", canonical().alias("message"))


def canonical() -> Column:
    """Keys sorted, nothing between tokens, absent values left out; arguments are canonical already (parsed JSON sorts its keys)."""

    def quoted(column: str) -> Column:
        shell = F.to_json(F.struct(F.col(column).alias("v")))  # {"v":"..."}, or {} of a null
        return F.when(shell != "{}", shell.substr(F.lit(6), F.length(shell) - 6))

    fields = {
        "arguments": F.col("arguments"),
        "call_id": quoted("call_id"),
        "errors": F.when(F.size("errors") > 0, F.to_json("errors")),
        "name": quoted("name"),
        "raw_arguments": quoted("raw"),
        "result": quoted("content"),
        "seq": F.col("seq").cast("string"),
        "status": quoted("status"),
    }
    parts = [F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value)) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


#: The tools that the query takes chat turns for.
CHAT_TOOLS: Schemas = {"ask": {"text": ("string", True), "words": ("integer", True), "topic": ("string", False)}, "configure": {"text": ("string", True)}}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chat turns as calls and results: the chat tables hold no tool calls, so turns stand for them.

    A user turn is a call of `ask` and a system turn one of `configure`, named conversation-turn; an ask builds on the call two
    turns before. An assistant turn is the result of the turn before it. Some asks are made faulty: each seventh turn
    has its word count as text, texts of a length divisible by 11 lack it, and each fifth turn has an argument too many.
    """
    name = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure")
    words = F.size(F.split("text", " ")).cast("long")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    words_json = F.when(F.length("text") % 11 == 0, "").when(F.col("turn") % 7 == 3, F.concat(F.lit('"words":"'), words, F.lit('",'))).otherwise(F.concat(F.lit('"words":'), words, F.lit(",")))
    extra = F.when(F.col("turn") % 5 == 4, '"zeal":1,').otherwise("")
    arguments = F.when(F.col("role") == "user", F.concat(F.lit("{"), F.coalesce(words_json, F.lit("")), extra, F.substring(text, 2, 1 << 30))).otherwise(text)
    ident = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    calls = turns.where("role in ('user', 'system')").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when((F.col("role") == "user") & (F.col("turn") >= 2), ident(F.col("turn") - 2)).alias("parent_id"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op1_tool_call_links(spark, sf_dir):
    calls, results = calls_of_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_tool_calls(calls, results, CHAT_TOOLS).withColumn("errors", F.array_join("errors", ","))
