"""Tool-call linking: join calls and results by identifier, order them, validate arguments, serialise.

Calls and results meet in hash joins on the call's identifier; the side with one row an identifier is the one that is
hashed.  A result follows its call, and a call follows the calls it names in ``depends_on``; a call's level is the
longest way to a call without dependencies.  Calls with one dependency form chains, which pointer doubling jumps in a
number of rounds that grows with the logarithm of their length; then calls with several dependencies are
peeled, a round settling every one whose dependencies are settled.  Calls on a cycle or behind one keep a null level.
``position`` numbers a conversation's rows from 0 in the order ``(level, turn, kind, call_id, message)``, null levels last, which is
topological; rows are sorted by range, so no task gathers a conversation.  Arguments are parsed into variants, whose fields are sorted by name, so
writing them gives canonical JSON: sorted keys, no white space, numbers without trailing zeros.

Defined cases: malformed or null arguments, arguments that are no object, unknown tools, missing, unknown or
wrongly typed parameters, and values outside a parameter's bounds make a call invalid, never an error; a result without a call is an ``orphan``, a call without a
result ``unanswered``; several results of one call are all linked; calls that repeat an identifier are
``repeated``, the first (least turn, then arguments) takes the results; a null identifier links with
nothing; dependencies on unknown calls are ignored; rows of null conversations are numbered together; rows equal in all columns share positions in any
order; extra columns of the inputs are not read.
"""
from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Types a parameter may be declared with, and the variant types that fit.
FITS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


class Param(NamedTuple):
    """A parameter's type, whether a call must have it, and bounds: of a string's length or of a number."""

    kind: str
    required: bool = False
    least: float | None = None
    most: float | None = None


Schemas = dict[str, dict[str, Param | tuple]]


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is malformed."""
    return F.to_json(F.try_parse_json(json))


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments are an object that fits the schema of the named tool."""
    parsed = F.try_parse_json(arguments)
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    ok = F.lit(False)
    for tool, params in schemas.items():
        fits = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(p) for p in params]))) == 0 if params else F.size(keys) == 0)
        for p, given in params.items():
            param = Param(*given)
            of = F.schema_of_variant(F.try_variant_get(parsed, f"$['{p}']", "variant"))
            typed = F.lit(False)
            for t in FITS[param.kind]:
                typed = typed | of.startswith(t)
            if param.least is not None or param.most is not None:
                value = F.length(F.try_variant_get(parsed, f"$['{p}']", "string")) if param.kind == "string" else F.try_variant_get(parsed, f"$['{p}']", "double")
                typed = typed & (F.lit(True) if param.least is None else value >= param.least) & (F.lit(True) if param.most is None else value <= param.most)
            fits = fits & F.coalesce(typed, F.lit(not param.required) & ~F.array_contains(keys, p), F.lit(False))
        ok = F.when(name == tool, F.coalesce(fits, F.lit(False))).otherwise(ok)
    return ok


def _hashed(one: DataFrame) -> DataFrame:
    """The side of a join that has one row a key: hashed in memory, partition by partition."""
    return one.hint("shuffle_hash")


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """``call_id, level`` of every call that lies on no cycle and behind none; ``calls``: ``call_id, depends_on``."""
    scratch: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = common.write_shared(spark, df, "levels")
        scratch.append(path)
        return out

    nodes = keep(calls.select("call_id").where("call_id is not null").distinct())
    edges = calls.select("call_id", F.explode("depends_on").alias("dep")).where("call_id is not null and dep is not null").distinct()
    edges = keep(edges.join(_hashed(nodes.withColumnRenamed("call_id", "dep")), "dep", "left_semi"))
    deps = keep(edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep")))
    # Chains: each call with one dependency points at it; pointers double until they reach a call with none or several.
    chain = keep(deps.where("n = 1").select("call_id", F.col("dep").alias("to"), F.lit(1).alias("d")))
    ends = lambda rows: _hashed(rows.select(F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("d").alias("more")))
    for _ in range(math.ceil(math.log2(chain.count() + 1)) + 1):
        step = chain.join(ends(chain), "to", "left")
        if not step.where("further is not null").take(1):
            break
        chain = keep(step.select("call_id", F.coalesce("further", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
    # Pointers that still lead to a chain's call go round a cycle.
    inner = _hashed(chain.select(F.col("call_id").alias("to")))
    chain = keep(chain.join(inner, "to", "left_anti"))
    settled = nodes.join(_hashed(deps.select("call_id")), "call_id", "left_anti").select("call_id", F.lit(0).alias("level"))
    settled, found = common.write_shared(spark, settled, "settled")
    several = deps.where("n > 1").select("call_id")
    # Calls with several dependencies, by the chains' ends; a dependency on a cycle leads nowhere and never settles.
    left = edges.join(_hashed(several), "call_id", "left_semi").join(_hashed(chain.select(F.col("call_id").alias("dep"), "to", "d")), "dep", "left")
    ended = _hashed(nodes.join(_hashed(deps.where("n = 1").select("call_id")), "call_id", "left_anti").select(F.col("call_id").alias("dep"), F.lit(True).alias("end")))
    left = keep(left.join(ended, "dep", "left").select("call_id", F.coalesce("to", F.when(F.col("end"), F.col("dep"))).alias("to"), (F.coalesce("d", F.lit(0)) + 1).alias("w")))
    while left.take(1):
        on = _hashed(settled.select(F.col("call_id").alias("to"), "level"))
        done = left.join(on, "to", "left").groupBy("call_id").agg(F.max(F.col("level") + F.col("w")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
        done = keep(done.where("all").select("call_id", "level"))
        if not done.take(1):
            break  # what is left waits for a cycle
        done.write.mode("append").parquet(found)
        settled = spark.read.schema(settled.schema).parquet(found)
        left = keep(left.join(_hashed(done.select("call_id")), "call_id", "left_anti"))
    on = _hashed(settled.select(F.col("call_id").alias("to"), "level"))
    out, _ = common.write_shared(spark, settled.unionByName(chain.join(on, "to").select("call_id", (F.col("level") + F.col("d")).alias("level"))), "level")
    common.drop_shared(spark, found, *scratch)
    return out


def positions(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` with ``position`` within their conversation, from a sort by range and the parts' sizes."""
    order = ["conv_id", F.asc_nulls_last("level"), "turn", "kind", "call_id", "message"]
    local = rows.orderBy(*order).withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    local, _ = common.write_shared(spark, local, "ordered")
    parts = local.groupBy("part").agg((F.max("i") + 1).alias("n"))  # one row a part
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = local.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("i"))
    first = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("place").alias("first"))
    placed = placed.join(_hashed(first), F.col("conv_id").eqNullSafe(F.col("c")))
    return placed.select(*rows.columns, (F.col("place") - F.col("first")).alias("position"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and result with its link, level, position, validity and canonical message.

    ``calls``: ``conv_id, turn, call_id, name, arguments, depends_on``; ``results``: ``conv_id, turn, call_id, content``.
    """
    spark = calls.sparkSession
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    results = results.select("conv_id", "turn", "call_id", "content")
    first = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "arguments", "name")).alias("first"))
    answered = results.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"))
    known = first.join(_hashed(answered), "call_id", "left").join(_hashed(levels(spark, calls)), "call_id", "left")
    known, _ = common.write_shared(spark, known.select("call_id", "first", "n_results", "level"), "calls")
    c = calls.join(_hashed(known), "call_id", "left")
    is_first = F.struct("turn", "arguments", "name").eqNullSafe(F.col("first"))
    status = F.when(F.col("call_id").isNull() | F.col("n_results").isNull(), "unanswered").when(~is_first, "repeated").otherwise("linked")
    message = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.lit("call").alias("type")))
    one = c.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", (2 * F.col("level")).alias("level"), status.alias("status"), valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"), message.alias("message"))
    r = results.join(_hashed(known.select("call_id", "level", F.col("first.name").alias("name"))), "call_id", "left")
    message = F.to_json(F.struct(F.col("content").alias("content"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.lit("result").alias("type")))
    two = r.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", (2 * F.col("level") + 1).alias("level"), F.when(F.col("name").isNull(), "orphan").otherwise("linked").alias("status"), F.col("name").isNotNull().alias("valid"), message.alias("message"))
    return positions(spark, one.unionByName(two))


#: The tools as which the turns of a conversation are read; longer texts than ``MOST_CHARS`` make a call invalid.
MOST_CHARS = 300
SCHEMAS: Schemas = {"configure": {"text": Param("string", True, 1, MOST_CHARS)}, "reply": {"text": Param("string", True, 1, MOST_CHARS), "turn": Param("integer", True, 0)}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns read as calls and results: a system turn configures, a user turn asks for a reply, any other turn (also
    one without a role) answers the turn before it.  A call waits for the calls of the two turns before it, so
    chains are as long as conversations."""
    at = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    turn, role = F.col("turn"), F.coalesce("role", F.lit(""))
    system = F.col("role") == "system"
    calls = turns.where(role.isin("system", "user")).select(
        "conv_id", "turn", at(turn).alias("call_id"), F.when(system, "configure").otherwise("reply").alias("name"),
        F.when(system, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text")))).alias("arguments"),
        F.array(at(turn - 1), at(turn - 2)).alias("depends_on"),
    )
    results = turns.where(~role.isin("system", "user")).select("conv_id", "turn", at(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op7_tool_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*conversation_calls(common.table(spark, sf_dir, "conversations")), SCHEMAS)


SQL = f"""
WITH c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, role, text FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM conversations WHERE coalesce(role, '') NOT IN ('system', 'user')),
n AS (SELECT call_id, count(*) AS n FROM r GROUP BY call_id),
-- a call follows the call before it unless more than one turn lies between; its level is its place in such a run
g AS (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 0 ELSE 1 END AS begins FROM (SELECT DISTINCT conv_id, turn, call_id, role FROM c)),
b AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g),
l AS (SELECT call_id, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level, CASE WHEN role = 'system' THEN 'configure' ELSE 'reply' END AS name FROM b),
m AS (SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, (2 * l.level)::INT AS level, CASE WHEN n.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(length(text) BETWEEN 1 AND {MOST_CHARS} AND (role = 'system' OR c.turn >= 0), false) AS valid,
  '{{"arguments":{{"text":' || to_json(text) || CASE WHEN role = 'user' THEN ',"turn":' || c.turn ELSE '' END || '}},"id":"' || c.call_id || '","name":"' || l.name || '","type":"call"}}' AS message
FROM c JOIN l ON l.call_id = c.call_id LEFT JOIN n ON n.call_id = c.call_id
UNION ALL SELECT r.conv_id, r.turn, 'result', r.call_id, (2 * l.level + 1)::INT, CASE WHEN l.call_id IS NULL THEN 'orphan' ELSE 'linked' END, l.call_id IS NOT NULL,
  '{{"content":' || to_json(text) || ',"id":"' || r.call_id || '"' || CASE WHEN l.call_id IS NULL THEN '' ELSE ',"name":"' || l.name || '"' END || ',"type":"result"}}'
FROM r LEFT JOIN l ON l.call_id = r.call_id)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, kind, call_id, message) - 1 AS position FROM m
"""
