"""Chat formatting with perspective rotation, with DataFrame functions only.

Each dialogue is rendered once for every participant: that speaker as assistant, the
others as named users, and a mask over what the speaker says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordkeys.llm.common import materialize, ranged

#: Turns rendered into one row at most. Longer dialogues come as several rows, whose texts, one after the other, are the whole.
BLOCK_TURNS = 512
#: The role that is nobody's perspective.
SYSTEM = "system"
START, STOP = "<|im_start|>", "<|im_end|>"


def escaped(said: Column) -> Column:
    """A mark inside a text gets a backslash after its first character, or one more, so that no text opens or ends a turn."""
    return F.regexp_replace(said, r"<(\\*)\|im_(start|end)\|>", r"<\\$1|im_$2|>")


def header(role: Column, participant: Column) -> Column:
    """Line that opens a turn, seen by a participant. Line breaks in names become blanks."""
    name = escaped(F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\r\n]+", " "))
    seen = F.when(role == participant, "assistant").when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), seen, F.lit("\n"))


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, dealt into ranges; and of each conversation in each range its first row there, its turns in the ranges before, and all its turns."""
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    dealt = ranged(materialize(rows, "turns"), ["conv_id", "turn", "role", "text"], "ordered-turns")
    upto = Window.partitionBy("conv_id").orderBy("range")
    offsets = (
        dealt.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
        .select(F.col("conv_id").alias("c"), F.col("range").alias("g"), "first", "before", "total")
    )
    return dealt, materialize(offsets, "offsets")


def _placed(dealt: DataFrame, offsets: DataFrame) -> DataFrame:
    """conv_id, role, text, place: the turn's number in its conversation, from 0."""
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("g"))
    return dealt.join(offsets, same).select("conv_id", "role", "text", (F.col("before") + F.col("row") - F.col("first")).alias("place"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place: the turn's number in its conversation, from 0.

    Turns are dealt into ranges of (conv_id, turn, role, text) and numbered there as
    they are written; the conversation's turns in the ranges before are added. So a
    conversation of any length is numbered by many tasks.
    """
    return _placed(*_numbered(turns))


def rotate_perspectives(turns: DataFrame, *, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every conversation from every participant's perspective.

    turns: conv_id, turn, role, text; other columns are ignored. Participants are the
    roles of a conversation but the system. Returns conv_id, participant, block,
    first_turn (turns of the dialogue before this row), n_turns (in this row), text,
    and masks: start and end, in characters of this row's text, of what the participant
    says, with the mark that ends the turn.

    A dialogue of up to block_turns turns is one row, whatever its turn numbers are. A
    longer one comes in blocks of so many turns; their texts in order, joined, are the
    rendered dialogue.

    Null text: an empty turn. Null role: a user named unknown, no participant. Null
    conv_id or turn: a value like any other, nulls first. Turns with the same number
    are ordered by role and text; repeated rows are repeated turns. A conversation
    without participants gives no rows. Marks within texts and names are escaped.

    Scale: no task gathers a conversation, only a block; participants are found
    pre-aggregated and meet the blocks by (conv_id, block).
    """
    dealt, offsets = _numbered(turns)
    block = F.floor(F.col("place") / block_turns).cast("long")
    blocks = _placed(dealt, offsets).groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    who = dealt.filter(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select("conv_id", "role").distinct()
    totals = offsets.groupBy("c").agg(F.first("total").alias("total"))
    people = who.join(totals, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "c", F.col("role").alias("participant"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_turns).cast("long"))).alias("k")
    )
    seen = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    who = F.col("participant")
    pieces = F.transform("turns", lambda t: F.struct(
        header(t["role"], who).alias("head"), F.concat(escaped(t["text"]), F.lit(STOP)).alias("body"), F.coalesce(t["role"] == who, F.lit(False)).alias("own")))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate("pieces", start, lambda a, x: F.struct(
        (a["at"] + size(x)).alias("at"),
        F.when(x["own"], F.array_append(a["spans"], F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + size(x) - 1).alias("end")))).otherwise(a["spans"]).alias("spans"),
    ), lambda a: a["spans"])
    return seen.withColumn("pieces", pieces).select(
        "conv_id", "participant", "block", (F.col("block") * block_turns).alias("first_turn"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"), spans.alias("masks"),
    )


def op2_chat_perspectives(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mask = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate_perspectives(turns).withColumn("masks", mask)


# whole dialogues of one perspective, cut after every 512th turn
SQL = r"""
WITH t AS (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS place,
         regexp_replace(coalesce(text, ''), '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g') || '<|im_end|>' AS body,
         regexp_replace(regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g'), '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g') AS name
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, participant, place, place // 512 AS block, coalesce(role = participant, false) AS own, body,
         '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || name END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, block ORDER BY place) - length(body) - 1 AS start FROM s)
SELECT conv_id, participant, block::BIGINT AS block, min(place)::BIGINT AS first_turn, count(*)::BIGINT AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(start::BIGINT::VARCHAR || '-' || (start + length(body))::BIGINT::VARCHAR, ',' ORDER BY place) FILTER (own), '') AS masks
FROM c GROUP BY conv_id, participant, block
"""
