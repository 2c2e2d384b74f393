"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The prompt is the longest run of turns that both begin with, rendered once; a completion is the rest, and its mask names
the spans (in code points) that are trained on: what assistants say, up to and with the end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:bigint,role:string,text:string>"
END = "<|end|>"
ASSISTANT = "assistant"


def gather(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): a conversation's turns by (turn, role, text), null turn numbers first. A null role is `unknown`, a null
    text is empty; turns without id are one conversation, and repeated turns all stay."""
    role, text = F.coalesce(F.col(role_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return turns.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with alike, by role and text."""
    n = F.least(F.size(a), F.size(b))
    same = lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"])
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~same(i))
    return F.coalesce(F.get(differ, F.lit(0)), n)


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(f"{END}\n"))), "")


def mask(turns: Column) -> Column:
    """Spans of the rendered turns that assistants say, as array of struct(start, end)."""
    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(END)
        span = F.when(t["role"] == ASSISTANT, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def spell(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), arrays of turns, to pair_id, n_prompt_turns, prompt, chosen, rejected and both masks.

    A missing (null) side has no turns. Equal conversations give empty completions, conversations that differ in their
    first turn an empty prompt. Repeated pairs are formatted each; other columns are ignored; an empty table gives an
    empty result. A conversation is one row by nature; the mask costs the square of its number of turns.
    """
    none = F.array().cast(f"array<{TURN}>")
    sides = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    cut = sides.withColumn("n", common_turns(F.col("c"), F.col("r")))
    cut = cut.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), *[F.slice(x, F.col("n") + 1, F.size(x)).alias(x) for x in ("c", "r")])
    return cut.select(
        "pair_id", F.col("n").cast("int").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        spell(mask(F.col("c"))).alias("chosen_mask"), spell(mask(F.col("r"))).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """format_pairs over two tables of turns (pair_id, turn, role, text); a pair with turns on one side only is kept."""
    sides = gather(chosen, id_col).select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), F.lit(None).cast(f"array<{TURN}>").alias("rejected"))
    other = gather(rejected, id_col).select(F.col("id").alias("pair_id"), F.lit(None).cast(f"array<{TURN}>").alias("chosen"), F.col("turns").alias("rejected"))
    both = sides.unionByName(other).groupBy("pair_id").agg(F.max("chosen").alias("chosen"), F.max("rejected").alias("rejected"))
    return format_pairs(both)


def with_repeated_answer(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations (id, turns): rejected is the conversation whose last answer is replaced
    by the one before it, or by nothing if there was none. Without an answer both sides are alike."""
    answers = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i)), lambda i: i.isNotNull())
    own = conversations.withColumn("answers", answers)
    last = F.coalesce(F.get("answers", F.size("answers") - 1), F.lit(-1))
    before = F.coalesce(F.get("turns", F.get("answers", F.size("answers") - 2))["text"], F.lit(""))
    own = own.withColumn("last", last).withColumn("before", before)
    worse = F.transform("turns", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("last"), F.col("before")).otherwise(t["text"]).alias("text")))
    return own.select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), worse.alias("rejected"))
