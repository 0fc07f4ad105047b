"""Operator 2, chat formatting: the dialogue from the view of each participant.

For every participant of a conversation the whole dialogue is rendered once, with that speaker as the
assistant and all others as named users; roles of `context_roles` (system prompts) stay as they are and
are no participants.  The result has a row for each view and turn: the rendered segment, where it stands
in the rendered dialogue, and the span in it that counts for the loss (what the speaker said and the end
mark).  Segments in order of `position`, joined, are the dialogue.

A conversation may be very large, so no task needs the whole of one: turns are sorted and cut into
blocks by range partitioning, numbered and measured within blocks, and the starts of blocks follow from
a table with a row for each view and block.

Only column functions are used.

Results for odd inputs: a null text is empty, a null role a speaker without a name, a null turn comes
first; ties are ordered by role and text; repeated rows are turns of their own; a conversation with
context only has no view; markers within texts and names are broken up; extra columns are dropped.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_stage

CONTEXT_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Texts cannot hold markers: a blank breaks them up."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _running_starts(df: DataFrame, keys: list[str], block: str, measure: Column, name: str) -> DataFrame:
    """What `measure` sums to in the blocks before each block of the same keys."""
    sums = df.groupBy(*keys, block).agg(measure.alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))


def chat_views(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES,
) -> DataFrame:
    """(conv_id, speaker, position, turn, role, segment, start, end, loss_start, loss_end)."""
    order = ["turn", "role", "text"]
    turns = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    cut = shared_stage(
        turns.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()), "turns"
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy(*order)
    first = _running_starts(cut, ["conv_id"], "block", F.count("*"), "first")
    same = cut["conv_id"].eqNullSafe(first["conv_id"]) & (cut["block"] == first["block"])
    numbered = (
        cut.withColumn("place", F.row_number().over(in_block))
        .join(first, same)
        .select(cut["*"], (F.col("first") + F.col("place") - 1).cast("long").alias("position"))
    )
    speakers = (
        cut.filter(~F.col("role").isin(*context_roles))
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
        .distinct()
    )
    views = numbered.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    spoken = F.col("role") == F.col("speaker")
    header = (
        F.when(spoken, F.lit("assistant"))
        .when(F.col("role").isin(*context_roles), F.col("role"))
        .otherwise(F.concat(F.lit("user name="), _plain(F.col("role"))))
    )
    opening = F.concat(F.lit(START), header, F.lit("\n"))
    views = (
        views.withColumn("opening", opening)
        .withColumn("segment", F.concat("opening", _plain(F.col("text")), F.lit(END + "\n")))
        .withColumn("length", F.length("segment").cast("long"))
    )
    keys = ["conv_id", "speaker"]
    starts = _running_starts(views, keys, "block", F.sum("length"), "block_start").select(
        F.col("conv_id").alias("_conv"),
        F.col("speaker").alias("_speaker"),
        F.col("block").alias("_block"),
        "block_start",
    )
    up_to = Window.partitionBy(*keys, "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    ends = views.withColumn("in_block", F.sum("length").over(up_to)).join(
        starts,
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("speaker") == F.col("_speaker"))
        & (F.col("block") == F.col("_block")),
    )
    end = F.col("block_start") + F.col("in_block")
    start = end - F.col("length")
    loss = F.col("role") == F.col("speaker")
    return ends.select(
        "conv_id",
        "speaker",
        "position",
        "turn",
        "role",
        "segment",
        start.alias("start"),
        end.alias("end"),
        F.when(loss, start + F.length("opening")).alias("loss_start"),
        F.when(loss, end - 1).alias("loss_end"),
    )
