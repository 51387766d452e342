"""Preference formatting in DataFrame functions.

Chosen and rejected conversations of a pair share their first turns.  The
longest common prefix of turns is rendered once as the prompt; what follows
on either side is its completion, with the spans that a loss may see: the
texts (and end marks) of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
CHOSEN, REJECTED = "chosen", "rejected"


def _rendered(role: Column, text: Column) -> tuple[Column, Column]:
    before, after = HEAD.split("{}")
    head = F.concat(F.lit(before), role, F.lit(after))
    return head, F.concat(head, text, F.lit(TAIL))


def format_pairs(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans,
    rejected_spans from rows (pair_id, side, turn, role, text).

    Turns are ordered by turn, then role and text; equal rows of a side
    count once.  A null role is rendered as ``unknown``, a null text as the
    empty one, null turns come first and null pair ids form one pair; sides
    other than chosen and rejected are ignored, and so are other columns.  A
    pair with one side has no common turn: its other completion is empty.
    Spans are start:end in code points, comma-joined, end exclusive.

    Turns are matched by grouping on their content, and the prefix and the
    offsets are running values over a pair, so only the example itself,
    which is one row, is ever gathered."""
    rows = turns.filter(F.col("side").isin(CHOSEN, REJECTED)).select(
        "pair_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "side")
    each = rows.groupBy("pair_id", "turn", "role", "text").agg(
        F.max(F.col("side") == CHOSEN).alias("in_chosen"), F.max(F.col("side") == REJECTED).alias("in_rejected"))
    so_far = Window.partitionBy("pair_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    common = F.min(F.col("in_chosen") & F.col("in_rejected")).over(so_far)
    head, whole = _rendered(F.col("role"), F.col("text"))
    marked = each.withColumns({"common": common, "rendered": whole, "head": F.length(head)})
    parts = {"prompt": F.col("common")}
    for side in (CHOSEN, REJECTED):
        parts[side] = ~F.col("common") & F.col(f"in_{side}")
    place = marked
    for side in (CHOSEN, REJECTED):
        place = place.withColumn(f"{side}_end", F.sum(F.when(parts[side], F.length("rendered")).otherwise(0)).over(so_far))
    order = [F.col(c) for c in ("turn", "role", "text")]

    def gathered(keep: Column, value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(*order, value.alias("value"))))), lambda x: x["value"])

    def spans(side: str) -> Column:
        end = F.col(f"{side}_end")
        start = end - F.length("rendered") + F.col("head")
        return F.array_join(gathered(parts[side] & (F.col("role") == trained_role), F.concat_ws(":", start.cast("string"), end.cast("string"))), ",")

    out = place.groupBy("pair_id").agg(
        F.sum(F.col("common").cast("bigint")).alias("n_prompt_turns"),
        *[F.array_join(gathered(keep, F.col("rendered")), "").alias(name) for name, keep in parts.items()],
        spans(CHOSEN).alias("chosen_spans"), spans(REJECTED).alias("rejected_spans"))
    return out


def exchanged_answers(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Pairs from conversations without preference labels: a conversation
    is chosen, and rejected is the same one with its last assistant turn
    taken from its neighbour (ids 2k and 2k + 1 exchange theirs); without a
    neighbour that has one, the answer is missing on the rejected side."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    last = rows.filter(F.col("role") == trained_role).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    answers = last.select(F.col("pair_id").alias("own_id"), F.col("last.turn").alias("last_turn"))
    others = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("text"))
    tagged = rows.join(answers, F.col("pair_id").eqNullSafe(F.col("own_id")), "left")
    is_last = F.coalesce((F.col("role") == trained_role) & (F.col("turn") == F.col("last_turn")), F.lit(False))
    chosen = rows.withColumn("side", F.lit(CHOSEN))
    before = tagged.filter(~is_last).select("pair_id", "turn", "role", "text", F.lit(REJECTED).alias("side"))
    swapped = answers.join(others, F.col("own_id") == F.col("pair_id")).select(
        "pair_id", F.col("last_turn").alias("turn"), F.lit(trained_role).alias("role"), "text", F.lit(REJECTED).alias("side"))
    return chosen.unionByName(before).unionByName(swapped)
