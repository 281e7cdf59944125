"""Chat-turn rendering with the template stored next to the checkpoint.

A leading system turn becomes the system block; the remaining turns must
alternate user/assistant starting with user, otherwise the conversation is
invalid (NULL text plus a reason, where the template raises); user and
assistant content is stripped; an optional generation prefix closes it.

One exchange on ``conv_id`` serves both the window (turn order) and the
aggregation that concatenates the segments in turn order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graded.functions.text import strip

# Special tokens of the stored chat template.
BOS = "<BOS_TOKEN>"
START = "<|START_OF_TURN_TOKEN|>"
END = "<|END_OF_TURN_TOKEN|>"
SYSTEM = "<|SYSTEM_TOKEN|>"
USER = "<|USER_TOKEN|>"
CHATBOT = "<|CHATBOT_TOKEN|>"
ALTERNATION_ERROR = "Conversation roles must alternate user/assistant/user/assistant/..."


def render_chat(turns: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, n_turns, rendered, error)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_first_role", F.first("role").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    has_sys = F.col("_first_role") == "system"
    is_sys_block = has_sys & (F.col("_rn") == 1)
    loop_idx = F.col("_rn") - 1 - has_sys.cast("int")
    bad = ~is_sys_block & ((F.col("role") == "user") != (F.pmod(loop_idx, F.lit(2)) == 0))
    seg = (
        F.when(is_sys_block, F.concat(F.lit(START + SYSTEM), F.col("text"), F.lit(END)))
        .when(F.col("role") == "user", F.concat(F.lit(START + USER), strip("text"), F.lit(END)))
        .when(F.col("role") == "assistant", F.concat(F.lit(START + CHATBOT), strip("text"), F.lit(END)))
        .otherwise(F.lit(""))
    )
    d = d.select("conv_id", "turn", seg.alias("_seg"), bad.alias("_bad"))
    agg = d.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if("_bad").alias("_n_bad"),
        F.array_sort(F.collect_list(F.struct("turn", "_seg"))).alias("_segs"),
    )
    body = F.concat(
        F.lit(BOS),
        F.array_join(F.col("_segs._seg"), ""),
        F.lit(START + CHATBOT if add_generation_prompt else ""),
    )
    ok = F.col("_n_bad") == 0
    return agg.select(
        "conv_id",
        "n_turns",
        F.when(ok, body).alias("rendered"),
        F.when(~ok, F.lit(ALTERNATION_ERROR)).alias("error"),
    )
