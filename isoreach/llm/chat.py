"""Chat formatting: every participant's view of a dialogue, with that speaker as the assistant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM_ROLES = ("system",)
#: Turn numbers in one rendered part. A part is what one row holds, so it bounds a row.
PART_TURNS = 64


def rotate_perspectives(turns: DataFrame, system_roles: Sequence[str] = SYSTEM_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """Render each dialogue once for every participant (a role that is not a system role).

    turns: conv_id, turn, role, text; other columns are ignored. Returned per (conv_id, perspective,
    part): n_turns, n_target_chars, text, and mask, the [start, end) code point spans of text that the
    loss covers, which are the perspective's own messages with their end marker. Part k holds the turn
    numbers of k * part_turns to (k + 1) * part_turns - 1, so a very long dialogue is many rows that
    follow one another, and no task has to hold it whole.

    Within a part messages stand by turn, ties by role, then text; repeated rows are each rendered.
    A null or blank role is the speaker "unknown", a null text is empty, a null turn stands in part -1.
    A null conv_id is a dialogue of its own. A dialogue of system messages alone has no participant
    and so no row. An empty table gives no rows.
    """
    name = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", "unknown").otherwise(F.trim("role"))
    lines = turns.select(
        "conv_id", "turn", name.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("int").alias("part"),
    )
    system = F.col("speaker").isin(list(system_roles))
    views = lines.where(~system).select(F.col("conv_id").alias("view_id"), F.col("speaker").alias("perspective")).distinct()
    seen = lines.join(views, F.col("conv_id").eqNullSafe(F.col("view_id")))
    own = (F.col("speaker") == F.col("perspective")) & ~system
    head = F.when(system, "<|system|>\n").when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    message = F.struct("turn", "speaker", "text", head.alias("head"), own.alias("own"))
    grouped = seen.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    tail = F.lit("<|end|>\n")
    whole = grouped.withColumn("parts", F.transform("messages", lambda m: F.struct(
        F.concat(m["head"], m["text"], tail).alias("text"), F.length(m["head"]).alias("lead"), m["own"].alias("own"))))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.when(p["own"], F.array_append(acc["spans"], F.struct((acc["at"] + p["lead"]).alias("start"), (acc["at"] + F.length(p["text"])).alias("end"))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    out = whole.select(
        "conv_id", "perspective", "part", F.size("parts").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("text"), spans.alias("mask"),
    )
    chars = F.aggregate("mask", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return out.select("conv_id", "perspective", "part", "n_turns", chars.alias("n_target_chars"), "text", "mask")
