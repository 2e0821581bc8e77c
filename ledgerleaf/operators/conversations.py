"""Preparation of conversations for a context of limited size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.text import estimate_tokens, trim_space, truncate_end

MESSAGE_CHARS, HISTORY = 10_000, 12


def normalize_messages(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: any role but assistant is user; blank messages go; long ones are cut."""
    text = truncate_end(trim_space(F.col("text")), MESSAGE_CHARS)
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    return df.where("text is not null").where(trim_space(F.col("text")) != "").select("conv_id", "turn", role.alias("role"), text.alias("text"))


def last_user_message(df: DataFrame) -> DataFrame:
    """``conv_id, text`` of the latest non-blank message of a user or of no role."""
    rows = df.where("(role = 'user' or role is null) and text is not null").where(trim_space(F.col("text")) != "")
    return rows.groupBy("conv_id").agg(trim_space(F.max_by("text", "turn")).alias("text"))


def recent_history(df: DataFrame, n: int = HISTORY) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return df.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def tokens_of(total: Column) -> Column:
    """Tokens of messages whose estimates, 12 a message added, sum up to ``total``; in whole numbers."""
    return F.ceil(total * F.lit(115) / F.lit(100)).cast("long") + 24


def conversation_tokens(df: DataFrame) -> DataFrame:
    total = F.sum(estimate_tokens(F.col("text")) + 12)
    return df.groupBy("conv_id").agg(tokens_of(total).alias("tokens"))


def ladder() -> list[tuple[int, int, int, int, int]]:
    """``(rung, viewer, retrieved, history, least)``: sizes that shrink in turn, and the tokens that a rung must leave."""
    viewer, retrieved, history, rungs = 12_000, 8_000, HISTORY, []
    for rung in range(14):
        rungs.append((rung, viewer, retrieved, history, 256 if rung < 7 else 64))
        if viewer > 4_000:
            viewer = max(4_000, viewer * 3 // 4)
        elif retrieved > 2_000:
            retrieved = max(2_000, retrieved * 3 // 4)
        elif history > 4:
            history = max(4, history * 3 // 4)
        else:
            viewer = retrieved = 0
    return rungs


def fit_context(messages: DataFrame, contexts: DataFrame, window: int, safety: int = 64, system_chars: int = 900) -> DataFrame:
    """``conv_id, rung, viewer_chars, retrieved_chars, history, available``: the first rung that leaves enough tokens.

    ``messages`` are normalised; ``contexts``: ``conv_id, viewer_chars, retrieved_chars`` (sizes of the offered
    texts). Where no rung fits, ``rung`` is null and the last four messages are meant. The ladder is an array
    of 14 rungs in every row, so nothing is joined; the running sums of the last messages are one window.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    recent = messages.withColumn("nth", nth).where(F.col("nth") <= HISTORY)
    sums = [F.coalesce(F.sum(F.when(F.col("nth") <= h, estimate_tokens(F.col("text")) + 12)), F.lit(0)).alias(f"h{h}") for h in sorted({r[3] for r in ladder()})]
    rows = recent.groupBy("conv_id").agg(*sums).join(contexts, "conv_id", "left").fillna({"viewer_chars": 0, "retrieved_chars": 0})
    part = lambda c, cap, prefix: F.when((F.col(c) > 0) & (F.lit(cap) > 0), F.ceil((F.least(F.col(c), F.lit(cap)) + prefix) / 4).cast("long") + 12).otherwise(0)
    rungs = []
    for rung, viewer, retrieved, history, least in ladder():
        total = F.lit((system_chars + 3) // 4 + 12) + part("viewer_chars", viewer, 33) + part("retrieved_chars", retrieved, 32) + F.col(f"h{history}")
        left = F.lit(window - safety) - tokens_of(total)
        rungs.append(F.when(left >= least, F.struct(F.lit(rung).alias("rung"), F.lit(viewer).alias("viewer"), F.lit(retrieved).alias("retrieved"), F.lit(history).alias("history"), left.alias("available"))))
    return rows.withColumn("fit", F.coalesce(*rungs)).select("conv_id", "fit.rung", F.col("fit.viewer").alias("viewer_cap"), F.col("fit.retrieved").alias("retrieved_cap"), F.coalesce("fit.history", F.lit(4)).alias("history"), "fit.available")
