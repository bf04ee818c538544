"""Ordered windows over the turns of conversations(conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_title, strings

CHEAPER = r"\b(cheaper|less expensive|more affordable|lower price|too expensive)\b"
SLOTS = ["scenario", "gender", "budget", "families", "longevity", "projection", "age", "skin", "dislikes"]


def active_segment(turns: DataFrame, is_reset: Column) -> DataFrame:
    """The turns from the last restart on; all of them without one."""
    last = F.max(F.when(is_reset, F.col("turn"))).over(Window.partitionBy("conv_id"))
    return turns.withColumn("_from", last).where(F.col("_from").isNull() | (F.col("turn") >= F.col("_from"))).drop("_from")


def segment_query(turns: DataFrame) -> DataFrame:
    """(conv_id, query): the user's turns joined in order."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ". ").alias("query"))


def sliding_context(turns: DataFrame, size: int = 3) -> DataFrame:
    """The user's turns, each with the texts of the last ``size``."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1 - size, 0)
    return turns.where("role = 'user'").withColumn("context", F.collect_list("text").over(by))


def next_slot(filled: Column, asked: Column, alternative: Column) -> Column:
    """The first slot that is neither answered nor asked; none for alternative searches."""
    open_ = F.array_except(F.array_except(strings(*SLOTS), F.coalesce(filled, strings())), F.coalesce(asked, strings()))
    return F.when(~alternative, F.try_element_at(open_, F.lit(1)))


def cheaper_follow_up(turns: DataFrame) -> DataFrame:
    """turns with ``budget`` and ``cheapest`` where a text asks for cheaper without a number: just below the last lowest price."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    low = F.last("min_price", ignorenulls=True).over(by)
    asks = F.lower("text").rlike(CHEAPER) & ~F.col("text").rlike(r"\d") & low.isNotNull()
    return turns.withColumns({"budget": F.when(asks, F.greatest(F.lit(100.0), low - 1)), "cheapest": F.coalesce(asks, F.lit(False))})


def recent_conversations(conversations: DataFrame, n: int = 30) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "conv_id").limit(n)


def titles(turns: DataFrame) -> DataFrame:
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", short_title(F.col("text")).alias("title"))
