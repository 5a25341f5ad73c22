"""The list of models that a gateway offers, as it answers or as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "array<struct<id:string,name:string,context_length:int,supported_protocols:array<string>>>"
#: Protocols of a model that chats.
CHAT = ("openai:chat-completions", "openai:chat")


def entries(body: Column) -> Column:
    """The entries of an answer: its data, else its models, else the answer itself where it is an array."""
    envelope = F.from_json(body, f"struct<data:{ENTRY},models:{ENTRY}>")
    bare = F.from_json(body, ENTRY)
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.when(F.ltrim(body).startswith("["), bare).otherwise(F.coalesce(some(envelope["data"]), some(envelope["models"]), F.array().cast(ENTRY)))


def usable(rows: DataFrame, order: str, protocols: tuple[str, ...] = CHAT) -> DataFrame:
    """(id, name, context_length): of each trimmed, non-blank id the first entry by ``order`` that speaks a protocol (or names none), by id.

    name is the id where it is blank.
    """
    speaks = (F.coalesce(F.size("supported_protocols"), F.lit(0)) <= 0) | F.exists(F.coalesce("supported_protocols", F.array()), lambda p: F.trim(p).isin(*protocols))
    kept = rows.withColumn("id", F.trim("id")).where((F.col("id") != "") & speaks)
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("n = 1")
    name = F.trim(F.coalesce("name", F.lit("")))
    return first.select("id", F.when(name != "", name).otherwise(F.col("id")).alias("name"), "context_length").orderBy("id")


def parsed(answers: DataFrame, body: str) -> DataFrame:
    """usable entries of the answer in a column."""
    return usable(answers.select(F.posexplode(entries(F.col(body))).alias("pos", "e")).select("pos", "e.*"), "pos")
