"""Chat formatting by perspective rotation, in DataFrame functions only.

Every conversation is rendered once for each of its participants: that speaker is the
assistant, all others are named users, and the loss mask covers the assistant's words
and the end marks behind them.  Roles in ``CONTEXT`` (system) are no participants; they
are rendered as they are in every perspective.

A rendering is a run of messages ``<|im_start|>role name=NAME\nTEXT<|im_end|>\n``.
It comes back in parts of about ``PART_CHARS`` characters that hold whole messages;
an ordinary conversation is one part, and the parts in order are the rendering.

Skew: messages are laid out by ranges of (conversation, turn), so a conversation of
any length is spread over many tasks.  Parts are cut by a message's place in the
rendering in which all are users: running sums inside a range plus the sums of the
ranges before it (one row per conversation and range).  Parts are thus the same for
every perspective, so a text travels once and is rendered per perspective where its
part lies.

Defined results
* Order: turn (nulls last), speaker, SHA-256 of the text.  Exact repeats of a message
  are one message.
* A null text is empty, a null speaker is ``unknown``, a null conversation id is one
  conversation.  ``<|`` inside a text becomes ``< |``, so a text cannot end its
  message; blanks, control characters, ``<``, ``|`` and ``>`` in a name become ``_``.
* A conversation without a participant has no perspective and gives no rows; neither
  does an empty table.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableguard.llm.common import written

CONTEXT = ("system",)
PART_CHARS = 1 << 16
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(speaker: Column, perspective: Column, context: Column) -> Column:
    name = F.regexp_replace(speaker, r"[\x00-\x20<|>]", "_")
    role = F.when(context, name).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
           context: tuple[str, ...] = CONTEXT, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation, perspective and part: conv, perspective, part, start, n_messages, text, mask.

    ``start`` is where the part begins in the perspective's rendering; ``mask`` holds
    the ranges under loss as [start, end) in the part's text.  Places count code points.
    """
    conv = F.col(conv_col)
    rows = conversations.select(
        conv.alias("conv"), F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("key"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256)).dropDuplicates(["key", "turn", "speaker", "digest"])
    order = [F.col("turn").asc_nulls_last(), F.col("speaker").asc(), F.col("digest").asc()]
    laid = rows.repartitionByRange(F.col("key").asc(), *order).withColumn("range", F.spark_partition_id())
    isin = F.col("speaker").isin(*context) if context else F.lit(False)
    laid = laid.withColumn("aside", isin).withColumn("text", F.replace("text", F.lit("<|"), F.lit("< |")))
    laid = laid.withColumn("size", (F.length(_header(F.col("speaker"), F.lit(None), F.col("aside"))) + F.length("text") + len(CLOSE) + 1).cast("long"))
    laid = written(laid, "chat-layout")  # the ranges are fixed from here on

    # places in the all-users rendering, and the parts
    sums = laid.groupBy("key", "range").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("key").alias("k"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumn("stop", F.sum("size").over(inside)).join(sums, (F.col("key") == F.col("k")) & (F.col("range") == F.col("r")))
    placed = placed.select("conv", "key", "speaker", "aside", "text", (F.col("before") + F.col("stop") - F.col("size")).alias("place"))
    placed = placed.withColumn("part", F.floor(F.col("place") / part_chars).cast("long"))
    parts = placed.groupBy("key", "part").agg(F.first("conv").alias("conv"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n_messages"),
                                              F.array_sort(F.collect_list(F.struct("place", "speaker", "aside", "text"))).alias("talk"))
    parts = written(parts, "chat-parts")

    # where each perspective's part begins: its own earlier messages have another header
    spoken = parts.select("key", "part", F.explode(F.filter("talk", lambda m: ~m["aside"])).alias("m")).groupBy(
        "key", "part", F.col("m.speaker").alias("perspective")).agg(F.count(F.lit(1)).alias("own"))
    people = spoken.groupBy("key").agg(F.collect_set("perspective").alias("people"))
    each = parts.select("key", "part", "place").join(people, "key").select("key", "part", "place", F.explode("people").alias("perspective"))
    each = each.join(spoken, ["key", "part", "perspective"], "left")
    shorter = F.length(_header(F.col("perspective"), F.col("perspective"), F.lit(False))) - F.length(_header(F.col("perspective"), F.lit(None), F.lit(False)))
    so_far = Window.partitionBy("key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("key", "part", "perspective", (F.col("place") + F.coalesce(F.sum("own").over(so_far), F.lit(0)) * shorter).alias("start"))

    who = F.col("perspective")

    def segment(m):
        return F.concat(_header(m["speaker"], who, m["aside"]), m["text"], F.lit(CLOSE + "\n"))

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc, m):
        lead = F.length(_header(m["speaker"], who, m["aside"]))
        end = acc["at"] + lead + F.length(m["text"]) + len(CLOSE) + 1
        own = (m["speaker"] == who) & ~m["aside"]
        return F.struct(end.alias("at"), F.when(own, F.concat(acc["mask"], F.array(F.struct((acc["at"] + lead).alias("start"), (end - 1).alias("end")))))
                        .otherwise(acc["mask"]).alias("mask"))

    return parts.join(each, ["key", "part"]).select(
        F.col("conv").alias(conv_col), "perspective", "part", "start", "n_messages", F.array_join(F.transform("talk", segment), "").alias("text"),
        F.aggregate("talk", nothing, step, lambda acc: acc["mask"]).alias("mask"))
