"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable. Turns that
follow the last reply (or a conversation without one) are kept in one more example without a trainable part, so
no turn is lost. A turn is written as <|im_start|>role, a line break, its text, <|im_end|> and a line break. Inside roles and
texts a backslash is doubled and `<|` becomes `<\\|`, so control strings in them are plain text and every text comes back exactly.

One shuffle by conversation; examples are made one after the other from the conversation's turns, and never shuffled.
An example holds its whole context by definition, so one conversation must fit a task.

Nulls and odd rows: null texts and roles are empty; turns go by turn number, null first, then by role and text, so ties and repeated
rows have a fixed order and all stay; rows with a null conv_id form one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of escape: a backslash stands for what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(text: Column) -> Column:
    """Roles end at a line break, so breaks in them are written as a backslash and n."""
    return F.replace(escape(text), F.lit("\n"), F.lit("\\n"))


def _unrole(text: Column) -> Column:
    pieces = F.split(text, r"\\\\", -1)  # doubled backslashes apart, what is left of \n is a line break
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, mask_start, mask_length): one row per assistant turn, and one for what follows the last.

    example: number of the turn replied with (from 0), or of the last turn; text: the formatted prefix up to and
    including it; mask_start/mask_length: trainable code points of text (null and 0 where none is).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = whole.select("conv_id", F.transform("turns", lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))).alias("parts"),
                           F.transform("turns", lambda t: F.when(t["role"] == "assistant", F.char_length(escape(t["text"])))).alias("masks"))
    chosen = F.filter(F.sequence(F.lit(0), F.size("masks") - 1), lambda i: F.get("masks", i).isNotNull() | (i == F.size("masks") - 1))
    each = written.withColumn("example", F.explode_outer(chosen))
    made = each.select("conv_id", "example", (F.col("example") + 1).alias("n_turns"), F.array_join(F.slice("parts", F.lit(1), F.col("example") + 1), "").alias("text"),
                       F.get("masks", F.col("example")).alias("_m"), (F.size("parts") == F.col("example") + 1).alias("complete"))
    length = F.coalesce("_m", F.lit(0))
    return made.select("conv_id", "example", "n_turns", "text", F.when(F.col("_m").isNotNull(), F.char_length("text") - len(END) - 1 - length).alias("mask_start"),
                       length.alias("mask_length"), "complete")


def read_turns(text: Column) -> Column:
    """Turns (role, text) of a formatted example."""
    whole = F.split(text, r"<\|im_start\|>", -1)
    parts = F.slice(whole, F.lit(2), F.size(whole) - 1)
    return F.transform(parts, lambda p: F.struct(
        _unrole(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - 2 - len(END))).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and sizes."""
    masked = F.when(F.col("mask_start").isNotNull(), unescape(F.substr("text", F.col("mask_start") + 1, F.col("mask_length"))))
    lines = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    last = F.when(F.col("complete"), F.array_join(lines, ""))
    one = examples.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), "n_turns", masked.alias("loss"), last.alias("turns"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return one.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.sha2(F.max("turns"), 256).alias("turns_sha256"),
                                      loss.alias("_loss"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples")).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
