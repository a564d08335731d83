"""Chat formatting by prefix-target expansion; DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, then that reply, which alone is
trainable. A conversation that doesn't end with an assistant turn gets one more example without a trainable part,
so that its last turns are in the output too.

The template writes a turn as ``<turn ROLE>TEXT</turn>`` and a newline. In roles and texts a backslash, ``<`` and
``>`` become ``\\s``, ``\\l`` and ``\\g``, so no text can open or close a turn, whatever it says, and reading back is exact.

Defined results: a null text or role is empty; turns of equal number stand in order of role and text, null numbers
first; repeated rows are turns of their own; rows without a conv_id are one conversation; an empty table gives no
rows; other columns are ignored. A conversation's turns meet in one row, as its text must; examples are made one by
one from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
_CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _open(role: Column) -> Column:
    return F.concat(F.lit("<turn "), escape(role), F.lit(">"))


def format_examples(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """(conv_id, example, turns, is_whole, formatted, loss_start, loss_end): an example holds the first ``turns`` turns;
    the loss mask is the code points from loss_start up to loss_end; ``is_whole`` marks the one with all turns."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("said"))
    whole = whole.select("conv_id", "said", F.transform("said", lambda t: F.concat(_open(t.role), escape(t.text), F.lit(_CLOSE))).alias("parts"), F.size("said").alias("n"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (F.element_at("said", k).role == trainable_role) | (k == F.col("n")))
    each = whole.select("conv_id", "n", "said", "parts", F.posexplode(ends).alias("example", "turns"))
    target = F.element_at("said", F.col("turns"))
    each = each.select("conv_id", "example", "turns", (F.col("turns") == F.col("n")).alias("is_whole"), F.array_join(F.slice("parts", F.lit(1), F.col("turns") - 1), "").alias("context"), target.role.alias("role"), escape(target.text).alias("reply"))
    start = F.length("context") + F.length(_open(F.col("role")))
    is_target = F.col("role") == trainable_role
    return each.select(
        "conv_id",
        "example",
        "turns",
        "is_whole",
        F.concat("context", _open(F.col("role")), "reply", F.lit(_CLOSE)).alias("formatted"),
        F.when(is_target, start).otherwise(0).alias("loss_start"),
        F.when(is_target, start + F.length("reply")).otherwise(0).alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted example, read back."""
    pieces = F.split(formatted, _CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(7)), ">", 1)).alias("role"), unescape(F.substr(p, F.locate(">", p) + 1)).alias("text")))


def trainable_text(examples: DataFrame) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def digests(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from format_examples()."""
    read = examples.select(
        "conv_id",
        F.when(F.col("is_whole"), parse_turns(F.col("formatted"))).alias("read"),
        F.when(F.col("loss_end") > F.col("loss_start"), F.struct("example", trainable_text(examples).alias("text"))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    digest = F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
    read = read.select("conv_id", F.size("read").cast("long").alias("n"), F.when(F.col("read").isNotNull(), digest).alias("sha"), "loss", "chars")
    one = read.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list("loss")).alias("losses"), F.sum("chars").alias("formatted_chars"))
    one = one.withColumn("loss", F.array_join(F.transform("losses", lambda x: x.text), ""))
    return one.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
