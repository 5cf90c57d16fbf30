"""Chat formatting with DataFrame expressions only.

A conversation's turns are collected as structs and sorted by turn; runs of one role become one marked turn, whose texts
stay apart by a mark of their own, so that nothing is lost:

    <turn>role<text>first text<part>second text</turn>

Inside roles and texts a backslash becomes \\0 and "<" becomes \\1, so that marks never occur there and reading back is exact.
The loss mask is an array of [start, end) in characters of the formatted text, one for each assistant text.

Defined results: a null text or role counts as empty; turns that tie are in order of role and text; a null conv_id is a
conversation of its own; a conversation of any length is one row, as the method collects its turns; a very long text is
formatted whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

TURN, TEXT, PART, END = "<turn>", "<text>", "<part>", "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


#: Pieces whose places are added up together: an array grows by copying, so long conversations are dealt with in blocks.
BLOCK = 256


def format_conversations(turns: DataFrame, learn_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start and end)."""
    turns = columns(turns, conv_id=(id_col, None), turn=(turn_col, None), role=(role_col, None), text=(text_col, None))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    # runs of one role: where each begins, and where the next does
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]))
    found = found.withColumn("begins", begins)
    runs = F.arrays_zip(F.col("begins").alias("a"), F.concat(F.slice("begins", F.lit(2), F.greatest(F.size("begins") - 1, F.lit(0))), F.array(n)).alias("z"))

    def merged(run: Column) -> Column:
        """A run as one turn: its role, and its texts, each with the mark before it and the last with the mark after it."""
        role = F.get("turns", run["a"])["role"]
        own = F.slice("turns", run["a"] + 1, run["z"] - run["a"])
        before = lambda i: F.when(i == 0, F.concat(F.lit(TURN), escape(role), F.lit(TEXT))).otherwise(F.lit(PART))
        after = lambda i: F.when(i == run["z"] - run["a"] - 1, F.lit(END)).otherwise(F.lit(""))
        return F.transform(own, lambda x, i: F.struct(before(i).alias("before"), escape(x["text"]).alias("text"), after(i).alias("after"), (role == learn_role).alias("learn")))

    found = found.select("conv_id", F.flatten(F.transform(runs, merged)).alias("pieces"))
    size = lambda x: F.char_length(x).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        a = done["at"] + size(x["before"])
        b = a + size(x["text"])
        return F.struct((b + size(x["after"])).alias("at"), F.when(x["learn"], F.array_append(done["spans"], F.struct(a.alias("start"), b.alias("end")))).otherwise(done["spans"]).alias("spans"))

    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(pieces) - 1) div {BLOCK}").cast("int")), lambda k: F.aggregate(F.slice("pieces", k * BLOCK + 1, F.lit(BLOCK)), start, step))
    found = found.select("conv_id", F.array_join(F.transform("pieces", lambda x: F.concat(x["before"], x["text"], x["after"])), "").alias("formatted"), blocks.alias("blocks"))
    begin = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda done, x: F.array_append(done, F.element_at(done, -1) + x["at"]))
    moved = lambda z: F.transform(z["spans"], lambda s: F.struct((s["start"] + z["begin"]).alias("start"), (s["end"] + z["begin"]).alias("end")))
    zipped = F.zip_with(F.col("blocks"), F.slice(begin, F.lit(1), F.size("blocks")), lambda x, at: F.struct(x["spans"].alias("spans"), at.alias("begin")))
    return found.select("conv_id", "formatted", F.flatten(F.transform(zipped, moved)).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as before the merge: array of role and text."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    texts = lambda b: F.split(F.substring_index(b, TEXT, -1), PART)
    role = lambda b: unescape(F.replace(F.substring_index(b, TEXT, 1), F.lit(TURN), F.lit("")))
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    part = lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return unescape(F.array_join(F.transform(mask, part), ""))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Figures of formatted conversations, all read back from them."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
