"""Chat formatting in budgeted windows, with built-in functions only.

Turns of a conversation are laid end to end in tokens (a prefix sum). A window takes the turns
that start in one slot of the token line, retains the system turn, repeats a limited tail of
what came before, and puts only the assistant texts it shows for the first time under its loss
mask.

Slots. With R = budget - history - system tokens, at least budget / 4, a slot is R / 2 tokens
wide. Only the last turn that starts in a slot can run over its end. If that turn is no longer
than a slot, the window's new turns hold R tokens at most; a longer turn gets a window of its
own, so that only a single turn that is itself too long exceeds the budget. No fold over the
conversation is needed, and a conversation of any length costs a sort of its turns.

Edge cases. Null text or role: empty. Null conv_id: one conversation of its own. Repeated rows
and tied turns: kept, ordered by turn, role, text. Empty input: empty result. Columns other than
the four named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may follow the opening character of a control string, in this template or in others.
#: None of these contains an opening character or a backslash.
AFTER_OPENING = r"(?:\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>>|(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>|/?(?:INST|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS|SYSTEM_PROMPT)\])"


def escape(text: Column) -> Column:
    """One more backslash behind the opening character of each control string; control strings
    that hold backslashes there already count too, which makes this reversible."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={AFTER_OPENING})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={AFTER_OPENING})", "$1$2")


def count_tokens(text: Column) -> Column:
    """The default measure: a token for every four bytes begun, and four for a turn's marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def format_chat(
    conversations: DataFrame, budget: int = 1024, history: int = 256, tokens=count_tokens
) -> DataFrame:
    """conv_id, window (from 0), first_turn (ordinal of the first new turn, from 1), n_repeated
    (leading turns that are repeated: system turn and history), n_turns (all in the window),
    n_tokens, formatted, loss: array of (start, length), code points of formatted."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    base = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = (
        base.withColumn("n", tokens(F.col("text")))
        .withColumn("idx", F.row_number().over(order))
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("before", F.col("upto") - F.col("n"))
        .withColumn(
            "sys",
            F.first(
                F.when((F.col("idx") == 1) & (F.col("role") == "system"), F.col("n")).otherwise(0)
            ).over(running),
        )
        .withColumn(
            "slot_width",
            F.greatest(
                F.floor(
                    F.greatest(F.lit(budget - history) - F.col("sys"), F.lit(budget // 4)) / 2
                ),
                F.lit(1),
            ),
        )
        .withColumn("slot", F.floor(F.col("before") / F.col("slot_width")))
        .withColumn("alone", (F.col("n") > F.col("slot_width")).cast("int"))
    )
    key = ["conv_id", "slot", "alone"]
    new = turns.select(*key, "idx", "role", "text", "n", F.lit(True).alias("new"))
    heads = turns.groupBy(*key).agg(
        F.min("before").alias("from_token"), F.min("idx").alias("first_turn")
    )
    # A turn is history of the windows that begin at most `history` tokens after its own start.
    past = (
        turns.filter(
            (F.col("n") <= history) & ~((F.col("idx") == 1) & (F.col("role") == "system"))
        )
        .select(
            "conv_id",
            F.explode(
                F.sequence(
                    F.floor(F.col("upto") / F.col("slot_width")),
                    F.floor((F.col("before") + history) / F.col("slot_width")),
                )
            ).alias("slot"),
            "idx",
            "role",
            "text",
            "n",
            "before",
            "upto",
        )
        .alias("p")
        .join(
            heads.alias("h"),
            F.col("p.conv_id").eqNullSafe(F.col("h.conv_id"))
            & (F.col("p.slot") == F.col("h.slot"))
            & (F.col("p.upto") <= F.col("h.from_token"))
            & (F.col("h.from_token") - F.col("p.before") <= history),
        )
        .select("h.conv_id", "h.slot", "h.alone", "p.idx", "p.role", "p.text", "p.n")
        .withColumn("new", F.lit(False))
    )
    system = (
        turns.filter((F.col("idx") == 1) & (F.col("role") == "system"))
        .select("conv_id", "idx", "role", "text", "n")
        .alias("s")
        .join(
            heads.filter("first_turn > 1").alias("h"),
            F.col("s.conv_id").eqNullSafe(F.col("h.conv_id")),
        )
        .select("h.conv_id", "h.slot", "h.alone", "s.idx", "s.role", "s.text", "s.n")
        .withColumn("new", F.lit(False))
    )
    shown = new.unionByName(past).unionByName(system)
    windows = (
        shown.groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("idx", "new", "role", "text", "n"))).alias("t"))
        .withColumn(
            "parts",
            F.transform(
                "t",
                lambda x: F.struct(
                    F.concat(F.lit(TURN), escape(x["role"]), F.lit(BODY)).alias("head"),
                    escape(x["text"]).alias("body"),
                    (x["new"] & (x["role"] == "assistant")).alias("loss"),
                ),
            ),
        )
        .withColumn(
            "lengths",
            F.transform(
                "parts",
                lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END),
            ),
        )
    )
    spans = F.filter(
        F.transform(
            "parts",
            lambda x, i: F.struct(
                (
                    F.aggregate(
                        F.slice("lengths", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b
                    )
                    + F.length(x["head"])
                ).alias("start"),
                F.length(x["body"]).cast("long").alias("length"),
                x["loss"].alias("loss"),
            ),
        ),
        lambda s: s["loss"],
    )
    number = Window.partitionBy("conv_id").orderBy("slot", "alone")
    return windows.select(
        "conv_id",
        (F.row_number().over(number) - 1).alias("window"),
        F.array_min(
            F.transform(F.filter("t", lambda x: x["new"]), lambda x: x["idx"])
        ).alias("first_turn"),
        F.size(F.filter("t", lambda x: ~x["new"])).alias("n_repeated"),
        F.size("t").alias("n_turns"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
        F.array_join(
            F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""
        ).alias("formatted"),
        F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
        ).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array of (role, text), read back from a formatted window."""
    return F.transform(
        F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: F.length(x) > 0),
        lambda x: F.struct(
            unescape(F.split(x, r"<\|text\|>|<\|end\|>")[0]).alias("role"),
            unescape(F.split(x, r"<\|text\|>|<\|end\|>")[1]).alias("text"),
        ),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: what
    the formatted windows hold, repeated turns left out by their count."""
    said = windows.select(
        "conv_id",
        "window",
        F.length("formatted").alias("chars"),
        F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns")).alias(
            "turns"
        ),
        F.array_join(
            F.transform(
                "loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))
            ),
            "",
        ).alias("loss"),
    ).select(
        "conv_id",
        "window",
        "chars",
        F.size("turns").alias("n"),
        "loss",
        F.array_join(
            F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))),
            "",
        ).alias("said"),
    )
    whole = said.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
    )
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.withColumn("loss_text", joined("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
