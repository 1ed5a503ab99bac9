"""Chat formatting by prefix-target expansion: one training example per assistant turn.

An example holds all turns up to and including one assistant turn; only that reply's text is
trainable. Turns after the last assistant turn form one more example without a target, so the
output holds every turn. DataFrame functions only.

A turn is written `<s>role[TURN]text</s>`. In roles and texts every character that a mark
begins with (`<`, `[`) and the escape sign `%` are written as `%3C`, `%5B` and `%25`: a text
can't forge a mark, and reading undoes it. The mask is a span of characters of the example.

Defined results: null texts and roles are empty; turns of equal number are ordered by role,
then text; repeated rows stay; a null conversation id is a conversation of its own; a text of
any length stays whole; no rows give no examples. A conversation's turns meet in one row, and its
examples repeat their prefixes, so one of n turns takes n times its text: thousands of turns are for
a splitter before this. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.tables import pick

BEGIN, BODY, END = "<s>", "[TURN]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("["), F.lit("%5B"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%5B"), F.lit("[")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_length (characters; null without target)."""
    rows = pick(turns, conv_id=conv, turn=turn, role=role, text=text).select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(BODY))
    talks = talks.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: t["role"] == target).alias("is_target"),
        F.transform("turns", lambda t: F.char_length(head(t))).alias("heads"),
    )
    n = F.size("parts")
    # ends of examples: after each target, and after the last turn
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("is_target", i - 1) | (i == n))
    examples = talks.select("*", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("parts", F.col("n_turns"))
    before = F.concat_ws("", F.slice("parts", F.lit(1), F.col("n_turns") - 1))
    trained = F.element_at("is_target", F.col("n_turns"))
    start = F.char_length("before") + F.element_at("heads", F.col("n_turns"))
    return examples.select("*", before.alias("before")).select(
        "conv_id",
        "example",
        F.concat("before", last).alias("formatted"),
        F.when(trained, start).cast("long").alias("loss_start"),
        F.when(trained, F.char_length(last) - F.element_at("heads", F.col("n_turns")) - len(END)).cast("long").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """Turns of an example as an array of (role, text), the exact texts again."""
    bodies = F.transform(
        F.filter(F.split(formatted, END), lambda x: x != ""),
        lambda x: F.split(F.substring(x, len(BEGIN) + 1, 1 << 30), r"\[TURN\]"),
    )
    return F.transform(bodies, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(example: DataFrame) -> Column:
    """Text under the mask, unescaped; empty without target."""
    masked = F.substring(example["formatted"], (example["loss_start"] + 1).cast("int"), example["loss_length"].cast("int"))
    return F.coalesce(unescape(masked), F.lit(""))


def digest(examples: DataFrame) -> DataFrame:
    """What a reader of the examples finds per conversation."""
    per = examples.select(
        "conv_id",
        "example",
        loss_text(examples).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
        "formatted",
    )
    # max_by keeps one formatted text, that of the longest example, while rows are combined
    talks = per.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    turns = parse(F.col("whole"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return talks.select("*", turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
