"""Chat formatting in relational steps, with Spark expressions alone.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role are merged into one turn with an array of texts; the merged
turns are concatenated under a template::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Texts and roles are escaped so that none can hold a control string: a
backslash is doubled and ``<|`` becomes ``<\\|``.  The way back is exact.  The
loss mask is spans of code points, one for each assistant text, marks left out.

A conversation's turn numbers are cut into parts of ``part_turns``, so a
conversation of any length is formatted by many tasks; usual ones are one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, NEXT, BREAK = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|im_nl|>"
#: Turn numbers of a part.
PART_TURNS = 4096


def _is(text: str) -> Column:
    return F.lit(text)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, _is("\\"), _is("\\\\")), _is("<|"), _is("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _parts(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"))


def formatted(turns: DataFrame, part_turns: int = PART_TURNS, learned: str = "assistant") -> DataFrame:
    """``conv_id, part, n_turns, n_merged, text, loss`` from ``conv_id, turn, role, text``.

    ``loss`` has ``start`` and ``end`` (exclusive, code points of ``text``) of
    each text of the role ``learned``.  Null texts and roles are empty; turns
    of one number come by role, then text; rows without a number come first,
    in the first part; repeated rows are turns of their own; rows without a
    conv_id are one conversation.  Texts of a part are joined with its border
    kept, so merging does not cross parts.  An empty table gives an empty one;
    other columns are not read.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long")
    whole = turns.select("conv_id", part.alias("part"), turn.alias("said")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))
    role = lambda i: F.col("said")[i]["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("said") - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0)))))
    whole = whole.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("said")) - 1
    merged = F.transform("starts", lambda s, k: F.struct(role(s).alias("role"), F.transform(F.sequence(s, end(k)), lambda i: escaped(F.col("said")[i]["text"])).alias("texts")))
    whole = whole.withColumn("merged", merged)
    head = lambda m: F.concat(_is(START), F.replace(escaped(m["role"]), _is("\n"), _is(BREAK)), _is("\n"))
    text = F.array_join(F.transform("merged", lambda m: F.concat(head(m), F.array_join(m["texts"], NEXT), _is(END))), "")
    lead = lambda m, i: F.when(i == 0, F.char_length(head(m))).otherwise(len(NEXT))
    tail = lambda m, i: F.when(i == F.size(m["texts"]) - 1, F.lit(len(END))).otherwise(0)
    piece = lambda m: F.transform(m["texts"], lambda t, i: F.struct(lead(m, i).alias("lead"), F.char_length(t).alias("n"), tail(m, i).alias("tail"), (m["role"] == learned).alias("on")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = lambda a, p: a["at"] + p["lead"]
    span = lambda a, p: F.array(F.struct(start(a, p).alias("start"), (start(a, p) + p["n"]).alias("end")))
    loss = F.aggregate(
        F.flatten(F.transform("merged", piece)), F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, p: F.struct((start(a, p) + p["n"] + p["tail"]).alias("at"), F.when(p["on"], F.concat(a["spans"], span(a, p))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return whole.select("conv_id", "part", F.size("said").cast("long").alias("n_turns"), F.size("merged").cast("long").alias("n_merged"), text.alias("text"), loss.alias("loss"))


def turns_of(text: Column) -> Column:
    """The turns in a formatted text, as an array of ``role, text``, one for each row that went in."""
    turns = _parts(text, START)
    mark = lambda t: F.substring_index(t, "\n", 1)
    body = lambda t: F.substring(t, F.char_length(mark(t)) + 2, F.char_length(t) - F.char_length(mark(t)) - 1 - len(END))
    name = lambda t: unescaped(F.replace(mark(t), _is(BREAK), _is("\n")))
    each = lambda t: F.transform(_parts(body(t), NEXT), lambda x: F.struct(name(t).alias("role"), unescaped(x).alias("text")))
    return F.flatten(F.transform(F.slice(turns, F.lit(2), F.size(turns)), each))


def learned_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(parts: DataFrame) -> DataFrame:
    """A row for each conversation, from what :func:`formatted` gives, read back from its texts and masks alone."""
    said = F.array_join(F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], _is("\n"), t["text"], _is("\n"))), "")
    read = parts.select(
        "conv_id", F.struct("part", said.alias("said"), learned_text(F.col("text"), F.col("loss")).alias("learned")).alias("p"),
        F.size(turns_of(F.col("text"))).cast("long").alias("turns"), F.char_length("text").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    whole = whole.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("learned").alias("learned"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
