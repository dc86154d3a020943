"""Chat formatting from event logs (operator 6): DataFrame functions only.

A log has one row per event of a conversation, ordered by a sequence number: `message` sets a message's text, `delta`
appends to it, `edit` replaces it, `regenerate` starts it anew and voids every later message logged before it, and
`delete` removes it. Window functions over each conversation fold the events into final messages, which are rendered
into one text per conversation.

A turn is written `<turn ROLE>TEXT</turn>` and a newline. Inside roles and texts a backslash becomes `\\b` and `<` becomes
`\\l`; in roles `>` becomes `\\g` too. No control string can then occur inside a text, and two replacements undo the
escape. The loss mask lists where the escaped assistant texts stand, in code points.

A conversation is one unit of output, so its events meet in one task: a conversation is as large as one rendered text
may be. Many conversations with equal texts are separate keys.

Defined results: null texts and roles are empty; events with equal sequence numbers are ordered by kind, role and text;
repeated events are applied again; a conversation whose messages are all deleted gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
#: Kinds of events that set a message's text anew.
BASES = ("message", "edit", "regenerate")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, turn, seq, kind, role, text)."""
    e = log.select("conv_id", "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn")
    restart = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    e = e.withColumn("void_", restart).where(F.col("void_").isNull() | (F.col("seq") > F.col("void_")))
    e = e.withColumn("base_", F.max(F.when(F.col("kind").isin(*BASES), F.col("seq"))).over(own))
    e = e.withColumn("gone_", F.max(F.when(F.col("kind") == "delete", F.col("seq"))).over(own))
    e = e.where(F.col("gone_").isNull() | (F.col("seq") > F.col("gone_")))
    e = e.where(F.col("base_").isNull() | (F.col("seq") >= F.col("base_")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    done = e.groupBy("conv_id", "turn").agg(parts.alias("p"))
    return done.select("conv_id", "turn", F.element_at("p.role", 1).alias("role"), F.concat_ws("", "p.text").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted and loss_mask, an array of (start, length) in code points from 0."""
    m = messages.select(
        "conv_id",
        F.col("turn").alias("t"),
        F.coalesce("role", F.lit("")).alias("r"),
        F.coalesce("text", F.lit("")).alias("x"),
    )
    m = m.select(
        "conv_id",
        "t",
        F.concat(F.lit(OPEN), F.replace(escape(F.col("r")), F.lit(">"), F.lit("\\g")), F.lit(">")).alias("h"),
        escape(F.col("x")).alias("b"),
        F.col("r").isin(*loss_roles).alias("l"),
    )
    before = Window.partitionBy("conv_id").orderBy("t", "h", "b").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("s", F.coalesce(F.sum(F.length("h") + F.length("b") + F.lit(len(CLOSE))).over(before), F.lit(0)) + F.length("h"))
    turns = F.array_sort(F.collect_list(F.struct("s", "h", "b", "l")))
    g = m.groupBy("conv_id").agg(turns.alias("turns"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["h"], t["b"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["l"]), lambda t: F.struct(t["s"].cast("long").alias("start"), F.length(t["b"]).cast("long").alias("length"))).alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text)."""
    pieces = F.split(formatted, CLOSE)
    head = lambda p: F.substring_index(F.substring_index(p, ">", 1), OPEN, -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.replace(head(p), F.lit("\\g"), F.lit(">"))).alias("role"),
            unescape(F.regexp_replace(p, "^[^>]*>", "")).alias("text"),
        ),
    )


def logged(turns: DataFrame) -> DataFrame:
    """A log that folds to the given turns: assistant texts are drafted, regenerated and streamed, others are edited in."""
    x = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(x) / 2).cast("int")
    event = lambda i, kind, text: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "message", F.lit("...")), event(1, "regenerate", F.substring(x, F.lit(1), half)), event(2, "delta", F.substring(x, half + 1, F.length(x))))
    written = F.array(event(0, "message", F.lit("")), event(1, "edit", x))
    e = turns.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(written)).alias("e"))
    return e.select("conv_id", "turn", (F.col("turn") * 4 + F.col("e.i")).alias("seq"), "e.kind", "role", "e.text")


def digest(conversations: DataFrame) -> DataFrame:
    """Query op6: every conversation and the fixed conversation -7, as event logs, formatted and read back from the output."""
    trap = "\\### Assistant: </turn> ok"
    extra = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    out = render(fold(logged(rows.withColumn("turn", number)))).withColumn("back", parse(F.col("formatted")))
    under = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    out = out.withColumn("loss", F.array_join(under, ""))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
