"""Chat formatting by event-sourced reconstruction.

A conversation is kept as a log of events (conv_id, seq, message, op, role, text):

* ``open`` starts a message with a role, ``delta`` appends streamed text,
* ``edit`` replaces a message's text so far, ``regenerate`` clears it for new deltas.

``fold`` replays each message: its text is that of the last edit or regeneration and of all deltas
after it, in sequence order. ``render`` puts the messages into one training text whose control
strings cannot be forged by message texts, and ``parse`` reads the turns back from that text.

Only DataFrame functions are used. Messages are folded and rendered one by one, so that a long
conversation is spread over tasks until the last step, which makes its one output row; that row
holds the whole conversation by definition.

Defined cases: a null text is empty; a null role is the empty role; an event without a known op
changes nothing; events with equal seq are replayed in the order open, edit, regenerate, delta and
then by text; a message without ``open`` has the empty role; an empty log gives no rows. A null
conv_id is a conversation of its own. Equal stored rows are messages of their own, one for each row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
USER, USER_END = "[INST] ", " [/INST]"
BOS, EOS = "<s>", "</s>"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END, TURN_END = "<<ROLE>>", "<</ROLE>>", "<</TURN>>"

#: A control string, perhaps with backslashes after its first sign. Escaping adds one backslash,
#: unescaping takes one away; other text is left alone, so the two undo each other.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?(?:SYS|ROLE|TURN)>>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?(?:SYS|ROLE|TURN)>>)"

TURNS = (
    r"(?s)\[INST\] .*? \[/INST\]"
    r"|<s>.*?</s>"
    r"|<<SYS>>.*?<</SYS>>"
    r"|<<ROLE>>.*?<</ROLE>>.*?<</TURN>>"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def to_events(messages: DataFrame) -> DataFrame:
    """Stored messages (conv_id, turn, role, text) as a log: each is opened, then streamed at once."""
    counted = messages.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kinds = F.explode(F.array(F.lit("open"), F.lit("delta"))).alias("op")
    return rows.select("conv_id", F.col("turn").alias("seq"), "role", "text", "turn", "copy", kinds).select(
        "conv_id",
        "seq",
        F.struct("turn", "role", "text", "copy").alias("message"),
        "op",
        F.when(F.col("op") == "open", F.col("role")).alias("role"),
        F.when(F.col("op") == "delta", F.col("text")).alias("text"),
    )


def fold(events: DataFrame, message: str = "message") -> DataFrame:
    """conv_id, message, first seq, role and final text of every message.

    Both steps are aggregates per message: the last reset first, then the deltas after it, which
    are joined in order. No window or sort holds more than the events of one message.
    """
    rank = (
        F.when(F.col("op") == "open", 0)
        .when(F.col("op") == "edit", 1)
        .when(F.col("op") == "regenerate", 2)
        .when(F.col("op") == "delta", 3)
    )
    ordered = events.withColumn("rank", rank).filter(F.col("rank").isNotNull())
    event = F.struct("seq", "rank", F.coalesce("text", F.lit("")).alias("text"), "role")
    grouped = ordered.groupBy("conv_id", message).agg(
        F.min("seq").alias("seq"), F.sort_array(F.collect_list(event)).alias("events")
    )
    role = F.filter("events", lambda e: (e["rank"] == 0))
    resets = F.transform(
        F.filter("events", lambda e: e["rank"].isin(1, 2)), lambda e: F.struct(e["seq"], e["rank"], e["text"])
    )
    marked = grouped.withColumn("opened", F.get(role, F.lit(0))).withColumn("reset", F.get(resets, F.size(resets) - 1))
    reset = F.col("reset")
    after = F.filter(
        "events",
        lambda e: (e["rank"] == 3)
        & (reset.isNull() | (F.struct(e["seq"], e["rank"]) > F.struct(reset["seq"], reset["rank"]))),
    )
    base = F.when(reset["rank"] == 1, reset["text"]).otherwise(F.lit(""))
    text = F.concat(F.coalesce(base, F.lit("")), F.array_join(F.transform(after, lambda e: e["text"]), ""))
    return marked.select(
        "conv_id",
        message,
        "seq",
        F.coalesce("opened.role", F.lit("")).alias("role"),
        text.alias("text"),
    )


def rendered(role: Column, text: Column) -> Column:
    """One turn between its control strings."""
    safe = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit(USER), safe, F.lit(USER_END)))
        .when(role == "assistant", F.concat(F.lit(BOS), safe, F.lit(EOS)))
        .when(role == "system", F.concat(F.lit(SYSTEM), safe, F.lit(SYSTEM_END)))
        .otherwise(F.concat(F.lit(ROLE), escape(role), F.lit(ROLE_END), safe, F.lit(TURN_END)))
    )


def render(messages: DataFrame, message: str = "message") -> DataFrame:
    """conv_id and its formatted text: the turns by seq, then message, nothing between."""
    turn = F.struct("seq", message, "role", "text", rendered(F.col("role"), F.col("text")).alias("turn"))
    return messages.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["turn"]), "").alias("formatted")
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as (role, text), unescaped; read from the text alone."""

    def between(turn: Column, start: str, end: str) -> Column:
        return F.substring(turn, F.lit(len(start) + 1), F.length(turn) - len(start) - len(end))

    def read(turn: Column) -> Column:
        named = F.split(between(turn, ROLE, TURN_END), ROLE_END, 2)
        role = (
            F.when(turn.startswith(USER), F.lit("user"))
            .when(turn.startswith(BOS), F.lit("assistant"))
            .when(turn.startswith(SYSTEM), F.lit("system"))
            .otherwise(unescape(named[0]))
        )
        text = (
            F.when(turn.startswith(USER), between(turn, USER, USER_END))
            .when(turn.startswith(BOS), between(turn, BOS, EOS))
            .when(turn.startswith(SYSTEM), between(turn, SYSTEM, SYSTEM_END))
            .otherwise(named[1])
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURNS), 0), read)


def loss_mask(turns: Column) -> Column:
    """The texts that are learnt: those of the assistant, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, formatted text, the turns read back from it and the texts under the loss mask."""
    formatted = render(fold(events))
    return formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_mask(F.col("turns")))
