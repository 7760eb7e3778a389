"""Chat formatting by event sourcing: logs are folded into final messages, then rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Events that begin a message's text anew; a delta adds to it.
RESETS = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    """Reversible: every backslash is doubled, then every "<|" gets one inside, so no control string can stand in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    # an odd backslash before n is a line break; even ones are backslashes before a letter
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"))


def events_of(conversations: DataFrame) -> DataFrame:
    """One message event for every row of a (conv_id, turn, role, text) table, in the order of turns.

    Rows of equal turn are turns of their own, by role and then text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what the log (conv_id, seq, kind, turn, role, text) amounts to.

    A message's text is that of its last reset (message, edit or regenerate) and the deltas after it, by sequence; resets come
    before deltas of the same sequence. Its role is the last one named. A regenerate takes the later turns that stood
    before it away; turns written again after it stay. Null texts add nothing, a role that is never named is
    empty, null ids are a conversation of their own, events without a turn or of other kinds are ignored.
    """
    known = events.where(F.col("turn").isNotNull() & F.col("kind").isin(*RESETS, "delta"))
    reset = F.col("kind") != "delta"
    event = F.struct(
        F.coalesce("seq", F.lit(-(2**62))).alias("seq"), (~reset).alias("adds"), "kind",
        F.coalesce("text", F.lit("")).alias("text"), "role",
    )
    folded = known.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(event)).alias("log"),
        F.coalesce(F.max(F.when(reset, F.col("seq"))), F.lit(-(2**62))).alias("reset_seq"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
    )
    last = "coalesce(array_max(transform(log, (e, i) -> if(e.adds, -1, i))), -1)"
    folded = folded.withColumn("since", F.expr(f"slice(log, greatest({last}, 0) + 1, size(log))"))
    messages = folded.select(
        "conv_id", "turn", "reset_seq", "regenerated",
        F.coalesce(F.expr("get(filter(reverse(transform(log, e -> e.role)), r -> r is not null), 0)"), F.lit("")).alias("role"),
        F.expr("array_join(transform(since, e -> e.text), '')").alias("text"),
    )
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    cut = F.max("regenerated").over(before)
    messages = messages.withColumn("cut", cut).where("cut is null or cut <= reset_seq")
    return messages.select("conv_id", "turn", "role", "text")


def rendered(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): turns in the template, and where the texts of `loss_role` stand in it.

    `loss` has start and length in code points, in order. The parts are laid out by a running sum, then gathered
    once per conversation: a conversation is one string, so it has to fit a row.
    """
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = messages.select(
        "conv_id", "turn", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("learn")
    )
    rows = rows.withColumn("part", F.concat("head", "body", F.lit(END + "\n")))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    span = F.when(
        F.col("learn"),
        F.struct(
            (F.col("at") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")
        ),
    )
    out = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("parts"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )
    return out.select("conv_id", F.expr("array_join(transform(parts, p -> p.part), '')").alias("formatted"), "loss")


def turns_in(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    # what follows the last end mark is empty
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def read(part: Column) -> Column:
        at = F.locate("\n", part)
        return F.struct(
            unescaped_role(F.substring(part, F.lit(len(START) + 1), at - 1 - len(START))).alias("role"),
            unescaped(F.substring(part, at + 1, F.length(part))).alias("text"),
        )

    return F.transform(parts, read)


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of an event log; see `final_messages` and `rendered`. An empty log gives no row."""
    return rendered(final_messages(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of rendered conversations, taken from the output alone."""
    rows = formatted.withColumn("turns", turns_in(F.col("formatted")))
    learned = F.expr(
        "transform(loss, l -> substring(formatted, cast(l.start + 1 as int), cast(l.length as int)))"
    )
    rows = rows.withColumn("learned", F.array_join(F.transform(learned, unescaped), ""))
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(log, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
