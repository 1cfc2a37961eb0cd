"""Chat formatting from event logs.

A log holds events of conversations: whole messages, streamed deltas, edits, regenerations and
deletions. Events are dealt by conversation and message and sorted by sequence; running counts tell
which events came after the last that began the content anew, and those are joined into the final
message. Messages are then put in order by conversation, rendered by a template, and the running
length gives each one's place, from which the loss mask follows.

Control strings inside texts are escaped by a backslash after their first character, and one more
if there are some already, so that undoing it gives back exactly the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: The strings that mark turns, and others that models take as control strings.
    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"([<\\[])(\\\\*)({self._tails()})", "$1\\\\$2$3")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)({self._tails()})", "$1$2$3")

    def header(self, role: Column) -> Column:
        """Roles lie on one line: a line feed and the sign of its code are written as %0A and %25."""
        one_line = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        return F.concat(F.lit(self.turn_start), self.escaped(one_line), F.lit("\n"))

    def footer(self) -> str:
        return f"{self.turn_end}\n"

    def turns(self, formatted: Column) -> Column:
        return F.filter(F.split(formatted, f"(?<={_quoted(self.turn_end)}\n)"), lambda t: t != "")

    def role(self, turn: Column) -> Column:
        line = self.unescaped(F.substring(F.substring_index(turn, "\n", 1), F.lit(len(self.turn_start) + 1), F.length(turn)))
        return F.replace(F.replace(line, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))

    def text(self, turn: Column) -> Column:
        head = F.length(F.substring_index(turn, "\n", 1)) + 1
        return self.unescaped(F.substring(turn, head + 1, F.length(turn) - head - len(self.footer())))

    def _tails(self) -> str:
        return "|".join(_quoted(c[1:]) for c in self.controls)


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\|[](){}.*+?^$" else c for c in s)


#: Kinds of events that begin a message's content anew, and those whose text is content.
RESETS, CONTENT = ("message", "edit", "regenerate", "delete"), ("message", "edit", "delta")
#: Code points of a delta in message_log().
PIECE = 2048


def fold_events(events: DataFrame) -> DataFrame:
    """events: conv_id, seq, kind, message, role, text, perhaps step. -> conv_id, seq, message, place, role, text: final messages.

    An event belongs to its message id, or to its seq where that is null; such messages and given ids
    are never mixed up. step, null first, orders the events of one seq. In order of seq and step, a
    "message" begins a message with its text (a second one under the same id begins another),
    "delta" appends, "edit" replaces the text, "regenerate" empties it, "delete" removes the message
    unless it is written anew. Events of one seq and step go by kind, role and text, so repeated rows
    count each. A null text is empty; the role is the first that is given, else empty; other kinds are
    ignored; deltas after a deletion are ignored. Null conversations and null seqs are values like
    any other, and come first. Events are spread by message, not by conversation.
    """
    key = ["conv_id", "message"]
    own = F.coalesce(F.concat(F.lit("id:"), F.col("message").cast("string")), F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    step = (F.col("step") if "step" in events.columns else F.lit(None)).cast("long")
    known = events.where(F.col("kind").isin(*RESETS, "delta")).select("conv_id", "seq", step.alias("step"), "kind", own.alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = F.array_position(F.array(*[F.lit(x) for x in (*RESETS, "delta")]), F.col("kind"))
    in_order = Window.partitionBy(*key).orderBy("seq", "step", order, F.coalesce("role", F.lit("")), "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        known.withColumn("place", F.row_number().over(in_order))
        .withColumn("instance", F.sum((F.col("kind") == "message").cast("long")).over(in_order))
        .withColumn("epoch", F.sum(F.col("kind").isin(*RESETS).cast("long")).over(in_order))
        .withColumn("last", F.max("epoch").over(Window.partitionBy(*key, "instance")))
    )
    live = F.col("epoch") == F.col("last")
    part = F.when(live & F.col("kind").isin(*CONTENT), F.struct("place", "text"))
    folded = numbered.groupBy(*key, "instance").agg(
        F.min("seq").alias("seq"),
        F.min("place").alias("place"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("place"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
        F.max(live & (F.col("kind") == "delete")).alias("deleted"),
    )
    return folded.where(~F.col("deleted")).select("conv_id", "seq", "message", "place", "role", "text")


def format_chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss_spans: one row for each conversation with a message left.

    loss_spans: array of (turn, turn_start, start, end), code points in formatted, under which lie the
    texts of the loss roles as they are escaped there. Messages go by the seq of their first event, then
    by role, text and id. A conversation is one string, so it has to fit in one value; its messages
    meet in one task only to be joined into it. Nulls, repeated rows and ties are as in fold_events();
    an empty log gives no rows; texts of any length stay whole.
    """
    text = template.escaped(F.col("text"))
    drawn = fold_events(events).withColumn("head", template.header(F.col("role"))).withColumn("body", text)
    drawn = drawn.withColumn("turn_text", F.concat("head", "body", F.lit(template.footer()))).withColumn("learn", F.col("role").isin(*template.loss_roles))
    in_order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        drawn.select("conv_id", "seq", "role", "text", "message", "place", "turn_text", "learn", F.length("head").alias("ahead"), F.length("body").alias("long"), F.length("turn_text").alias("all"))
        .withColumn("turn", F.row_number().over(in_order) - 1)
        .withColumn("at", F.sum("all").over(in_order) - F.col("all"))
    )
    span = F.struct("turn", F.col("at").alias("turn_start"), (F.col("at") + F.col("ahead")).alias("start"), (F.col("at") + F.col("ahead") + F.col("long")).alias("end"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "turn_text"))), lambda t: t["turn_text"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text: read back from formatted and loss_spans alone.

    A row for each row, null and repeated ones too; an empty table gives no rows.
    """
    split = formatted.withColumn("raw", template.turns(F.col("formatted")))
    masked = F.transform("loss_spans", lambda s: template.unescaped(F.substring(F.get(F.col("raw"), s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    turns = F.transform("raw", lambda t: F.struct(template.role(t).alias("role"), template.text(t).alias("text")))
    return split.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def message_log(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as the log of how each row may have come about; folded, it gives the rows back.

    Messages of even turns (and of null ones) are streamed: an empty message, a first attempt, a
    regeneration, and the text in deltas of PIECE code points. Those of odd turns are begun, edited to
    the first delta, and gone on with. A null text is empty; repeated rows are messages of their own.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().cast("string").alias("message"))
    event = lambda step, kind, text: F.struct(F.lit(step).cast("long").alias("step") if isinstance(step, int) else step.alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    piece = lambda i: F.substring(F.col("text"), (i * PIECE + 1).cast("int"), F.lit(PIECE))
    count = F.greatest(F.ceil(F.length("text") / PIECE), F.lit(1).cast("long"))
    deltas = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: event(i + 3, "delta", piece(i)))
    draft = F.reverse(F.substring("text", 1, 32))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", draft), event(2, "regenerate", F.lit("")))
    edited = F.array(event(0, "message", draft), event(1, "edit", piece(F.lit(0).cast("long"))))
    events = F.when(F.col("turn") % 2 != 0, F.concat(edited, F.slice(deltas, F.lit(2), F.size(deltas)))).otherwise(F.concat(streamed, deltas))
    return rows.select("conv_id", F.col("turn").alias("seq"), "message", "role", F.explode(events).alias("event")).select("conv_id", "seq", "event.step", "event.kind", "message", "role", "event.text")


def conversation_digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role = 'assistant' AS learn FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', false
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', true
), e AS (
  SELECT *, regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS role_out,
         regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS text_out
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (learn), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learn), '')) AS loss_sha256,
       sum(length(role_out) + length(text_out) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
