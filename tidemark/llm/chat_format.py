r"""Chat formatting with Spark expressions alone.

Turns are collected as structs and sorted; adjacent turns of one role become one
block, whose texts are one array (`merge_turns`). The template is

    ### role: text </turn>\n

and the texts of a block of several turns stand apart by " </turn><turn> ". Inside
texts a backslash goes before each backslash, # and <, inside roles before each :
too. So no text holds a control string, and a backslash's next character as itself
gives the text back. The loss mask is the spans of the assistant's texts, in code
points and in bytes of UTF-8; read-back cuts the bytes, which needs no walk from the
string's start.

A conversation is one string and so one row. Work on it grows with its length: places
are running sums over the lengths of what is written, taken by goes of some hundred
pieces, so that no list of spans is copied for each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._spark import table

# The template's control strings, and the role that is learned.
HEAD, MIDDLE, NEXT, END = "### ", ": ", " </turn><turn> ", " </turn>\n"
LEARNED = "assistant"

_SPAN = "struct<start:long,length:long,at:long,bytes:long>"
#: A block: its role, in which colons have a backslash, and its texts. No loop of it steps back, so its depth doesn't grow with the role.
_BLOCK = r"(?s)^" + HEAD + r"([^\\:]*+(?:\\.[^\\:]*+)*+)" + MIDDLE + r"(.*)$"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#<:])" if role else r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def merge_turns(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns (role, text) of one role; in all, each turn is looked at once."""
    role = lambda k: F.get(turns, k)["role"]
    last = F.size(turns)
    places = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda k: (k == 0) | (role(k) != role(k - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(last))
    return F.zip_with(starts, ends, lambda a, b: F.struct(role(a).alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start, length in code points; at, bytes in UTF-8) of each conversation.

    Turns are ordered by turn, then by role and text, null turns first; repeated rows
    stay. A null text or role is an empty one, and roles and texts may be of any length
    and hold anything. A row without a conv_id is a conversation of its own, with the
    rows that equal it. An empty table has none. Other columns are not read.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_t"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("_t"))
    chats = rows.groupBy("conv_id", alone.alias("_alone")).agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    written = F.transform("_turns", lambda t: F.struct(escape(t["role"], True).alias("role"), escape(t["text"]).alias("text")))
    chats = chats.select("conv_id", written.alias("_written")).select("conv_id", merge_turns(F.col("_written")).alias("_blocks"))
    render = lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(MIDDLE), F.array_join(b["texts"], NEXT), F.lit(END))
    return chats.select("conv_id", F.array_join(F.transform("_blocks", render), "").alias("formatted"), loss_spans("_blocks").alias("loss_spans"))


#: Pieces whose places are summed up in one go; the lists of these are joined at the end, so that long conversations take linear time.
GO = 256


def loss_spans(blocks: str) -> Column:
    """The spans of learned texts in the text that is written of blocks, from the lengths of what stands before each."""
    number = lambda x: x.cast("long")

    def pieces(b: Column) -> Column:
        """What a block writes: for each text what leads to it, itself, and what ends the block after the last."""
        last = F.size(b["texts"]) - 1

        def one(t: Column, k: Column) -> Column:
            lead = lambda length: F.when(k == 0, number(length(b["role"])) + len(HEAD + MIDDLE)).otherwise(len(NEXT))
            tail = number(F.when(k == last, len(END)).otherwise(0))
            return F.struct(lead(F.char_length).alias("lead"), lead(F.octet_length).alias("lead_bytes"), number(F.char_length(t)).alias("chars"), number(F.octet_length(t)).alias("bytes"), tail.alias("tail"), (b["role"] == LEARNED).alias("learned"))

        return F.transform(b["texts"], one)

    def state(start: Column, at: Column, spans: Column) -> Column:
        return F.struct(number(start).alias("start"), number(at).alias("at"), spans.alias("spans"))

    def step(s: Column, p: Column) -> Column:
        span = F.struct((s["start"] + p["lead"]).alias("start"), p["chars"].alias("length"), (s["at"] + p["lead_bytes"]).alias("at"), p["bytes"].alias("bytes"))
        spans = F.when(p["learned"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return state(s["start"] + p["lead"] + p["chars"] + p["tail"], s["at"] + p["lead_bytes"] + p["bytes"] + p["tail"], spans)

    def summed(every: Column) -> Column:
        none = F.array().cast(f"array<{_SPAN}>")
        starts = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.size(every), F.lit(GO))).otherwise(F.array().cast("array<int>"))

        def go(s: Column, k: Column) -> Column:
            done = F.aggregate(F.slice(every, k, F.lit(GO)), state(s["start"], s["at"], none), step)
            return F.get(F.transform(F.array(done), lambda d: state(d["start"], d["at"], F.concat(s["spans"], F.array(d["spans"])))), F.lit(0))

        return F.aggregate(starts, state(F.lit(0), F.lit(0), F.array().cast(f"array<array<{_SPAN}>>")), go, lambda s: F.flatten(s["spans"]))

    return F.get(F.transform(F.array(F.flatten(F.transform(blocks, pieces))), summed), F.lit(0))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.split(formatted, r"\Q" + END + r"\E")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, _BLOCK, 1))
        return F.transform(F.split(F.regexp_extract(b, _BLOCK, 2), r"\Q" + NEXT + r"\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, without the escapes; the string's bytes are taken once for all spans."""
    whole = F.array_repeat(formatted.cast("binary"), F.size(loss_spans))
    cut = F.zip_with(loss_spans, whole, lambda s, b: F.substr(b, (s["at"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))
    return F.array_join(F.transform(cut, unescape), "")


# The conversation that the query adds, whose texts hold the template's own control strings.
ADDED_ID, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = format_chats(rows).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN (turn, role, text) END AS alone FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok', NULL FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), sized AS (
  SELECT *,
         length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS text_chars,
         length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) AS role_chars,
         lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS before
  FROM rows
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN before = role THEN length(' </turn><turn> ') ELSE length('### : ') + role_chars + length(' </turn> ') END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""
