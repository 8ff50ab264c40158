r"""Chat formatting as a grammar round trip.

The grammar of a rendered conversation::

    conversation := turn*
    turn         := "### " role ":\n" text "</turn>\n"

A deterministic parser splits at ``</turn>\n`` and at the first ``:\n``, then undoes escapes. A turn is first written
as it is. Where reparsing it gives other content, or it holds a control string (``###`` or ``</turn>``), its
conflicting characters are escaped: ``\`` as ``\b``, ``#`` as ``\h``, ``<`` as ``\l`` and, in roles, ``:`` as ``\c``.
The whole conversation is then reparsed and compared; if it differs, every turn is escaped. Escaped text holds no
``#`` and no ``<``, so that form always parses back; a difference would raise an error.

DataFrame functions only. A conversation is one output row, so its turns meet in one task by definition; turns of
different conversations never do.

The loss mask is a list of byte spans of the rendered text; what the query digests is read back through it.

Defined cases: a null text or role is empty; a very long text is one text like any other (a rendered conversation has
to fit a string of Spark's, 2 GB); turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one order; rows with a null conversation id form one conversation; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.work import literal_table, read

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in ((":", "\\c"), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def conflicts(text: Column) -> Column:
    return (unescape(text) != text) | text.contains("###") | text.contains("</turn>")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, MIDDLE, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(piece, F.length(head) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(pieces, one)


def format_chats(turns: DataFrame, *, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """One row per conversation: key, formatted, recovered (the parsed turns) and mask: where in the UTF-8 bytes of
    ``formatted`` the texts of role ``learn`` stand (start, length), in order."""
    rows = turns.select(F.col(key).alias("key"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumns({"r": F.when(conflicts(role) | role.contains(":"), escape_role(role)).otherwise(role), "t": F.when(conflicts(text), escape(text)).otherwise(text)})
    # What differs after a round trip of the turn alone is escaped; then the conversation as a whole is tried.
    alone = parse(turn_text(F.col("r"), F.col("t")))
    same = (F.size(alone) == 1) & F.coalesce((alone[0]["role"] == role) & (alone[0]["text"] == text), F.lit(False))
    rows = rows.withColumn("same", same)
    rows = rows.withColumns({"r": F.when(F.col("same"), F.col("r")).otherwise(escape_role(role)), "t": F.when(F.col("same"), F.col("t")).otherwise(escape(text))}).drop("same")
    order = W.partitionBy("key").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    frame = len(OPEN) + len(MIDDLE) + len(CLOSE)
    sizes = {"light_size": F.octet_length("t").cast("long"), "full_size": F.octet_length(escape(text)).cast("long")}
    rows = rows.withColumns(sizes | {"light_role": F.octet_length("r"), "full_role": F.octet_length(escape_role(role))})
    ends = {f"{x}_end": F.sum(F.col(f"{x}_role") + F.col(f"{x}_size") + frame).over(so_far) for x in ("light", "full")}
    rows = rows.withColumns({"n": F.row_number().over(order)} | ends)
    span = lambda x: F.struct((F.col(f"{x}_end") - F.col(f"{x}_size") - len(CLOSE)).alias("start"), F.col(f"{x}_size").alias("length")).alias(x)
    turn = F.struct("n", "role", "text", "r", "t", span("light"), span("full"))
    chats = rows.groupBy("key").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    light = F.array_join(F.transform("turns", lambda x: turn_text(x["r"], x["t"])), "")
    full = F.array_join(F.transform("turns", lambda x: turn_text(escape_role(x["role"]), escape(x["text"]))), "")
    chats = chats.withColumns({"source": source, "light": light})
    chats = chats.withColumn("kept", parse(F.col("light")) == F.col("source"))
    chats = chats.withColumn("formatted", F.when(F.col("kept"), F.col("light")).otherwise(full)).withColumn("recovered", parse(F.col("formatted")))
    checked = F.when(F.col("recovered") == F.col("source"), F.col("recovered")).otherwise(F.raise_error(F.lit("a conversation did not survive the round trip")))
    learnt = F.filter("turns", lambda x: x["role"] == learn)
    mask = F.when(F.col("kept"), F.transform(learnt, lambda x: x["light"])).otherwise(F.transform(learnt, lambda x: x["full"]))
    return chats.select(F.col("key").alias(key), "formatted", checked.alias("recovered"), mask.alias("mask"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """What stands under the mask, unescaped, nothing between. Cut by bytes, so each span costs its own length alone; the
    bytes are bound once, as the element of an array."""

    def read(data: Column) -> Column:
        return F.array_join(F.transform(mask, lambda m: unescape(F.substr(data, (m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string"))), "")

    return F.transform(F.array(formatted.cast("binary")), read)[0]


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = literal_table(spark, [{"conv_id": -7, "turn": i, "role": r, "text": said} for i, r in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    chats = format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    told = F.array_join(F.transform("recovered", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss", masked_text(F.col("formatted"), F.col("mask")))
    return chats.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def _escaped_sql(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\b'), '#', '\h'), '<', '\l')"


ORACLE = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\b') OR contains(text, '\h')
                   OR contains(text, '\l') OR contains(text, '\c') THEN {_escaped_sql("text")} ELSE text END AS t
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(t) + 8)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
