"""Chat formatting with typed content parts, in DataFrame functions only.

A message is (role, parts); a part is (kind, text, ref, tokens). ``flatten_parts`` visits the parts in order and turns
text into itself and image, audio and document parts into placeholders ``<|kind|>`` (any other kind into
``<|attachment|>``), recording an attachment (message, place, kind, ref, expanded token count) for each. ``format_chats``
writes the messages of a conversation as ``<|im_start|>role\\ntext<|im_end|>\\n`` and keeps the code-point spans of the
assistant's texts as the loss mask. Places are running sums over a conversation's messages, and what is read back is cut
from its own message, so work grows with the length of a conversation and not with its square.

Control strings inside texts get one backslash after their bracket; a text that already has n backslashes there gets
n + 1, so taking one away restores every text exactly and no control string of a text survives.

Defined cases: null text, ref or parts count as empty; null role as the empty role; a null conversation id is a
conversation of its own; rows with equal turn are ordered by role, then text, repeated rows stay; null turns come
first; a very long text is one message like any other, and a conversation is one row, so it must fit in memory; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What follows the bracket of a control string in the common chat templates.
CONTROL_REST = r"/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|/?INST\]"
START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART_TYPE = "array<struct<kind:string,text:string,ref:string,tokens:long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)(?={CONTROL_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\(?={CONTROL_REST})", "$1")


def escape_role(role: Column) -> Column:
    """A role is one line: its backslashes and line ends are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), F.when(kind.isin(*KINDS), kind).otherwise(F.lit("attachment")), F.lit("|>"))


def flatten_parts(parts: Column) -> Column:
    """struct(body, attachments, expanded_tokens) of an array of typed parts.

    Text parts are escaped; other kinds become placeholders in order. expanded_tokens counts the tokens that the
    attachments stand for. Null parts are skipped.
    """
    clean = F.filter(F.coalesce(parts, F.expr(f"cast(array() as {PART_TYPE})")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    body = F.array_join(
        F.transform(
            clean,
            lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p["kind"])),
        ),
        "",
    )
    attachments = F.filter(
        F.transform(
            clean,
            lambda p, i: F.struct(
                i.cast("int").alias("place"),
                p["kind"].alias("kind"),
                F.coalesce(p["ref"], F.lit("")).alias("ref"),
                F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens"),
            ),
        ),
        lambda a: F.coalesce(a["kind"], F.lit("text")) != "text",
    )
    total = F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return F.struct(body.alias("body"), attachments.alias("attachments"), total.alias("expanded_tokens"))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages(conv_id, turn, role, parts) to one row per conversation.

    Returns conv_id, formatted, loss_spans (code points, start from 0 and length, one per message under the loss), spans
    (all messages' ones, with the start inside the message, after its start mark, and whether the loss holds it),
    attachments (message, place, kind, ref, tokens) and expanded_tokens.
    """
    role = F.coalesce("role", F.lit(""))
    flat = messages.select("conv_id", "turn", escape_role(role).alias("role"), role.isin(*loss_roles).alias("loss"), flatten_parts(F.col("parts")).alias("flat"))
    # Sorting by these is a total order up to rows that are alike.
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attachments", "expanded")
    length = F.length("role") + F.length("body") + F.lit(len(START) + 1 + len(END) + 1)
    rows = (
        flat.select("conv_id", "turn", "role", "loss", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"), F.col("flat.expanded_tokens").alias("expanded"))
        .withColumn("message", F.row_number().over(line) - 1)
        .withColumn("at", F.coalesce(F.sum(length).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    )
    ms = F.array_sort(F.collect_list(F.struct("message", "at", "role", "loss", "body", "attachments", "expanded")))
    gathered = rows.groupBy("conv_id").agg(ms.alias("ms"), F.sum("expanded").alias("expanded_tokens"))
    whole = lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["body"], F.lit(f"{END}\n"))
    span = lambda m: F.struct(
        (m["at"] + len(START) + F.length(m["role"]) + 1).alias("start"), F.length(m["body"]).cast("long").alias("length"), (F.length(m["role"]) + 1).alias("inside"), m["loss"].alias("loss")
    )
    with_message = lambda m: F.transform(m["attachments"], lambda a: F.struct(m["message"], a["place"], a["kind"], a["ref"], a["tokens"]))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("ms", whole), "").alias("formatted"),
        F.transform(F.filter("ms", lambda m: m["loss"]), lambda m: F.struct(span(m)["start"].alias("start"), span(m)["length"].alias("length"))).alias("loss_spans"),
        F.transform("ms", span).alias("spans"),
        F.flatten(F.transform("ms", with_message)).alias("attachments"),
        "expanded_tokens",
    )


def messages_of(formatted: Column) -> Column:
    """The array of messages, each from after its start mark on; no text holds such a mark."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds; placeholders stay as they are."""
    cut = lambda s: F.locate("\n", s)
    tail = len(END) + 1
    return F.transform(
        messages_of(formatted),
        lambda s: F.struct(
            unescape_role(F.substring(s, F.lit(1), cut(s) - 1)).alias("role"),
            unescape(F.substring(s, cut(s) + 1, F.length(s) - cut(s) - tail)).alias("text"),
        ),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order; each is cut from its own message."""
    cut = lambda m, s: F.when(s["loss"], unescape(F.substring(m, s["inside"] + 1, s["length"].cast("int"))))
    return F.filter(F.zip_with(messages_of(formatted), spans, cut), lambda t: t.isNotNull())


def text_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of one text part."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(0).cast("long").alias("tokens"),
    )
    return conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.array(part).alias("parts"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns and loss text read back from the formatted string, as counts and hashes."""
    back = formatted.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("spans")), "").alias("loss"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def typed_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of a text and, by turn, an image, an audio, a document or an unknown part.

    The text is split before its first blank, the part stands between; its reference and token count follow from the row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.greatest(F.locate(" ", text) - 1, F.lit(0))
    part = lambda kind, x, ref, tokens: F.struct(kind.alias("kind"), x.alias("text"), ref.alias("ref"), tokens.cast("long").alias("tokens"))
    nothing, words = F.lit(None).cast("string"), F.lit("text")
    kind = F.element_at(F.array(*map(F.lit, (*KINDS, "im_end"))), (F.pmod(F.coalesce("turn", F.lit(0)), F.lit(4)) + 1).cast("int"))
    ref = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parts = F.array(
        part(words, F.substring(text, F.lit(1), cut), nothing, F.lit(0)), part(kind, nothing, ref, F.length(text)), part(words, F.substring(text, cut + 1, F.length(text)), nothing, F.lit(0))
    )
    return conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), parts.alias("parts"))


def parts_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: a hash of the formatted string, attachments, their references in order and expanded tokens."""
    refs = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["message"].cast("string"), a["place"].cast("string"), a["kind"], a["ref"])), ",")
    return formatted.select("conv_id", F.sha2("formatted", 256).alias("formatted_sha256"), F.size("attachments").cast("long").alias("n_attachments"), refs.alias("refs"), "expanded_tokens")
