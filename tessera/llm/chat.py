"""Chat formatting with a grammar round trip, DataFrame operations only.

A conversation is rendered turn by turn as ``<|im_start|>role``, a line feed,
the text and ``<|im_end|>`` with a line feed. A deterministic parser reads the
rendered string back: it splits at the end marks, wants the start mark at the
head of every part, no other mark inside, and undoes the escape. The turns that
come back are compared with the source; a conversation that differs has its
turns escaped and is rendered and compared again, and must then be identical.

Escape: each ``<`` that is followed by any number of backslashes and ``|`` gets
one more backslash, so no mark is left inside, and the parser takes one away.
Roles may hold line feeds, which become ``%0A`` (and ``%`` becomes ``%25``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Running sums over a conversation: pieces of so many turns, and levels of pieces of pieces.
BLOCK, LEVELS = 64, 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def render(turns: Column) -> Column:
    """The string of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def parts(formatted: Column) -> Column:
    """The turns' bodies between start and end marks; a part that breaks the grammar is null."""
    split = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(split, 1, F.size(split) - 1), lambda s: F.when(
        s.startswith(START) & ~F.contains(F.substr(s, F.lit(len(START) + 1)), F.lit("<|"))
        & F.contains(s, F.lit("\n")), F.substr(s, F.lit(len(START) + 1))))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read from the string; null turns where the grammar is broken."""
    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.when(p.isNotNull(), F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substr(p, F.length(role) + 2)).alias("text")))
    return F.transform(parts(formatted), turn)


def _blocks(values: Column) -> Column:
    """The array in pieces of ``BLOCK``."""
    n = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda b: F.slice(values, (b - 1) * BLOCK + 1, BLOCK))
    return F.when(F.size(values) > 0, cut).otherwise(F.array().cast("array<array<long>>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def _before(values: Column, start: Column) -> Column:
    """``start`` plus the sum of the values before each, of one piece."""
    zero = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
                       lambda s: s["out"])


def with_offsets(df: DataFrame, sizes_col: str, out_col: str) -> DataFrame:
    """Adds for every element of ``sizes_col`` the sum of those before it. An array that grows inside
    ``aggregate`` is copied at every step, so sums are taken in pieces of pieces: the work of a step
    is bounded by ``BLOCK`` however long the array."""
    x = df.withColumn("_p0", _blocks(F.col(sizes_col)))
    for level in range(LEVELS):                        # sums of pieces, of pieces of pieces, ...
        x = x.withColumn(f"_s{level}", F.transform(f"_p{level}", _sum)).withColumn(f"_p{level + 1}", _blocks(F.col(f"_s{level}")))
    top = F.transform(f"_p{LEVELS}", lambda b: F.lit(0).cast("long"))
    if_more = F.flatten(_blocks(_before(F.transform(f"_p{LEVELS}", _sum), F.lit(0).cast("long"))))
    x = x.withColumn("_at", F.when(F.size(f"_p{LEVELS}") > 1, if_more).otherwise(top))
    for level in range(LEVELS, -1, -1):
        x = x.withColumn("_at", F.flatten(F.zip_with(f"_p{level}", "_at", _before)))
    return x.withColumn(out_col, F.col("_at")).select(*df.columns, out_col)


def with_loss_spans(df: DataFrame, formatted_col: str, role: str = "assistant", out_col: str = "loss_spans") -> DataFrame:
    """Adds (start, end) code points of the texts of ``role`` in the string, end exclusive."""
    x = df.withColumn("_parts", F.transform(parts(F.col(formatted_col)), lambda p: F.struct(
        F.length(p).cast("long").alias("size"),
        F.length(F.substring_index(p, "\n", 1)).cast("long").alias("head"),
        (unescape_role(F.substring_index(p, "\n", 1)) == F.lit(role)).alias("hit"))))
    marks = len(START) + len(END) + 1
    x = x.withColumn("_sizes", F.transform("_parts", lambda p: p["size"] + F.lit(marks)))
    x = with_offsets(x, "_sizes", "_offsets")
    spans = F.transform(F.filter(F.arrays_zip(F.col("_parts").alias("p"), F.col("_offsets").alias("at")), lambda z: z["p"]["hit"]),
                        lambda z: F.struct((z["at"] + z["p"]["head"] + F.lit(len(START) + 1)).cast("int").alias("start"),
                                           (z["at"] + z["p"]["size"] + F.lit(len(START))).cast("int").alias("end")))
    return x.withColumn(out_col, spans).select(*df.columns, out_col)


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped, turns (read back), loss_spans.

    Turns follow ``turn``, then role, then text; null turns come first. Null
    role or text: empty. Repeated rows are turns of their own. Null ids form
    one conversation. A conversation is one string, so it must fit in a row.
    Empty table: no rows. A conversation that is not identical after the
    escape fails the job."""
    turns = rows.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    first = convs.withColumn("raw", render(F.col("source")))
    # null-safe: a broken part comes back as a null turn
    first = first.withColumn("escaped", ~parse(F.col("raw")).eqNullSafe(F.col("source")))
    marked = F.transform("source", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    second = first.select("conv_id", "source", "escaped",
                          F.when(F.col("escaped"), render(marked)).otherwise(F.col("raw")).alias("formatted"))
    back = second.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation is not identical after the escape")).cast("string"))
    return with_loss_spans(back.withColumn("formatted", same).drop("source"), "formatted", loss_role)


def chat_digests(rows: DataFrame, loss_role: str = "assistant", **columns: str) -> DataFrame:
    """One row per conversation with digests of what ``format_chats`` gives: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped.

    The text under the loss mask is that of the turns read back whose spans the mask holds; as many
    spans as turns of the role must be there."""
    chats = format_chats(rows, loss_role=loss_role, **columns)
    masked = F.filter("turns", lambda t: t["role"] == F.lit(loss_role))
    loss = F.when(F.size(masked) == F.size("loss_spans"), F.array_join(F.transform(masked, lambda t: t["text"]), "")).otherwise(
        F.raise_error(F.lit("the loss mask does not fit the turns")).cast("string"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (chats.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escaped"))
