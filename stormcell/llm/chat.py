"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns get prefix sums of their tokens.  They choose
turn-aligned spans: a window takes new turns while they fit into what the
budget leaves beside the system turn and the history.  Every window begins with
the system turn, repeats the last few turns before it as far as the history's
share allows, and then has its new turns.  Loss falls on the assistant texts
among the new turns only, so that each is a target once.

Prefix sums are made in blocks of turns and the spans are chosen inside
segments of ``SEGMENT`` budgets, so a conversation of any length is spread over
many tasks and no array holds more than a segment.  A turn is never cut: one
that is longer than the budget has a window of its own.

The template marks a turn as ``<|role|>`` newline text ``<|end|>`` newline.
Texts and roles can't hold a mark: ``&``, ``<`` and ``[`` are written as
entities, and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_SHARE = 0.25
BLOCK = 256
SEGMENT = 16
END = "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("|", "&#124;"))  # a role also ends at a mark's bar


def escape(c: Column, pairs=ESCAPES) -> Column:
    for raw, safe in pairs:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role, ROLE_ESCAPES), F.lit("|>\n"), escape(text), F.lit(END))


def _render(t: Column) -> Column:
    return _turn(t["role"], t["text"])


def about_tokens(text: Column, role: Column | None = None) -> Column:
    """An estimate for Latin script: a token for every three bytes, and four for the
    marks.  Texts of other scripts can have more."""
    return F.ceil(F.octet_length(text) / F.lit(3)).cast("long") + 4


def most_tokens(text: Column, role: Column) -> Column:
    """A bound: the bytes of the turn as it is written, as no token of a byte-level
    vocabulary has less than one."""
    return F.octet_length(_turn(role, text)).cast("long")


def numbered(turns: DataFrame, tokens=most_tokens) -> DataFrame:
    """(conv_id, idx, start, n, role, text): the turn's place, the tokens before
    it and its own.  Order: turn (nulls last), role, text.

    ``tokens`` gives a turn's tokens from its text and role, or is the name of a
    column of ``turns`` that has them (null: the bound of ``most_tokens``)."""
    count = F.col(f"`{tokens}`").cast("long") if isinstance(tokens, str) else F.lit(None).cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), count.alias("n"))
    of = most_tokens if isinstance(tokens, str) else tokens
    rows = (rows.withColumn("n", F.coalesce("n", of(F.col("text"), F.col("role"))))
            .withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(2**62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(
        F.asc_nulls_last("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("idx", F.count(F.lit(1)).over(inside))
            .withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows.groupBy("conv_id", "block").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
            .select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
                    F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c"),
                    F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s")))
    return (rows.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv"))
                      & (F.col("block") == F.col("_block")))
            .select("conv_id", (F.col("idx") + F.col("_c")).alias("idx"),
                    (F.col("start") + F.col("_s")).alias("start"), "n", "role", "text"))


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
            history_share: float = HISTORY_SHARE, tokens=most_tokens) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss): a row per window.

    ``window`` is the place of its first new turn, ``repeated`` the number of
    leading turns that earlier windows have already had, ``loss`` an array of
    (start, length) in code points of ``formatted``.  Null texts and roles are
    empty; turns without conv_id are one conversation; repeated rows are turns.

    ``tokens`` as in :func:`numbered`.  With counts that bound the written turns, as
    by default, a window of several new turns, or of one that fits, has at most
    ``budget`` tokens.
    """
    history = int(budget * history_share)
    rows = numbered(turns, tokens)
    system = (rows.where((F.col("idx") == 0) & (F.col("role") == "system"))
              .select(F.col("conv_id").alias("_conv"), F.col("n").alias("sys_n"),
                      F.struct("idx", "start", "n", "role", "text").alias("sys")))
    rows = (rows.join(system.drop("sys"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .withColumn("room", F.greatest(F.lit(1), budget - history
                                           - F.coalesce("sys_n", F.lit(0))))
            .withColumn("segment", F.expr(f"start div (room * {SEGMENT})")))
    segments = (rows.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("idx", "start", "n", "role", "text"))).alias("turns"),
        F.first("room").alias("room")))
    # the first turn of every span: a turn opens one when it does not fit any more
    zero = F.struct(F.array().cast("array<bigint>").alias("firsts"), F.lit(0).cast("long").alias("used"))

    def take(state, turn):
        new = (F.size(state["firsts"]) == 0) | (state["used"] + turn["n"] > F.col("room"))
        return F.struct(
            F.when(new, F.concat(state["firsts"], F.array(turn["idx"]))).otherwise(state["firsts"])
            .alias("firsts"),
            F.when(new, turn["n"]).otherwise(state["used"] + turn["n"]).alias("used"))

    order = Window.partitionBy("conv_id").orderBy("segment")
    keep = max(1, history_turns)
    spans = (segments
             .withColumn("firsts", F.aggregate("turns", zero, take, lambda s: s["firsts"]))
             .withColumn("tail", F.lag(F.slice("turns", F.greatest(F.lit(1), F.size("turns") - keep + 1),
                                               keep)).over(order))
             .withColumn("tail", F.coalesce("tail", F.slice("turns", 1, 0)))
             .select("conv_id", "turns", "firsts", "tail", F.posexplode("firsts").alias("k", "window"))
             .withColumn("at", (F.col("window") - F.col("turns")[0]["idx"]).cast("int"))
             .withColumn("upto", F.coalesce(F.get("firsts", F.col("k") + 1) - F.col("turns")[0]["idx"],
                                            F.size("turns")).cast("int"))
             .withColumn("new", F.slice("turns", F.col("at") + 1, F.col("upto") - F.col("at")))
             .withColumn("past", F.concat("tail", F.slice("turns", F.lit(1), F.col("at")))))
    spans = (spans.join(system.drop("sys_n"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
             .withColumn("lead", F.when((F.col("window") > 0) & F.col("sys").isNotNull(), F.array("sys"))
                         .otherwise(F.slice("turns", 1, 0)))
             .withColumn("past", F.filter("past", lambda t: (
                 (t["idx"] >= F.col("window") - history_turns)
                 & (F.col("new")[0]["start"] - t["start"] <= history)
                 & (F.col("sys").isNull() | (t["idx"] > 0)))))
             .withColumn("before", F.concat("lead", "past")))
    spans = spans.select("conv_id", "window", F.size("before").alias("repeated"), "new",
                         F.array_join(F.transform("before", _render), "").alias("head"))
    none = F.struct(F.char_length("head").cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def mask(state, turn):
        start = state["at"] + F.char_length(escape(turn["role"], ROLE_ESCAPES)) + 5
        length = F.char_length(escape(turn["text"])).cast("long")
        span = F.struct(start.alias("start"), length.alias("length"))
        return F.struct(
            (start + length + len(END)).alias("at"),
            F.when(turn["role"] == "assistant", F.concat(state["loss"], F.array(span)))
            .otherwise(state["loss"]).alias("loss"))

    return spans.select(
        "conv_id", "window", "repeated",
        F.concat("head", F.array_join(F.transform("new", _render), "")).alias("formatted"),
        F.aggregate("new", none, mask, lambda s: s["loss"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets): new turns (role, text) and loss texts
    of each window, parsed from its text, mark by mark; a row per row of
    ``formatted``, whose other columns are left out."""
    parts = F.split("formatted", r"<\|end\|>\n")
    new = F.slice(parts, F.col("repeated") + 1, F.size(parts) - 1 - F.col("repeated"))

    def parse(p):
        cut = F.locate("|>\n", p)
        return F.struct(unescape(p.substr(F.lit(3), cut - 3), ROLE_ESCAPES).alias("role"),
                        unescape(p.substr(cut + 3, F.char_length(p))).alias("text"))

    targets = F.transform("loss", lambda s: unescape(
        F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(
        "conv_id", "window", F.char_length("formatted").cast("long").alias("chars"),
        F.transform(new, parse).alias("turns"), targets.alias("targets"))


def digests(read: DataFrame) -> DataFrame:
    """A row per conversation (null conv_id is one): its turns and targets, hashed in
    order of the windows.  A conversation's text is gathered in one row."""
    rows = read.select(
        "conv_id", "window", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("body"),
        F.array_join("targets", "").alias("loss"))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "body", "loss"))).alias("w"),
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sum(F.char_length("loss")).alias("loss_chars"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"),
        F.sha2(F.array_join("w.body", ""), 256).alias("turns_sha256"),
        F.col("loss_chars").cast("long"),
        F.sha2(F.array_join("w.loss", ""), 256).alias("loss_sha256"), "formatted_chars")


def injected(turns: DataFrame, conv_id: int = -1) -> DataFrame:
    """``turns`` and a conversation whose texts are full of control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame(
        [(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)],
        "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").union(extra)
