"""Chat formatting into budgeted windows, by DataFrame operations alone.

A turn is written ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and
a newline. Inside roles and texts every ``<|`` becomes ``<||``, so no text can
hold a control string, and the inverse is exact.

Prefix sums cut a conversation into windows at turns. A turn of more than
``SPAN`` tokens is a window of its own; other turns belong together if no such
turn lies between them and the tokens before them agree div ``SPAN``, so the
own turns of a window have less than 2 ``SPAN`` tokens. A window repeats the
system turn (the first one, if it is of that role) and at most ``HISTORY``
turns before it, as far as they fit into ``HISTORY_TOKENS``. With the defaults
a window keeps to ``BUDGET`` tokens. Turns are never cut and the system turn is
in every window, so beyond the budget lie only windows of a turn over 2
``SPAN`` or a system turn over ``SYSTEM_TOKENS``, by what these have too much.
A token is four characters, and a turn has four more. Only a window's own
assistant turns are under the loss mask, so repeated targets are masked and
each is learned once.

Long conversations are numbered in sections of ``SECTION`` turn numbers, so a
huge one is spread over tasks until its windows are joined at the end; windows
and history depend on the order of turns alone and cross sections. ``digest``
puts a whole conversation into one row, as a digest of it must; ``windows`` does
not, and no window holds more than its budget or its one long turn.

Turns are ordered by turn number (null last), then role, then text; null roles
and texts are empty; repeated rows are turns of their own; the null conversation
is a conversation; an empty table gives an empty table. Other columns are
dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The tokens of a window: its own turns (twice SPAN), the turns before it, the system turn.
SPAN, HISTORY, HISTORY_TOKENS, SYSTEM_TOKENS, SECTION = 256, 2, 256, 256, 64
BUDGET = 2 * SPAN + HISTORY_TOKENS + SYSTEM_TOKENS


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss) records.

    ``window`` is the place of the window's first own turn, from 1.
    ``repeated`` is the number of leading turns that were seen before;
    ``loss`` holds the start and length, in code points from 0, of the stretches
    of ``formatted`` that are learned.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn, conv = F.col("turn").cast("long"), F.col("conv_id")
    df = turns.select(
        "conv_id", conv.isNull().alias("_none"), F.coalesce(conv.cast("string"), F.lit("")).alias("_key"),
        turn.isNull().alias("_last"), F.coalesce(turn, F.lit(0)).alias("turn"), F.coalesce(F.floor(turn / SECTION), F.lit(2**60)).alias("section"), role.alias("role"), text.alias("_raw"),
    )
    key, order = ["_none", "_key"], ["_last", "turn", "role", "_raw"]
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    shown = F.concat(head, escape(F.col("_raw")), F.lit(END + "\n"))
    first = df.groupBy("conv_id").agg(F.min(F.struct(*order)).alias("_first"))
    system = first.filter("_first.role = 'system'").select(F.col("conv_id").alias("_conv"), F.col("_first.role").alias("role"), F.col("_first._raw").alias("_raw")).select("_conv", shown.alias("_system"))
    # places and prefix sums (of tokens and of long turns) within sections, then those of the sections
    rows = Window.partitionBy(*key, "section").orderBy(*order)
    df = df.withColumn("_tokens", (F.char_length(escape(F.col("_raw"))) / 4).cast("long") + 4).withColumn("_long", (F.col("_tokens") > span).cast("long"))
    at = F.struct(F.coalesce(F.sum("_tokens").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("_long").over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("longs"), F.col("_long").alias("long"))
    df = df.withColumns({"_pos": F.row_number().over(rows), "_at": at})
    df = df.withColumns({f"_lead{k}": F.lead("_at", k).over(rows) for k in range(1, history + 1)})
    along = Window.partitionBy(*key).orderBy("section")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, max(1, history))
    parts = df.groupBy(*key, "section").agg(F.struct(F.sum("_tokens").alias("before"), F.sum("_long").alias("longs")).alias("_sum"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_pos") <= history, F.struct("_pos", "_at")))).alias("_starts"))
    parts = parts.withColumns({"_place": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_offset": F.struct(*(F.coalesce(F.sum(f"_sum.{c}").over(earlier), F.lit(0)).alias(c) for c in ("before", "longs")))})

    def moved(x: Column) -> Column:
        return F.struct((x["before"] + F.col("_offset.before")).alias("before"), (x["longs"] + F.col("_offset.longs")).alias("longs"), x["long"].alias("long"))

    # the places of the turns that follow a section, in whichever sections these are
    parts = parts.withColumn("_starts", F.transform("_starts", lambda t: moved(t["_at"]))).withColumn("_after", F.flatten(F.collect_list("_starts").over(later)))
    df = df.join(parts.select(*key, "section", "_n", "_offset", "_place", "_after"), [*key, "section"])
    next_at = [F.coalesce(F.when(F.col(f"_lead{k}").isNotNull(), moved(F.col(f"_lead{k}"))), F.get("_after", (F.lit(k - 1) - F.col("_n") + F.col("_pos")).cast("int"))).alias(f"_at{k}") for k in range(1, history + 1)]
    df = df.select("conv_id", "role", "_raw", (F.col("_place") + F.col("_pos")).alias("_pos"), moved(F.col("_at")).alias("_at0"), *next_at)
    # long turns and the turns between them, these by the tokens before them
    window_of = lambda x: F.struct(x["longs"].alias("longs"), (1 - x["long"]).alias("rest"), F.when(x["long"] == 0, F.floor(x["before"] / span)).alias("span"))
    at = [F.col(f"_at{k}") for k in range(history + 1)]
    into = [F.struct(window_of(at[0]).alias("w"), F.lit(1).alias("own"))]
    for nearer, a in zip(at, at[1:], strict=False):
        w = window_of(a)
        into.append(F.when(a.isNotNull() & ~w.eqNullSafe(window_of(nearer)) & (a["before"] - at[0]["before"] <= history_tokens), F.struct(w.alias("w"), F.lit(0).alias("own"))))
    df = df.select("conv_id", "role", "_raw", "_pos", F.explode(F.array_compact(F.array(*into))).alias("_to")).withColumns({"_w": F.col("_to.w"), "_own": F.col("_to.own")}).drop("_to")
    within = Window.partitionBy("conv_id", "_w").orderBy("_own", "_pos")
    df = df.withColumn("_start", F.coalesce(F.sum(F.char_length(shown)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.char_length(head))
    learned = (F.col("_own") == 1) & (F.col("role") == "assistant")
    packed = df.groupBy("conv_id", "_w").agg(
        F.min(F.when(F.col("_own") == 1, F.col("_pos"))).alias("window"),
        F.array_sort(F.collect_list(F.struct("_own", "_pos", shown.alias("_shown")))).alias("_turns"),
        F.array_sort(F.collect_list(F.when(learned, F.struct(F.col("_start").alias("start"), F.char_length(escape(F.col("_raw"))).cast("long").alias("length"))))).alias("_loss"),
    )
    packed = packed.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    joined = F.array_join(F.transform("_turns", lambda t: t["_shown"]), "")
    # the system turn stands in its own window already, and may be there as history
    there = F.exists("_turns", lambda t: t["_shown"] == F.col("_system"))
    add = F.col("_system").isNotNull() & ~there
    shift = F.when(add, F.char_length("_system")).otherwise(0)
    return packed.select(
        "conv_id", "window", F.concat(F.when(add, F.col("_system")).otherwise(""), joined).alias("formatted"),
        (F.size(F.filter("_turns", lambda t: t["_own"] == 0)) + F.when(add, 1).otherwise(0)).alias("repeated"),
        F.transform("_loss", lambda s: F.struct((s["start"] + shift).alias("start"), s["length"].alias("length"))).alias("loss"),
    )


def turns_of(records: DataFrame) -> DataFrame:
    """Reads windows back: adds ``turns``, the own turns of each as (role, text), and ``learned``, the texts under the mask."""
    end = r"\Q" + END + "\n" + r"\E"
    parts = F.split("formatted", end, -1)
    own = F.slice(parts, F.col("repeated") + 1, F.size(parts) - 1 - F.col("repeated"))
    body = lambda t: F.substring(t, len(START) + 1, 2**31 - 1)
    turn = F.transform(own, lambda t: F.struct(_role_in(F.substring_index(body(t), "\n", 1)).alias("role"), unescape(F.substr(t, F.instr(t, F.lit("\n")) + 1)).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return records.withColumns({"turns": turn, "learned": learned})


def digest(turns: DataFrame, **options) -> DataFrame:
    """One row per conversation, read back from its windows."""
    back = turns_of(windows(turns, **options))
    per = back.select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), F.char_length("formatted").cast("long").alias("size"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("body"), F.array_join("learned", "").alias("lost"),
    )
    whole = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "body", "lost"))).alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    whole = whole.withColumns({"body": joined("body"), "lost": joined("lost")})
    return whole.select("conv_id", "n_turns", F.sha2(F.col("body").cast("binary"), 256).alias("turns_sha256"), F.char_length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
