"""Conversations as budgeted training windows, and back. Column functions only.

The running token count before a turn puts it into a cell of NEW tokens; the turn that crosses the end
of its cell is a window of its own, the others of the cell form one window. So windows hold whole turns
in order, none has more than NEW fresh tokens unless a single turn has, and no scan over turns is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, HISTORY = 384, 128
MARKS = 4
# The marks of the template.
START, STOP = "<|im_start|>", "<|im_end|>"
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}]"


def escaped(text: Column) -> Column:
    """No mark can be read from the result: a backslash is doubled and ``<|`` gets one in between."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def chat_windows(turns: DataFrame, new: int = NEW, history: int = HISTORY) -> DataFrame:
    """conv_id, window_no, text, n_tokens, n_context, loss of every training window.

    ``turns`` has conv_id, turn, role, text (other columns are ignored). Turns are taken by (turn, role, text);
    repeated rows are turns of their own; null roles and texts are empty, null conv_ids are one conversation.
    A window shows the system turn (if the conversation opens with one), then whole earlier turns of at most
    ``history`` tokens, then its fresh turns. ``n_context`` counts the turns before the fresh ones; ``loss`` has the
    (start, size) in code points of the fresh assistant texts: a repeated target is never trained twice.
    """
    if not 0 <= history < new:
        raise ValueError("history must be smaller than a window's fresh tokens")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("size", (F.regexp_count("text", F.lit(TOKEN)) + F.lit(MARKS)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("*", F.row_number().over(order).alias("pos"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    cell = F.floor(F.col("before") / new)
    crosses = (F.floor((F.col("before") + F.col("size") - 1) / new) > cell).cast("long")
    piece = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(STOP + "\n"))
    rows = rows.select(
        "conv_id", "pos", "before", "size", (2 * cell + crosses).alias("window_no"), ((F.col("pos") == 1) & (F.col("role") == "system")).alias("opens"),
        (F.col("role") == "assistant").alias("target"), F.length(_escaped_role(F.col("role"))).alias("lead"), piece.alias("piece"),
    )
    fresh = rows.select("conv_id", "window_no", "pos", "piece", "size", F.lit(True).alias("fresh"), "target", "lead")
    heads = rows.groupBy("conv_id", "window_no").agg(F.min("before").alias("from"), F.min("pos").alias("first")).withColumnsRenamed({"conv_id": "c", "window_no": "w"})

    after, reach = F.col("before") + F.col("size"), F.col("before") + F.lit(history)
    near = rows.where(~F.col("opens") & (F.col("size") <= history)).withColumn("k", F.explode(F.sequence(2 * F.floor(after / new), 2 * F.floor(reach / new) + 1)))
    told = near.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("w"))).where((F.col("from") >= after) & (F.col("from") <= reach))
    told = told.select("conv_id", F.col("w").alias("window_no"), "pos", "piece", "size", F.lit(False).alias("fresh"), "target", "lead")
    system = rows.where("opens").join(heads.where("first > 1"), F.col("conv_id").eqNullSafe(F.col("c")))
    system = system.select("conv_id", F.col("w").alias("window_no"), "pos", "piece", "size", F.lit(False).alias("fresh"), "target", "lead")

    packed = fresh.unionByName(told).unionByName(system).groupBy("conv_id", "window_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece", "size", "fresh", "target", "lead"))).alias("parts")
    )
    skip = len(START) + 1
    trail = len(STOP) + 1
    span = f"named_struct('start', s.at + {skip} + x.lead, 'size', length(x.piece) - {skip + trail} - x.lead)"
    loss = f"""aggregate(parts, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,size:int>>)),
      (s, x) -> named_struct('at', s.at + length(x.piece), 'spans', if(x.fresh and x.target, array_append(s.spans, {span}), s.spans)), s -> s.spans)"""
    return packed.select(
        "conv_id", "window_no", F.array_join("parts.piece", "").alias("text"), F.expr("aggregate(parts.size, 0L, (t, x) -> t + x)").alias("n_tokens"),
        F.expr("size(filter(parts, x -> not x.fresh))").alias("n_context"), F.expr(loss).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window_no, turns (role, text), targets: the fresh turns and trained texts, from the text alone."""
    parts = F.slice(F.split("text", r"<\|im_start\|>"), F.col("n_context") + 2, F.greatest(F.size(F.split("text", r"<\|im_start\|>")), F.lit(1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - len(STOP) - 2)
        return F.struct(_unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["size"])))
    return windows.select("conv_id", "window_no", F.transform(parts, turn).alias("turns"), targets.alias("targets"), F.length("text").alias("n_chars"))


def chat_digests(read: DataFrame) -> DataFrame:
    """One row per conversation over what was read back from its windows."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", F.struct("window_no", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("turns").alias("n"), "n_chars")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("n").cast("long").alias("n_turns"), F.sum("n_chars").cast("long").alias("formatted_chars"))
    loss = F.array_join("ws.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("ws.said", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )
