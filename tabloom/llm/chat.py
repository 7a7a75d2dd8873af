"""Chat formatting: snapshots of growing conversations collapse to the longest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import grouped_rank
from tabloom.operators.shared import quoted, settle

#: Turns whose running hashes one window sums, and turns of one rendered part.
RUN, PART = 1_024, 64
LANES = ["l0", "l1", "l2", "l3"]


def _lanes(*values: Column) -> list[Column]:
    """128 bits of hash in four columns of 32, whose sums cannot overflow."""
    first, second = F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)
    low = F.lit((1 << 32) - 1)
    return [F.shiftrightunsigned(first, 32), first.bitwiseAND(low), F.shiftrightunsigned(second, 32), second.bitwiseAND(low)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, place, l0..l3) -> the same with the lanes summed over places up to this one.

    A turn's hash depends on its place, so the sum names the sequence, and the hash of a
    longer prefix comes from that of a shorter one by adding one turn. A conversation is
    summed in runs of `RUN` turns, then over its runs: none is one task's work.
    """
    runs = turns.withColumn("run", F.floor(F.col("place") / RUN))
    sums = runs.groupBy("conv", "run").agg(*[F.sum(c).alias(c) for c in LANES])
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv", "run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in LANES]).alias("o")
    inside = Window.partitionBy("conv", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = runs.select("conv", "run", "place", *[F.sum(c).over(inside).alias(c) for c in LANES]).alias("r")
    same = F.col("r.conv").eqNullSafe(F.col("o.conv")) & (F.col("r.run") == F.col("o.run"))
    return running.join(offsets, same).select("r.conv", "place", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in LANES])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv): conversations that are no proper prefix of another; of equal ones the lowest."""
    lengths = prefixes.groupBy("conv").agg((F.max("place") + 1).alias("n"))
    sized = prefixes.alias("p").join(lengths.alias("n"), F.col("p.conv").eqNullSafe(F.col("n.conv"))).select("p.conv", (F.col("place") + 1).alias("length"), *LANES, "n")
    sign = ["length", *LANES]
    inner = sized.where("length < n").select(*sign).distinct()
    ends = sized.where("length = n").select("conv", *sign)
    return ends.join(inner, sign, "left_anti").groupBy(*sign).agg(F.min("conv").alias("conv")).select("conv")


def collapse(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART, end: str = "<|end|>"
) -> DataFrame:
    """conv_id, part, n_turns, rendered: the maximal conversations, rendered.

    A logged conversation that is the beginning of a longer one is a snapshot of it and goes;
    of equal conversations the one with the lowest id stays. What stays is rendered as
    <|role|>, line feed, text, ``end``, line feed for each turn, in parts of at most ``part``
    turns, which joined in order are the conversation.

    Turns are in the order of turn (null first), then role, then a hash of the text.
    Repeated rows of one turn count once. A null role is rendered as unknown, a null text as
    empty; both count as different from "unknown" and "" when conversations are
    compared. A null conversation id is a conversation of its own. Extra columns are ignored;
    an empty table gives no rows. A conversation with a third of all rows is ranked and
    summed in pieces; first turns that many conversations share are combined in
    the tasks before they move.
    """
    base = df.select(quoted(conv).alias("conv"), quoted(turn).alias("turn"), quoted(role).cast("string").alias("role"), quoted(text).cast("string").alias("text"))
    known = base.withColumns({"h1": F.xxhash64("role", "text", F.col("role").isNull(), F.col("text").isNull()), "h2": F.xxhash64(F.lit("b"), "role", "text", F.col("role").isNull(), F.col("text").isNull())})
    narrow = known.select("conv", "turn", "role", "h1", "h2").distinct()
    ranked = settle(grouped_rank(narrow, ["conv"], ["turn", "role", "h1", "h2"], "place"), "turns")
    lanes = {name: lane for name, lane in zip(LANES, _lanes(F.col("place"), F.col("h1"), F.col("h2")), strict=True)}
    kept = settle(maximal(settle(prefix_hashes(ranked.select("conv", "place", "h1", "h2").withColumns(lanes).drop("h1", "h2")), "prefixes")), "kept")
    left = ranked.alias("t").join(kept.alias("k"), F.col("t.conv").eqNullSafe(F.col("k.conv")), "left_semi").alias("t")
    keys = ["conv", "turn", "role", "h1", "h2"]
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}"))
    texts = known.alias("a").join(left, same).select("a.conv", F.floor(F.col("t.place") / part).cast("int").alias("part"), "t.place", "a.role", "a.text")
    lines = F.sort_array(F.collect_set(F.struct("place", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    groups = texts.groupBy("conv", "part").agg(lines.alias("lines"))
    shown = F.array_join(F.transform("lines", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(f"{end}\n"))), "")
    return groups.select(F.col("conv").alias(conv), "part", F.size("lines").cast("long").alias("n_turns"), shown.alias("rendered"))
