"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ROW_KEY, grouped_rank, rows_by_key, text_of, with_row_key
from tabloom.operators.shared import quoted, row_rank, settle

#: Weights of sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document, and so no source, is taken more than this many times its size.
MOST = 3.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(_tl_source, _tl_total, _tl_target) from (_tl_source, _tl_total).

    Sources by code point, null last, get the weights in turn. What all sources hold is
    shared by weight; a source stops at ``most`` times its own size and the excess is
    shared again by weight. The level (words a unit of weight) rises from round to round
    until no further source stops; a round is one aggregate over the sources.
    """
    ranked = row_rank(sizes.withColumn("_tl_last", F.col("_tl_source").isNull().cast("int")), ["_tl_last", "_tl_source"], "_tl_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = settle(ranked.select("_tl_source", "_tl_total", F.get(cycle, (F.col("_tl_rank") % len(weights)).cast("int")).alias("_tl_weight")), "sources")
    stop = F.col("_tl_total") * F.lit(most)
    total = table.agg(F.sum("_tl_total")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        done = stop <= F.lit(level) * F.col("_tl_weight")
        row = table.agg(F.sum(F.when(done, stop)).alias("held"), F.sum(F.when(~done, F.col("_tl_weight"))).alias("open"), F.count_if(done).alias("n")).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (total - (row["held"] or 0.0)) / row["open"]
    return table.withColumn("_tl_target", F.least(stop, F.lit(float(level)) * F.col("_tl_weight")))


def tilts(cells: DataFrame, targets: DataFrame, most: float = MOST, rounds: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """(_tl_source, _tl_tilt): the dual's solution for every source.

    Entropy balancing: rates closest to 1 (in relative entropy) whose words meet the
    target are exp(tilt * size), here at most ``most``. The dual is convex in the tilt, and
    its gradient, words taken less target, never falls. One round is a join of the cells
    (source, size, number of documents) with the sources and one aggregate: gradient and
    curvature by source. The next tilt is Newton's; where it leaves the bracket of tilts
    known to give too little and too much, the bracket is halved, or doubled while one end
    is open. Sizes count in units of the source's mean, so that tilts are of like size.
    """
    mean = cells.groupBy("_tl_source").agg((F.sum(F.col("_tl_size") * F.col("_tl_rows")) / F.sum("_tl_rows")).alias("_tl_mean"))
    state = mean.join(targets, mean["_tl_source"].eqNullSafe(targets["_tl_source"])).where("_tl_mean > 0").select(
        mean["_tl_source"], "_tl_mean", "_tl_target", F.lit(0.0).alias("_tl_tilt"), F.lit(None).cast("double").alias("_tl_low"), F.lit(None).cast("double").alias("_tl_high"),
    )
    state = settle(state, "tilts")
    for _ in range(rounds):
        joined = cells.alias("c").join(state.alias("s"), F.col("c._tl_source").eqNullSafe(F.col("s._tl_source"))).where("_tl_size > 0")
        scaled = F.col("_tl_size") / F.col("_tl_mean")
        raw = F.exp(F.least(F.col("_tl_tilt") * scaled, F.lit(50.0)))
        words = F.col("_tl_rows") * F.col("_tl_size")
        sums = joined.groupBy("s._tl_source").agg(
            *[F.first(c).alias(c) for c in ["_tl_mean", "_tl_target", "_tl_tilt", "_tl_low", "_tl_high"]],
            F.sum(words * F.least(raw, F.lit(most))).alias("_tl_taken"), F.sum(F.when(raw < most, words * scaled * raw).otherwise(0.0)).alias("_tl_curve"),
            F.sum(words).alias("_tl_all"),
        )
        gap = F.col("_tl_taken") - F.col("_tl_target")
        full = F.col("_tl_target") >= F.col("_tl_all") * F.lit(most) * F.lit(1 - tolerance)
        low = F.when(gap < 0, F.col("_tl_tilt")).otherwise(F.col("_tl_low"))
        high = F.when(gap > 0, F.col("_tl_tilt")).otherwise(F.col("_tl_high"))
        steps = sums.withColumns({"_tl_gap": F.when(full, 0.0).otherwise(gap / F.greatest(F.col("_tl_target"), F.lit(1.0))), "_tl_full": full, "_tl_low": low, "_tl_high": high})
        newton = F.when(F.col("_tl_curve") > 0, F.col("_tl_tilt") - gap / F.col("_tl_curve"))
        inside = newton.isNotNull() & (F.col("_tl_low").isNull() | (newton > F.col("_tl_low"))) & (F.col("_tl_high").isNull() | (newton < F.col("_tl_high")))
        other = (
            F.when(F.col("_tl_low").isNotNull() & F.col("_tl_high").isNotNull(), (F.col("_tl_low") + F.col("_tl_high")) / 2)
            .when(F.col("_tl_high").isNull(), F.greatest(F.col("_tl_tilt") * 2, F.lit(1.0))).otherwise(F.least(F.col("_tl_tilt") * 2, F.lit(-1.0)))
        )
        close = F.abs(F.col("_tl_gap")) <= tolerance
        tilt = F.when(F.col("_tl_full"), F.lit(1e6)).when(close, F.col("_tl_tilt")).when(inside, newton).otherwise(other)
        state = settle(steps.select("_tl_source", "_tl_mean", "_tl_target", "_tl_low", "_tl_high", "_tl_gap", tilt.alias("_tl_tilt")), "tilts")
        worst = state.agg(F.max(F.abs("_tl_gap"))).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.select("_tl_source", "_tl_mean", "_tl_tilt")


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST,
    draw: str | None = None,
) -> DataFrame:
    """key, size, source_size, target, taken, copies for every row.

    Rates are rounded into copies twice. A source's cells (documents of one size, whose
    rates are equal) get whole numbers of copies from the longest size down, each making
    up for what the cells before it took too much or too little, so a source ends
    within half of its shortest document of the target (unless the limit of copies binds).
    Within a cell, copies are dealt evenly; the odd ones go to the documents with the lowest
    draw of their key (or of the column ``draw``). Cells of one source are put in an array: they are as many as there
    are different lengths of text, whatever the number of documents.

    Null text: size 0, nothing taken. A null source is a source of its own, last in the
    order. Repeated rows and null keys are rows like any other. A source without words has
    target 0. Empty table: no rows. Extra columns are ignored.
    """
    rows = df.select(quoted(key).alias(key), quoted(source).alias("_tl_source"), word_count(text_of(text)).alias("_tl_size"), F.md5(F.coalesce(quoted(draw or key).cast("string"), F.lit("null:"))).alias("_tl_draw"))
    rows = settle(rows, "sizes")
    cells = settle(rows.groupBy("_tl_source", "_tl_size").agg(F.count(F.lit(1)).alias("_tl_rows")), "cells")
    sizes = cells.groupBy("_tl_source").agg(F.sum(F.col("_tl_size") * F.col("_tl_rows")).alias("_tl_total"))
    targets = source_targets(settle(sizes, "totals"), weights, most)
    solved = tilts(cells, targets, most)
    named = cells.alias("c").join(solved.alias("s"), F.col("c._tl_source").eqNullSafe(F.col("s._tl_source"))).where("_tl_size > 0")
    rate = F.least(F.exp(F.least(F.col("_tl_tilt") * F.col("_tl_size") / F.col("_tl_mean"), F.lit(50.0))), F.lit(most))
    rated = named.select("c._tl_source", F.struct((-F.col("_tl_size")).alias("back"), F.col("_tl_rows").alias("rows"), rate.alias("rate")).alias("cell"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<size:bigint,rows:bigint,copies:bigint>>").alias("out"))

    def deal(state: Column, cell: Column) -> Column:
        size = -cell["back"]
        want = state["carry"] + cell["rows"] * cell["rate"] * size
        copies = F.greatest(F.least(F.round(want / size).cast("long"), (cell["rows"] * F.lit(int(most))).cast("long")), F.lit(0).cast("long"))
        done = F.array(F.struct(size.alias("size"), cell["rows"].alias("rows"), copies.alias("copies")))
        return F.struct((want - copies * size).cast("double").alias("carry"), F.concat(state["out"], done).alias("out"))

    dealt = rated.groupBy("_tl_source").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    dealt = dealt.select("_tl_source", F.explode(F.aggregate("cells", start, deal)["out"]).alias("d"))
    dealt = dealt.select("_tl_source", F.col("d.size").alias("_tl_size"), F.col("d.rows").alias("_tl_rows"), F.col("d.copies").alias("_tl_copies"))
    placed = grouped_rank(rows, ["_tl_source", "_tl_size"], ["_tl_draw"], "_tl_place").alias("p")
    same = F.col("p._tl_source").eqNullSafe(F.col("d._tl_source")) & (F.col("p._tl_size") == F.col("d._tl_size"))
    extra = F.col("_tl_place") < F.col("d._tl_copies") % F.col("d._tl_rows")
    copies = F.coalesce(F.floor(F.col("d._tl_copies") / F.col("d._tl_rows")) + extra.cast("long"), F.lit(0)).cast("long")
    taken = placed.join(dealt.alias("d"), same, "left").select(quoted(key).alias(key), F.col("p._tl_source").alias("_tl_source"), F.col("p._tl_size").alias("size"), copies.alias("copies"))
    out = taken.alias("t").join(targets.alias("g"), F.col("t._tl_source").eqNullSafe(F.col("g._tl_source")))
    return out.select(
        F.col(f"t.`{key}`").alias(key), "size", F.col("_tl_total").alias("source_size"), F.col("_tl_target").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed_documents(df: DataFrame, key: str = "doc_id", **rules) -> DataFrame:
    """The rows of ``df`` with all columns, each as often as the mix takes it."""
    rows = with_row_key(df)
    own = F.struct(*ROW_KEY)
    copies = mix(rows.withColumn("_tl_own", own), "_tl_own", draw=key, **rules)
    total = copies.groupBy(*[F.col(f"_tl_own.{c}").alias(c) for c in ROW_KEY]).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").cast("int").alias("_tl_copies"))
    many = rows_by_key(rows, settle(total.where("_tl_copies > 0"), "copies")).withColumn("_tl_copy", F.explode(F.sequence(F.lit(1), F.col("_tl_copies"))))
    return many.select(*[quoted(c) for c in df.columns])
