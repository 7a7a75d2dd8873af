"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.shared import quoted, settle

#: White space between words; everything else belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    return F.array_remove(F.split(text, BLANKS), "")


#: Two hashes of a text, by which rows find what depends on nothing but their text.
TEXT_KEY = ["_tl_text_a", "_tl_text_b"]
#: Two hashes of a whole row.
ROW_KEY = ["_tl_row_a", "_tl_row_b"]


def _two_hashes(names: list[str], *values: Column) -> list[Column]:
    return [F.xxhash64(*values).alias(names[0]), F.xxhash64(F.lit("second"), *values).alias(names[1])]


def text_hashes(text: Column) -> list[Column]:
    return _two_hashes(TEXT_KEY, text)


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds hashes of the row's content. Unlike a row number they are the same whenever the
    plan runs again, whatever its partitions; rows that are equal in all columns share them."""
    values = [part for c in df.columns for part in (quoted(c), quoted(c).isNull())]
    return df.withColumns(dict(zip(ROW_KEY, _two_hashes(ROW_KEY, *values), strict=True)))


def rows_by_key(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that have a row key joined to ``found`` (row key, n, ...), each key's row once.

    ``n`` is how many rows of the input have the key. Only if some have several are
    rows with equal keys made one.
    """
    joined = rows.join(found, ROW_KEY)
    if found.where("n > 1").limit(1).count():
        joined = joined.dropDuplicates(ROW_KEY)
    return joined


def shingle_hashes(words: Column, n: Column, width: int) -> Column:
    """One 64-bit hash per run of ``width`` words, in order; empty with fewer words.

    ``words`` and ``n`` (their number) should be columns of the input, not expressions.
    """
    count = F.greatest(n - F.lit(width - 1), F.lit(0))
    parts = [F.slice(words, F.lit(i + 1), count).alias(f"w{i}") for i in range(width)]
    return F.transform(F.arrays_zip(*parts), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(width)]))


def grouped_rank(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of every row within its group, whatever the size of a group.

    Rows are dealt into ranges of (groups, order) and written; ranks within a range are
    shifted by the group's rows in lower ranges. A group longer than a range simply spans
    several. Equal rows are told apart by their place in the input, so that copies of one
    row do not share a range; which of them gets which rank is open.
    """
    keys = [quoted(c) for c in [*groups, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_tl_row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(parts, *keys, F.col("_tl_row")).withColumn("_tl_range", F.spark_partition_id())
    ranged = settle(ranged, "ranked")
    by = [quoted(c) for c in groups]
    counts = ranged.groupBy("_tl_range", *by).agg(F.count(F.lit(1)).alias("_tl_rows"))
    before = Window.partitionBy(*by).orderBy("_tl_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_tl_range", *by, F.coalesce(F.sum("_tl_rows").over(before), F.lit(0)).alias("_tl_before"))
    inside = Window.partitionBy("_tl_range", *by).orderBy(*[quoted(c) for c in order], "_tl_row")
    ranked = ranged.withColumn("_tl_place", F.row_number().over(inside)).alias("a")
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in groups]
    on = F.col("a._tl_range") == F.col("b._tl_range")
    for condition in same:
        on = on & condition
    kept = [F.col(f"a.`{c}`").alias(c) for c in df.columns]
    return ranked.join(offsets.alias("b"), on).select(*kept, (F.col("a._tl_place") - 1 + F.col("b._tl_before")).alias(name))
