"""SimHash near copies by multi-index hashing: Hamming balls within segments, exact distances."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_of
from tabloom.operators.graph import connect
from tabloom.operators.shared import quoted, settle, settle_counted

BITS, SEED = 64, 42
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Entries of a cell; larger buckets are cut into cells of pairs of blocks.
BLOCK = 4_096
#: What an entry costs to shuffle, in comparisons of fingerprints.
ENTRY_COST = 200
#: Entries a task compares at the least, when there are many.
TASK_ENTRIES = 1_000_000


def shingle_hashes(text: bytes, width: int = 4) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included.

    A to Z are lower-cased, words are joined by one space. With fewer words the whole
    sequence is one shingle; without words there is none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = min(width, len(words))
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)


def _bit_counts(hashes: list[np.ndarray]) -> np.ndarray:
    """How often each bit is set in each of some arrays, none of them empty."""
    starts = np.cumsum([0, *map(len, hashes[:-1])])
    bits = np.unpackbits(np.concatenate(hashes).view(np.uint8), bitorder="little").reshape(-1, BITS)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(df: DataFrame, key: Column, text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp) for every row: the 64 bits that over half of the text's shingle hashes have.

    Null, empty and blank texts: zero. Bits are counted in chunks, so a very long text takes
    memory for its words and hashes only.
    """
    rows = df.select(key.alias("key"), text_of(text).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, totals = np.zeros((batch.num_rows, BITS), np.int64), np.zeros(batch.num_rows, np.int64)
            held, owners, size = [], [], 0
            for i, value in enumerate(batch.column(1)):
                hashes = shingle_hashes(value.as_py(), width)
                totals[i] = len(hashes)
                for start in range(0, len(hashes), CHUNK):
                    held.append(hashes[start : start + CHUNK])
                    owners.append(i)
                    size += len(held[-1])
                    if size >= CHUNK:
                        np.add.at(counts, owners, _bit_counts(held))
                        held, owners, size = [], [], 0
            if held:
                np.add.at(counts, owners, _bit_counts(held))
            prints = np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["key", "fp"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, fp long")


def layout(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment of a fingerprint.

    Two fingerprints at ``distance`` or less differ, in one segment at least, by no more
    than that segment's radius: if all exceeded it, the distances would add up to more.
    """
    radius, rest = divmod(distance, segments)
    out, shift = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        out.append((shift, width, radius if i <= rest else radius - 1))
        shift += width
    return [s for s in out if s[2] >= 0]


def _ball(width: int, radius: int) -> list[int]:
    """Differences of up to ``radius`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def segments_by_cost(prints: int, distance: int) -> int:
    """The number of segments that costs least, for so many different fingerprints.

    Many short segments need few entries but fill their buckets; few long ones need large
    balls. Any number gives the same links.
    """

    def cost(segments: int) -> float:
        total = 0.0
        for _, width, radius in layout(segments, distance):
            entries = 1 + sum(math.comb(width, r) for r in range(1, radius + 1)) / 2
            total += entries * (ENTRY_COST + prints / 2.0**width)
        return total

    return min(range(max(2, distance // 2), distance + 2), key=cost)


def _entries(prints: DataFrame, segments: int, distance: int) -> DataFrame:
    """(cell, fp, own): each fingerprint in the bucket of each of its segments, and as a
    visitor in those near by, of higher value; of two neighbours the lower visits the higher."""

    def of_segment(i: int, shift: int, width: int, radius: int) -> Column:
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        ball = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        keys = F.filter(F.transform(ball, lambda m: m.bitwiseXOR(own)), lambda k: k >= own)
        return F.transform(keys, lambda k: F.struct(k.bitwiseOR(F.lit(i << 58)).alias("cell"), (k == own).alias("own")))

    parts = [of_segment(i, *segment) for i, segment in enumerate(layout(segments, distance))]
    return prints.select("fp", F.explode(F.concat(*parts)).alias("e")).select("e.cell", "fp", "e.own")


def _cells(entries: DataFrame, block: int) -> DataFrame:
    """(cell, fp, own): as they are, but buckets of over ``block`` entries in pairs of blocks.

    In a pair of blocks the first one's owners are compared with all of the second.
    """
    counts = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owners"))
    hot, n_hot = settle_counted(counts.where((F.col("n") > block) & (F.col("owners") > 0)).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    if not n_hot:
        return entries
    marked = entries.join(hot, "cell", "left")
    cut = marked.where("blocks is not null").withColumn("at", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Owners are first in pairs with every block; as second they need only meet lower or equal ones.
    first = cut.where("own").select("cell", "fp", "own", F.col("at").alias("i"), F.explode(every).alias("j"))
    lower = F.when(F.col("own"), F.sequence(F.lit(0), F.col("at"))).otherwise(every)
    second = cut.select("cell", "fp", F.lit(False).alias("own"), F.explode(lower).alias("i"), F.col("at").alias("j"))
    paired = first.where("i <> j").unionByName(second.where("i <> j")).unionByName(cut.select("cell", "fp", "own", F.col("at").alias("i"), F.col("at").alias("j")))
    return marked.where("blocks is null").select("cell", "fp", "own").unionByName(paired.select(F.xxhash64("cell", "i", "j").alias("cell"), "fp", "own"))


def forest(own: np.ndarray, visitors: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what pairs with an owner at ``distance`` or less connect.

    A fingerprint found leaves the search, so there are fewer links than fingerprints.
    Both are unsigned: numpy counts the bits of a negative number's absolute value.
    """
    links, own, visitors = [], np.unique(own), np.unique(visitors)
    while len(own):
        todo, own = [(own[0], True)], own[1:]
        while todo and (len(own) or len(visitors)):
            x, owner = todo.pop()
            near = np.bitwise_count(own ^ x) <= distance
            if near.any():
                links += [(int(x), int(y)) for y in own[near]]
                todo += [(y, True) for y in own[near]]
                own = own[~near]
            if owner and len(visitors):
                near = np.bitwise_count(visitors ^ x) <= distance
                if near.any():
                    links += [(int(x), int(y)) for y in visitors[near]]
                    todo += [(y, False) for y in visitors[near]]
                    visitors = visitors[~near]
    return links


def _links(distance: int):
    """Links of each cell; rows come sorted by cell."""

    def of_cells(cells: np.ndarray, prints: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        ends = np.append(starts[1:], len(cells))
        some = (ends - starts > 1) & (np.add.reduceat(own, starts, dtype=np.int64) > 0)
        links = []
        for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            mine = own[a:b]
            links += forest(prints[a:b][mine], prints[a:b][~mine], distance)
        found = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        found = found[found[:, 0] != found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
        for batch in batches:
            held = [np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False).view(old.dtype)]) for i, old in enumerate(held)]
            if len(held[0]):
                # The last cell may go on in the next batch.
                whole = int(np.searchsorted(held[0], held[0][-1]))
                if whole:
                    yield of_cells(*[h[:whole] for h in held])
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield of_cells(*held)

    return work


def links(prints: DataFrame, distance: int = 4, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints (fp) that connect all that
    pairs at ``distance`` or less connect. Links may repeat; not every pair is one."""
    if segments is None:
        segments = segments_by_cost(prints.count(), distance)
    cells = _cells(_entries(prints, segments, distance), block)
    entries = sum(1 + sum(math.comb(w, r) for r in range(1, radius + 1)) // 2 for _, w, radius in layout(segments, distance))
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() * entries // TASK_ENTRIES)
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_links(distance), "a long, b long")


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """key, fingerprint, component_id for every row of ``df``.

    Fingerprints of ``width``-word shingles (`fingerprints`) link at ``distance`` or fewer
    differing bits; a component is what links reach, named by its smallest key.

    Equal fingerprints are one. Each is put into the bucket of each of its segments and looked
    up in the buckets of the Hamming ball around it; within a bucket whole distances decide. Of
    a bucket's links a spanning forest is kept, so groups of near copies never become all their
    pairs, and large buckets are cut into pairs of blocks that any task can hold.

    Null, empty and blank texts have fingerprint zero and link like others. Null keys: rows
    like others, never the name of a component unless all its keys are null. Repeated rows
    and keys: each row is returned. Very long texts are hashed whole. Extra columns are
    ignored. Empty table: no rows.
    """
    prints = settle(fingerprints(df, quoted(key), text, width), "prints")
    lowest = settle(prints.groupBy("fp").agg(F.min("key").alias("low")), "lowest")
    labels = settle(connect(links(lowest.select("fp"), distance, segments, block)), "labels")
    nodes = labels.select(F.col("node").alias("fp"), "component").join(lowest, "fp")
    names = nodes.groupBy("component").agg(F.min("low").alias("name"))
    named = nodes.join(names, "component").select("fp", "name")
    # Where all keys of a component are null, so is its name.
    final = settle(lowest.join(named.withColumn("in", F.lit(True)), "fp", "left").select("fp", F.when(F.col("in"), F.col("name")).otherwise(F.col("low")).alias("name")), "names")
    out = prints.join(final, "fp")
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("name").alias("component_id"))
