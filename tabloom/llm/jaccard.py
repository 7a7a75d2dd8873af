"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import ROW_KEY, rows_by_key, text_of, with_row_key
from tabloom.operators.graph import connect
from tabloom.operators.shared import quoted, settle, settle_counted

WIDTH, PERCENT = 5, 75
#: Words of a shingle are weighted by these odd numbers before they are summed.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Shingles counted together in a task; below two in such a share, one in SPARSE stands for all.
SHARE, SPARSE = 2_000_000, 16
#: Shingles known to be frequent: the most frequent ones from HOT_COUNT on, at most HOT_MOST.
#: They come last in the order of shingles. The table only steers cost, never the result.
HOT_COUNT, HOT_MOST = 32, 1 << 18
#: Sizes among which the boundary between small and large sets is sought.
SMALL_MOST = 64
#: A set shares one more leading shingle with what it links to for each so many it has.
MORE = 8
#: Words of 64 bits in the filter that says which texts are needed again.
FILTER = 1 << 18
#: Sets a task remembers; when it forgets them, postings may repeat, which costs and changes nothing.
MET_MOST = 1 << 20
#: Members of a block when sets of one bag are compared.
BLOCK = 512


class _Words(dict):
    """Places of words in a table of their hashes; emptied when full."""

    FULL = 1 << 19

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.empty(self.FULL, np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.hashes[place] = xxhash.xxh3_64_intdigest(word)
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        out = []
        for start in range(0, len(words), self.FULL // 2):
            some = words[start : start + self.FULL // 2]
            if len(self) + len(some) > self.FULL:
                self.clear()
            out.append(self.hashes[np.fromiter(map(self.__getitem__, some), np.int32, len(some))])
        return out[0] if len(out) == 1 else np.concatenate(out)


def runs(text: str, known: _Words, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order.

    A to Z are lower-cased; words are what white space separates. With fewer words
    than ``width`` the whole sequence is one shingle; without words there is none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = known.of(words)
    n = min(width, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total += hashes[i : i + count] * FACTORS[i]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def shingles(text: str, known: _Words, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    found = np.sort(runs(text, known, width))
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles in four to eight bits for each of them, 1024 at least.

    Where the sketches of two sets differ, the sets differ in one shingle at least, so their
    number of differing bits bounds the difference from below. The number of words is a
    power of two; the halves of a sketch, xored, are the sketch of half as many.
    """
    bits = 64 << max(4, (max(len(found), 1) * 2 - 1).bit_length() - 5)
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def needed(n, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def shared(n):
    """How many of their leading shingles a set of ``n`` has in common with a linked set of ``n`` or more."""
    return 1 + n // MORE


def _counts(rows: DataFrame, width: int) -> DataFrame:
    """(shingle, n): estimates of how often a shingle occurs in different texts.

    Every shingle of every text is counted. In a task's share equal texts count once;
    shingles seen twice or more leave with their number, of those seen once each 16th (by a
    hash) leaves as sixteen.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, seen = _Words(), [], 0, set()

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            values, counts = every[starts], np.diff(starts, append=len(every))
            salt = np.uint64(xxhash.xxh3_64_intdigest(values[:1].tobytes()))
            alone = counts == 1
            drawn = (((values ^ salt) * FACTORS[0]) >> np.uint64(40)) % np.uint64(SPARSE) == 0
            stay = ~alone | drawn
            n = np.where(alone, SPARSE, counts)[stay]
            return pa.RecordBatch.from_arrays([pa.array(values[stay].view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                mark = xxhash.xxh3_64_intdigest(text)
                if text and mark not in seen:
                    seen.add(mark)
                    held.append(runs(text, known, width))
                    size += len(held[-1])
                if size >= SHARE:
                    yield flush()
                    held, size, seen = [], 0, set()
        if size:
            yield flush()

    counts = rows.select("_tl_text").mapInArrow(work, "shingle long, n long")
    return counts.groupBy("shingle").agg(F.sum("n").alias("n"))


def _leading(rows: DataFrame, key: str, hot: tuple, width: int, percent: int) -> DataFrame:
    """(key, n, sig, check, lead, n_light, work) for every row.

    ``lead`` are the first shingles of the set in the common order (rare before frequent,
    then by hash), so many that a linked set shares two, or `shared`, of them. From
    ``n_light`` on they are known to be frequent. ``work`` adds up how often they are expected.
    Of the equal sets that a task meets, the first has them and the others have none, so that a
    set's postings do not repeat with its copies.
    """
    frequent = rows.sparkSession.sparkContext.broadcast(hot)
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = _Words(), set()
        values, counts = frequent.value
        for batch in batches:
            out = {c: [] for c in ["n", "sig", "check", "lead", "n_light", "work"]}
            for value in batch.column(1):
                found = shingles(value.as_py(), known, width)
                n, data = len(found), found.tobytes()
                sig, lead, n_light, load = xxhash.xxh3_64_intdigest(data), found[:0], 0, 0.0
                if n and sig not in met:
                    if len(met) >= MET_MOST:
                        met.clear()
                    met.add(sig)
                    at = np.minimum(np.searchsorted(values, found), max(len(values) - 1, 0))
                    is_hot = values[at] == found if len(values) else np.zeros(n, bool)
                    light, heavy = found[~is_hot], found[is_hot]
                    often = counts[at[is_hot]] if len(values) else np.empty(0, np.int64)
                    order = np.lexsort((heavy, often))
                    size = min(n, n - needed(n, percent) + max(2, shared(n)))
                    lead = np.concatenate([light, heavy[order]])[:size]
                    n_light = min(size, len(light))
                    load = float(n_light + often[order][: size - n_light].sum())
                out["n"].append(n)
                out["sig"].append(sig)
                out["check"].append(xxhash.xxh64_intdigest(data, seed=7))
                out["lead"].append(lead.view(np.int64))
                out["n_light"].append(n_light)
                out["work"].append(load)
            ends = np.cumsum([0, *map(len, out["lead"])]).astype(np.int32)
            flat = np.concatenate(out["lead"]) if out["lead"] else np.empty(0, np.int64)
            signed = [pa.array(np.array(out[c], np.uint64).view(np.int64)) for c in ["sig", "check"]]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            arrays = [batch.column(0), pa.array(out["n"], pa.int64()), *signed, lists, pa.array(out["n_light"], pa.int32()), pa.array(out["work"], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *out])

    return rows.select(key, "_tl_text").mapInArrow(work, f"{key} {kind}, n long, sig long, check long, lead array<long>, n_light int, work double")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(sig, n, members, sketch) for rows (_tl_text, sig) whose text has that signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sigs, lists, drawn = [], [], []
            for value, sig in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = shingles(value.as_py(), known, width)
                own = np.array([xxhash.xxh3_64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0]
                if own == sig:
                    sigs.append(sig)
                    lists.append(found.view(np.int64))
                    drawn.append(sketch(found))
            sizes = pa.array([len(x) for x in lists], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), sizes, _ragged(lists), _ragged(drawn)], names=["sig", "n", "members", "sketch"])

    return rows.select("_tl_text", "sig").mapInArrow(work, "sig long, n long, members array<long>, sketch array<long>")


def _ragged(lists: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))


def boundary(table: DataFrame, percent: int = PERCENT) -> int:
    """The size up to which sets count as small: the one that costs least.

    A small set costs the pairs of its leading shingles; a large one costs their postings and
    the entries expected in their lists. Small sets from ``percent`` of the
    boundary on are posted as well, for the large ones. One aggregate by size.
    """
    sizes = table.where((F.col("n") > 1) & (F.col("n") <= SMALL_MOST)).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("work").alias("work"))
    rows = {r["n"]: (r["sets"], r["work"]) for r in sizes.collect()}

    def lead(n: int) -> int:
        return n - needed(n, percent) + 1

    def cost(limit: int) -> float:
        total = 0.0
        for n, (sets, work) in rows.items():
            if n <= limit:
                total += sets * (lead(n) + 1) * lead(n) / 2
            if n > limit or n >= needed(limit + 1, percent):
                total += sets * (lead(n) + n // MORE) + work
        return total

    return min(range(SMALL_MOST + 1), key=lambda limit: (cost(limit), limit))


def _keys(table: DataFrame, limit: int, percent: int) -> DataFrame:
    """(key, sig, info, hot): pairs of leading shingles of small sets, leading shingles of large.

    ``info`` is twice the set's size, and one more for a single shingle.
    """
    size = F.col("n")
    rest = size - F.ceil(size * F.lit(percent) / F.lit(100))
    ready = table.where("n > 1").withColumns({"_tl_pairs": (rest + 2).cast("int"), "_tl_singles": (rest + 1 + F.floor(size / MORE)).cast("int")})
    small = ready.where(size <= limit).withColumn("lead", F.slice("lead", F.lit(1), F.col("_tl_pairs")))
    pairs = small.select("sig", "n", "n_light", F.col("lead").alias("_tl_rest"), F.posexplode("lead").alias("i", "first"))
    pairs = pairs.select("sig", "n", "n_light", "i", "first", F.explode(F.slice("_tl_rest", F.col("i") + F.lit(2), F.size("_tl_rest"))).alias("second"))
    pairs = pairs.select(F.xxhash64("first", "second").alias("key"), "sig", (2 * size).alias("info"), (F.col("i") >= F.col("n_light")).alias("hot"))
    large = ready.where(size >= needed(limit + 1, percent))
    singles = large.select("sig", "n", "n_light", F.posexplode(F.slice("lead", F.lit(1), F.col("_tl_singles"))).alias("i", "key"))
    return pairs.unionByName(singles.select("key", "sig", (2 * size + 1).alias("info"), (F.col("i") >= F.col("n_light")).alias("hot")))


def _lists(keys: DataFrame, limit: int) -> DataFrame:
    """(key, sig, info): postings whose list has another set, and a large one if of single shingles.

    Lists of shingles known to be frequent are joined to what an aggregate says of them
    (Spark splits such joins); the others, which are short, are looked at by window.
    """
    good = (F.col("low") < F.col("high")) & ((F.col("info") % 2 == 0) | (F.col("most") > 2 * limit + 1))
    measures = {"low": F.min("sig"), "high": F.max("sig"), "most": F.max("info")}
    over = Window.partitionBy("key")
    light = keys.where(~F.col("hot")).select("key", "sig", "info").withColumns({k: v.over(over) for k, v in measures.items()}).where(good)
    heavy = keys.where("hot").select("key", "sig", "info")
    about = heavy.groupBy("key").agg(*[v.alias(k) for k, v in measures.items()]).where("low < high")
    return light.select("key", "sig", "info").unionByName(heavy.join(about, "key").where(good).select("key", "sig", "info"))


def _thinned(lists: DataFrame, limit: int, percent: int) -> DataFrame:
    """The postings of sets with enough lists for a link, in lists that still have two sets.

    A set that links shares `shared` of its leading shingles, by the size of the
    smaller of the two, or a pair. Sets that others share shingles with by chance have
    fewer; without them, others have too few. Repeated until little goes.
    """
    least = F.ceil(F.floor(F.col("info") / 2) * F.lit(percent) / F.lit(100))
    now, rows = lists, lists.count()
    while rows:
        counts = now.groupBy("sig").agg(F.max("info").alias("info"), F.count_if(F.col("info") % 2 == 1).alias("singles"), F.count_if(F.col("info") % 2 == 0).alias("pairs"))
        enough = counts.where((F.col("pairs") > 0) | (F.col("singles") >= 1 + F.floor(least / MORE))).select("sig")
        kept = now.join(enough, "sig", "left_semi")
        heads = kept.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.max("info").alias("most"))
        good = heads.where((F.col("low") < F.col("high")) & ((F.col("most") % 2 == 0) | (F.col("most") > 2 * limit + 1))).select("key")
        now = settle(kept.join(good, "key", "left_semi").select("key", "sig", "info"), "postings")
        before, rows = rows, now.count()
        if rows > 0.8 * before:
            break
    return now


def _bags(lists: DataFrame, percent: int) -> DataFrame:
    """(bag, rep, k, sig, n): sets that share a key and may fit in size, with their representative.

    A key's sets are listed under their lowest signature, and what is under one signature is
    parted by size: sizes that fit fall into one of a row of ranges or two neighbouring
    ones, so each set is in two bags. A bag's representative is its lowest signature, ``k`` that
    set's size. Any two sets that link are in a bag together.
    """
    heads = lists.groupBy("key").agg(F.min("sig").alias("low"))
    listed = lists.join(heads, "key").select("low", "sig", F.floor(F.col("info") / 2).alias("n")).distinct()
    # A little wider than the sizes that fit, so that rounding cannot part them.
    step = F.floor(F.ln(F.col("n")) / F.lit(math.log(100.5 / percent)))
    ranged = settle(listed.withColumn("step", F.explode(F.array(step, step + 1))).select(F.xxhash64("low", "step").alias("bag"), "sig", "n"), "listed")
    heads = ranged.groupBy("bag").agg(F.min("sig").alias("rep"), F.max("sig").alias("last")).where("rep < last").select("bag", "rep")
    members = ranged.join(heads, "bag")
    sizes = members.where("sig = rep").select("bag", F.col("n").alias("k")).distinct()
    return members.join(sizes, "bag").select("bag", "rep", "k", "sig", "n")


def _again(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_tl_text, sig): the texts of the rows with the wanted keys (_tl_key, sig).

    A filter of fixed size, whose bits the wanted keys set, goes to the tasks, so that most
    other texts stay where they are; the join decides.
    """
    hashed = F.xxhash64("_tl_key")
    word, bit = F.pmod(hashed, F.lit(FILTER)), F.pmod(F.shiftright(hashed, 32), F.lit(64)).cast("int")
    mask = F.expr("shiftleft(1L, _tl_bit)")
    bits = wanted.select(word.alias("_tl_word"), bit.alias("_tl_bit")).groupBy("_tl_word").agg(F.bit_or(mask).alias("_tl_mask"))
    near = rows.withColumns({"_tl_word": word, "_tl_bit": bit}).join(F.broadcast(bits), "_tl_word").where(F.expr("shiftrightunsigned(_tl_mask, _tl_bit) & 1L = 1L"))
    near = near.select("_tl_key", "_tl_text")
    return near.alias("t").join(wanted.alias("w"), F.col("t._tl_key").eqNullSafe(F.col("w._tl_key"))).select("_tl_text", "sig")


def similar(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether two sets link; sizes decide first."""
    common = F.size(F.array_intersect(a, b))
    fits = _fits(n_a, n_b, percent)
    return fits & F.when(fits, 100 * common >= percent * (n_a + n_b - common)).otherwise(F.lit(False))


def _halved(a: Column, b: Column) -> Column:
    """Sketch ``a``, at the length of ``b`` if that is half as long."""
    half = F.size(b)
    folded = F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(a) > half, folded).otherwise(a)


def may_link(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """False for most sets that do not link, by their sketches; never for sets that do."""
    differ = F.zip_with(_halved(a, b), _halved(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    count = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    fits = _fits(n_a, n_b, percent)
    return fits & F.when(fits, (100 + percent) * count <= (100 - percent) * (n_a + n_b)).otherwise(F.lit(False))


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets, with any further columns, those that link: sketches go first."""
    return _verified(_sketched(pairs, sets, percent), sets, percent)


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    first = sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    second = sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(first, "a").join(second, "b")
    return both.where(may_link(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), percent)).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    first = sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("m_a"))
    second = sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("m_b"))
    both = pairs.join(first, "a").join(second, "b")
    return both.where(similar(F.col("m_a"), F.col("m_b"), F.col("n_a"), F.col("n_b"), percent)).select(*pairs.columns)


def _cross_links(bags: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that a pair of sets in one bag links, beyond those already joined.

    Only pairs across components are open. The members of a bag's most frequent component
    need not be compared with each other, so the others are compared with all. In bags of
    up to `BLOCK` sets the open pairs are listed; several bags may have the same. In
    larger ones both sides are cut into blocks, a block meets a block in one group of the
    join, and the comparison of sketches is the join's condition, so that little more than
    links comes out. What is left is compared by the sets themselves.
    """
    named = bags.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("bag", "rep", "sig", "n", F.coalesce("component", "sig").alias("part"))
    named = settle(named, "named")
    parts = named.groupBy("bag", "part").agg(F.count(F.lit(1)).alias("size"))
    most = parts.groupBy("bag").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("held"), F.sum("size").alias("all")).where("held < all")
    members = settle(named.join(most, "bag").withColumn("other", F.col("part") != F.col("main")), "open")
    pair = (F.col("l.part") != F.col("r.part")) & (~F.col("r.other") | (F.col("l.sig") < F.col("r.sig"))) & _fits(F.col("l.n"), F.col("r.n"), percent)
    pair = pair & (F.col("l.sig") != F.col("l.rep")) & (F.col("r.sig") != F.col("r.rep"))
    ends = [F.col("l.sig").alias("a"), F.col("r.sig").alias("b"), F.col("l.part").alias("p"), F.col("r.part").alias("q")]

    short = members.where(F.col("all") <= BLOCK)
    listed = short.where("other").alias("l").join(short.alias("r"), (F.col("l.bag") == F.col("r.bag")) & pair).select(*ends)
    order = F.col("a") < F.col("b")
    ordered = [F.when(order, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in [("a", "b"), ("b", "a"), ("p", "q"), ("q", "p")]]
    listed = _sketched(listed.select(*ordered).distinct(), sets, percent)

    blocks, rows = F.ceil(F.col("all") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("held")) / BLOCK).cast("int")
    cell = F.pmod(F.xxhash64("sig"), F.lit(1 << 30)).cast("int")
    wide = members.where(F.col("all") > BLOCK).withColumns({"blocks": blocks, "rows": rows}).join(sets.select("sig", "sketch"), "sig")
    left = wide.where("other").withColumn("row", cell % F.col("rows")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("l")
    right = wide.withColumn("column", cell % F.col("blocks")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).alias("r")
    at = (F.col("l.bag") == F.col("r.bag")) & (F.col("l.row") == F.col("r.row")) & (F.col("l.column") == F.col("r.column"))
    near = may_link(F.col("l.sketch"), F.col("r.sketch"), F.col("l.n"), F.col("r.n"), percent)
    blocked = left.join(right, at & pair & near).select(*ends).select(*ordered).distinct()
    open_pairs = settle(listed.unionByName(blocked).distinct(), "candidates")
    return _verified(open_pairs, sets, percent).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id for every row of ``df``.

    Two rows link when their sets of ``width``-word shingles have a Jaccard similarity of
    ``percent`` percent or more; a component is what links reach, named by its smallest key.
    No link between different sets is lost and none is found by sampling:

    1. Equal sets are one set. All else works on signatures of sets.
    2. Linked sets share a key. Small sets: a pair of shingles among the first
       n - needed + 2; large ones, and small against large: `shared` shingles among the first
       n - needed + `shared`. `boundary` weighs the cost of pairs against that of lists.
    3. Sets with a common key, of sizes that may fit, are in one bag, under one of them. They
       are compared with it first. What links is one component.
    4. Pairs across the components of a bag are compared in blocks.

    Null or empty texts, also those of white space: size 0, a component of their own. Null
    keys: rows like others, but never the name of a component unless all its keys are
    null. Repeated rows: each is returned. Extra columns are ignored. Groups of
    copies are one set; groups of near copies are compared with one of them first, so most
    of their pairs are never made. Shingles and sets are compared by 64-bit hashes; two sets
    of one signature are told apart by a second hash, and the join fails if they differ.
    """
    name = quoted(key)
    rows = df.select(name.alias("_tl_key"), text_of(text).alias("_tl_text"))
    hot = _counts(rows, width).where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "shingle").limit(HOT_MOST).toArrow()
    values = hot.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    table = settle(_leading(rows, "_tl_key", (values[order], hot.column("n").to_numpy()[order]), width, percent), "leading")

    seals = table.groupBy("sig").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min("_tl_key").alias("_tl_key"))
    if seals.where("low <> high").limit(1).count():
        raise ValueError("two different sets have one signature")
    limit = boundary(table, percent)
    lists = settle(_lists(_keys(table, limit, percent), limit), "postings")
    bags = settle(_bags(_thinned(lists, limit, percent), percent), "bags")
    stars = settle(bags.where(F.col("rep") != F.col("sig")).where(_fits(F.col("k"), F.col("n"), percent)).select(F.col("rep").alias("a"), F.col("sig").alias("b")).distinct(), "stars")
    wanted = bags.select("sig").distinct().join(seals.select("sig", "_tl_key"), "sig")
    wanted, n_wanted = settle_counted(wanted, "wanted")
    sets, n_sets = settle_counted(_sets(_again(rows, wanted), width), "sets")
    if n_sets > n_wanted:  # rows that repeat key and text
        sets = settle(sets.dropDuplicates(["sig"]), "sets")
    stars = _linked(stars, sets, percent)
    first = settle(connect(stars), "components")
    second = settle(connect(_cross_links(bags, sets, first, percent)), "joined").select(F.col("node").alias("part"), F.col("component").alias("whole"))
    # A set that only the second pass linked was its own part.
    named = first.withColumnRenamed("component", "part").join(second, "part", "left").select(F.col("node").alias("sig"), F.coalesce("whole", "part").alias("component"))
    alone = second.join(first.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("sig"), F.col("whole").alias("component"))
    labels = settle(named.unionByName(alone), "labels")

    placed = table.select("_tl_key", "n", "sig").join(labels, "sig", "left").select("_tl_key", "n", F.coalesce("component", "sig").alias("component"))
    names = placed.where("n > 0").groupBy("component").agg(F.min("_tl_key").alias("name"))
    out = placed.join(names, "component", "left")
    return out.select(F.col("_tl_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("_tl_key")).alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The rows of ``df`` with all columns, but of each component only the row of the lowest key.

    Rows without words are components of their own and all stay. Rows with equal keys are
    ordered by a hash of their content; null keys go last. Of rows that are equal in
    all columns one stays, also of rows without words.
    """
    rows = with_row_key(df)
    own = F.struct(quoted(key).isNull().alias("none"), quoted(key).alias("key"), *ROW_KEY)
    found = jaccard_components(rows.withColumn("_tl_own", own), "_tl_own", text, **rules)
    same = [F.col(f"_tl_own.{c}") == F.col(f"component_id.{c}") for c in ROW_KEY]
    kept = found.where(same[0] & same[1]).groupBy(*[F.col(f"_tl_own.{c}").alias(c) for c in ROW_KEY]).agg(F.count(F.lit(1)).alias("n"))
    return rows_by_key(rows, settle(kept, "kept")).select(*[quoted(c) for c in df.columns])
