"""Phrase collocations: words as frequency ranks, pairs counted in direct-address tiles, pairs ranked again."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import text_of
from tabloom.operators.shared import quoted, settle, settle_counted

#: Ends of pieces; a phrase does not pass them. Words are parted by blanks and tabs.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: One mapping of bytes: A to Z lowered, separators to a line feed, tabs to blanks.
MAPPED = bytes.maketrans(string.ascii_uppercase.encode() + SEPARATORS + b"\t", string.ascii_lowercase.encode() + b"\n" * len(SEPARATORS) + b" ")
#: Not a unit: the end of a piece, a rare word or phrase. And what an empty string between blanks is.
BREAK, SKIP = 1 << 62, (1 << 62) + 1
#: Longest word, in bytes, that may have a rank, so that the table sent to the tasks is bounded.
RANKED_BYTES = 64
#: Words of 64 bits in a filter: sixteen bits a unit, between these.
FILTER_LEAST, FILTER_MOST = 1 << 10, 1 << 21


@dataclass(frozen=True)
class Sizes:
    """What steers cost, never the result: ranks and sides of tiles in bits, positions that a
    task counts at a time, and how many cells a dense tile has for one pair at most."""

    rank_bits: int = 18
    tile_bits: int = 10
    share: int = 4_000_000
    dense: int = 8


def tokens(text: bytes) -> list[bytes]:
    """Words, with a line feed between pieces and empty strings between blanks."""
    return text.translate(MAPPED).replace(b"\n", b" \n ").split(b" ")


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of ids, as negative longs."""
    x = left.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (right.astype(np.int64).view(np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F))
    for shift, factor in [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)]:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) | np.uint64(1 << 63)).view(np.int64)


def _word_hash(lang: str, word: bytes) -> int:
    """A negative long."""
    return (xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) | (1 << 63)) - (1 << 64)


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a filter may have these ids."""
    at = ids.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Ids(dict):
    """Ids of a language's words: ranks, hashes of other words that may be frequent, `BREAK`.

    Only ranked words are held.
    """

    def __init__(self, lang: str, ranked: dict[bytes, int], bits: np.ndarray | None) -> None:
        super().__init__(ranked)
        self[b""], self[b"\n"] = SKIP, BREAK
        self.lang, self.bits = lang, bits

    def __missing__(self, word: bytes) -> int:
        if self.bits is None:
            return BREAK
        found = _word_hash(self.lang, word)
        at = found & (len(self.bits) * 64 - 1)
        return found if int(self.bits[at >> 6]) >> (at & 63) & 1 else BREAK


@dataclass
class _Known:
    """What the tasks know of frequent words, or of frequent phrases of one length: ranks of the most
    frequent ones (words by language; codes of pairs in order), and a filter for the others, if any."""

    words: dict[str, dict[bytes, int]] | None
    codes: np.ndarray | None
    ranks: np.ndarray | None
    bits: np.ndarray | None


def units(before: np.ndarray, words: np.ndarray, known: _Known, sizes: Sizes) -> np.ndarray:
    """Ids of the phrases at each position: what ``before`` has there and one word more.

    ``words`` is shifted so that it has the word after. Ranked pairs have their rank, others that
    may be frequent a hash.
    """
    out = np.full(len(words), BREAK, np.int64)
    good = np.flatnonzero((before[: len(words)] != BREAK) & (words != BREAK))
    left, right = before[good], words[good]
    both = (left >= 0) & (right >= 0)
    if len(known.codes) and both.any():
        codes = (left[both] << sizes.rank_bits) | right[both]
        at = np.minimum(np.searchsorted(known.codes, codes), len(known.codes) - 1)
        out[good[both]] = np.where(known.codes[at] == codes, known.ranks[at], BREAK)
    if known.bits is not None:
        rest = out[good] == BREAK
        hashed = _mixed(left[rest], right[rest])
        out[good[rest]] = np.where(_passes(known.bits, hashed), hashed, BREAK)
    return out


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], np.diff(starts, append=len(ordered))


def tally(left: np.ndarray, right: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n): how often each pair of ids occurs.

    Pairs of ranks are dealt into square tiles. A tile with many pairs is counted by address,
    one cell for each possible pair; what is in the other tiles is sorted and its runs are
    counted, and so are pairs with a hash.
    """
    bits, side = sizes.rank_bits, sizes.tile_bits
    ranked = (left >= 0) & (right >= 0)
    i, j = left[ranked], right[ranked]
    tile = ((i >> side) << (bits - side)) | (j >> side)
    order = np.argsort(tile.astype(np.uint16) if 2 * (bits - side) <= 16 else tile, kind="stable")
    codes = ((i << bits) | j)[order]
    number, count = _runs(tile[order])
    ends = np.cumsum(count)
    out, sparse = [], np.ones(len(codes), bool)
    low = (1 << side) - 1
    for t, n, end in zip(number.tolist(), count.tolist(), ends.tolist(), strict=True):
        if n * sizes.dense >= 1 << (2 * side):
            part = codes[end - n : end]
            cells = np.bincount((((part >> bits) & low) << side) | (part & low), minlength=1 << (2 * side))
            hit = np.flatnonzero(cells)
            row, column = t >> (bits - side), t & ((1 << (bits - side)) - 1)
            out.append(((row << side) + (hit >> side), (column << side) + (hit & low), cells[hit]))
            sparse[end - n : end] = False
    pairs, n = _runs(np.sort(codes[sparse]))
    out.append((pairs >> bits, pairs & ((1 << bits) - 1), n))
    if not ranked.all():
        a, b = left[~ranked], right[~ranked]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        out.append((a[starts], b[starts], np.diff(starts, append=len(a))))
    return tuple(np.concatenate([part[k] for part in out]).astype(np.int64) for k in range(3))


def _word_counts(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """(lang, word, n) over all texts; ``word`` in bytes."""

    def flush(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs, words, n = [], [], []
        for lang, counted in counts.items():
            counted.pop(b"", None)
            counted.pop(b"\n", None)
            langs += [lang] * len(counted)
            words += counted.keys()
            n += counted.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, read = {}, 0
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                counts.setdefault(lang, Counter()).update(tokens(text))
                read += len(text)
                if read >= 8 * sizes.share:
                    yield flush(counts)
                    counts, read = {}, 0
        yield flush(counts)

    return rows.mapInArrow(work, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _phrase_counts(rows: DataFrame, known: list[_Known], sizes: Sizes) -> DataFrame:
    """(prefix, last, n): phrases one word longer than those known, by the ids of what they begin
    with and their last word. Phrases with a part that is not frequent are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *more = sent.value
        ids, held, size = {}, [], 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate([*held, np.full(len(more) + 1, BREAK)])
            prefix = words
            for i, level in enumerate(more):
                prefix = units(prefix, words[i + 1 :], level, sizes)
            n = len(more) + 1
            last, left, right = words[n:], prefix[: len(words) - n], prefix[1 : len(words) - n + 1]
            good = (left != BREAK) & (last != BREAK) & (right != BREAK)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in tally(left[good], last[good], sizes)], names=["prefix", "last", "n"])

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in ids:
                    ids[lang] = _Ids(lang, first.words.get(lang, {}), first.bits)
                parts = tokens(value.as_py())
                found = np.fromiter(map(ids[lang].__getitem__, parts), np.int64, len(parts))
                held += [found[found != SKIP], np.array([BREAK])]
                size += len(held[-2])
                if size >= sizes.share:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(work, "prefix long, last long, n long").groupBy("prefix", "last").agg(F.sum("n").alias("n"))


def _filter(named: DataFrame, unranked: int) -> np.ndarray | None:
    """Bits of the hashed ids; a fixed number of them for each, up to a bound. Collisions only cost."""
    if not unranked:
        return None
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (unranked // 4).bit_length()))
    at = F.col("id").bitwiseAND(F.lit(size * 64 - 1))
    masks = named.where("id < 0").select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("mask"))
    found = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return bits


def _distinct_ids(named: DataFrame) -> None:
    if named.where("id < 0").groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("two frequent words or phrases have one hash")


def _ranked_words(counts: DataFrame, sizes: Sizes) -> tuple[DataFrame, _Known]:
    """Level of the words (id, n, prefix, last, tail_id, lefts, rights, lang, phrase, tail), and what the tasks get of it."""
    order = [F.desc("n"), "lang", "word"]
    top = counts.where(F.octet_length("word") <= RANKED_BYTES).orderBy(*order).limit(1 << sizes.rank_bits).select("lang", "word").toArrow()
    words: dict[str, dict[bytes, int]] = {}
    for rank, (lang, word) in enumerate(zip(top.column("lang").to_pylist(), top.column("word").to_pylist(), strict=True)):
        words.setdefault(lang, {})[word] = rank
    sent = counts.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ids = [_word_hash(lang, word) if (rank := sent.value.get(lang, {}).get(word)) is None else rank for lang, word in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=["lang", "word", "n", "id"])

    named = counts.select("lang", "word", "n").mapInArrow(work, "lang string, word binary, n long, id long")
    text = F.col("word").cast("string")
    none = F.expr("CAST(array() AS array<bigint>)")
    level = settle(named.select("id", "n", F.lit(None).cast("long").alias("prefix"), F.col("id").alias("last"), F.col("id").alias("tail_id"), none.alias("lefts"), none.alias("rights"), "lang", text.alias("phrase"), text.alias("tail")), "words")
    _distinct_ids(level)
    return level, _Known(words, None, None, _filter(level, level.count() - top.num_rows))


def _ranked_phrases(counts: DataFrame, n_counts: int, sizes: Sizes) -> tuple[DataFrame, _Known]:
    """(id, prefix, last, n), and what the tasks get of it."""
    top = counts.where("prefix >= 0 AND last >= 0").orderBy(F.desc("n"), "prefix", "last").limit(1 << sizes.rank_bits).toArrow()
    codes = (top.column("prefix").to_numpy() << sizes.rank_bits) | top.column("last").to_numpy()
    order = np.argsort(codes)
    known = _Known(None, codes[order], order.astype(np.int64), None)
    sent = counts.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = units(left, right, sent.value, sizes)
            ids = np.where(ids == BREAK, _mixed(left, right), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=["prefix", "last", "n", "id"])

    named = settle(counts.select("prefix", "last", "n").mapInArrow(work, "prefix long, last long, n long, id long"), "ranked")
    _distinct_ids(named)
    return named, _Known(None, known.codes, known.ranks, _filter(named, n_counts - len(codes)))


def _level(named: DataFrame, shorter: DataFrame, pairs: bool) -> DataFrame:
    """Adds to phrases what their parts have: counts of both sides of every cut, language, text.

    What is left of a cut but the last is left of the same cut in the phrase without its
    last word; what is right of a cut but the first, right in the phrase without its first.
    """
    head = shorter.select(F.col("id").alias("prefix"), F.col("tail_id").alias("inner"), F.col("n").alias("n_left"), F.col("lefts").alias("l_lefts"), "lang", F.col("phrase").alias("head"))
    joined = named.join(head, "prefix")
    if pairs:
        rest = shorter.select(F.col("id").alias("last"), F.col("id").alias("tail_id"), F.col("n").alias("n_right"), F.col("rights").alias("r_rights"), "tail")
        joined = joined.join(rest, "last")
    else:
        rest = shorter.select(F.col("prefix").alias("inner"), "last", F.col("id").alias("tail_id"), F.col("n").alias("n_right"), F.col("rights").alias("r_rights"), "tail")
        joined = joined.join(rest, ["inner", "last"])
    return joined.select(
        "id", "n", "prefix", "last", "tail_id", F.concat("l_lefts", F.array("n_left")).alias("lefts"), F.concat(F.array("n_right"), "r_rights").alias("rights"),
        "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail",
    )


def _scored(level: DataFrame) -> DataFrame:
    """Adds the lowest-scoring cut: score, l, r. Counts up to 10^15 are exact."""
    whole = "CAST({} AS DECIMAL(15,0))"
    a, left, right = whole.format("n"), whole.format("lefts[k - 1]"), whole.format("rights[k - 1]")
    cut = f"named_struct('score', (CAST(1000000 AS DECIMAL(7,0)) * {a} * {a}) DIV ({left} * {right}), 'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])"
    return level.withColumn("cut", F.expr(f"array_min(transform(sequence(1, size(lefts)), k -> {cut}))")).select("*", "cut.score", "cut.l", "cut.r")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, cover: int = 50, top: int = 2000, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best-scoring phrases of each language.

    A to Z are lower-cased, texts are split at ``. , ; : ! ?`` and line ends into pieces, those at blanks and tabs
    into words. Candidates are phrases of 2 to ``longest`` words that occur ``least`` times or more within pieces, overlaps
    included. A cut after k words scores floor(10^6 a a / (l r)) from the phrase's count a and those of
    its sides; the lowest cut counts, ties to the smallest k. A candidate goes if a longer one
    that holds it has ``cover`` percent of its count or more. ``n`` are all words of the language.

    Words get ids by frequency: ranks where the table that all tasks get has room, a hash where not. Pairs of
    ranks are counted in tiles (`tally`). Frequent pairs are ranked in turn, and a phrase of three
    words is a pair of such a pair and a word, and so on. A phrase is no more frequent than its parts, so only
    phrases of frequent parts are counted; a filter rules most others out without a table
    of all, and one that it lets through wrongly fails the count. Counts are exact: the
    function ends with an error should two frequent units share a hash.

    Null or empty texts have no words. Null languages count as ``und``. Repeated rows count
    each. Ties: higher score, then count, then the phrase by its bytes. Very long texts are counted
    whole; a task holds one text and a share of positions. Extra columns are ignored. A table
    without candidates, or without rows, gives none.
    """
    rows = df.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))
    every = settle(_word_counts(rows, sizes), "counts")
    totals = every.groupBy("lang").agg(F.sum("n").alias("all"))
    level, known = _ranked_words(every.where(F.col("n") >= least), sizes)
    levels, sent = [], [known]
    for length in range(2, longest + 1):
        counts, n_counts = settle_counted(_phrase_counts(rows, sent, sizes).where(F.col("n") >= least), "phrases")
        named, known = _ranked_phrases(counts, n_counts, sizes)
        level = settle(_level(named, level, length == 2), "level")
        levels.append(level)
        sent.append(known)
    candidates = None
    for level, longer in zip(levels, [*levels[1:], None], strict=True):
        scored = _scored(level).select("id", "lang", "phrase", "n", "l", "r", "score")
        if longer is not None:
            # What a phrase two words longer covers, the one between covers too.
            inside = longer.select(F.col("prefix").alias("id"), F.col("n").alias("most")).unionByName(longer.select(F.col("tail_id").alias("id"), F.col("n").alias("most")))
            covered = inside.groupBy("id").agg(F.max("most").alias("most"))
            scored = scored.join(covered, "id", "left").where(F.coalesce(100 * F.col("most") < cover * F.col("n"), F.lit(True))).drop("most")
        scored = scored.drop("id")
        candidates = scored if candidates is None else candidates.unionByName(scored)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))
    best = candidates.withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", "score")
    return best.join(totals.withColumnRenamed("all", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
