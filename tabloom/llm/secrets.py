"""Secret scans: known forms, and strings whose windows are too even to be words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_of
from tabloom.operators.shared import quoted

#: Known forms: kind, pattern, group measured, least length. Fixed values.
FORMS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]


@dataclass(frozen=True)
class Entropy:
    """A character class: its members, the window and the bits a character it must reach.

    Candidates are runs of at least ``window`` members that match all of ``needs``.
    ``alphabet`` lists the members; the rest of the class's letters fall on the
    last counter together (none here).
    """

    kind: str
    run: str
    needs: tuple[str, ...]
    alphabet: str
    window: int
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Uniformly drawn hex digits have 3.4 bits in 24 on average, words in lower case fewer than
#: 3.3 in 20 and no digits; base64 of random bytes has over 4 in 24. Hex takes a digit and a
#: letter, base64 a digit and both cases. Random digits and letters of one case (base32,
#: base36) have 3.9 to 4.0 in 24 and fewer than 3.5 in less than 1 of 100 windows.
CLASSES = (
    Entropy("entropy_hex", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_-])", ("[0-9]", "[A-Fa-f]"), DIGITS + "abcdefABCDEF", 24, 3.0),
    Entropy("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", ("[0-9]", "[a-z]", "[A-Z]"), DIGITS + LOWER + UPPER + "+/_-", 24, 3.9),
    Entropy("entropy_onecase", r"(?<![A-Za-z0-9])(?:[a-z0-9]{24,}+|[A-Z0-9]{24,}+)(?![A-Za-z0-9])", ("[0-9]", "[A-Za-z]"), DIGITS + LOWER + UPPER, 24, 3.5),
)
#: Never secrets: UUIDs (as a whole run only), examples by name, runs of one character, steps
#: through the alphabet. Windows that overlap a match do not count; the rest of the run does.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]?(api[_-]?)?(key|token|secret|password)|xxxx",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij",
)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (kind, start, end, hit) of a pattern's matches with ``least`` characters in ``group``.

    What lies between the matches comes from splitting at the pattern, so positions are
    sums of lengths, in code points.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(F.split(text, pattern).alias("gap"), hits.alias("hit"), sized.alias("sized"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,from:int,to:int,hit:string>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + F.length(row["gap"])
        end = begin + F.coalesce(F.length(row["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("from"), end.alias("to"), row["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(F.length(row["sized"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    found = F.aggregate(rows, start, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:string,from:int,to:int,hit:string>>"))


def _term(n: Column) -> Column:
    """n log2 n, from a table of the counts a window can hold."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(n * F.log2(n))


def window_entropy(hit: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters in a row.

    One pass: an array counts each member of the alphabet in the window. A step takes the
    character that leaves and the one that enters, changes their two counters, and corrects
    the sum of n log2 n by those two terms only; entropy is log2(window) less that sum over
    the window. Strings shorter than the window have none (-1).
    """
    places = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(alphabet), c))
    behind = F.concat(F.array_repeat(F.lit(0), window), places)
    steps = F.arrays_zip(places.alias("new"), behind.alias("old"))
    start = F.struct(
        F.lit(0).alias("seen"), F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best")
    )

    def step(state: Column, row: Column) -> Column:
        new, old, counts = row["new"], row["old"], state["counts"]
        leaves = F.when(old > 0, F.get(counts, old)).otherwise(F.lit(0))
        after = F.when(old > 0, _term(leaves - 1) - _term(leaves)).otherwise(F.lit(0.0))
        has = F.get(counts, new) - F.when(old == new, F.lit(1)).otherwise(F.lit(0))
        total = state["sum"] + after + _term(has + 1) - _term(has)
        moved = F.transform(counts, lambda n, i: n + (i == new).cast("int") - ((i == old) & (old > 0)).cast("int"))
        seen = state["seen"] + 1
        bits = F.lit(math.log2(window)) - total / F.lit(float(window))
        best = F.when(seen >= window, F.greatest(state["best"], bits)).otherwise(state["best"])
        return F.struct(seen.alias("seen"), moved.alias("counts"), total.alias("sum"), best.alias("best"))

    # The longer of the zipped arrays is ``behind``; its surplus has no new character.
    return F.aggregate(F.filter(steps, lambda r: r["new"].isNotNull()), start, step)["best"]


def _cut_at(pattern: str):
    # A function of one argument: a second one, with a default too, would be taken for the index.
    return lambda part: F.split(part, pattern)


def _between(hit: Column, allowed: tuple[str, ...], least: int) -> Column:
    """What of a run lies between the ``allowed`` patterns' matches, in parts of ``least`` characters or more.

    A window overlaps no match just if it lies in one of the parts. An anchored pattern
    that fits the run leaves none.
    """
    parts = F.array(hit)
    for pattern in allowed:
        parts = F.flatten(F.transform(parts, _cut_at(pattern)))
    return F.filter(parts, lambda p: F.length(p) >= least)


def _entropy_spans(text: Column, rule: Entropy, allowed: tuple[str, ...]) -> Column:
    found = _spans(text, rule.kind, rule.run, 0, rule.window)

    def secret(span: Column) -> Column:
        hit = span["hit"]
        fits = hit.rlike(rule.needs[0])
        for pattern in rule.needs[1:]:
            fits = fits & hit.rlike(pattern)
        even = F.exists(_between(hit, allowed, rule.window), lambda p: window_entropy(p, rule.alphabet, rule.window) >= rule.bits)
        return F.when(fits, even).otherwise(F.lit(False))

    return F.filter(found, secret)


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[Entropy, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, keep: list[str] = ()) -> DataFrame:
    """key, n_<form> for every known form, base_sha256, spans, for every row.

    Spans are kind:start:end in code points, by start, then kind as listed. ``base_sha256``
    is of the known forms' spans. To them come strings by entropy, unless a known form covers
    them wholly. The window that reaches the entropy must not overlap a match of an
    ``allowed`` pattern; the span is the whole run around it. ``_tl_spans`` has all
    spans as structs. ``keep`` names further columns to carry along.

    Null and empty texts have no span. Every row is judged by itself, so null keys,
    repeated rows and hot groups make no difference, and no data moves. Extra columns are ignored.
    """
    body = F.col("_tl_text")
    rows = df.select(quoted(key).alias(key), *[quoted(c).alias(c) for c in keep], text_of(text).alias("_tl_text"))
    rows = rows.withColumns({f"_tl_{kind}": _spans(body, kind, pattern, group, least) for kind, pattern, group, least in FORMS})
    base = F.concat(*[F.transform(f"_tl_{f[0]}", lambda s, i=i: F.struct(s["from"].alias("from"), F.lit(i).alias("rank"), s["to"].alias("to"), s["kind"].alias("kind"))) for i, f in enumerate(FORMS)])
    rows = rows.withColumn("_tl_base", F.sort_array(base))
    rows = rows.withColumns({f"_tl_{rule.kind}": _entropy_spans(body, rule, allowed) for rule in classes})
    more = F.concat(*[
        F.transform(f"_tl_{rule.kind}", lambda s, i=i: F.struct(s["from"].alias("from"), F.lit(len(FORMS) + i).alias("rank"), s["to"].alias("to"), s["kind"].alias("kind")))
        for i, rule in enumerate(classes)
    ]) if classes else F.array_repeat(F.element_at("_tl_base", 1), 0)
    known = F.col("_tl_base")
    new = F.filter(more, lambda s: ~F.exists(known, lambda b: (b["from"] <= s["from"]) & (s["to"] <= b["to"])))
    rows = rows.withColumn("_tl_spans", F.sort_array(F.concat(known, new)))
    return rows.select(
        quoted(key).alias(key), *[quoted(c).alias(c) for c in keep], *[F.size(f"_tl_{f[0]}").cast("long").alias(f"n_{f[0]}") for f in FORMS],
        F.sha2(_joined(F.col("_tl_base")), 256).alias("base_sha256"), _joined(F.col("_tl_spans")).alias("spans"), "_tl_spans", "_tl_text",
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """All rows and columns of ``df``; in ``text`` each secret is replaced by ``mark``.

    Spans that touch or overlap are replaced together. ``length`` names a column that
    holds the text's length, which is brought up to date where the text changes. A text
    without secrets, also a null one, stays as it is.
    """
    columns = df.columns
    inner = df.select(*[quoted(c).alias(f"_tl_in_{i}") for i, c in enumerate(columns)], F.lit(0).alias("_tl_id"))
    body = f"_tl_in_{columns.index(text)}"
    found = scan(inner, "_tl_id", body, keep=[f"_tl_in_{i}" for i in range(len(columns))])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.col("_tl_text")

    def step(state: Column, span: Column) -> Column:
        fresh = (span["from"] > state["at"]) | (state["out"] == "")
        before = whole.substr(state["at"] + F.lit(1), F.greatest(span["from"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], span["to"]).alias("at"),
            F.when(fresh, F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate("_tl_spans", start, step)
    clean = F.concat(done["out"], whole.substr(done["at"] + F.lit(1), F.length(whole)))
    has = F.size("_tl_spans") > 0
    out = found.withColumn("_tl_clean", F.when(has, clean).otherwise(F.col(body)))
    kinds = dict(df.dtypes)
    final = []
    for i, c in enumerate(columns):
        value = F.col(f"_tl_in_{i}")
        if c == text:
            value = F.col("_tl_clean")
        elif c == length:
            value = F.when(has, F.length("_tl_clean").cast(kinds[c])).otherwise(value)
        final.append(value.alias(c))
    return out.select(*final)
