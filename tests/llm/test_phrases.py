"""Phrase collocations against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tabloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, id long, prefix string"
SMALL = phrases.Sizes(rank_bits=4, tile_bits=2, share=300, dense=4)


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 0, 1, "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, least=10, longest=3, cover=50, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang, lowered = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    covered = collections.defaultdict(int)
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                covered[lang, words[i : i + k]] = max(covered[lang, words[i : i + k]], a)
    best = collections.defaultdict(list)
    for (lang, words), a in found.items():
        if 100 * covered[lang, words] >= cover * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        best[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, lines in best.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(lines)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("aBé z", k=rng.randint(1, 4))) for _ in range(60)] + ["w" * 100, "the", "of"]
    fixed = ["New York City", "of the", "le petit chat noir", "a\tb", "x y z"]
    out = [(None, "en"), ("", None), ("a, b. c!\n\x0b\x0cd", "en"), ("the " * 500, "en"), (". , ;", None), ("one two three", "éé")]
    for i in range(150):
        words = rng.choices(vocabulary, weights=[1 / (1 + k) for k in range(len(vocabulary))], k=rng.randint(0, 60))
        for _ in range(3):
            words.insert(rng.randint(0, len(words)), rng.choice(fixed))
        text = " ".join(w + rng.choice(["", "", "", "", ",", " .", "\n", "  ", "\t"]) for w in words)
        out.append((text, rng.choice(["en", "fr", None])))
    out += [out[-1]] * 8
    out.append((" ".join(rng.choices(vocabulary, k=30_000)), "en"))
    return out


@pytest.mark.parametrize("sizes", [phrases.Sizes(), SMALL])
def test_matches_brute_force(spark, rows, sizes):
    """With room for every word, and with few ranks, so that most units are hashed and tiles of both kinds occur."""
    want = brute(rows)
    assert len(want) > 100 and any(r[2] == "new york city" for r in want)
    assert rows_of(phrases.collocations(table_of(spark, rows), sizes=sizes)) == want


def test_longer_phrases_and_other_rules(spark, rows):
    want = brute(rows, least=5, longest=4, cover=80, top=30)
    assert any(len(r[2].split(" ")) == 4 for r in want)
    assert rows_of(phrases.collocations(table_of(spark, rows), least=5, longest=4, cover=80, top=30, sizes=SMALL)) == want


def test_products_beyond_64_bits(spark):
    """Counts whose products do not fit a long, given as levels."""
    n = 9 * 10**13
    df = spark.createDataFrame([(n, [n + 1, 2 * n], [3 * n, n])], "n long, lefts array<bigint>, rights array<bigint>")
    row = phrases._scored(df).first()
    cuts = [(10**6 * n * n // ((n + 1) * 3 * n), n + 1, 3 * n), (10**6 * n * n // (2 * n * n), 2 * n, n)]
    assert (row.score, row.l, row.r) == min(cuts)


def test_tally_counts_dense_tiles_sorted_pairs_and_hashes():
    rng = np.random.default_rng(1)
    left, right = rng.integers(-3, 16, 2000), rng.integers(-3, 16, 2000)
    a, b, n = phrases.tally(left, right, SMALL)
    want = collections.Counter(zip(left.tolist(), right.tolist(), strict=True))
    assert len(a) == len(want) and dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want


def test_no_candidates(spark):
    df = table_of(spark, [("all words differ here", "en")])
    assert phrases.collocations(df).count() == 0
    out = phrases.collocations(table_of(spark, []))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
