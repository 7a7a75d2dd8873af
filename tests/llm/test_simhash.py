"""SimHash near copies against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp long, low long, key string, component string"


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints, distance=4):
    """(doc_id, fingerprint, component) of every row; a component is named by its lowest key that is not null."""
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                group[find(i)] = find(j)
    names = {}
    for i, key in enumerate(rows):
        if key is not None:
            names[find(i)] = min(names.get(find(i), key), key)
    return sorted(((key, f"{prints[i]:016x}", names.get(find(i))) for i, key in enumerate(rows)), key=str)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("ABCdefé", k=rng.randint(2, 6))) for _ in range(300)]
    base = rng.choices(vocabulary, k=200)
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (None, "alone and null"), (None, None), (5, "three words only"), (5, "THREE words\tonly"), (6, "one"), (7, "x" * 100_000), (8, " ".join(rng.choices(vocabulary, k=70_000)))]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, " ".join(rng.choices(vocabulary, k=30))) for i in range(40)]
    want = brute([k for k, _ in rows], [fingerprint(t) for _, t in rows])
    df = spark.createDataFrame([(k, t, 1, 2, "k", "c") for k, t in rows], SCHEMA).repartition(5)
    for more in [{}, {"block": 7}, {"segments": 2}, {"segments": 3, "block": 5}, {"segments": 5}]:
        got = simhash.simhash_components(df, **more).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want, more


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_links_find_every_distance(spark, segments):
    """Pairs at each distance up to the limit, wherever the differing bits are; chains of such pairs join."""
    rng = random.Random(segments)
    prints, apart = [], []
    for _ in range(120):
        a = rng.getrandbits(64)
        near = a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        prints += [a, near]
        apart.append(a ^ sum(1 << b for b in rng.sample(range(64), 5)))
    values = [(int(np.uint64(p).astype(np.int64)),) for p in [*prints, *apart]]
    found = simhash.links(spark.createDataFrame(values, "fp long").distinct(), 4, segments).collect()
    pairs = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in found}
    assert {frozenset(prints[i : i + 2]) for i in range(0, len(prints), 2)} <= pairs
    assert all((a ^ b).bit_count() <= 4 for a, b in map(tuple, pairs))


def test_a_group_of_near_copies_does_not_become_all_its_pairs(spark):
    prints = sorted({sum(1 << b for b in random.Random(i).sample(range(64), 2)) for i in range(600)})
    df = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long")
    entries = simhash._entries(df, 4, 4).count()
    assert 0 < simhash.links(df, 4, 4).count() < entries
    cut = simhash._cells(simhash._entries(df, 4, 4), 64)
    assert cut.groupBy("cell").count().agg(F.max("count")).first()[0] < 4 * 64


def test_cost_chooses_longer_segments_for_more_fingerprints():
    chosen = [simhash.segments_by_cost(n, 4) for n in [0, 10**3, 10**6, 10**9, 10**12]]
    assert chosen == sorted(chosen, reverse=True) and chosen[0] > chosen[-1]


def test_empty_table(spark):
    out = simhash.simhash_components(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
