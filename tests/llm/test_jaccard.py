import random
from collections import defaultdict

import numpy as np
import pytest

from hornbeam.llm.graph import components
from hornbeam.llm.jaccard import compare, near_duplicates, one_of_each, overlap_possible, shingle_sets

_LOW = {c: c + 32 for c in range(65, 91)}


def plain_sets(rows):
    out = []
    for d, t in rows:
        w = (t or "").translate(_LOW).encode().split()
        out.append((d, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (d, _) in enumerate(sets):
        least[find(k)].append(d)
    return sorted((d, len(s), min(least[find(k)])) for k, (d, s) in enumerate(sets))


def family(rng, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(rng.randint(2, 12)):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_families(docs, seed):
    rng = random.Random(seed)
    texts = [t for _ in range(8) for t in family(rng, rng.choice([3, 6, 9, 30, 120]), rng.choice([1, 2, 4]))]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    assert sorted(map(tuple, near_duplicates(docs(rows)).collect())) == plain(rows)


def test_chains_are_followed(docs):
    """Each links to the next only; the ends are far apart."""
    words = [f"w{k}" for k in range(400)]
    rows = [(50 - k, " ".join(words[8 * k : 8 * k + 200])) for k in range(20)]
    got = sorted(map(tuple, near_duplicates(docs(rows)).collect()))
    assert got == plain(rows) and {r[2] for r in got} == {31}


def test_a_large_family_with_a_hot_passage(docs):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for d in range(700):
        copy = list(base)
        for at in rng.sample(range(150), 2):
            copy[at] = f"x{d}y{at}"
        rows.append((d, " ".join(copy)))
    rows += [(1000 + d, " ".join([*base[:60], *[f"z{d}q{k}" for k in range(90)]])) for d in range(300)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows)).collect()}
    want = {d: c for d, _, c in plain(rows)}
    assert got == want


def test_odd_rows(odd, docs):
    got = sorted([tuple(r) for r in near_duplicates(odd).collect()], key=repr)
    assert len(got) == odd.count() and [r for r in got if r[0] in (1, 2, 4, 9)] == [(d, 0, d) for d in (1, 2, 4, 9)] and got.count((7, 1, 7)) == 2
    assert near_duplicates(docs([])).collect() == []
    assert near_duplicates(odd.selectExpr("*", "1 AS class", "2 AS token", "3 AS root")).count() == odd.count()
    rows = [(5, "A b C d e f"), (3, "a B c D e f"), (9, "a b c d e f"), (9, "a b c d e f"), (11, "Short Text"), (12, "short text"), (13, "É b c d e"), (14, "é b c d e")]
    assert sorted(map(tuple, near_duplicates(docs(rows)).collect())) == plain(rows)
    assert sorted(r.doc_id for r in one_of_each(docs(rows)).collect()) == [3, 11, 13, 14]


def test_one_of_each_with_repeated_ids(docs):
    twin, alone, near = ("one text of words that stands twice", "quite another text that stands here alone", "near " + " ".join(f"w{k}" for k in range(60)))
    rows = [(3, twin), (5, twin), (5, alone), (6, near), (6, near + " end"), (None, twin), (7, ""), (8, None)]
    got = sorted([(r.doc_id, r.text) for r in one_of_each(docs(rows)).collect()], key=repr)
    assert [x for x in got if x[0] != 6] == sorted([(3, twin), (5, alone), (7, ""), (8, None)], key=repr) and [x[0] for x in got].count(6) == 1


def test_sets_and_overlap():
    texts = ["a b c d e f a b c d e f", None, "x", "A B c d e f", ""]
    assert [len(s) for s in shingle_sets(texts)] == [len(s) for _, s in plain_sets(enumerate(texts))]
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**64, 40, np.uint64) >> np.uint64(58) << np.uint64(58)) for _ in range(2))
        common = len(set(a.tolist()) & set(b.tolist()))
        assert overlap_possible(a, b, common)
        linked, found, beyond = compare(a, b, 80)
        assert linked == (100 * common >= 80 * len(set(a.tolist()) | set(b.tolist())))
        assert found is None or (found == common and {x % 2**64 for x in beyond} == set(b.tolist()) - set(a.tolist()))


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(7, k) for k in range(1000, 1200)] + [(3, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 181)}, **{k: 7 for k in range(1000, 1200)}, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_families_about_the_threshold(docs, seed):
    """Members of many sizes that link by chance, with passages that the first of them lacks."""
    rng = random.Random(seed)
    rows = []
    for f in range(3):
        base = [f"f{f}w{k}" for k in range(rng.choice([40, 70]))]
        hot = [f"f{f}h{k}" for k in range(12)]
        for _ in range(45):
            copy = list(base) if rng.random() < 0.6 else [*base[:20], *hot, *base[20:]]
            for at in rng.sample(range(len(copy)), rng.randint(0, 2)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.choice([0, 0, 3, 9, 15])])))
    rows = [(d, t) for d, (_, t) in zip(rng.sample(range(10_000), len(rows)), rows)]
    want = plain(rows)
    assert len({c for _, _, c in want}) > 5 and sorted(map(tuple, near_duplicates(docs(rows)).collect())) == want
