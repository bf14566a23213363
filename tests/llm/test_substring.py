import random

import numpy as np
import pytest

from hornbeam.llm.common import WordHashes, windows
from hornbeam.llm.substring import anchors, deduplicate


def plain(rows, size=13):
    """(doc_id, n_words, n_removed, kept) by looking every window up."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, w in split:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, w in split:
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < d for j in range(size)}
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(docs, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(4)}" for _ in range(rng.randint(10, 40))] for k in range(6)]
    rows = []
    for d in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.6 else [f"u{rng.randrange(9)}" for _ in range(rng.randint(1, 20))]
        rows.append((d, rng.choice([" ", "  ", "\n"]).join(words)))
    assert sorted(map(tuple, deduplicate(docs(rows)).collect())) == plain(rows)


def test_every_full_window_has_an_anchor():
    h = WordHashes().of([b"%d" % (k * k % 17) for k in range(80)])
    short, least = anchors(h, 13)
    assert len(short) == 74 and len(least) == 68 and all(k <= p <= k + 6 for k, p in enumerate(least))
    assert all(short[p] == short[k : k + 7].min() for k, p in enumerate(least))
    assert len(windows(h, 13)) == 68


def test_odd_rows(odd, docs):
    got = sorted(map(tuple, deduplicate(odd).collect()), key=repr)
    assert [r[:3] for r in got if r[0] in (1, 2, 4, 9)] == [(1, 0, 0), (2, 0, 0), (4, 0, 0), (9, 0, 0)]
    assert len(got) == odd.count() and (8, 180_000, 0) in [r[:3] for r in got]
    assert deduplicate(docs([])).collect() == []
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(3, text), (3, text), (4, text + " more"), (4, "other " + text), (None, text)]
    got = sorted([(r.doc_id, r.n_removed, r.kept) for r in deduplicate(docs(rows)).collect()], key=repr)
    assert got == sorted([(3, 20, ""), (3, 20, ""), (4, 20, "more"), (4, 20, "other"), (None, 0, text)], key=repr)
    assert deduplicate(odd.selectExpr("*", "1 AS key", "2 AS places", "3 AS n_words")).count() == odd.count()


def test_one_passage_in_all_documents(docs):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(3000)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in deduplicate(docs(rows)).collect()}
    assert got[0] == (0, rows[0][1]) and all(got[k] == (30, f"a{k} b{k} c{k}") for k in range(1, 3000))


def test_words_are_compared_exactly():
    assert not np.array_equal(windows(WordHashes().of([b"a", b"b"]), 2), windows(WordHashes().of([b"b", b"a"]), 2))
