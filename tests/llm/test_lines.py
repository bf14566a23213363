import random

import pytest

from hornbeam.llm.common import hot_slots, spread_join
from hornbeam.llm.lines import common_blocks, deduplicate_lines, part_spans, patience, run_spans
from hornbeam.llm.queries import op10_lines

from conftest import DIR


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_patience_matches_in_order():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= longest(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    unique = rng.sample(range(100), 20)
    assert len(patience(unique, unique[5:])) == 15 and patience([1, 2, 3], [1, 9, 3]) == [(0, 0), (2, 2)]


def test_blocks():
    words = [10, 10, 10, 10, 10]
    assert common_blocks([1, 2, 3, 9], [8, 1, 2, 3, 7], words, 20) == [1, 2, 3]
    assert common_blocks([1, 9], [8, 1, 7], words, 20) == [] and common_blocks([5, 1, 2], [1, 2], [1, 1], 20) == [0, 1]
    assert common_blocks([1, 0, 2], [8, 1, 0, 2], [10, 10, 0, 10], 20) == [1, 3]


def plain(rows, min_words):
    """Texts without the blocks that any earlier document holds, found by comparing every line with every line."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    docs = sorted(((d, (t or "").split("\n")) for d, t in rows), key=lambda r: r[0])
    full = [[k for k, x in enumerate(lines) if strip(x)] for _, lines in docs]
    out = {}
    for c, (d, lines) in enumerate(docs):
        own, gone = [strip(lines[k]) for k in full[c]], set()
        for a in range(c):
            other = [strip(docs[a][1][k]) for k in full[a]]
            for i in range(len(other)):
                for j in range(len(own)):
                    n = 0
                    while i + n < len(other) and j + n < len(own) and other[i + n] == own[j + n]:
                        n += 1
                    if n and (n == len(own) or sum(len(x.split()) for x in own[j : j + n]) >= min_words):
                        gone |= set(full[c][j : j + n])
        out[d] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_version(docs, seed):
    """All earlier documents are looked at: lines that stand in many, blocks in other orders, short and whole texts."""
    rng = random.Random(seed)
    pool = [" ".join(f"l{k}w{j}" for j in range(rng.randint(1, 15))) for k in range(25)] + [""]
    runs = [[rng.choice(pool) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    line = lambda d, j: rng.choice([[rng.choice(pool)], rng.choice(runs), [f"own {d} {j}"]])
    rows = [(d, "\n".join(x for j in range(rng.randint(1, 6)) for x in line(d, j))) for d in rng.sample(range(500), 90)]
    rows += [(900, rows[0][1]), (901, rows[0][1] + "\nmore"), (902, "\n".join(rows[1][1].split("\n")[-2:]))]
    least = (8, 20)[seed % 2]
    assert {r.doc_id: r.text for r in deduplicate_lines(docs(rows), min_words=least).collect()} == plain(rows, least)


def test_moved_and_short_blocks(docs):
    line = lambda k, n=11: " ".join(f"m{k}w{j}" for j in range(n))
    x, y = "\n".join([line(1), line(2)]), "\n".join([line(3), line(4), line(5)])
    rows = [(1, f"{x}\n{y}"), (2, f"{y}\nown line\n{x}"), (3, "yes\nfirst"), (4, "second\nno"), (5, "a\nyes\nno\nb"), (6, "yes\nno"), (7, "yes\n\nno"), (8, "no\nyes")]
    got = {r.doc_id: r.text for r in deduplicate_lines(docs(rows)).collect()}
    assert got == {**dict(rows), 2: "own line", 6: "", 7: ""} and got == plain(rows, 20)


def test_spans_and_hot_keys(spark):
    assert run_spans([10, 10, 10], 20) == [(0, 2), (1, 3)] and run_spans([25, 1], 20) == [(0, 1), (0, 2)] and run_spans([3, 4], 20) == [(0, 2)] and run_spans([], 20) == []
    assert part_spans([10, 9, 8], 20) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    many = spark.range(40_000).selectExpr("id", "if(id < 30000, 7, id) AS k")
    hot = hot_slots(many, "k")
    assert len(hot) == 1 and hot_slots(many, "id") == []
    joined = spread_join(many, spark.range(40_000).selectExpr("id AS k", "id AS own"), "k", hot)
    assert joined.where("own = k").count() == 40_000 and joined.where("k = 7").select("id").distinct().count() == 30_000


def test_a_block_of_lines_that_stand_elsewhere(docs):
    block = [" ".join(f"b{k}w{j}" for j in range(8)) for k in range(4)]
    rows = [(k, f"{x}\nown line of {k}") for k, x in enumerate(block)]
    rows += [(10, "\n".join(["own of ten", *block])), (11, "\n".join(["own of eleven", *block[:2], "", *block[2:], "end"]))]
    got = {r.doc_id: r.text for r in deduplicate_lines(docs(rows)).collect()}
    assert got == {**dict(rows), 11: "own of eleven\n\nend"}


def test_a_rare_line_shields_no_passage(docs):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(20)) for k in range(3))
    rows = [(1, "Chapter one\nown words of the first")] + [(d, f"own start {d}\n{passage}\nown end {d}") for d in range(2, 31)]
    rows += [(31, f"Chapter one\n{passage}\nown end 31"), (32, f"own start 32\n{passage}")]
    got = {r.doc_id: r.text for r in deduplicate_lines(docs(rows)).collect()}
    assert got[2] == rows[1][1] and got[31] == "Chapter one\nown end 31" and got[32] == "own start 32"


def test_query_keeps_first_copies(spark, sample):
    got = {r.doc_id: r for r in op10_lines(spark, DIR).collect()}
    first: dict[str, int] = {}
    for r in sorted(sample.collect(), key=lambda r: r.doc_id):
        if r.text in first:
            assert got[r.doc_id].n_removed == got[r.doc_id].n_lines
        first.setdefault(r.text, r.doc_id)
    assert len(got) == sample.count() and any(r.n_removed for r in got.values())


def test_odd_rows(odd, docs):
    got = deduplicate_lines(odd).collect()
    assert len(got) == odd.count() and [r.text for r in got if r.doc_id == 1] == [None] and {r.n_lines for r in got if r.doc_id in (1, 2, 4)} == {0}
    assert deduplicate_lines(docs([])).collect() == []
    odd_names = deduplicate_lines(odd.selectExpr("*", "1 AS text_hash", "2 AS found", "3 AS found_id"))
    assert {(r.text_hash, r.found, r.found_id) for r in odd_names.collect()} == {(1, 2, 3)}
    clash = deduplicate_lines(odd.selectExpr("*", "1 AS key", "2 AS gone", "3 AS n_lines"))
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "gone", "n_lines", "n_removed"] and {r.key for r in clash.collect()} == {1}
    rows = [(None, "x y\nz"), (4, "x y\nz"), (4, "x y\nz"), (5, "x y\nz\nq")]
    got = deduplicate_lines(docs(rows), min_words=2).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted([(None, "x y\nz"), (4, ""), (4, ""), (5, "q")], key=repr)


def test_a_line_in_all_documents(docs):
    rows = [(k, f"own line {k}\n" + "common " * 25 + f"\nend {k}") for k in range(2000)]
    got = {r.doc_id: r.text for r in deduplicate_lines(docs(rows)).collect()}
    assert got[0] == rows[0][1] and got[1999] == "own line 1999\nend 1999"
