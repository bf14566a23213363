import random

import pytest

from hornbeam import Engine

PATH = "path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y). "


def engine(spark, text):
    out = Engine(spark=spark)
    out.load(text)
    return out


def test_islands_derive_less(spark):
    edges = "".join(f"edge(n{i}x{k}, n{i}x{k + 1}). " for i in range(6) for k in range(7))
    e = engine(spark, edges + PATH)
    found = e.query("path(n0x0, W)", demand=True)
    assert found.rows == e.query("path(n0x0, W)").rows and len(found) == 7
    assert found.stats["tuples"] - 42 < (e.stats["tuples"] - 42) / 3
    assert e.query("path(n0x0, n1x3)", demand=True).rows == []


@pytest.mark.parametrize("goal", ["path(X, Y)", "edge(a, X)", "total(N), path(a, X)"])
def test_declines(spark, goal):
    e = engine(spark, "edge(a, b). edge(b, c). total(N) :- N = count { path(_, _) }. " + PATH)
    found = e.query(goal, demand=True)
    assert found.stats is None and found.rows == e.query(goal).rows


def test_facts_of_derived_predicates_and_negation(spark):
    e = engine(spark, "edge(a, b). edge(b, c). path(c, z). stop(b). free(X, Y) :- path(X, Y), not stop(Y). " + PATH)
    for goal in ("path(a, W)", "free(a, W)", "path(b, W), not path(W, z)"):
        assert e.query(goal, demand=True).rows == e.query(goal).rows


def test_over_registered_tables(spark):
    e = Engine(spark=spark)
    e.register("edge", spark.createDataFrame([(k, k + 1) for k in range(30)], "a int, b int"))
    e.load(PATH)
    found = e.query("path(25, W)", demand=True)
    assert found.stats is not None and found.rows == [(k,) for k in range(26, 31)]


@pytest.mark.parametrize("seed", range(3))
def test_same_answers_on_random_graphs(spark, seed):
    rng, fired = random.Random(seed), 0
    rules = [PATH, "path(X, Y) :- edge(X, Y). path(X, Y) :- path(X, Z), path(Z, Y). ", PATH + "back(X, Y) :- path(X, Y), not path(Y, X). "]
    for text in rules:
        edges = " ".join(f"edge({rng.randrange(5)}, {rng.randrange(5)})." for _ in range(7))
        e = engine(spark, edges + text)
        for goal in ("path(1, X)", "path(X, 2)") + (("back(1, X)",) if "back" in text else ()):
            found = e.query(goal, demand=True)
            fired += found.stats is not None
            assert found.rows == e.query(goal).rows
    assert fired >= 4
