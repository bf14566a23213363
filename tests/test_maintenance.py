import random

import pytest

from hornbeam import DeductiveError, Engine, EvaluationError, StratificationError

PATH = "path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y). "


def engine(spark, text):
    out = Engine(spark=spark)
    out.load(text)
    return out


def test_assert_and_retract(spark):
    e = engine(spark, "edge(a, b). edge(b, c). " + PATH)
    assert str(e.assert_fact("edge(c, d)")) == "+ edge(c, d)\n+ path(a, d)\n+ path(b, d)\n+ path(c, d)"
    delta = e.retract_fact("edge(b, c)")
    assert str(delta) == "- edge(b, c)\n- path(a, c)\n- path(a, d)\n- path(b, c)\n- path(b, d)"
    assert delta.stats["mode"] == "incremental" and len(delta) == 5 and delta.predicates == [("edge", 2), ("path", 2)]
    assert delta.removed["path", 2] == {("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")} and not delta.added
    assert e.query("path(X, Y)").rows == [("a", "b"), ("c", "d")]


def test_what_has_another_support_stays(spark):
    e = engine(spark, "edge(a, b). edge(b, c). edge(a, c). path(a, b). " + PATH)
    assert str(e.retract_fact("edge(a, c)")) == "- edge(a, c)"
    assert str(e.retract_fact("edge(a, b)")) == "- edge(a, b)\n- path(a, c)"
    assert not e.retract_fact("path(b, c)") and e.is_asserted("path(a, b)") and not e.is_asserted("path(b, c)")


def test_no_change(spark):
    e = engine(spark, "edge(a, b). " + PATH)
    assert not e.update() and not e.assert_fact("edge(a, b)") and not e.retract_fact("edge(x, y)")
    assert not e.update(add=["edge(a, b)"], remove=["edge(a, b)"]) and e.query("edge(a, b)")
    with pytest.raises(DeductiveError, match="ground.*X"):
        e.assert_fact("edge(a, X)")


def test_negation_moves_both_ways(spark):
    e = engine(spark, "item(a). item(b). blocked(a). free(X) :- item(X), not blocked(X).")
    assert str(e.retract_fact("blocked(a)")) == "- blocked(a)\n+ free(a)"
    assert str(e.assert_fact("blocked(b)")) == "+ blocked(b)\n- free(b)"


def test_aggregates_move(spark):
    e = engine(spark, "person(al). owns(al, x). owns(al, y). total(P, N) :- person(P), N = count { owns(P, _) }.")
    assert str(e.assert_fact("owns(al, z)")) == "+ owns(al, z)\n- total(al, 2)\n+ total(al, 3)"


def test_unknown_predicates_and_types_are_evaluated_anew(spark):
    e = engine(spark, "edge(a, b). " + PATH)
    delta = e.assert_fact("brand(new)")
    assert delta.stats["mode"] == "recompute" and str(delta) == "+ brand(new)"
    assert str(e.assert_fact("edge(b, 1)")) == "+ edge(b, 1)\n+ path(a, 1)\n+ path(b, 1)"


def test_registered_rows_can_be_retracted(spark):
    e = Engine(spark=spark)
    e.register("edge", spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
    e.load(PATH)
    assert str(e.retract_fact("edge(2, 3)")) == "- edge(2, 3)\n- path(1, 3)\n- path(2, 3)"
    assert str(e.assert_fact("edge(2, 4)")) == "+ edge(2, 4)\n+ path(1, 4)\n+ path(2, 4)"
    assert sorted(map(tuple, e.relation("edge").df.collect())) == [(1, 2), (2, 4)]


def test_a_failed_change_leaves_everything(spark):
    e = engine(spark, "n(1). m(X, Y) :- n(X), Y = 10 / X.")
    assert e.query("m(X, Y)").rows == [(1, 10)]
    with pytest.raises(DeductiveError, match="division"):
        e.assert_fact("n(0)")
    assert e.query("m(X, Y)").rows == [(1, 10)] and not e.is_asserted("n(0)")


PROGRAMS = [
    PATH,
    "path(X, Y) :- edge(X, Y). path(X, Y) :- path(X, Z), path(Z, Y). un(X, Y) :- node(X), node(Y), not path(X, Y).",
    PATH + "deg(X, N) :- node(X), N = count { path(X, _) }. top(X) :- deg(X, N), N > 1, not edge(X, X).",
]


@pytest.mark.parametrize("number", range(3))
def test_maintained_equals_fresh(spark, number):
    rng, rules = random.Random(number), PROGRAMS[number]
    nodes = "".join(f"node({k}). " for k in range(4))
    edges = {(rng.randrange(4), rng.randrange(4)) for _ in range(4)}
    e = engine(spark, nodes + "".join(f"edge({a}, {b}). " for a, b in sorted(edges)) + rules)
    before = {s: set(e.relation(*s).tuples) for s in e.predicates()}
    for _ in range(4):
        add = {(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(2))}
        gone = {x for x in sorted(edges) if rng.random() < 0.3} - add
        delta = e.update(add=[f"edge({a}, {b})" for a, b in sorted(add)], remove=[f"edge({a}, {b})" for a, b in sorted(gone)])
        edges = (edges - gone) | add
        fresh = engine(spark, nodes + "".join(f"edge({a}, {b}). " for a, b in sorted(edges)) + rules)
        after = {s: set(e.relation(*s).tuples) for s in e.predicates()}
        for s in before:
            assert after[s] == fresh.relation(*s).tuples, (s, edges)
            assert delta.added.get(s, set()) == after[s] - before[s] and delta.removed.get(s, set()) == before[s] - after[s]
        before = after


def test_rules_must_stay_stratified(spark):
    e = engine(spark, "p(X) :- q(X), not p(X). q(1).")
    with pytest.raises(StratificationError):
        e.run()


def test_a_stream_feeds_updates(spark, tmp_path):
    from hornbeam.streaming import feed

    spark.createDataFrame([("b", "c", "+"), ("a", "b", "-")], "x string, y string, op string").coalesce(1).write.parquet(str(tmp_path / "in"))
    e = engine(spark, "edge(a, b). " + PATH)
    e.run()
    seen = []
    stream = spark.readStream.schema("x string, y string, op string").parquet(str(tmp_path / "in"))
    feed(e, stream, "edge", op="op", on_change=seen.append).awaitTermination()
    assert "\n".join(map(str, seen)) == "- edge(a, b)\n+ edge(b, c)\n- path(a, b)\n+ path(b, c)"
    assert e.query("path(X, Y)").rows == [("b", "c")]


def test_facts_are_looked_up_by_one_scan(spark, tmp_path):
    """However many facts are added, a registered table is read a fixed number of times; a new predicate reads none of it."""
    spark.range(2000).selectExpr("id", "id + 1 AS next").write.parquet(str(tmp_path / "step"))
    e = Engine(spark=spark)
    e.register("step", spark.read.parquet(str(tmp_path / "step")))
    e.load("pair(X, Z) :- mark(X), step(X, Y), step(Y, Z). mark(1).")
    e.run()
    seen = []
    held = e._in_base
    e._in_base = lambda *f: seen.append(f) or held(*f)
    delta = e.update(add=[f"step({k}, {k + 1})" for k in range(10, 60)] + ["step(3, 90)", "mark(3)"], remove=["step(1, 2)", "step(5, 99)"])
    assert not seen and {str(a) for a in delta.added_facts()} == {"step(3, 90)", "mark(3)", "pair(3, 5)", "pair(3, 91)"}
    assert {str(a) for a in delta.removed_facts()} == {"step(1, 2)", "pair(1, 3)"}
    other = e.update(add=["colour(red)"])
    assert other.stats["mode"] == "recompute" and str(other) == "+ colour(red)"


def test_integers_beyond_64_bits_are_refused(spark):
    e = Engine(spark=spark)
    e.load("big(99999999999999999999).")
    with pytest.raises(EvaluationError, match="64 bits"):
        e.query("big(X)").rows
