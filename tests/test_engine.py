import random

import pytest

from hornbeam import Atom, Const, DeductiveError, Engine, EvaluationError, Literal, ParseError, Query, SafetyError, Var, solve

from naive import naive

CHAIN = "edge(a, b). edge(b, c). edge(c, d). "
PATH = "path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y). "


@pytest.mark.parametrize("rules", [PATH, "path(X, Y) :- edge(X, Y). path(X, Y) :- path(X, Z), edge(Z, Y).", "path(X, Y) :- edge(X, Y). path(X, Y) :- path(X, Z), path(Z, Y)."])
def test_closure(solved, rules):
    assert solved(CHAIN + rules, "path(X, Y)") == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert len(solved(CHAIN + "edge(d, a). " + rules, "path(X, Y)")) == 16


def test_selections(solved):
    p = "sent(kim, lee). sent(lee, lee). sent(kim, moe). sent(moe, moe). sent(moe, kim). "
    assert solved(p, "sent(X, X)") == [("lee",), ("moe",)]
    assert solved(p, "sent(kim, To)") == [("lee",), ("moe",)] and solved(p, "sent(From, kim)") == [("moe",)]
    assert solved(p, "sent(moe, _)") == [()] and solved(p, "sent(nia, _)") == []
    assert solved(p + "note(W, 7) :- sent(W, W).", "note(W, N)") == [("lee", 7), ("moe", 7)]


def test_joins(solved):
    p = "q(1). q(2). r(2). r(3). "
    assert solved(p, "q(X), r(Y), X < Y") == [(1, 2), (1, 3), (2, 3)]
    assert solved(p, "q(X), r(X)") == [(2,)]
    assert solved(p, "q(X), not r(X)") == [(1,)]
    assert len(solved(p, "q(X), r(Y)")) == 4
    assert solved(p + "u(X) :- q(X). u(X) :- r(X).", "u(X)") == [(1,), (2,), (3,)]


def test_zero_arity(solved):
    p = "rain. stock(0). wet :- rain. picnic :- not rain. shop :- wet, not stock(5). "
    assert solved(p, "wet") == [()] and solved(p, "picnic") == [] and solved(p, "shop, not picnic") == [()]


def test_mutual_recursion_and_same_generation(solved):
    succ = " ".join(f"s({k}, {k + 1})." for k in range(4))
    assert solved(succ + "even(0). odd(Y) :- even(X), s(X, Y). even(Y) :- odd(X), s(X, Y).", "even(X)") == [(0,), (2,), (4,)]
    family = "up(a, x). up(b, x). up(c, y). flat(x, y). down(x, a). down(y, c). sg(X, Y) :- flat(X, Y). sg(X, Y) :- up(X, A), sg(A, B), down(B, Y)."
    assert solved(family, "sg(X, Y)") == [("a", "c"), ("b", "c"), ("x", "y")]


def test_negation_over_recursion(solved):
    p = CHAIN + PATH + "node(X) :- edge(X, _). node(X) :- edge(_, X). far(X) :- node(X), not path(a, X)."
    assert solved(p, "far(X)") == [("a",)]
    assert solved("n(1). n(2). r(1, x). bare(X) :- n(X), not r(X, _).", "bare(X)") == [(2,)]


def test_arithmetic(solved):
    n = "n(6). n(7). "
    assert solved(n, "n(X), Y = X / 2") == [(6, 3), (7, 3.5)]
    assert [type(r[1]) for r in solved(n, "n(X), Y = X / 2")] == [int, float]
    assert solved(n, "n(X), Y = X % 4, Z = X % -4, W = -X % 4") == [(6, 2, -2, 2), (7, 3, -1, 1)]
    assert solved("n(7.5). ", "n(X), Y = X % -2, Z = X * 2") == [(7.5, -0.5, 15.0)]
    assert solved(n, "n(X), Y = -X + 2 * 3") == [(6, 0), (7, -1)]
    assert solved(n, "n(X), Y = (X - X % 2) / 2") == [(6, 3), (7, 3)]
    assert solved('part(door). tail("-42 b").', "part(P), tail(T), Tag = P + T") == [("door", "-42 b", "door-42 b")]


@pytest.mark.parametrize("goal, part", [("n(X), Y = X / 0", "division by zero"), ("n(X), Y = X % (X - X)", "division by zero"), ("s(X), Y = X + 1", "number"), ("s(X), Y = -X", "number"), ("n(X), Y = X * 9223372036854775807", "64 bits"), ("s(_), T = sum X { s(X) }", "sum")])
def test_runtime_errors(solved, goal, part):
    with pytest.raises(EvaluationError, match=part):
        solved("n(7). s(a).", goal)


def test_total_order(solved):
    v = 'v(2). v(1.5). v("b"). v(a). v(10). '
    assert solved(v, "v(X)") == [(1.5,), (2,), (10,), ("a",), ("b",)]
    assert solved(v, "v(X), X < a") == [(1.5,), (2,), (10,)]
    assert solved(v, "v(X), X >= a") == [("a",), ("b",)]
    assert solved(v, "L = min X { v(X) }, H = max X { v(X) }") == [(1.5, "b")]
    assert solved("p(1). p(2).", "p(X), X = 1.0") == [(1,)]
    assert solved("p(1). q(1.0).", "p(X), q(X)") == [(1,)]
    assert solved('p(1). q("1").', "p(X), q(X)") == [] and solved("p(1).", "p(X), X != a") == [(1,)]
    assert solved('p(1). q("1"). m(X) :- p(X). m(X) :- q(X).', "m(X)") == [(1,), ("1",)]


def test_assignments(solved):
    assert solved("q(1). q(2).", "Y = X, q(X)") == [(1, 1), (2, 2)]
    assert solved("q(1). q(2).", "q(X), Y = 2, X = Y") == [(2, 2)]
    assert solved("q(1).", "X = 3") == [(3,)]


def test_guards(spark):
    for how, part in (({"max_iterations": 5}, "fixpoint"), ({"max_tuples": 6}, "tuples")):
        engine = Engine(spark=spark, **how)
        engine.load("p(0). p(Y) :- p(X), Y = X + 1.")
        with pytest.raises(EvaluationError, match=part):
            engine.run()


def test_bounded_recursion_with_costs(solved):
    g = "e(a, b, 4). e(b, c, 1). e(a, c, 9). e(c, a, 2). c(X, Y, W) :- e(X, Y, W). c(X, Y, W) :- c(X, Z, A), e(Z, Y, B), W = A + B, W <= 20. s(X, Y, W) :- c(X, Y, _), W = min V { c(X, Y, V) }."
    assert solved(g, "s(a, X, W)") == [("a", 7), ("b", 4), ("c", 5)]


def test_api(spark):
    engine = Engine(spark=spark)
    queries = engine.load(CHAIN + PATH + "?- path(a, X).")
    assert [str(q) for q in queries] == ["?- path(a, X)."]
    result = engine.query(queries[0])
    assert result.variables == ["X"] and list(result) == [{"X": "b"}, {"X": "c"}, {"X": "d"}] and result[0] == {"X": "b"} and bool(result) and len(result) == 3
    assert result.df.columns == ["X"] and not result.is_ground and engine.query("path(a, d)").is_ground
    assert engine.query(Query((Literal(Atom("path", (Const("c"), Var("Z")))),))).rows == [("d",)]
    assert engine.query([Literal(Atom("edge", (Const("a"), Var("Z"))))]).rows == [("b",)]
    assert engine.predicates() == [("edge", 2), ("path", 2)]
    path = engine.relation("path")
    assert len(path) == 6 and ("a", "d") in path and path.sorted_tuples()[0] == ("a", "b")
    assert len(engine.relation("nothing")) == 0 and engine.predicates() == [("edge", 2), ("path", 2)]
    assert {k: engine.stats[k] for k in ("strata", "rules", "predicates", "tuples")} == {"strata": 1, "rules": 5, "predicates": 2, "tuples": 9}
    assert Engine(spark=spark).load("p(X) :- q(X), not r(X, _).") == []


def test_loading_is_all_or_nothing(spark):
    engine = Engine(spark=spark)
    for text, error in (("p(1). p(1, 2).", DeductiveError), ("p(1). q(X).", SafetyError), ("p(1). q(", ParseError)):
        with pytest.raises(error):
            engine.load(text)
    assert engine.rules == []
    engine.load("p(1). q(X) :- p(X), r(X), not s(X).")
    assert engine.undefined_predicates() == [("r", 1), ("s", 1)]
    engine.truncate_rules(1)
    assert len(engine.rules) == 1 and engine.reset().rules == []


def test_registered_tables(spark):
    engine = Engine(spark=spark)
    engine.register("edge", spark.createDataFrame([(1, 2), (2, 3), (2, 3), (None, 1)], "a int, b bigint"))
    engine.load(PATH + "named(X, N) :- path(X, _), N = 'it'.")
    assert engine.query("path(1, X)").rows == [(2,), (3,)]
    assert engine.query("edge(2, X)").rows == [(3,)]
    with pytest.raises(DeductiveError, match="arity"):
        engine.load("edge(1, 2, 3).")


def test_solve(spark):
    engine, results = solve(CHAIN + PATH + "?- path(b, X). ?- path(a, a).", spark=spark)
    assert [r.rows for _, r in results] == [[("c",), ("d",)], []] and engine.stats["tuples"] == 9


PROGRAMS = [
    PATH,
    "path(X, Y) :- edge(X, Y). path(X, Y) :- path(X, Z), path(Z, Y). two(X) :- path(X, Y), path(Y, X).",
    "node(X) :- edge(X, _). node(Y) :- edge(_, Y). " + PATH + "un(X, Y) :- node(X), node(Y), not path(X, Y). alone(X) :- node(X), not un(X, _).",
]


@pytest.mark.parametrize("seed", range(4))
def test_against_the_plain_evaluator(spark, seed):
    rng = random.Random(seed)
    for rules in PROGRAMS:
        edges = {(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(1, 9))}
        text = " ".join(f"edge({a}, {b})." for a, b in sorted(edges)) + rules
        engine, expected = Engine(spark=spark), naive(text)
        engine.load(text)
        for signature in engine.predicates():
            assert engine.relation(*signature).tuples == expected.get(signature, set()), (signature, text)


def test_no_limit_on_tuples_unless_given(spark):
    engine = Engine(spark=spark)
    engine.register("n", spark.range(5_000_001))
    engine.load("p(X) :- n(X).")
    assert len(engine.relation("p")) == 5_000_001
    engine = Engine(max_tuples=5_000_000, spark=spark)
    engine.register("n", spark.range(5_000_001))
    engine.load("p(X) :- n(X).")
    with pytest.raises(EvaluationError, match="limit of 5000000"):
        engine.run()


def test_rows_meet_once_in_cross_joins(spark):
    engine = Engine(spark=spark)
    many = spark.range(2000).selectExpr("id", "id % 3 k")
    engine.register("a", many).register("b", many)
    engine.load("pair(N, M) :- a(_, N), b(_, M).")
    found = engine.query("a(_, N), b(_, M)")
    assert found.rows == engine.query("pair(N, M)").rows == [(n, m) for n in range(3) for m in range(3)]
    plan = found.df._jdf.queryExecution().optimizedPlan().toString().split("Join Cross")[1]
    assert plan.count("Aggregate") == 2


def test_evaluation_bounds_memory_and_gives_settings_back(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold")
    before = [spark.conf.get(n) for n in names]
    engine, seen = Engine(spark=spark), []
    inner = engine._evaluate
    engine._evaluate = lambda: seen.append([int(spark.conf.get(n)) for n in names]) or inner()
    engine.load("p(1). q(X) :- p(X).")
    engine.run()
    assert seen == [[1 << 20, 4 << 20, 65_536]] and [spark.conf.get(n) for n in names] == before
    try:
        spark.conf.set(names[0], "-1")
        engine.run(force=True)
        assert seen[1][0] == -1 and spark.conf.get(names[0]) == "-1"
    finally:
        spark.conf.set(names[0], before[0])
