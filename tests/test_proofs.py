import pytest

from hornbeam import Condition, DeductiveError, Derivation, Engine
from hornbeam.plans.terms import Literal

PATH = "path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y). "


def engine(spark, text):
    out = Engine(spark=spark)
    out.load(text)
    return out


def test_tree(spark):
    rules = "needs(P, Q) :- uses(P, Q). needs(P, R) :- uses(P, Q), needs(Q, R). risky(P) :- needs(P, Q), flawed(Q, _)."
    e = engine(spark, "uses(shop, cart). uses(cart, tax). uses(mail, tax). flawed(tax, 9). " + rules)
    proof = e.explain("risky(shop)")
    lines = str(proof).splitlines()
    assert lines[0] == "risky(shop)   by  risky(P) :- needs(P, Q), flawed(Q, _)." and lines[-1] == "└─ flawed(tax, 9)"
    assert [x.lstrip("│├└─ ").split("   by")[0] for x in lines[1:-1]] == ["needs(shop, tax)", "uses(shop, cart)", "needs(cart, tax)", "uses(cart, tax)"]
    assert {str(a) for a in proof.support()} == {"uses(shop, cart)", "uses(cart, tax)", "flawed(tax, 9)"}
    assert proof.depth == 3 and len(list(proof.walk())) == len(lines) and len(proof.rules_used()) == 3
    assert proof.to_dict()["premises"][1] == {"fact": "flawed(tax, 9)"}
    assert e.explain("risky(tax)") is None and e.explain("flawed(tax, 9)").is_fact


def test_conditions(spark):
    e = engine(spark, "age(al, 20). adult(P) :- age(P, A), A >= 18. free(P) :- adult(P), not banned(P, _). next(Y) :- age(_, A), Y = A + 1. many(N) :- N = count { age(P, _) }.")
    assert "20 >= 18" in str(e.explain("adult(al)"))
    assert str(e.explain("free(al)")).splitlines()[-1] == "└─ not banned(al, _)   (no such fact)"
    assert "21 = (20 + 1)" in str(e.explain("next(21)"))
    assert "1 = count { age(P, _) }" in str(e.explain("many(1)"))


def test_cycles_and_choice(spark):
    e = engine(spark, "edge(a, b). edge(b, a). edge(b, c). edge(a, c). " + PATH)
    for fact in ("path(a, a)", "path(b, b)", "path(a, c)", "path(b, a)"):
        check(e, e.explain(fact))
    assert str(e.explain("path(a, c)")).count("by") == 1


def check(e, proof, above=()):
    """Every premise holds, and no fact rests on itself."""
    assert isinstance(proof, Derivation) and proof.atom not in above
    assert tuple(t.value for t in proof.atom.terms) in e.relation(*proof.atom.signature)
    assert len(proof.premises) == len(proof.rule.body)
    for premise, literal in zip(proof.premises, proof.rule.body):
        if isinstance(premise, Condition):
            assert not isinstance(literal, Literal) or literal.negated
        else:
            assert premise.atom.signature == literal.atom.signature
            check(e, premise, (*above, proof.atom))


def test_tables_and_errors(spark):
    e = Engine(spark=spark)
    e.register("edge", spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
    e.load(PATH)
    assert [str(a) for a in e.explain("path(1, 3)").support()] == ["edge(1, 2)", "edge(2, 3)"]
    with pytest.raises(DeductiveError, match="ground.*X"):
        e.explain("path(1, X)")
    from hornbeam import parse

    with pytest.raises(DeductiveError, match="track_derivations"):
        Engine(spark=spark).prove(parse("p(1).").rules[0].head)


def test_after_an_update(spark):
    e = engine(spark, "edge(a, b). edge(b, c). edge(a, c). " + PATH)
    assert e.explain("path(a, c)").depth == 1
    e.retract_fact("edge(a, c)")
    assert e.explain("path(a, c)").depth == 2
