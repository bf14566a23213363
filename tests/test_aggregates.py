SALES = "person(al). person(bo). person(ca). sale(al, 1). sale(al, 2). sale(al, 2). sale(bo, 5). "


def test_grouped(solved):
    assert solved(SALES, "person(P), N = count { sale(P, _) }") == [("al", 2), ("bo", 1), ("ca", 0)]
    assert solved(SALES, "person(P), N = sum X { sale(P, X) }") == [("al", 3), ("bo", 5), ("ca", 0)]
    assert solved(SALES, "person(P), N = max X { sale(P, X) }") == [("al", 2), ("bo", 5)]
    assert solved(SALES, "person(P), N = avg X { sale(P, X) }") == [("al", 1.5), ("bo", 5)]


def test_global(solved):
    s = "depth(7). depth(-3). depth(12). depth(0). depth(-6). "
    assert solved(s, "A = avg D { depth(D) }, H = max D { depth(D) }, L = min D { depth(D) }, S = sum D { depth(D) }") == [(2, 12, -6, 10)]
    assert solved(s, "N = count { depth(D), D > 50 }") == [(0,)] and solved(s, "H = max D { depth(D), D > 50 }") == []
    assert solved(s, "T = sum D * D { depth(D), D < 0 }") == [(45,)]


def test_distinct_over_all_local_variables(solved):
    r = "trip(ida, 30, bus). trip(ida, 30, tram). trip(ida, 45, bus). trip(jon, 45, bus). who(ida). who(jon). "
    assert solved(r, "who(W), N = count { trip(W, _, _) }") == [("ida", 3), ("jon", 1)]
    assert solved(r, "who(W), N = count { trip(W, Km, _) }") == [("ida", 3), ("jon", 1)]
    assert solved(r + "far(W, Km) :- trip(W, Km, _).", "who(W), N = count { far(W, _) }") == [("ida", 2), ("jon", 1)]
    assert solved(r, "who(W), T = sum Km { trip(W, Km, _) }") == [("ida", 105), ("jon", 45)]


def test_nested_and_chained(solved):
    d = "hall(n). hall(s). hall(w). seat(n, 40). seat(n, 25). seat(s, 70). seat(w, 5). seat(w, 15). "
    assert solved(d, "T = max C { hall(H), C = sum X { seat(H, X) } }") == [(70,)]
    assert solved(d + "rows(H, N) :- hall(H), N = count { seat(H, _) }.", "M = min N { rows(_, N) }, W = count { rows(H, M) }") == [(1, 1)]
    assert solved(d, "hall(H), N = count { seat(H, _) }, N >= 2") == [("n", 2), ("w", 2)]
    assert solved(d, "hall(H), N = 2, N = count { seat(H, _) }") == [("n", 2), ("w", 2)]


def test_bodies_that_need_outer_values(solved):
    assert solved("k(1). k(3). s(1). s(2).", "k(K), N = count { s(X), X < K }") == [(1, 0), (3, 2)]
    assert solved("k(2). s(1). s(2).", "k(K), T = sum X * K { s(X) }") == [(2, 6)]


def test_over_joins_negation_and_recursion(solved):
    g = "edge(a, b). edge(b, c). path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y). node(X) :- edge(X, _). node(X) :- edge(_, X). "
    assert solved(g, "node(X), N = count { path(X, _) }") == [("a", 2), ("b", 1), ("c", 0)]
    assert solved(g, "node(X), N = count { node(Y), not path(X, Y) }") == [("a", 1), ("b", 2), ("c", 3)]


def test_answers_of_a_query_leave_out_local_variables(solved):
    assert solved(SALES, "N = count { sale(P, X) }") == [(3,)]
