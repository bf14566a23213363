import io
import json

import pytest

from hornbeam.cli import main

PROGRAM = "edge(a, b). edge(b, c).\npath(X, Y) :- edge(X, Y).\npath(X, Y) :- edge(X, Z), path(Z, Y).\n?- path(a, W).\n"


@pytest.fixture
def file(tmp_path, spark):
    path = tmp_path / "g.dl"
    path.write_text(PROGRAM)
    return str(path)


def test_run(file, capsys):
    assert main(["run", file, "-q", "path(a, c)", "-q", "path(c, X)", "-s", "edge/2", "--strata", "--warn-undefined"]) == 0
    out, err = capsys.readouterr()
    assert out.startswith("% edge/2 (2 tuples)\n  edge(a, b).\n  edge(b, c).\n\n?- path(a, W).\n  W\n  -\n  b\n  c\n  2 answers.\n")
    assert "?- path(a, c).\n  yes." in out and "no answers." in out and err == "stratum 0: edge/2, path/2\n"


def test_run_json_and_demand(file, capsys):
    assert main(["run", file, "--json", "--show-all"]) == 0
    payload = json.loads(capsys.readouterr().out)
    assert payload["queries"][0] == {"query": "?- path(a, W).", "variables": ["W"], "rows": [["b"], ["c"]]}
    assert payload["relations"]["edge/2"] == [["a", "b"], ["b", "c"]] and payload["stats"]["tuples"] == 5
    assert main(["run", file, "--demand", "--stats", "-q", "path(X, Y)"]) == 0
    err = capsys.readouterr().err
    assert "not rewritten" in err and "iterations in" in err


def test_explain(file, capsys):
    assert main(["explain", "path(a, c)", file, "--facts"]) == 0
    assert capsys.readouterr().out == "edge(a, b).\nedge(b, c).\n"
    assert main(["explain", "path(c, a)", file]) == 1
    assert "path(c, a) is not derivable." in capsys.readouterr().err


def test_diff(file, capsys):
    assert main(["diff", file, "--add", "edge(c, d)", "--remove", "edge(a, b)", "--remove", "path(a, c)", "--only", "edge", "--stats"]) == 0
    out, err = capsys.readouterr()
    assert out == "- edge(a, b)\n+ edge(c, d)\n" and "1 added, 1 removed." in err and "nothing to retract" in err and "incremental" in err
    assert main(["diff", file, "--add", "edge(a, b)"]) == 0
    assert "no change." in capsys.readouterr().err


def test_check_and_errors(file, capsys, tmp_path):
    assert main(["check", file]) == 0 and "ok: 4 rules, 1 strata" in capsys.readouterr().err
    bad = tmp_path / "bad.dl"
    bad.write_text("p(X).")
    assert main(["check", str(bad)]) == 1 and "must be ground" in capsys.readouterr().err
    assert main(["run", str(tmp_path / "none.dl")]) == 1 and main([]) == 2
    bad.write_text("p(X) :- q(X), r(X). q(1).")
    assert main(["check", str(bad)]) == 0 and "r/1" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["--version"])


def test_session(file, capsys, monkeypatch, spark):
    lines = ["n(1).", "n(2).\n", "m(X) :-", "  n(X), X > 1.", "?- m(X).", ":list", ":preds", ":show m", ":why m(2)", ":retract n(2)", ":retract n(9)", "bad(X).", "?- m(X).", ":strata", ":stats", f":load {file}", ":nope", ":show", ":reset", ":list", ":help", ":quit"]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(lines) + "\n"))
    assert main(["repl"]) == 0
    out, err = capsys.readouterr()
    for part in ("ok (1 clause)", "  2\n  1 answer.", "  m(X) :- n(X), X > 1.", "n/1  2 tuples", "m(2).", "by  m(X)", "- m(2)", "n(9) is not a fact of this session.", "no answers.", "stratum 0", "rules total", "cleared", "(no rules loaded)", "Commands"):
        assert part in out, part
    assert "must be ground" in err and "unknown command :nope" in err and "usage: :show" in err
