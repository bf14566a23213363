import random
import re
from collections import Counter

from hornbeam.llm import rules
from hornbeam.llm.rules import quality_rules, remove_common_lines


def base(text):
    t = text or ""
    w = t.encode().split()
    fives = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if fives[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def check(table, rows, **how):
    got = quality_rules(table, **how).collect()
    want = sorted([(d, *base(t)) for d, t, *_ in rows], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=repr) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    return got


def test_base_figures(sample, docs):
    check(sample, [(r.doc_id, r.text) for r in sample.collect()])
    rng = random.Random(0)
    rows = [(d, "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randint(0, 300)))) for d in range(60)]
    check(docs(rows), rows)


def test_odd_rows(odd, docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(check(odd, rows)) == len(rows)
    check(odd.selectExpr("*", "1 AS host", "2 AS w", "3 AS line", "4 AS text_hash"), rows)
    assert quality_rules(docs([])).collect() == []
    assert len(check(docs([(1, "a b", "en", None, 1)]), [(1, "a b")])) == 1


def test_common_lines_deplete(docs):
    common = "this very line is the boiler plate of the whole site and more"
    rows = [(k, f"{common}\n" + " ".join(f"own{k}w{j}" for j in range(40 if k % 2 else 3)), "en", "h", 1) for k in range(100)]
    rows += [(1000 + k, f"{common}\n" + " ".join(f"o{k}w{j}" for j in range(3)), "en", "other", 1) for k in range(10)]
    got = {r.doc_id: r for r in quality_rules(docs(rows)).collect()}
    assert got[1].kept and got[1].n_common_words == 13 and not got[2].kept and not got[2].base_failed
    assert got[1000].kept and got[1000].n_common_words == 0  # ten documents of that host are within its limit
    apart = [(k, f"{common} {'' if k < 12 else ' '}\nown{k} words", "en", None if k < 12 else "", 1) for k in range(24)]
    assert {r.n_common_words for r in quality_rules(docs(apart)).collect()} == {0}  # twelve of each host, null and empty
    copies = docs([(k, "one and the same text of more than ten words stands here again and again", "en", "h", 1) for k in range(100)])
    assert all(r.kept for r in quality_rules(copies).collect())


def normal(line):
    return " ".join(w.decode() for w in line.encode().split()).lower()


def plain_common(rows, share=0.02, least=20, copies=False):
    """Brute force over (doc_id, text, host): the lines above the limits of each host."""
    texts, spread = {}, {}
    for at, (_, text, host) in enumerate(rows):
        texts.setdefault(host, set()).add(at if copies else text or "")
        for line in {normal(x) for x in (text or "").split("\n")} - {""}:
            spread.setdefault((host, line), set()).add(at if copies else text)
    return {k for k, v in spread.items() if len(v) > least and len(v) > share * len(texts[k[0]])}


def test_common_lines_against_brute_force(docs):
    rng = random.Random(5)
    pool = ["Home  page", " home page ", "A b\tc", "\ta B c\r", "x\x0by", "", " ", "çé Ü", "one more line", "and \x0c this"]
    rows = []
    for d in range(160):
        own = [f"own {d} {k} word" for k in range(rng.randint(0, 6))]
        lines = own + [rng.choice(pool) for _ in range(rng.randint(0, 5))]
        rng.shuffle(lines)
        rows.append((d, None if d % 40 == 0 else "\n".join(lines), rng.choice(["h", "h", "g", "", None])))
    rows += [(200 + k, "the same copy\nof this text", "g") for k in range(60)] + [rows[3]] * 3
    table = docs([(d, t, "en", h, 1) for d, t, h in rows])
    for how in ({"least": 9, "share": 0.02}, {"least": 3, "share": 0.2}, {"least": 9, "share": 0.02, "copies": True}):
        hot = plain_common(rows, **how)
        assert hot
        want = sorted(((d, sum(len(normal(x).split()) for x in (t or "").split("\n") if (h, normal(x)) in hot)) for d, t, h in rows), key=repr)
        assert sorted(((r.doc_id, r.n_common_words) for r in quality_rules(table, **how).collect()), key=repr) == want
        clean = [(d, None if t is None else "\n".join(x for x in t.split("\n") if (h, normal(x)) not in hot)) for d, t, h in rows]
        assert sorted(((r.doc_id, r.text) for r in remove_common_lines(table, **how).collect()), key=repr) == sorted(clean, key=repr)


def test_removal_keeps_columns_and_odd_rows(odd, docs):
    clash = odd.selectExpr("*", "1 AS host", "2 AS own_host", "3 AS gone_lines", "4 AS text_hash", "5 AS row")
    out = remove_common_lines(clash)
    assert out.columns == clash.columns and out.count() == odd.count()
    assert remove_common_lines(docs([])).collect() == []


def test_only_native_operators(sample, monkeypatch):
    plans = []
    write = rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df, name: plans.append(df) or write(df, name))
    plans += [quality_rules(sample), remove_common_lines(sample)]
    assert len(plans) == 4
    for df in plans:
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
