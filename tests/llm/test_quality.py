import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hornbeam.llm.quality import BUCKETS, LABELLERS, LabelModel, classify, features, pattern_of, train, variety, votes, votes_of
from hornbeam.llm.queries import op1_quality

DIR = "/root/testdata/sf0.01"


def test_agrees_with_the_labels(spark):
    got = {r.doc_id: r for r in op1_quality(spark, DIR).collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    good, bad = ([got[r.doc_id].kept for r in labels if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) >= 0.97 and 1 - sum(bad) / len(bad) >= 0.9


def test_variety_does_not_fall_with_length():
    rng = np.random.default_rng(0)
    draw = lambda n: [b"w%d" % k for k in rng.zipf(1.3, n) % 5000]
    assert abs(variety(draw(4000)) - variety(draw(400_000))) < 0.03
    assert variety([]) == 0 and variety([b"a", b"b", b"a"]) == 2 / 3 and variety([b"a", b"b"] * 3000) < 0.01


@pytest.mark.parametrize("lang", ["en", "de"])
def test_a_clean_document_of_many_words_is_kept(spark, lang):
    large = DIR.replace("sf0.01", "sf0.1")
    clean = spark.read.parquet(f"{large}/labels.parquet").where("quality = 1").select("doc_id")
    texts = [r.text for r in spark.read.parquet(f"{large}/documents.parquet").where(f"lang = '{lang}'").join(clean, "doc_id").select("text").distinct().orderBy("text").collect()]
    text = "\n".join(texts)
    assert len(text.split()) >= 200_000
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, text)], "doc_id long, text string"))
    got = classify(docs).where("doc_id = -1").collect()[0].quality
    assert got.kept and got.label > 0.5


def test_patterns_round_trip():
    for text in ("", "one", "the plain words of a text " * 9, "Und " * 90, "A!! B!! C!!", "x | y | z | w | v | u"):
        assert votes_of(pattern_of(votes(text))) == votes(text) and len(votes(text)) == len(LABELLERS)


def drawn(rng, n, share, accuracies, voting=1.0):
    """Counts of patterns of labellers that are right as often as planted, and abstain else."""
    good = rng.random(n) < share
    right = rng.random((n, len(LABELLERS))) < np.array(accuracies)
    said = np.where(right == good[:, None], 1, -1) * (rng.random((n, len(LABELLERS))) < voting)
    return Counter(map(pattern_of, said.tolist())), said, good


@pytest.mark.parametrize("share, voting", [(0.5, 1.0), (0.7, 0.6), (0.3, 0.8)])
def test_planted_accuracies_are_found(share, voting):
    """A coin, an inverted labeller and some of accuracy 0.9 or 0.8."""
    planted = [0.5, 0.1, *[0.9, 0.8] * 9][: len(LABELLERS)]
    counts, said, good = drawn(np.random.default_rng(4), 20_000, share, planted, voting)
    model = LabelModel(counts)
    assert max(abs(a - b) for a, b in zip(model.accuracies().values(), planted)) < 0.05 and abs(model.good - share) < 0.03
    assert np.abs(model.coverage - voting).max() < 0.02
    assert ((model.posterior(said) > 0.5) == good).mean() > 0.9


def test_defects_that_draw_several_votes_are_bad_and_a_lone_voter_errs():
    rng, counts = np.random.default_rng(1), Counter()
    for _ in range(20_000):
        kind = rng.choice(4, p=[0.8, 0.1, 0.06, 0.04])
        low = np.zeros(len(LABELLERS), bool)
        low[list([(), (0, 1, 2), (4, 5, 8), (0, 1, 2, 3, 7)][kind])] = True
        low[6] = rng.random() < 0.4  # errs alone, whatever the document
        counts[pattern_of(np.where(low ^ (rng.random(len(low)) < 0.02), -1, 1).tolist())] += 1
    model = LabelModel(counts)
    vote = lambda *low: np.array([[-1 if k in low else 1 for k in range(len(LABELLERS))]])
    assert abs(model.good - 0.8) < 0.03 and abs(model.accuracies()["length"] - (0.8 * 0.6 + 0.2 * 0.4)) < 0.05
    assert all(model.posterior(vote(*low))[0] < 0.1 for low in ((0, 1, 2), (4, 5, 8), (0, 1, 2, 3, 7)))
    assert all(model.posterior(vote(*low))[0] > 0.5 for low in ((), (6,), (9,)))
    assert LabelModel({}).posterior([[1] * len(LABELLERS)]).shape == (1,)


def plain_labels(rows, most=8, rounds=300):
    """The posterior of every document, by loops over documents."""
    log, exp, width = math.log, math.exp, len(LABELLERS)

    def joint(v, rates, share):
        return [log(s) + sum(log(r[k]) if x < 0 else log(1 - r[k]) for k, x in enumerate(v) if x) for r, s in zip(rates, share)]

    def climb(rates, share):
        fit = -math.inf
        for _ in range(rounds):
            seen = [joint(v, rates, share) for v in rows]
            norm = [max(j) + log(sum(exp(x - max(j)) for x in j)) for j in seen]
            before, fit = fit, sum(norm)
            if fit - before < 1e-8 * len(rows):
                break
            post = [[exp(x - z) for x in j] for j, z in zip(seen, norm)]
            total = [sum(p[c] for p in post) for c in range(len(share))]
            share = [(t + 1) / (len(rows) + len(share)) for t in total]
            rates = [[(sum(p[c] for p, v in zip(post, rows) if v[k] < 0) + 0.5) / (sum(p[c] for p, v in zip(post, rows) if v[k]) + 1) for k in range(width)] for c in range(len(share))]
        return rates, share, fit

    rates, share, fit = climb([[0.3] * width, [0.7] * width], [0.5, 0.5])
    while len(share) < most:
        likely = {tuple(v): sum(map(exp, joint(v, rates, share))) for v in rows}
        same = Counter(tuple(map(abs, v)) for v in rows)
        count = Counter(map(tuple, rows))
        over = {v: n * log(n / (same[tuple(map(abs, v))] * likely[v])) for v, n in count.items()}
        worst = max(over, key=over.get)
        begun = count[worst] / (2 * len(rows))
        found = climb([*rates, [0.9 if x < 0 else 0.1 if x else 0.5 for x in worst]], [*[s * (1 - begun) for s in share], begun])
        if 2 * (found[2] - fit) <= (width + 1) * log(len(rows)):
            break
        rates, share, fit = found
    best = min(rates, key=sum)
    bad = [sum(max(0, a - b) for a, b in zip(r, best)) >= 1.5 for r in rates]
    out = []
    for v in rows:
        j = [exp(x) for x in joint(v, rates, share)]
        out.append(sum(x for x, b in zip(j, bad) if not b) / sum(j))
    return out


def plain_features(text, vote):
    words = text.encode("utf-8", "replace").split()
    out = defaultdict(float)
    for w in words:
        shape = re.sub(rb"0+", b"0", re.sub(rb"A+", b"A", re.sub(rb"a+", b"a", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[B-Z]", b"A", re.sub(rb"[1-9]", b"0", w))))))
        out[zlib.crc32(shape[:12]) % BUCKETS] += 1 / len(words)
    out = defaultdict(float, {k: x**0.5 for k, x in out.items()})
    kinds = sum(len(set(words[k : k + 2000])) for k in range(0, len(words), 2000)) / max(1, len(words))
    for name in [*[f"vote:{k}:{x}" for k, x in enumerate(vote)], f"kinds:{int(5 * kinds)}", f"size:{int(5 * min(1.0, len(words) / 200))}"]:
        out[zlib.crc32(name.encode()) % BUCKETS] += 0.5
    return out


def test_against_a_plain_version(spark):
    table = spark.read.parquet(f"{DIR.replace('sf0.01', 'sf0.001')}/documents.parquet").select("doc_id", "text")
    docs = {r.doc_id: r.text or "" for r in table.collect()}
    got = {r.doc_id: r.quality for r in classify(table).collect()}
    said = {d: votes(t) for d, t in docs.items()}
    soft = dict(zip(docs, plain_labels(list(said.values()))))
    assert max(abs(got[d].label - soft[d]) for d in docs) < 1e-6
    found = {d: plain_features(t, said[d]) for d, t in docs.items()}
    for d, t in docs.items():
        at, x = features(t, said[d])
        assert dict(zip(at.tolist(), x.tolist())) == pytest.approx(found[d], abs=1e-6)
    weights, bias, spread = defaultdict(float), 0.0, defaultdict(lambda: 1e-3)
    order, rows = np.random.default_rng(11), sorted(docs, key=lambda d: tuple(a.tobytes() for a in features(docs[d], said[d])) + (pattern_of(said[d]),))
    odds = lambda f: 1 / (1 + math.exp(-(bias + sum(weights[k] * x for k, x in f.items()))))
    for _ in range(8):
        for k in order.permutation(len(rows)):
            f = found[rows[k]]
            g = soft[rows[k]] - odds(f)
            for h, x in f.items():
                step = g * x - 1e-5 * weights[h]
                spread[h] += step * step
                weights[h] += 0.3 * step / spread[h] ** 0.5
            bias += 0.01 * g
    assert max(abs(got[d].score - odds(found[d])) for d in docs) < 1e-3
    assert all(got[d].kept == (got[d].score >= 0.5 and bool(docs[d].split())) for d in docs)


def test_repeated_rows_are_drawn_once(docs):
    rows = [(1, "one row of words that stands here a thousand times")] * 3000 + [(k, f"row {k} of its own") for k in range(2, 40)]
    _, scorer = train(docs(rows), sample=30)
    assert scorer.rows <= 30
    assert classify(docs(rows), sample=30).count() == len(rows)


def test_odd_rows(odd, docs):
    got = {r.doc_id: r.quality for r in classify(odd.selectExpr("*", "1 AS drawn", "2 AS pattern")).collect()}
    assert not any(got[d].kept for d in (1, 2, 4, 9)) and got[7] is not None
    assert classify(odd).count() == odd.count() and classify(docs([])).collect() == []
    taken = classify(odd.selectExpr("*", "1 AS quality")).collect()
    assert {r.quality for r in taken} == {1} and all(0 <= r.quality_.score <= 1 for r in taken)
