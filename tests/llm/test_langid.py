import numpy as np

from hornbeam.llm.langid import Model, identify, learn
from hornbeam.llm.queries import op3_language

from conftest import DIR


def test_held_out_accuracy(spark, sample):
    got = {r.doc_id: r for r in op3_language(spark, DIR).collect()}
    truth = {r.doc_id: r.lang for r in sample.collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert set(got) == set(truth) and held
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def learning(spark):
    rows = [("en", "the cat and the dog went to that house with this other thing " * 5), ("fr", "le chat et la souris dans une maison avec des autres choses pour " * 5), ("ru", "кошка и собака пошли в этот дом с другой вещью " * 5), (None, "not labelled"), ("en", None)]
    return spark.createDataFrame(rows, "lang string, text string")


def test_mixed_texts_scripts_and_odd_rows(spark, odd, docs):
    table = docs([(1, "the dog and that house " * 6 + "la souris dans une maison " * 6), (2, "собака дом " * 4), (3, "123 --- 456"), (4, None), (5, ""), (6, "the cat кошка dog went to that house")])
    got = {r.doc_id: r.language for r in identify(table, learning(spark)).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "fr"] and (got[1].spans[1].first, got[1].spans[1].words) == (30, 30) and abs(got[1].score - 0.5) < 1e-9
    assert got[2].lang == "ru" and got[2].score == 1
    assert all((got[d].lang, got[d].score, got[d].spans) == ("und", 0.0, []) for d in (3, 4, 5)) and got[6].lang == "en"
    nobody = identify(odd, spark.createDataFrame([], "lang string, text string")).collect()
    assert len(nobody) == odd.count() and {r.language.lang for r in nobody} == {"und"}
    assert identify(docs([]), learning(spark)).collect() == []
    assert identify(odd.withColumnRenamed("lang", "score"), learning(spark)).count() == odd.count()


def test_paths_are_the_best(spark):
    model, rng = Model(learn(learning(spark).where("lang IS NOT NULL AND text IS NOT NULL")), 12.0, 0.001), np.random.default_rng(0)

    def value(path, s):
        return s[np.arange(len(s)), path].sum() - 12.0 * (path[1:] != path[:-1]).sum()

    for _ in range(300):
        n = int(rng.integers(1, 60))
        s = rng.normal(0, 1.5, (n, 3))
        for _ in range(rng.integers(0, 4)):
            a = rng.integers(0, n)
            s[a : a + rng.integers(1, 25), rng.integers(0, 3)] += 3
        assert abs(value(model.path(s), s) - value(np.array(model.viterbi(s, None, None)), s)) < 1e-9
