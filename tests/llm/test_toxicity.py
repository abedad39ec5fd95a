import numpy as np

from logloom.llm import toxicity
from tests.llm.helpers import LONG, clashing, docs


def test_words():
    assert toxicity.words("You IDIOT!! é1x\n a*b a") == {"you", "idiot", "é", "x", "a", "b"}
    assert toxicity.words(None) == toxicity.words("") == toxicity.words("12 ..") == set()


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    """What a later category learns from is what models without that fold say."""
    rng = np.random.default_rng(0)
    texts = [{f"w{k}" for k in rng.integers(0, 40, 8)} | ({"idiot"} if i % 3 == 0 else set()) for i in range(300)]
    labels, folds = np.array([float(i % 3 == 0) for i in range(300)]), np.arange(300) % toxicity.FOLDS
    seen = []
    fitted = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, earlier, own, size: seen.append((len(own), earlier.shape[1])) or fitted(x, earlier, own, size))
    model = toxicity.train(texts, folds, labels)
    assert seen == [(240, 0)] * 5 + [(300, 0)] + [(240, 1)] * 5 + [(300, 1)] + [(300, 2)]
    found = model.scores(["an idiot", "w1 w2", None])
    assert found.shape == (3, 3) and found[0, 2] > 0.5 > found[1, 2] and found[0, 0] > 0.5 and found[0, 1] < 0.5


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(table, toxicity.fit(table, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    caught = [p for t, p in held if t == 1]
    assert len(rows) == table.count() and sum(caught) / len(caught) >= 0.8
    assert sum(p for t, p in held if t == 0) <= 0.01 * len(held)


def test_awkward_rows(spark):
    texts = [None, "", "123 !!", LONG, "You idiot", "You idiot", "Fine words here."]
    table = clashing(docs(spark, texts))
    labels = spark.createDataFrame([(i, 1, int(i in (4, 5))) for i in range(7)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in toxicity.score(table, toxicity.fit(table, labels)).collect()}
    assert len(rows) == 7 and rows[0] == rows[1] == rows[2] and rows[4] == rows[5]
    for part in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.fit(table, part)
        assert len({r.score for r in toxicity.score(table, model).collect()}) == 1
    assert toxicity.score(table.limit(0), model).count() == 0
