import math
from collections import Counter

from pairlens.operators import naive_bayes as NB


def test_probabilities_by_hand(spark):
    rows = [(1, "Good good food", 1, 0), (2, "bad FOOD!", 0, None), (3, "good café", 1, 1), (4, "", None, 1), (5, "unseen words", None, None), (6, None, 0, 0)]
    df = spark.createDataFrame(rows, "id long, text string, a int, b int")
    model = NB.train(df, "id", "text", {"a": 2, "b": 3})
    got = {r.id: r for r in model.probabilities(df, "id", "text").collect()}
    words = {1: ["good", "good", "food"], 2: ["bad", "food"], 3: ["good", "café"], 4: [], 5: ["unseen", "words"], 6: []}
    for t, k in (("a", 2), ("b", 3)):
        labels = {r[0]: r[2 if t == "a" else 3] for r in rows}
        known = [i for i, c in labels.items() if c is not None]
        count = {c: Counter(w for i in known if labels[i] == c for w in words[i]) for c in range(k)}
        vocabulary = {w for c in count.values() for w in c}
        for i in words:
            score = [math.log((sum(labels[j] == c for j in known) + 1) / (len(known) + k))
                     + sum(math.log((count[c][w] + 1) / (sum(count[c].values()) + len(vocabulary))) for w in words[i] if w in vocabulary) for c in range(k)]
            e = [math.exp(s) for s in score]
            assert all(abs(x / sum(e) - p) < 1e-5 for x, p in zip(e, got[i][f"{t}_probs"]))


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "id long, text string, a int")
    model = NB.train(df.where("false"), "id", "text", {"a": 2})
    r = NB.predicted(model.probabilities(df, "id", "text"), "a").first()
    assert r.a_probs == [0.5, 0.5] and r.prediction == 0


def test_rare_tokens_travel_and_frequent_ones_do_not(spark):
    """Two broadcast tokens of many: the same scores; and no token of a text is shuffled where all are broadcast."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7)) + f" Common the {'x' * (i % 3)}", i % 2, (i % 3) or None) for i in range(60)]
    rows += [(None, "w1 the", 1, 1), (None, None, 0, 2), (7, "w1 w1 twice", 1, 1), (100, None, 1, None), (101, " .,! ", 0, 1)]
    df = spark.createDataFrame(rows, "id long, text string, a int, b int")
    few, all_ = (NB.train(df.where("id is null or id % 4 > 0"), "id", "text", {"a": 2, "b": 3}, n) for n in (2, NB.FREQUENT))
    got = [sorted(((r.id, *[round(x, 9) for x in (*r.a_probs, *r.b_probs)]) for r in m.probabilities(df, "id", "text").collect()), key=str) for m in (few, all_)]
    assert got[0] == got[1] and len(got[0]) == len({r[0] for r in rows})
    plan = all_.probabilities(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and "BroadcastHashJoin" in plan
