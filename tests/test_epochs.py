"""Training by epochs against the same steps in one place."""

import random

import numpy as np

from siftwave.functions import fixed_values as fv
from siftwave.plans import epochs, evaluate


def messages(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    telling = [["hẹn", "họp", "ăn"], ["giảm", "giá", "mua"], ["chuyển", "khoản", "otp"]]
    out = []
    for i in range(n):
        label = r.randint(0, 2)
        words = [r.choice(telling[label]) for _ in range(r.randint(1, 3))] + [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 6))]
        r.shuffle(words)
        out.append((i, " ".join(words), label))
    return out + [(n, "", 0), (n + 1, None, 1)]


def test_epochs_start_from_the_one_before_and_the_best_is_kept(spark):
    schema = "id long, text string, label_id int"
    train, val = spark.createDataFrame(messages(150, 1), schema), spark.createDataFrame(messages(60, 2), schema)
    done = epochs.train_by_epochs(train, val, epochs=5)
    # the same steps with numpy on collected rows
    rows = epochs.hashed_terms(train, "label_id").toArrow()
    labels, w = np.asarray(rows.column("label_id").combine_chunks()), np.zeros((epochs.FEATURES + 1, 3))
    squares, steps = np.zeros_like(w), []
    for _ in range(5):
        shares, row, term, value = epochs.probabilities(w, rows.column("terms"))
        x = np.zeros((len(labels), epochs.FEATURES + 1))
        x[row, term], x[:, -1] = value, 1
        g = x.T @ (shares - np.eye(3)[labels]) / len(labels) + epochs.DECAY * w
        squares += g * g
        w = w - epochs.RATE * g / (np.sqrt(squares) + 1e-10)
        steps.append(w)
    assert np.abs(done.weights - steps[done.epoch - 1]).max() < 1e-6
    # every epoch's score and the choice follow from the written predictions
    table = spark.read.parquet(done.predictions).toPandas()
    assert sorted(table.epoch.unique()) == [1, 2, 3, 4, 5] and len(table) == 5 * 62
    scores = []
    for _, part in table.groupby("epoch"):
        f1 = []
        for k in range(3):
            hit, said, real = ((part.expected == k) & (part.predicted == k)).sum(), (part.predicted == k).sum(), (part.expected == k).sum()
            f1.append(2 * hit / (said + real) if hit else 0.0)
        scores.append(float(np.mean(f1)))
    assert np.allclose(scores, done.scores) and done.epoch == int(np.argmax(scores)) + 1 and max(scores) > 0.9
    told = epochs.predict(done.weights, val.select("id", "text"))
    pairs = told.join(val, "id").selectExpr("id", "label_id AS expected", "CASE predicted WHEN 'normal' THEN 0 WHEN 'spam' THEN 1 ELSE 2 END AS predicted")
    assert list(fv.LABELS) == ["normal", "spam", "scam"] and abs(evaluate.metrics(pairs).first().macro_f1 - max(scores)) < 1e-9


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "id long, text string, label_id int")
    done = epochs.train_by_epochs(none, none, epochs=2)
    assert done.epoch == 2 and not done.weights.any()
    told = epochs.predict(done.weights, spark.createDataFrame([(1, None)], "id long, text string")).collect()
    assert told[0].predicted == "normal" and abs(told[0].scam - 1 / 3) < 1e-12
