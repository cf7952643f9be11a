import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.llm import toxicity as tx
from tests.llm.data import WORDS, documents, empty, sentence

BAD = ("grimble", "snarkle", "vexon")


def corpus(spark, n=500, seed=5):
    """Toxic rows have words that start alike, some more than chance gives clean rows; and known insults."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 120)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + str(rng.randrange(30)) if i % 3 else "idiot")
        elif rng.random() < 0.05:
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + "x")
        rows.append((i, " ".join(words), "en", "s", 0))
        if rng.random() < 0.9:
            labels.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels, rows = corpus(spark)
    return docs, labels, rows, tx.train_toxicity(docs, labels)


def test_held_out_rows(trained):
    docs, labels, rows, model = trained
    got = {r["doc_id"]: r for r in tx.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    plain = {b for word in BAD for b in model.starts if word.startswith(b.decode().strip())}
    assert plain


def plain_score(model, text):
    """The score from its definition: every start tried on every word."""
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    size, z = len(model.starts), model.bias
    for i, s in enumerate(model.starts):
        begin = s.decode()
        often = sum(w + " " == begin if begin.endswith(" ") else (w.startswith(begin) and w != begin) for w in words)
        if often:
            z += model.weights[i] + (often >= 2) * model.weights[i + size] + (often >= 4) * model.weights[i + 2 * size]
            z += model.weights[i + 3 * size] * 4 * (often / len(words)) ** 0.5
    return 1 / (1 + np.exp(-z))


def test_scores_by_definition(spark, trained):
    docs, _, rows, model = trained
    rng = random.Random(8)
    odd = [(None, None, "en", "s", 0), (-1, "", "en", "s", 0), (-2, "GRIMBLE7, grimble7! Ünï çödé", "en", "s", 0), (-2, "again", "en", "s", 0),
           (-3, "idiot " + sentence(rng, 150_000), "en", "s", 0)]
    got = sorted(((r["doc_id"], r["score"]) for r in tx.score_toxicity(documents(spark, rows[:60] + odd), model).collect()), key=repr)
    want = sorted(((i, plain_score(model, t or "")) for i, t, *_ in rows[:60] + odd), key=repr)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want])
    clash = documents(spark, extra=True).withColumns({"score": F.lit(1), "text2": F.lit("x"), "held_out": F.lit(3)})
    assert tx.score_toxicity(clash, model).count() == clash.count()
    assert tx.score_toxicity(empty(spark), model).collect() == []


def test_only_labels_that_are_not_held_out_count(spark, trained):
    docs, labels, _, model = trained
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped = flipped.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema))
    again = tx.train_toxicity(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), flipped)
    assert again.starts == model.starts and np.array_equal(again.weights, model.weights)


def test_one_class_and_none(spark, trained):
    docs, labels, *_ = trained
    assert tx.train_toxicity(docs, labels.where("toxic = 0")).scorer()("any text") < 0.05
    assert tx.train_toxicity(docs, labels.limit(0)).scorer()("any text") == 0.5
    assert tx.train_toxicity(empty(spark), labels).scorer()("") == 0.5


def votes_of(n, accuracies, copies, seed):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    cols = [np.where(rng.random(n) < 0.2, 0, np.where((rng.random(n) < a) == y, 1, -1)) for a in accuracies]
    return y.astype(int), np.stack(cols + [cols[0]] * copies, axis=1)


def test_label_model_finds_accuracies():
    accuracies = [0.9, 0.8, 0.7, 0.85, 0.6]
    y, votes = votes_of(6000, accuracies, 0, 1)
    rng = np.random.default_rng(2)
    model = tx.label_model(votes, np.where(rng.random(6000) < 0.25, 1 - y, y), pull=0.0)  # a quarter of first guesses is wrong
    assert np.abs(model.accuracy - accuracies).max() < 0.05 and abs(model.prior - 0.3) < 0.05
    assert (model.parent < 0).all()


def test_copies_of_a_voter_count_once():
    y, votes = votes_of(4000, [0.65, 0.8, 0.8, 0.8], 6, 3)
    model = tx.label_model(votes, (votes[:, 1:4].sum(1) > 0).astype(float), pull=0.0)
    assert (model.parent >= 0).sum() == 6  # the copies hang on the first voter
    alone = tx.label_model(votes[:, :4], (votes[:, 1:4].sum(1) > 0).astype(float), pull=0.0)
    assert np.abs(model.posterior(votes) - alone.posterior(votes[:, :4])).mean() < 0.02
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_posterior_by_definition():
    rng = np.random.default_rng(4)
    table = rng.random((3, 2, 3, 3))
    table /= table.sum(3, keepdims=True)
    model = tx.LabelModel(0.2, np.array([-1, 0, 1]), table)
    votes = rng.integers(-1, 2, (50, 3))
    for row, p in zip(votes, model.posterior(votes)):
        joint = [q * (table[0, c, 0, row[0] + 1] if row[0] else 1) * (table[1, c, row[0] + 1, row[1] + 1] if row[1] else 1)
                 * (table[2, c, row[1] + 1, row[2] + 1] if row[2] else 1) for c, q in ((0, 0.8), (1, 0.2))]
        assert p == pytest.approx(joint[1] / sum(joint))


def test_logistic_finds_the_minimum():
    rng = np.random.default_rng(5)
    x = (rng.random((200, 6)) < 0.4).astype(float)
    target, weight = rng.random(200), np.where(rng.random(200) < 0.5, 1.0, 2.0)
    rows = [(np.flatnonzero(r), r[r > 0]) for r in x]
    w, b = tx.logistic(rows, target, 6, weight, steps=2000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (weight * (p - target)) + 0.5 * w).max() < 1e-3 and abs((weight * (p - target)).sum()) < 1e-3


def test_lexicons_and_patterns_vote():
    named = dict(zip(tx.FIXED, tx.fixed_votes("You're such a moron! Shut up")))
    assert named["en insults"] and named["you are"] and named["shut up"] and not named["none matches"]
    assert tx.fixed_votes(" ".join(WORDS))[0] == -1 and len(tx.fixed_votes("")) == len(tx.FIXED)
