"""Quality classifier: Naive Bayes log-count ratios in a linear support vector machine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-grams are numbered by a hash of this many bits.
BITS = 18
#: Labelled rows of each class the model is fitted on, at most: those with the smallest MD5 of their key.
SAMPLE_PER_CLASS = 3000
#: Bytes whose n-grams are numbered at a time: bounds the memory of very long texts.
BLOCK = 1 << 20
_MULT = np.uint32(2654435761)


def _number(kind: int, codes: np.ndarray) -> np.ndarray:
    """Numbers of n-grams of one kind, packed into 32-bit codes."""
    h = (codes ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * _MULT
    h ^= h >> np.uint32(15)
    return (h * _MULT) >> np.uint32(32 - BITS)


def _grams(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, packed n-grams) of codes below 256, n from 1 to `most`."""
    packed = codes
    for n in range(1, most + 1):
        if n > 1:
            packed = (packed[:-1] << np.uint32(8)) | codes[n - 1:]
        if not len(packed):
            return
        yield n, packed


def _classes() -> np.ndarray:
    """What kind of character a byte is part of: letters by case, digits, white space; others are themselves."""
    table = np.arange(256, dtype=np.uint32)
    table[ord("a"):ord("z") + 1] = table[128:] = 1
    table[ord("A"):ord("Z") + 1] = 2
    table[ord("0"):ord("9") + 1] = 3
    table[[32, 9, 11, 12, 13]] = 4
    return table


_CLASS = _classes()


def features(text: str) -> np.ndarray:
    """The distinct n-grams of a text, as sorted numbers.

    N-grams are of three kinds: 1 to 3 bytes as they are; 1 to 4 character classes, runs of one
    class taken as one; and words that follow themselves 2, 3, 4, 6 or 9 times or more.
    """
    marks = np.zeros(1 << BITS, dtype=bool)
    data = text.encode("utf-8", "surrogatepass")
    for start in range(0, len(data), BLOCK):
        raw = np.frombuffer(data, dtype=np.uint8)[max(0, start - 3):start + BLOCK].astype(np.uint32)
        shape = _CLASS[raw]
        shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))]
        for n, grams in _grams(raw, 3):
            marks[_number(n, grams)] = True
        for n, grams in _grams(shape, 4):
            marks[_number(16 + n, grams)] = True
    words = data.split()
    longest = 1
    if True in (same := list(map(eq, words, words[1:]))):
        longest = 1 + max(sum(1 for _ in run) for value, run in groupby(same) if value)
    for n in (2, 3, 4, 6, 9):
        if longest >= n:
            marks[_number(32, np.array([n], dtype=np.uint32))] = True
    return np.flatnonzero(marks)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = bias + sum of weights / sqrt(number of n-grams)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return self.bias + float(self.weights[found].sum()) / math.sqrt(max(1, len(found)))

    def score(self, text: str) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return 1 / (1 + math.exp(-z)) if z >= 0 else 1 - 1 / (1 + math.exp(z))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per n-gram log of the ratio of its smoothed shares among the n-grams of either class."""
    counts = np.ones((2, 1 << BITS))
    for found, label in zip(rows, labels):
        counts[label, found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, costs: np.ndarray, epochs: int = 20,
                 seed: int = 0) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 penalty by dual coordinate descent; an n-gram's value is its ratio, rows are scaled
    by the root of their number of n-grams. Returns weights per n-gram (ratio included) and the bias."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    scale = np.array([1 / math.sqrt(max(1, len(r))) for r in rows])
    square = np.array([(ratios[r] ** 2).sum() for r in rows]) * scale ** 2 + 1
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            gradient = signs[i] * (float(w[x] @ ratios[x]) * scale[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[x] += step * scale[i] * ratios[x]
                bias += step
                moved = max(moved, abs(step) / costs[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * ratios, bias


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve through margins, by Newton steps on smoothed targets."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margins ** 2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    """Fit on n-gram sets with labels 0 and 1. With one class only, every score is its share.

    Margins for the logistic curve come from two halves, each scored by the other's model.
    """
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 4.0 * (2 * share - 1))

    def train(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        some, y = [rows[i] for i in chosen], labels[chosen]
        balance = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        return dual_descent(some, 2.0 * y - 1, log_count_ratios(some, y), cost * balance)

    weights, bias = train(np.arange(len(rows)))
    margins = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 2
    for half in (0, 1):
        seen, other = np.flatnonzero(fold != half), np.flatnonzero(fold == half)
        w, b = train(seen) if len(set(labels[seen].tolist())) == 2 else (weights, bias)
        margins[other] = [Model(w, b, 1, 0).margin(rows[i]) for i in other]
    slope, shift = platt(margins, labels)
    return Model(weights.astype(np.float32), bias, slope, shift)


def held_out(key: str):
    """Rows whose labels are never learnt from: CRC-32 of the key as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of the labelled rows that are not held out: of each class the `per_class` rows with
    the smallest MD5 of their key, whole texts. What reaches the driver are their n-gram numbers."""
    usable = (labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null")
              .where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
              .withColumn("rank", F.md5(F.col("id").cast("string"))))
    sample = usable.where("label = 1").orderBy("rank", "id").limit(per_class).unionByName(
        usable.where("label = 0").orderBy("rank", "id").limit(per_class))
    texts = (docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .join(F.broadcast(sample), "id"))  # bounded by the sample's size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"rank": pdf["rank"], "id": pdf["id"].astype(str), "label": pdf["label"],
                                "found": [features(t).astype("<i4").tobytes() for t in pdf["text"]]})

    found = texts.mapInPandas(run, "rank string, id string, label int, found binary").collect()
    found.sort(key=lambda r: (r["rank"], r["id"], r["found"]))
    return fit([np.frombuffer(r["found"], dtype="<i4") for r in found], np.array([r["label"] for r in found], dtype=int))


def score_quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row, from its whole text alone.

    Null texts are empty; empty texts get the score of a text without n-grams. Rows with a
    null key are scored like others. Other columns are not read.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"],
                                "score": [model.score(t) for t in pdf["text"]]})

    rows = docs.select(F.col(key).alias("id"), held_out(key).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInPandas(run, f"id {kind}, held_out boolean, score double")
            .select(F.col("id").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score of 0.5 or more, all columns as they are."""
    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") >= 0.5 for t in texts], dtype=bool)

    return docs.where(good(F.col(text)))
