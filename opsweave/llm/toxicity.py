"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are lexicons (a common one, and word starts found in labelled rows) and patterns; each says
toxic, clean or nothing of a text. The label model takes a text's votes as drawn from a hidden class:
it estimates by expectation maximisation how often each voter is right, wrong or silent in either
class, and which voters depend on each other, as a tree of their strongest conditional
dependencies, so that voters that say the same thing do not count twice. The classifier, logistic
regression on word starts, learns the model's posterior probabilities, not the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import text_of

#: Labelled rows of each class that models are fitted on, at most: those with the smallest MD5 of their key.
SAMPLE_PER_CLASS = 4000
#: Word starts in the classifier, and the most telling of them that vote.
STARTS, VOTING = 384, 48
#: Characters of a word start; whole words are starts with an end mark.
LENGTHS = range(3, 10)
#: Rows a start must stand in to be considered.
SUPPORT = 5
#: Words a task remembers the starts of.
REMEMBERED = 1 << 18
END = b" "

# Common terms of abuse, as a lexicon of voters.
LEXICONS = {
    "en insults": "idiot moron stupid dumb fool loser clown jerk creep imbecile cretin",
    "en contempt": "pathetic worthless disgusting useless filthy despicable",
    "en dehumanising": "scum trash vermin garbage filth parasite subhuman",
    "en hate": "hate hates hateful despise kill",
    "fr insults": "imbécile crétin débile abruti connard salaud ordure minable",
    "de insults": "idiot trottel dummkopf arschloch abschaum versager widerlich wertlos",
    "es insults": "imbécil estúpido idiota basura escoria patético asqueroso payaso",
}
PATTERNS = {
    "you are": r"\b(?:you|u)(?:'re| are| r) (?:a |an |such |so |the )?(?:\w+ )?(?:idiot|moron|loser|fool|clown|joke|trash|scum)",
    "shut up": r"\bshut (?:the \w+ )?up\b|\bgo to hell\b|\bget lost\b",
    "threat": r"\b(?:i|we)(?:'ll| will| am going to) (?:kill|hurt|beat|find) (?:you|u|them)\b",
    "hate you": r"\b(?:hate|despise) (?:you|them|those|these|all)\b",
    "masked word": r"\b[a-z][*@#$]{2,}[a-z]*\b",
    "shouting": r"(?:\b[A-Z]{4,}\b[\s,!]*){6,}",
    "exclamations": r"!{3,}",
}
_PATTERNS = {name: re.compile(p, re.IGNORECASE if name != "shouting" else 0) for name, p in PATTERNS.items()}
_PLAIN = bytes(b if b in set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256)) else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a whole text in lower case, as UTF-8: runs of letters, digits and characters outside ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def starts_of(word: bytes) -> list[bytes]:
    """A word with its end mark, and its first 3 to 9 characters."""
    chars = word.decode("utf-8", "replace")
    return [word + END] + [chars[:k].encode() for k in LENGTHS if k < len(chars)]


class Starts:
    """Counts chosen word starts in texts; remembers which starts a word has."""

    def __init__(self, chosen: list[bytes]):
        self.number = {s: i for i, s in enumerate(chosen)}
        self.sizes = sorted({len(s) for s in chosen if not s.endswith(END)})
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, word: bytes) -> tuple[int, ...]:
        number = self.number
        found = [number[s] for n in self.sizes if n < len(word) and (s := word[:n]) in number]
        if (whole := word + END) in number:
            found.append(number[whole])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = out = tuple(found)
        return out

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """(start -> how often, number of words) of a whole text."""
        words, count, known = words_of(text), Counter(), self.known
        for word in words:
            starts = known.get(word)
            if starts is None:
                starts = self.of(word)
            if starts:
                count.update(starts)
        return count, len(words)


def values(count: dict[int, int], n_words: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text as (numbers, values): per start whether it stands once, twice, four times, and the root of its share."""
    if not count:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    which, often = np.array(list(count), dtype=np.int64), np.array(list(count.values()), dtype=float)
    x = np.stack([np.ones(len(which)), often >= 2, often >= 4, 4 * np.sqrt(often / n_words)])
    at = which[None, :] + size * np.arange(4)[:, None]
    keep = x.ravel() > 0
    return at.ravel()[keep], x.ravel()[keep]


def gain(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of standing in a of n1 toxic and b of n0 clean rows; negative if it speaks for clean."""
    def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0)

    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    share = (a + b) / max(1.0, n1 + n0)
    g = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    return np.where(a * n0 >= b * n1, g, -g)


def choose(found: list[tuple[bytes, int, int]], n1: int, n0: int, most: int) -> list[bytes]:
    """The most telling starts; of starts that are each other's beginning and stand in as many rows only the best."""
    g = np.abs(gain(np.array([a for _, a, _ in found]), np.array([b for *_, b in found]), n1, n0)) if found else []
    chosen: list[tuple[bytes, int, int]] = []
    by_begin: dict[bytes, list[tuple[bytes, int, int]]] = {}
    for i in sorted(range(len(found)), key=lambda i: (-round(float(g[i]), 6), -len(found[i][0]), found[i][0])):
        s, a, b = found[i]
        rivals = by_begin.setdefault(s[:2], [])
        if any((s.startswith(t) or t.startswith(s)) and abs(a - c) + abs(b - d) <= 0.05 * (a + b) for t, c, d in rivals):
            continue
        rivals.append(found[i])
        chosen.append(found[i])
        if len(chosen) == most:
            break
    return [s for s, _, _ in chosen]


def stump(share: np.ndarray, toxic: np.ndarray) -> float:
    """The share from which on a start tells most for toxic, among those that occur."""
    n1, n0 = float(toxic.sum()), float((1 - toxic).sum())
    some = np.unique(share[share > 0])
    some = some[np.linspace(0, len(some) - 1, min(len(some), 40)).astype(int)] if len(some) else np.array([1.0])
    g = [float(gain(toxic[share >= t].sum(), (1 - toxic)[share >= t].sum(), n1, n0)) for t in some]
    return float(some[int(np.argmax(g))])


def voters(share: np.ndarray, toxic: np.ndarray, starts: list[bytes], precise: float = 0.9) -> tuple[list[int], list[float]]:
    """Starts that vote, and the shares from which on they do, from rows of shares and their labels.

    Most telling first. A start is judged on rows where no chosen start that begins like it votes, so that a common
    beginning does not live on the merits of a longer start; it must be toxic there in `precise` of the cases.
    """
    present = share > 0
    telling = gain((present * toxic[:, None]).sum(0), (present * (1 - toxic)[:, None]).sum(0), toxic.sum(), (1 - toxic).sum())
    chosen: list[int] = []
    limits: list[float] = []
    for s in np.argsort(-telling, kind="stable").tolist():
        if len(chosen) == VOTING or telling[s] <= 10:
            break
        related = [share[:, t] >= limit for t, limit in zip(chosen, limits)
                   if starts[t].startswith(starts[s]) or starts[s].startswith(starts[t])]
        left = ~np.any(related, axis=0) if related else np.ones(len(toxic), dtype=bool)
        limit, y = stump(share[left, s], toxic[left]), toxic[left]
        fires = share[left, s] >= limit
        if fires.sum() >= SUPPORT and (y[fires].sum() + 1) / (fires.sum() + 2) >= precise:
            chosen.append(s)
            limits.append(limit)
    return chosen, limits


def fixed_votes(text: str) -> list[int]:
    """Votes of the common lexicons and patterns: toxic where one matches; the first one is for clean where none does."""
    words = set(words_of(text))
    found = [bool(words & lexicon) for lexicon in _LEXICONS] + [bool(p.search(text)) for p in _PATTERNS.values()]
    return [0 if any(found) else -1] + [int(f) for f in found]


_LEXICONS = [{w.encode() for w in words.split()} for words in LEXICONS.values()]
FIXED = ["none matches", *LEXICONS, *PATTERNS]


@dataclass
class LabelModel:
    """Hidden class and votes: prior of toxic, a parent for each voter (-1: none), and per voter the
    probabilities of its votes given class and its parent's vote: table[j][class, parent vote + 1, vote + 1].

    Toxic texts are of many kinds, and most voters know one of them: that a voter is silent is no evidence of
    its own. Silence of all is what voters for clean speak of."""

    prior: float
    parent: np.ndarray
    table: np.ndarray
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic per row of votes (-1, 0, 1)."""
        v = votes + 1
        up = np.where(self.parent[None, :] >= 0, v[:, np.maximum(self.parent, 0)], 0)
        j = np.arange(votes.shape[1])[None, :]
        spoke = votes != 0
        score = [math.log(p) + (np.log(self.table[j, c, up, v]) * spoke).sum(1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))


def forest(votes: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Parents of voters: the spanning forest of greatest conditional mutual information given the class,
    without dependencies of less than `least` (of the likelihood ratio, so chance does not make them)."""
    n, m = votes.shape
    hot = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(float)
    tie = np.zeros((m, m))
    for w in (1 - weight, weight):
        total = max(w.sum(), 1e-9)
        both = ((hot * w[:, None]).T @ hot).reshape(m, 3, m, 3).transpose(0, 2, 1, 3) / total
        one = np.einsum("jjaa->ja", both)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = both * np.log(both / (one[:, None, :, None] * one[None, :, None, :]))
        tie += 2 * total * np.nan_to_num(ratio, posinf=0, neginf=0).sum((2, 3))
    parent, root = np.full(m, -1), list(range(m))
    links: list[list[int]] = [[] for _ in range(m)]

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted(((i, j) for i in range(m) for j in range(i)), key=lambda p: (-tie[p], p)):
        if tie[i, j] < least:
            break
        if top(i) != top(j):
            root[top(i)] = top(j)
            links[i].append(j)
            links[j].append(i)
    seen: set[int] = set()
    for start in range(m):
        todo = [] if start in seen else [start]
        seen.add(start)
        while todo:
            i = todo.pop()
            for j in links[i]:
                if j not in seen:
                    seen.add(j)
                    parent[j] = i
                    todo.append(j)
    return parent


def label_model(votes: np.ndarray, first: np.ndarray, rounds: int = 40, least: float = 12.0, pull: float = 2.0) -> LabelModel:
    """Expectation maximisation from first guesses of the class (probabilities per row).

    The guesses stay in the counts with the weight `pull`, so classes keep their meaning. Wrong guesses look like
    dependencies: the forest has only strong ones (0.1 nats a row) in the first 8 rounds, is chosen anew until the
    20th, then kept.
    """
    n, m = votes.shape
    p, v = first.astype(float), votes + 1
    parent = np.full(m, -1)
    model = LabelModel(0.5, parent, np.full((m, 2, 3, 3), 1 / 3))
    for r in range(rounds):
        mixed = (p + pull * first) / (1 + pull)
        if r < 20:
            parent = forest(votes, mixed, max(least, 0.2 * n) if r < 8 else least)
        prior = float((mixed.sum() + 1) / (n + 2))
        table = np.zeros((m, 2, 3, 3))
        for j in range(m):
            up = v[:, parent[j]] if parent[j] >= 0 else np.zeros(n, dtype=int)
            for c, w in ((0, 1 - mixed), (1, mixed)):
                table[j, c] = np.bincount(3 * up + v[:, j], weights=w, minlength=9).reshape(3, 3)
        table = (table + 0.1) / (table + 0.1).sum(3, keepdims=True)
        model = LabelModel(prior, parent, table)
        new = model.posterior(votes)
        moved, p = float(np.abs(new - p).max()) if n else 0.0, new
        if moved < 1e-4 and r >= 20:
            break
    right = (votes == 1) * p[:, None] + (votes == -1) * (1 - p[:, None])
    model.accuracy = (right.sum(0) + 1) / ((votes != 0).sum(0) + 2)
    return model


def logistic(x: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, weight: np.ndarray,
             penalty: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft targets, L2 penalty, by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    at, val = np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])
    norm = np.bincount(rows, weights=val ** 2, minlength=len(x)) + 1
    pace = 1 / (0.25 * float((weight * norm).sum()) + penalty)
    pace = max(pace, 1 / (0.25 * float(weight.max()) * _largest(rows, at, val, weight, len(x), size) + penalty))
    w, look = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(steps):
        z = np.bincount(rows, weights=val * look[at], minlength=len(x)) + look[size]
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(at, weights=val * slope[rows], minlength=size) + penalty * look[:size], slope.sum())
        new = look - pace * grad
        look = new + step / (step + 3) * (new - w)
        w = new
    return w[:size], float(w[size])


def _largest(rows: np.ndarray, at: np.ndarray, val: np.ndarray, weight: np.ndarray, n: int, size: int) -> float:
    """A bound, by power steps and a margin, of the largest eigenvalue of the features' weighted squares."""
    u, scale = np.ones(size + 1), weight / weight.max()
    most = 1.0
    for _ in range(30):
        z = scale * (np.bincount(rows, weights=val * u[at], minlength=n) + u[size])
        u = np.append(np.bincount(at, weights=val * z[rows], minlength=size), z.sum())
        most = float(np.sqrt((u ** 2).sum()))
        u /= max(most, 1e-300)
    return 1.1 * most


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + weights * features)))."""

    starts: list[bytes]
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None

    def scorer(self):
        counter, size, weights, bias = Starts(self.starts), len(self.starts), self.weights, self.bias

        def score(text: str) -> float:
            at, x = values(*counter.counts(text), size)
            z = bias + float(weights[at] @ x)
            return 1 / (1 + math.exp(-z)) if z >= 0 else 1 - 1 / (1 + math.exp(z))
        return score


def fit(counts: list[tuple[dict[int, int], int]], fixed: np.ndarray, labels: np.ndarray, starts: list[bytes]) -> Model:
    """Votes, label model and classifier from the counted starts and fixed votes of labelled rows."""
    size = len(starts)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model([], np.zeros(0), 4.0 * (2 * share - 1))
    share = np.zeros((len(counts), size))
    for i, (count, n) in enumerate(counts):
        for s, c in count.items():
            share[i, s] = c / n
    y = labels.astype(float)
    voting, limits = voters(share, y, starts)
    found = np.array([[int(share[i, s] >= t) for s, t in zip(voting, limits)] for i in range(len(counts))]).reshape(len(counts), -1)
    strong = found.any(1)
    weak = (share[:, voting] > 0).any(1) if voting else np.zeros(len(counts), dtype=bool)
    clean = np.stack([np.where(strong, 0, -1), np.where(weak, 0, -1)], axis=1)
    votes = np.concatenate([found, clean, fixed], axis=1).astype(int)
    votes = votes[:, (votes != 0).any(0)]
    model = label_model(votes, y)
    target = model.posterior(votes)
    toxic = target.sum()
    weight = np.where(target >= 0.5, len(y) / (2 * max(1.0, toxic)), len(y) / (2 * max(1.0, len(y) - toxic)))
    w, bias = logistic([values(c, n, size) for c, n in counts], target, 4 * size, weight)
    return Model(starts, w, bias, model)


def held_out(key: str) -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the key as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   per_class: int = SAMPLE_PER_CLASS, starts: int = STARTS) -> Model:
    """A model of the labelled rows that are not held out: of each class the `per_class` rows with the smallest MD5
    of their key, whole texts.

    Spark counts in how many rows of each class every word start stands; the driver gets the `10 x starts` most
    telling ones, and for each sampled row the counts of the chosen ones. Rows labelled twice count as toxic if one
    label says so; null keys and null labels are not used, null texts are empty. Without labels of both classes every
    score is the share of the class there is (a half without any).
    """
    usable = (labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
              .where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
              .withColumn("rank", F.md5(F.col("id").cast("string"))))
    sample = usable.where("label = 1").orderBy("rank", "id").limit(per_class).unionByName(
        usable.where("label = 0").orderBy("rank", "id").limit(per_class))
    texts = (docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
             .join(F.broadcast(sample), "id"))  # bounded by the sample's size

    def stand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in frames:
            for one, its in zip(pdf["text"], pdf["label"]):
                count[its].update({s for w in set(words_of(one)) for s in starts_of(w)})
        rows = [(s, count[1][s], count[0][s]) for s in count[0].keys() | count[1].keys()]
        yield pd.DataFrame(rows, columns=["start", "toxic", "clean"])

    sums = (texts.select("text", "label").mapInPandas(stand, "start binary, toxic long, clean long")
            .groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") + F.col("clean") >= SUPPORT))
    total = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    rate = F.abs((F.col("toxic") + 0.5) / (n1 + 1) - (F.col("clean") + 0.5) / (n0 + 1))
    spread = F.sqrt(((F.col("toxic") + F.col("clean") + 1) / (n1 + n0 + 2)) * (1.0 / (n1 + 1) + 1.0 / (n0 + 1)))
    best = sums.orderBy(F.desc(F.round(rate / spread, 9)), "start").limit(10 * starts).collect()
    chosen = choose([(bytes(r["start"]), r["toxic"], r["clean"]) for r in best], n1, n0, starts)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Starts(chosen)
        for pdf in frames:
            found = [counter.counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"rank": pdf["rank"], "id": pdf["id"].astype(str), "label": pdf["label"], "n": [n for _, n in found],
                                "starts": [list(c) for c, _ in found], "times": [list(c.values()) for c, _ in found],
                                "fixed": [fixed_votes(t) for t in pdf["text"]]})

    rows = texts.mapInPandas(count, "rank string, id string, label int, n long, starts array<int>, times array<int>,"
                                    " fixed array<int>").collect()  # at most two classes' samples
    rows.sort(key=lambda r: (r["rank"], r["id"], r["n"], r["starts"], r["times"]))
    return fit([(dict(zip(r["starts"], r["times"])), r["n"]) for r in rows],
               np.array([r["fixed"] for r in rows], dtype=int).reshape(len(rows), len(FIXED)),
               np.array([r["label"] for r in rows], dtype=int), chosen)


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row, from its whole text alone.

    Null texts are empty; empty texts get the score of a text without known starts. Repeated rows and rows with a
    null key are scored like others, an empty table gives an empty result. Other columns are not read.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for pdf in frames:
            yield pd.DataFrame({"score": [score(t) for t in pdf["text"]], "id": pdf["id"], "held_out": pdf["held_out"]})

    rows = docs.select(F.col(key).cast("string").alias("id"), held_out(key).alias("held_out"), text_of(text).alias("text"))
    return (rows.mapInPandas(run, "id string, held_out boolean, score double")
            .select(F.col("id").cast(docs.schema[key].dataType).alias(key), "held_out", "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
