"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the subsequences of three characters they share, each weighted
by DECAY to the power of how far it is spread, up to SPREAD characters, so an insult
with characters put in between (`idxiot`) stays close to the plain one; the start of a word counts as a character. Punctuation within
a word is left out before (`i--d.iot`), and letters set apart (`s c u m`, `s. c. u. m`) are read as one word too. A labelled text is a
bag of words of which some are meant when it is toxic. Training takes as meant what is much
more frequent in toxic bags than in clean ones, fits a machine over words, and then alternates between adding the worst word of
each toxic bag that has none yet, and the worst words of clean bags as hard examples. The machine
works in the space of LANDMARKS words (Nyström). As its decision is a weighted sum of kernels
with landmarks, it unfolds to one weight per subsequence, a table of fixed size that scores all
documents. A text scores by its worst words, how many words are bad and which share of all they are (FEATURES), through a logistic fitted
on training bags that a machine of the other bags decides.

Training reads a sample bounded by MAX_BAGS labelled rows of either class, in order of a hash.

Defined cases: null labels are left out; null and empty texts have no words and score lowest; repeated
rows give repeated scores; without labels of both classes every score is 0; columns other than
the named ones are ignored. Texts of any length are read whole, in pieces; a word's score is remembered by a worker only within a
batch, and only for words of up to REMEMBERED characters.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.arrow import parts as parts_of
from cairnflow.llm.bpe import pieces

DECAY, SPREAD, LANDMARKS, MAX_BAGS = 0.7, 6, 400, {True: 2000, False: 2500}
#: Words longer than WINDOW are scored in overlapping windows.
WINDOW = 24
#: Words whose scores a task has in hand at once, and their most characters.
TABLE_SIZE, REMEMBERED = 200_000, 64
SYMBOLS = 64
#: Symbol number of ASCII punctuation, which no subsequence takes up, that of a word's start, steps of a fit, fits of a machine, and machines.
MARK, START, STEPS, ROUNDS, FOLDS = 29, 0, 200, 3, 3
#: Words of so many toxic bags at least, and so many times as frequent in these as in clean ones, are taken as meant.
LEAST_BAGS, RATIO = 3, 6.0
_MARKS = re.compile(r"[!-/:-@\[-`{-~¿¡«»„“”’…]+")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2,}")
_BETWEEN = re.compile(r"[\W_]+")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without punctuation, and runs of single characters joined to words."""
    found: set[str] = set()
    for piece in pieces(text):
        low = piece.lower()
        found.update(_MARKS.sub("", low).split())
        found.update(_BETWEEN.sub("", m[0]) for m in _APART.finditer(low))
    return found


_CODE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _CODE[_c] = _c - 96 if 97 <= _c <= 122 else 27 + _c % 2 if 48 <= _c <= 57 else 29 if _c < 0x80 else 30 + _c % 34


def codes(words: list[str]) -> np.ndarray:
    """Words of equal length as rows of symbol numbers below SYMBOLS."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    found = np.where(c < 0x250, _CODE[np.minimum(c, 0x24F)], 30 + c % 34).reshape(len(words), -1)
    return np.concatenate([np.full((len(words), 1), START), found], 1)


_SHAPES: dict[int, tuple] = {}


def _shape(n: int) -> tuple:
    """Places of the subsequences in a word of n symbols, and their weights at norm 1."""
    if n not in _SHAPES:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if k - i < SPREAD]
        i, j, k = np.array(at, np.int64).reshape(-1, 3).T
        w = DECAY ** (k - i - 2.0)
        _SHAPES[n] = i, j, k, w / max(1e-9, np.sqrt((w * w).sum()))
    return _SHAPES[n]


def parts(word: str) -> list[str]:
    """The word, in windows if it is long."""
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def features(part: str) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of one word."""
    c = codes([part])
    i, j, k, w = _shape(c.shape[1])
    return _numbers(c, i, j, k)[0], w


def _numbers(c: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (c[:, i] * SYMBOLS + c[:, j]) * SYMBOLS + c[:, k]


#: What the logistic sees of a text: the worst decision, the mean of the worst two, how many words are bad, and their share.
FEATURES = ("worst", "worst_two", "bad", "share")


def summary(decisions: np.ndarray) -> tuple[float, ...]:
    """FEATURES of a text from the decisions for its words."""
    if not len(decisions):
        return -1.0, -1.0, 0.0, 0.0
    top = np.clip(np.sort(decisions)[::-1][:2], -1, 1)
    bad = float(np.clip(2 * decisions, 0, 1).sum())
    return float(top[0]), float(top.sum() - (2 - len(top))) / 2, float(np.log1p(bad)), float(np.log1p(1000 * bad / (50 + len(decisions))))


@dataclass
class Model:
    """weight: per subsequence; slope and shift: from FEATURES to a logit."""

    weight: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float

    def decide(self, words: list[str]) -> np.ndarray:
        """The decision for each word."""
        if len(words) > 1 << 14:
            return np.concatenate([self.decide(words[a : a + (1 << 14)]) for a in range(0, len(words), 1 << 14)])
        out = np.full(len(words), -np.inf)
        by_size: dict[int, list[tuple[int, str]]] = {}
        for at, word in enumerate(words):
            for p in parts(word):
                by_size.setdefault(len(p), []).append((at, p))
        for size, held in by_size.items():
            i, j, k, w = _shape(size + 1)
            for a in range(0, len(held), 2048):
                some = held[a : a + 2048]
                value = self.weight[_numbers(codes([p for _, p in some]), i, j, k)] @ w if size > 2 else np.zeros(len(some))
                np.maximum.at(out, [at for at, _ in some], value + self.bias)
        return out

    def chance(self, features: tuple[float, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(float(np.dot(self.slope, features)) + self.shift, -50, 50))))


def _vectors(words: list[str]) -> list[dict[int, float]]:
    out = []
    for word in words:
        sums: dict[int, float] = {}
        for u, x in zip(*(a.tolist() for a in features(parts(word)[0])), strict=True):
            sums[u] = sums.get(u, 0.0) + x
        out.append(sums)
    return out


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """k(word, landmark), from the landmarks' own subsequences."""
    column: dict[int, int] = {}
    marks = _vectors(landmarks)
    for v in marks:
        for u in v:
            column.setdefault(u, len(column))
    of = np.full(SYMBOLS**3, len(column), np.int64)
    of[list(column)] = list(column.values())
    table = np.zeros((len(column) + 1, len(landmarks)))
    for m, v in enumerate(marks):
        for u, x in v.items():
            table[column[u], m] = x
    out = np.zeros((len(words), len(landmarks)))
    by_size: dict[int, list[int]] = {}
    heads = [parts(word)[0] for word in words]
    for n, head in enumerate(heads):
        by_size.setdefault(len(head), []).append(n)
    for size, held in by_size.items():
        i, j, k, w = _shape(size + 1)
        for a in range(0, len(held), 1024):
            some = held[a : a + 1024]
            at = of[_numbers(codes([heads[n] for n in some]), i, j, k)]
            total = np.zeros((len(some), len(landmarks)))
            for f in range(len(w)):
                total += w[f] * table[at[:, f]]
            out[some] = total
    return out


def _machine(words: list[str], y: np.ndarray, importance: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Weights per subsequence and bias of a squared-hinge machine in the landmarks' space."""
    own = _kernel(landmarks, landmarks)
    values, axes = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values[-1]
    to = axes[:, good] / np.sqrt(values[good])
    x = _kernel(words, landmarks) @ to
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    c = (importance / importance.sum() * 2000).astype(np.float32)
    y = y.astype(np.float32)
    scaled = x1 * np.sqrt(c)[:, None]
    top = np.float32(1 + 2 * np.linalg.eigvalsh(scaled.T @ scaled)[-1])
    w = z = np.zeros(x1.shape[1], np.float32)
    ridge = np.r_[np.ones(x.shape[1]), 0.01].astype(np.float32)
    t = 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        new = z - (ridge * z - 2 * x1.T @ (c * y * slack)) / top
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + np.float32((last - 1) / t) * (new - w)
        w = new
    alpha = to @ w[:-1]
    weight = np.zeros(SYMBOLS**3)
    for a, v in zip(alpha, _vectors(landmarks), strict=True):
        for u, value in v.items():
            weight[u] += a * value
    return weight, float(w[-1])


def _noisy(word: str, rng: np.random.Generator) -> str:
    """The word with a character put in, as people do to pass filters."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + str(rng.choice(list("xzq019"))) + word[at:]


class Bags:
    """Labelled texts as numbers of their words."""

    def __init__(self, bags: Iterable[tuple[Iterable[str], bool]]):
        number: dict[str, int] = {}
        seen: set[tuple[bytes, bool]] = set()
        self.toxic: list[np.ndarray] = []
        self.clean: list[np.ndarray] = []
        for bag, toxic in bags:
            own = np.sort(np.array([number.setdefault(w, len(number)) for w in bag], np.int32))
            if len(own) and (mark := (own.tobytes(), toxic)) not in seen:
                seen.add(mark)
                (self.toxic if toxic else self.clean).append(own)
        self.words = list(number)


def train(bags: Iterable[tuple[Iterable[str], bool]], seed: int = 7) -> Model:
    """A model from (distinct words, toxic) of labelled texts: the mean of FOLDS machines, each fitted without a part of the
    bags. The logistic is fitted on bags as the machine that hasn't seen them decides."""
    held = Bags(bags)
    if len(held.toxic) < 2 or len(held.clean) < 2:
        return Model(np.zeros(SYMBOLS**3), -1.0, np.zeros(len(FEATURES)), -50.0)
    x, y, machines = [], [], []
    for fold in range(FOLDS):
        rest = [[bag for n, bag in enumerate(side) if n % FOLDS != fold] for side in (held.toxic, held.clean)]
        model, known = fit(held.words, *rest, seed + fold, ROUNDS)
        machines.append(model)
        for side, bag_list in ((1.0, held.toxic), (0.0, held.clean)):
            for bag in bag_list[fold::FOLDS]:
                x.append(summary(known[bag]))
                y.append(side)
    slope, shift = _logistic(np.array(x), np.array(y))
    # decisions are linear in the weights, so the mean of machines is one
    return Model(sum(m.weight for m in machines) / FOLDS, sum(m.bias for m in machines) / FOLDS, slope, shift)


def fit(words: list[str], toxic: list[np.ndarray], clean: list[np.ndarray], seed: int, rounds: int) -> tuple[Model, np.ndarray]:
    """A machine over words from toxic and clean bags, without a logistic, and its decisions for all words."""
    rng = np.random.default_rng(seed)
    in_toxic, in_clean = (np.bincount(np.concatenate(b), minlength=len(words)) for b in (toxic, clean))
    long = np.array([len(w) > 2 for w in words])
    odds = (in_toxic / len(toxic)) / ((in_clean + 0.5) / len(clean))
    meant = long & (in_toxic >= LEAST_BAGS) & (odds >= RATIO)
    common = np.lexsort((np.arange(len(words)), -in_clean))
    common = common[(in_clean[common] > 0) & long[common] & ~meant[common]]
    pool = np.concatenate([common[:1500], common[rng.permutation(len(common))[:2500]]])
    good = {int(w): float(in_toxic[w]) ** 0.5 for w in np.flatnonzero(meant)}
    hard: dict[int, float] = {}
    decisions = np.zeros(len(words))
    model = Model(np.zeros(SYMBOLS**3), 0.0, np.zeros(len(FEATURES)), 0.0)
    for round_ in range(rounds):
        if round_ or not good:  # toxic bags without a word that is taken as meant give their worst one
            score = decisions if round_ else odds
            for bag in toxic:
                some = bag[long[bag]]
                if len(some) and not any(int(w) in good for w in some):
                    w = int(some[np.argmax(score[some])])
                    if not round_ or decisions[w] > 0:
                        good[w] = 1.0
        kept = sorted(good, key=lambda w: (-good[w], w))[:1500]
        negative = [w for w in dict.fromkeys([*pool.tolist(), *hard]) if w not in good]
        plain = [(words[w], 1.0, good[w]) for w in kept] + [(words[w], -1.0, hard.get(w, 1.0)) for w in negative]
        extra = [(_noisy(words[w], rng), 1.0, good[w] / 3) for w in kept for _ in range(2)] + [(_noisy(words[w], rng), -1.0, 0.3) for w in negative[:1500]]
        rows = plain + extra
        y = np.array([r[1] for r in rows])
        weight = np.array([r[2] for r in rows])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum() / 2
        marks = kept[: LANDMARKS // 2]
        marks += [negative[i] for i in rng.permutation(len(negative))[: LANDMARKS - len(marks)]]
        model.weight, model.bias = _machine([r[0] for r in rows], y, weight, [words[w] for w in marks])
        decisions = model.decide(words)
        for bag in clean:
            w = int(bag[np.argmax(decisions[bag])])
            if w not in good and len(hard) < 3000:
                hard[w] = 0.3 + 0.3 * min(2, int(in_clean[w]))
    return model, decisions


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of logistic regression with a small ridge, by Newton steps; the shift puts 0.5 where F2 (recall
    counts twice) is highest on the bags, in the middle between two of them."""
    a = np.zeros(x.shape[1] + 1)
    m = np.hstack([x, np.ones((len(x), 1))])
    c = 1 / len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -50, 50)))
        g = c * m.T @ (p - y) + 1e-4 * a
        h = c * (m * (p * (1 - p))[:, None]).T @ m + 1e-4 * np.eye(len(a))
        a = a - np.clip(np.linalg.solve(h, g), -2, 2)
    logit = x @ a[:-1]
    order = np.argsort(-logit, kind="stable")
    z, hits = logit[order], np.cumsum(y[order])
    f2 = 5 * hits / (np.arange(1, len(y) + 1) + 4 * y.sum())
    ends = np.flatnonzero(np.r_[z[1:] != z[:-1], True])
    at = int(ends[np.argmax(f2[ends])])
    return a[:-1], -float(z[at] + z[min(at + 1, len(z) - 1)]) / 2


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def labelled_bags(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: dict[bool, int] | None = None) -> list[tuple[tuple[str, ...], bool]]:
    """Up to MAX_BAGS texts of either class, in order of a hash of the id, as bags of distinct words."""
    most = most or MAX_BAGS
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("key"), (F.col(label) == 1).alias("toxic"))
    sample = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(most[y]) for y in (True, False)]
    ids = sample[0].union(sample[1]).dropDuplicates(["key"])  # as many rows as MAX_BAGS at most
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key").where("text IS NOT NULL")

    def run(batches):
        for b in batches:
            bags = [sorted(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.string())), b.column(2)], ["words", "toxic"])

    found = rows.mapInArrow(run, "words array<string>, toxic boolean").toLocalIterator()
    return [(tuple(map(sys.intern, r["words"])), bool(r["toxic"])) for r in found]  # one object per word, not per text


def score(docs: DataFrame, key: str, text: str, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its key, score, predicted and the columns to carry. Batches are read in parts of bounded bytes."""

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            for b in parts_of(batch, most=2 << 20):
                bags = [words_of(t or "") for t in b.column(1).to_pylist()]
                new = list(set().union(*bags) - known.keys())
                if len(known) + len(new) > TABLE_SIZE:
                    known.clear()
                    new = list(set().union(*bags))
                known.update(zip(new, model.decide(new).tolist(), strict=True))
                scores = [model.chance(summary(np.array(list(map(known.__getitem__, bag))))) for bag in bags]
                for w in new:
                    if len(w) > REMEMBERED:
                        del known[w]
                own = dict(zip(names, b.columns, strict=True))
                yield pa.RecordBatch.from_arrays([own["key"], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *(own["body" if c == text else c] for c in carry)], ["key", "score", "predicted", *carry])

    names = ["key", "body", *(c for c in carry if c != text)]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), *names[2:])
    also = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, predicted int" + also).withColumnRenamed("key", key)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(labelled_bags(docs, labels, "doc_id", "text", "toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents; learnt from labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, "doc_id", "text", model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
