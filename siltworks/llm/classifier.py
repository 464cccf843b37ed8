"""A quality classifier from weak labels.

Overlapping heuristic labellers vote on each document. Expectation-maximisation over the counts of vote
patterns estimates how accurate each labeller is; the posterior of a document's pattern is its label, and a
hashed linear scorer is trained on such labels. All documents are counted and scored; the scorer is fitted on a
sample of at most ``TRAIN_ROWS`` documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.scale import bound_batches, scratch_table

#: Documents that the scorer is fitted on at most: those with the smallest hash of seed, id and text.
TRAIN_ROWS = 5_000
#: Hash buckets of the linear scorer.
BUCKETS = 1 << 14
SEED = 11
EPOCHS, RATE, PENALTY = 300, 0.5, 1e-4

SYMBOL = re.compile(rb"[#*$%&|<>{}~^\\_=@+]")
HIGH_BYTES = bytes(range(128, 256))
STOPS = frozenset(
    b"the of and to in a is that it for on as with was be by or at from this der die das und in zu den mit von ist de la "
    b"le et les des en un une que est pour el los las y con por para se no".split()
)


@dataclass(frozen=True)
class Signals:
    """What labellers look at: shares of bytes, words or lines."""

    n_words: int
    symbols: float
    upper: float
    bangs: float
    distinct: float
    mean_word: float
    stops: float
    closed: float
    bars: float
    top_word: float
    foreign: float


def signals(data: bytes) -> tuple[Signals, list[bytes]]:
    """The signals of a text in UTF-8 and its words in lower case."""
    words = data.lower().split()
    n, size = len(words), max(1, len(data))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x.rstrip() for x in data.split(b"\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ended = sum(len(x) for x in lines if x.endswith((b".", b"!", b"?", b":", b'"', b";")))
    return Signals(
        n_words=n,
        symbols=len(SYMBOL.findall(data)) / size,
        upper=capitals / letters,
        bangs=data.count(b"!") / max(1, n),
        distinct=len(counts) / max(1, n),
        mean_word=letters / max(1, n),
        stops=sum(counts.get(w, 0) for w in STOPS) / max(1, n),
        closed=ended / max(1, sum(map(len, lines))),
        bars=data.count(b" | ") / max(1, n),
        top_word=max(counts.values(), default=0) / max(1, n),
        foreign=(len(data) - len(data.translate(None, HIGH_BYTES))) / letters,
    ), words


#: Above this share of non-ASCII bytes a text is not in Latin script: word lengths and stop words tell nothing then.
FOREIGN = 0.5

#: Name and vote of each labeller: 1 good, 0 bad, -1 no opinion.
LABELLERS = {
    "few_symbols": lambda s: 0 if s.symbols > 0.06 else 1 if s.symbols < 0.01 else -1,
    "normal_case": lambda s: 0 if s.upper > 0.3 else 1 if s.upper < 0.08 and s.n_words >= 10 else -1,
    "calm": lambda s: 0 if s.bangs > 0.2 else -1,
    "varied_words": lambda s: -1 if s.n_words < 20 else 0 if s.distinct < 0.3 else 1 if s.distinct > 0.45 else -1,
    "no_dominant_word": lambda s: -1 if s.n_words < 20 else 0 if s.top_word > 0.2 else 1 if s.top_word < 0.12 else -1,
    "word_length": lambda s: -1 if s.n_words < 5 or s.foreign > FOREIGN else 1 if 3 <= s.mean_word <= 10 else 0,
    "function_words": lambda s: -1 if s.n_words < 20 or s.foreign > FOREIGN else 1 if s.stops > 0.1 else 0 if s.stops < 0.02 else -1,
    "closed_lines": lambda s: -1 if s.n_words < 10 else 1 if s.closed > 0.8 else 0 if s.closed < 0.3 else -1,
    "no_menu_bars": lambda s: 0 if s.bars > 0.1 else -1,
}


def votes(s: Signals) -> str:
    """One character a labeller: ``1``, ``0`` or ``-``."""
    return "".join("-" if (v := rule(s)) < 0 else str(v) for rule in LABELLERS.values())


def estimate_accuracies(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, accuracies ``(labeller, class)`` and the share of good documents.

    Labellers err independently given the class. A pattern table has at most ``3 ** len(LABELLERS)`` rows. Starts
    from the share of votes for good; without votes a pattern's posterior is the share of good.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {}, np.full((len(LABELLERS), 2), 0.5), 0.5
    table = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    good, bad = (table == 1).astype(float), (table == 0).astype(float)
    posterior = (good.sum(1) + 1) / ((table >= 0).sum(1) + 2)
    right = np.full((table.shape[1], 2), 0.7)
    share = 0.5
    for _ in range(rounds):
        y1, y0 = weight * posterior, weight * (1 - posterior)
        right[:, 1] = (y1 @ good + 4) / (y1 @ (good + bad) + 5)
        right[:, 0] = (y0 @ bad + 4) / (y0 @ (good + bad) + 5)
        share = float((y1.sum() + 1) / (weight.sum() + 2))
        odds = np.log(share / (1 - share))
        odds = odds + good @ np.log(right[:, 1] / (1 - right[:, 0])) + bad @ np.log((1 - right[:, 1]) / right[:, 0])
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(now - posterior).max() < 1e-9:
            posterior = now
            break
        posterior = now
    return {p: float(x) for (p, _), x in zip(patterns, posterior, strict=True)}, right, share


def _shape(s: Signals) -> list[bytes]:
    """Coarse signals as words of their own."""
    steps = {
        "symbols": (0.005, 0.02, 0.05, 0.1, 0.2),
        "upper": (0.05, 0.1, 0.2, 0.4, 0.6),
        "bangs": (0.01, 0.05, 0.2, 0.5),
        "distinct": (0.05, 0.15, 0.3, 0.45, 0.6),
        "mean_word": (2, 3, 6, 9, 12),
        "closed": (0.1, 0.3, 0.6, 0.9),
        "bars": (0.01, 0.05, 0.1),
        "top_word": (0.05, 0.1, 0.2, 0.4),
        "stops": (0.02, 0.05, 0.1, 0.2),
    }
    short = s.n_words < 20
    return [f"\0{name}:{sum(getattr(s, name) > x for x in cuts)}:{short:d}".encode() for name, cuts in steps.items()]


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) % BUCKETS
        return found


def features(data: bytes, known: _Buckets, shapes: bool = True) -> tuple[np.ndarray, np.ndarray, Signals]:
    """Distinct buckets of a text and their values: words share a length of 1, shapes weigh 1 each."""
    s, words = signals(data)
    bag = np.unique(np.fromiter(map(known.__getitem__, set(words)), np.int64, -1)) if words else np.empty(0, np.int64)
    shape = np.unique([known[w] for w in _shape(s)]) if shapes else np.empty(0, np.int64)
    values = np.full(len(bag), 1 / max(1.0, len(bag)) ** 0.5)
    return np.concatenate([bag, shape]), np.concatenate([values, np.ones(len(shape))]), s


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer, the last one constant, by full-batch steps with adaptive rates."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    keys, values = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    seen = np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        score = np.bincount(owner, values * weights[keys], len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        slope = np.bincount(keys, values * error[owner], BUCKETS + 1) / len(rows)
        slope[-1] = error.mean()
        slope[:-1] += PENALTY * weights[:-1]
        seen += slope**2
        weights -= RATE * slope / np.sqrt(seen) * 0.1
    return weights


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes(signals((text.as_py() or "").encode())[0]) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["h", "pattern"])


def _features(shapes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            some = [features((text.as_py() or "").encode(), known, shapes) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k.tolist() for k, _, _ in some], pa.list_(pa.int64())),
                    pa.array([v.tolist() for _, v, _ in some], pa.list_(pa.float64())),
                    pa.array([votes(s) for _, _, s in some], pa.string()),
                ],
                names=["keys", "vals", "pattern"],
            )

    return run


def _draw(id_col: Column, text_col: Column) -> Column:
    return F.xxhash64(F.lit(SEED), id_col, text_col)


class QualityModel:
    """Posteriors by vote pattern, labeller accuracies and scorer weights."""

    def __init__(self, posteriors: dict[str, float], accuracies: np.ndarray, share: float, weights: np.ndarray, shapes: bool = True):
        self.posteriors, self.accuracies, self.share, self.weights, self.shapes = posteriors, accuracies, share, weights, shapes

    def score(self, data: bytes, known: _Buckets) -> tuple[str, float]:
        keys, values, s = features(data, known, self.shapes)
        if not s.n_words:
            return votes(s), 0.0
        x = float(values @ self.weights[keys] + self.weights[-1])
        return votes(s), 1 / (1 + float(np.exp(-np.clip(x, -30, 30))))


def fit_quality_model(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, shapes: bool = True
) -> QualityModel:
    """Count vote patterns over all rows, estimate accuracies, and fit the scorer on at most ``train_rows`` rows.

    The driver gets a row a pattern (``3 ** 9`` at most) and the features of the sample, no texts. The sample is the
    rows with the least hashes of id and text, of rows that repeat both one: whatever ids repeat or are null, it does not
    depend on the order of tasks. Without ``shapes`` the scorer sees words only, nothing that the labellers look at.
    """
    bound_batches(df.sparkSession)
    slim = df.select(_draw(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    voted = scratch_table(slim.mapInArrow(_votes, "h bigint, pattern string"), "votes")
    patterns = [(r["pattern"], r["n"]) for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()]
    posteriors, accuracies, share = estimate_accuracies(patterns)
    drawn = voted.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    rows = []
    if drawn is not None:
        sample = slim.where(F.col("h") <= drawn).dropDuplicates(["h"]).select("text")
        rows = sample.mapInArrow(_features(shapes), "keys array<bigint>, vals array<double>, pattern string").collect()
    rows.sort(key=lambda r: (r["keys"], r["vals"], r["pattern"]))
    labels = np.array([posteriors[r["pattern"]] for r in rows])
    weights = fit_scorer([(np.array(r["keys"], np.int64), np.array(r["vals"])) for r in rows], labels)
    return QualityModel(posteriors, accuracies, share, weights, shapes)


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``votes``, ``weak_label`` (posterior of good), ``score`` (0 to 1) and ``kept`` to the rows of ``df``.

    Every row's whole text is scored in its task, whatever its length. Null and empty texts score 0 and are not kept;
    rows that repeat score alike; an empty table gives an empty table; clashing names of ``df`` are replaced.
    """
    bound_batches(df.sparkSession)
    added = ("votes", "weak_label", "score", "kept")
    keep = [c for c in df.columns if c not in added]
    names = [f"k{i}" for i in range(len(keep))]
    slim = df.select(F.col(text_col).alias("__text"), *[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = _Buckets(), shared.value
        for batch in batches:
            some = [own.score((text.as_py() or "").encode(), known) for text in batch.column(0)]
            found = [
                pa.array([v for v, _ in some], pa.string()),
                pa.array([own.posteriors.get(v, own.share) for v, _ in some], pa.float64()),
                pa.array([round(x, 6) for _, x in some], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=[*names, "votes", "weak_label", "score"])

    found = [T.StructField("votes", T.StringType()), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())]
    out = slim.mapInArrow(run, T.StructType([*[slim.schema[n] for n in names], *found]))
    out = out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "votes", "weak_label", "score")
    return out.withColumn("kept", F.col("score") >= threshold)


def quality_report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return score_quality(docs, fit_quality_model(docs)).drop("text")
