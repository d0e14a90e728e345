"""Toxicity by classifier chains of linear models.

Categories are predicted one after another; the model of each also gets the probabilities of those before it. While
training, these are out-of-fold predictions, so a later model never sees what an earlier one has learned by heart.
Features say which of the chosen words, and beginnings of words (of 5 bytes), a text has, and three shares (capitals,
signs, repeated words). Words and beginnings are chosen by how clearly they go with any category: the ``features`` of
highest significance above ``least_z``. A category holds from the probability on that had the best F1 out of fold.

Labels are a bounded sample: the ``sample`` labelled documents whose ids' hashes come first (ids that are labelled twice
count once, with the larger label; of several texts of one id the smallest is read); word counts are taken on Spark, and
the driver gets no more than ``sample`` rows of at most ``features`` numbers. It fits ridge-penalised logistic regressions
by Newton steps, the folds from where the whole fit ended, and takes the penalty that loses least out of fold. Null and empty texts have no words and get what the models
say to that. Without labels, or with one label only, probabilities are the labels' mean (0 without any). Every text is
scored whole; repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import words as W
from sparkloom.llm._common import field, map_texts, scope, written

SHARES = 3
BEGINNING = 5  # bytes
PENALTIES = (1.0, 3.0, 10.0)  # the one with the least loss out of fold is taken


class Chain(NamedTuple):
    categories: tuple[str, ...]
    hashes: np.ndarray  # of the chosen words, sorted
    weights: list[np.ndarray]  # of each category: words, shares, earlier categories, constant
    cuts: list[float]  # the probability from which on a category is taken to hold


def _terms(own: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every word and every beginning of a word."""
    at, hashes = W.beginnings(own, BEGINNING)
    return np.concatenate([own.text, own.text[at]]), np.concatenate([own.hash, hashes])


def _shares(texts: list[str | None], own: W.Words) -> np.ndarray:
    out = np.zeros((len(texts), SHARES))
    count = np.bincount(own.text, minlength=len(texts))
    for i, t in enumerate(texts):
        if t:
            raw = np.frombuffer(t.encode(), np.uint8)
            kinds = np.bincount(_KIND[raw], minlength=4)
            out[i, 0] = kinds[1] / max(1, kinds[1] + kinds[2])
            out[i, 1] = kinds[3] / len(raw)
    pairs = np.unique(np.stack([own.text.astype(np.uint64), own.hash]), axis=1)[0].astype(np.int64) if len(own.hash) else np.zeros(0, np.int64)
    out[:, 2] = 1 - np.bincount(pairs, minlength=len(texts)) / np.maximum(1, count)
    return out


#: 1: capitals, 2: small letters, 3: signs, 0: anything else
_KIND = np.array([1 if chr(b).isupper() else 2 if chr(b).islower() else 3 if 33 <= b < 127 and not chr(b).isalnum() else 0 for b in range(128)] + [0] * 128)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse rows of ones, with some dense columns after them; kept by row and by column."""

    def __init__(self, lists: list[np.ndarray], width: int, dense: np.ndarray) -> None:
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.column = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.n, self.width, self.dense = len(lists), width, dense
        order = np.argsort(self.column, kind="stable")
        self.by_column = self.row[order]
        self.columns, self.column_at = np.unique(self.column[order], return_index=True)
        self.rows, self.row_at = np.unique(self.row, return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = self.dense @ w[self.width :]
        if len(self.row):
            out[self.rows] += np.add.reduceat(w[self.column], self.row_at)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.row):
            out[self.columns] = np.add.reduceat(r[self.by_column], self.column_at)
        return np.concatenate([out, self.dense.T @ r])


def _train(rows: _Rows, y: np.ndarray, use: np.ndarray, start: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps, each solved by conjugate gradients; the constant isn't penalised."""
    w = np.zeros(rows.width + rows.dense.shape[1]) if start is None else start.copy()
    if not use.any():
        return w
    if start is None:
        mean = np.clip(y[use].mean(), 1e-4, 1 - 1e-4)
        w[-1] = np.log(mean / (1 - mean))
    held = use.astype(float)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6  # labels that are all alike would draw it beyond all bounds

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(held @ (np.logaddexp(0, z) - y * z) + (ridge * w * w).sum() / 2)

    z = rows.times(w)
    before = loss(z, w)
    for _ in range(steps):
        p = _logistic(z)
        gradient = rows.back(held * (p - y)) + ridge * w
        bend = held * p * (1 - p)
        step, left = np.zeros_like(w), -gradient
        toward, size = left.copy(), left @ left
        least = 1e-4 * size  # a part of the gradient is enough for a step
        for _ in range(30):
            if size <= least or size == 0:
                break
            bent = rows.back(bend * rows.times(toward)) + ridge * toward
            go = size / max(toward @ bent, 1e-300)
            step, left = step + go * toward, left - go * bent
            size, was = left @ left, size
            toward = left + size / was * toward
        along, much = rows.times(step), 1.0
        while much > 1e-4 and not (after := loss(z + much * along, w + much * step)) < before:
            much /= 2
        if much <= 1e-4:
            break
        w, z = w + much * step, z + much * along
        before, gain = after, before - after
        if gain < 1e-5 * max(1.0, before):
            break
    return w


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1 on out-of-fold predictions, half-way to the next lower one."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((p[order[k]] + p[order[min(k + 1, len(p) - 1)]]) / 2)


def _choose(rows: DataFrame, columns: list[str], features: int, least_z: float, n: int, positives: list[int]) -> np.ndarray:
    """Hashes of the words that go most clearly with a category, counted over the sample's documents on Spark."""
    counted = rows.select(F.explode("words").alias("word"), *columns).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
    scores = []
    for c, held in zip(columns, positives):
        share = held / max(1, n)
        spread = F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
        scores.append(F.abs(F.col(c) - F.col("n") * share) / (spread + 1))
    best = counted.where("n >= 3").select("word", F.greatest(*scores, F.lit(0.0)).alias("z")).where(F.col("z") >= least_z)
    return np.sort(np.array([r["word"] for r in best.orderBy(F.desc("z"), "word").limit(features).collect()], np.int64).view(np.uint64))


def fit(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text",
    sample: int = 8_000, features: int = 4096, least_z: float = 2.0, folds: int = 4,
) -> Chain:
    """Train the chain on labelled documents; null labels count as 0. Categories may have any names."""
    columns = [f"y{i}" for i in range(len(categories))]
    own = labels.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("int").alias(y) for c, y in zip(categories, columns)])
    given = own.where("id IS NOT NULL").groupBy("id").agg(*[F.max(y).alias(y) for y in columns])
    chosen = given.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min("text").alias("text"))

    def make():
        def read(texts: list[str | None]) -> dict:
            own = W.split(texts)
            shares = _shares(texts, own)
            text, hashes = _terms(own)
            order = np.argsort(text, kind="stable")
            hashes = hashes[order]
            cuts = np.searchsorted(text[order], np.arange(len(texts) + 1))
            return {"words": [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:])], "shares": [s.astype(np.float32) for s in shares]}

        return read

    read = map_texts(texts, "id", "text", [field("words", "array<bigint>"), field("shares", "array<float>")], make)
    with scope():
        rows = written(read.join(F.broadcast(chosen), "id"), "labelled")
        total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in columns]).first()
        hashes = _choose(rows, columns, features, least_z, total["n"], [total[y] for y in columns])
        sent = rows.sparkSession.sparkContext.broadcast(hashes)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen_words = sent.value
            for batch in batches:
                words = batch.column("words")
                values = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.minimum(np.searchsorted(chosen_words, values), max(0, len(chosen_words) - 1))
                hit = chosen_words[at] == values if len(chosen_words) else np.zeros(len(values), bool)
                ends = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists, *(batch.column(c) for c in ("shares", *columns))], names=["id", "words", "shares", *columns])

        kinds = [rows.schema["id"], field("words", "array<int>"), *(rows.schema[c] for c in ("shares", *columns))]
        small = rows.select("id", "words", "shares", *columns).mapInArrow(pick, T.StructType(kinds)).toPandas().sort_values("id")
    lists = [np.asarray(x, np.int64) for x in small.words]
    shares = np.array(small.shares.tolist(), float).reshape(-1, SHARES)
    fold = np.arange(len(small)) % folds
    earlier = np.zeros((len(small), 0))
    weights, cuts = [], []
    for c in columns:
        y = small[c].to_numpy(float)
        own = _Rows(lists, len(hashes), np.hstack([shares, earlier, np.ones((len(small), 1))]))
        if not len(small):
            weights.append(np.append(np.zeros(own.width + own.dense.shape[1] - 1), -30.0))
            cuts.append(0.5)
            earlier = np.zeros((0, earlier.shape[1] + 1))
            continue
        best = np.inf
        for penalty in PENALTIES:
            fitted = _train(own, y, np.ones(len(small), bool), penalty=penalty)
            p = np.zeros(len(small))
            for f in range(folds):
                p[fold == f] = _logistic(own.times(_train(own, y, fold != f, fitted, penalty)))[fold == f]
            loss = -np.log(np.where(y > 0, p, 1 - p)).mean()
            if loss < best:
                best, whole, out_of_fold = loss, fitted, p
        weights.append(whole)
        cuts.append(_cut(out_of_fold, y))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return Chain(tuple(categories), hashes, weights, cuts)


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, and p_<category> and is_<category> for every category, one row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        own_chain: Chain = sent.value
        known = W.HashSet(own_chain.hashes)

        def predict(texts: list[str | None]) -> dict:
            own = W.split(texts)
            text, hashes = _terms(own)
            at, k = known.find(hashes) if len(known.sorted) else (np.zeros(0, np.int64),) * 2
            pair = np.unique(text[at] * max(1, len(known.sorted)) + k)
            row, column = np.divmod(pair, max(1, len(known.sorted)))
            dense = _shares(texts, own)
            out = {}
            for c, w, cut in zip(own_chain.categories, own_chain.weights, own_chain.cuts):
                columns = np.hstack([dense, np.ones((len(texts), 1))])
                p = _logistic(np.bincount(row, weights=w[column], minlength=len(texts)) + columns @ w[len(known.sorted) :])
                dense = np.hstack([dense, p[:, None]])
                out |= {f"p_{c}": p, f"is_{c}": p >= cut}
            return out

        return predict

    return map_texts(docs, id_col, text_col, [f for c in chain.categories for f in (field(f"p_{c}", "double"), field(f"is_{c}", "boolean"))], make)
