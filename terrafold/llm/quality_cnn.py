"""Quality classifier: a byte-level convolutional network in numpy (operator 6).

A text's UTF-8 bytes pass through `FILTERS` learned filters of width `WIDTH` (one weight for each place and byte
value, so a filter's answer is a sum of table entries). The answers, rectified, are max-pooled over chunks of
`CHUNK` bytes that overlap by half and cover the whole text, however long. Per filter the mean, the least and the
greatest of the chunks' maxima are combined by one logistic unit into one probability. (The least shows text that
repeats itself: a chunk of it excites few filters.)

Learned by Adam on at most `FIT_ROWS` labelled texts, in whole; the gradient of a maximum reaches only the bytes that
made it. The classes weigh alike in the loss to the power `BALANCE`, so that the score stays near the label's rate.

Memory: texts are scored in slices of about `_SLICE` bytes; a longer text runs piece by piece.
Defined results: null and empty texts score `EMPTY_SCORE`, the share of label 1 if it is known; without labels of
both kinds every text scores that share. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import labelled_sample, need

FILTERS = 24
WIDTH = 5
CHUNK = 128
FIT_ROWS = 3_000
EPOCHS = 6
THRESHOLD = 0.3
BALANCE = 0.5
EMPTY_SCORE = 0.5
_HALF = CHUNK // 2
_SLICE = 1 << 19


@dataclass
class QualityModel:
    """table: [WIDTH, 256, FILTERS] filter weights; bias of the filters; weight and offset of the logistic unit."""

    table: np.ndarray | None
    bias: np.ndarray | None
    weight: np.ndarray | None
    offset: float
    empty: float

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Greatest rectified answer of each filter in each half chunk of the bytes; the last half may be shorter."""
        n = len(data) - WIDTH + 1
        out = np.take(self.table[0], data[:n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.table[k], data[k : n + k], axis=0)
        return np.maximum(np.maximum.reduceat(out, np.arange(0, n, _HALF), axis=0) + self.bias, 0)

    def features(self, data: np.ndarray) -> np.ndarray:
        """Mean, least and greatest over the chunks of one text's pooled answers."""
        if len(data) < CHUNK:
            data = np.concatenate([data, np.zeros(CHUNK - len(data), np.uint8)])
        step = _SLICE // _HALF * _HALF
        parts = [self.halves(data[a : a + step + WIDTH - 1]) for a in range(0, len(data) - WIDTH + 1, step)]
        return _combine(parts[0] if len(parts) == 1 else np.concatenate(parts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.empty)
        if self.table is None:
            return out
        use = [i for i, t in enumerate(texts) if t]
        if not use:
            return out
        x = np.stack([self.features(np.frombuffer(texts[i].encode("utf-8", "replace"), np.uint8)) for i in use])
        out[use] = 1 / (1 + np.exp(-np.clip(x @ self.weight + self.offset, -30, 30)))
        return out


def _combine(halves: np.ndarray) -> np.ndarray:
    """A last half of a few bytes says little; its chunk is the half before with it."""
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    return np.concatenate([chunks.mean(axis=0), chunks.min(axis=0), chunks.max(axis=0)])


class _Trainer:
    """Adam on the model's arrays."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = {"table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "weight": rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), "offset": np.zeros(1, np.float32)}
        self.m = {k: np.zeros_like(v) for k, v in self.values.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.values.items()}
        self.t = 0

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.values[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)


def _winners(table: np.ndarray, bias: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per half chunk and filter: the greatest answer and the place that gave it."""
    n = len(data) - WIDTH + 1
    out = np.take(table[0], data[:n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(table[k], data[k : n + k], axis=0)
    pad = -n % _HALF
    if pad:
        out = np.concatenate([out, np.full((pad, FILTERS), -np.inf, np.float32)])
    cube = out.reshape(-1, _HALF, FILTERS)
    at = cube.argmax(axis=1)
    best = np.take_along_axis(cube, at[:, None, :], axis=1)[:, 0, :]
    return np.maximum(best + bias, 0), at + (np.arange(len(cube)) * _HALF)[:, None]


def _winners_of(table: np.ndarray, bias: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a text of any length, slice by slice, so that what is held at once stays bounded."""
    step = _SLICE // _HALF * _HALF
    parts = [(_winners(table, bias, data[a : a + step + WIDTH - 1]), a) for a in range(0, len(data) - WIDTH + 1, step)]
    return np.concatenate([best for (best, _), _ in parts]), np.concatenate([at + a for (_, at), a in parts])


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7, batch: int = 16) -> QualityModel:
    """Fit on whole texts; without labels of both kinds the model answers the share of label 1."""
    share = float(np.mean(labels)) if len(labels) else EMPTY_SCORE
    kinds = np.asarray(labels, dtype=np.float32)
    pairs = [(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), y) for t, y in zip(texts, kinds) if t]
    if len(set(labels)) < 2:
        return QualityModel(None, None, None, 0.0, share)
    n1 = max(1, sum(1 for _, y in pairs if y))
    n0 = max(1, len(pairs) - n1)
    weigh = {1.0: (len(pairs) / (2 * n1)) ** BALANCE, 0.0: (len(pairs) / (2 * n0)) ** BALANCE}
    trainer, rng = _Trainer(seed), np.random.default_rng(seed + 1)
    for epoch in range(epochs):
        order = rng.permutation(len(pairs))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for a in range(0, len(order), batch):
            grads = {k: np.zeros_like(v) for k, v in trainer.values.items()}
            for i in order[a : a + batch]:
                _add_gradient(trainer.values, grads, pairs[i][0], float(pairs[i][1]), weigh[float(pairs[i][1])])
            for g in grads.values():
                g /= min(batch, len(order) - a)
            grads["weight"] += 1e-4 * trainer.values["weight"]
            trainer.step(grads, rate)
    v = trainer.values
    return QualityModel(v["table"], v["bias"], v["weight"].astype(np.float64), float(v["offset"][0]), share)


def _add_gradient(v: dict, grads: dict, data: np.ndarray, y: float, scale: float) -> None:
    if len(data) < CHUNK:
        data = np.concatenate([data, np.zeros(CHUNK - len(data), np.uint8)])
    halves, at = _winners_of(v["table"], v["bias"], data)
    if len(halves) > 1:
        first = halves[:-1] >= halves[1:]
        chunks = np.where(first, halves[:-1], halves[1:])
        places = np.where(first, at[:-1], at[1:])
    else:
        chunks, places = halves, at
    n = len(chunks)
    low, high = chunks.argmin(axis=0), chunks.argmax(axis=0)
    f = np.arange(FILTERS)
    x = np.concatenate([chunks.mean(axis=0), chunks[low, f], chunks[high, f]])
    p = 1 / (1 + np.exp(-np.clip(x @ v["weight"] + v["offset"][0], -30, 30)))
    d = np.float32((p - y) * scale)
    grads["weight"] += d * x
    grads["offset"] += d
    back = np.repeat((d * v["weight"][:FILTERS] / n)[None, :], n, axis=0)
    back[low, f] += d * v["weight"][FILTERS : 2 * FILTERS]
    back[high, f] += d * v["weight"][2 * FILTERS :]
    back[chunks <= 0] = 0
    grads["bias"] += back.sum(axis=0)
    columns = np.broadcast_to(f, places.shape).ravel()
    flat, values = places.ravel(), back.ravel()
    for k in range(WIDTH):
        cell = data[flat + k].astype(np.int64) * FILTERS + columns
        grads["table"][k] += np.bincount(cell, weights=values, minlength=256 * FILTERS).reshape(256, FILTERS).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, quality), at most `rows` labelled documents, those with the least hash of their id."""
    sample = labelled_sample(docs, labels, "quality", rows, "quality-sample").orderBy("doc_id").toPandas()
    return train(sample["text"].tolist(), sample["quality"].astype(int).tolist())


def verdict(spark: SparkSession, model: QualityModel, text: Column, threshold: float = THRESHOLD) -> Column:
    """score and predicted (1 from the threshold on) of a text column, as one struct."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in texts:
            scores = own.scores([t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"score": scores, "predicted": (scores >= threshold).astype("int32")})

    return judge.asNondeterministic()(text)  # else Spark may run it once more for each use of a field


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` of docs with score and predicted; one row for each row of docs."""
    found = need(docs, *dict.fromkeys([*keep, "text"])).select(*keep, verdict(docs.sparkSession, model, F.col("text"), threshold).alias("_verdict"))
    return found.select(*keep, "_verdict.*")
