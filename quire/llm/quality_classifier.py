"""Quality of a text by compression against dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text.  A text is cut into blocks, every
block is compressed with either dictionary, and the summed sizes give the normalised difference
``(bad - good) / (bad + good)``: text like the good one is smaller with the good dictionary.
A logistic curve over that difference and over how far the text shrinks at all (both sizes
against the bytes) makes it a probability; it is fitted on labelled rows that the dictionaries
did not see.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_column, broadcast_bytes, held, utf8

#: Bytes of a block, of a dictionary, and the compression level.
BLOCK, DICTIONARY, LEVEL = 1024, 112_640, 3
#: The fit uses at most about this many labelled rows of either label, and stops taking rows
#: of a label once this many bytes of text are reached.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 8 << 20
#: At least this many texts of a label share those bytes, if there are as many.
SAMPLE_TEXTS = 64


@dataclass(frozen=True)
class Model:
    """Dictionaries and curve; without a dictionary every score is ``prior``."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


class Compressors:
    def __init__(self, good: bytes, bad: bytes) -> None:
        def make(data: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )

        self.good, self.bad = make(good), make(bad)

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        """Bytes of the text, and compressed with the good and with the bad dictionary."""
        good = bad = 0
        view = memoryview(text)
        for at in range(0, len(text), BLOCK):
            block = view[at : at + BLOCK]
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        return len(text), good, bad


def features(sizes: np.ndarray) -> np.ndarray:
    """Columns of the curve for rows of (bytes, good, bad); an empty text is incompressible."""
    n, good, bad = sizes.T.astype(float)
    both = np.maximum(good + bad, 1.0)
    d = np.where(n > 0, (bad - good) / both, 0.0) * 10
    r = np.where(n > 0, np.log(both / np.maximum(2 * n, 1.0)), 0.0)
    short = 1.0 / np.sqrt(1.0 + n / 64.0)
    return np.stack([np.ones_like(d), d, d * d, r, r * r, d * r, short, d * short], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Logistic regression by Newton's method, halving steps that don't lower the loss.

    The first column is constant.  The ridge holds the others, scaled to unit deviation, so
    that the weights stay finite where the labels can be told apart entirely.
    """
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    mean[0], scale[0] = 0.0, 1.0
    z, hold = (x - mean) / scale, ridge * (np.arange(x.shape[1]) > 0) + 1e-6

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + hold @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (y - p) - hold * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    w = w / scale
    w[0] -= w[1:] @ mean[1:]
    return w


def train(rows: Iterable[tuple[int, bytes]], prior: float) -> Model:
    """Model from (label, text): alternate rows build the dictionaries and fit the curve."""
    by = {0: [], 1: []}
    for label, text in rows:
        by[label].append(text)
    build = {k: v[::2] for k, v in by.items()}
    fit = {k: v[1::2] for k, v in by.items()}
    data = {}
    for k, texts in build.items():
        blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        try:
            data[k] = zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
        except zstandard.ZstdError:  # too little text: the text itself is the dictionary
            data[k] = b"".join(blocks)[-DICTIONARY:]
    if min(map(len, data.values())) < 8 or not (fit[0] and fit[1]):
        return Model(b"", b"", (), prior)
    own = Compressors(data[1], data[0])
    sizes = np.array([own.sizes(t) for k in (0, 1) for t in fit[k]])
    y = np.repeat([0.0, 1.0], [len(fit[0]), len(fit[1])])
    w = _logistic(features(sizes), y)
    # the sample may hold another share of good rows than the labels do
    odds = np.log(prior / (1 - prior)) - np.log(len(fit[1]) / len(fit[0]))
    w[0] += odds
    return Model(data[1], data[0], tuple(w.tolist()), prior)


def _spread(texts: pa.Array, shares: pa.Array) -> pa.Array:
    """UTF-8 of each text; of one longer than the share, as many whole blocks, evenly apart."""
    out = []
    for t, share in zip(utf8(texts), shares, strict=True):
        share = share.as_py()
        if len(t) > max(share, BLOCK):
            n = max(1, share // BLOCK)
            starts = [i * (len(t) - BLOCK) // max(1, n - 1) for i in range(n)]
            t = b"".join(t[a : a + BLOCK] for a in starts)
        out.append(t)
    return pa.array(out, pa.binary())


def fit(
    documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality"
) -> Model:
    """Model from labelled documents.

    Rows without id, text or a label of 0 or 1 are left out, so are empty texts; an id that is
    labelled both ways counts for both, and of rows with one id the greatest text counts.  At most about ``SAMPLE_ROWS`` rows and
    ``SAMPLE_BYTES`` bytes of either label are used, chosen by a hash of the id; of a text longer
    than its share of the bytes, blocks spread over all of it.  Without rows of both labels the score is the share of good rows (one half without any).
    """
    named = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).select(
        F.col(doc).alias("_id"), F.col(label).cast("int").alias("_y")
    ).distinct()
    count = {r[0]: r[1] for r in named.groupBy("_y").count().collect()}
    total = sum(count.values())
    prior = min(max(count.get(1, 0) / total, 0.01), 0.99) if total else 0.5
    if len(count) < 2:
        return Model(b"", b"", (), prior)
    chance = F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30))
    share = {y: min(1.0, SAMPLE_ROWS / n) for y, n in count.items()}
    chosen = named.where(
        chance < F.when(F.col("_y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    )
    # at most about 2 * SAMPLE_ROWS ids: bounded by the parameter
    rows = documents.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.where(F.octet_length("_text") > 0).withColumn("_at", chance)
    rows = rows.withColumn("_text", arrow_column(_spread, "binary", F.col("_text"), F.lit(SAMPLE_BYTES // SAMPLE_TEXTS)))
    # one text of an id that repeats, found on the way: its rows, however many, never meet in a task
    rows = rows.groupBy("_id", "_y", "_at").agg(F.max("_text").alias("_text"))
    before = Window.partitionBy("_y").orderBy("_at", "_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.coalesce(F.sum(F.octet_length("_text")).over(before), F.lit(0)))
    taken = rows.where(F.col("_sum") < SAMPLE_BYTES).orderBy("_at", "_id", "_text")
    return train(((r["_y"], bytes(r["_text"])) for r in taken.collect()), prior)


def _load(data: bytes) -> tuple[Model, Compressors | None]:
    model = pickle.loads(data)
    return model, Compressors(model.good, model.bad) if model.weights else None


def score(documents: DataFrame, text: Column, model: Model) -> Column:
    """Probability that ``text`` is good, from 0 to 1; null counts as empty."""
    shared = broadcast_bytes(documents.sparkSession, pickle.dumps(model))

    def judge(texts: pa.Array) -> pa.Array:
        own, compressors = held("quality", shared.value, _load)
        if compressors is None:
            return pa.array(np.full(len(texts), own.prior))
        sizes = np.array([compressors.sizes(t) for t in utf8(texts)]).reshape(-1, 3)
        x = np.clip(features(sizes) @ np.array(own.weights), -30, 30)
        return pa.array(1 / (1 + np.exp(-x)))

    return arrow_column(judge, "double", text)


def held_out(doc: Column) -> Column:
    """One id in five is kept from the fit."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on the labels that are not held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def predicted(score: str = "score") -> Column:
    """1 for a score of 0.3 or more, else 0."""
    return F.when(F.col(score) >= 0.3, 1).otherwise(0)
