"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, on windows of ordinary and of toxic
text. A third, not trained, is the ordinary one with the words that toxic text
uses ``MIN_RATIO`` times as often. A text is cut at white space into short
windows, each compressed with all three; the bytes that the toxic dictionary and
the one with the words save against the ordinary one are the window's evidence.
A document's largest, mean top and counted savings of both kinds go into a
logistic function fitted on labelled documents that the dictionaries have not
seen, and moved so that 0.5 is the calibrated threshold: the lowest that calls at
most ``FALSE_SHARE`` of the ordinary ones toxic, between ``LOWEST`` and ``HIGHEST``
of the function before.

Bounds: at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled texts train the
dictionaries and ``CALIBRATION_ROWS`` the logistic function, the lowest by a
hash of the id; at most ``SAMPLE_WINDOWS`` windows train a dictionary, in that
order, and ``MAX_WORDS`` words are added; every document's whole text is scored. Only text is an input of
a score.

Defined results: a null or empty text is one empty window. If either label is
missing from the training rows, every score is the smoothed share of toxic
ones. Equal texts have equal scores. Rows with equal ids train as often as they
occur. An empty table gives an empty result. A column that is called as the new
one is replaced, others pass whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexafact.llm.mapping import add_columns

TOXIC_ROWS = 2_000
ORDINARY_ROWS = 4_000
CALIBRATION_ROWS = 5_000
SAMPLE_WINDOWS = 200_000
WINDOW_BYTES = 40
LEVEL = 3
DICTIONARY_BYTES = 8192
#: Words of the third dictionary: seen in this many different contexts, and this many times as often in toxic text.
MIN_CONTEXTS, MIN_RATIO, MAX_WORDS = 6, 20.0, 800
#: The threshold lets this share of the ordinary calibration rows be called toxic, if it lies within LOWEST and HIGHEST.
FALSE_SHARE, LOWEST, HIGHEST = 0.01, 0.2, 0.5

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes) -> list[bytes]:
    """Windows: whole words until they reach WINDOW_BYTES, ASCII letters in lower case."""
    out, own, size = [], [], 0
    for word in text.lower().split():
        own.append(word)
        size += len(word) + 1
        if size >= WINDOW_BYTES:
            out.append(b" " + b" ".join(own) + b" ")
            own, size = [], 0
    if own or not out:
        out.append(b" " + b" ".join(own) + b" ")
    return out


@dataclass(frozen=True)
class Model:
    """The three dictionaries' contents and the logistic function's weights (means, deviations, coefficients, constant)."""

    ordinary: bytes
    toxic: bytes
    marked: bytes
    weights: tuple[tuple[float, ...], ...]
    prior: float

    @property
    def key(self) -> str:
        return hashlib.sha256(self.ordinary + b"|" + self.toxic + b"|" + self.marked).hexdigest()


class Compressors:
    """Compressors with each dictionary; one set for a process and model."""

    _kept: dict[str, Compressors] = {}

    def __init__(self, model: Model) -> None:
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        made = []
        for content in (model.ordinary, model.toxic, model.marked):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
        self.ordinary, self.toxic, self.marked = made

    @classmethod
    def of(cls, model: Model) -> Compressors:
        if model.key not in cls._kept:
            cls._kept.clear()
            cls._kept[model.key] = cls(model)
        return cls._kept[model.key]

    def evidence(self, text: bytes) -> tuple[float, ...]:
        windows = cut(text)
        plain = np.array([len(self.ordinary(w)) for w in windows])
        out: list[float] = []
        for compress in (self.toxic, self.marked):
            saved = plain - np.array([len(compress(w)) for w in windows])
            top = np.sort(saved)[-3:]
            out += [float(top[-1]), float(top.mean()), *(float(np.log1p((saved >= k).sum())) for k in (3, 5, 7, 9))]
        return (*out, float(np.log1p(len(windows))))


FEATURES = 13


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Texts of which at most a fifth of the 3-word shingles occurred in earlier ones: near copies would count as usage."""
    seen: set[int] = set()
    out = []
    for t in dict.fromkeys(texts):
        w = _WORD.findall(t)
        own = {hash(tuple(w[i : i + 3])) for i in range(max(1, len(w) - 2))}
        if len(own & seen) * 5 <= len(own):
            out.append(t)
        seen |= own
    return out


def _contexts(texts: list[bytes]) -> Counter:
    """In how many different (previous, next) contexts each word occurs."""
    seen: set[int] = set()
    out: Counter = Counter()
    for t in texts:
        w = [b"", *_WORD.findall(t.lower()), b""]
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            h = hash((a, b, c))
            if h not in seen:
                seen.add(h)
                out[b] += 1
    return out


def trained(texts: list[bytes]) -> bytes:
    samples = [w for t in texts for w in cut(t)][:SAMPLE_WINDOWS]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Contents of the ordinary dictionary, of the toxic one and of the one with toxic words."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    base = trained(ordinary)
    often, rarely = _contexts(toxic), _contexts(ordinary)
    ratio = {w: (n / len(toxic)) / ((rarely[w] + 0.5) / max(1, len(ordinary))) for w, n in often.items() if n >= MIN_CONTEXTS}
    marked = sorted((w for w, r in ratio.items() if r >= MIN_RATIO), key=lambda w: (often[w], w))[-MAX_WORDS:]
    return base, trained(toxic), base + b" " + b" ".join(marked) + b" "


def fit(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], ...]:
    """Logistic regression with a small ridge, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(z.shape[1] - 1, 0.1), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], ...]:
    """The weights of ``fit``, moved so that the threshold scores 0.5."""
    mean, scale, w = fit(x, y)
    p = _logistic(x, mean, scale, w)
    t = float(np.clip(np.quantile(p[y == 0], 1 - FALSE_SHARE), LOWEST, HIGHEST))
    return mean, scale, (*w[:-1], w[-1] - float(np.log(t / (1 - t))))


def _logistic(x: np.ndarray, mean: tuple, scale: tuple, w: tuple) -> np.ndarray:
    # summed row by row: a matrix product may round equal rows differently
    return 1 / (1 + np.exp(-np.clip((((x - np.array(mean)) / np.array(scale)) * np.array(w[:-1])).sum(1) + w[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", seed: int = 11) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, 1: toxic), one row for each id. Null labels and null texts are left out.

    Ids are chosen from the labels alone, so the texts are read, never shuffled.
    """
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), (F.col(label) == 1).cast("int").alias("y"), F.xxhash64(F.col(doc_id), F.lit(seed)).alias("h"))
    half = F.pmod("h", F.lit(2))

    def lowest(which, n: int, part: str) -> list[tuple]:
        return [(r["id"], r["y"], r["h"], part) for r in ids.where(which).orderBy("h", "id").limit(n).collect()]

    chosen = lowest((F.col("y") == 1) & (half == 0), TOXIC_ROWS, "words") + lowest((F.col("y") == 0) & (half == 0), ORDINARY_ROWS, "words") + lowest(half == 1, CALIBRATION_ROWS, "fit")
    prior = (sum(c[1] for c in chosen) + 1) / (len(chosen) + 2)
    table = F.broadcast(spark.createDataFrame(chosen, "id bigint, y int, h bigint, part string"))  # a bounded sample
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(table, "id")
    words = sorted(((r["h"], r["id"], r["t"].encode(), r["y"]) for r in rows.where("part = 'words'").select("h", "id", "t", "y").collect()))
    toxic, ordinary = [w[2] for w in words if w[3]], [w[2] for w in words if not w[3]]
    if not toxic or not ordinary:
        return Model(b"", b"", b"", (), prior)
    made = dictionaries(toxic, ordinary)
    got = sorted((r["h"], r["id"], r["y"], r["evidence"]) for r in _evidence(rows.where("part = 'fit'"), Model(*made, (), prior), "t", ["h", "id", "y"]).collect())
    if len({g[2] for g in got}) < 2:
        return Model(b"", b"", b"", (), prior)
    return Model(*made, calibrated(np.array([g[3] for g in got], float), np.array([g[2] for g in got], float)), prior)


def _evidence(df: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    def found(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
        raw, of = data.tobytes(), Compressors.of(model).evidence
        return {"evidence": pa.array([of(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.list_(pa.float64()))}

    return add_columns(df, found, [T.StructField("evidence", T.ArrayType(T.DoubleType()))], text, keep)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add each whole text's score, 0 to 1."""

    def found(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
        n = len(offs) - 1
        if not model.weights:
            return {out: np.full(n, model.prior)}
        raw, of = data.tobytes(), Compressors.of(model).evidence
        x = np.array([of(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)])
        return {out: _logistic(x, *model.weights)}

    return add_columns(docs, found, [T.StructField(out, T.DoubleType())], text, keep)
