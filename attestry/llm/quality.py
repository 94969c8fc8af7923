"""Compression classifier for text quality.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed in blocks
against each; the bytes that the good dictionary saves over the bad one, per byte of text, become a score by
a logistic curve fitted on labelled texts that the dictionaries have not seen. Short texts are drawn towards the mean gain of good text, since their
few bytes say little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, prepare

BLOCK = 512
DICTIONARY_BYTES = 1 << 15
LEVEL = 3
#: Bytes of average good text that every text is taken to have besides its own.
PRIOR_BYTES = 100
#: The bound of the sample that the classifier is fitted on: texts of each class, and code points of a text.
SAMPLE_TEXTS = 3000
SAMPLE_CHARS = 20_000


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    mean_gain: float
    slope: float
    offset: float

    def compressors(self) -> tuple:
        def one(blob: bytes):
            data = zstandard.ZstdCompressionDict(blob) if blob else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

        return one(self.good), one(self.bad)

    def gains(self, texts: list[str | None]) -> np.ndarray:
        """Per text: bytes saved by the good dictionary, per byte, with the prior."""
        good, bad = self.compressors()
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            saved = 0
            for i in range(0, len(raw), BLOCK):
                part = raw[i : i + BLOCK]
                saved += len(bad.compress(part)) - len(good.compress(part))
            out[k] = (saved + PRIOR_BYTES * self.mean_gain) / (len(raw) + PRIOR_BYTES)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.gains(texts) + self.offset, -40, 40)))


def _dictionary(texts: list[str]) -> bytes:
    parts = [raw[i : i + BLOCK] for raw in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to learn from: the text itself serves
        return b"".join(parts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a little ridge on the slope."""
    scale = float(x.std()) or 1.0
    z = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.01, 1e-6])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([0.01, 0]) * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_on(texts: list[str], good: list[bool]) -> Classifier:
    """Fits on labelled texts in hand: every other one builds the dictionaries, the rest calibrate."""
    build = [(t, g) for k, (t, g) in enumerate(zip(texts, good, strict=True)) if k % 2 == 0]
    rest = [(t, g) for k, (t, g) in enumerate(zip(texts, good, strict=True)) if k % 2 == 1]
    lines = [{x for t, g in build if g == kind for x in t.split("\n")} for kind in (True, False)]
    both = lines[0] & lines[1]  # lines that either class has say nothing about it

    def own(kind: bool) -> list[str]:
        return [t for t in ("\n".join(x for x in t.split("\n") if x not in both) for t, g in build if g == kind) if t]

    model = Classifier(_dictionary(own(True)), _dictionary(own(False)), 0.0, 1.0, 0.0)
    if rest:
        y = np.array([g for _, g in rest], float)
        raw = [t for t, _ in rest]
        size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in raw], float)
        saved = model.gains(raw) * (size + PRIOR_BYTES)
        if y.sum():
            model.mean_gain = float(saved[y == 1].sum() / max(1.0, size[y == 1].sum()))
        if 0 < y.sum() < len(y):
            model.slope, model.offset = _logistic((saved + PRIOR_BYTES * model.mean_gain) / (size + PRIOR_BYTES), y)
        else:
            model.slope, model.offset = 0.0, 40.0 if y.sum() else -40.0
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Classifier:
    """Learns from labelled rows outside the held-out fold: at most ``sample_texts`` a class, chosen by a hash of the id.

    A document with both labels teaches both. Texts longer than ``sample_chars`` are left out of the sample (not of the scoring). Rows without a quality
    label or id teach nothing; if one class is missing all scores are those of the other, and without labels 0.5.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.where(fold_of(F.col("doc_id"), folds) != held_out).distinct()
    order = F.xxhash64("doc_id")
    some = [labels.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample_texts) for q in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * sample_texts rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= sample_chars).join(chosen, "doc_id")
    rows = texts.orderBy(order, "doc_id", "quality").limit(2 * sample_texts).select("text", "quality").collect()
    return fit_on([r["text"] for r in rows], [r["quality"] == 1 for r in rows])


def _scored(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.scores(texts), pa.float64())], names=[*batch.schema.names, name])

    return run


def with_quality(docs: DataFrame, model: Classifier, name: str = "quality_score") -> DataFrame:
    """``docs`` with a last column ``name`` (0 to 1, higher is better); needs a column ``text``.

    A null text counts as an empty one. All rows and columns come back. If there is a column of that name already (in any case), the
    score's name gets as many underscores in front as make it new. The whole text is compressed, in blocks of ``BLOCK`` bytes.
    """
    prepare(docs.sparkSession)
    there = {c.lower() for c in docs.columns}
    while name.lower() in there:
        name = "_" + name
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(shared, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
