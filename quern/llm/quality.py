"""Quality from compression: which of two zstandard dictionaries suits a text better.

One dictionary is trained on good labelled texts and one on bad. A text is compressed in blocks with
each, so that it can't become its own dictionary, and the difference of the two sizes by their sum
says which it is nearer to. A logistic calibration turns the difference into a probability; beside it,
only the length counts, as the difference of a short text says less than that of a long one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .labelled import fit_logistic, fold_of, labelled_sample, sigmoid

#: Bytes of a dictionary and of a block; zstandard's level; blocks of training text for a dictionary at most.
DICTIONARY_BYTES = 65_536
BLOCK_BYTES = 1024
LEVEL = 3
TRAINING_BLOCKS = 6_000
FOLDS, HELD_OUT = 3, 1
LABEL = "quality"


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK_BYTES] for i in range(0, max(1, len(raw)), BLOCK_BYTES)]


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts' blocks; the blocks themselves where they are too few to train on."""
    blocks = [b for t in texts for b in _blocks(t.encode("utf-8", "surrogatepass")) if len(b) >= 32]
    random.Random(0).shuffle(blocks)
    blocks = blocks[:TRAINING_BLOCKS]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=200, d=8, steps=0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**plain)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **plain)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """(good, bad, raw) bytes of each text."""
        if not hasattr(self, "_tools"):
            self._tools = (_compressor(self.good), _compressor(self.bad))
        good, bad = self._tools
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            blocks = _blocks(raw)
            out[i] = sum(len(good.compress(b)) for b in blocks), sum(len(bad.compress(b)) for b in blocks), len(raw)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (calibration_inputs(self.sizes(texts)) - self.mean) / self.scale
        return sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.weights)


def calibration_inputs(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference and the logarithm of the length, their squares and their product."""
    good, bad, raw = sizes.T
    d, length = (bad - good) / np.maximum(1, bad + good), np.log1p(raw)
    return np.column_stack([d, length, d * d, d * length, length * length])


def fit_quality(texts: list[str], labels: np.ndarray) -> QualityModel:
    """Half of the sample trains the dictionaries, the other half calibrates. Without both labels, the score is the label's share."""
    half = np.arange(len(texts)) % 2 == 0
    good = train_dictionary([t for t, y, h in zip(texts, labels, half, strict=True) if h and y == 1])
    bad = train_dictionary([t for t, y, h in zip(texts, labels, half, strict=True) if h and y == 0])
    model = QualityModel(good, bad, np.zeros(6), np.zeros(5), np.ones(5))
    rest = [t for t, h in zip(texts, half, strict=True) if not h]
    if rest:
        x = calibration_inputs(model.sizes(rest))
        model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        model.weights = fit_logistic((x - model.mean) / model.scale, labels[~half])
    return model


def fit_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return fit_quality(*labelled_sample(docs, labels, LABEL, FOLDS, HELD_OUT))


def score_column(docs: DataFrame, model, text_col: str = "text"):
    """A column of docs: the model's score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]), dtype="float64")

    return score(F.col(text_col))


def score_documents(docs: DataFrame, model, folds: int, held_out: int) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = shared.value.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return map_arrow(rows, score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of good quality), predicted.

    The model is fitted on a bounded sample of labelled rows outside the held-out fold (see
    labelled.py for the bound); every whole text is scored, however long. A null text counts as empty.
    Repeated rows are scored each and equal texts equally; a null id counts as not held out. Without
    labels every score is 0.5. Other columns don't matter; an empty table gives an empty result.
    """
    return score_documents(docs, fit_on(docs, labels), FOLDS, HELD_OUT)


def good_rows(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns.

    A null text is scored as an empty one; repeated rows stay or go together; columns may have any
    name; an empty table gives an empty result.
    """
    return docs.where(score_column(docs, model) >= least)
