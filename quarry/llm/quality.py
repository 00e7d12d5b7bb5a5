"""Quality classifier by compression: texts are compressed against a dictionary of good and one of bad labelled text; the
difference of the two sizes, normalised by the text's length, becomes a calibrated score. It is the score's only input."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import discard, fold, map_text, sampled, slices, stored, to_bytes
from quarry.llm.compression import Logistic, SizeModel, gather


@dataclass(frozen=True)
class QualityParams:
    """dictionary_bytes: room of each dictionary. sample_rows: labelled rows taken of each class, in hash order: the bound of
    what reaches the driver, with sample_chars of each one's text. piece: a text is compressed in pieces of so many bytes, so
    that its own repetitions don't drown what the dictionaries add. level: of zstandard."""

    dictionary_bytes: int = 2 << 20
    sample_rows: int = 2500
    sample_chars: int = 8192
    piece: int = 2048
    level: int = 9
    folds: int = 3
    held_out: int = 1
    threshold: float = 0.5


@dataclass
class QualityModel:
    sizes: SizeModel
    calibration: Logistic | None
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1; a model fitted on no rows of one class gives the other class's share for every text."""
        if self.calibration is None:
            return np.full(len(texts), self.prior)
        return self.calibration(difference(self.sizes, texts))


def difference(sizes: SizeModel, texts: list[bytes]) -> np.ndarray:
    """How many bytes less a text takes under the good dictionary than under the bad one, per byte of it; one column."""
    both = sizes.sizes(texts).astype(np.float64)
    return ((both[:, 1] - both[:, 0]) / np.maximum([len(t) for t in texts], 1))[:, None]


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Learns from labelled rows outside the held-out fold. In hash order, even rows of each class build its dictionary and
    odd rows calibrate, weighted by how often the class occurs among all learnable labels. Repeated labels of an id count
    once, by the largest; null ids and labels, and null and empty texts, teach nothing; of a longer text than sample_chars, so
    much is learned from, so classes of long texts lose no rows."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), params.folds) != params.held_out))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    own = [sampled(known.where(F.col("quality") == q), F.col("doc_id"), 2 * params.sample_rows, counts.get(q, 0)) for q in (1, 0)]
    ids = [o.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * params.sample_rows) for o in own]  # twice as many, as some may have no text
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").where(F.length("text") > 0)
        .groupBy("doc_id", "quality").agg(F.min(F.substring("text", 1, params.sample_chars)).alias("text"))
    )
    rows = stored(rows)
    first = [rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows) for q in (1, 0)]
    by_class = [[r["text"].encode() for r in own.select("text", "doc_id").collect()] for own in first]
    discard(rows)
    halves = [(rows[::2], rows[1::2]) for rows in by_class]
    sizes = SizeModel([gather(build, params.dictionary_bytes)[0] for build, _ in halves], params.level, params.piece)
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = counts.get(1, 0) / total if total else 0.5
    held = [rows for _, rows in halves]
    if not all(held):
        return QualityModel(sizes, None, prior)
    y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    weight = np.repeat([counts[1] / len(held[0]), counts[0] / len(held[1])], [len(held[0]), len(held[1])])
    return QualityModel(sizes, Logistic(difference(sizes, held[0] + held[1]), y, weight), prior)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with a column quality_score (replaced if there): a narrow pass over whole texts. Null text counts as empty."""
    schema = T.StructType([*docs.drop("quality_score").schema.fields, T.StructField("quality_score", T.DoubleType())])
    at = docs.drop("quality_score").columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                values = pa.array(model.score(to_bytes(part.column(at))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, "quality_score"])

    return map_text(docs.drop("quality_score"), run, schema)


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: better), predicted. Repeated rows each get a row, an
    empty table gives none, null ids count as not held out. Only the text is an input of the score."""
    narrow = docs.select("doc_id", "text")
    return score(narrow, fit(narrow, labels, params)).select(
        "doc_id",
        (fold(F.col("doc_id"), params.folds) == params.held_out).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= params.threshold).cast("int").alias("predicted"),
    )
