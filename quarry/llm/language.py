"""Language identification by compression: the language whose dictionary compresses a text best, with a rejection margin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fold, map_text, slices
from quarry.llm.compression import SizeModel, gather

UNDETERMINED = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageParams:
    """dictionary_bytes: room of each language's dictionary, filled with whole texts in hash order from at most sample_rows
    documents of 32 to sample_chars characters; where those leave half of the room or more, with others too, long ones cut to
    sample_chars. languages: over so many, all are learned still, and share the rows and the room of so many. margin: a best language whose
    lead over the next, as a share of the next one's size, is less counts as rejected; keep_rejected: still name it."""

    dictionary_bytes: int = 128 << 10
    sample_rows: int = 400
    sample_chars: int = 8192
    languages: int = 64
    level: int = 9
    folds: int = 4
    held_out: int = 2
    margin: float = 0.01
    keep_rejected: bool = True


@dataclass
class LanguageModel:
    names: list[str]
    sizes: SizeModel
    priors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Name, score and margin of each. The languages stand most frequent first, so that ties go to the commoner one.
        A size is some -log2 p of the text in bytes; the score is the best language's share of exp(lead), in 0 to 1."""
        clean = [normalise(t) for t in texts]
        letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts], dtype=bool)
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        sizes = self.sizes.sizes(clean).astype(np.float64)
        best = sizes.argmin(axis=1)
        lead = np.exp(np.maximum(sizes.min(axis=1, keepdims=True) - sizes, -500) / 4) * self.priors
        score = lead[np.arange(len(best)), best] / lead.sum(axis=1)
        if len(self.names) > 1:
            two = np.partition(sizes, 1, axis=1)
            margin = (two[:, 1] - two[:, 0]) / np.maximum(1, two[:, 1])
        else:
            margin = np.ones(len(best))
        names = [self.names[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0), np.where(letters, margin, 0.0)


def normalise(text: str | None) -> bytes:
    """Lower case, with one space for whatever is not a letter."""
    return f" {_NOT_LETTERS.sub(' ', text.lower())} ".encode() if text else b""


def _filled(texts: dict[bytes, None], room: int) -> bytes:
    """Texts joined up to the room, the last one cut where a character begins."""
    return b"\n".join(texts)[:room].decode(errors="ignore").encode()


def _sample(known: DataFrame, wanted: dict[str, int], rows: int, chars: int, usual: bool) -> dict[str, dict[bytes, None]]:
    """Normalised texts of each wanted language (with its number of documents) in hash order, at most rows of each, in one pass
    over known: a filter by hash leaves about four times as many before they are ordered."""
    parts = 1 << 30
    spark = known.sparkSession
    most = [(name, float(parts if n <= 4 * rows else max(1, 4 * rows * parts // n))) for name, n in wanted.items()]
    limits = F.broadcast(spark.createDataFrame(most, "lang string, most double"))  # a row per language
    between = F.length("text").between(32, chars)
    own = known.where(between if usual else F.col("text").rlike(r"\p{L}") & ~between).join(limits, "lang")
    own = own.where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(parts)) < F.col("most")) if usual else own
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "doc_id"))
    taken = own.select("lang", F.substring("text", 1, chars).alias("text"), nth.alias("nth")).where(F.col("nth") <= rows)
    out: dict[str, dict[bytes, None]] = {name: {} for name in wanted}
    for r in taken.orderBy("nth").collect():
        out[r["lang"]][normalise(r["text"])] = None
    return out


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learns from text and non-null lang outside the held-out fold (a null id is not held out); counts cover all rows, the
    dictionaries a bounded sample in hash order of the texts. A language whose texts have no letter has an empty dictionary and
    wins only where no other is better."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & (fold(F.col("doc_id"), params.folds) != params.held_out))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    share = min(1.0, params.languages / max(1, len(counts)))  # over so many languages, rows and room of each shrink, and their sums stay
    room, rows = max(1, int(params.dictionary_bytes * share)), max(4, int(params.sample_rows * share))
    sizes = {r["lang"]: r["n"] for r in counts}
    texts = _sample(known, sizes, rows, params.sample_chars, True) if sizes else {}
    raw = {name: gather(own, room)[0] for name, own in texts.items()}
    if thin := {name: sizes[name] for name in raw if len(raw[name]) < room // 2}:
        for name, more in _sample(known, thin, rows, params.sample_chars, False).items():
            raw[name] = _filled(texts[name] | more, room)
    total = sum(sizes.values())
    return LanguageModel(list(sizes), SizeModel([raw[n] for n in sizes], params.level), np.array([n / total for n in sizes.values()]))


def identify(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, margin, rejected (the lead is narrow). Null texts and texts
    without a letter are "und", score 0, rejected. With keep_rejected, as the query has it, a narrow lead is only marked in
    rejected and the best language still named (the query's contract keeps "und" for texts without a letter); with it off, all
    rejected texts are "und". Repeated rows each get a
    row; an empty table gives none; without any labelled text all are "und"."""
    narrow = docs.select("doc_id", "text", "lang")
    model = fit(narrow, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                names, score, margin = model.predict(part.column(1).to_pylist())
                rejected = (margin < params.margin) | np.array([n == UNDETERMINED for n in names], dtype=bool)
                if not params.keep_rejected:
                    names = [UNDETERMINED if r else n for n, r in zip(names, rejected, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "margin", "rejected"],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    done = map_text(narrow.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")
    return done.withColumn("held_out", fold(F.col("doc_id"), params.folds) == params.held_out).select(
        "doc_id", "held_out", "lang_pred", "score", "margin", "rejected"
    )
