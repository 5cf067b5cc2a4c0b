"""Quality classifier by compression: zstandard dictionaries of good and bad text.

*Fit.*  Two dictionaries are trained on whole labelled texts, one per class.
A text that compresses smaller with the good dictionary than with the bad one
looks like good text; the difference of the two compressed sizes, divided by
the length, is calibrated to a probability by a logistic regression (Newton
steps) on labelled rows that the dictionaries have not seen.  The calibration
also knows the length of a piece and the size per byte without a dictionary, of
which repetitive text has little; it sees nothing but these sizes.

*Pieces.*  A dictionary helps near the start of what is compressed, so a text is
cut into the fewest equal pieces of at most ``PIECE_BYTES`` and each is
compressed on its own, to the last; the sizes are summed.  No feature grows with
the length of the text beyond a piece.

The fit reads a bounded sample: at most ``sample_rows`` rows of each class, in
hash order, among texts of at most ``sample_bytes`` bytes.  Scoring compresses
every whole text in Arrow batches where it lies, without a shuffle.

Nulls and empties: a null text counts as empty; labels other than 0 and 1 and
documents with both labels are not learnt from; without any label the score is
the calibrated prior, 0.5.  A null id is not held out.  Repeated rows score
alike.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1600
SAMPLE_BYTES = 32_768
DICTIONARY_BYTES = 112_640
LEVEL = 3
PIECE_BYTES = 8192
HELD_OUT_OF, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == HELD_OUT,
                      F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple], dict[int, int]]:
    """(text, label) rows of the bounded sample and the number of labelled rows per class."""
    clean = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))) \
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_col).alias("n")) \
        .filter((F.col("n") > 0) & (F.col("n") <= most_bytes)).select("id").distinct()
    able = clean.join(sizes, "id").select("id", "label", F.xxhash64("id").alias("k"))
    chosen = [able.filter(F.col("label") == y).orderBy("k", "id").limit(rows) for y in (0, 1)]
    ids = {r["id"]: (r["label"], r["k"]) for r in chosen[0].unionByName(chosen[1]).collect()}
    texts = _texts_of(docs, id_col, text_col, sorted(ids), most_bytes)
    sample = sorted(((*ids[r["id"]], r["text"]) for r in texts.collect()), key=lambda r: (r[1], r[0], r[2]))
    return [(text, label) for label, _, text in sample], counts


def _texts_of(docs: DataFrame, id_col: str, text_col: str, ids: list[int], most_bytes: int) -> DataFrame:
    """The smallest text of each id; ids are at most twice the bounded sample."""
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return found.filter(F.col("id").isin(ids) & (F.octet_length("text") <= most_bytes)) \
        .groupBy("id").agg(F.min("text").alias("text"))


@dataclass
class Model:
    good: bytes
    bad: bytes
    good_raw: bool
    bad_raw: bool
    weights: list[float]

    def compressors(self):
        import zstandard

        def one(content: bytes, raw: bool):
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL)
            kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
            d = zstandard.ZstdCompressionDict(content, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

        return one(self.good, self.good_raw), one(self.bad, self.bad_raw), one(b"", True)


def pieces(text: bytes, most: int = PIECE_BYTES) -> list[memoryview]:
    """The whole text in the fewest pieces of at most ``most`` bytes, equal but for one byte."""
    n = max(1, -(-len(text) // most))
    cuts = [len(text) * k // n for k in range(n + 1)]
    view = memoryview(text)
    return [view[a:b] for a, b in zip(cuts, cuts[1:])]


def features(texts: list[bytes], good, bad, plain) -> np.ndarray:
    """Intercept, normalised size difference, log of the length of a piece, log of the plain size per byte."""
    cut = [pieces(t) for t in texts]
    sizes = np.array([(len(t), len(parts), *(sum(len(c.compress(x)) for x in parts) for c in (good, bad, plain)))
                      for t, parts in zip(texts, cut)], float)
    n, k, g, b, p = np.maximum(sizes.reshape(-1, 5), 1).T
    return np.column_stack([np.ones(len(n)), 100 * (b - g) / n, np.log(n / k), np.log(p / n)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability(x, w)
        grad = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))


def dictionary_of(texts: list[bytes], size: int) -> tuple[bytes, bool]:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    import zstandard

    if not texts:
        return b"", True
    try:
        return zstandard.train_dictionary(size, texts).as_bytes(), False
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:], True


def fit(sample: list[tuple[str, int]], counts: dict[int, int], size: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries from one half of each class's sample, calibration on the other."""
    halves: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for label in (0, 1):
        texts = [t.encode() for t, y in sample if y == label]
        halves[label] = texts[::2], texts[1::2]
    (bad, bad_raw), (good, good_raw) = (dictionary_of(halves[y][0], size) for y in (0, 1))
    model = Model(good, bad, good_raw, bad_raw, [0.0] * 4)
    texts = halves[0][1] + halves[1][1]
    if halves[0][1] and halves[1][1]:
        y = np.repeat([0.0, 1.0], [len(halves[0][1]), len(halves[1][1])])
        share = np.where(y == 1, counts[1] / len(halves[1][1]), counts[0] / len(halves[0][1]))
        x = features(texts, *model.compressors())
        model.weights = logistic(x, y, share * len(y) / share.sum()).tolist()
    return model


def score(docs: DataFrame, model: Model, text_col: str, out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless asked for, with the calibrated probability of label 1."""
    kept = [f for f in docs.schema if keep_text or f.name != text_col]
    names = [f.name for f in kept]
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            p = probability(features(texts, *compressors), weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p)], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{fields}, {out} double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """``id, held_out, score, predicted``, one row per document."""
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    return score(rows, model, text_col).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col))
    return score(docs, model, text_col, "__score", keep_text=True).filter("__score >= 0.5").drop("__score")
