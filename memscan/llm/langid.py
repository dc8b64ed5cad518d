"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (blended spectrum,
1 <= n <= 3) present in both, cosine-normalised over the n-grams that occur in
the landmarks.  A bounded sample of labelled rows is fitted by Nystroem
features and one-versus-rest kernel ridge regression on the driver; scoring a
document is a product of its presence vector with the landmark matrix, done
for a batch of documents at once.

Bounds: at most ``PER_LANG`` sampled rows of a language (least hash of doc_id)
and ``LANDMARKS`` landmarks in all; everything else covers whole texts.

Edge cases: a text that is null or has no letter is ``und`` with score 0;
without a labelled row every text is ``und``; null labels never train; a null
doc_id is not held out and does not train; repeated rows are predicted one by
one; ties go to the language first in sorted order; extra columns are not
read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memscan.llm import common

PER_LANG = 250
LANDMARKS = 160
RIDGE = 1e-2
CODES = (1 << 8) + (1 << 16) + (1 << 24)
ROWS = 128               # documents of a matrix product


def gram_codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every byte n-gram, 1 <= n <= 3, ASCII case folded."""
    b = common.LOWER[buf].astype(np.int32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    codes, rows = [b], [row]
    if len(b) > 1:
        same = row[:-1] == row[1:]
        two = (b[:-1] << 8) | b[1:]
        codes.append((two + (1 << 8))[same])
        rows.append(row[:-1][same])
        if len(b) > 2:
            same = row[:-2] == row[2:]
            codes.append((((two[:-1] << 8) | b[2:]) + ((1 << 8) + (1 << 16)))[same])
            rows.append(row[:-2][same])
    return np.concatenate(codes), np.concatenate(rows)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray        # n-grams of the landmarks, sorted
    landmarks: np.ndarray    # presence, landmarks x codes, rows of unit length
    weights: np.ndarray      # landmarks x languages


def fit(sets: list[np.ndarray], labels: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Nystroem kernel ridge regression on presence sets of n-gram codes."""
    langs = sorted(set(labels))
    if not langs:
        return None
    y = np.array([langs.index(x) for x in labels])
    # landmarks in turn from each language
    turn = np.array([np.sum(y[:i] == y[i]) for i in range(len(y))])
    pick = np.lexsort((y, turn))[:n_landmarks]
    codes = np.unique(np.concatenate([sets[i] for i in pick]))

    def presence(rows):
        p = np.zeros((len(rows), len(codes)), np.float32)
        for k, i in enumerate(rows):
            at = np.minimum(np.searchsorted(codes, sets[i]), len(codes) - 1)
            p[k, at[codes[at] == sets[i]]] = 1
        return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))

    marks = presence(pick)
    k_mm = marks.astype(np.float64) @ marks.T
    val, vec = np.linalg.eigh(k_mm)
    keep = val > 1e-8 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])
    k_nm = np.concatenate([presence(range(i, min(i + ROWS, len(sets)))) @ marks.T for i in range(0, len(sets), ROWS)])
    z = k_nm.astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # each language weighs the same
    w = 1.0 / np.bincount(y, minlength=len(langs))[y]
    zw = z * w[:, None]
    coef = np.linalg.solve(z.T @ zw + ridge * np.eye(z.shape[1]), zw.T @ target)
    return Model(langs, codes, marks, (root @ coef).astype(np.float32))


def training_sample(docs: DataFrame, train: Column, lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """At most ``per_lang`` rows of each language, by least hash of doc_id.
    Ids are chosen on narrow rows; the bounded id list is then broadcast."""
    w = Window.partitionBy(lang).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (docs.filter(train & F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", lang)
           .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_lang)
           .select("doc_id", F.col(lang).alias("_lang")).distinct())
    return docs.join(F.broadcast(ids), "doc_id").filter(F.col(lang) == F.col("_lang")).drop("_lang")


def train(docs: DataFrame, is_train: Column, lang: str = "lang") -> Model | None:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                code, _ = gram_codes(*common.text_buffer(b.column(1).slice(i, 1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([np.unique(code).tobytes()], pa.binary())],
                    ["doc_id", "lang", "codes"])

    rows = (training_sample(docs, is_train, lang).filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col(lang).alias("lang"))
            .mapInArrow(sets, "doc_id long, lang string, codes binary").collect())     # PER_LANG rows a language
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"]))
    return fit([np.frombuffer(r["codes"], np.int32) for r in rows], [r["lang"] for r in rows])


_tables: dict[int, np.ndarray] = {}


def predict_batch(m: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its score in 0..1 for each row."""
    key = hash((len(m.codes), m.codes[:64].tobytes(), m.codes[-64:].tobytes()))
    if key not in _tables:
        _tables.clear()
        t = np.full(CODES, -1, np.int32)
        t[m.codes] = np.arange(len(m.codes))
        _tables[key] = t
    table = _tables[key]
    best, score = [], []
    for i in range(0, len(off) - 1, ROWS):
        o = off[i:i + ROWS + 1]
        code, row = gram_codes(buf[o[0]:o[-1]], o - o[0])
        at = table[code]
        known = at >= 0
        p = np.zeros((len(o) - 1, len(m.codes)), np.float32)
        p[row[known], at[known]] = 1
        p /= np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
        f = (p @ m.landmarks.T) @ m.weights
        best.append(f.argmax(1))
        score.append(np.clip((f.max(1) + 1) / 2, 0, 1))
    return np.concatenate(best), np.concatenate(score)


def identify(docs: DataFrame, is_train: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of (doc_id, text, lang)."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, is_train))     # LANDMARKS x their n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.chunks(batches, "text", max_bytes=2 << 20):
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            if m is None:
                pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            else:
                k, s = predict_batch(m, *common.text_buffer(b.column("text")))
                pred = [m.languages[x] if ok else "und" for x, ok in zip(k, letters, strict=True)]
                score = np.where(letters, s, 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), letters).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
