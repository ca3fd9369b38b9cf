"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its different words and their beginnings, hashed into
``2 ** BITS`` buckets, and one term for the order of magnitude of its length.
The model adds a weight for each term and an inner product of two learned
vectors for each pair of terms, so a pair can count for more than both alone. A
term counts by how far its share differs between the sampled labels, which
keeps terms of chance small without leaving any out. The model is fitted on the
driver to a bounded sample of labelled rows, at most ``SAMPLE`` of each label,
chosen by a hash of the id; every document is scored on its whole text.

Defined results. Null texts count as empty, and an empty text has the score of
its length term alone. A text of any length is its different terms, at most one
for each bucket. Rows that repeat an id are scored each. Without any
labelled row, or with rows of one label only, the score is the share of label 1
among them (0 where there are none). Null labels are left out. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import crc_part, kept

#: Labelled rows of each label that the model is fitted to, at most.
SAMPLE = 3000
#: Bits of the term hash, and length of the learned vectors.
BITS, RANK = 20, 6
#: Lengths of the word beginnings that are terms.
STARTS = (3, 4, 5, 6, 7)
EPOCHS, RATE, DECAY, BATCH, SEED = 25, 0.1, 1e-3, 256, 7
#: Chi-squared of a term between the labels at which it counts half.
HALF = 20.0
#: Every so many sampled rows one is held back, to place the threshold.
HELD_BACK = 5
#: Where the threshold goes, a clean text predicted toxic costs as much as so many toxic ones missed.
FALSE_COST = 10
#: Score from which a text is predicted toxic.
THRESHOLD = 0.7
#: Words whose terms a task remembers.
REMEMBERED = 250_000

LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


class Terms:
    """Hashed terms of whole texts, sorted; the last one stands for the length."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(STARTS)), np.int64)

    def _row(self, word: str) -> int:
        row = len(self.rows)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        starts = [hashed(b"^", word[:n]) if len(word) > n else -1 for n in STARTS]
        self.table[row] = [hashed(b"", word), *starts]
        self.rows[word] = row
        return row

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(LETTERS.findall((text or "").lower()))
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        known = self.rows
        rows = np.fromiter((known[w] if w in known else self._row(w) for w in words), np.int64, len(words))
        found = np.unique(self.table[rows])
        return np.append(found[found >= 0], hashed(b"#", str(len(words).bit_length())))


def hashed(kind: bytes, part: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + part.encode(errors="replace")) & ((1 << BITS) - 1)


class Machine:
    """How much each bucket counts, and its weight and vector."""

    def __init__(self, buckets: int, bias: float) -> None:
        self.bias = bias
        self.value, self.weights, self.vectors = np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), np.zeros((buckets, RANK), np.float32)

    def forward(self, terms: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Logits, and what the gradient needs. Pairs weigh one over the sum of a text's values, so that long texts do not win by length."""
        flat, counts = np.concatenate(terms), np.array([len(t) for t in terms])
        starts = np.cumsum(counts) - counts
        x = self.value[flat]
        norm = 1 + np.add.reduceat(x, starts)
        v = self.vectors[flat] * x[:, None]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), starts)
        pairs = 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares) / norm
        return self.bias + np.add.reduceat(self.weights[flat] * x, starts) + pairs, flat, counts, x, norm, v, sums

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        logits = self.forward(terms)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def fit(terms: list[np.ndarray], labels: np.ndarray) -> Machine:
    """The machine fitted to most rows, its bias moved so that ``THRESHOLD`` divides the rest best."""
    back = np.arange(len(terms)) % HELD_BACK == 0
    known = labels[back]
    model = descend([t for t, b in zip(terms, back, strict=True) if not b], labels[~back])
    if 0 < known.sum() < len(known):
        logits = model.forward([t for t, b in zip(terms, back, strict=True) if b])[0]
        order = np.argsort(-logits, kind="stable")
        found, wrong = np.cumsum(known[order]) / known.sum(), np.cumsum(1 - known[order]) / (len(known) - known.sum())
        best = int(np.argmax(found - FALSE_COST * wrong))
        below = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
        model.bias += np.log(THRESHOLD / (1 - THRESHOLD)) - 0.5 * (logits[order[best]] + below)
    return model


def telling(place: np.ndarray, label: np.ndarray, n0: int, n1: int, buckets: int) -> np.ndarray:
    """How much each term counts: chi-squared of its presence between the labels, with one row of each added, over itself and ``HALF``."""
    rows, toxic = np.bincount(place, minlength=buckets), np.bincount(place, label, buckets)
    n0, n1 = n0 + 2.0, n1 + 2.0
    both = (rows + 2) / (n0 + n1)
    gap = ((toxic + 1) / n1 - (rows - toxic + 1) / n0) ** 2 / (both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    return (gap / (gap + HALF)).astype(np.float32)


def descend(terms: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Adaptive gradient descent on the logistic loss, in a fixed order, over the buckets that the sample has."""
    share = float(labels.mean()) if len(labels) else 0.0
    whole = Machine(1 << BITS, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if share in (0.0, 1.0):
        return whole
    keys, place = np.unique(np.concatenate(terms), return_inverse=True)
    counts = np.array([len(t) for t in terms])
    model, rng, size = Machine(len(keys), whole.bias), np.random.default_rng(SEED), len(keys)
    model.value = telling(place, np.repeat(labels, counts), int((labels == 0).sum()), int((labels == 1).sum()), size)
    places = np.split(place, np.cumsum(counts)[:-1])
    model.vectors = (rng.standard_normal((size, RANK)) * 0.05).astype(np.float32)
    seen_w, seen_v = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32)
    balance = np.where(labels == 1, min(4.0, 0.5 / share), min(4.0, 0.5 / (1 - share)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            logit, flat, counts, x, norm, v, sums = model.forward([places[i] for i in chosen])
            slope = balance[chosen] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, counts) * x
            grad = np.bincount(flat, each, size).astype(np.float32) + DECAY * model.weights
            seen_w += grad**2
            model.weights -= RATE * grad / np.sqrt(seen_w)
            push = (each / np.repeat(norm, counts))[:, None] * (np.repeat(sums, counts, axis=0) - v)
            grad = np.stack([np.bincount(flat, push[:, k], size) for k in range(RANK)], axis=1).astype(np.float32) + DECAY * model.vectors
            seen_v += grad**2
            model.vectors -= RATE * grad / np.sqrt(seen_v)
            model.bias -= RATE * float(slope.sum())
    whole.bias, whole.value[keys], whole.weights[keys], whole.vectors[keys] = model.bias, model.value, model.weights, model.vectors
    return whole


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, each: int) -> DataFrame:
    """``text, label``: at most ``each`` labelled rows of each label whose crc32 part of 3 is not 1."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").where(crc_part(F.col("id"), 3) != 1)
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("id"), F.lit(SEED))
    picked = marks.where("label = 1").orderBy(order, "id").limit(each).unionByName(marks.where("label = 0").orderBy(order, "id").limit(each))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "id").select("id", "text", "label")  # 2 * each rows at most


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: int = SAMPLE) -> Machine:
    """Fit the machine to ``labels (doc_id, toxic)``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = kept("toxicity", Terms)
        for batch in batches:
            found = [terms(t.as_py()).astype(np.uint32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "label", "terms"])

    rows = labelled(docs, labels, "toxic", id_col, text_col, each).mapInArrow(features, "id long, label int, terms binary").toArrow().sort_by("id")
    terms = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("terms")]
    return fit(terms, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = kept("toxicity", Terms), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = machine.scores([terms(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scores, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
