"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded from
what its words look like (shares of symbols, capitals, digits, repeats, and a
hashed bag of the words). Gated attention, learned from the labels of whole
documents, weighs the passages, and the weighted representation is scored. The
model is fitted on the driver to a bounded sample of labelled rows, at most
``SAMPLE`` of each label, chosen by a hash of the id, of whose passages it sees
``FIT_PASSAGES`` at most; every document is scored on all its passages.

Defined results. Null texts count as empty; an empty text is one passage
without words. Rows that repeat an id are scored each. Without labelled rows,
or with rows of one label only, the score is the share of label 1 among them (1
where there are none, so that nothing is rejected). An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.common import crc_part, kept

#: Words of a passage.
PASSAGE = 64
#: Labelled rows of each label that the model is fitted to, at most.
SAMPLE = 3000
#: Passages that a sampled text gives the fit at most, spread evenly over it.
FIT_PASSAGES = 512
#: Buckets of the hashed bag of words.
BUCKETS = 128
#: Width of a passage's representation and of the attention.
WIDTH, GATE = 24, 12
EPOCHS, RATE, DECAY, BATCH, SEED = 30, 3e-3, 1e-4, 64, 11
#: Score from which a document is predicted good.
THRESHOLD = 0.5
#: Words whose looks a task remembers.
REMEMBERED = 250_000

LOOKS = 9
FEATURES = LOOKS + 5 + BUCKETS


class Passages:
    """Encodes whole texts: one row of ``FEATURES`` numbers for each passage."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.looks = np.zeros((1024, LOOKS), np.float32)
        self.bucket = np.zeros(1024, np.int64)

    def _row(self, word: str) -> int:
        row = len(self.rows)
        if row == len(self.bucket):
            self.looks = np.concatenate([self.looks, np.zeros_like(self.looks)])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        letters = sum(map(str.isalpha, word))
        symbols = len(word) - letters - sum(map(str.isdigit, word))
        runs = sum(a == b and not a.isalnum() for a, b in zip(word, word[1:], strict=False))
        self.looks[row] = (
            len(word) / 10,
            letters / len(word),
            symbols / len(word),
            letters > 1 and word.isupper(),
            word[0].isupper() and not word.isupper(),
            letters == 0,
            runs > 0,
            word[-1] in ".!?",
            any(map(str.isdigit, word)),
        )
        self.bucket[row] = xxhash.xxh3_64_intdigest(word.lower().encode(errors="replace")) % BUCKETS
        self.rows[word] = row
        return row

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros((1, FEATURES), np.float32)
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        known = self.rows
        rows = np.fromiter((known[w] if w in known else self._row(w) for w in words), np.int64, len(words))
        starts = np.arange(0, len(rows), PASSAGE)
        counts = np.diff(np.append(starts, len(rows))).astype(np.float32)[:, None]
        passage = np.arange(len(rows)) // PASSAGE
        out = np.zeros((len(starts), FEATURES), np.float32)
        out[:, :LOOKS] = np.add.reduceat(self.looks[rows], starts) / counts
        same = np.append(False, rows[1:] == rows[:-1])
        key = passage * (1 << 32) + rows
        distinct = np.bincount(np.unique(key) >> 32, minlength=len(starts))
        out[:, LOOKS] = np.add.reduceat(same.astype(np.float32), starts) / counts[:, 0]
        out[:, LOOKS + 1] = distinct / counts[:, 0]
        out[:, LOOKS + 2] = counts[:, 0] / PASSAGE
        out[:, LOOKS + 3] = np.log1p(len(rows)) / 10
        out[:, LOOKS + 4] = 1
        bag = np.bincount(passage * BUCKETS + self.bucket[rows], minlength=len(starts) * BUCKETS)
        out[:, LOOKS + 5 :] = np.sqrt(bag.reshape(len(starts), BUCKETS) / counts)
        return out.astype(np.float16).astype(np.float32)  # as the sample travels, so that fit and score see the same


class Attention:
    """Encoder, gated attention, and the score of the weighted representation."""

    NAMES = ("encode", "tanh", "gate", "weigh", "score")

    def __init__(self, share: float) -> None:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.encode, self.tanh, self.gate = draw(FEATURES, WIDTH), draw(WIDTH, GATE), draw(WIDTH, GATE)
        self.weigh, self.score = draw(GATE) * 0.1, draw(WIDTH) * 0.1
        self.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))

    def forward(self, bags: list[np.ndarray]) -> tuple:
        x = (np.concatenate(bags) - self.mean) / self.scale
        counts = np.array([len(b) for b in bags])
        starts = np.cumsum(counts) - counts
        h = np.tanh(x @ self.encode)
        t, s = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-np.clip(h @ self.gate, -30, 30)))
        e = (t * s) @ self.weigh
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return z @ self.score + self.bias, x, counts, starts, h, t, s, a, z

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(bags)[0].astype(np.float64), -30, 30)))

    def gradients(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        logit, x, counts, starts, h, t, s, a, z = self.forward(bags)
        slope = (weights * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)).astype(np.float32)
        each = np.repeat(slope, counts)[:, None] * self.score
        da = np.einsum("ij,ij->i", each, h)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dt, ds = (de[:, None] * self.weigh * s) * (1 - t * t), (de[:, None] * self.weigh * t) * s * (1 - s)
        dh = (a[:, None] * each + dt @ self.tanh.T + ds @ self.gate.T) * (1 - h * h)
        return {"encode": x.T @ dh, "tanh": h.T @ dt, "gate": h.T @ ds, "weigh": (t * s).T @ de, "score": z.T @ slope}, float(slope.sum())


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Attention:
    """Adam on the logistic loss, in a fixed order; both labels weigh the same in all."""
    share = float(labels.mean()) if len(labels) else 1.0
    model = Attention(share)
    if share in (0.0, 1.0):
        model.score[:] = 0
        return model
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    del every
    rng, step = np.random.default_rng(SEED), 0
    first = {n: np.zeros_like(getattr(model, n)) for n in Attention.NAMES}
    second = {n: np.zeros_like(getattr(model, n)) for n in Attention.NAMES}
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            grads, slope = model.gradients([bags[i] for i in chosen], labels[chosen], weights[chosen])
            step += 1
            for n, g in grads.items():
                value = getattr(model, n)
                g = g + DECAY * value
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                value -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            model.bias -= 0.1 * slope
    return model


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, each: int) -> DataFrame:
    """``id, text, label``: at most ``each`` labelled rows of each label whose crc32 part of 3 is not 1."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label is not null").where(crc_part(F.col("id"), 3) != 1)
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("id"), F.lit(SEED))
    picked = marks.where("label = 1").orderBy(order, "id").limit(each).unionByName(marks.where("label = 0").orderBy(order, "id").limit(each))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "id").select("id", "text", "label")  # 2 * each rows at most


def spread(passages: np.ndarray) -> np.ndarray:
    """At most ``FIT_PASSAGES`` of a bag, evenly."""
    if len(passages) <= FIT_PASSAGES:
        return passages
    return passages[np.linspace(0, len(passages) - 1, FIT_PASSAGES).astype(int)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: int = SAMPLE) -> Attention:
    """Fit the attention to ``labels (doc_id, quality)``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept("quality", Passages)
        for batch in batches:
            found = [spread(encode(t.as_py())).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "label", "bag"])

    rows = labelled(docs, labels, id_col, text_col, each).mapInArrow(features, "id long, label int, bag binary").toArrow().sort_by("id")
    bags = [np.frombuffer(b.as_py(), np.float16).reshape(-1, FEATURES) for b in rows.column("bag")]
    return fit(bags, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``score`` of every whole text under the struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, attention = kept("quality", Passages), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = attention.scores([encode(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scores, "doc_id long, score double")


def score_column(model: Attention, session) -> Column:
    """A vectorised function of a text column: the score, beside whatever columns a row has."""
    shared = session.sparkContext.broadcast(model)  # of fixed size

    def scores(texts: pa.Array) -> pa.Array:
        encode, attention, out = kept("quality", Passages), shared.value, []
        for at in range(0, len(texts), 64):
            out.append(attention.scores([encode(t.as_py()) for t in texts.slice(at, 64)]))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return F.arrow_udf(scores, "double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are predicted good, as they are."""
    model = train(docs if training is None else training, labels, id_col, text_col)
    return docs.where(score_column(model, docs.sparkSession)(F.col(text_col)) >= THRESHOLD)
