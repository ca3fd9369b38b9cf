"""Language of whole texts by a linear-chain conditional random field over words.

Every word is a position of the chain; runs of scripts that are written without
spaces are cut into positions of ``RUN`` letters. A position's features are affixes, character
n-grams and, as a lexicon, the word itself, all hashed; transitions between the
languages of neighbouring words are learned with them. Training sequences are
code-switched: all words of the sampled documents, cut into segments, each
labelled with its document's language, strung together. Forward-backward gives each word's
chances, and a text's language is the one with the most expected words; its
share of them is the score.

Sums run over every word of every text. Forward-backward is cut into segments
of ``STEP`` words whose transfer matrices are computed side by side, so a long
text is as cheap for its length as many short ones.

Defined results. ``und`` with score 0 for null texts and texts without a
letter. A text of any length is one chain. Ties go to the language first in code-point order. Rows that repeat an
id are labelled each. Without any training text all texts are ``und``. An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import crc_part, kept

UNKNOWN = "und"
#: Documents of each language that the field is fitted to, at most.
SAMPLE = 250
#: Words of the segments into which a sampled document is cut.
SEGMENT = (3, 24)
#: Words of a training sequence.
SEQUENCE = 64
#: Buckets of the hashed features.
BITS = 17
EPOCHS, RATE, DECAY, BATCH, SEED = 6, 0.1, 1e-5, 64, 5
#: Words of a segment of forward-backward, and words that are labelled at a time.
STEP, AT_ONCE = 32, 100_000
#: Words whose emissions a task remembers.
REMEMBERED = 400_000

#: Letters of a position in scripts without spaces between words.
RUN = 4

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    words = WORDS.findall(low)
    if low.isascii() or not UNSPACED.search(low):
        return words
    return [p for w in words for p in (positions(w) if UNSPACED.search(w) else (w,))]


def positions(run: str) -> list[str]:
    """A run of letters in pieces of ``RUN`` characters."""
    return [run[i : i + RUN] for i in range(0, len(run), RUN)]


def features(word: str) -> list[int]:
    """Hashed affixes, n-grams (of UTF-8 bytes) and lexicon entry of a word."""
    body = word.encode(errors="replace")
    edged = b"^" + body + b"$"
    parts = [b"=" + body]
    parts += [b"<" + body[:n] for n in (2, 3, 4)] + [b">" + body[-n:] for n in (2, 3, 4)]
    parts += [edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1)]
    mask = (1 << BITS) - 1
    return [zlib.crc32(p) & mask for p in parts]


class Field:
    """Languages in code-point order, emission weights by feature, and transition weights."""

    def __init__(self, languages: list[str]) -> None:
        k = len(languages)
        self.languages = languages
        self.emit = np.zeros((1 << BITS, k), np.float32)
        self.pass_on = np.eye(k, dtype=np.float32) * 2

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features(w) for w in words]
        counts = np.array([len(f) for f in found])
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum()))
        return np.add.reduceat(self.emit[flat], np.cumsum(counts) - counts) / np.sqrt(counts)[:, None]


class Emissions:
    """Emission weights of words under one field, remembered by word."""

    def __init__(self, field: Field) -> None:
        self.field, self.rows = field, {}
        self.table = np.zeros((1024, len(field.languages)), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.rows
        if fresh := [w for w in set(words) if w not in known]:
            stop = len(known) + len(fresh)
            while stop > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(known) : stop] = self.field.emissions(fresh)
            known.update(zip(fresh, range(len(known), stop), strict=True))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def trim(self) -> None:
        if len(self.rows) > REMEMBERED:
            self.rows.clear()


def chances(emissions: np.ndarray, lengths: np.ndarray, pass_on: np.ndarray) -> np.ndarray:
    """Each word's chances by forward-backward over chains of the given lengths, all of one word at least."""
    k = emissions.shape[1]
    move = np.exp(pass_on - pass_on.max()).astype(np.float64)
    spread = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    pieces = -(-lengths // STEP)  # segments of each chain
    first_piece = np.cumsum(pieces) - pieces
    begin = np.cumsum(lengths) - lengths
    chain = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(chain)) - first_piece[chain]
    start = begin[chain] + within * STEP
    size = np.minimum(STEP, lengths[chain] - within * STEP)
    step = lambda t: (np.minimum(start + t, len(emissions) - 1), (size > t))

    def normal(a: np.ndarray) -> np.ndarray:
        return a / a.reshape(len(a), -1).sum(axis=1).reshape(-1, *[1] * (a.ndim - 1))

    opening = within == 0
    transfer = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t in range(int(size.max())):
        at, live = step(t)
        moved = transfer @ move
        if t == 0:
            moved[opening] = transfer[opening]
        moved = normal(moved * spread[at][:, None, :])
        transfer = np.where(live[:, None, None], moved, transfer)
    # messages at the segments' edges, chain by chain side by side
    ahead, behind = np.full((len(chain), k), 1.0 / k), np.full((len(chain), k), 1.0 / k)
    for j in range(1, int(pieces.max())):
        p = first_piece[pieces > j] + j
        ahead[p] = normal(np.einsum("ni,nij->nj", ahead[p - 1], transfer[p - 1]))
        q = first_piece[pieces > j] + pieces[pieces > j] - 1 - j
        behind[q] = normal(np.einsum("nij,nj->ni", transfer[q + 1], behind[q + 1]))
    forward, now = np.zeros((len(emissions), k)), ahead
    for t in range(int(size.max())):
        at, live = step(t)
        moved = now @ move
        if t == 0:
            moved[opening] = now[opening]
        moved = normal(moved * spread[at])
        now = np.where(live[:, None], moved, now)
        forward[at[live]] = now[live]
    backward, now = np.zeros((len(emissions), k)), behind
    for t in range(int(size.max()) - 1, -1, -1):
        at, live = step(t)
        backward[at[live]] = now[live]
        now = np.where(live[:, None], normal((now * spread[at]) @ move.T), now)
    return normal(forward * backward)


def fit(segments: list[tuple[str, list[str]]]) -> Field:
    """Adaptive gradient ascent on the conditional likelihood of strung segments, in a fixed order."""
    languages = sorted({lang for lang, words in segments if words}, key=lambda x: x.encode())
    field = Field(languages)
    k = len(languages)
    if k < 2:
        return field
    rng = np.random.default_rng(SEED)
    vocabulary: dict[str, int] = {}
    label_of = {lang: i for i, lang in enumerate(languages)}
    # every language gets about as many words
    by_lang: dict[int, list[np.ndarray]] = {i: [] for i in range(k)}
    for lang, words in segments:
        if words:
            by_lang[label_of[lang]].append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]))
    want = max(sum(map(len, s)) for s in by_lang.values())
    strung = []
    for i, own in by_lang.items():
        total = 0
        for j in range(10 * len(own)):
            if total >= want:
                break
            strung.append((i, own[j % len(own)]))
            total += len(strung[-1][1])
    order = rng.permutation(len(strung))
    words = np.concatenate([strung[i][1] for i in order])
    labels = np.concatenate([np.full(len(strung[i][1]), strung[i][0]) for i in order])
    n = max(1, len(words) // SEQUENCE)
    if len(words) < SEQUENCE:
        words, labels = np.resize(words, SEQUENCE), np.resize(labels, SEQUENCE)
    words, labels = words[: n * SEQUENCE].reshape(n, SEQUENCE), labels[: n * SEQUENCE].reshape(n, SEQUENCE)
    found = [features(w) for w in vocabulary]
    counts = np.array([len(f) for f in found])
    flat, starts = np.concatenate(found), np.cumsum(counts) - counts
    seen_e, seen_p = np.full(field.emit.shape, 1e-3, np.float32), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            w, y = words[order[low : low + BATCH]], labels[order[low : low + BATCH]]
            used, place = np.unique(w, return_inverse=True)
            place = place.reshape(w.shape)
            rows = np.concatenate([flat[starts[u] : starts[u] + counts[u]] for u in used])
            edges = np.cumsum(counts[used]) - counts[used]
            scale = 1 / np.sqrt(counts[used])[:, None]
            emissions = (np.add.reduceat(field.emit[rows], edges) * scale)[place]
            gradient, moves = slopes(emissions, y, field.pass_on)
            by_word = np.stack([np.bincount(place.ravel(), gradient[:, :, j].ravel(), len(used)) for j in range(k)], axis=1) * scale
            touched, back = np.unique(rows, return_inverse=True)
            spread = np.repeat(by_word, counts[used], axis=0)
            grad = np.stack([np.bincount(back, spread[:, j], len(touched)) for j in range(k)], axis=1) / len(w) - DECAY * field.emit[touched]
            seen_e[touched] += grad**2
            field.emit[touched] += RATE * grad / np.sqrt(seen_e[touched])
            grad = moves / len(w) - DECAY * field.pass_on
            seen_p += grad**2
            field.pass_on += (RATE * grad / np.sqrt(seen_p)).astype(np.float32)
    return field


def slopes(emissions: np.ndarray, labels: np.ndarray, pass_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of labelled sequences of one length: by word, and by transition."""
    n, length, k = emissions.shape
    move = np.exp(pass_on - pass_on.max())
    spread = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    forward, backward = np.empty((n, length, k)), np.empty((n, length, k))
    forward[:, 0] = spread[:, 0] / spread[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (forward[:, t - 1] @ move) * spread[:, t]
        forward[:, t] = a / a.sum(axis=1, keepdims=True)
    backward[:, -1] = 1.0 / k
    for t in range(length - 2, -1, -1):
        b = (backward[:, t + 1] * spread[:, t + 1]) @ move.T
        backward[:, t] = b / b.sum(axis=1, keepdims=True)
    single = forward * backward
    single /= single.sum(axis=2, keepdims=True)
    pairs = np.einsum("nti,ij,ntj->ntij", forward[:, :-1], move, spread[:, 1:] * backward[:, 1:])
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    truth = np.eye(k)[labels]
    seen = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    return truth - single, seen - pairs.sum(axis=(0, 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = SAMPLE) -> Field:
    """Fit the field to ``each`` documents of each language whose crc32 part of 4 is not 2."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null").where(crc_part(F.col("id"), 4) != 2)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(SEED)), "id")
    picked = rows.select("id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("id", "lang").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, parts = [], [], []
            for doc_id, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, at = words_of(text), 0
                rng = np.random.default_rng([SEED, doc_id & 0xFFFFFFFF])
                while at < len(words):
                    n = int(rng.integers(SEGMENT[0], SEGMENT[1] + 1))
                    ids.append(doc_id)
                    langs.append(lang)
                    parts.append(" ".join(words[at : at + n]))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.string())], ["id", "lang", "words"])

    sample = rows.join(F.broadcast(picked), ["id", "lang"]).select("id", "text", "lang")  # ``each`` rows a language at most
    table = sample.mapInArrow(cut, "id long, lang string, words string").toArrow().sort_by([("id", "ascending"), ("lang", "ascending"), ("words", "ascending")])
    return fit([(lang, words.split()) for lang, words in zip(table.column("lang").to_pylist(), table.column("words").to_pylist(), strict=True)])


def label(texts: list[str | None], emissions: Emissions) -> list[tuple[str, float, int]]:
    """``(language, score, switches)`` of each text."""
    field, out = emissions.field, [(UNKNOWN, 0.0, 0)] * len(texts)
    if not field.languages:
        return out
    emissions.trim()
    held: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        lengths = np.array([len(e) for _, e in held])
        found = chances(np.concatenate([e for _, e in held]), lengths, field.pass_on)
        begin = np.cumsum(lengths) - lengths
        share = np.add.reduceat(found, begin) / lengths[:, None]
        best = found.argmax(axis=1)
        moved = np.append(False, best[1:] != best[:-1])
        moved[begin] = False
        switches = np.add.reduceat(moved.astype(np.int64), begin)
        for (i, _), s, n in zip(held, share, switches, strict=True):
            out[i] = (field.languages[int(s.argmax())], min(1.0, float(s.max())), int(n))
        held.clear()

    words_held = 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if words:
            held.append((i, emissions(words)))
            words_held += len(words)
            if words_held >= AT_ONCE:
                settle()
                words_held = 0
    if held:
        settle()
    return out


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: ``doc_id, held_out, lang_pred, score, switches``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col)), uuid.uuid4().hex  # 2**BITS weights a language

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = kept(f"language {key}", lambda: Emissions(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = label(part.column(1).to_pylist(), emissions)
                lang, score, switches = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())], ["doc_id", "lang_pred", "score", "switches"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(labels, "doc_id long, lang_pred string, score double, switches long")
    return found.select("doc_id", (crc_part(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "switches")
