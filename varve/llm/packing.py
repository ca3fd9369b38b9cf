"""Best-fit packing of documents into sequences by bin completion.

Documents become token pieces of at most ``CAPACITY`` ids. What the packer
needs is the number of pieces of each length, at most ``CAPACITY`` numbers
however large the corpus is; on these the driver runs bin completion. The
largest remaining length is completed with an undominated filling of what is
left in its sequence, and the filling is used as often as the supply allows.
Best-fit decreasing runs beside it, and the better solution is the incumbent of
a branch and bound over the emptiest sequences, which prunes by the waste bound
and by dominance; a solution that meets the least number of sequences is
optimal. No packing is worse than best-fit decreasing.

Pieces find their place by rank: the rank of a piece among those of its length
is a two-level running count, and the plan maps ranges of ranks to sequences.

Defined results. Null texts count as empty; a document without text is the
single end id. Rows that repeat an id are packed each. An empty table gives an
empty result; only the id and the text column are read.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import checkpoint, kept

#: Ids in a sequence at most.
CAPACITY = 4096
#: The id after each document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Search nodes for one filling, and for the last sequences together.
FILL_NODES, TAIL_NODES = 300, 20_000
#: Hash buckets of a length, so that a hot length is counted by many tasks.
BUCKETS = 1024
#: Words whose ids a task remembers.
REMEMBERED = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers.

    The vocabulary splits texts into words that are encoded on their own, so
    ids are remembered by word for texts of plain Latin script. Texts with
    other characters, for which normal forms, lower case or the word pattern
    might differ, and texts that spell a special token go through the library
    as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        letters, digits = charset("L"), charset("N")
        self.plain = re.compile(f"[{charset('')}]*+").fullmatch
        self.words = re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^\s{letters}{digits}]+").findall
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words: all encoded in one text, and told apart by the word that each id is of."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = self.whole.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(part)))).tolist()
            self.known.update((w, ids[a:z]) for w, a, z in zip(part, [0, *ends], ends, strict=False))

    def encode(self, text: str) -> bytes:
        if not self.plain(text) or any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = self.words(text.lower())
        found = list(map(self.known.get, words))
        if None in found:
            gaps = [k for k, ids in enumerate(found) if ids is None]
            self._learn(list({words[k] for k in gaps}))
            for k in gaps:
                found[k] = self.known[words[k]]
        return b"".join(found)


#: Characters whose normal form, lower case and classes are plain: printable ASCII and Latin, white space.
PLAIN = [chr(i) for low, high in ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x24F)) for i in range(low, high + 1)]


def charset(category: str) -> str:
    """The plain characters of a Unicode category, as the inside of a character class."""
    codes = [ord(c) for c in PLAIN if unicodedata.category(c).startswith(category)]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str | None, capacity: int) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32``."""
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path()
        encoder = kept(f"packing {file}", lambda: Encoder(file))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


# --- bin completion over a histogram of lengths ---


def filling(room: int, lengths: list[int], supply: dict[int, int], nodes: int = FILL_NODES) -> list[tuple[int, int]]:
    """Lengths and how many of each, whose sum comes nearest to ``room`` from below, as far as ``nodes`` steps find it.

    Depth-first over the number of pieces of each length, with the largest
    length that fits and as many of it as fit first, which is the best-fit
    filling (the incumbent) on the first way down. That way is always gone to
    its end; ``nodes`` counts the steps after it. The search ends when nothing
    is left over. ``lengths`` ascends.
    """
    best: list[tuple[int, int]] = []
    left, budget, first = room, nodes, True
    path: list[tuple[int, int]] = []

    def descend(free: int, top: int) -> bool:
        nonlocal best, left, budget, first
        if free < left:
            best, left = path[:], free
        if left == 0:
            return True
        for at in range(min(bisect.bisect_right(lengths, free), top) - 1, -1, -1):
            length = lengths[at]
            for n in range(min(supply[length], free // length), 0, -1):
                if not first:
                    budget -= 1
                    if budget < 0:
                        return True
                path.append((length, n))
                done = descend(free - length * n, at)
                path.pop()
                if done:
                    return True
        first = False
        return False

    descend(room, len(lengths))
    return best


def complete(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times)], sequences that use it) for all pieces.

    Bin completion and best-fit decreasing; the better of both is the incumbent
    that the branch and bound over the emptiest sequences starts from.
    """
    best = min((completed(counts, capacity), best_fit(counts, capacity)), key=lambda p: sum(t for _, t in p))
    return improved(best, counts, capacity)


def completed(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The largest remaining length with its fullest filling, as often as the supply allows, until nothing remains."""
    supply = {k: v for k, v in counts.items() if v}
    lengths = sorted(supply)
    patterns = []
    while lengths:
        largest = lengths[-1]
        supply[largest] -= 1
        rest = filling(capacity - largest, lengths, supply)
        supply[largest] += 1
        uses: dict[int, int] = {largest: 1}
        for length, n in rest:
            uses[length] = uses.get(length, 0) + n
        times = min(supply[k] // n for k, n in uses.items())
        patterns.append((sorted(uses.items(), reverse=True), times))
        for k, n in uses.items():
            supply[k] -= n * times
            if not supply[k]:
                del supply[k]
                lengths.pop(bisect.bisect_left(lengths, k))
    return patterns


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on counts: each piece goes to the fullest sequence that has room for it.

    Sequences with the same room are one group; a length fills a group up before
    it goes to the next one, as best fit does piece by piece.
    """
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by room: patterns and sequences
    rooms: list[int] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, times))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - left % each * length, ((length, left % each),), 1)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            full = min(times, left // each)
            if full:
                put(room - each * length, (*pattern, (length, each)), full)
            left -= full * each
            if full < times:
                if left:
                    put(room - left * length, (*pattern, (length, left)), 1)
                if times - full - bool(left):
                    put(room, pattern, times - full - bool(left))
                left = 0
    return [(list(p), t) for room in rooms for p, t in groups[room]]


def least_sequences(counts: dict[int, int], capacity: int, orders: int = 20) -> int:
    """The waste bound: no packing has fewer sequences.

    The greatest of the volume bound and those of dual feasible functions, which
    round lengths to k-ths: more than a third of the room counts as a half where
    only two such pieces fit, and so on.
    """
    best = -(-sum(n * v for n, v in counts.items()) // capacity)
    for k in range(1, orders + 1):
        total = sum(v * (n * k if (k + 1) * n % capacity == 0 else (k + 1) * n // capacity * capacity) for n, v in counts.items())
        best = max(best, -(-total // (capacity * k)))
    return best


def improved(patterns: list, counts: dict[int, int], capacity: int) -> list:
    """Branch and bound over the emptiest sequences, where the incumbent is above the bound."""
    total, bound = sum(t for _, t in patterns), least_sequences(counts, capacity)
    if total == bound:
        return patterns
    by_fill = sorted(range(len(patterns)), key=lambda i: sum(k * n for k, n in patterns[i][0]))
    for size in (4, 8, 16, 32):
        if total == bound:
            break
        chosen, taken = [], 0
        for i in by_fill:
            if taken >= size:
                break
            n = min(patterns[i][1], size - taken)
            chosen.append((i, n))
            taken += n
        pieces = sorted((k for i, n in chosen for k, m in patterns[i][0] for _ in range(m * n)), reverse=True)
        found = branch(pieces, taken - 1, capacity)
        if found:
            rest = [(p, t - dict(chosen).get(i, 0)) for i, (p, t) in enumerate(patterns)]
            fresh = [(sorted(Counter(s).items(), reverse=True), 1) for s in found]
            return improved([(p, t) for p, t in rest if t] + fresh, counts, capacity)
    return patterns


def branch(pieces: list[int], sequences: int, capacity: int) -> list[list[int]] | None:
    """The pieces in so many sequences, or None if the search finds none."""
    budget = [TAIL_NODES]

    def place(rest: dict[int, int], sequences_left: int, waste_left: int) -> list[list[int]] | None:
        if not rest:
            return []
        if not sequences_left or budget[0] <= 0:
            return None
        largest = next(iter(rest))
        room = capacity - largest
        for chosen in completions(less(rest, {largest: 1}), room, waste_left, budget):
            gone = less(rest, Counter([largest, *chosen]))
            found = place(gone, sequences_left - 1, waste_left - (room - sum(chosen)))
            if found is not None:
                return [[largest, *chosen], *found]
            if budget[0] <= 0:
                return None
        return None

    waste = sequences * capacity - sum(pieces)
    return place(dict(sorted(Counter(pieces).items(), reverse=True)), sequences, waste) if waste >= 0 else None


def less(rest: dict[int, int], gone: dict[int, int]) -> dict[int, int]:
    return {k: n - gone.get(k, 0) for k, n in rest.items() if n > gone.get(k, 0)}


def completions(rest: dict[int, int], room: int, waste: int, budget: list[int], most: int = 30) -> list[list[int]]:
    """Undominated fillings of ``room`` that waste no more than ``waste``, fullest first; ``rest`` descends."""
    lengths, out = list(rest.items()), []

    def go(i: int, free: int, path: list[tuple[int, int]], short: int) -> None:
        """``short``: the least length of which pieces were left out."""
        budget[0] -= 1
        while i < len(lengths) and lengths[i][0] > free:
            i += 1
        if i == len(lengths):
            if short > free and free <= waste:
                out.append([k for k, n in path for _ in range(n)])
            return
        length, have = lengths[i]
        for n in range(min(have, free // length), -1, -1):
            go(i + 1, free - n * length, [*path, (length, n)], short if n == have else length)
            if budget[0] <= 0 or len(out) >= most:
                return

    go(0, room, [], room + 1)
    out.sort(key=lambda p: (-sum(p), len(p)))
    kept: list[list[int]] = []
    for filling in out:
        if not any(dominates(k, filling) for k in kept):
            kept.append(filling)
    return kept


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the pieces of ``b`` fit into rooms of the sizes of ``a``'s, so that ``b`` can be swapped for ``a`` in any packing.

    Both descend. Best fit answers; where it fails the other way may still exist, and ``b`` stays.
    """
    if len(b) < len(a) or len(b) > 24:
        return False
    rooms = sorted(a)
    for piece in b:
        at = bisect.bisect_left(rooms, piece)
        if at == len(rooms):
            return False
        room = rooms.pop(at) - piece
        if room:
            bisect.insort(rooms, room)
    return True


def ranges(patterns: list) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset) for the ranks of each length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for uses, times in patterns:
        offset = 0
        for length, n in uses:
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """With ``rank``: from 0, among the pieces of the same length."""
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS))
    pieces = pieces.withColumn("bucket", bucket)
    counts = pieces.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket")
    counts = counts.select("length", "bucket", (F.sum("count").over(before) - F.col("count")).alias("ahead"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return pieces.join(counts, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece with its sequence and its place there."""
    pieces = checkpoint(tokenized(docs, id_col, text_col, path, capacity))
    histogram = pieces.groupBy("length").count().collect()  # ``capacity`` rows at most
    plan = ranges(complete({r["length"]: r["count"] for r in histogram}, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(rank) else plan[:0]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // np.maximum(row[:, 2], 1), row[:, 4] + nth % np.maximum(row[:, 2], 1) * length
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(place, PLACED)
