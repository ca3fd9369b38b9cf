"""Exact deduplication with Patricia-trie owners.

Every map task inserts its texts into a compressed radix trie and sends each
different text once, with the smallest id and the number of rows seen, so that
a group of copies costs one row a task before the shuffle. The rows are dealt
by length and content hash; each reduce task inserts the whole byte strings
into a trie whose terminal nodes hold the smallest id. The owners are joined
back to the rows on length and hash, a join that adaptive execution splits
where one group is hot.

Defined results. Null texts count as empty. Rows with equal text and equal id
are the same document: the digest marks each of them kept, and
:func:`exact_dedup` returns one of them. Null ids sort after all others. An
empty table gives an empty result. A text of any length is one key; the task
that meets it holds it whole. Columns other than the two named ones are
neither read by the digest nor changed by the filter.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.common import SPACE_RE, task_folder

#: Bytes of keys that a task's trie holds before it sends or spills them.
TRIE_BYTES = 16 << 20
#: What a node weighs besides its label.
NODE_BYTES = 300
#: Bytes of texts in a batch that a task sends.
BATCH_BYTES = 2 << 20
NO_ID = (1 << 63) - 1


class Node:
    """A node of the trie: an edge label, children by first byte, and the owner of the key that ends here."""

    __slots__ = ("label", "children", "least", "rows", "own", "file")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.file = None  # of a subtree that was spilled
        self.children: dict[int, Node] = {}
        self.least, self.rows, self.own = NO_ID, 0, 0

    def take(self, least: int, rows: int, own: int) -> None:
        """Merge an owner: rows in all, and ``own`` of them with the id ``least``."""
        if not self.rows or least < self.least:
            self.least, self.own = least, own
        elif least == self.least:
            self.own += own
        self.rows += rows


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection over slice comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over whole byte strings that spills by subtree.

    When more than ``budget`` bytes are held, the heaviest subtrees below the
    first node that branches go to files of their own, until half the budget is
    free. What all keys share above that node is never walked byte by byte, so a
    long common beginning costs no extra rounds. A spilled subtree leaves its
    first byte behind, and later keys below it are appended to its file.
    :meth:`owners` reads the files back one by one, each as a trie of its own
    with fewer keys than the one it came from, so memory stays near the budget
    (or one key, if that is larger).
    """

    def __init__(self, budget: int = TRIE_BYTES) -> None:
        self.budget, self.held = budget, 0
        self.root = Node(b"")
        self.spilled: list[object] = []

    def insert(self, key: bytes, least: int, rows: int = 1, own: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.take(least, rows, own)
                return
            child = node.children.get(key[at])
            if child is None:
                leaf = Node(key[at:])
                leaf.take(least, rows, own)
                node.children[key[at]] = leaf
                self._grow(len(leaf.label))
                return
            if child.file is not None:
                pickle.dump((key, least, rows, own), child.file)
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = shared(label, key[at : at + len(label)])
            upper = Node(label[:cut])
            child.label = label[cut:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.held += NODE_BYTES
            node, at = upper, at + cut

    def _grow(self, size: int) -> None:
        self.held += size + NODE_BYTES
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while True:
            inner = [c for c in node.children.values() if c.file is None]
            if len(inner) != 1 or node.rows or not inner[0].children:
                break
            node = inner[0]
            prefix += node.label
        weights = sorted(((weight(c), byte) for byte, c in node.children.items() if c.file is None), reverse=True)
        for size, byte in weights if len(weights) > 1 or node.rows or prefix else []:
            if self.held <= self.budget // 2:
                break
            stub = Node(bytes([byte]))
            stub.file = tempfile.TemporaryFile(dir=task_folder())
            for key, found in walk(node.children[byte], prefix):
                pickle.dump((key, found.least, found.rows, found.own), stub.file)
            for inner in files_below(node.children[byte]):
                inner.seek(0)
                shutil.copyfileobj(inner, stub.file, 1 << 20)
                inner.close()
                self.spilled.remove(inner)
            node.children[byte] = stub
            self.spilled.append(stub.file)
            self.held -= size

    def owners(self) -> Iterator[tuple[bytes, int, int, int]]:
        """Each different key with its smallest id, its rows, and the rows that carry that id."""
        files = yield from self._told()
        while files:
            file = files.pop()
            file.seek(0)
            below = PatriciaTrie(self.budget)
            while True:
                try:
                    below.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            files += yield from below._told()

    def _told(self) -> Generator[tuple[bytes, int, int, int], None, list[object]]:
        """The owners in memory, which are then let go; returns the files of the others."""
        for key, node in walk(self.root):
            yield key, node.least, node.rows, node.own
        self.root, files, self.spilled = Node(b""), self.spilled, []
        return files


def walk(root: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
    """Terminal nodes in memory with their keys."""
    stack = [(prefix, root)]
    while stack:
        prefix, node = stack.pop()
        key = prefix + node.label
        if node.rows:
            yield key, node
        stack.extend((key, child) for child in node.children.values() if child.file is None)


def files_below(root: Node) -> list:
    """Files of subtrees that were spilled inside this one before."""
    stack, found = [root], []
    while stack:
        node = stack.pop()
        if node.file is not None:
            found.append(node.file)
        stack.extend(node.children.values())
    return found


def weight(root: Node) -> int:
    """Bytes that a subtree holds."""
    stack, total = [root], 0
    while stack:
        node = stack.pop()
        total += len(node.label) + NODE_BYTES
        stack.extend(child for child in node.children.values() if child.file is None)
    return total


LOCAL = "bytes long, sha string, text string, least long, n long, own long"
OWNERS = "bytes long, sha string, keep_id long, group_size long, own long"


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different text of a task, with the smallest id and the counts."""

    def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, least, n, own in trie.owners():
            rows.append((len(key), hashlib.sha256(key).hexdigest(), key.decode(), least, n, own))
            size += len(key)
            if size > BATCH_BYTES:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bytes", "sha", "text", "least", "n", "own"])

    trie = PatriciaTrie(2 * TRIE_BYTES)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            trie.insert(text.as_py().encode(), NO_ID if doc_id is None else doc_id)
            if trie.held > TRIE_BYTES:
                yield from flush(trie)
                trie = PatriciaTrie(2 * TRIE_BYTES)
    yield from flush(trie)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owners of a reduce task's keys: whole texts under their content hash."""
    trie = PatriciaTrie()
    for batch in batches:
        numbers = [batch.column(i).to_pylist() for i in (3, 4, 5)]
        for sha, text, least, n, own in zip(batch.column(1), batch.column(2), *numbers, strict=True):
            trie.insert(bytes.fromhex(sha.as_py()) + text.as_py().encode(), least, n, own)
    rows = []
    for key, least, n, own in trie.owners():
        rows.append((len(key) - 32, key[:32].hex(), least, n, own))
        if len(rows) == 20_000:
            yield owner_batch(rows)
            rows = []
    if rows:
        yield owner_batch(rows)


def owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bytes", "sha", "keep_id", "group_size", "own"])


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " ")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bytes, sha, keep_id, group_size, own``: one row for each different text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normal_text(F.col(text_col)).alias("text"))
    return rows.mapInArrow(combine, LOCAL).repartition("bytes", "sha").mapInArrow(merge, OWNERS)


def keyed(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """``row`` of each row, with its id and its text's length and hash."""
    keys = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), normal_text(F.col(text_col)).alias("text"))
    return keys.select("row", "id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its owner, its group's size, and whether it stays."""
    found = keyed(docs, id_col, text_col, F.lit(0)).join(owners(docs, id_col, text_col), ["bytes", "sha"])
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return found.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), "group_size", F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; one row where a document repeats as a whole."""
    rows = keyed(docs, id_col, text_col, F.struct(*(docs[c] for c in docs.columns))).withColumn("keep_id", F.coalesce("id", F.lit(NO_ID)))
    found = rows.join(owners(docs, id_col, text_col).select("bytes", "sha", "keep_id", "own"), ["bytes", "sha", "keep_id"])
    once, again = found.where("own = 1"), found.where("own > 1").dropDuplicates(["bytes", "sha"])
    return once.unionByName(again).select("row.*")
