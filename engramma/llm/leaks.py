"""Problem 7: evaluation passages inside training text, by size-partitioned MinHash containment search.

A test item's text and question are cut, at the sentences that several items share (instructions), into passages. Passages
are partitioned by size: class k has those of 12*2^k words and more. A passage leaks if twelve of its consecutive words,
that is eight consecutive shingles of five words, stand in a document, so a class has its own least containment: eight
shingles of the most that a passage of the class can have. Against documents of any length this is searched by banded
MinHash over passages' and documents' windows of that least size: one band of two minima a window. The same eight
shingles have the same minima wherever they stand, so no leak is without a candidate, and since neighbouring windows
mostly share their minima, a passage or document has far fewer distinct bands than words. A candidate (document, passage)
is then verified by exact shingle containment: the share of the passage's shingles that the document has must reach that of
its class, and eight of them must follow each other in both, word for word.

Passages of a bounded size in bytes go to every worker with their bands; beyond it, bands are joined by shuffle (numbers
only), and the texts of documents with candidates are fetched for verification.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.llm.plaintext import plain_text, plain_words
from engramma.session import stored

RUN = 12
SHINGLE = 5
#: The shingles of a run.
NEED = RUN - SHINGLE + 1
#: A sentence of at least so many words that at least so many items share is an instruction.
INSTRUCTION_WORDS, INSTRUCTION_ITEMS = 6, 3
#: Passages up to so many bytes of words go to every worker; with more, bands are joined by shuffle.
INDEX_BYTES = 8 << 20

_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash of each ``n`` consecutive entries."""
    out = np.zeros(max(0, h.size - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ (h[k : h.size - n + 1 + k] + np.uint64(k))) * _ODD
        out ^= out >> np.uint64(29)
    return (out * _MIX) ^ (out >> np.uint64(32))


def bands(s: np.ndarray) -> np.ndarray:
    """One band of two minima for each window of eight shingles: under the shingles' own order, and under a mixed one."""
    mixed = (s ^ (s >> np.uint64(31))) * _MIX
    least = [np.lib.stride_tricks.sliding_window_view(x, NEED).min(1) for x in (s, mixed)]
    return (least[0] * _ODD ^ least[1]).view(np.int64)


def size_class(words: int) -> int:
    return (words // RUN).bit_length() - 1


def least_containment(k: int) -> float:
    """What share of the shingles of a passage of class ``k`` a run of twelve words is at least."""
    return NEED / (RUN * 2 ** (k + 1) - 1 - SHINGLE + 1)


def passages(items: DataFrame) -> DataFrame:
    """(item_id, part, nr, size, words): the passages between instruction sentences, of twelve words at least; ``size`` is
    the class. Sentences are counted and marked as rows, so neither items nor instructions are held in one place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, n, " ".join(plain_words(s))) for i, *texts in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for p, t in enumerate(texts) for n, s in enumerate(_SENTENCE.split(t or ""))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=["item_id", "part", "nr", "words"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, p, sentences in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                runs: list[list[str]] = [[]]
                for s in sentences:
                    if s["shared"]:
                        runs.append([])
                    else:
                        runs[-1] += s["words"].split()
                rows += [(i, p, n, size_class(len(r)), " ".join(r)) for n, r in enumerate(runs) if len(r) >= RUN]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=["item_id", "part", "nr", "size", "words"])

    sentences = items.where("item_id is not null").select("item_id", "text", "question").distinct().mapInArrow(cut, "item_id long, part int, nr int, words string").where("words <> ''")
    told = sentences.where(F.size(F.split("words", " ")) >= INSTRUCTION_WORDS).groupBy("words").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= INSTRUCTION_ITEMS).select("words", F.lit(True).alias("shared"))
    marked = sentences.join(told, "words", "left").groupBy("item_id", "part").agg(F.array_sort(F.collect_list(F.struct("nr", F.coalesce("shared", F.lit(False)).alias("shared"), "words"))).alias("s"))
    return marked.select("item_id", "part", "s").mapInArrow(join, "item_id long, part int, nr int, size int, words string")


class Index:
    """Passages of all size classes with the posting lists of their bands."""

    def __init__(self, rows: list[tuple[int, int, str]]) -> None:
        self.item, self.least, self.words, self.hashes = [], [], [], []
        self.posting: dict[int, list[tuple[int, int]]] = {}  # band: (passage, position)
        known: dict[str, int] = {}
        for item, size, text in rows:
            words = text.split(" ")
            n = len(self.item)
            for w in words:
                if w not in known:
                    known[w] = _word_hash(w)
            s = shingles(np.array([known[w] for w in words], np.uint64))
            self.item.append(item)
            self.least.append(least_containment(size))
            self.words.append(words)
            self.hashes.append(s)
            for at, band in enumerate(bands(s).tolist()):
                self.posting.setdefault(band, []).append((n, at))
        self.known = known
        self.all_bands = np.array(sorted(self.posting), np.int64)

    def verified(self, words: list[str], s: np.ndarray, found: list[tuple[int, int, int]]) -> set[int]:
        """The items of candidates (passage, position there, position in the document) that stand the exact check."""
        out: set[int] = set()
        share: dict[int, bool] = {}
        for n, q, p in found:
            if self.item[n] in out:
                continue
            if n not in share:
                share[n] = bool(np.isin(self.hashes[n], s).mean() >= self.least[n])
            if share[n] and self.words[n][q : q + RUN] == words[p : p + RUN]:
                out.add(self.item[n])
        return out

    def search(self, text: str) -> set[int]:
        """The items of which a text has twelve consecutive words of a passage."""
        words = _WORD.findall(plain_text(text))
        if len(words) < RUN or not self.all_bands.size:
            return set()
        get = self.known.get
        h = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        # a window with a word that no passage has can match nothing
        foreign = np.concatenate([[0], np.cumsum(h == 0)])
        free = foreign[RUN:] == foreign[:-RUN]
        if not free.any():
            return set()
        s = shingles(h)
        b = bands(s)
        at = np.flatnonzero(free)
        at = at[np.isin(b[at], self.all_bands)]
        return self.verified(words, s, [(n, q, p) for p in at.tolist() for n, q in self.posting[int(b[p])]])


_PAIR = "doc_id long, item_id long"


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["doc_id", "item_id"])


def leaks(documents: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id), distinct: the documents with at least twelve consecutive words of an item's text or question.

    Null, empty and short texts match nothing; rows with a null id are left out; repeated rows change nothing; if either
    table is empty, so is the result.
    """
    known = stored(passages(items).distinct(), "leak-passages")
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    return (_by_index(docs, known) if size <= index_bytes else _by_shuffle(docs, known)).distinct()


def _by_index(docs: DataFrame, known: DataFrame) -> DataFrame:
    rows = [tuple(r) for r in known.select("item_id", "size", "words").collect()]  # of a size that was measured
    shared = docs.sparkSession.sparkContext.broadcast(Index(rows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            yield _pairs([(doc, i) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in index.search(text)])

    return docs.mapInArrow(search, _PAIR)


def _by_shuffle(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Bands of passages and documents are joined within nothing but their value; candidates fetch the texts of both."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _WORD.findall(plain_text(text))
                if len(words) >= RUN:
                    own = np.unique(bands(shingles(np.array([_word_hash(w) for w in words], np.uint64))))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * own.size, pa.int64()), pa.array(own)], names=["key", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(5)]
            yield _pairs([(doc, item) for doc, text, item, size, words in zip(*cols, strict=True) if Index([(item, size, words)]).search(text)])

    numbered = known.withColumn("key", F.xxhash64("item_id", "part", "nr"))
    mine = numbered.select("key", "words").mapInArrow(sketch, "key long, band long").withColumnRenamed("key", "passage")
    theirs = docs.mapInArrow(sketch, "key long, band long").withColumnRenamed("key", "doc_id")
    candidates = theirs.join(mine, "band").select("doc_id", "passage").distinct()
    whole = candidates.join(numbered.select(F.col("key").alias("passage"), "item_id", "size", "words"), "passage").join(docs, "doc_id")
    return whole.select("doc_id", "text", "item_id", "size", "words").mapInArrow(verify, _PAIR)
