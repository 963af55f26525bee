"""Benchmark decontamination: BM25 over test items with block-max WAND, queried by every passage.

The index holds each item's terms with BM25 weights, divided by the item's weight for itself, so
a passage scores the share of the item that it has.  Passages are windows of successive blocks of
``BLOCK`` words, one block apart, and follow the item: as many blocks as it needs wherever it
starts (two up to ``BLOCK`` words).  Each posting list is cut into blocks of items with the largest
weight of each, and a search skips items and blocks whose bounds can't reach the threshold.

Most passages never start a search.  Each item sets aside its most common terms, together worth
less than half of the threshold, and the rest of its postings give, for all passages of a batch
at once and wherever they start, an upper bound of any score; only passages whose bound reaches the threshold are
searched, among the items of their length.  Retrieved items are then verified: the passage's surroundings must hold most word
trigrams of the item's question and of its answer (its last sentence).

Items are shipped to the executors in shards of bounded size, one after the other; the number of
items, their mean length and the terms' document frequencies are those of all shards together.

Defined results: null or wordless texts and items match nothing; repeated documents are judged
each; items with equal texts are found each under its own id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, portions, written

BLOCK = 64
THRESHOLD = 0.6
#: Share of the question's, and of the answer's, trigrams that must be there.
OVERLAP = 0.6
K1, B = 1.2, 0.75
#: Items whose index is shipped at once.
SHARD_ITEMS = 20_000
#: Items of a block of a posting list.
LIST_BLOCK = 64
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words before and in its last sentence; of one sentence the last quarter is the answer."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    whole = sentences[0] if sentences else []
    cut = len(whole) - -(-len(whole) // 4)
    return whole[:cut], whole[cut:]


def trigrams(terms: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(3, len(terms))
    return {tuple(terms[k : k + n]) for k in range(len(terms) - n + 1)} if n else set()


def blocks_of(size: int) -> int:
    """Blocks of a passage for an item of so many words."""
    return -(-size // BLOCK) + 1


class Statistics(NamedTuple):
    """Of all items, also those of other shards; df has the terms of the shard at least."""

    items: int
    words: int
    df: Mapping[bytes, int]


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]], overall: Statistics | None = None):
        items = sorted(((i, t) for i, t in items if t and words(t)), key=lambda x: blocks_of(len(words(x[1]))))
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        counts = [Counter(words(t)) for _, t in items]
        sizes = [sum(c.values()) for c in counts]
        self.sizes = sizes
        #: Blocks of each item's passages; items are in order of it, so those of one length are a range.
        self.span = np.array([blocks_of(x) for x in sizes], dtype=np.int64)
        here = Counter(t for c in counts for t in c)
        n, total, df = overall or Statistics(len(items), sum(sizes), here)
        mean = total / max(1, n)
        self.terms = {t: k for k, t in enumerate(here)}
        idf = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in here}
        lists: list[list[tuple[int, float]]] = [[] for _ in here]
        essential: list[list[tuple[int, float]]] = [[] for _ in here]
        self.aside = np.zeros(len(items))
        for k, c in enumerate(counts):
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[k] / mean)) for t, f in c.items()}
            own = sum(weight.values())
            for t in sorted(c, key=lambda t: (-df[t], t)):
                share = weight[t] / own
                lists[self.terms[t]].append((k, share))
                if self.aside[k] + share < THRESHOLD / 2:
                    self.aside[k] += share
                else:
                    essential[self.terms[t]].append((k, share))
        self.lists = [(np.array([k for k, _ in x]), np.array([w for _, w in x])) for x in lists]
        self.most = np.array([w.max() for _, w in self.lists]) if lists else np.zeros(0)
        self.blocks = [[w[k : k + LIST_BLOCK].max() for k in range(0, len(w), LIST_BLOCK)] for _, w in self.lists]
        flat = [p for x in essential for p in x]
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in essential]))).astype(np.int64)
        self.item = np.array([k for k, _ in flat], dtype=np.int64)
        self.weight = np.array([w for _, w in flat])

    def term_ids(self, text: str) -> np.ndarray:
        """Of each word its term, or -1."""
        return np.fromiter(map(self.terms.get, words(text), repeat(-1)), dtype=np.int64)

    def promising(self, blocks: np.ndarray, terms: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """(first block, blocks) of the passages that may reach the threshold for some item; starts are the texts' first blocks."""
        have = self.start[terms + 1] - self.start[terms]
        blocks, terms, have = blocks[have > 0], terms[have > 0], have[have > 0]
        if not len(terms):
            return np.empty((0, 2), dtype=np.int64)
        starts = np.zeros(1, dtype=np.int64) if starts is None else np.asarray(starts, dtype=np.int64)
        ends = np.cumsum(have)
        posting = np.repeat(self.start[terms] - ends + have, have) + np.arange(ends[-1])
        stride = int(blocks.max()) + 1
        # of each posting the blocks that have it, once each
        keys = np.unique(posting * stride + np.repeat(blocks, have))
        posting, block = keys // stride, keys % stride
        item, weight = self.item[posting], self.weight[posting]
        before = np.concatenate(([-1], np.where(posting[1:] == posting[:-1], block[:-1], -1)))
        # a passage holds it first in this block if it starts after the block before, reaches here, and is of this text
        first = np.maximum(np.maximum(before, block - self.span[item]) + 1, starts[np.searchsorted(starts, block, side="right") - 1])
        # what passages gain and lose by where they start; every start between two changes has the same bound
        stride += 1
        change = np.concatenate((item * stride + first, item * stride + block + 1))
        order = np.argsort(change, kind="stable")
        change, weight = change[order], np.concatenate((weight, -weight))[order]
        at = np.flatnonzero(np.concatenate(([True], change[1:] != change[:-1])))
        change, bound = change[at], np.cumsum(np.add.reduceat(weight, at))
        item = change // stride
        may = np.flatnonzero(bound[:-1] + self.aside[item[:-1]] >= THRESHOLD - 1e-6)
        may = may[item[may] == item[may + 1]]
        many = change[may + 1] - change[may]
        start = np.repeat(change[may] % stride, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.unique(np.stack([start, np.repeat(self.span[item[may]], many)], axis=1), axis=0)

    def search(self, terms: np.ndarray, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All items (of those from low to before high) that the passage's distinct terms score at least the threshold for, by block-max WAND."""
        high = len(self.ids) if high is None else high
        cursors = []  # (item, term, place in the term's list)
        for t in np.unique(terms).tolist():
            ids = self.lists[t][0]
            at = int(np.searchsorted(ids, low)) if low else 0
            if at < len(ids) and ids[at] < high:
                cursors.append((int(ids[at]), t, at))
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= THRESHOLD - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            upto = pivot
            while upto + 1 < len(cursors) and cursors[upto + 1][0] == item:
                upto += 1
            moved, block_bound = [], 0.0
            for have, t, at in cursors[: upto + 1]:
                ids = self.lists[t][0]
                if have < item:
                    at += int(np.searchsorted(ids[at:], item))
                    have = int(ids[at]) if at < len(ids) else high
                moved.append((have, t, at))
                if at < len(ids):
                    block_bound += self.blocks[t][at // LIST_BLOCK]
            if block_bound >= THRESHOLD - 1e-9:
                score = math.fsum(self.lists[t][1][at] for have, t, at in moved if have == item)
                if score >= THRESHOLD - 1e-9:
                    found.append((item, score))
            left = []
            for have, t, at in moved:
                ids = self.lists[t][0]
                if have == item:
                    at += 1
                    have = int(ids[at]) if at < len(ids) else high
                if have < high:
                    left.append((have, t, at))
            cursors = left + cursors[upto + 1 :]
        return found

    def verify(self, item: int, near: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's trigrams that the words hold."""
        have = [trigrams(near)] + [set(zip(near)), set(zip(near, near[1:]))]
        shares = []
        for part in self.parts[item]:
            wanted = trigrams(part)
            held = have[0] if len(part) >= 3 else have[len(part)] if part else set()
            shares.append(len(wanted & held) / len(wanted) if wanted else 1.0)
        return shares[0], shares[1]

    def judge(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item's id, score, question's share, answer's share) of each verified pair, its best passage."""
        if not self.ids:
            return
        ids = [self.term_ids(t) if t else np.empty(0, dtype=np.int64) for t in texts]
        starts, blocks, terms, at = [], [], [], 0
        for x in ids:
            starts.append(at)
            known = np.flatnonzero(x >= 0)
            blocks.append(at + known // BLOCK)
            terms.append(x[known])
            at += len(x) // BLOCK + 2  # a block stays empty between two texts
        passages = self.promising(np.concatenate(blocks), np.concatenate(terms), np.array(starts)) if ids else np.empty((0, 2), dtype=np.int64)
        rows = np.searchsorted(starts, passages[:, 0], side="right") - 1
        lows, highs = (np.searchsorted(self.span, passages[:, 1], side=side) for side in ("left", "right"))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        cut: tuple[int, list[bytes]] = (-1, [])
        for row, (passage, span), low, high in zip(rows.tolist(), passages.tolist(), lows.tolist(), highs.tolist()):
            first = (passage - starts[row]) * BLOCK
            after = first + span * BLOCK
            window = ids[row][first:after]
            for item, score in self.search(window[window >= 0], low, high):
                if cut[0] != row:
                    cut = row, words(texts[row])
                more = max(0, self.sizes[item] - BLOCK)
                shares = self.verify(item, cut[1][max(0, first - more) : after + more])
                if min(shares) >= OVERLAP:
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, *shares))
        for (row, item), found in best.items():
            yield row, self.ids[item], *found


def _shards(benchmark: DataFrame):
    """Indexes of the items, SHARD_ITEMS at a time; items come to the driver one shard after the other."""
    spark = benchmark.sparkSession
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = ((r["item_id"], r["text"]) for r in source.orderBy("item_id").toLocalIterator())
    part, following = list(islice(rows, SHARD_ITEMS)), list(islice(rows, SHARD_ITEMS))
    if part and not following:  # the only shard has all items: their statistics are its own
        yield spark.sparkContext.broadcast(ItemIndex(part))
        return
    count = _counted(source) if part else None
    while part:
        yield spark.sparkContext.broadcast(ItemIndex(part, count(part)))
        part, following = following, list(islice(rows, SHARD_ITEMS))


def _counted(source: DataFrame):
    """Counts items, words and documents of each term over all items; gives them for the terms of some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch.column("text").to_pylist() if t and (w := words(t))]
            df = Counter(t for w in found for t in set(w))
            # the null term has the number of items and of words
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([len(found), *df.values()], pa.int64()), pa.array([sum(map(len, found))] + [0] * len(df), pa.int64())], ["term", "n", "words"])

    counts = written(map_batches(source, run, "term binary, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "item-terms")
    whole = counts.where("term is null").first()

    def count(items: list[tuple[int, str]]) -> Statistics:
        shared = counts.sparkSession.sparkContext.broadcast(sorted({w for _, t in items if t for w in words(t)}))

        def of_these(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = pa.array(shared.value, pa.binary())
            for batch in batches:
                yield batch.filter(pc.is_in(batch.column("term"), value_set=wanted))

        found = map_batches(counts.where("term is not null").select("term", "n"), of_these, "term binary, n long").collect()
        return Statistics(whole["n"], whole["words"], {bytes(r["term"]): r["n"] for r in found})

    return count


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified pair."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for shared in _shards(benchmark):
        found = map_batches(source, _finder(shared), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 512):
                found = list(shared.value.judge(part.column("text").to_pylist()))
                columns = list(zip(*found)) or [()] * 5
                rows = part.column("doc_id").take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a verified item; judged where they are, without a shuffle."""
    for shared in _shards(benchmark):
        docs = map_batches(docs, _cleaner(shared), docs.schema)
    return docs


def _cleaner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 512):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[x[0] for x in shared.value.judge(part.column("text").to_pylist())]] = False
                yield part.filter(pa.array(keep))

    return run
