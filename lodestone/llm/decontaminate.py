"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are words (runs of letters, figures and characters beyond ASCII, in lower case). All runs of
``least`` words of the items are seeds; rolling Karp-Rabin hashes over a text find the seeds that it shares, and what they
find is compared word by word (words are told by 64-bit hashes). For each pair of text and item that shares enough, the
longest matches of words that no tile has yet become tiles; what is left is matched again, round by round, down to
``least`` words. An item leaks into a text whose tiles cover ``threshold`` of it or more, in whatever order its passages
stand.

The items are the stated query set: they are taken in blocks of ``block_words`` words at most, and a block's seeds are
sent to every task, so what is broadcast doesn't grow with them. The driver holds one block; where there are more, each
one's finds are written to the shared folder and its broadcast is dropped before the next. No pair is left out. Texts
aren't shuffled.

Defined cases: ids are longs or null. Null or empty texts and items match nothing; an item of fewer words than ``least``
must stand whole; rows with repeated ids share their matches, and null ids match by their own null. An item with a null
id counts as one more item, first in the list. Other columns of both tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, released, small_batches, text_chunks
from .shingles import MARKS, buffers, windows, words

TABLE_BITS = 20


class Seeds:
    """The seeds of a block of items: sorted hashes with their postings (item, place), by length of seed."""

    def __init__(self, ids: list, texts: list[str], least: int):
        data, offsets = buffers(pc.utf8_lower(pa.array(texts, pa.string())))
        self.hashes, _, _, self.rows = words(data, offsets, MARKS)
        self.ids, self.tables = ids, []
        sizes = np.diff(self.rows)
        for k in sorted(set(np.minimum(sizes, least).tolist()) - {0}):
            items = np.flatnonzero(np.minimum(sizes, least) == k)
            item = np.repeat(items, sizes[items] - k + 1)
            place = np.concatenate([np.arange(sizes[i] - k + 1) for i in items])
            seed = windows(self.hashes, k)[self.rows[item] + place]
            order = np.argsort(seed, kind="stable")
            values, first = np.unique(seed[order], return_index=True)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.tables.append((k, values, np.append(first, len(order)), item[order], place[order], table))

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(row, item, seed length, places in the item, places in the row's words) for each pair that shares seeds."""
        for k, values, first, item, place, table in self.tables:
            seen = windows(hashes, k)
            at = np.flatnonzero(table[(seen >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(values, seen[at]), len(values) - 1)
            row = np.searchsorted(rows, at, side="right") - 1
            good = (values[slot] == seen[at]) & (at + k <= rows[row + 1])
            at, slot, row = at[good], slot[good], row[good]
            if not len(at):
                continue
            for a, b in _groups(row):
                yield from self._of_row(int(row[a]), k, first, item, place, slot[a:b], at[a:b], hashes, int(rows[row[a]]))

    def _of_row(self, row: int, k: int, first: np.ndarray, item: np.ndarray, place: np.ndarray, slot: np.ndarray, at: np.ndarray, hashes: np.ndarray, begin: int):
        """One row's pairs, item by item: a seed's postings are read once, however often the text repeats it."""
        order = np.argsort(slot, kind="stable")
        slot, at = slot[order], at[order]
        kinds, start = np.unique(slot, return_index=True)
        ends = np.append(start[1:], len(slot))
        many = first[kinds + 1] - first[kinds]
        post = np.repeat(first[kinds] - np.cumsum(many) + many, many) + np.arange(many.sum())
        kind, items, places = np.repeat(np.arange(len(kinds)), many), item[post], place[post]
        order = np.argsort(items, kind="stable")
        for c, d in _groups(items[order]):
            pick = order[c:d]
            words_of = self.hashes[self.rows[items[pick[0]]] :]
            often = (ends - start)[kind[pick]]
            there = at[np.repeat(start[kind[pick]] - np.cumsum(often) + often, often) + np.arange(often.sum())]
            here = np.repeat(places[pick], often)
            same = np.ones(len(here), bool)
            for i in range(k):
                same &= words_of[here + i] == hashes[there + i]
            if same.any():
                yield row, int(items[pick[0]]), k, here[same], there[same] - begin


def _groups(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def tiled(places: np.ndarray, there: np.ndarray, k: int) -> int:
    """Words of the item that greedy tiles of at least k words cover, from all shared windows of k words.

    Each round matches anew what no tile has: the windows that are left, put together along their diagonals. The longest
    matches become tiles, those that come first before others that overlap them.
    """
    in_item, in_text = np.zeros(places.max() + k, bool), np.zeros(there.max() + k, bool)
    order = np.lexsort((places, there - places))
    places, there = places[order], there[order]
    while len(places):
        diagonal = there - places
        new = np.ones(len(places), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (places[1:] != places[:-1] + 1)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(places))) + k - 1
        most = int(length.max())
        for p, t in sorted(zip(places[start[length == most]].tolist(), there[start[length == most]].tolist(), strict=True)):
            if not (in_item[p : p + most].any() or in_text[t : t + most].any()):
                in_item[p : p + most] = in_text[t : t + most] = True
        taken, met = (np.concatenate([[0], np.cumsum(x)]) for x in (in_item, in_text))
        free = (taken[places + k] == taken[places]) & (met[there + k] == met[there])
        places, there = places[free], there[free]
    return int(in_item.sum())


def leaks(seeds: Seeds, texts: pa.Array, threshold: float) -> Iterator[tuple[int, object, float]]:
    """(row, item id, coverage) of the items that leak into the rows."""
    data, offsets = buffers(pc.utf8_lower(texts))
    hashes, _, _, rows = words(data, offsets, MARKS)
    for row, item, k, places, there in seeds.hits(hashes, rows):
        size = int(seeds.rows[item + 1] - seeds.rows[item])
        reached = len(np.unique(np.add.outer(places, np.arange(k))))
        if reached >= threshold * size - 1e-9 and (covered := tiled(places, there, k)) >= threshold * size - 1e-9:
            yield row, seeds.ids[item], covered / size


def _blocks(benchmark: DataFrame, least: int, block_words: int) -> Iterator[Seeds]:
    ids, texts, size = [], [], 0
    for r in benchmark.where("text is not null").toLocalIterator():
        ids.append(r["item_id"]), texts.append(r["text"])
        size += len(r["text"]) // 2 + 1  # no text has more words than that
        if size >= block_words:
            yield Seeds(ids, texts, least)
            ids, texts, size = [], [], 0
    if ids:
        yield Seeds(ids, texts, least)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: int = 5, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage of every pair of a text and an item that leaks into it."""
    plain, sc = id_text(docs, id_col, text_col), docs.sparkSession.sparkContext
    out = last = None
    for block in _blocks(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), least, block_words):
        if last is not None:
            last[1] = materialise(last[1], "leaks")
            last[0].unpersist()
        shared = sc.broadcast(block)
        last = [shared, plain.mapInArrow(released(_finder(shared, threshold)), "doc_id bigint, item_id bigint, coverage double")]
        out = [last] if out is None else [*out, last]
    none = plain.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(0.0).alias("coverage")).where("false")
    return reduce(DataFrame.union, [found for _, found in out or []], none)


def _finder(shared, threshold: float):
    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                ids = part.column(0).to_pylist()
                found = list(leaks(shared.value, part.column(1), threshold))
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.float64())], names=["doc_id", "item_id", "coverage"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: int = 5, block_words: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that no item leaks into; blocks of items pass over the texts in turn.

    Rows with a null or empty text stay, whatever their id.
    """

    def keeper(shared):
        def run(batches):
            for batch in batches:
                good, row = np.ones(batch.num_rows, bool), 0
                for part in text_chunks(batch.select([text_col])):
                    good[[row + r for r, _, _ in leaks(shared.value, part.column(0), threshold)]] = False
                    row += part.num_rows
                yield batch.filter(pa.array(good))

        return run

    small_batches(docs.sparkSession)
    for block in _blocks(benchmark, least, block_words):
        docs = docs.mapInArrow(released(keeper(docs.sparkSession.sparkContext.broadcast(block))), docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, items (ascending) and the best coverage of every row; 0.0 where nothing leaks."""
    pairs = contamination(docs, benchmark, threshold, least, id_col=id_col, text_col=text_col)
    per = pairs.groupBy(F.col("doc_id").alias("found")).agg(F.sort_array(F.collect_set(F.struct("item_id"))).alias("items"), F.max("coverage").alias("coverage"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(per, F.col("doc_id").eqNullSafe(F.col("found")), "left")
    items = F.coalesce("items.item_id", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.size(items).cast("bigint").alias("n_items"), items.alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")).select(
        "doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "items", "coverage"
    )
