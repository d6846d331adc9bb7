"""Exact removal of repeated passages: every byte covered by a ``least``-byte string that also starts earlier.

1. Anchors: of each ``least``-byte window the ``gram``-byte piece with the lowest hash. Two equal windows have equal
   anchors at equal places, so windows that match meet by an anchor that stands twice; the rest of the text is never sent.
2. An anchor's tile is the lowest row that has it, so all that copies one document meets in few tiles. What a row sends
   to a tile is the stretches around those anchors, in parts of bounded size. Tiles of more than TILE bytes are cut into
   pairs of blocks.
3. Equal parts are one. Of the rest a run-length index is built (see run_index): the transform as runs, sampled where
   they begin and end; matching statistics stream along the text from the samples. Positions whose match reaches
   ``least`` bytes form groups, and all of a group but the earliest are marked.
4. The marked windows of a row are merged and cut out of its text.

Rows are in order of their id (a long); positions are bytes of the whole text in UTF-8. Defined cases: a null text is empty; null
ids come first; rows with one id are in order of a hash of their texts, and if those are the same too they count as one
row, each with that row's result. Matches may overlap themselves. Hashes only gather what is then compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, mix64, packed_texts, released, text_chunks
from .run_index import RunIndex
from .shingles import CODES, _powers

#: Bytes of stretches that a tile may hold, that are indexed at once, and a byte that UTF-8 never has.
TILE, BATCH, STOP = 2_000_000, 1_000_000, 0xFF
#: Bytes of a stretch before it is cut, and of a text that are looked at at once.
PIECE, SLAB = 1 << 16, 1 << 20
#: An anchor that has more than one in so many of all places (and more than HOT_LEAST) is hot.
HOT, HOT_LEAST = 2000, 1000
#: Bits kept of an anchor's hash.
HASH_BITS = 48
CASED = CODES.copy()
CASED[65:91] = np.random.default_rng(7).integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The least (or largest) of each ``width`` values in a row, by doubling."""
    n, step = len(x) - width + 1, 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[:n], x[width - step : width - step + n])


def anchors(data: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the pieces that are lowest in some window; ties all count."""
    width = least - gram + 1
    if len(data) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CASED[data] * power[: len(data)], out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    low = _sliding(h, width, np.minimum)
    low = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(low, width, np.maximum) == h)
    return at, h[at]


def _in_slabs(data: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, some windows at a time: memory doesn't grow with the text."""
    if len(data) <= SLAB + least:
        return anchors(data, gram, least)
    parts = []
    for a in range(0, len(data) - least + 1, SLAB):
        at, h = anchors(data[a : a + SLAB + least - 1], gram, least)
        parts.append((at + a, h))
    at, first = np.unique(np.concatenate([x for x, _ in parts]), return_index=True)
    return at, np.concatenate([x for _, x in parts])[first]


def _anchors(docs: DataFrame, gram: int, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, 1 << 20):
                rows = part.column(0).to_numpy(zero_copy_only=False)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([len(x) for x in texts])
                at, h = _in_slabs(data, gram, least)
                row = np.searchsorted(ends, at, side="right")
                inside = at + gram <= ends[np.minimum(row, len(ends) - 1)]
                at, h, row = at[inside], h[inside], row[inside]
                start = np.concatenate([[0], ends])[row]
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - HASH_BITS)).astype(np.int64)), pa.array(rows[row].astype(np.int64)), pa.array((at - start).astype(np.int32))], names=["anchor", "row", "pos"])

    return docs.where(F.octet_length("text") >= least).select("row", "text").mapInArrow(released(run), "anchor bigint, row bigint, pos int")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with their place in order as ``row``: the id itself where ids are unique and none is null."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    twice = keyed.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not twice:
        return keyed.withColumn("row", F.col("doc_id"))
    keyed = keyed.withColumn("hash", F.sha2("text", 256))
    order = keyed.select("doc_id", "hash").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "hash")
    order = materialise(order.withColumn("row", F.monotonically_increasing_id()), "rows")
    return keyed.join(order.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("doc_id", "text", "row")


def _packed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """row and the compressed text of the rows that may be among ``rows``; of those that count as one, one is enough."""
    return packed_texts(docs, rows, "row").dropDuplicates(["row"])


def _stretches(found: DataFrame, texts: DataFrame, gram: int, least: int) -> DataFrame:
    """tile, row, start, bytes (compressed): what each row holds around the anchors of each tile.

    Long stretches are cut; the parts overlap, so that each window stands whole in one of them.
    """
    before = least - gram

    def run(batches):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(1).compress
        def made(out):
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["tile", "row", "start", "n", "packed"])

        for batch in batches:
            out, size = [], 0
            for row, places, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = unpack(text)
                pos, tile = places.values.field("pos").to_numpy(), places.values.field("tile").to_numpy()
                order = np.lexsort((pos, tile))
                pos, tile = pos[order].astype(np.int64), tile[order]
                start, end = np.maximum(pos - before, 0), np.minimum(pos + least, len(text))
                new = np.ones(len(pos), bool)
                new[1:] = (tile[1:] != tile[:-1]) | (start[1:] > end[:-1] - least + 1)
                cuts = np.flatnonzero(new)
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pos)], strict=True):
                    for s in range(int(start[a]), int(end[b - 1]) - least + 1, PIECE):
                        e = min(int(end[b - 1]), s + PIECE + least - 1)
                        out.append((int(tile[a]), row, s, e - s, pack(text[s:e])))
                        size += e - s
                        if size > SLAB:
                            yield made(out)
                            out, size = [], 0
            yield made(out)

    per = found.groupBy("row").agg(F.collect_list(F.struct("pos", "tile")).alias("places"))
    return per.join(texts, "row").select("row", "places", "packed").mapInArrow(released(run), "tile bigint, row bigint, start bigint, n bigint, packed binary")


def _marked(batch: list[tuple[int, int, bytes]], least: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the covered stretches of ``batch``: (row, start, bytes), from any tiles."""
    batch.sort(key=lambda x: x[:2])
    first: dict[bytes, tuple[int, int]] = {}
    kept = []
    for row, start, data in batch:
        at = first.setdefault(data, (row, start))
        if at == (row, start):
            kept.append((row, start, data))
        else:  # all of it stands earlier
            yield row, start, start + len(data)
    if len({k[:2] for k in kept}) < 2 and not any(len(k[2]) > least for k in kept):
        return
    text = np.frombuffer(b"".join(d + bytes([STOP]) for _, _, d in kept), np.uint8)
    sizes = np.array([len(d) for _, _, d in kept])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    rows, starts = np.array([r for r, _, _ in kept]), np.array([s for _, s, _ in kept], np.int64)
    _, rank = np.unique(rows, return_inverse=True)
    owner = np.repeat(np.arange(len(kept)), sizes + 1)
    within = np.arange(len(text)) - begin[owner]
    mark = RunIndex(text).earlier(rank[owner] << 40 | (starts[owner] + within), least)
    mark &= within + least <= sizes[owner]
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        k = owner[a]
        yield int(rows[k]), int(starts[k] + within[a]), int(starts[k] + within[b - 1] + least)


def _covered(stretches: DataFrame, least: int) -> DataFrame:
    """row, start, end of what stands earlier, as each tile sees it."""
    heavy = stretches.groupBy("tile").agg(F.sum("n").alias("total")).where(F.col("total") > TILE).select("tile", F.ceil(2 * F.col("total") / TILE).cast("int").alias("blocks"))
    heavy, own = materialise(heavy, "heavy"), ("tile", "row", "start", "packed")
    if heavy.limit(1).count():
        block = F.pmod(F.xxhash64("row", "start"), F.col("blocks")).cast("int")
        cell = lambda i, j: F.named_struct(F.lit("i"), i, F.lit("j"), j)
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: cell(F.least(block, j), F.greatest(block, j)))
        cells = F.when(F.col("blocks").isNull(), F.array(cell(F.lit(0), F.lit(0)))).otherwise(pairs)
        rows = stretches.join(heavy, "tile", "left").select(*own, F.explode(cells).alias("c")).select(*own, "c.i", "c.j")
    else:
        rows = stretches.select(*own, F.lit(0).alias("i"), F.lit(0).alias("j"))
    rows = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        at, held, size = None, [], 0

        def done():
            found = list(_marked(held, least))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["row", "start", "end"])

        for batch in batches:
            for *cell, row, start, data in zip(*[batch.column(c).to_pylist() for c in ("tile", "i", "j", "row", "start", "packed")], strict=True):
                if cell != at and size > BATCH:  # a cell is never cut; several may be indexed together
                    yield done()
                    held, size = [], 0
                at = cell
                held.append((row, start, unpack(data)))
                size += len(held[-1][2])
        yield done()

    return rows.mapInArrow(released(run), "row bigint, start bigint, end bigint")


def repeated_spans(docs: DataFrame, least: int = 100, gram: int = 32) -> DataFrame:
    """row, spans (maximal, ascending arrays of [start, end)) of the numbered rows that have any."""
    found = _anchors(docs, gram, least)
    tiles = materialise(found.groupBy("anchor").agg(F.min("row").alias("tile"), F.count("*").alias("n")).where("n > 1"), "tiles")
    # hot anchors, HOT at most, are told apart where their places are and dealt out by place; the others meet their tile by a join
    total = tiles.agg(F.sum("n")).first()[0] or 0
    hot = materialise(tiles.where(F.col("n") > max(total / HOT, HOT_LEAST)).select(F.col("anchor").alias("hot"), F.col("tile").alias("hot_tile")), "hot")
    told = found.join(F.broadcast(hot), F.col("anchor") == F.col("hot"), "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("anchor")).otherwise(-1 - F.abs(F.xxhash64("row", "pos") % (1 << 40))))
    rest = tiles.join(F.broadcast(hot), F.col("anchor") == F.col("hot"), "left_anti").select(F.col("anchor").alias("key"), "tile")
    tile = F.coalesce("hot_tile", "tile")
    repeated = materialise(told.join(rest, "key", "left").where(tile.isNotNull()).select("row", "pos", tile.alias("tile")), "anchors")
    texts = _packed(docs, repeated.select("row").distinct())
    stretches = materialise(_stretches(repeated, texts, gram, least), "stretches")
    spans = F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("end"))))
    return materialise(_covered(stretches, least).groupBy("row").agg(spans.alias("spans")), "spans")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def substring_dedup(docs: DataFrame, least: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes of every row."""
    numbered = _numbered(id_text(docs, id_col, text_col))
    spans = repeated_spans(numbered, least, gram)
    texts = _packed(numbered, spans.select("row"))

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row, found, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, found = unpack(data), _merged(found)
                digest, at = hashlib.sha256(), 0
                for a, b in found:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((row, sum(b - a for a, b in found), len(found), digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["row", "removed", "many", "sha"])

    cut = spans.join(texts, "row").select("row", "spans", "packed").mapInArrow(released(run), "row bigint, removed bigint, many bigint, sha string")
    whole = numbered.select("doc_id", "row", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return whole.join(cut, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("many", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")
    )


def oracle_sql(least: int = 100) -> str:
    """The same over the view ``documents``: every window of every text compared with all."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * (i + {least}) <= length(h) THEN substr(h, 2 * i + 1, {2 * least}) END AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
again AS (SELECT doc_id, i, b, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
cover AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS {least - 1} PRECEDING) AS gone FROM again),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM cover),
per AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (first) AS r, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS k FROM edge GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(r, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)"""
