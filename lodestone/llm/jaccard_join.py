"""Exact Jaccard self-join of the texts' word shingles, and the classes that its links make.

1. Texts with one set of shingles are one class (a 128-bit digest); only classes are compared.
2. Prefix filter: two sets that link share one of their first few shingles in any order that all keep to. The order
   puts shingles of many texts last, so the keys that classes meet at are rare ones. Which are frequent is counted over
   all texts, each batch summed up before the shuffle; it only decides the order, never what links.
3. A key goes with a band of sizes; a small set also goes to the next band if a linked set can lie there. The classes that
   share one meet in the tile of the least of them, so a group of copies that shares a hundred keys meets in a few tiles.
   Tiles of too many shingles are cut into pairs of blocks; none is dropped.
4. In a tile, by size: bitmaps of hashed shingles (a bit is the parity of what falls on it) bound the overlap of two sets
   from above by their count of differing bits. Classes that pass with none are done.
5. The rest meet again, by the least class that they pass with, now with their texts: pairs that pass are intersected
   exactly. Pairs that links have already joined are skipped, so a tile of n classes gives n - 1 links at most.
6. The links' connected components.

Words are runs of other than space and \\t to \\r, A-Z lower-cased. A shingle is a 64-bit hash of its words, and sets are
intersected by those hashes; classes are told by 128 bits. Defined cases: ids are longs or null; a text without words, or null, has no shingles and is linked with nothing; fewer words than a shingle takes are one shingle;
rows with repeated ids each get a result, of their own text; null ids have a null component unless their class has an id,
and only such classes are linked with others. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, id_text, materialise, mix64, packed_texts, released, text_chunks, without
from .components import connected_components
from .shingles import buffers, shingles, words

#: Bits of the signatures, and the sizes from which sets have the next wider one: enough to tell unlike sets apart.
WIDTHS, WIDE_FROM = (512, 1024, 2048, 4096, 32768), (800, 1800, 3600, 7200)
#: Levels of the signatures that are sent.
SENT = 4
#: Shingles and sets that a tile may hold before it is cut: the first bound memory, the others time.
TILE, TILE_SETS = 4_000_000, 500
#: A class that has more than one in so many of all rows (and more than HOT_LEAST) is hot.
HOT, HOT_LEAST = 2000, 1000
#: Bits of the bitmap of shared keys at most.
KEY_BITS = 1 << 27
#: How much larger the sizes of the next band are.
BAND = 1.5
#: A shingle counts as frequent from this share of all texts on; it is reported from so many times among COUNTED shingles.
FREQUENT, REPORT, COUNTED = 0.001, 8, 5_000_000


def _sets(part: pa.RecordBatch, k: int) -> tuple[list, list[np.ndarray]]:
    """Ids, and each row's different shingles in ascending order."""
    data, offsets = buffers(part.column(1))
    hashes, _, _, rows = words(data, offsets)
    found, at = shingles(hashes, rows, k)
    return part.column(0).to_pylist(), [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix64(s + np.uint64(0x632BE59BD9B4E019))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int((b * (a | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64))


def frequent_shingles(docs: DataFrame, k: int, n_docs: int, share: float = FREQUENT) -> np.ndarray:
    """Shingles of at least ``share`` of all texts, sorted; there are 1 / share times a text's mean size at most."""

    def run(batches):
        held, size, n = [], 0, 0

        def counted():
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            every.sort()
            least = int(np.ceil(max(REPORT, share * n / 2)))
            ends = every[least - 1 :]  # of runs that are long enough; there are few of them, so that little beside ``every`` is held
            often = np.unique(ends[ends == every[: len(ends)]])
            counts = np.searchsorted(every, often, "right") - np.searchsorted(every, often)
            return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

        for batch in batches:
            for part in text_chunks(batch):
                sets = _sets(part, k)[1]
                held += sets
                n, size = n + len(sets), size + sum(map(len, sets))
                if size >= COUNTED:
                    yield counted()
                    size, n = 0, 0
        yield counted()

    met = docs.mapInArrow(released(run), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n_docs).select("shingle")
    return np.sort(np.array([r[0] for r in met.toLocalIterator()], np.int64).view(np.uint64))


def _least_overlap(n, percent: int):
    return -(-percent * n // 100)


def _banded(keys: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Keys with the band of a set's size, and with the next one if a larger set that links can lie there."""
    band = lambda size: int(np.log(size) / np.log(BAND))
    bands = sorted({band(n), band(n * 100 / percent + 1e-6)})
    return np.concatenate([mix64(keys + mix64(np.full(1, b + 1, np.uint64))) for b in range(bands[0], bands[-1] + 1)])


def _profiles(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, key_bits: int) -> DataFrame:
    """doc_id, set size, digest (hi, lo) and the keys that a linked set must share one of."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often = shared.value
        for batch in batches:
            for part in text_chunks(batch):
                ids, sets = _sets(part, k)
                keys, digests, signs = [], [], []
                for s in sets:
                    signs.append(signature(s, SENT) if len(s) else None)
                    digests.append(_digest(s) if len(s) else (None, None))
                    take = len(s) - _least_overlap(len(s), percent) + 1 if len(s) else 0
                    if len(often) and take:
                        last = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                        s = np.concatenate([s[~last], s[last]])
                    keys.append((_banded(s[:take], len(s), percent) >> np.uint64(64 - key_bits)).view(np.int64) if take else np.zeros(0, np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), sizes, pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), flat, pa.array(signs, pa.binary())], names=["doc_id", "n", "hi", "lo", "keys", "sign"]
                )

    return docs.mapInArrow(released(run), "doc_id bigint, n bigint, hi bigint, lo bigint, keys array<bigint>, sign binary")


def signature(s: np.ndarray, levels: int = len(WIDTHS)) -> bytes:
    """A bitmap as wide as the set's size asks for; a bit says whether an odd number of shingles falls on it.

    What is sent to every tile has SENT levels; where the sets themselves are, the widest costs nothing more.
    """
    bits = WIDTHS[min(int(np.searchsorted(WIDE_FROM, len(s), side="right")), levels - 1)]
    odd = np.bincount((mix64(s) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Near:
    """Sets of one tile, which come by ascending size, and which of them a new one can link with."""

    def __init__(self, percent: int):
        self.percent, self.first, self.n = percent, 0, 0
        self.sizes = np.zeros(16, np.int64)
        # of each width the bitmaps of the sets that have it, and the first such set
        self.bitmaps = [np.zeros((16, w // 64), np.uint64) if not k else np.zeros((0, w // 64), np.uint64) for k, w in enumerate(WIDTHS)]
        self.since = [0, *[None] * (len(WIDTHS) - 1)]

    def _bounded(self, rows: np.ndarray, size: int, differing: np.ndarray) -> np.ndarray:
        """The rows whose overlap, bounded from above by the count of differing bits, can be enough."""
        total = self.sizes[rows] + size
        return rows[(100 + self.percent) * ((total - differing) // 2) >= self.percent * total]

    def add(self, size: int, bitmap: bytes) -> np.ndarray:
        """Takes a set in and returns the numbers of those before it that pass."""
        i = self.n
        if i == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.first < i and 100 * self.sizes[self.first] < self.percent * size:
            self.first += 1  # too small for all that follow
        own, rows = np.frombuffer(bitmap, np.uint64), np.arange(self.first, i)
        for level, width in enumerate(WIDTHS):
            if len(own) * 64 < width:
                break
            if self.since[level] is None:
                self.since[level] = i
            since, bits = self.since[level], np.bitwise_xor.reduce(own.reshape(-1, width // 64), axis=0)  # parities of parts add up
            if i - since >= len(self.bitmaps[level]):
                more = np.zeros((max(16, len(self.bitmaps[level])), width // 64), np.uint64)
                self.bitmaps[level] = np.concatenate([self.bitmaps[level], more])
            wide = rows[rows >= since]
            differing = np.bitwise_count(self.bitmaps[level][wide - since] ^ bits).sum(axis=1, dtype=np.int64)
            rows = np.concatenate([rows[rows < since], self._bounded(wide, size, differing)])
            self.bitmaps[level][i - since] = bits
        self.sizes[i], self.n = size, i + 1
        return rows


class Tile:
    """Links the sets of one tile, which come by ascending size."""

    def __init__(self, percent: int):
        self.near, self.percent, self.freed = Near(percent), percent, 0
        self.ids, self.sets, self.parent = [], [], []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, doc_id: int, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """Yields the links that join what was apart."""
        i, size = len(self.ids), len(s)
        passing = self.near.add(size, signature(s))
        self.ids.append(doc_id), self.sets.append(s), self.parent.append(i)
        while self.freed < self.near.first:
            self.sets[self.freed] = None
            self.freed += 1
        # latest first: the sets of nearest size; a pair that is joined already adds nothing
        for j in passing[::-1].tolist():
            if self.root(j) != self.root(i):
                both = len(np.intersect1d(self.sets[j], s, assume_unique=True))
                if 100 * both >= self.percent * (size + len(self.sets[j]) - both):
                    self.parent[self.root(j)] = self.root(i)
                    yield self.ids[j], doc_id


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (tile, rep, n, more) with the cell (band, i, j) of the tile that each is compared in.

    A tile of up to TILE shingles and TILE_SETS sets is one cell. A larger one is cut by size, as wide as linked sets can differ, a set going
    to its own band and as a smaller partner to the next, and each band into pairs of blocks.
    """
    blocks = F.ceil(F.greatest(F.sum("n") / TILE, F.count("*") / TILE_SETS)).cast("int")
    heavy = members.groupBy("tile").agg(blocks.alias("blocks")).where("blocks > 1")
    heavy, own = materialise(heavy, "heavy"), members.columns
    if not heavy.limit(1).count():
        rows = members.select(*own, F.lit(0).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        return rows.repartition("tile", "band", "i", "j").sortWithinPartitions("tile", "band", "i", "j", "n", "rep")
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cell = lambda b, i, j: F.named_struct(F.lit("band"), b, F.lit("i"), i, F.lit("j"), j)
    pairs = lambda b: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: cell(b, F.least(block, j), F.greatest(block, j)))
    cells = F.when(F.col("blocks").isNull(), F.array(cell(F.lit(0), F.lit(0), F.lit(0)))).otherwise(F.concat(pairs(band), pairs(band + 1)))
    rows = members.join(heavy, "tile", "left").select(*own, F.explode(cells).alias("c")).select(*own, "c.band", "c.i", "c.j")
    return rows.repartition("tile", "band", "i", "j").sortWithinPartitions("tile", "band", "i", "j", "n", "rep")


def _cells(batches, *columns: str) -> Iterator[tuple[list, list[tuple] | None]]:
    """Each row with its cell, in order; a last one without a cell."""
    for batch in batches:
        yield from zip(zip(*[batch.column(c).to_pylist() for c in ("tile", "band", "i", "j")], strict=True), zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True)
    yield None, None


def _kept_keys(profiles: DataFrame, leaders: DataFrame) -> DataFrame:
    """key and hi of the keys that may be among the leaders': a bitmap of bounded size leaves most others out.

    Where there are too many keys for it, it only lets more rows go to the join that follows.
    """
    bits, slots = bitmap(leaders, "key", KEY_BITS, hashed=True)
    shared = profiles.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            slot = keys % slots
            met = (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[met]), batch.column(0).take(pa.array(owner[met]))], names=["key", "hi"])

    return profiles.where("hi is not null").select("hi", "keys").mapInArrow(released(run), "key bigint, hi bigint")


def _passing(profiles: DataFrame, reps: DataFrame, percent: int, class_bits: int) -> DataFrame:
    """tile, rep, n of the classes that pass with some other one; the tile is the least class that they pass with."""
    short = F.shiftrightunsigned("hi", 64 - class_bits)  # two classes of one short name only meet more often
    keyed = profiles.where("hi is not null").select(F.explode("keys").alias("key"), "hi")
    leaders = keyed.groupBy("key").agg(F.min("hi").alias("hi"), F.max("hi").alias("last")).where("hi <> last").select("key", short.alias("tile"))
    leaders = materialise(leaders, "leaders")
    member = _kept_keys(profiles, leaders).select("key", short.alias("class")).join(leaders, "key").select("class", "tile").distinct().join(reps.withColumn("class", short), "class").select("tile", "rep", "n", "sign")

    def run(batches):
        at, near, members, parent, out = None, Near(percent), [], [], []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for cell, row in _cells(batches, "rep", "n", "sign"):
            if cell != at:
                least: dict[int, int] = {}
                for i, (rep, _) in enumerate(members):
                    least[root(i)] = min(rep, least.get(root(i), rep))
                many = Counter(map(root, range(len(members))))
                out += [(least[root(i)], rep, n) for i, (rep, n) in enumerate(members) if many[root(i)] > 1]
                at, near, members, parent = cell, Near(percent), [], []
            if len(out) > 50_000 or (row is None and out):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["tile", "rep", "n"])
                out = []
            if row is not None:
                i = len(members)
                members.append(row[:2]), parent.append(i)
                for j in near.add(row[1], row[2]).tolist():
                    parent[root(j)] = root(i)

    return _placed(materialise(member, "members"), percent).mapInArrow(released(run), "tile bigint, rep bigint, n bigint").distinct()


def _links(docs: DataFrame, members: DataFrame, named: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b for classes whose sets link within a tile; ``named`` has the least id and the digest of each class."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        at, tile, links = None, Tile(percent), []
        for cell, row in _cells(batches, "rep", "packed", "hi", "lo"):
            if row is None or len(links) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
                links = []
            if row is not None:
                if cell != at:
                    at, tile = cell, Tile(percent)
                _, (found,) = _sets(pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([unpack(row[1])], pa.binary())], names=["rep", "text"]), k)
                if _digest(found) == row[2:]:  # else another text of that id
                    links += tile.add(row[0], found)

    tiles = members.groupBy("rep").agg(F.max("n").alias("n"), F.collect_set("tile").alias("tiles")).join(named, "rep")
    texts = packed_texts(docs, named.select(F.col("least").alias("doc_id")), "doc_id").join(tiles, F.col("doc_id") == F.col("least"))
    return _placed(materialise(texts.select(F.explode("tiles").alias("tile"), "rep", "n", "packed", "hi", "lo"), "texts"), percent).mapInArrow(released(run), "a bigint, b bigint")


def jaccard_join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets link where 100 * intersection >= percent * union."""
    plain = id_text(docs, id_col, text_col)
    n_docs = max(plain.count(), 1)
    # as many bits as keep chance meetings of a row rare, by all of its keys; what meets by chance is told apart later
    key_bits, class_bits = min(63, n_docs.bit_length() + 20), min(63, n_docs.bit_length() + 12)
    profiles = materialise(_profiles(plain, k, percent, frequent_shingles(plain, k, n_docs), key_bits), "profiles")
    classes = profiles.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("sign").alias("sign"), F.count("*").alias("copies"))
    # a number for each class: an id can stand on rows of different classes
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    members = materialise(_passing(profiles, classes.where("least is not null").select("hi", "rep", "n", "sign"), percent, class_bits), "passing")
    named = members.select("rep").distinct().join(classes.select("rep", "least", "hi", "lo"), "rep")
    components = materialise(connected_components(_links(plain, members, named, k, percent)), "components")
    linked = classes.join(components, classes["rep"] == components["node"]).select("hi", "lo", "least", F.col("component").alias("of"))
    linked = linked.join(linked.groupBy("of").agg(F.min("least").alias("component")), "of").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "component")
    merged = classes.join(linked, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left").select("hi", "lo", "copies", F.coalesce("component", "least").alias("component"))
    out = _with_component(profiles, materialise(merged, "merged"), n_docs)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _with_component(profiles: DataFrame, merged: DataFrame, n_docs: int) -> DataFrame:
    """Rows with the component of their class. The rows of very large classes, HOT at most, and those without words are told
    apart where they are and dealt out by id; the others meet their class by a join.
    """
    hot = materialise(merged.where(F.col("copies") > max(n_docs / HOT, HOT_LEAST)).select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("component").alias("_hot")), "hot")
    told = profiles.select("doc_id", "n", "hi", "lo").join(F.broadcast(hot), (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
    apart = F.col("hi").isNull() | F.col("_hi").isNotNull()
    told = told.select("doc_id", "n", "hi", "_hot", F.when(apart, F.xxhash64("doc_id", "n")).otherwise(F.col("hi")).alias("k"), F.when(~apart, F.col("lo")).alias("l"))
    rest = merged.select(F.col("hi").alias("k"), F.col("lo").alias("l"), F.col("component").alias("met"))
    return told.join(rest, ["k", "l"], "left").select("doc_id", "n", "hi", F.coalesce("_hot", "met").alias("component"))


def drop_near_copies(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs``, with all columns, that are the least id of their component.

    Of rows with one id and one text, one stays; rows with a null id stay, and so do rows without words. An id that stands
    on several texts goes only where all of them have a lower id in their components. ``docs`` has the columns doc_id and
    text; others, of whatever names, stay as they are.
    """
    joined = materialise(jaccard_join(docs, k, percent), "near-copies")
    gone = joined.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("component_id") < F.col("doc_id")).alias("all")).where("all").select("doc_id")
    twice = joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = without(docs, gone, "doc_id")
    if not twice.limit(1).count():
        return kept
    return without(kept, twice, "doc_id").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def oracle_sql(percent: int = 90) -> str:
    """The same over the view ``documents`` for shingles of three words: all pairs that share one are counted."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id"""
