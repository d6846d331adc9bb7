"""A trie of conversations from chained prefix digests: what conversations share from their start, and what that saves.

Each turn has a digest, and each prefix the digest of its predecessor's and the turn's; a node is a (depth, digest) with the
conversations whose prefixes have it. Chains run in blocks of ``BLOCK`` turns: inside a block the chain starts anew, and a
second chain runs over the blocks' ends, so a conversation of any length is hashed by many tasks.

Subtree sums: a node belongs to its smallest member, so the nodes of one member are a run of depths, from where no smaller
conversation shares its prefix down to its end. The sum of a run goes to every run above it, at the depth where the two
part; sums inside a run are taken from its end, in blocks. Each prefix of a conversation meets a run at most once, so these rows
are fewer than the turns, however long a conversation is; pairs of a node with each of its ancestors would grow with the
square of its depth.

Defined cases: rows with a null conv_id belong to no conversation and are left out; null turns come first; rows of one turn
stand in the order of their digests, and a repeated row is a turn of its own. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .conversations import BLOCK, BLOCK_BITS, blocked, by_group, digest, fold, offsets, turns, word_count

#: The first turns of a conversation whose id is a multiple of GROUP open the others of its group, HEAD - 1 of them at most.
GROUP, HEAD = 20, 4
#: Ends of a node are joined by ranges of two to the power of so many ids.
RANGE_BITS = 12
#: Nodes that hold more than a SHARE-th of all prefixes are at most SHARE; rows of them meet their owner by broadcast.
SHARE = 1000
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def positions(table: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), total, turn_digest and words of every turn; positions are counted in blocks of turn numbers."""
    rows = blocked(turns(table).where("conv_id is not null"))
    counted = rows.select("conv_id", "turn", "block", digest().alias("turn_digest"), word_count().alias("words"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "turn_digest")) - 1
    at = offsets(rows.select("conv_id", "block"))
    numbered = counted.withColumn("inside", inside).join(at, ["conv_id", "block"])
    return numbered.select("conv_id", (F.col("inside") + F.col("before")).alias("pos"), "total", "turn_digest", "words")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of the rebuilt conversations, and all conversations with their lengths.

    A conversation opens with the first turns of its group's first one and goes on with its own; both are told by a small
    table of conversations, so a turn is sent on to the conversations that it stands in without a join of turns.
    """
    sizes = placed.groupBy("conv_id").agg(F.max("total").alias("own"))
    sizes = sizes.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP)), "head": fold(F.col("conv_id"), HEAD)})
    first = sizes.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("own").alias("first"))
    convs = sizes.join(first, "base", "left").withColumn("opens", F.least("head", F.coalesce("first", F.lit(0))))
    convs = convs.select("conv_id", "base", "head", "opens", (F.col("opens") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    own = placed.join(convs, "conv_id").where("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("opens")).alias("pos"), "length", "turn_digest", "words")
    heads = placed.where((F.col("pos") < HEAD - 1) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).withColumnRenamed("conv_id", "base")
    opened = heads.join(convs, "base").where("pos < head").select("conv_id", "pos", "length", "turn_digest", "words")
    return own.unionByName(opened), convs.select("conv_id", "length")


def _chain(rows):
    """(conv_id, part, pos, length, words, turn_digest) in order -> the chain inside each part; parts begin anew."""
    at, last = None, b""
    for conv, part, pos, length, words, value in rows:
        if at != (conv, part):
            at, last = (conv, part), b""
        above, last = last, hashlib.sha256(last + value).digest()
        yield conv, part, pos, length, words, above, last


def _chain_ends(rows):
    """(conv_id, part, digest of the whole part) in order -> the chain that the next part begins with."""
    at, last = None, b""
    for conv, part, value in rows:
        if at != conv:
            at, last = conv, b""
        last = hashlib.sha256(last + value).digest() if part else value
        yield conv, part + 1, last


def prefixes(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: conv_id, depth, node and above (digests), words of the last turn, ends."""
    parts = sequences.withColumn("part", F.shiftright("pos", BLOCK_BITS)).select("conv_id", "part", "pos", "length", "words", "turn_digest")
    schema = "conv_id bigint, part bigint, pos bigint, length bigint, words bigint, above binary, chain binary"
    chained = parts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(by_group(_chain, schema, parts.columns), schema)
    chained = materialise(chained, "trie-chains")
    whole = chained.where(F.pmod("pos", F.lit(BLOCK)) == BLOCK - 1).select("conv_id", "part", "chain")
    starts = whole.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(by_group(_chain_ends, "conv_id bigint, part bigint, start binary", whole.columns), "conv_id bigint, part bigint, start binary")
    later = chained.where("part > 0").join(starts, ["conv_id", "part"])
    joined = lambda c: F.unhex(F.sha2(F.concat("start", c), 256))
    later = later.withColumns({"above": F.when(F.pmod("pos", F.lit(BLOCK)) == 0, F.col("start")).otherwise(joined("above")), "chain": joined("chain")})
    deep = chained.where("part = 0").unionByName(later.drop("start"))
    deep = deep.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("chain").alias("node"), "above", "words", (F.col("pos") + 1 == F.col("length")).alias("ends"))
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("node"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("bigint").alias("words"), (F.col("length") == 0).alias("ends"))
    return deep.unionByName(root)


def _ends_hash(rows):
    """(depth, node, range, ids as text) in order -> the hash of a node's ids, which stream through it."""
    at, h = None, None
    for depth, node, _, ids in rows:
        if at != (depth, node):
            if at is not None:
                yield *at, h.hexdigest()
            at, h = (depth, node), hashlib.sha256(ids.encode())
        else:
            h.update(b"," + ids.encode())
    if at is not None:
        yield *at, h.hexdigest()


def end_hashes(rows: DataFrame) -> DataFrame:
    """depth, node and ends_sha256 of the nodes where conversations end: ids are joined by ranges, then streamed in order."""
    pieces = rows.where("ends").groupBy("depth", "node", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    schema = "depth bigint, node binary, ends_sha256 string"
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "range").mapInArrow(by_group(_ends_hash, schema, pieces.columns), schema)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes of all prefixes: depth, node, above, conv_id (the owner), n_convs, words, n_children, n_leaves and value of their own."""
    nodes = rows.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("above").alias("above"))
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("words")})


def owned(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with column owner, the smallest member of their node. Nodes with many rows are few, and come by broadcast."""
    many = max(1, nodes.agg(F.sum("n_convs")).first()[0] or 0) // SHARE
    keys = ["depth", "node"]
    owner = nodes.select(*keys, F.col("conv_id").alias("owner"), "n_convs")
    hot = F.broadcast(owner.where(F.col("n_convs") > many).drop("n_convs"))
    met = rows.join(hot, keys, "left")
    return met.where("owner is not null").unionByName(met.where("owner is null").drop("owner").join(owner.where(F.col("n_convs") <= many).drop("n_convs"), keys))


def partings(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each conversation and each run above its own: the depth of the last node of that run on its path."""
    met = owned(rows.select("conv_id", "depth", "node"), nodes)
    return met.groupBy("conv_id", "owner").agg(F.max("depth").alias("depth")).where("conv_id <> owner")


def below_parting(parting: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node where runs part from its owner's run: depth, conv_id (the owner), and the sums of all that lies in those runs."""
    runs = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    joined = parting.join(runs, "conv_id")
    return joined.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("leaf").alias("leaf_below"), F.sum("saved").alias("saved_below"))


def conversation_trie(table: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with the columns of ``COLUMNS``."""
    placed = materialise(positions(table), "trie-positions")
    sequences, convs = rebuilt(placed)
    rows = materialise(prefixes(sequences, materialise(convs, "trie-convs")), "trie-prefixes")
    nodes = materialise(nodes_of(rows), "trie-values")
    parting = materialise(partings(rows, nodes), "trie-partings")
    below = below_parting(parting, nodes)
    sums = nodes.join(below, ["conv_id", "depth"], "left").withColumn("part", F.shiftright("depth", BLOCK_BITS))
    sums = sums.withColumns({"leaf": F.col("leaf") + F.coalesce("leaf_below", F.lit(0)), "saved": F.col("saved") + F.coalesce("saved_below", F.lit(0))})
    sums = materialise(sums.select("depth", "node", "above", "conv_id", "n_convs", "n_children", "leaf", "saved", "part"), "trie-sums")
    onward = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("conv_id", "part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    blocks = blocks.select("conv_id", "part", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("leaf", "saved")))
    total = sums.withColumns({"n_leaves": F.sum("leaf").over(onward), "saved_tokens": F.sum("saved").over(onward)}).join(blocks, ["conv_id", "part"])
    total = total.withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf_later"), "saved_tokens": F.col("saved_tokens") + F.col("saved_later")})
    # the parent of a run's first node is where it parts from the run above; all others follow a node of their own run
    above = parting.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    total = total.join(above, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")))
    hashes = end_hashes(rows)
    none = hashlib.sha256(b"").hexdigest()
    out = total.join(hashes, ["depth", "node"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    return out.select(*COLUMNS)



def oracle_sql() -> str:
    """The same nodes, chain by chain, each with all its descendants."""
    return r"""
WITH RECURSIVE crct AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crct WHERE k < 8),
ids AS (SELECT DISTINCT conv_id::BIGINT AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, c::VARCHAR AS s, 1 AS p, 4294967295::BIGINT AS r FROM ids
  UNION ALL SELECT crc.c, s, p + 1, xor(r >> 8, t.c) FROM crc JOIN crct t ON t.k = 8 AND t.i = xor(r & 255, ord(substr(s, p, 1))::BIGINT) WHERE p <= length(s)),
head AS (SELECT c, xor(r, 4294967295) % 4 AS h FROM crc WHERE p = length(s) + 1),
named AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
orig AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS pos FROM named),
built AS (SELECT e.c, 0 AS part, pos, role, text FROM head e JOIN orig o ON o.c = e.c - ((e.c % 20) + 20) % 20 AND pos < h
  UNION ALL SELECT e.c, 1, pos, role, text FROM head e JOIN orig o ON o.c = e.c AND pos >= h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM built),
chain AS (SELECT c, 0::BIGINT AS d, '' AS n, 0::BIGINT AS words FROM ids
  UNION ALL SELECT t.c, t.d, sha256(n || length(role) || ':' || role || text), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT FROM chain JOIN turns t ON t.c = chain.c AND t.d = chain.d + 1),
nodes AS (SELECT d, n, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM chain GROUP BY d, n),
parents AS (SELECT w.d, w.n, p.conv_id AS parent_conv_id, p.d AS pd, p.n AS pn FROM nodes w JOIN chain a ON a.c = w.conv_id AND a.d = w.d - 1 JOIN nodes p ON p.d = a.d AND p.n = a.n),
kids AS (SELECT pd AS d, pn AS n, count(*) AS n_children FROM parents GROUP BY ALL),
own AS (SELECT d, n, conv_id, n_convs, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN kids USING (d, n)),
sums AS (SELECT a.d, a.n, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM own w JOIN chain a ON a.c = w.conv_id AND a.d <= w.d GROUP BY a.d, a.n),
ends AS (SELECT d, n, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM (SELECT c, d, n FROM chain QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY d, n)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM own JOIN sums USING (d, n) LEFT JOIN parents USING (d, n) LEFT JOIN ends USING (d, n)"""
