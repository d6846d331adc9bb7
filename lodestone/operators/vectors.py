"""Vectors: hashed n-gram embeddings as sparse rows, cosine, nearest rows of a query."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters that are counted at a time, and grams whose buckets a task remembers.
ECHO_BLOCK, ECHO_KNOWN = 1 << 20, 1 << 17


def echo_rows(rows: DataFrame, text_col: str, out: str, dim: int = 256, unit: bool = True) -> DataFrame:
    """``rows`` with ``out`` in place of a text: an array of ``dim`` sums of its hashed runs of 2, 3 and 4 characters (1), words (2)
    and pairs of words (3), as floats of unit norm or (not ``unit``) as doubles. Rows stay where they are: nothing is shuffled.
    """
    low = rows.withColumn(text_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    kept = [f for f in low.schema.fields if f.name != text_col]
    kind = T.ArrayType(T.FloatType() if unit else T.DoubleType())
    return low.select(*[f.name for f in kept], text_col).mapInArrow(_echo(dim, unit, out), T.StructType([*kept, T.StructField(out, kind)]))


def _echo(dim: int, unit: bool, out: str):
    """A function of Arrow batches whose last column is a text in lower case."""

    def run(batches):
        from hashlib import md5

        known: dict[str, int] = {}

        def bucket(gram: str) -> int:
            got = known.get(gram)
            if got is None:
                if len(known) >= ECHO_KNOWN:
                    known.clear()
                got = known[gram] = int.from_bytes(md5(gram.encode()).digest()[:8], "big") % dim
            return got

        for batch in batches:
            sums, some, size = np.zeros((batch.num_rows, dim)), [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                _add_words(sums[i], text, bucket)
                for start in range(0, len(text), ECHO_BLOCK):
                    some.append((i, text[start : start + ECHO_BLOCK + 3]))
                    size += len(some[-1][1])
                    if size >= ECHO_BLOCK:
                        _add_grams(sums, some, bucket, dim)
                        some, size = [], 0
            _add_grams(sums, some, bucket, dim)
            if unit:
                norm = np.sqrt((sums * sums).sum(1, keepdims=True))
                sums = (sums / np.where(norm == 0, 1.0, norm)).astype(np.float32)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=[*batch.schema.names[:-1], out])

    return run


def _add_words(sums: np.ndarray, text: str, bucket) -> None:
    before = None
    for m in re.finditer("[a-z0-9]+", text):
        word = m.group()
        sums[bucket("w:" + word)] += 2
        if before is not None:
            sums[bucket(f"b:{before} {word}")] += 3
        before = word


def _add_grams(sums: np.ndarray, pieces: list[tuple[int, str]], bucket, dim: int) -> None:
    """Adds the runs of pieces (row, text) that begin in a piece's first ECHO_BLOCK characters; each different one is hashed once."""
    text = "".join(p for _, p in pieces)
    lengths = [len(p) for _, p in pieces]
    if not text:
        return
    row = np.repeat(np.array([i for i, _ in pieces], np.int64), lengths)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    first = np.arange(len(text)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths) < ECHO_BLOCK
    one, letters = pd.factorize(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    one = one.astype(np.int64)
    two, pairs = pd.factorize(one[:-1] * len(letters) + one[1:])
    two = two.astype(np.int64)
    for n, code in ((2, two), (3, two[:-1] * len(letters) + one[2:]), (4, two[:-2] * len(pairs) + two[2:])):
        at = np.flatnonzero(first[: len(code)] & (piece[: len(code)] == piece[n - 1 :]))
        if len(at):
            which, different = pd.factorize(code[at])
            place = np.empty(len(different), np.int64)
            place[which[::-1]] = at[::-1]
            buckets = np.array([bucket(text[p : p + n]) for p in place.tolist()], np.int64)
            low, high = row[at[0]], row[at[-1]] + 1
            sums[low:high] += np.bincount((row[at] - low) * dim + buckets[which], minlength=(high - low) * dim).reshape(-1, dim)


def echo_weights(docs: DataFrame, dim: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, bucket, weight: the hashed n-grams of ``echo_rows`` as rows, unit norm; rows of one id add up."""
    counts = echo_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "sums", dim, unit=False)
    sums = counts.select("id", F.posexplode("sums").alias("bucket", "w")).where("w > 0").groupBy("id", "bucket").agg(F.sum("w").alias("w"))
    norms = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, "id").select("id", "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_cosine(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, id, sim of unit sparse rows (query_id or id, bucket, weight); pairs without a common bucket are left out."""
    q = queries.select("query_id", "bucket", F.col("weight").alias("qw"))
    return q.join(rows, "bucket").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("sim"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double; a vector of norm 0 counts as of norm 1, other dimensions give 0."""
    norm = lambda v: F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def nearest(rows: DataFrame, query: list[float], k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, sim of the k rows most like one query vector; what points away counts as 0. All rows are scored, each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col).alias("id"), F.greatest(cosine(F.col(vector_col), q), F.lit(0.0)).alias("sim"))
    return scored.orderBy(F.desc("sim"), "id").limit(k)


#: Rows and queries that one task holds at a time; similarities that it holds; digits of a similarity that decide an order.
ROW_BLOCK, QUERY_BLOCK, SIMS, DIGITS = 16384, 1024, 1 << 20, 9


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    """Lists of one dimension as rows of norm 1, in double; a vector of norm 0 stays as it is."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``sims`` the columns of its k greatest, as two arrays (row, column); ties: the first columns."""
    shown = np.round(sims, DIGITS)
    if shown.shape[1] > k:
        least = -np.partition(-shown, k - 1, axis=1)[:, k - 1 : k]
        more, same = shown > least, shown == least
        left = k - more.sum(1, keepdims=True)
        return np.nonzero(more | (same & (np.cumsum(same, axis=1) <= left)))
    return np.nonzero(np.ones_like(shown, bool))


def _compare(k: int):
    """A function of a block of rows (id, v) and one of queries (query_id, q) to the k rows of each query; a task holds SIMS similarities at a time."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["id", "v"]).combine_chunks().sort_by("id").combine_chunks()
        right = right.select(["query_id", "q"]).combine_chunks()
        plain = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
        ids, vectors, names, wanted = (plain(c) for c in (left["id"], left["v"], right["query_id"], right["q"]))
        row_dims, query_dims = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (vectors, wanted))
        who, what, sim = [], [], []
        for dim in np.unique(query_dims) if len(vectors) else ():
            at, same = np.flatnonzero(query_dims == dim), np.flatnonzero(row_dims == dim)
            asked_for, held = (_unit(x.take(pa.array(i)), dim) for x, i in ((wanted, at), (vectors, same)))
            step = max(1, SIMS // len(vectors))
            for start in range(0, len(at), step):
                part = at[start : start + step]
                sims = np.zeros((len(part), len(vectors)))
                sims[:, same] = np.maximum(asked_for[start : start + step] @ held.T, 0.0)
                row, column = _best(sims, k)
                who, what, sim = [*who, part[row]], [*what, column], [*sim, sims[row, column]]
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query_id": names.take(pa.array(join(who, np.int64))), "id": ids.take(pa.array(join(what, np.int64))), "sim": pa.array(join(sim, np.float64))})

    return run


def nearest_each(rows: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "chunk_id", vector_col: str = "embedding", query_vector: str = "vector", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, sim, place of the k rows most like each of any number of query vectors (query_id, ``query_vector``).

    Rows and queries are dealt out into blocks by hashes; a task gets one block of each, compares them as matrices and keeps k
    rows for each query. These lists, not pairs, are shuffled and merged once. Neither side is broadcast or collected. What
    points away, or has another dimension, counts as 0; similarities equal to nine digits are ordered by id. Rows without
    an id or a vector are left out.
    """
    some = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(F.col("query_id").isNotNull() & F.col(query_vector).isNotNull()).select("query_id", F.col(query_vector).alias("q"))
    n_rows, n_queries = (max(1, -(-df.count() // size)) for df, size in ((some, row_block), (asked, query_block)))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = some.withColumns({"rb": F.pmod(F.xxhash64("id", "v"), F.lit(n_rows)).cast("int"), "qb": number(n_queries)})
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id", "q"), F.lit(n_queries)).cast("int")).withColumn("rb", number(n_rows))
    kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((some, "id"), (asked, "query_id"))}

    lists = some.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(_compare(k), f"query_id {kinds['query_id']}, id {kinds['id']}, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", DIGITS)), "id")
    return lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
