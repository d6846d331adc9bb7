"""Cross-entropy difference: how much better a model of target texts tells a document's words than one of all texts.

Both models are bigram models of the same kind over all words of the corpus: Witten-Bell, down to add-one counts of single
words. Counts are over all texts (background) and all target texts; the background's counts are scaled to the target's
total, so that both are smoothed alike.

``corpus_scores`` keeps counts of every word and every pair of words. Texts are cut into chunks of about 2 million words,
kept in the shared folder. Each chunk asks for the counts of its different pairs, dealt out by hash, and gets the sums over
the corpus back (``_counted``); then the same for its words. The first chunk that asks for a pair counts it as a kind of
what follows its first word. Words and pairs are told by 64-bit hashes. No table goes to the driver or to all tasks but a
bitmap of target ids and those other ids that it can't tell from them.

``train_models`` and ``lm_score`` are the same models over the ``vocabulary`` commonest words and classes of other words, by
a hash of their length and last byte, in memory.

Words are runs of other than space and \\t to \\r, A-Z lower-cased. Defined cases: a text without words, or null, has no
tokens and losses of 0; without target texts both models are the background's and all scores are 0. Repeated rows count
and are scored each; target ids that are repeated or null count once or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _met, bitmap, id_text, materialise, mix64, packed_texts, released, text_chunks
from .shingles import buffers, words

#: A chunk is cut at so many words or rows.
CHUNK_WORDS, CHUNK_ROWS = 1 << 21, 1 << 16
SCHEMA = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


@dataclass
class Models:
    """Sorted hashes of the vocabulary, and both models' log probabilities by previous and next token."""

    known: np.ndarray
    target: np.ndarray
    background: np.ndarray


def _pass_words(docs: DataFrame) -> DataFrame:
    """word (a hash) and its count over all texts."""

    def run(batches):
        for batch in batches:
            hashes = [words(*buffers(part.column(1)))[0] for part in text_chunks(batch)]
            values, counts = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return docs.mapInArrow(released(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def token_ids(texts: pa.Array, known: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Token of each word and where each row's words start (and end)."""
    data, offsets = buffers(texts)
    hashes, starts, ends, rows = words(data, offsets)
    if not len(hashes):
        return np.zeros(0, np.int64), rows
    slot = np.searchsorted(known, hashes)
    slot = np.minimum(slot, max(len(known) - 1, 0))
    found = known[slot] == hashes if len(known) else np.zeros(len(hashes), bool)
    other = len(known) + (np.minimum(ends - starts, 31) * 37 + data[ends - 1]) % classes
    return np.where(found, slot, other), rows


def _previous(tokens: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """The token before each; ``start`` before the first of a row."""
    out = np.concatenate([[start], tokens[:-1]]) if len(tokens) else tokens
    first = rows[:-1][np.diff(rows) > 0]
    out[first] = start
    return out


def _pass_pairs(docs: DataFrame, known: np.ndarray, classes: int, packed: bool = False) -> np.ndarray:
    """Counts of (previous, next) over ``docs`` (id, text)."""
    size = len(known) + classes
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros((size + 1) * size, np.int64)
        for batch in batches:
            texts = pa.array([unpack(x) for x in batch.column(1).to_pylist()], pa.binary()) if packed else batch.column(1)
            for part in text_chunks(pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "text"])):
                tokens, rows = token_ids(part.column(1), shared.value, classes)
                total += np.bincount(_previous(tokens, rows, size) * size + tokens, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    counts = docs.mapInArrow(released(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1) * size)
    out[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    return out.reshape(size + 1, size)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell: each history trusts its own counts as far as it has more of them than kinds of next token."""
    single = (counts.sum(axis=0) + 1) / (counts.sum() + counts.shape[1])
    total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    trust = total / np.maximum(total + kinds, 1e-9)
    return np.log(trust * counts / np.maximum(total, 1e-9) + (1 - trust) * single).astype(np.float32)


def train_models(docs: DataFrame, targets: DataFrame, vocabulary: int, classes: int, id_col: str = "doc_id", text_col: str = "text", target_col: str = "doc_id") -> Models:
    """``targets`` has the ids of the target texts."""
    plain = id_text(docs, id_col, text_col)
    top = _pass_words(plain).orderBy(F.desc("n"), "word").limit(vocabulary)
    known = np.sort(np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64))
    background = _pass_pairs(plain, known, classes)
    wanted = targets.select(F.col(target_col).alias("doc_id")).where("doc_id is not null").distinct()
    chosen = packed_texts(plain, wanted, "doc_id").join(wanted, "doc_id", "left_semi")
    target = _pass_pairs(chosen, known, classes, packed=True)
    if not target.sum():
        target = background
    scaled = background * (target.sum() / max(background.sum(), 1))
    return Models(known, log_probabilities(target), log_probabilities(scaled))


def lm_score(docs: DataFrame, models: Models, classes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mean loss per token of both models and their difference; the lower the score, the more a text is like the target."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_chunks(batch):
                tokens, rows = token_ids(part.column(1), m.known, classes)
                before, n = _previous(tokens, rows, m.target.shape[1]), np.diff(rows)
                losses = []
                for table in (m.target, m.background):
                    sums = np.concatenate([[0.0], np.cumsum(-table[before, tokens].astype(np.float64))])
                    losses.append((sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), pa.array(losses[0]), pa.array(losses[1]), pa.array(losses[0] - losses[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(released(run), SCHEMA)


def _pack(x: np.ndarray) -> bytes:
    """Numbers, the first bytes of all before the second bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _is_target(plain: DataFrame, wanted: DataFrame):
    """A function of a column of ids that tells which are ``wanted``: a bitmap, and the ids of ``plain`` it takes for others."""
    bits, slots = bitmap(wanted, "doc_id", 1 << 26)
    context = plain.sparkSession.sparkContext
    shared = context.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_met(shared.value, batch.column(1)))).select([0])

    other = plain.select(F.col("doc_id").cast("bigint")).where("doc_id is not null").distinct().join(wanted, "doc_id", "left_anti")
    taken = other.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot")).mapInArrow(released(run), "doc_id bigint").toArrow()
    wrong = context.broadcast(np.sort(taken.column(0).to_numpy()))
    return lambda ids, at: _met(shared.value, at) & ~np.isin(ids, wrong.value), slots


def _chunks(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of many texts each: ids, which are null and which targets, where each text's words start, words, tokens.

    words are the sorted hashes of the chunk's words after a 0, which stands before each text; tokens are places in them.
    """
    tell, slots = _is_target(plain, wanted)

    def row(chunk, ids, null, target, hashes, sizes):
        every, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes, target = np.concatenate(sizes), np.concatenate(target)
        values = [np.concatenate(ids), np.concatenate(null), target, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.zeros(1, np.uint64), every]), (tokens + 1).astype(np.uint32)]
        columns = [pa.array([chunk]), pa.array([int(sizes.sum())]), pa.array([int(sizes[target].sum())]), *(pa.array([_pack(x)], pa.binary()) for x in values)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "n", "n_target", "ids", "null", "target", "rows", "words", "tokens"])

    def run(batches):
        from pyspark import TaskContext

        chunk, held, n_words, n_rows = TaskContext.get().partitionId() << 32, [[] for _ in range(5)], 0, 0
        for batch in batches:
            for part in text_chunks(batch):
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).cast(pa.int64()).fill_null(0).to_numpy()
                hashes, _, _, rows = words(*buffers(part.column(1)))
                for kept, x in zip(held, (ids, null, tell(ids, part.column(2)) & ~null, hashes, np.diff(rows)), strict=True):
                    kept.append(x)
                n_words, n_rows = n_words + len(hashes), n_rows + len(ids)
                if n_words >= CHUNK_WORDS or n_rows >= CHUNK_ROWS:
                    yield row(chunk, *held)
                    chunk, held, n_words, n_rows = chunk + 1, [[] for _ in range(5)], 0, 0
        if n_rows:
            yield row(chunk, *held)

    at = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(slots)), F.lit(0)).alias("at")
    schema = "chunk bigint, n bigint, n_target bigint, ids binary, null binary, target binary, rows binary, words binary, tokens binary"
    return materialise(plain.select("doc_id", "text", at).mapInArrow(released(run), schema), "lm-chunks")


def _pairs(every: np.ndarray, tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted hashes of a chunk's different pairs, their first words, the place of each token's pair, the token before each."""
    before = _previous(tokens, rows, 0)
    hashes = mix64(mix64(every + np.uint64(1))[before] + every[tokens])
    pairs, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    return pairs, before[first], at, before


REQUEST = "bucket int, chunk bigint, hashes binary, counts binary"


def _requests(chunk: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of sorted ``hashes`` and their ``counts`` (a row of them for each kind)."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    steps = [_pack(np.diff(hashes[i:j], prepend=np.uint64(0))) for i, j in spans]
    sums = [_pack(counts[:, i:j].astype(np.int64)) for i, j in spans]
    columns = [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([chunk] * len(spans), pa.int64()), pa.array(steps, pa.binary()), pa.array(sums, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "hashes", "counts"])


def _counted(requests: DataFrame, kinds: int, what: str) -> DataFrame:
    """For each request the sums of its hashes' counts over all requests, and which of them it is the first to ask for."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        asked = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        _, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        each = np.concatenate([_unpack(x).reshape(kinds, -1) for x in table.column("counts").to_pylist()], axis=1)
        sums = np.stack([np.bincount(at, x).astype(np.int64)[at] for x in each])
        own = np.zeros(len(at), np.uint8)
        own[first] = 1
        ends = np.cumsum([len(x) for x in asked])
        spans = [(j - len(x), j) for x, j in zip(asked, ends, strict=True)]
        columns = [table.column("chunk"), pa.array([what] * len(spans)), table.column("bucket"), pa.array([_pack(sums[:, i:j]) for i, j in spans], pa.binary()), pa.array([_pack(own[i:j]) for i, j in spans], pa.binary()), pa.array([int((own[i:j] * (sums[0, i:j] > 0)).sum()) for i, j in spans])]
        return pa.table(columns, names=["chunk", "what", "bucket", "sums", "own", "n_own"])

    schema = "chunk bigint, what string, bucket int, sums binary, own binary, n_own bigint"
    return materialise(requests.groupBy("bucket").applyInArrow(run, schema), f"lm-{what}")


def _answers(table: pa.Table, what: str, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and firsts of a chunk in the order in which it asked."""
    some = sorted((r for r in table.to_pylist() if r["what"] == what), key=lambda r: r["bucket"])
    if not some:
        return np.zeros((kinds, 0), np.int64), np.zeros(0, np.uint8)
    return np.concatenate([_unpack(r["sums"]).reshape(kinds, -1) for r in some], axis=1), np.concatenate([_unpack(r["own"], np.uint8) for r in some])


def corpus_scores(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "doc_id") -> DataFrame:
    """As ``lm_score``, by models of all words of ``docs``. ``targets`` has the ids of the target texts."""
    wanted = targets.select(F.col(target_col).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    chunks = _chunks(id_text(docs, id_col, text_col), wanted)
    total = chunks.agg(F.count("*").alias("chunks"), F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).first()
    buckets, n, n_target = 2 * max(total["chunks"], 1), total["n"] or 0, total["n_target"] or 0

    def opened(r):
        rows, tokens = _unpack(r["rows"]), _unpack(r["tokens"], np.uint32).astype(np.int64)
        return rows, _unpack(r["words"], np.uint64), tokens, np.repeat(_unpack(r["target"], bool), np.diff(rows))

    def ask_pairs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, every, tokens, target = opened(r)
                pairs, _, at, _ = _pairs(every, tokens, rows)
                counts = [np.bincount(x, minlength=len(pairs)) for x in (at, at[target])]
                yield _requests(r["chunk"], pairs, np.stack(counts), buckets)

    def ask_words(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in chunk.to_pylist():
            rows, every, tokens, target = opened(r)
            _, first, _, before = _pairs(every, tokens, rows)
            sums, own = _answers(answers, "pairs", 2)
            count = lambda x: np.bincount(x, minlength=len(every))
            counts = [count(tokens), count(tokens[target]), count(before), count(before[target]), count(first[own > 0]), count(first[(own > 0) & (sums[1] > 0)])]
            out.append(_requests(r["chunk"], every, np.stack(counts), buckets))
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=["bucket", "chunk", "hashes", "counts"])

    texts = chunks.select("chunk", "target", "rows", "words", "tokens")
    pairs = _counted(texts.mapInArrow(released(ask_pairs), REQUEST), 2, "pairs")
    by_word = _counted(texts.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(ask_words, REQUEST), 6, "words")
    size = by_word.agg(F.sum("n_own").alias("n")).first()["n"] or 1

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in chunk.to_pylist():
            rows, every, tokens, _ = opened(r)
            _, _, at, before = _pairs(every, tokens, rows)
            (pair, _), (word, _) = _answers(answers, "pairs", 2), _answers(answers, "words", 6)
            losses = []
            for k, scale in ((1, 1.0), (0, n_target / max(n, 1))) if n_target else ((0, 1.0), (0, 1.0)):
                single = (scale * word[k] + 1) / (scale * (n_target if k else n) + size)
                history, kinds = scale * word[2 + k][before], word[4 + k][before]
                seen = history + kinds
                p = np.where(seen > 0, (scale * pair[k][at] + kinds * single[tokens]) / np.maximum(seen, 1e-9), single[tokens])
                sums = np.concatenate([[0.0], np.cumsum(-np.log(p))])
                losses.append((sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(np.diff(rows), 1))
            ids = pa.array(_unpack(r["ids"]), mask=_unpack(r["null"], bool))
            out.append(pa.table([ids, pa.array(np.diff(rows)), *map(pa.array, losses), pa.array(losses[0] - losses[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    whole = chunks.select("chunk", "ids", "null", "target", "rows", "words", "tokens")
    return whole.groupBy("chunk").cogroup(pairs.unionByName(by_word).groupBy("chunk")).applyInArrow(score, SCHEMA)
