"""Language identification by rank-order profiles of n-grams.

A language's profile ranks the ``size`` most frequent n-grams (one to three characters, words bounded by spaces, letters
only, lower case) of all its documents; a document's own most frequent n-grams are ranked the same way, and the
out-of-place distance is the sum of rank differences, ``size`` for an n-gram that the profile lacks. The nearest language
wins. N-grams are packed exactly into longs; counts are of whole texts and of all rows learnt from.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text where no language could be
learnt. Ties go to the language first in order; n-grams of one count rank by their code points. Rows of one id are judged each.
Rows with a null lang or text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, released, small_batches, text_chunks
from .conversations import fold

#: N-grams of a profile, and of a document.
SIZE = 400
#: Most languages: a profile is sent to every task, so their number has to be bounded. More is an error, not a cut.
MOST_LANGUAGES = 500
UNKNOWN = "und"
FOLDS, HELD = 3, 1
#: Characters of a text that are counted at once; different n-grams that a task holds before it hands them on.
PIECE, HELD_GRAMS = 1 << 20, 1 << 20
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
SPACE = 32


@lru_cache(maxsize=1 << 16)
def _folded(code: int) -> int:
    """A letter in lower case, or a space for anything else; a letter whose lower case is several characters stays."""
    c = chr(code)
    low = c.lower()
    return (ord(low) if len(low) == 1 else code) if c.isalpha() else SPACE


def symbols(text: str) -> np.ndarray:
    """Code points of letters in lower case; a space for each other character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    top = int(codes.max(initial=0)) + 1
    seen = np.zeros(top, bool)
    seen[codes] = True
    kinds = np.flatnonzero(seen)
    low = np.zeros(top, np.int64)
    low[kinds] = np.fromiter(map(_folded, kinds.tolist()), np.int64, len(kinds))
    return low[codes]


def counted(flat: np.ndarray, owner: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), in order, of the n-grams that end at ``known`` or later; ``flat`` has no two spaces in a row.

    Owners rise from 0 and are those of letters; a space belongs to no one.
    """
    kinds, local = np.unique(flat, return_inverse=True)
    base = len(kinds) + 1
    x = local.astype(np.int64) + 1
    word = flat != SPACE
    two, three = word[:-1] | word[1:], word[1:-1]
    two[: max(known - 1, 0)] = three[: max(known - 2, 0)] = False
    one = word.copy()
    one[:known] = False
    keys = np.concatenate([x[one], (x[:-1] * base + x[1:])[two], ((x[:-2] * base + x[1:-1]) * base + x[2:])[three]])
    owners = np.concatenate([owner[one], np.where(word[:-1], owner[:-1], owner[1:])[two], owner[1:-1][three]])
    if not len(keys):
        return owners, keys, keys
    if (int(owners.max()) + 1) * base**3 < 1 << 63:
        both = owners * base**3 + keys
        both.sort()
        new = np.concatenate([[True], both[1:] != both[:-1]])
        owners, keys = both[new] // base**3, both[new] % base**3
    else:  # very many kinds of letter
        order = np.lexsort([keys, owners])
        owners, keys = owners[order], keys[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
        owners, keys = owners[new], keys[new]
    count = np.diff(np.append(np.flatnonzero(new), len(new)))
    code = np.concatenate([[0], kinds])
    packed = (code[keys // base**2] << 42) | (code[keys // base % base] << 21) | code[keys % base]
    return owners, packed, count


def _single_spaced(flat: np.ndarray) -> np.ndarray:
    space = flat == SPACE
    return ~space | np.concatenate([[True], ~space[:-1]])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, n-gram, count) of texts that together are short, in order."""
    flat = symbols(" " + " ".join(texts) + " ")
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    keep = _single_spaced(flat)
    return counted(flat[keep], owner[keep])


def summed(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Counts of parts (owner, n-gram, count) put together, in the order of owner and n-gram."""
    owner, gram, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort([gram, owner])
    owner, gram, count = owner[order], gram[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])) if len(gram) else np.zeros(0, np.int64)
    return owner[new], gram[new], np.add.reduceat(count, new) if len(new) else count


def long_grams(text: str, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """The same of one text of any length, by pieces: a piece begins with the last two symbols of the one before."""
    got, carry = (np.zeros(0, np.int64),) * 3, np.array([SPACE], np.int64)
    for at in range(0, len(text), piece):
        part = symbols(text[at : at + piece] + (" " if at + piece >= len(text) else ""))
        flat = np.concatenate([carry, part])
        flat = flat[_single_spaced(flat)]
        got = summed([got, counted(flat, np.zeros(len(flat), np.int64), len(carry))])
        carry = flat[-2:]
    return got


def text_grams(column: pa.Array) -> Iterator[tuple[int, int, tuple]]:
    """(first row, end row, their n-grams with numbers from 0) over a column of texts; nulls have none."""
    texts = [x or "" for x in column.to_pylist()]
    start, size = 0, 0
    for i, x in enumerate(texts):
        if len(x) > PIECE:
            if start < i:
                yield start, i, grams(texts[start:i])
            yield i, i + 1, long_grams(x)
            start, size = i + 1, 0
        elif (size := size + len(x)) > PIECE:
            yield start, i + 1, grams(texts[start : i + 1])
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts), grams(texts[start:])


def ranked(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank from 0) of each owner's ``size`` most frequent n-grams; equal counts in the order of n-grams."""
    order = np.lexsort([-count, owner])  # stable: n-grams are in order
    owner, gram = owner[order], gram[order]
    first = np.searchsorted(owner, owner, "left")
    rank = np.arange(len(owner)) - first
    top = rank < size
    return owner[top], gram[top], rank[top]


class Profiles:
    """Profiles of languages in arrays: for each n-gram, the languages that rank it and their ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        """``rows``: language, n-gram, rank."""
        self.size, self.languages = size, sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.languages)}
        rows = sorted((g, number[lang], r) for lang, g, r in rows)
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.grams, self.starts = np.unique(table[:, 0], return_index=True)
        self.ends = np.append(self.starts[1:], len(table))
        self.language, self.rank = table[:, 1], table[:, 2]

    def nearest(self, n: int, owner: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ``n`` texts the number of the nearest language (-1: none) and the score, one less the share of the greatest distance."""
        held = np.bincount(owner, minlength=n)
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        met = self.grams[at] == gram
        owner, rank, at = owner[met], rank[met], at[met]
        many = self.ends[at] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        saved = self.size - np.abs(np.repeat(rank, many) - self.rank[entry])
        width = len(self.languages)
        near = np.bincount(np.repeat(owner, many) * width + self.language[entry], saved, n * width).reshape(n, width)
        best = near.argmax(1)
        score = near[np.arange(n), best] / np.maximum(held * self.size, 1)
        return np.where(held > 0, best, -1), np.where(held > 0, score, 0.0)


def held_out(column: Column) -> Column:
    """Whether an id is kept out of learning; a null id is not."""
    return F.coalesce(fold(column, FOLDS) == HELD, F.lit(False))


def train_languages(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows that are not held out. N-grams are counted in each task, then by language and n-gram."""
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches):
        names: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def out():
            owner, gram, count = summed(held)
            known = np.array(list(names), object)
            return pa.RecordBatch.from_arrays([pa.array(known[owner] if len(owner) else [], pa.string()), pa.array(gram, pa.int64()), pa.array(count, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for part in text_chunks(batch):
                numbers = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], np.int64)
                for start, _, (owner, gram, count) in text_grams(part.column(1)):
                    held.append(summed([(numbers[start + owner], gram, count)]))
                    size += len(held[-1][0])
                if size > HELD_GRAMS:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD_GRAMS // 2:
                        yield out()
                        names, held, size = {}, [], 0
        if held:
            yield out()

    counts = rows.mapInArrow(released(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counts.withColumn("rank", rank).where(F.col("rank") < size).limit(MOST_LANGUAGES * size + 1).collect()
    if len(top) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in top], size)


def language_id(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The nearest language of every row of ``docs``."""
    rows = id_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)  # -1 is the last
        for batch in batches:
            for part in text_chunks(batch):
                best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                for start, end, got in text_grams(part.column(1)):
                    best[start:end], score[start:end] = known.nearest(end - start, *ranked(*got, known.size))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(released(run), SCHEMA)
