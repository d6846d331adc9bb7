"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model's protobuf is parsed here and rebuilt as a ``tokenizers.Tokenizer``: normaliser (character map, space
marker, dummy prefix), unigram scores or BPE merges, byte fallback. Texts of BPE models are cut where no piece can reach
across (before a run of markers, around line ends and tabs that no longer piece holds); each different segment is encoded
once per worker, the new ones of a chunk together and multithreaded, and its ids are kept, of KEEP bytes and SEGMENTS segments at most.
Unigram models take whole texts. All ids are those of ``tokenizers``; the ``sentencepiece`` library encodes each new
segment too, and ``parity`` tells whether both agree on all segments of a row.

Only one row's data is ever needed at a time: there is no shuffle, a lost executor costs its own tasks.

Defined cases: ids of rows are longs or null. A null text has null ids and counts of zero; an empty text has no ids.
Repeated rows are encoded each; texts may have any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, released, text_chunks

#: Segments that are encoded as one text, and that are encoded together.
JOINED, TOGETHER = 500, 4000
#: Bytes and number of the segments that a worker's store may hold (some 200 bytes each beside the text); bytes of text that are encoded at once.
KEEP, SEGMENTS, CHUNK = 16 << 20, 150_000, 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
SCHEMA = "doc_id bigint, n_chars bigint, n_tokens bigint, ids array<int>, ids_sha256 string, round_trip boolean, parity boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = {1: (8, i), 5: (4, i)}.get(key & 7) or varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Model:
    """What a SentencePiece model file holds, as far as encoding and decoding need it."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.by_space = 1, False, True
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, NORMAL)))
            elif number == 2:
                x = dict(_fields(value))
                self.kind, self.byte_fallback, self.by_space = x.get(3, 1), bool(x.get(35, 0)), bool(x.get(22, 1))
            elif number == 3:
                x = dict(_fields(value))
                self.charsmap = x.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        self.ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best score first."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, i in usable.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in usable and b in usable:
                    found.append((-self.pieces[i][1], i, usable[a], usable[b], a, b))
        return [x[4:] for x in sorted(found)]

    def normaliser(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            end = f"[ {MARK}]+" if self.escape else " +"  # a marker that the text has itself counts as a space at the end only
            steps += [normalizers.Replace(Regex(p), r) for p, r in ((r"\A +", ""), (" {2,}", " "), (rf"{end}\z", ""))]
        return normalizers.Sequence(steps) if steps else None

    def tokenizer(self):
        """The tokenizers object; it takes normalised text with markers."""
        from tokenizers import Tokenizer, decoders
        from tokenizers.models import BPE, Unigram

        if self.kind == 1:
            model = Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk, byte_fallback=self.byte_fallback)
        else:
            model = BPE(vocab=self.ids, merges=self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)  # the codec keeps segments itself
        out = Tokenizer(model)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out

    def alone(self) -> str | None:
        """Line ends and tabs that no longer piece holds, or None where a piece may reach across the start of a word."""
        long = [p for p, _, kind in self.pieces if kind in (NORMAL, USER) and len(p) > 1]
        known = lambda c: self.byte_fallback or c in self.ids  # noqa: E731  unknown characters in a row are one
        if self.kind == 1 or not self.escape or not known(MARK) or any(MARK in p.lstrip(MARK) for p in long):
            return None
        return "".join(c for c in "\n\r\t" if known(c) and not any(c in p for p in long))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists in a row, and how many each has."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of ``size``."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _alike(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the runs of a (of sizes n) are those of b (of sizes m)."""
    same, k = n == m, np.where(n == m, n, 0)
    off = np.concatenate([[0], np.cumsum(a[_spread(np.cumsum(n) - n, k)] != b[_spread(np.cumsum(m) - m, k)])])
    return same & (np.diff(off[np.concatenate([[0], np.cumsum(k)])]) == 0)


class Codec:
    """Encodes and decodes; keeps the ids of the segments that it has met, of ``keep`` bytes and SEGMENTS segments at most, and of one chunk more."""

    def __init__(self, data: bytes, keep: int = KEEP):
        import sentencepiece

        self.model = Model(data)
        self.tokenizer, self.normal, self.alone = self.model.tokenizer(), self.model.normaliser(), self.model.alone()
        self.keep = keep
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.line = len(self.reference.encode("\n"))
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.bytes_of[self.model.unk] = " ⁇ ".encode()
        self.pieces = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_start = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        ends = self.tokenizer.encode("a\n", add_special_tokens=False).ids  # the id of a line end, where it is one and no other text has it
        self.line_end = ends[-1] if self.alone and "\n" in self.alone and ends[-1] != self.model.unk and self.bytes_of[ends[-1]] == b"\n" else None
        self._forget()

    def _forget(self) -> None:
        """An empty store: of each segment met its place; of each place the ids, whether they decode to it, whether both libraries agree."""
        self.place: dict[str, int] = {}
        self.held = 0
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.back, self.agree = np.zeros(0, bool), np.zeros(0, bool)

    def normalise(self, text: str) -> str:
        """The text as the model sees it, with spaces for markers."""
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        if self.model.dummy_prefix and text:
            text = " " + text
        return text.replace(MARK, " ") if self.model.escape else text

    def _cuts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the segments of the texts that stand between ``rows`` in ``data`` start; no piece reaches across a cut."""
        begins = rows[:-1][np.diff(rows) > 0]
        if self.alone is None or not len(data):
            return begins
        new = data == 32
        new[1:] &= data[:-1] != 32
        for c in self.alone.encode():
            new |= data == c
            new[1:] |= data[:-1] == c
        new[begins] = True
        return np.flatnonzero(new)

    def by_tokenizers(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments in a row, and how many each has; encoded multithreaded, each as if it stood alone."""
        marked = [s.replace(" ", MARK) for s in segments] if self.model.escape else segments
        if self.line_end is None or any("\n" in s for s in marked):
            return _flat([e.ids for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)])
        joined = ["\n".join(marked[i : i + JOINED]) + "\n" for i in range(0, len(marked), JOINED)]
        ids, _ = _flat([e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.line_end)
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def by_sentencepiece(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the reference library, which puts a prefix before each text: one that a segment has is left off."""
        if not self.model.dummy_prefix:
            return _flat(self.reference.encode(segments, num_threads=1))
        # markers alone would be trimmed, or left out as the prefix of an empty text: they get an end, whose ids are cut off
        end = self.alone[:1] if self.alone else ""
        plain = [s[1:] if s[0] == " " else "\n" + s for s in segments]
        if self.model.trim and self.model.escape:  # spaces that are still there were markers in the text
            plain = [p.replace(" ", MARK) for p in plain]
        bare = [end and not s.strip(" ") for s in segments]
        ids = self.reference.encode([p + end if b else p for p, b in zip(plain, bare, strict=True)], num_threads=1)
        tail = len(self.reference.encode("a" + end)) - len(self.reference.encode("a"))
        return _flat([g[: len(g) - tail] if b else g[self.line :] if s[0] != " " else g for s, g, b in zip(segments, ids, bare, strict=True)])

    def _learn(self, segments: list[str]) -> None:
        """Put segments into the store, those with line ends apart from the others."""
        kinds = ([s for s in segments if "\n" not in s], [s for s in segments if "\n" in s])
        for some in (kind[i : i + TOGETHER] for kind in kinds for i in range(0, len(kind), TOGETHER)):
            self.place.update(zip(some, range(len(self.back), len(self.back) + len(some)), strict=True))
            ids, size = self.by_tokenizers(some)
            plain = [s.encode() for s in some]
            self.held += sum(map(len, plain))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.flat = np.concatenate([self.flat, ids])
            n = self.piece_start[ids + 1] - self.piece_start[ids]
            made = self.pieces[_spread(self.piece_start[ids], n)]
            long = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(size)])])
            given = np.fromiter(map(len, plain), np.int64, len(plain))
            self.back = np.append(self.back, _alike(made, long, np.frombuffer(b"".join(plain), np.uint8), given))
            self.agree = np.append(self.agree, _alike(ids, size, *self.by_sentencepiece(some)))

    def _places(self, different: list[str]) -> np.ndarray:
        if self.held > self.keep or len(self.back) > SEGMENTS:
            self._forget()
        new = [s for s in different if s not in self.place]
        if new:
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, different), np.int64, len(different))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, where each text's begin (and the last one's end), whether each is decoded to the same text, and
        whether tokenizers and sentencepiece agree on all of its segments."""
        normal = [self.normalise(t) for t in texts]
        parts = [t.encode() for t in normal]
        rows = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        buffer = b"".join(parts)
        cuts = self._cuts(np.frombuffer(buffer, np.uint8), rows)
        offsets = np.append(cuts, len(buffer)).astype(np.int64)
        segments = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(buffer)).dictionary_encode()
        place = self._places(segments.dictionary.to_pylist())[segments.indices.to_numpy()]
        size = np.diff(self.start)[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[_spread(self.start[place], size)]
        first = np.searchsorted(cuts, rows)
        wrong = lambda ok: np.diff(np.concatenate([[0], np.cumsum(~ok[place])])[first]) > 0
        begin = ends[first]
        same, agree = ~wrong(self.back), ~wrong(self.agree)
        prefix = " " if self.model.dummy_prefix else ""
        for i in np.flatnonzero(~same | np.fromiter((bool(t) and n != prefix + t for n, t in zip(normal, texts, strict=True)), bool, len(texts))):
            same[i] = self.decode(ids[begin[i] : begin[i + 1]].tolist()) == texts[i]
        return ids, begin, same, agree

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """One codec for each model and worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def _rows(c: Codec, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    plain = [t or "" for t in texts]
    flat, begin, same, agree = c.encode(plain)
    digests = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array([len(t) for t in plain], pa.int64()), pa.array(np.diff(begin)), lists, pa.array(digests, pa.string()), pa.array(same), pa.array(agree)],
        names=["doc_id", "n_chars", "n_tokens", "ids", "ids_sha256", "round_trip", "parity"],
    )


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, with the check of the round trip and of parity.

    ``model_path`` is a file of the driver's; it is read there (a model file has a few hundred kB) and sent along.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            for part in text_chunks(batch, CHUNK):
                yield _rows(c, part.column(0), part.column(1).to_pylist())

    return id_text(docs, id_col, text_col).mapInArrow(released(run), SCHEMA)


def sentencepiece_decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of lists of ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        data = f.read()
    shared = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids").mapInArrow(released(run), "doc_id bigint, text string")
