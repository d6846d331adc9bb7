"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward and Adam.

A word is its own vector (hashed) beside the mean of the vectors of its four-byte pieces (hashed too), so a word that was
never met is known by its stem. A window of words gives one logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .shingles import MARKS, words

BITS, WORD, PIECE, HIDDEN, ATTEND = 14, 8, 8, 8, 8
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LOWERED[MARKS] = 0


@dataclass
class Tokens:
    """Words of many texts: bucket of each word, where each text's words start, buckets of pieces and where each word's start."""

    word: np.ndarray
    rows: np.ndarray
    piece: np.ndarray
    first: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return (1 / np.diff(self.first)).astype(np.float32)[:, None]


def tokens(texts: list[bytes]) -> Tokens:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n\n\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    hashes, starts, ends, rows = words(data, offsets, MARKS)
    low = LOWERED[data]
    wide = low.astype(np.uint32)
    code = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    inside = (low[1:-2] != 0) & (low[2:-1] != 0)
    single = starts[ends - starts == 1] - 1
    inside[single] = True
    code[single] &= np.uint32(0xFFFF)
    piece = (code[np.flatnonzero(inside)] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    first = np.concatenate([[0], np.cumsum(np.maximum(ends - starts - 1, 1))])
    return Tokens((hashes >> np.uint64(64 - BITS)).astype(np.int32), rows, piece.astype(np.int32), first)


def many_tokens(texts: list[bytes], limit: int = 1 << 20) -> Iterator[Tokens]:
    """Tokens of the texts in turn, of about ``limit`` bytes at a time."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit or i == len(texts) - 1:
            yield tokens(texts[at : i + 1])
            at, size = i + 1, 0


def joined(parts: list[Tokens]) -> Tokens:
    """One after another."""
    words_before = np.cumsum([0, *(len(t.word) for t in parts)])
    pieces_before = np.cumsum([0, *(len(t.piece) for t in parts)])
    rows = np.concatenate([*(t.rows[:-1] + n for t, n in zip(parts, words_before, strict=False)), words_before[-1:]])
    first = np.concatenate([*(t.first[:-1] + n for t, n in zip(parts, pieces_before, strict=False)), pieces_before[-1:]])
    return Tokens(np.concatenate([t.word for t in parts]), rows, np.concatenate([t.piece for t in parts]), first)


def windows(rows: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; windows overlap and cover every word of a text."""
    n = np.diff(rows)
    many = np.where(n > width, -(-(n - width) // step) + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    # the last window ends with the text
    return rows[text] + np.minimum(k * step, np.maximum(n[text] - width, 0)), np.minimum(n[text], width), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name; ``a`` is the forward and ``b`` the backward direction."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": g(1 << BITS, WORD, scale=0.1), "piece": g(1 << BITS, PIECE, scale=0.1), "attend": g(2 * HIDDEN, ATTEND, scale=0.3), "focus": g(ATTEND, scale=0.3), "out": g(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "ab":
            self.p |= {f"{d}_in": g(WORD + PIECE, 3 * HIDDEN, scale=0.3), f"{d}_state": g(HIDDEN, 3 * HIDDEN, scale=0.3), f"{d}_bias": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, t: Tokens) -> np.ndarray:
        """A row for each word and a last one of zeros, for the places after a window's end."""
        x = np.zeros((len(t.word) + 1, WORD + PIECE), np.float32)
        if len(t.word):
            x[:-1, :WORD] = self.p["word"][t.word]
            x[:-1, WORD:] = np.add.reduceat(self.p["piece"][t.piece], t.first[:-1], axis=0) * t.share
        return x

    def _run(self, d: str, gates: np.ndarray, at: np.ndarray, mask: np.ndarray | None, states: np.ndarray, keep: list | None) -> None:
        """One direction over the windows' words ``at``; fills ``states`` (windows, places, HIDDEN)."""
        n, width = at.shape
        h = np.zeros((n, HIDDEN), np.float32)
        u = self.p[f"{d}_state"]
        for t in range(width) if d == "a" else range(width - 1, -1, -1):
            gx, gh = gates[at[:, t]], h @ u
            zr = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if mask is not None:
                new *= mask[:, t, None]
                if d == "a":
                    new += h * (1 - mask[:, t, None])
            if keep is not None:
                keep.append((t, h, z, r, c, gh[:, 2 * HIDDEN :]))
            h = new
            states[:, t] = h

    def forward(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, keep: dict | None = None) -> np.ndarray:
        """The logit of each window of the words whose inputs are ``x``."""
        place = np.arange(width)
        inside = place < size[:, None]
        at = np.where(inside, start[:, None] + place, len(x) - 1)
        mask = None if inside.all() else inside.astype(np.float32)
        states = np.empty((*at.shape, 2 * HIDDEN), np.float32)
        kept = {"a": [], "b": []} if keep is not None else {"a": None, "b": None}
        for d, part in (("a", states[..., :HIDDEN]), ("b", states[..., HIDDEN:])):
            self._run(d, x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"], at, mask, part, kept[d])
        seen = np.tanh(states @ self.p["attend"])
        score = seen @ self.p["focus"]
        if mask is not None:
            score = np.where(inside, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        if keep is not None:
            keep |= {"at": at, "mask": mask, "states": states, "seen": seen, "weight": weight, "pooled": pooled, **kept}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, k: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the parameters but the two tables, and of ``x``."""
        g = {"bias": np.array([dlogit.sum()], np.float32), "out": k["pooled"].T @ dlogit}
        states, weight, seen = k["states"], k["weight"], k["seen"]
        dpool = dlogit[:, None] * self.p["out"]
        dstates = weight[..., None] * dpool[:, None]
        dw = np.einsum("nth,nh->nt", states, dpool)
        dscore = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
        g["focus"] = np.einsum("nt,nta->a", dscore, seen)
        dseen = dscore[..., None] * self.p["focus"] * (1 - seen**2)
        g["attend"] = np.einsum("nth,nta->ha", states, dseen)
        dstates += dseen @ self.p["attend"].T
        dx = np.zeros_like(x)
        for d, part in (("a", dstates[..., :HIDDEN]), ("b", dstates[..., HIDDEN:])):
            u, v = self.p[f"{d}_state"], self.p[f"{d}_in"]
            gu, gv, gb = np.zeros_like(u), np.zeros_like(v), np.zeros(3 * HIDDEN, np.float32)
            dh = np.zeros((len(dlogit), HIDDEN), np.float32)
            for t, h, z, r, c, ghc in reversed(k[d]):
                total = dh + part[:, t]
                m = 1.0 if k["mask"] is None else k["mask"][:, t, None]
                new = total * m
                dc = new * (1 - z) * (1 - c**2)
                dz = new * (h - c) * z * (1 - z)
                dr = dc * ghc * r * (1 - r)
                dgx = np.concatenate([dz, dr, dc], axis=1)
                dgh = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ dgh
                xt = x[k["at"][:, t]]
                gv += xt.T @ dgx
                gb += dgx.sum(axis=0)
                np.add.at(dx, k["at"][:, t], dgx @ v.T)
                dh = new * z + dgh @ u.T
                if d == "a" and k["mask"] is not None:
                    dh += total * (1 - m)
            g |= {f"{d}_state": gu, f"{d}_in": gv, f"{d}_bias": gb}
        return g, dx

    def part(self, t: Tokens, start: np.ndarray, size: np.ndarray) -> tuple[Tokens, np.ndarray]:
        """The words of some windows only, and where each window starts among them."""
        at = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(start - at[:-1], size) + np.arange(at[-1])
        many = np.diff(t.first)[pick]
        first = np.concatenate([[0], np.cumsum(many)])
        pieces = np.repeat(t.first[pick] - first[:-1], many) + np.arange(first[-1])
        return Tokens(t.word[pick], at, t.piece[pieces], first), at[:-1]

    def table_gradients(self, t: Tokens, dx: np.ndarray) -> dict[str, np.ndarray]:
        used = np.flatnonzero(np.abs(dx[:-1]).sum(axis=1))
        word, piece = np.zeros_like(self.p["word"]), np.zeros_like(self.p["piece"])
        np.add.at(word, t.word[used], dx[used, :WORD])
        many = np.diff(t.first)[used]
        at = np.repeat(t.first[used] - np.cumsum(many) + many, many) + np.arange(many.sum())
        np.add.at(piece, t.piece[at], np.repeat(dx[used, WORD:] * t.share[used], many, axis=0))
        return {"word": word, "piece": piece}


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-7)
