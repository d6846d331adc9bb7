"""The SentencePiece codec on the public model file and on small models that are written here, byte by byte."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from lodestone.llm import sentencepiece_codec
from lodestone.llm.queries import PIECES

from .conftest import frame

TEXTS = ["", " ", "  two", "a\n b", "\n\n", "   x   \n  y ", "\tq", "日本\u0000 é\U0001f600 " + " " * 40 + "z", "Hello World, naïve façade 12345", "a" * 300, "literal ▁ mark▁▁", "ﬁne ①②  Ｆｕｌｌ"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def charsmap(rule):
    for number, value in sentencepiece_codec._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()):
        if number == 3:
            return dict(sentencepiece_codec._fields(value))[2]


def model_bytes(kind, words, byte_fallback=False, trim=False, rule=None, prefix=True):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if byte_fallback else [])
    pieces += [(w, -0.1 * i - 1 - 0.013 * (i % 7), 1) for i, w in enumerate(words)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, kind) + field(35, int(byte_fallback)))
    return out + field(3, field(1, (rule or "identity").encode()) + (field(2, charsmap(rule)) if rule else b"") + field(3, int(prefix)) + field(4, int(trim)) + field(5, 1))


WORDS = ["▁", "a", "b", "c", "ab", "▁a", "abc", "▁ab", "▁abc", "bc", "▁▁", "\n", "x", "fi", "f", "i", "1", "2"]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("trim, rule, prefix", [(False, None, True), (True, "nmt_nfkc", True), (False, None, False), (True, None, True)])
def test_small_models(kind, fallback, trim, rule, prefix):
    data = model_bytes(kind, WORDS, fallback, trim, rule, prefix)
    c, reference = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    r = random.Random(kind)
    texts = TEXTS + ["".join(r.choice("aabbcc  \nxfi12é") for _ in range(r.randint(0, 40))) for _ in range(120)]
    ids, begin, same, agree = c.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)]
    want = [reference.encode(t) for t in texts]
    wrong = [t for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not wrong and agree.all()
    assert [c.decode(g) == t for g, t in zip(got, texts, strict=True)] == same.tolist()
    if fallback and not trim:
        assert all(s for s, t in zip(same, texts, strict=True) if "▁" not in t)


@pytest.mark.parametrize("text", TEXTS)
def test_parity(text):
    with open(PIECES, "rb") as f:
        c = sentencepiece_codec.codec(f.read())
    ids, begin, same, agree = c.encode([text, text])
    assert ids[: begin[1]].tolist() == ids[begin[1] :].tolist() == c.reference.encode(text)
    assert agree.all() and same.tolist() == ["▁" not in text] * 2 and (c.decode(ids[: begin[1]].tolist()) == text) == same[0]


def test_ids_are_those_of_the_backend(monkeypatch):
    """A backend that gives other ids shows in the ids and in both checks: nothing is taken from the reference library."""
    with open(PIECES, "rb") as f:
        data = f.read()
    c = sentencepiece_codec.Codec(data)
    right = c.by_tokenizers

    def broken(segments):
        ids, size = right(segments)
        return np.where(ids == ids.max(), ids - 1, ids), size

    monkeypatch.setattr(c, "by_tokenizers", broken)
    ids, begin, same, agree = c.encode(["hello world", "hello there, a longer text of many words"])
    assert ids.tolist() != [i for t in ("hello world", "hello there, a longer text of many words") for i in c.reference.encode(t)]
    assert not agree.all() and not same.all()


def test_store_is_bounded():
    with open(PIECES, "rb") as f:
        c = sentencepiece_codec.Codec(f.read(), keep=200)
    r = random.Random(2)
    for _ in range(20):
        texts = [" ".join(str(r.randrange(10**9)) for _ in range(5)) for _ in range(4)]
        ids, begin, _, _ = c.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == c.reference.encode(texts)
        assert c.held <= 500


def test_encode_and_decode_rows(spark, messy):
    rows = messy + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(900, "line of text, again\n" * 60_000)]
    got = sentencepiece_codec.sentencepiece_encode(frame(spark, rows), PIECES)
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = got.collect()
    assert sorted(r.ids for r in out if r.ids is not None) == sorted(reference.encode(t) for _, t in rows if t is not None)
    assert all(r.parity and r.n_tokens == len(r.ids or ()) for r in out) and sum(r.ids is None for r in out) == sum(t is None for _, t in rows)
    assert sum(not r.round_trip for r in out) == sum("▁" in (t or "") for _, t in rows)
    back = sentencepiece_codec.sentencepiece_decode(got, PIECES)
    assert sorted(r.text for r in back.where("text is not null").collect()) == sorted(t.replace("▁", " ") for _, t in rows if t is not None)
    assert sentencepiece_codec.sentencepiece_encode(frame(spark, []), PIECES).count() == 0
