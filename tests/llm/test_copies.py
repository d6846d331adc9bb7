import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import components, decontaminate, jaccard_join, substring_dedup
from lodestone.llm.run_index import RunIndex
from lodestone.llm.shingles import MARKS, buffers, words

from .conftest import frame


def near_copies(seed, n=40, size=60):
    r = random.Random(seed)
    base = [[f"w{r.randrange(200)}" for _ in range(size)] for _ in range(4)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            t[r.randrange(len(t))] = f"e{r.randrange(50)}"
        out.append((1000 + i, " ".join(t)))
    return out


def jaccard_by_hand(rows, k, percent):
    sets = []
    for _, text in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows, strict=True):
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    return [(d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, group, strict=True)]


@pytest.mark.parametrize("k, percent, tile", [(3, 90, 4_000_000), (5, 80, 4_000_000), (3, 80, 150)])
def test_jaccard(spark, messy, monkeypatch, k, percent, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    near = near_copies(k)
    rows = messy + near + [(5, "x y z"), (3000, near[0][1] + " tail"), (3000, near[1][1]), (900, "short text of the id"), (900, near[2][1])]
    got = [tuple(r) for r in jaccard_join.jaccard_join(frame(spark, rows), k, percent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, jaccard_by_hand(rows, k, percent)))


def test_jaccard_edges(spark, messy):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_join(frame(spark, messy)).count() == len(messy)
    docs = frame(spark, messy)
    kept = jaccard_join.drop_near_copies(docs, 5, 80)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 10 not in ids and 1 in ids and ids.count(5) == 2 and None in ids


def test_near_copies_of_any_column_names(spark):
    """Columns named like those that are used inside, and an id on a clean text and on a copy."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 7, 8, 9, 1, 2), (2, text + " more", 7, 8, 9, 1, 2), (3, text + " more", 7, 8, 9, 1, 2), (3, "a clean text of that id", 7, 8, 9, 1, 2), (4, "another clean text", 7, 8, 9, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _slot long, least long, rep long, tile long")
    out = jaccard_join.drop_near_copies(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[3], rows[2], rows[4]] or sorted(map(tuple, out.collect())) == sorted([rows[0], rows[2], rows[3], rows[4]])


def test_tiles_of_many_sets_are_cut(spark, monkeypatch):
    """So are classes of many copies, and the rows without words."""
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 5)
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 1)
    rows = near_copies(9, 60) + [(i, "a text that many have") for i in range(9)] + [(20 + i, " ") for i in range(3)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(frame(spark, rows), 3, 80).collect())
    assert got == sorted(jaccard_by_hand(rows, 3, 80))


def test_signatures_never_bound_too_low():
    r = np.random.default_rng(3)
    for n in (50, 790, 810, 7990, 8200):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.96)], r.integers(0, 2**63, int(n * 0.03)).astype(np.uint64)]))
        near = jaccard_join.Near(90)
        for s in sorted((a, b), key=len):
            last = near.add(len(s), jaccard_join.signature(s))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert list(last) == [0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def repeated_by_hand(rows, least):
    seen, out = set(), []
    for text in (t or "" for _, t in rows):
        b = text.encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if b[p : p + least] in seen:
                cover[p : p + least] = True
            seen.add(b[p : p + least])
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("tile, batch", [(2_000_000, 1_000_000), (120, 60)])
def test_repeats(spark, monkeypatch, tile, batch):
    monkeypatch.setattr(substring_dedup, "TILE", tile)
    r = random.Random(batch)
    parts = ["".join(r.choice("abé ") for _ in range(r.randint(5, 40))) for _ in range(8)]
    rows = [(i * 3, "".join(r.choice(parts) if r.random() < 0.7 else r.choice("abcd") * r.randint(1, 30) for _ in range(r.randint(0, 6)))) for i in range(40)] + [(500, None), (501, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(spark, rows), least=16, gram=6).collect()}
    assert [got[d] for d, _ in rows] == repeated_by_hand(rows, 16)


def test_repeats_of_repeated_ids(spark, messy):
    out = substring_dedup.substring_dedup(frame(spark, messy), least=16, gram=6)
    assert out.count() == len(messy)
    same = {(r.n_removed, r.kept_sha256) for r in out.where("doc_id = 5 and n_bytes > 1000").collect()}
    assert len(same) == 1
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_run_index():
    r = random.Random(5)
    for _ in range(150):
        t = bytes(r.randrange(1, r.choice([2, 3, 5])) for _ in range(r.randint(1, 60)))
        t += b"\xff" + t[: r.randint(0, len(t))] + b"\xff"
        index = RunIndex(np.frombuffer(t, np.uint8))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert b"".join(bytes([c]) * n for c, n in zip(index.bytes.tolist(), index.lengths.tolist(), strict=True)) == bytes(t[i - 1] for i in order)
        want, before = [0] * len(t), [-1] * len(t)
        for p, q in zip(order[1:], order, strict=False):
            while p + want[p] < len(t) and q + want[p] < len(t) and t[p + want[p]] == t[q + want[p]]:
                want[p] += 1
            before[p] = q if want[p] else -1
        got = index.matching_statistics()
        assert got[0].tolist() == before and got[1].tolist() == want
        key = np.array(r.sample(range(1000), len(t)))
        for least in (1, 2, 5):
            alike = [[key[q] for q in range(len(t)) if t[q : q + least] == t[p : p + least] and p + least <= len(t)] for p in range(len(t))]
            assert index.earlier(key, least).tolist() == [bool(a) and key[p] > min(a) for p, a in enumerate(alike)]


def test_run_index_rests_on_its_samples():
    """A repetitive text has few runs; what the samples say decides all results."""
    text = np.frombuffer(b"a passage that stands many times, word by word; " * 400 + b"\xff", np.uint8)
    index = RunIndex(text)
    assert len(index.bytes) < len(text) / 100
    key = np.arange(len(text))
    assert index.earlier(key, 40).sum() == len(text) - 48 - 40
    index.shared[:] = 0
    assert not index.earlier(key, 40).any()


@pytest.mark.parametrize("slab, piece", [(64, 40), (1 << 20, 1 << 16)])
def test_long_repeats(spark, monkeypatch, slab, piece):
    """Texts of many slabs and stretches of many parts give what whole ones give."""
    monkeypatch.setattr(substring_dedup, "SLAB", slab)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 3)
    r = random.Random(4)
    unit = "".join(r.choice("abcdefgh é") for _ in range(300))
    rows = [(1, unit * 3 + "x" * 200), (2, "y" + unit), (3, "".join(r.choice("abc") for _ in range(500))), (4, unit[50:250] * 2), (5, "x" * 90)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.substring_dedup(frame(spark, rows), least=16, gram=6).collect()}
    assert [got[d] for d, _ in rows] == repeated_by_hand(rows, 16)


def test_memory_of_a_very_long_text():
    """Anchors of 24 MB of text are found within a bound that doesn't depend on the text."""
    import tracemalloc

    data = np.frombuffer(("a line that comes again and again, number %d\n" * 50 % tuple(range(50))).encode() * 10_000, np.uint8)
    tracemalloc.start()
    at, _ = substring_dedup._in_slabs(data, 32, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) and peak < 200 << 20 < 10 * len(data)


def tiles_by_hand(p, t, k):
    mp, mt, k = [0] * len(p), [0] * len(t), min(k, len(p))
    while True:
        best, at = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                best, at = (n, [(i, j)]) if n > best else (best, [*at, (i, j)] if n == best else at)
        if best < max(k, 1):
            return sum(mp)
        for i, j in at:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [1] * best


def test_tiling():
    r = random.Random(1)
    for _ in range(200):
        v = "abcdef"[: r.choice([2, 3, 6])]
        p, t = [r.choice(v) for _ in range(r.randint(1, 14))], [r.choice(v) for _ in range(r.randint(0, 30))]
        seeds = decontaminate.Seeds([7], [" ".join(p)], 3)
        h = words(*buffers(pa.array([" ".join(t)])), MARKS)
        got = [decontaminate.tiled(a, b, k) for _, _, k, a, b in seeds.hits(h[0], h[3])]
        assert sum(got) == tiles_by_hand(p, t, 3)


def test_hash_hits_are_compared():
    """Windows whose hashes meet by chance aren't taken for equal."""
    seeds = decontaminate.Seeds([7], ["a b c d e f"], 3)
    h = words(*buffers(pa.array(["x a b c y u v w z"])), MARKS)
    k, values, first, item, place, table = seeds.tables[0]
    seeds.tables[0] = (k, np.sort(np.append(values, decontaminate.windows(h[0], 3)[5])), np.append(first, first[-1] + 1), np.append(item, 0), np.append(place, 0), np.ones_like(table))
    assert [(a.tolist(), b.tolist()) for *_, a, b in seeds.hits(h[0], h[3])] in ([([0], [1])], [])


def test_repeated_seeds_stay_small():
    """A text that repeats a passage of many items gives each item its own places, not all at once."""
    seeds = decontaminate.Seeds(list(range(3000)), ["one two three four five"] * 3000, 5)
    h = words(*buffers(pa.array(["one two three four five " * 2000])), MARKS)
    sizes = [len(a) for *_, a, _ in seeds.hits(h[0], h[3])]
    assert len(sizes) == 3000 and set(sizes) == {2000}


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_contamination(spark, messy, block):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    w = item.split()
    turned = " ".join(w[8:] + ["x"] + w[:8])
    rows = messy + [(200, f"start {item.upper()} end"), (201, turned), (202, " ".join(w[:8])), (203, " ".join(w[::2])), (204, "short item here"), (205, "here is an item without any id of its own to find"), (206, f"{item} an item without any id of its own")]
    bench = spark.createDataFrame([(1, item, 0.5), (2, None, 0.5), (3, "", 0.5), (4, "short item", 0.5), (4, "short item", 0.1), (None, "an item without any id of its own", 0.2)], "item_id long, text string, coverage double")
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contamination(frame(spark, rows), bench, block_words=block).collect()}
    assert pairs == {(200, 1), (201, 1), (204, 4), (205, None), (206, 1), (206, None)}
    out = decontaminate.decontaminate(frame(spark, rows), bench)
    assert out.count() == len(rows) and {r.doc_id for r in out.where("contaminated").collect()} == {200, 201, 204, 205, 206}
    assert {r.doc_id: (r.n_items, r["items"]) for r in out.where("doc_id >= 204").collect()} == {204: (1, [4]), 205: (1, [None]), 206: (2, [None, 1])}
    kept = decontaminate.drop_contaminated(frame(spark, rows), bench, block_words=block)
    assert kept.columns == frame(spark, []).columns and kept.count() == len(rows) - 5
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0 and decontaminate.drop_contaminated(frame(spark, rows), bench.where("false")).count() == len(rows)
    assert re.sub(r"\W", "", item).isalpha()
