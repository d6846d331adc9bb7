"""The trie and the repair of conversations against plain versions, and languages by held-out accuracy and by hand."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversation_repair, conversations, language_id, prefix_trie

SHAPE = "conv_id long, turn long, role string, text string, depth long, node string, words long, part int, copies long, first boolean, length int"
CLASH = (7, "x", 8, 9, 5, True, 3)


def frame(spark, rows):
    """Turns with extra columns of names that the operators use inside."""
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SHAPE)


def in_order(rows, null):
    """Turns of each conversation, nulls filled in; ties of a turn by their digests."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = null if role is None else role, null if text is None else text
        out[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), t, role, text))
    return {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in out.items()}


def trie_by_hand(rows):
    turns = {c: [(r, x) for _, r, x in v] for c, v in in_order([r for r in rows if r[0] is not None], "").items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (turns.get(c - c % 20, [])[:h] + turns[c][h:]) if c % 20 else turns[c]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def some_turns(r, n, longest=6):
    """Conversations that share their first turns, repeat rows, lack turns, roles and texts."""
    rows = []
    said = ["hi there", "Fine.", "", " ", None, "what now?", "no end", "a b  c", "Über uns!"]
    for c in r.sample(range(-30, 90), n):
        for t in range(r.randint(1, longest)):
            row = (c, None if r.random() < 0.05 else t, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(said))
            rows += [row] * (2 if r.random() < 0.05 else 1)
    r.shuffle(rows)
    return rows


def test_trie(spark):
    r = random.Random(3)
    rows = some_turns(r, 60) + [(None, 0, "user", "no id"), (40, None, None, None)]
    same = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} said") for c in range(100, 140) for t in range(c % 7)]
    got = prefix_trie.conversation_trie(frame(spark, rows + same)).select(*prefix_trie.COLUMNS).collect()
    assert sorted((tuple(x) for x in got), key=lambda x: x[:2]) == trie_by_hand(rows + same)
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0


def test_trie_of_long_conversations(spark):
    """Conversations over several blocks, that part in a later block, at its edge and inside the first."""
    b = conversations.BLOCK
    rows = [(c, t, "user", f"t{t}" if t < part else f"t{t} of {c}") for c, part, n in ((21, 10**9, 2 * b + 5), (22, 2 * b, 2 * b + 3), (23, b + 1, b + 9), (24, 5, b + 2), (25, 10**9, b), (26, 10**9, b + 1), (20, 10**9, 2 * b + 5)) for t in range(n)]
    got = prefix_trie.conversation_trie(frame(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=lambda x: x[:2]) == trie_by_hand(rows)


def test_hot_nodes_meet_their_owners(spark, monkeypatch):
    """Whatever counts as hot, the rows are the same."""
    rows = [(c, t, "user", "same" if t < 2 else f"{c % 9}") for c in range(200) for t in range(4)]
    want = trie_by_hand(rows)
    for share in (1, 10**6):
        monkeypatch.setattr(prefix_trie, "SHARE", share)
        assert sorted((tuple(x) for x in prefix_trie.conversation_trie(frame(spark, rows)).collect()), key=lambda x: x[:2]) == want


def cheapest(turns):
    """The least cost and the edits first in ASCII, by a search over all edit sequences (turns: initial, must go, truncated)."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(turns) and q in (0, 3):
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        nexts = {0: "u", 1: "u", 2: "a", 3: "u"}[q]
        to = {"s": 1, "u": 2, "a": 3}
        heapq.heappush(heap, (cost + 3, audit + "I", i, to[nexts]))
        if i < len(turns):
            initial, gone, late = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if not gone:
                if initial == nexts or (q == 0 and initial == "s"):
                    heapq.heappush(heap, (cost + 3 * late, audit + "K", i + 1, to[initial]))
                heapq.heappush(heap, (cost + 3 + 3 * late, audit + "R", i + 1, to[nexts]))
    raise AssertionError


def repair_by_hand(rows, damage=True):
    ids = {r[0] for r in rows}
    after = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    turns, out = in_order(after, ""), []
    for c in ids:
        mine, seen, plan = turns.get(c, []), set(), []
        n = Counter()
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            plan.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plan, plan[1:]))
        numbers = [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = cheapest(plan)
        lines, i, last = [], 0, ""
        for e in audit:
            wanted = "assistant" if last == "u" else "user"
            if e == "I":
                lines.append(f"{wanted}:")
            else:
                if e != "D":
                    lines.append(f"{wanted if e == 'R' else mine[i][1]}:{mine[i][2]}")
                i += 1
            last = lines[-1][:1] if e != "D" else last
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repair(spark, seed):
    r = random.Random(seed)
    rows = some_turns(r, 70, 9) + [(None, 1, "user", "no id."), (None, None, None, None), (500, None, "tool", "x")]
    got = conversation_repair.conversation_repair(frame(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == repair_by_hand(rows)


def test_repair_of_an_empty_table_and_a_long_conversation(spark):
    assert conversation_repair.conversation_repair(frame(spark, [])).count() == 0
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["One.", "two", f"{t}!", "x" * 5000])) for t in range(6000)]
    rows += [(2, 5, "user", "same.")] * 4000
    got = conversation_repair.conversation_repair(frame(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == repair_by_hand(rows)


def grams_by_hand(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    out = Counter()
    for w in words:
        for n in (1, 2, 3):
            padded = w if n == 1 else f" {w} "
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def packed(g):
    value = 0
    for c in g:
        value = value << 21 | ord(c)
    return value


def languages_by_hand(rows, size):
    """Predictions and scores of (doc_id, text, lang) rows by the definition."""
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], [ord(y) for y in x[0]]))][:size]
    order = lambda c: sorted(c, key=lambda g: (-c[g], packed(g)))[:size]
    learnt = defaultdict(Counter)
    for d, text, lang in rows:
        if lang is not None and text is not None and (d is None or zlib.crc32(str(d).encode()) % 3 != 1):
            learnt[lang] += grams_by_hand(text)
    profiles = {k: {g: i for i, g in enumerate(order(v))} for k, v in learnt.items() if v}
    out = []
    for d, text, _ in rows:
        own = order(grams_by_hand(text))
        far = {k: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k)) if own and far else None
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1, best or "und", round(1 - far[best] / (len(own) * size), 9) if best else 0.0))
    return sorted(out, key=str)


def test_languages_by_hand(spark, messy, monkeypatch):
    r = random.Random(5)
    said = {"en": "the cat and the hat of that", "fr": "le chat et les chapeaux ça été", "ja": "日本語の文章です 猫 と 帽子", "el": "η γάτα και το καπέλο İß"}
    rows = [(i, " ".join(r.choices(said[k].split(), k=r.randint(1, 40))), k) for i, k in enumerate(r.choices(list(said), k=80))]
    rows += [(d, t, None) for d, t in messy] + [(900, None, "en"), (901, "", "fr"), (902, "123 !?", "en"), (903, "the", "en"), (904, "\U0001d400\U0001f600 \U00020000", "zz"), (None, "der hut", "de")]
    docs = spark.createDataFrame([(*x, 1, "p", 0.5) for x in rows], "doc_id long, text string, lang string, gram long, lang_pred string, score double")
    for piece, held in ((1 << 20, 1 << 20), (7, 3)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "HELD_GRAMS", held)
        for size in (400, 5):
            got = language_id.language_id(docs, language_id.train_languages(docs, size)).collect()
            assert sorted(((x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in got), key=str) == languages_by_hand(rows, size)


def test_long_texts_in_pieces():
    text = "Ab  cé, d" * 50 + "x" * 40
    want = Counter({packed(g): n for g, n in grams_by_hand(text).items()})
    for piece in (1, 2, 3, 7, 1000):
        _, gram, count = language_id.long_grams(text, piece)
        assert Counter(dict(zip(gram.tolist(), count.tolist()))) == want


def test_no_languages(spark, messy):
    docs = spark.createDataFrame(messy, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    out = language_id.language_id(docs, language_id.train_languages(docs))
    assert out.count() == len(messy) and out.where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.language_id(docs.limit(0), language_id.train_languages(docs.limit(0))).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train_languages(docs, 4)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(docs, language_id.train_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
