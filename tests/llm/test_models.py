import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import boosted_trees, lm_score, quality_rules, toxicity
from lodestone.llm.gated_network import Network, tokens, windows

from .conftest import frame


def counts_by_hand(text):
    b = (text or "").encode()
    w = b.split()
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, mark = Counter(five), set()
    for i, x in enumerate(five):
        if many[x] > 1:
            mark |= set(range(i, i + 5))
    lines = [x for x in b.split(b"\n") if x.split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(mark))


def test_quality_counts(spark, messy):
    got = quality_rules.quality_rules(frame(spark, messy), None)
    rows = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert rows == sorted(counts_by_hand(t) for _, t in messy)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality_rules.quality_rules(frame(spark, []), None).count() == 0


def test_repeat_words_with_many_kinds():
    r = np.random.default_rng(1)
    ids = np.concatenate([np.arange(9000), r.integers(0, 9000, 50), np.arange(10)])
    assert quality_rules.repeat_words(ids, 9000) == counts_by_hand(" ".join(f"w{i}" for i in ids))[4]


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.fold(F.col("doc_id")) == 2
    forest = quality_rules.train_quality(docs, labels.where(~held))
    got = quality_rules.quality_rules(docs, forest).join(labels.where(held), "doc_id").select(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int").alias("hit"))
    assert got.agg(F.avg("hit")).first()[0] > 0.95


def test_no_labels(spark, messy):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train_quality(frame(spark, messy), none) is None and toxicity.train_toxicity(frame(spark, messy), none) is None
    out = toxicity.toxicity(frame(spark, messy), None)
    assert out.count() == len(messy) and out.where("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.drop_toxic(frame(spark, messy), None).count() == len(messy)


def test_trees_keep_to_constraints():
    r = np.random.default_rng(2)
    x = r.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * r.random(600) > 0.6).astype(float)
    forest = boosted_trees.train(x, y, np.array([1, 0, -1]))
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.9
    at = r.random((50, 3))
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(at, 20, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(forest.margin(grid).reshape(50, 20), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_scores_are_those_of_a_walk():
    """Each row through each tree, node by node, from the root to a leaf."""
    r = np.random.default_rng(4)
    x = r.random((300, 4))
    forest = boosted_trees.train(x, (x[:, 0] * x[:, 1] + 0.1 * r.random(300) > 0.3).astype(float), np.array([0, 1, -1, 0]), trees=12)
    for row in x:
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_gradients():
    net, t = Network(3), tokens([b"a bad word here and more", b"x yz", b"", b"same same"])
    start, size, owner = windows(t.rows, 4, 3)
    assert owner.tolist() == [0, 0, 1, 3] and (start + size <= t.rows[owner + 1]).all()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, keep, w = net.inputs(t), {}, np.array([0.3, -0.5, 0.7, 0.2])
    net.forward(x, start, size, 4, keep)
    g, dx = net.gradients(x, keep, w)
    g |= net.table_gradients(t, dx)
    r = random.Random(4)
    for k, p in net.p.items():
        spots = [tuple(r.randrange(n) for n in p.shape) for _ in range(4)] if k not in ("word", "piece") else [(int(t.word[2] if k == "word" else t.piece[5]), 1)]
        for s in spots:
            old, loss = p[s], []
            for d in (1e-3, -1e-3):
                p[s] = old + d
                loss.append((w * net.forward(net.inputs(t), start, size, 4)).sum())
            p[s] = old
            assert abs((loss[0] - loss[1]) / 2e-3 - g[k][s]) < 2e-4, k


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels, "doc_id", "left_semi")
    out = toxicity.toxicity(docs, toxicity.train_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    order = sorted(out, key=lambda x: x.score)
    ranks = [i + 1 for i, x in enumerate(order) if x.toxic]
    yes, no = len(ranks), len(out) - len(ranks)
    assert (sum(ranks) - yes * (yes + 1) / 2) / (yes * no) > 0.9
    assert sum(x.predicted == x.toxic for x in out) > 0.94 * len(out)


def test_windows_cover_all():
    rows = np.cumsum([0, 0, 1, 47, 48, 49, 200])
    start, size, owner = windows(rows, 48, 32)
    seen = np.zeros(rows[-1], bool)
    for s, n in zip(start, size, strict=True):
        seen[s : s + n] = True
    assert seen.all() and (np.diff(start)[np.diff(owner) == 0] <= 32).all()


def test_language_models(spark, messy):
    docs = frame(spark, messy)
    targets = spark.createDataFrame([(1,), (1,), (None,), (20,), (21,)], "doc_id long")
    m = lm_score.train_models(docs, targets, vocabulary=5, classes=3)
    got = lm_score.lm_score(docs, m, classes=3).collect()
    assert len(got) == len(messy)
    # by hand: the same tokens, counted one by one
    size, pairs, per = 8, Counter(), {}
    import pyarrow as pa

    for n, (d, text) in enumerate(messy):
        ids, _ = lm_score.token_ids(pa.array([text], pa.string()), m.known, 3)
        seq = [size, *ids.tolist()]
        per[n] = list(zip(seq, seq[1:], strict=False))
        pairs.update(per[n])
    target = Counter(x for n, (d, _) in enumerate(messy) if d in (1, 20, 21) for x in per[n])
    scale = sum(target.values()) / sum(pairs.values())

    def loss(counts, seq):
        single, total = Counter(), sum(counts.values())
        for (_, b), c in counts.items():
            single[b] += c
        out = 0.0
        for a, b in seq:
            n, kinds = sum(c for (x, _), c in counts.items() if x == a), sum(1 for (x, _), c in counts.items() if x == a)
            trust = n / (n + kinds) if n else 0
            out -= math.log(trust * (counts.get((a, b), 0) / n if n else 0) + (1 - trust) * (single[b] + 1) / (total + size))
        return out / len(seq) if seq else 0.0

    scaled = {k: v * scale for k, v in pairs.items()}
    want = sorted((len(s), round(loss(target, s), 4), round(loss(scaled, s), 4)) for s in per.values())
    have = sorted((r.n_tokens, round(r.target_loss, 4), round(r.background_loss, 4)) for r in got)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 and abs(a[2] - b[2]) < 2e-3 for a, b in zip(have, want, strict=True))
    assert lm_score.lm_score(frame(spark, []), m, classes=3).count() == 0
    same = lm_score.lm_score(docs, lm_score.train_models(docs, targets.where("false"), 5, 3), 3)
    assert same.where("abs(score) > 1e-6").count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 21])
def test_language_models_of_all_words(spark, messy, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", chunk)
    rare = [(100, "one rareaax two"), (101, "one rareaax two"), (102, "one rarebbx two")]
    rows = messy + rare
    docs = frame(spark, rows).repartition(3)
    targets = spark.createDataFrame([(1,), (1,), (None,), (5,), (20,), (100,), (999,)], "doc_id long")
    got = lm_score.corpus_scores(docs, targets).collect()
    texts = [[b"", *(text or "").encode().lower().split()] for _, text in rows]
    is_target = [d in (1, 5, 20, 100) for d, _ in rows]
    every = [list(zip(w, w[1:], strict=False)) for w in texts]
    size = len({b for x in every for _, b in x})

    def model(chosen, scale):
        pairs = Counter(p for x in chosen for p in x)
        single, history, kinds = Counter(), Counter(), Counter(a for a, _ in pairs)
        for (a, b), n in pairs.items():
            single[b] += n * scale
            history[a] += n * scale
        total = sum(single.values())

        def loss(x):
            out = 0.0
            for a, b in x:
                low = (single[b] + 1) / (total + size)
                seen = history[a] + kinds[a]
                out -= math.log((pairs[a, b] * scale + kinds[a] * low) / seen if seen else low)
            return out / max(len(x), 1)

        return loss, sum(pairs.values())

    chosen = [x for x, t in zip(every, is_target, strict=True) if t]
    target, n = model(chosen, 1)
    background, _ = model(every, n / sum(map(len, every)))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = sorted(((d, len(x), target(x), background(x)) for (d, _), x in zip(rows, every, strict=True)), key=key)
    have = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key)
    for a, b in zip(have, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
    by_id = {r.doc_id: r.target_loss for r in got}
    assert by_id[100] == by_id[101] < by_id[102]  # words of one length and last letter are told apart
    assert lm_score.corpus_scores(frame(spark, []), targets).count() == 0
    assert lm_score.corpus_scores(docs, targets.where("false")).where("abs(score) > 1e-9").count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in p.STAGES[1:]:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "secrets":
            assert out.count() == docs.count() and out.where("text rlike '[0-9a-f]{24}'").count() == 0


def test_toxicity_scores_are_those_of_a_walk():
    """Each window of a text read word by word in both directions, its states pooled, the worst window's score taken."""
    r = random.Random(13)
    net = Network(5)
    net.scale, net.shift = 1.7, -0.4
    vocabulary = ["bad", "worse", "straße", "fine", "日本", "x", "longerword"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)).encode() for n in (1, 5, 47, 48, 49, 80, 81, 200)] + [b"", b"  "]
    h, p = net.p["a_state"].shape[0], net.p

    def states(x, d):
        out, state = [None] * len(x), np.zeros(h)
        for i in range(len(x)) if d == "a" else reversed(range(len(x))):
            gx, gh = x[i] @ p[f"{d}_in"] + p[f"{d}_bias"], state @ p[f"{d}_state"]
            z, keep = (1 / (1 + math.e ** -(gx[k * h : k * h + h] + gh[k * h : k * h + h])) for k in (0, 1))
            new = np.tanh(gx[2 * h :] + keep * gh[2 * h :])
            state = new + z * (state - new)
            out[i] = state
        return np.array(out)

    for text, got in zip(texts, toxicity.scores(net, texts), strict=True):
        t = tokens([text])
        x, n = net.inputs(t)[:-1].astype(float), len(t.word)
        if not n:
            assert got == 0
            continue
        starts = sorted({min(k, max(n - toxicity.WIDTH, 0)) for k in range(0, max(n - toxicity.WIDTH, 0) + toxicity.STEP, toxicity.STEP)})
        worst = -math.inf
        for i in starts:
            part = x[i : i + toxicity.WIDTH]
            both = np.concatenate([states(part, "a"), states(part, "b")], axis=1)
            weight = np.exp(np.tanh(both @ p["attend"]) @ p["focus"])
            worst = max(worst, float((weight / weight.sum()) @ both @ p["out"] + p["bias"][0]))
        assert got == pytest.approx(1 / (1 + math.exp(-(net.scale * worst + net.shift))), abs=1e-5)
