"""The trained models against plain versions: character models counted in dictionaries, a recurrent network word by word."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortspark.llm.langid import ORDER, codes, entropies, fit
from cohortspark.llm.toxicity import HIDDEN, INPUTS, WIDTH, WORDS, Net, Scorer, features, gradients, train, windows_of, word_slots


def plain_kneser_ney(texts):
    """probability(history, character, alphabet) of one language, by the textbook."""
    padded = [[0] * (ORDER - 1) + [int(c) for c in codes(x)] for x in texts]
    levels = []
    for n in range(1, ORDER + 1):
        size = min(n + 1, ORDER)
        longer = [tuple(s[i - size + 1 : i + 1]) for s in padded for i in range(ORDER - 1, len(s))]
        counts = Counter(longer) if n == ORDER else Counter(g[1:] for g in set(longer))
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        total, kinds = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        levels.append((counts, total, kinds, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5))

    def probability(history, c, alphabet):
        p = 1 / alphabet
        for n, (counts, total, kinds, d) in enumerate(levels):
            context = tuple(history[len(history) - n :])
            if total[context]:
                p = (max(counts[*context, c] - d, 0) + d * kinds[context] * p) / total[context]
        return p

    return probability


def test_character_models_by_dictionaries():
    rng = random.Random(4)
    made = {"aa": ["ka", "ko", "ta"], "bb": ["sch", "ung", "eit"], "cc": ["que", "eau", "ion", "é"]}
    samples = {k: [" ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(12)) for _ in range(9)] for k, s in made.items()}
    samples["dd"] = ["!", ""]  # a language of hardly any text
    models = fit(samples, checks=10**9)
    plain = {k: plain_kneser_ney(v) for k, v in samples.items()}
    alphabet = len({int(c) for v in samples.values() for x in v for c in codes(x)}) + 1
    texts = ["kako ta", "Schung eitung, que!", "ion", "zzz é", "k", "a" * 300, "\U00030000 ka", samples["cc"][0]]
    got = entropies([codes(x) for x in texts], models)
    for row, x in zip(got, texts, strict=True):
        s = [0] * (ORDER - 1) + [int(c) for c in codes(x)]
        for j, k in enumerate(models.languages):
            bits = [-math.log2(plain[k](s[i - ORDER + 1 : i], s[i], alphabet)) for i in range(ORDER - 1, len(s))]
            assert row[j] == pytest.approx(sum(bits) / len(bits), abs=1e-4), (x, k)


def random_net(seed):
    rng = np.random.default_rng(seed)
    h = HIDDEN
    shapes = {"in": (INPUTS, 6 * h), "in_bias": 6 * h, "uf": (h, 3 * h), "ub": (h, 3 * h), "cf": 3 * h, "cb": 3 * h, "attend": 2 * h, "out": 2 * h, "bias": 1}
    w = {k: (0.5 * rng.standard_normal(s)).astype(np.float32) for k, s in shapes.items()}
    return Net(*(rng.standard_normal(1 << 18).astype(np.float32) for _ in range(2)), w)


def plain_logit(x, w):
    """One window (word, input), word by word."""
    h, s = HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for side, u, c, words in (("f", "uf", "cf", range(len(x))), ("b", "ub", "cb", range(len(x) - 1, -1, -1))):
        state = np.zeros(h)
        for t in words:
            a = (x[t] @ w["in"] + w["in_bias"])[: 3 * h] if side == "f" else (x[t] @ w["in"] + w["in_bias"])[3 * h :]
            b = state @ w[u] + w[c]
            z, r = s(a[:h] + b[:h]), s(a[h : 2 * h] + b[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            states[side, t] = state
    both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(x))])
    e = np.exp(both @ w["attend"] - (both @ w["attend"]).max())
    return float((e / e.sum()) @ both @ w["out"] + w["bias"][0])


def test_network_word_by_word():
    rng, net = random.Random(1), random_net(2)
    docs = [["w%d" % rng.randrange(200) for _ in range(n)] for n in (1, 5, WIDTH, WIDTH + 1, 200)] + [["same"] * 90, []]
    got = Scorer(net).logits(docs)
    w = {k: v.astype(float) for k, v in net.w.items()}
    for z, d in zip(got, docs, strict=True):
        if not d:
            assert z == -math.inf
            continue
        words = sorted(set(d))
        own = dict(zip(words, features(words, word_slots(words), net.word_evidence, net.gram_evidence).astype(float), strict=True))
        _, start, size = windows_of(np.array([len(d)]))
        want = max(plain_logit(np.array([own[x] for x in d[a : a + n]]), w) for a, n in zip(start, size, strict=True))
        assert z == pytest.approx(want, abs=1e-3)


def test_gradients_by_differences():
    rng, w = np.random.default_rng(3), random_net(4).w
    sizes, target, weight = [7, 3, 5], np.array([1, 0, 1], np.float32), np.array([1.0, 0.7, 2.0])
    shown = rng.standard_normal((7, 3, INPUTS)).astype(np.float32)
    mask = (np.arange(7)[:, None] < np.array(sizes)).astype(np.float32)[:, :, None]
    got = gradients(shown, mask, target, weight, w)

    def loss(held):
        z = [plain_logit(shown[:n, k].astype(float), held) for k, n in enumerate(sizes)]
        return sum(c * (math.log1p(math.exp(-v)) if t else math.log1p(math.exp(v))) for v, t, c in zip(z, target, weight, strict=True)) / 3

    exact = {k: v.astype(float) for k, v in w.items()}
    for k, v in exact.items():
        for i in rng.choice(v.size, min(v.size, 12), replace=False):
            sides = []
            for step in (1e-5, -1e-5):
                moved = v.copy()
                moved.ravel()[i] += step
                sides.append(loss({**exact, k: moved}))
            assert got[k].ravel()[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=2e-4, rel=2e-3), (k, i)


def test_training_separates_and_leaves_clean_texts_alone():
    rng = random.Random(7)
    words = [a + b + c for a in "bdgk" for b in "aeiou" for c in ("n", "r", "st")]
    texts, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        if i % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(["horrid", "vile", "foul"])
        texts.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    scorer = Scorer(train(texts[:200], labels[:200]))
    got = scorer.scores([WORDS.findall(x) for x in texts[200:]]) >= 0.3
    by_label = defaultdict(list)
    for hit, label in zip(got, labels[200:], strict=True):
        by_label[label].append(hit)
    assert np.mean(by_label[1]) > 0.9 and np.mean(by_label[0]) < 0.1
    assert train(texts[:3], [0, 0, 0]) is None and train([], []) is None and train(["", "..."], [0, 1]) is None


def test_training_holds_little_at_once():
    """What the driver allocates to learn from a sample of many windows."""
    import tracemalloc

    texts = [" ".join(f"w{(i * 31 + j * 7) % 400}" for j in range(3000)) + (" bad" if i % 2 else "") for i in range(60)]
    tracemalloc.start()
    try:
        assert train(texts, [i % 2 for i in range(60)], epochs=1, least_steps=1) is not None
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
