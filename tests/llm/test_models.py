"""Votes, models and scores of operators that SQL cannot express, computed again the plain way."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemolith.llm import quality_classifier as qc
from mnemolith.llm import quality_rules as qr
from mnemolith.llm import textblock as tb
from mnemolith.llm import url_filter as uf

from test_llm import corpus, frame, sentence

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_votes(text: bytes) -> list[int]:
    words = SPACED.findall(text)
    n, some = len(words), max(1, len(words))
    _, _, _, dup, repeated, _ = qr.brute_force(text.decode())
    letters = sum(chr(c).isascii() and chr(c).isalpha() or c >= 128 for c in text)
    symbols = sum(c in b"#*$%&|<>" for c in text) / some
    breaks = text.count(b"\n") + 1
    length = sum(map(len, words)) / some
    capitals = sum(65 <= c <= 90 for c in text) / max(1, letters)
    loud = sum(w.endswith(b"!") for w in words) / some
    marks = sum(len(w) == 1 and not ALNUM.fullmatch(w) for w in words) / some
    weight = {}
    for lists, x in ((qc.MILD, 0.5), (qc.STRONG, 1.0)):
        for group in lists.values():
            weight |= {f: x for w in group.split() for f in qc.spellings(w) if len(f) > 1}
    second = set(qc.SECOND_PERSON.split())
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    said = [(m.group().decode(), text[m.end() : m.end() + 1]) for m in ALNUM.finditer(lower)]
    hostile = aimed = 0.0
    for i, (w, after) in enumerate(said):
        x = weight.get(w, 0.0)
        if x and w in second:
            x = weight[w]
        hostile += x
        if x and (after == b"!" or any(v in second and v not in weight for v, _ in said[max(0, i - qc.NEAR) : i + qc.NEAR + 1])):
            aimed += x
    spoken = len(said)
    vote = lambda bad, good: 0 if bad else 2 if good else 1
    return [
        vote(n < 3, n >= 30),
        vote(symbols > 0.1, symbols < 0.02),
        vote(repeated / some > 0.3, repeated / some < 0.05 and n >= 20),
        vote(dup / breaks > 0.5, dup / breaks < 0.05 and breaks > 2),
        vote(length < 3 or length > 12, 4 <= length <= 9),
        vote(capitals > 0.3, capitals < 0.1 and letters > 0),
        vote(loud > 0.1, loud < 0.01 and n >= 20),
        vote(marks > 0.1, marks < 0.01 and n >= 20),
        vote(hostile > qc.HOSTILE * spoken or (hostile > qc.LESS * spoken and hostile >= qc.SEVERAL), hostile == 0 and spoken >= 20),
        vote(aimed > qc.LESS * spoken, hostile == 0 and spoken >= 20),
    ]


def test_votes():
    rnd = random.Random(6)
    texts = [(t or "").encode() for t in corpus()]
    texts += ["You IDIOT! " * 5, f"{sentence(rnd, 100)} trash {sentence(rnd, 50)}", "NOW! BUY! " * 20, "a | b | c " * 30, "x\n" * 40, f"{sentence(rnd, 30)}, you are a moron and an idiot", "Dummkopf"]
    texts = [t if isinstance(t, bytes) else t.encode() for t in texts]
    got, _ = qc.votes(tb.Block(texts))
    assert got.tolist() == [plain_votes(t) for t in texts]
    assert all(set(got[:, j]) >= {0} for j in (0, 1, 2, 3, 6, 8, 9))


def test_posteriors_are_the_expectation_maximisation():
    rnd = random.Random(3)
    m = len(qc.LABELLERS)
    rows = []
    for _ in range(300):
        kind = rnd.choice([None, None, None, *range(len(qc.FAULTS))])
        rows.append([0 if kind is not None and x in qc.FAULTS[kind] and rnd.random() < 0.7 else rnd.choice([1, 2, 2]) for x in qc.LABELLERS])
    counts = Counter(int(qc.pattern(np.array([v]))[0]) for v in rows)
    got, rates = qc.posteriors(dict(counts))

    kinds = len(qc.FAULTS) + 1
    p = []
    for v in rows:
        bad = [any(v[j] == 0 for j, x in enumerate(qc.LABELLERS) if x in f) for f in qc.FAULTS]
        p.append([0.1, *(0.9 * b / sum(bad) for b in bad)] if any(bad) else [0.95, *([0.05 / len(qc.FAULTS)] * len(qc.FAULTS))])
    for _ in range(qc.ROUNDS):
        share = [(sum(x[k] for x in p) / len(rows) + 1e-4) / (1 + 1e-4 * kinds) for k in range(kinds)]
        rate = [[[sum(x[k] for x, v in zip(p, rows) if v[j] == y) + qc.PRIOR[min(k, 1)][y] * len(rows) for y in (0, 2)] for j in range(m)] for k in range(kinds)]
        rate = [[[y / sum(r) for y in r] for r in of] for of in rate]
        after = []
        for v in rows:
            like = [share[k] * math.prod(max(rate[k][j][v[j] // 2], 1e-12) for j in range(m) if v[j] != 1) for k in range(kinds)]
            after.append([x / sum(like) for x in like])
        p = after
    for v, x in zip(rows, p):
        assert got[int(qc.pattern(np.array([v]))[0])] == pytest.approx(x[0], abs=1e-6)
    assert np.allclose(rates[:, :, [0, 2]], rate, atol=1e-6)


def test_scorer_is_the_gradient_descent():
    rnd = random.Random(8)
    rows = []
    for _ in range(12):
        good = rnd.random()
        which = sorted(rnd.sample(range(20), 6))
        rows.append((good, np.array(which, np.int32), np.array([rnd.random() * 10 + (i < 10) * good * 20 for i in which])))
    w, b = qc.train(rows)
    want, const, squares, square = defaultdict(float), 0.0, defaultdict(lambda: 1e-8), 1e-8
    good, bad = sum(r[0] for r in rows), sum(1 - r[0] for r in rows)
    for _ in range(qc.EPOCHS):
        grad, step = defaultdict(float), 0.0
        for label, which, value in rows:
            z = sum(want[i] * x for i, x in zip(which.tolist(), value.tolist())) + const
            d = (1 / (1 + math.exp(-max(-50, min(50, z)))) - label) * (label * 0.5 / good + (1 - label) * 0.5 / bad)
            step += d
            for i, x in zip(which.tolist(), value.tolist()):
                grad[i] += d * x
        for i in range(20):
            g = grad[i] + 1e-7 * want[i]
            squares[i] += g * g
            want[i] -= qc.RATE * g / math.sqrt(squares[i])
        square += step**2
        const -= qc.RATE * step / math.sqrt(square)
    assert np.allclose(w[:20], [want[i] for i in range(20)], atol=1e-6) and b == pytest.approx(const, abs=1e-6) and not w[20:].any()


def test_ratio_of_ngrams(spark):
    """Counts of exact n-grams give the hashed score but for a few collisions."""
    rnd = random.Random(14)
    texts = [sentence(rnd, 60, "en" if i % 3 else "fr") for i in range(30)] + [None, "", "one"]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 30, 2)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in qr.quality_rules(frame(spark, texts), labels).collect()}
    grams = lambda t: (lambda w: [*((x,) for x in w), *zip(w, w[1:])])(SPACED.findall((t or "").encode()))
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i % 2 == 0 and i < 30:
            target.update(grams(t))
    scale = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + qr.PRIOR) / (n * scale + qr.PRIOR)) for g, n in raw.items()}
    for i, t in enumerate(texts):
        g = grams(t)
        assert got[i] == pytest.approx(sum(ratio[x] for x in g) / max(1, len(g)), abs=3e-3)


def test_models_of_urls(spark):
    """Each verdict without a rule, from exact counts of contexts, and the threshold that sets the examples apart best."""
    rnd = random.Random(4)
    good = [f"http://site{rnd.randrange(9)}.org/{rnd.choice(['news', 'wiki', 'docs'])}/{rnd.randrange(999)}" for _ in range(80)]
    bad = [f"http://shop{rnd.randrange(9)}.com/de/{rnd.choice(['casino', 'pills', 'cheap'])}-{rnd.randrange(999)}" for _ in range(80)]
    rest = [f"http://x{i}.net/{p}/{i}" for i, p in enumerate(["news", "casino", "docs/about", "de/pills", "wiki", "cheap-pills"])]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + rest)], "page_id bigint, url string")
    got = {r.page_id: (r.score, r.verdict) for r in uf.filter_urls(df).collect()}

    digits = lambda u: re.sub(rb"[0-9]", b"0", u[7:].encode())
    counts = [Counter(), Counter()]
    for kind, urls in ((0, good), (1, bad)):
        for u in map(digits, urls):
            for i in range(len(u)):
                for k in range(min(uf.ORDER, i) + 1):
                    counts[kind][(k, "gram", u[i - k : i + 1])] += 1
                    counts[kind][(k, "context", u[i - k : i])] += 1

    def score(u, own=None):
        total = 0.0
        for i in range(len(u)):
            p = [1 / 256, 1 / 256]
            for k in range(min(uf.ORDER, i) + 1):
                for kind in (0, 1):
                    n, of = (max(0, counts[kind][(k, what, u[i - k : i + (what == "gram")])] - (own == kind)) for what in ("gram", "context"))
                    p[kind] = (min(n, of) + uf.SMOOTH * p[kind]) / (of + uf.SMOOTH)
            total += math.log(p[0]) - math.log(p[1])
        return total / max(1, len(u))

    own = sorted([(score(digits(u), 0), 0) for u in good] + [(score(digits(u), 1), 1) for u in bad])
    assert min(s for s, k in own if k == 0) > max(s for s, k in own if k == 1)
    for i, u in enumerate(rest, 160):
        assert got[i][0] == pytest.approx(score(digits(u)), abs=2e-2)
    cut = {got[i][1]: got[i][0] for i in range(160, 166)}
    assert [got[i][1] for i in range(160, 166)] == ["allow", "block", "allow", "block", "allow", "block"] and cut["allow"] > cut["block"]
