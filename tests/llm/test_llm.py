"""Each operator against a plain version on small texts, and on nulls, empties, repeats, clashes and empty tables."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as pt
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemolith.llm import bpe_codec, decontaminate, language_crf, license_scan, near_dedup, quality_classifier, quality_rules, suffix_dedup, textblock, token_counts, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["_n2", "_win_id", "_win_node", "node_of_row", "n2", "l2", "w", "n_words", "kept", "score", "node", "t", "row", "label", "band", "spans", "copies", "ids"]


def sentence(rnd, n, lang="en"):
    syllables = {"en": "th er on an re he in ed nd ha at en es of or".split(), "fr": "é eau oi que le ment aux ai ç tion ou è la des".split(), "de": "ung sch keit ü er ä ein ich ver zu der ß en".split()}[lang]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus():
    rnd = random.Random(5)
    texts = [sentence(rnd, rnd.randint(30, 120), "en" if i % 3 else "fr") for i in range(30)]
    passage = sentence(rnd, 90)
    texts += [texts[0], texts[0], texts[1] + " more words", f"{texts[2]} {passage} {texts[3]}", f"{texts[4]} {passage}", passage]
    words = texts[5].split()
    for k in (1, 2, 3):  # near copies of near copies
        words = words[:]
        words[k * 7] = f"changed{k}"
        texts.append(" ".join(words))
    texts += ["", None, " \n\t", "###", "###", "one two", "One, two!", "x" * 3000, "ab " * 900, "日本語 " * 60 + "é" * 500, sentence(rnd, 6000)]
    return texts


def frame(spark, texts, clash=False):
    df = spark.createDataFrame([Row(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    if clash:
        df = df.withColumns({c: F.lit("clash") for c in CLASHING}).withColumn("n_words", F.lit(-1))
    return df


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts, clash=True).unionByName(frame(spark, texts[:1], clash=True)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# Shared arrays.


def test_words_lines_and_hashes():
    block = textblock.Block([b"Ab cd\nab", b"", "é ab".encode()])
    start, end = block.runs(textblock.ALNUM)
    lo, hi = block.of(start)
    assert [(hi - lo).tolist(), [bytes(block.buf[a:b]) for a, b in zip(start, end)]] == [[3, 0, 2], [b"Ab", b"cd", b"ab", "é".encode(), b"ab"]]
    h = block.hashes(block.prefix(textblock.BYTE_LOWER), start, end)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert textblock.ranges(np.array([5, 9]), np.array([2, 1])).tolist() == [5, 6, 9]


# 1


def test_votes_and_classes_of_patterns():
    good = b"This is a plain text of many words. " + b" ".join(b"word%d" % i for i in range(60))
    v, insult = quality_classifier.votes(textblock.Block([good, b"the%%% of### and&&& to$$$ in%%% is### it&&&" * 4, b"you idiot " + good, b""]))
    names = quality_classifier.LABELLERS
    assert v[0][names.index("symbols")] == 2 and v[1][names.index("symbols")] == 0
    assert insult.tolist() == [False, False, True, False]
    p, _ = quality_classifier.posteriors({0: 5, 3**8 - 1: 90, 3**8 - 1 - 2 * 3: 6})
    assert p[3**8 - 1] > 0.9 > 0.2 > p[0] and p[3**8 - 1 - 2 * 3] < 0.5


def test_classifier_rows(spark, docs, nothing, texts):
    out = quality_classifier.classify(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted([*range(len(texts)), 0])
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in out)
    same = {(r.score, r.kept) for r in out if r.doc_id == 0}
    assert len(same) == 1
    assert all(r.kept == (r.score >= 0.5 and r.score + r.posterior >= 1) for r in out)
    blank = {(r.score, r.posterior, r.votes.size) for r in out if not texts[r.doc_id]}
    assert len(blank) == 1 and next(iter(blank))[2] == "bad"
    assert quality_classifier.classify(nothing).count() == 0


def test_hostility_is_weighed_in_several_languages(spark):
    rnd = random.Random(12)
    fill = lambda n, lang: sentence(rnd, n, lang).capitalize() + ".\n" + sentence(rnd, n, lang) + "."
    langs = ("en", "fr", "de")
    clean = [fill(40, langs[i % 3]) for i in range(120)]
    abuse = {"en": ["you jackass", "You are an imbecile!", "your scumbags", "you d1mw1t"], "fr": ["tu es un connard", "Abruti!", "espèce de crétin, toi"], "de": ["du Dummkopf", "ihr seid Trottel!", "du bist ein Vollidiot"]}
    hostile = []
    for i in range(24):
        lang = langs[i % 3]
        hostile.append(" ".join(f"{sentence(rnd, 12, lang)} {rnd.choice(abuse[lang])} {sentence(rnd, 4, lang)}" for _ in range(5)))
    long = [f"{fill(150, 'en')} the {w} was here. {fill(150, 'en')}" for w in ("trash", "clown", "loser", "idiot")]
    out = {r.doc_id: r for r in quality_classifier.classify(frame(spark, clean + hostile + long)).collect()}
    assert not any(out[i].kept for i in range(120, 144))
    assert all(out[i].kept for i in range(144, 148)) and sum(out[i].kept for i in range(120)) == 120


# 2


def test_decontamination(spark, docs, nothing, texts):
    items = [(1, " ".join(texts[7].split()[3:40]).upper()), (2, "One two"), (None, "###"), (4, None), (5, texts[8]), (6, " ".join(texts[7].split()[3:40])), (2, "x y z")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(decontaminate.brute_force([*enumerate(texts), (0, texts[0])], items))
    for most in (4_000_000, 100):  # one automaton, and several in turn
        found = decontaminate.decontaminate(docs, bench, max_symbols=most)
        assert sorted(tuple(r) for r in decontaminate.digest(found).collect()) == expected
    span = found.where("doc_id = 7").first().spans[0]
    assert texts[7][span.start : span.end] == " ".join(texts[7].split()[3:40])
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


# 3


def test_languages(spark, nothing):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, 40, lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    df = spark.createDataFrame([*rows, (None, "no id", "en"), (900, None, "en"), (901, "123 --- 456", "de"), (902, sentence(rnd, 30), None), (0, rows[0][1], "en")], "doc_id bigint, text string, lang string")
    learn = df.where(~language_crf.held_out())
    out = language_crf.identify(df, learn).collect()
    by = {r.doc_id: r for r in out}
    held = {r.doc_id for r in df.where(language_crf.held_out()).collect()}
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows if i in held]) > 0.95
    assert (by[900].lang_pred, by[900].score, by[901].lang_pred) == ("und", 0.0, "und") and by[902].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out) and len(out) == df.count()
    assert {r.lang_pred for r in language_crf.identify(df, learn.limit(0)).collect()} == {"und"}
    assert language_crf.identify(nothing, learn).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, step, begin = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    total = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        s = begin[path[0]] + sum(e[0, i, path[i]] for i in range(4)) + sum(step[path[i], path[i + 1]] for i in range(3))
        for i in range(4):
            total[i, path[i]] += np.exp(s)
    got = language_crf.marginals(e, np.array([4]), step, begin)[0]
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 130, 1000])
def test_long_texts_are_one_chain(n):
    """Links of 64 words give what one chain of all words gives."""
    rng = np.random.default_rng(n)
    sizes = [n, 5, 200, 0, 64]
    hi = np.cumsum(sizes)
    lo = hi - sizes
    score, step, begin = rng.normal(size=(hi[-1], 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32) * 2, rng.normal(size=3).astype(np.float32)
    got = language_crf.chained(score, lo, hi, step, begin, at_once=3)
    for a, z in zip(lo, hi):
        if z > a:
            want = language_crf.marginals(score[None, a:z], np.array([z - a]), step, begin)[0]
            assert np.allclose(got[a:z], want, atol=1e-4)


def test_code_switched_texts(spark):
    rnd = random.Random(2)
    rows = [(i, sentence(rnd, 40, lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    rows += [(1000, sentence(rnd, 8000, "en"), "en")] * 5  # very long, and repeated: learned from once, in pieces
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language_crf.sample(learn, id_col="doc_id", text_col="text", lang_col="lang")
    assert len(sample) == 91 and max(len(t) for _, t in sample) <= language_crf.MAX_CHARS + language_crf.PIECES
    parts = [sentence(rnd, 70, "de"), sentence(rnd, 90, "fr"), sentence(rnd, 60, "en")]
    mixed = " ".join(parts)
    out = language_crf.identify(spark.createDataFrame([(1, mixed), (2, None), (3, "--")], "doc_id bigint, text string"), learn, runs=True).collect()
    right = 0
    for r in out[0].runs:
        right += sum(len(p) for x, p in [(x, p) for x, p in zip(("de", "fr", "en"), parts) if x == r.lang] for p in [mixed[max(r.start, mixed.index(p)) : min(r.end, mixed.index(p) + len(p))]])
    assert right > 0.9 * len(mixed) and out[0].lang_pred == "fr" and out[1].runs == out[2].runs == []
    # The labels of words, the plain way.
    model = language_crf.learn(sample)
    _, _, fixed, word, grams, h = language_crf.word_features(textblock.Block([mixed.encode()]))
    score = model.emissions(fixed, word, grams, h)
    assert np.allclose(language_crf.chained(score, np.array([0]), np.array([len(h)]), model.step, model.begin), language_crf.marginals(score[None], np.array([len(h)]), model.step, model.begin)[0], atol=1e-4)


# 4 and 5

FUZZ = "aaabbbé ñ 'sStT'll\n\n\t  日本語ßüö🙂🙂 123١٢ \x85\xa0 \x1c\x1f.,;!!!###---===́​"


def fuzz():
    rnd = random.Random(3)
    out = ["".join(rnd.choice(FUZZ) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    return [*out, "a" * 5000, " " * 3000 + "x", "=" * 777, "", "<|endoftext|>a<|endoftext|>", "ab" * 999]


def encoding(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_codec_equals_the_library(name, texts):
    path = pt.path(name)
    cases = [*fuzz(), *(t or "" for t in texts)]
    got = bpe_codec.codec(path).encode(cases)
    assert [x.tolist() for x in got] == encoding(path).encode_ordinary_batch(cases, num_threads=1)
    assert all(bpe_codec.codec(path).decode(x) == c.encode() for x, c in zip(got, cases))


def test_replay_takes_lower_ranks_that_a_merge_makes():
    # ab (rank 300) makes, with c, abc of rank 260: lower than its own.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 260, b"ab": 300, b"ca": 280}
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    merges = bpe_codec.Merges(ranks)
    for w in ["abcabc", "ababcab", "caababcca", "ab" * 20 + "c", "a", ""]:
        n, ids = bpe_codec.replay([w.encode()], merges)
        assert ids.tolist() == enc.encode_ordinary(w) and n.tolist() == [len(ids)]


def test_codec_rows(docs, nothing, texts):
    path = pt.path("byte_bpe_multi_50k.tiktoken")
    enc = encoding(path)
    got = {r.doc_id: r for r in bpe_codec.encode(docs, path, as_digest=True).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    full = bpe_codec.encode(docs, path).where("doc_id = 3").first()
    assert bytes(full.decoded).decode() == texts[3]
    assert bpe_codec.encode(nothing, path).count() == 0


def test_counts_equal_the_library(docs, nothing, texts):
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    cases = [*fuzz(), *(t or "" for t in texts)]
    lib = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(cases, add_special_tokens=False)]
    assert token_counts.counter(path).counts(cases) == lib
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        n = lib[len(cases) - len(texts) + i]
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(nothing, path).count() == 0


# 6


def classes(texts):
    """The smallest id of each class, by comparing all pairs."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def shingles(t):
        w = word.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if texts[i] and (texts[i] == texts[j] or (union and len(sets[i] & sets[j]) / union >= 0.8)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, docs, nothing, texts):
    rnd = random.Random(9)
    base = sentence(rnd, 150).split()
    more = list(texts)
    for _ in range(60):  # copies with words left out, which share what that makes
        w = base[:]
        for _ in range(rnd.randint(0, 5)):
            del w[rnd.randrange(0, len(w), 10)]
        more.append(" ".join(w))
    rows = near_dedup.near_duplicates(frame(spark, more, clash=True)).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(classes(more)))
    assert {r.doc_id for r in rows if r.kept} == set(classes(more))
    out = near_dedup.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(classes(texts)))
    assert near_dedup.near_duplicates(nothing).count() == 0 == near_dedup.keep_one(nothing).count()


def test_copies_with_a_repeated_line_are_linked(spark):
    rnd = random.Random(3)
    texts = []
    for i in range(24):
        text = " ".join(f"w{rnd.randrange(10**9)}" for _ in range(104))
        line = " ".join(f"v{rnd.randrange(10**9)}" for _ in range(18))
        texts += [text, text + f"\n{line}" * 1000]  # 100 of 122 shingles
    rows = near_dedup.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i - i % 2 for i in range(48)}


def test_crowded_bands_lose_no_link(spark):
    """Texts of one template, most of them unlike it and each other; whatever meets, however they are joined."""
    rnd = random.Random(31)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(25):
        own = base[:]
        a = rnd.randrange(0, 100)
        own[a : a + 30] = [f"v{rnd.randrange(10**9)}" for _ in range(30)]
        texts.append(" ".join(own))
        for _ in range(rnd.randrange(3)):
            near = own[:]
            near[rnd.randrange(150)] = f"u{rnd.randrange(10**9)}"
            texts.append(" ".join(near))
        texts.append(" ".join(own[: rnd.randrange(90, 118)]))  # within the center but for some
    want = dict(enumerate(classes(texts)))
    for crowded in (0, 10**9):
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, texts), crowded=crowded).collect()}
        assert got == want
    assert len(set(want.values())) > 20


def test_pairs_that_meet_by_what_is_besides_the_center(spark):
    """No similar pair of a crowded band is missed, by all pairs of sets around one center."""
    rnd = random.Random(12)
    center = set(range(300))
    sets = []
    for _ in range(60):
        s = set(rnd.sample(sorted(center), rnd.randrange(60, 290))) | set(rnd.sample(range(1000, 1400), rnd.randrange(0, 120)))
        sets += [s, (s - set(rnd.sample(sorted(s), len(s) // 20))) | set(rnd.sample(range(1000, 1400), len(s) // 25))]
    rows = []
    for i, s in enumerate(sets):
        besides = np.array(sorted(s - center), np.uint64)
        both = len(s & center)
        first = besides[: int(0.2 * len(s) + 1e-9) + 1].tolist()
        more, less = near_dedup._bitmap(besides), near_dedup._bitmap(np.array(sorted(center - s), np.uint64))
        extra = len(s) - both - sum(bin(x & (2**64 - 1)).count("1") for x in more)
        rows.append((7, bytes([i]), (bytes([i]), len(s), 0, 300, more, less, extra), len(s) - both <= int(0.2 * len(s) + 1e-9), [int(x) for x in first]))
    df = spark.createDataFrame([(*r[:2], *r[2][:3], *r[2:]) for r in rows], "band bigint, label binary, node binary, n bigint, u bigint, p struct<node: binary, n: bigint, u: bigint, nx: bigint, more: array<bigint>, less: array<bigint>, extra: bigint>, within boolean, first array<bigint>")
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    for crowded in (0, 1000):
        got = {(r.x[0], r.y[0]) for r in near_dedup.open_pairs(df, crowded).collect()}
        assert want <= got and len(want) > 20 and len(got) < len(sets) * (len(sets) - 1) / 2


def test_registers_estimate_similarity():
    value = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat([0, 1], 900)
    both = np.concatenate((value[:900], value[100:]))  # 800 of 1000
    s = near_dedup.signatures(3, doc, both, np.ones(1800))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15 and (s[0] != 0).all() and not s[2].any()
    # One element fills every register; a heavier weight wins more of them.
    one = near_dedup.signatures(1, np.array([0, 0]), value[:2], np.array([9.0, 1.0]))[0]
    assert set(one.tolist()) <= set(value[:2].tolist()) and (one == value[0]).mean() > 0.7


def test_bound_by_center_never_drops_a_link(spark):
    from mnemolith.llm.near_dedup import LONGS, _bitmap, _bound_by_center

    rnd = random.Random(2)
    rows, truth = [], []
    for _ in range(200):
        center = set(rnd.sample(range(400), 150))
        change = lambda: set(rnd.sample(sorted(center), 150 - rnd.randint(0, 25))) | {1000 + rnd.randrange(40) for _ in range(rnd.randint(0, 20))}  # noqa: B023, E731
        p, q = change(), change()
        arr = lambda s: np.array(sorted(s), np.uint64)

        def side(s, center=center, arr=arr):
            more, less = _bitmap(arr(s - center)), _bitmap(arr(center - s))
            bits = sum(bin(x & (2**64 - 1)).count("1") for x in more)
            return (len(s), len(center), more, less, len(s - center) - bits)

        rows.append((side(p), side(q)))
        truth.append(len(p & q) / len(p | q) >= 0.8)
    s = "struct<n: bigint, nx: bigint, more: array<bigint>, less: array<bigint>, extra: bigint>"
    got = [r.ok for r in spark.createDataFrame(rows, f"p {s}, q {s}").select(_bound_by_center().alias("ok")).collect()]
    assert LONGS == 8 and any(truth) and all(g for g, t in zip(got, truth) if t) and not all(got)


# 7


def test_urls(spark):
    urls = ["http://A.example.ORG/x", "https://example.org/es/1", "https://www.example.org/en/12", "http://example.org/en/2", "ftp://b.com/fr/", "http://b.com/de/?q", "http://b.com", "http://org", "no scheme", None, "", "http://x.net/de/casino", "http://x.net/fr/a#b/c", "http://Ä.ORG/é"] * 3
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = sorted(url_filter.filter_urls(df).collect(), key=lambda r: r.page_id)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for r, u in zip(got, urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = host.translate(lower)
        fit = [x for x in url_filter.RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert {r.verdict for r in got if not r.host} == {"block"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df.where("url like '%x.net%'")).collect()} == {"allow"}


def test_url_models_separate():
    good, bad = [b"a.net/news/%d" % i for i in range(300)], [b"a.net/casino-pills/%d" % i for i in range(300)]
    table = np.zeros((2, 1 << url_filter.BITS), np.int32)
    for kind, urls in ((0, good), (1, bad)):
        for _, _, gram, context in url_filter._grams(textblock.Block(urls)):
            np.add.at(table[kind], gram, 1)
            np.add.at(table[kind], context, 1)
    s = url_filter._log_likelihood(textblock.Block([b"b.net/news/x", b"b.net/casino-pills/x", b""]), table)
    assert s[0] > 0 > s[1] and s[2] == 0


# 8


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(30), 200]:
        for a in (1, 2, 5):
            x = rng.integers(1, a + 1, n)
            assert suffix_dedup.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("crowd", [1500, 1])
def test_repeats(docs, texts, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    want = suffix_dedup.brute_force([(t or "").encode() for t in [*texts, texts[0]]])
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(docs, crowd=crowd).collect()}
    assert got == {i: w for i, w in enumerate(want[:-1])} and any(w[1] for w in want) and any(w[4] for w in want)


def test_equal_hashes_are_compared():
    s = np.array([1, 2, 3, 4, 5, 1, 2, 3, 9, 5, 1, 2, 3, 4, 5])
    i, j = np.array([5, 10, 11, 12, 6, 7]), np.array([0, 0, 1, 2, 1, 2])
    for at_once in (3, 1 << 20):
        assert suffix_dedup.really_equal(s, i, j, 3, at_once).tolist() == [s[a : a + 3].tolist() == s[b : b + 3].tolist() for a, b in zip(i, j)]


def thue_morse(k, a, b):
    out = a
    for _ in range(k):
        out, other = out + out.translate(bytes.maketrans(a + b, b + a)), None
    return out


@pytest.mark.parametrize("crowd", [1500, 0])
def test_patterns_on_which_sums_modulo_a_power_of_two_agree(spark, crowd):
    """Thue-Morse words and their complements, around 64 bytes that both texts have: nothing of 400 bytes is in both."""
    rnd = random.Random(3)
    mid = "".join(rnd.choice("abcdefgh") for _ in range(64)).encode()
    t = thue_morse(8, b"J", b")")
    c = t.translate(bytes.maketrans(b"J)", b")J"))
    pairs = [(t + mid + c + t[:160], c + mid + t + c[:160]), (t + t[:80] + mid + t + c[:80], c + c[:80] + mid + c + t[:80])]
    long = [(b" ".join([w] + [b"w%d" % i for i in range(49)])) for w in (thue_morse(9, b"J", b")"), thue_morse(9, b")", b"J"))]
    for a, b in [*pairs, tuple(long)]:
        want = suffix_dedup.brute_force([a, b])
        got = sorted(suffix_dedup.digest(frame(spark, [a.decode(), b.decode()]), crowd=crowd).collect())
        assert [tuple(r)[1:] for r in got] == want


def test_fingerprints_are_polynomials():
    rng = np.random.default_rng(8)
    v = rng.integers(0, suffix_dedup.PRIME, 70_000, dtype=np.uint64)
    x, span = 2**60 + 12345, 57
    start = np.array([0, 1, 500, 65_536, len(v) - span])
    want = [sum(int(v[s + i]) * pow(x, i, suffix_dedup.PRIME) for i in range(span)) % suffix_dedup.PRIME for s in start.tolist()]
    assert suffix_dedup.fingerprints(v, start, span, x).tolist() == want
    a = rng.integers(0, suffix_dedup.PRIME, 1000, dtype=np.uint64)
    b = np.concatenate((a[1:], [suffix_dedup.PRIME - 1])).astype(np.uint64)
    assert suffix_dedup.product(a, b).tolist() == [int(i) * int(j) % suffix_dedup.PRIME for i, j in zip(a, b)]


def test_long_texts_are_cut_without_losing_or_doubling_windows(spark, monkeypatch):
    rnd = random.Random(21)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000))
    words = long.split()
    texts = [long, f"{sentence(rnd, 100)} {' '.join(words[2000:2060])} {sentence(rnd, 20)}", "z" * 5000, " ".join(words[:51])]
    want = suffix_dedup.brute_force([t.encode() for t in texts])
    df = frame(spark, texts).coalesce(1)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    units = (suffix_dedup.BYTES, suffix_dedup.WORDS)
    rows = [r for b in suffix_dedup._places(units)([df.select("text").toArrow().to_batches()[0]]) for r in b.to_pylist()]
    place = [(r["unit"], r["bucket"], r["stretch"]) for r in rows if r["n"] == 1 and r["lo"] < 20000 and r["node"] == hashlib.sha256(long.encode()).digest()[:16]]
    assert len(place) > 50 and len(set(place)) == len(place)
    assert [tuple(r)[1:] for r in sorted(suffix_dedup.digest(df).collect())] == want


def test_repeats_rewritten(spark, docs, nothing, texts):
    clashing = docs.withColumns({c: F.lit("clash") for c in ("_n2", "node_of_row", "node_of_text", "Kept_Text", "a.b")})
    raw = [(t or "").encode() for t in [*texts, texts[0]]]
    for units in ((suffix_dedup.BYTES,), (suffix_dedup.BYTES, suffix_dedup.WORDS)):
        out = suffix_dedup.remove_repeats(clashing, size_col="n_chars", units=units)
        assert out.columns == clashing.columns
        runs = [suffix_dedup.brute_runs(raw, u) for u in units]
        want = [suffix_dedup.without(t, suffix_dedup.merged([x for u in runs for r in u[i] for x in r])).decode("utf-8", "ignore") for i, t in enumerate(raw)]
        for r in out.collect():
            assert (r.text is None) == (texts[r.doc_id] is None) and r._n2 == "clash"
            assert (r.text or "") == want[r.doc_id] and r.n_chars == len(r.text or "")
    assert suffix_dedup.digest(nothing).count() == 0 == suffix_dedup.remove_repeats(nothing).count()


def test_passages_of_fifty_words_go(spark):
    """Short words: 51 of them are far below the bytes of the other unit."""
    rnd = random.Random(23)
    passage = " ".join(rnd.choice("abcdefgh") + rnd.choice("ijklmn") for _ in range(51))
    short = " ".join(passage.split()[:49])
    texts = [f"{sentence(rnd, 30)} {p} {sentence(rnd, 30)}" for p in (passage, passage.replace(" ", "\n"), short, short)]
    out = [r.text for r in sorted(suffix_dedup.remove_repeats(frame(spark, texts), units=(suffix_dedup.WORDS,)).collect())]
    assert [len(x.split()) for x in out] == [60, 60, 109, 109]


# 9


def test_licenses(spark, docs, nothing):
    assert license_scan.digest(license_scan.scan(nothing)).count() == 0
    notice = license_scan.NOTICES[8][1]
    cases = [
        "Apache license, APACHE-LICENSE and the MIT licence",
        None,
        "",
        "gnu general public",
        f"x {notice}",
        f"word {' '.join(notice.split()[:9])} inserted {' '.join(notice.split()[9:])}",
        "cc by cc by",
        "GNU General\nPublic License v3, cc-by",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(cases)] + [(0, cases[0], 1)], "doc_id bigint, text string, row int")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.digest(license_scan.scan(df)).collect()}
    assert got[0] == (8, 2, 0, 2, "apache", "apache", 1.0)
    assert got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3][1] == 0 and got[4][5] == "mit" and got[4][1] == 0 and got[5][5] == "mit" and got[5][6] < 1
    assert got[6][1:4] == (2, 0, 2) and got[7][4] == "cc-by,gpl"
    assert license_scan.digest(license_scan.scan(docs)).count() == docs.count()


# 10


def test_quality_rules(spark, docs, nothing, texts):
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1)], "doc_id bigint, quality int")
    out = quality_rules.quality_rules(docs, labels).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_rules.brute_force(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    assert len(out) == docs.count()
    rows = quality_rules.quality_rules(docs, labels, whole_rows=True).where("kept").select("row.*")
    assert rows.columns == docs.columns
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert {r.score for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def test_lines_and_windows():
    for t in ["a b\na b\n\n \na b", "one two three four five six seven eight " * 3, "a b c d e f g h a b c d e f g h", "x"]:
        block = textblock.Block([t.encode(), b"other"])
        ratios = np.zeros(1 << quality_rules.BITS, np.float32)
        got = [int(x[0]) for x in quality_rules.measure(block, ratios, 0.0)[:5]]
        assert tuple(got) == quality_rules.brute_force(t)[:5]


def test_ratio_rejects_what_the_trusted_lack(spark):
    rnd = random.Random(4)
    good = [sentence(rnd, 60) for _ in range(60)]
    junk = [" | ".join(sentence(rnd, 40).split()) for _ in range(20)]
    df = frame(spark, good + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality_rules.quality_rules(df, labels).where("kept").collect()}
    assert kept == set(range(60))


def test_every_trusted_document_is_counted(spark):
    """More trusted ids than a fixed bound of 20,000, most of them absent, some repeated or null."""
    words = [("alpha beta", 1), ("gamma delta", 2), ("alpha beta", 2), ("epsilon", None), (None, 3)]
    docs = spark.createDataFrame([(i, t) for t, i in words], "doc_id bigint, text string")
    labels = spark.range(-30000, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    labels = labels.union(labels.where("doc_id = 1")).union(spark.createDataFrame([(None, 1)], "doc_id bigint, quality int"))
    rows = quality_rules.count_ngrams(docs, labels.where("quality = 1"), id_col="doc_id", text_col="text").collect()
    assert (sum(r.raw for r in rows), sum(r.target for r in rows)) == (10, 3)
    # Labels without documents change nothing.
    rnd = random.Random(6)
    texts = frame(spark, [sentence(rnd, 40, "en" if i % 2 else "fr") for i in range(40)])
    present = spark.range(0, 40, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    absent = spark.range(1000, 61000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    a, b = ({r.doc_id: r.score for r in quality_rules.quality_rules(texts, x).collect()} for x in (present, present.union(absent)))
    assert a == b and a[0] > a[1]


# The pipeline.


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    rnd = random.Random(8)
    plain = [sentence(rnd, 80) for _ in range(25)]
    passage = sentence(rnd, 100)
    rows = [*plain, plain[0], plain[1] + " tail", f"{plain[2]} {passage} end", f"{passage} {sentence(rnd, 40)}", plain[3].replace(plain[3].split()[5], "other", 1), None, "short", " | ".join(sentence(rnd, 60).split())]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(plain[4].split()[:30]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_array_dedup", "decontamination", "byte_bpe"]

    # The same, stage by stage, the plain way; only the ratio's verdict comes from the operator.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()}
    assert kept >= set(range(25)) and not kept & {30, 31, 32}
    ids = sorted(kept)
    cls = classes([rows[i] for i in ids])
    ids = [ids[k] for k in sorted(set(cls))]
    raw = [rows[i].encode() for i in ids]
    bytes_, words = (suffix_dedup.brute_runs(raw, u) for u in (suffix_dedup.BYTES, suffix_dedup.WORDS))
    left = {i: suffix_dedup.without(t, suffix_dedup.merged([x for r in (*p, *q) for x in r])).decode() for i, t, p, q in zip(ids, raw, bytes_, words)}
    assert sum(len(left[i]) < len(rows[i]) for i in ids) >= 2
    marked = decontaminate.brute_force(sorted(left.items()), [(1, " ".join(plain[4].split()[:30]))])
    final = {r[0] for r in marked if not r[5]}
    assert set(got) == final and 4 not in final and 25 not in final
    enc = encoding(pt.path("byte_bpe_multi_50k.tiktoken"))
    for i in final:
        assert got[i].ids == enc.encode_ordinary(left[i]) and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256(left[i].encode()).hexdigest()


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns; then no rows at all."""
    import corpus_pipeline

    rnd = random.Random(18)
    plain = [sentence(rnd, 80) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(0, plain[0]), (0, plain[0]), (None, sentence(rnd, 80)), (None, None), (40, None), (41, ""), (42, sentence(rnd, 30000))]
    df = spark.createDataFrame([Row(i, t, "en", None, None) for i, t in rows], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})
    for name, n in (("some", 100), ("none", 0)):
        d = f"{tmp_path}/{name}"
        df.limit(n).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id bigint, text string").limit(n).write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int").limit(n).write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == df.columns
            out.write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
        assert sorted((r.doc_id is None, r.doc_id) for r in docs.select("doc_id").collect()) == ([(False, i) for i in (*range(12), 42)] + [(True, None)] if n else [])


def test_a_text_meets_others_once_for_all_bands_of_a_center(spark):
    """Rows by shingles grow with the texts of a center, not with the bands that they share; pairs stay the same."""
    rnd = random.Random(5)
    center = set(range(200))
    rows, sets = [], []
    for i in range(40):
        s = set(rnd.sample(sorted(center), rnd.choice((100, 170)))) | set(rnd.sample(range(1000, 1200), rnd.choice((30, 80))))
        sets += [s, (s - set(rnd.sample(sorted(s), 5))) | {2000 + i}]
    for i, s in enumerate(sets):
        besides = np.array(sorted(s - center), np.uint64)
        more, less = near_dedup._bitmap(besides), near_dedup._bitmap(np.array(sorted(center - s), np.uint64))
        extra = len(besides) - sum(bin(x & (2**64 - 1)).count("1") for x in more)
        p = (bytes([i]), len(s), 0, 200, more, less, extra)
        rows += [(band, b"x", bytes([i]), *p[:3], p, len(besides) <= int(0.2 * len(s) + 1e-9), besides[: int(0.2 * len(s) + 1e-9) + 1].astype(np.int64).tolist()) for band in range(24)]
    df = spark.createDataFrame(rows, "band bigint, x binary, label binary, node binary, n bigint, u bigint, p struct<node: binary, n: bigint, u: bigint, nx: bigint, more: array<bigint>, less: array<bigint>, extra: bigint>, within boolean, first array<bigint>")
    assert near_dedup.by_shingle(df, "x").count() == sum(len(r[-1]) for r in rows[::24])
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    got = [(r.x[0], r.y[0]) for r in near_dedup.open_pairs(df, 0, "x").collect()]
    assert want <= set(got) and len(want) >= 40 and len(got) == len(set(got))


def test_places_alone_in_their_bucket_are_not_dealt(spark):
    """All places are stored only until those of shared buckets are known; texts that differ leave none."""
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(200)) for _ in range(12)]
    shared = " ".join(f"s{rnd.randrange(10**9)}" for _ in range(120))

    class Watched(suffix_dedup.Stored):
        alive, seen = {}, []

        def write(self, df):
            out = super().write(df)
            self.alive[out.stored_at] = out.count()
            self.seen.append(dict(self.alive))
            return out

        def drop(self, *tables):
            super().drop(*tables)
            for t in tables:
                del self.alive[t.stored_at]

    store = Watched(spark)
    _, spans = suffix_dedup.repeated_spans(frame(spark, [*texts, texts[0] + " a " + shared, texts[1] + " b " + shared]), units=(suffix_dedup.BYTES, suffix_dedup.WORDS), store=store)
    assert spans.count() == 4
    first = next(iter(store.seen[0]))
    assert sum(first in s for s in store.seen) <= 3 and store.seen[1][f"{store.folder}/2"] < store.seen[0][first]
    places = spark.createDataFrame([(0, b, bytes([i]), b"n", 0, 9, n) for i, (b, n) in enumerate([(1, 1), (2, 1), (2, 1), (3, 2), (None, 2)])], suffix_dedup._PLACES)
    assert sorted(r.bucket for r in suffix_dedup.shared_places(places).collect()) == [2, 2, 3]
