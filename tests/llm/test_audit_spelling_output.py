"""Source divergence, spelling variants and token files against plain versions, and on nulls, empties, ties, repeats, clashes and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as pt
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemolith.llm import divergence, spelling, token_output

from test_llm import SCHEMA, sentence

CLASH = ["id", "word", "n", "term", "d", "value", "part", "ids", "row", "digest", "start", "texts", "key", "shape", "item"]


def frame(spark, rows):
    df = spark.createDataFrame([Row(i, t, lang, s, 0) for i, t, lang, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = [(i, sentence(rnd, rnd.randint(20, 200), lang).upper() if i % 7 == 0 else sentence(rnd, rnd.randint(20, 200), lang), lang, f"src{i % 4}") for i, lang in enumerate(["en", "fr"] * 30)]
    out += [(1, out[1][1], "fr", "src1"), (1, out[1][1], "fr", "src1"), (None, "ab cd ab", None, None), (90, None, "en", "none"), (91, "", "", ""), (92, "12 34 !", "en", "digits"), (93, "solo words", "it", "a"), (94, "other words", "it", "b"), (95, "x", "it", "b")]
    out += [(96, "word " * 4000 + "q" * 3000 + " " + "q" * 2999, "en", "src0")] * 3
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


# 11


def plain_audit(rows, top):
    counts, with_, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(words)
        with_[lang].update(set(words))
        groups.add((lang, source))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in with_[lang].items() if d >= 3]
        n = {s: {t: counts[lang, s][t] for t in kept} for la, s in groups if la == lang}
        whole = {t: sum(n[s][t] for s in n) for t in kept}
        p = lambda c, c_of: 1 + 10**9 * (c + 1) // (sum(c_of.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        mine = {t: p(n[source][t], n[source]) for t in kept}
        pairs = [(sum(f(mine[t], p(n[s][t], n[s])) for t in kept), s) for s in n if s != source]
        terms = [(f(mine[t], p(whole[t], whole)), t) for t in kept if n[source][t] and mine[t] > p(whole[t], whole)]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize(("block", "tile", "top"), [(2048, 128, 200), (7, 2, 5)])
def test_audit_equals_plain_version(docs, rows, block, tile, top):
    got = divergence.audit(docs, block=block, tile=tile, top=top).collect()
    assert len(got) == len(set(got))
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == plain_audit(rows, top)
    assert ("it", "a", "pair", "b", 0, 1) in {tuple(r)[:6] for r in got}


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trees_share_nodes_and_price_each_pair_once():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.3, (9, 300))
    counts[4] = counts[2]
    trees = divergence.Trees(counts)
    assert trees.root[4] == trees.root[2] and len(trees.children) == 9
    k, a, b, places = trees.pairs_of_leaves(trees.root[0], trees.root[[2, 4]])
    assert len(k) < 40 and places.sum() == 2 * 512
    total = counts.sum(1)
    there, back = divergence.price_pairs(trees, total, 300, np.arange(9), np.arange(9))
    for i in range(9):
        for j in range(9):
            p, q = divergence.shares(counts[i], total[i], 300), divergence.shares(counts[j], total[j], 300)
            assert there[i, j] == divergence.cost(p, q).sum() and back[i, j] == divergence.cost(q, p).sum()


def test_shares_of_counts_beyond_64_bits():
    big = np.array([10**12, 3])
    assert divergence.shares(big, 10**12 + 3, 2).tolist() == [1 + 10**9 * (10**12 + 1) // (10**12 + 5), 1 + 10**9 * 4 // (10**12 + 5)]


# 12


def plain_spelling(rows):
    n = Counter()
    for id_, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= 5}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    found = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), c, len(found[w]), words.get(form[w])) for w, c in words.items()}


@pytest.fixture(scope="module")
def misspelled():
    rnd = random.Random(4)
    words = ["garden", "gardens", "gaarden", "ardens", "hélène", "hélénne", "letters", "lettérs", "aaaaaaa", "aaaaaa", "aaaaaaaa", "zebras", "WINDOW", "windowÿ", "x×y÷zz"]
    out = []
    for i in range(400):
        weight = [1000, 190, 30, 5, 60, 12, 40, 40, 9, 50, 7, 20, 30, 4, 8]
        out.append((i % 350, " ".join(rnd.choices(words, weight, k=12)), "en", "s"))
    long = "lmno" * 1500
    out += [(500 + i, f"{long} {long[:4000]}q{long[4001:]} {long[1:]}", "en", "s") for i in range(6)]
    return [*out, (None, "garden " * 9, "en", "s"), (7, None, "en", "s"), (8, "", "en", "s"), (9, "...", "en", "s")]


def test_spelling_equals_plain_version(spark, rows, misspelled):
    for x in (misspelled, rows):
        got = spelling.group(frame(spark, x)).collect()
        assert len(got) == len(set(got))
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_spelling(x)
    assert any(f and r != f for _, f, r, *_ in plain_spelling(misspelled))


@pytest.mark.parametrize("symbols", [1, 2, 16])
def test_any_number_of_symbols_finds_the_same(spark, misspelled, symbols):
    got = spelling.group(frame(spark, misspelled[:200]), symbols=symbols, often=2).count()
    assert got == spelling.group(frame(spark, misspelled[:200]), often=2).count()
    words = spark.createDataFrame([("garden", 1), ("gardens", 2), ("barden", 3), ("hidden", 4)], "word string, n bigint")
    pairs = {(r.a, r.b) for r in spelling.near_words(words, symbols=symbols).collect()}
    assert pairs == {("garden", "gardens"), ("gardens", "garden"), ("garden", "barden"), ("barden", "garden")}


def test_spelling_of_nothing(spark):
    assert spelling.group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbourhoods_are_full():
    for w in (b"abca", b"aa", b"h", b"abcdefgh" * 5):
        near = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        near |= {w[:i] + bytes([c]) + w[i + k :] for i in range(len(w) + 1) for c in b"abcdefgh" for k in (0, 1) if i < len(w) or not k}
        assert set(spelling._neighbours(w, 8).tolist()) == set(spelling._shape_hashes(sorted(near)).tolist())


# 13

VOCABULARY = "byte_bpe_50k.json"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pt.path(VOCABULARY))


def test_encoder_equals_library():
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a  b", "\n", "a \n b", "a \n\n  b c", "x <|endoftext|> y", "a<|endoftext|> ", "\t a  b", "don't  stop", "a\x1c b \x1d c", "a \x85b", "日本 語 ", "\n\x1f", " \n\x1f"]
    texts += [f"a {c}b  {c} c{c} {c}{c}" for c in "\x1c\x1f\x85\xa0¡é\u1680\u2000\u200b\u2013\u2028\u202f\u205f\u2603\u3000\u3042😀"]
    texts += ["".join(rnd.choice(["a", " ", "  ", "\n", "'s", "1", "!", "é", " ", "<|endoftext|>", "\x1f", "\xa0", "longer", "語"]) for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    for limit in (5, 400_000):
        e = token_output.Encoder(pt.path(VOCABULARY), limit)
        assert [x.tolist() for at in range(0, len(texts), 100) for x in e.encode([t.encode() for t in texts[at : at + 100]])] == want


SIGNS = ["a", "b", "Z", " ", "  ", "\n", "\n\n", "'", "'s", "'ll", "1", "23", "!", ",", "-", "$$", "<", "|>", "<|endoftext|>", "é", "ß", "×", "÷", "²", "ª", "¡", "\u0301", "語", "\xa0", "\u3000", "\x7f", "\0", "\t", "\r\n", "word", "ÿ", "þ", "😀"]


@pytest.mark.parametrize("together", [True, False])
def test_encoder_equals_library_around_signs(together):
    rnd = random.Random(13)
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 25))) for _ in range(6000)]
    texts += [a + b + c for a in SIGNS for b in SIGNS for c in SIGNS[::3]]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    e = token_output.Encoder(pt.path(VOCABULARY))
    assert e.between is not None
    if not together:
        e.between = None
    assert [x.tolist() for at in range(0, len(texts), 500) for x in e.encode([t.encode() for t in texts[at : at + 500]])] == want
    with pytest.raises(ValueError):
        e.encode([b"ab", b"c\xffd"])


def test_a_pre_token_is_merged_once():
    batches = [["Some words, (others) stand: x1 é,"], ["Some words. others! stand", " stand; words? 1x é."], ["words\nothers\n", "Some (words"]]
    e, merged = token_output.Encoder(pt.path(VOCABULARY)), []
    e.merged = lambda words, f=e.merged: merged.extend(words) or f(words)
    got = [x.tolist() for b in batches for x in e.encode([t.encode() for t in b])]
    assert got == [library().encode(t, add_special_tokens=False).ids for b in batches for t in b]
    assert len(merged) == len(set(merged)) == len({w for b in batches for t in b for w in token_output.PATTERN.findall(t)})


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.4, n).clip(max=50_000).astype(np.uint32) for n in (1, 31, 32, 33, 500, 4097)] + [np.full(700, 9, np.uint32)]
    ids, n = np.unique(np.concatenate(blocks), return_counts=True)
    slots = token_output.frequencies(dict(zip(ids.tolist(), n.tolist())))
    assert slots.sum() == 1 << token_output.PRECISION and (slots[ids] > 0).all()
    m = token_output.Model(slots)
    made = token_output.pack(blocks, m, every=128)
    assert made[3] == token_output.pack([blocks[3]], m, every=128)[0]
    for got, want in zip(token_output.unpack(made[::-1], m)[::-1], blocks, strict=True):
        assert got.tolist() == want.tolist()
    assert len(made[-1]) < 700 * 3 and token_output.pack([], m) == []
    for at in (3, 20, 30, len(made[4]) - 1):
        with pytest.raises(ValueError):
            token_output.unpack([made[4][:at] + bytes([made[4][at] ^ 1]) + made[4][at + 1 :]], m)


def test_frequencies_of_few_and_of_very_many_ids():
    assert token_output.frequencies({}).tolist() == [0]
    assert token_output.frequencies({3: 7})[3] == 1 << token_output.PRECISION
    many = token_output.frequencies({i: 1 if i else 10**9 for i in range(60_000)}, 16)
    assert many.sum() == 1 << 16 and many.min() == 1
    with pytest.raises(ValueError):
        token_output.frequencies({i: 1 for i in range(300)}, 8)


def test_combined_sums():
    parts = [b"hello", b"", b"wor" * 7001, b"x"]
    assert token_output.combined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_files_give_back_every_text(spark, docs, rows, block):
    t = library()
    got = token_output.digest(docs, pt.path(VOCABULARY), block=block).collect()
    assert len(got) == len(rows) and sorted(got[0].asDict()) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    ids = [(id_, t.encode(text or "", add_special_tokens=False).ids + [2]) for id_, text, *_ in rows]
    want = Counter((id_, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for id_, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)


def test_ids_come_back_piece_by_piece(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_output.write_tokens(docs, pt.path(VOCABULARY), path, block=100)
    pieces = defaultdict(list)
    for r in token_output.read(spark, path, as_ids=True).collect():
        pieces[r.id, r.row].append((r.piece, bytes(r.value)))
    back = Counter((id_, b"".join(x for _, x in sorted(p))) for (id_, _), p in pieces.items())
    t = library()
    assert back == Counter((id_, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for id_, x, *_ in rows)


def test_files_of_nothing(spark):
    assert token_output.digest(spark.createDataFrame([], SCHEMA), pt.path(VOCABULARY)).count() == 0
