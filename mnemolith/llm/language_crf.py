"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its affixes (one to three bytes at either end), its byte trigrams, both
hashed, and its place in a lexicon of words that the sample has often. Learned transitions link
neighbouring words, and forward-backward gives every word a probability of each language, so that
code-switched texts get a label for every word; a text's language is the one with the greatest
mean probability, which is its score.

Learning: at most PER_LANG texts of each language and MAX_ROWS in all, those with the smallest hashes
of their ids, one row of each id; of a text longer than MAX_CHARS, PIECES pieces from all over it,
MAX_CHARS characters together. They are cut in pieces of a few words and put together to chains in
which languages change, from which transitions are learned too. The sample is all that reaches the
driver. Every text is then labelled whole, as one chain of all its words: it is worked on in links of
CHAIN words, whose products of transitions carry what is known before and after across all of them,
so that results equal those of one long chain.

Texts that are null or have no letter are "und" with score 0, and so is everything if nothing can be
learned from. Null languages and null ids are not learned from. Neither language, source nor id is
an input of a prediction; rows with the same id are judged each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblock as tb

PER_LANG, MAX_ROWS, MAX_CHARS, PIECES = 250, 4000, 20_000, 16
BITS, LEXICON, OFTEN = 16, 20_000, 5
CHAIN = 64
EPOCHS, BATCH, RATE = 6, 256, 0.3
_LETTER = regex.compile(r"\p{L}")


def word_features(block: tb.Block):
    """Starts of the words' runs by text, and for each feature its word and number; lexicon features are hashes yet."""
    start, end = block.runs(tb.ALNUM)
    lo, hi = block.of(start)
    pre = block.prefix(tb.BYTE_LOWER)
    shift = np.uint64(64 - BITS)
    number = np.arange(len(start))
    fixed = []
    for k in (1, 2, 3):
        for kind, a, z in ((2 * k, start, np.minimum(start + k, end)), (2 * k + 1, np.maximum(end - k, start), end)):
            h = tb.mix(tb.Block.hashes(pre, a, z) + np.uint64(kind))
            fixed.append((h >> shift).astype(np.int32))
    n = np.maximum(end - start - 2, 0)
    at = tb.ranges(start, n)
    grams = (tb.Block.hashes(pre, at, at + 3) >> shift).astype(np.int32)
    return lo, hi, fixed, np.repeat(number, n), grams, tb.Block.hashes(pre, start, end)


class Model:
    def __init__(self, langs: list[str], lexicon: np.ndarray):
        self.langs, self.lexicon = langs, lexicon
        k = len(langs)
        self.weight = np.zeros(((1 << BITS) + len(lexicon) + 1, k), np.float32)
        self.step = np.zeros((k, k), np.float32)
        self.begin = np.zeros(k, np.float32)

    def lexical(self, h: np.ndarray) -> np.ndarray:
        """Feature of each word in the lexicon; the last one, whose weight stays 0, for all others."""
        last = len(self.weight) - 1
        if not len(self.lexicon):
            return np.full(len(h), last, np.int32)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at + (1 << BITS), last).astype(np.int32)

    def emissions(self, fixed, word, grams, h) -> np.ndarray:
        out = self.weight[self.lexical(h)].copy()
        for f in fixed:
            out += self.weight[f]
        if len(grams):
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(word, weights=self.weight[grams, k], minlength=len(out))
        return out


def marginals(emission: np.ndarray, size: np.ndarray, step: np.ndarray, begin: np.ndarray, with_steps: bool = False, after: np.ndarray | None = None):
    """Forward-backward over chains (chain, place, label) of the given sizes, longest first.

    Probabilities of the labels of each place; with_steps, also the expected number of each transition. begin: one
    row of weights (logarithms) for all chains or one for each; after: weights of the last labels by what follows.
    """
    n, t, k = emission.shape
    move = np.exp(step)
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    forward = np.zeros_like(e)
    here = np.exp(np.atleast_2d(begin)) * e[:, 0]
    forward[:, 0] = here / here.sum(axis=1, keepdims=True)
    going = [int(np.searchsorted(-size, -i, "left")) for i in range(t + 1)]  # chains longer than i
    for i in range(1, t):
        m = going[i]
        if not m:
            break
        here = (forward[:m, i - 1] @ move) * e[:m, i]
        forward[:m, i] = here / here.sum(axis=1, keepdims=True)
    backward = np.ones_like(e)
    if after is not None:
        backward[np.arange(n), size - 1] = after
    steps = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        m = going[i + 1]
        if not m:
            continue
        ahead = e[:m, i + 1] * backward[:m, i + 1]
        if with_steps:
            joint = forward[:m, i][:, :, None] * move[None] * ahead[:, None, :]
            steps += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        here = ahead @ move.T
        backward[:m, i] = here / here.sum(axis=1, keepdims=True)
    p = forward * backward
    p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-30)
    return (p, steps) if with_steps else p


def learn(sample: list[tuple[str, bytes]], seed: int = 7) -> Model | None:
    """A model of (language, text) pairs; None if they have no words."""
    langs = sorted({x for x, _ in sample})
    sample = sorted(sample)
    block = tb.Block([d for _, d in sample])
    lo, hi, fixed, word, grams, h = word_features(block)
    if not len(h):
        return None
    value, count = np.unique(h, return_counts=True)
    often = value[count >= OFTEN]
    if len(often) > LEXICON:
        often = np.sort(often[np.argsort(-count[count >= OFTEN], kind="stable")[:LEXICON]])
    model = Model(langs, often)
    gold = np.repeat(np.array([langs.index(x) for x, _ in sample]), hi - lo)
    # Every word's features in one list: affixes, lexicon, trigrams.
    lexical = model.lexical(h)
    flat = np.concatenate([*fixed, lexical, grams])
    owner = np.concatenate([np.arange(len(h))] * (len(fixed) + 1) + [word])
    by = np.argsort(owner, kind="stable")
    flat, owner = flat[by], owner[by]
    first = np.searchsorted(owner, np.arange(len(h) + 1))
    rng = np.random.default_rng(seed)
    squares = [np.full_like(x, 1e-3) for x in (model.weight, model.step, model.begin)]
    k, last = len(langs), len(model.weight) - 1
    for _ in range(EPOCHS):
        order = switched(lo, hi, gold, rng)
        for a in range(0, len(order) // CHAIN, BATCH):
            pick = order[a * CHAIN : (a + BATCH) * CHAIN]
            pick = pick[: len(pick) // CHAIN * CHAIN]
            if not len(pick):
                continue
            n = len(pick) // CHAIN
            size = first[pick + 1] - first[pick]
            feature = flat[tb.ranges(first[pick], size)]
            of = np.repeat(np.arange(len(pick)), size)
            score = np.stack([np.bincount(of, weights=model.weight[feature, j], minlength=len(pick)) for j in range(k)], 1)
            p, steps = marginals(score.reshape(n, CHAIN, k), np.full(n, CHAIN), model.step, model.begin, True)
            label = gold[pick].reshape(n, CHAIN)
            diff = p.copy()
            np.put_along_axis(diff, label[:, :, None], np.take_along_axis(diff, label[:, :, None], 2) - 1, 2)
            flat_diff = diff.reshape(-1, k)
            seen = np.bincount(label[:, :-1].reshape(-1) * k + label[:, 1:].reshape(-1), minlength=k * k).reshape(k, k)
            gradient = np.stack([np.bincount(feature, weights=flat_diff[of, j], minlength=last + 1) for j in range(k)], 1) / n
            gradient[last] = 0
            for x, g, s in zip((model.weight, model.step, model.begin), (gradient, (steps - seen) / n, diff[:, 0].mean(axis=0)), squares, strict=True):
                s += g**2
                x -= (RATE * g / np.sqrt(s)).astype(np.float32)
    return model


def switched(lo: np.ndarray, hi: np.ndarray, gold: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The sample's words in an order of pieces of 4 to 40 words, shuffled, so that languages change within chains."""
    pieces = []
    for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
        while a < z:
            b = min(z, a + int(rng.integers(4, 41)))
            pieces.append((a, b))
            a = b
    order = rng.permutation(len(pieces))
    return np.concatenate([np.arange(*pieces[i]) for i in order]) if len(order) else np.zeros(0, np.int64)


def label_block(block: tb.Block, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its words' probabilities of each language, and the number of words."""
    lo, hi, fixed, word, grams, h = word_features(block)
    n_words = hi - lo
    k = len(model.langs)
    out = np.zeros((len(n_words), k))
    if not len(h):
        return out, n_words
    p = chained(model.emissions(fixed, word, grams, h), lo, hi, model.step, model.begin)
    for j in range(k):
        out[:, j] = tb.per_text(p[:, j], lo, hi)
    return out, n_words


def transfer(emission: np.ndarray, size: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For links of the given sizes, longest first, the weight of each last label for each first one, up to a factor."""
    n, t, k = emission.shape
    move = np.exp(step)
    e = np.exp(emission - emission.max(axis=2, keepdims=True)).astype(np.float64)
    out = e[:, 0][:, None, :] * np.eye(k)
    for i in range(1, t):
        m = int(np.searchsorted(-size, -i, "left"))
        if not m:
            break
        here = (out[:m] @ move) * e[:m, i][:, None, :]
        out[:m] = here / here.max(axis=(1, 2), keepdims=True)
    return out


def chained(score: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray, begin: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Probability of each label for each word; the words of a text (lo to hi) are one chain, however long."""
    n_words = hi - lo
    k = score.shape[1]
    links = -(-n_words // CHAIN)
    total = int(links.sum())
    doc = np.repeat(np.arange(len(n_words)), links)
    first = np.cumsum(links) - links
    nth = np.arange(total) - first[doc]
    start = lo[doc] + CHAIN * nth
    size = np.minimum(hi[doc] - start, CHAIN)
    order = np.argsort(-size, kind="stable")

    def tables(which: np.ndarray):
        s = size[which]
        row = np.repeat(np.arange(len(which)), s)
        col = tb.ranges(np.zeros(len(which), np.int64), s)
        e = np.zeros((len(which), int(s.max()), k), np.float32)
        places = tb.ranges(start[which], s)
        e[row, col] = score[places]
        return e, s, row, col, places

    # What comes into each link from before, and from after, as weights of its first and last label.
    before = np.tile(np.exp(begin.astype(np.float64)), (total, 1))
    after = np.ones((total, k))
    several = order[links[doc[order]] > 1]
    if len(several):
        product = np.zeros((total, k, k))
        for a in range(0, len(several), at_once):
            which = several[a : a + at_once]
            e, s, *_ = tables(which)
            product[which] = transfer(e, s, step)
        move = np.exp(step.astype(np.float64))
        most = int(links.max())
        unit = lambda x: x / x.sum(axis=1, keepdims=True)
        for i in range(1, most):
            here = first[links > i] + i
            before[here] = unit(np.einsum("ni,nij->nj", before[here - 1], product[here - 1]) @ move)
        for i in range(most - 2, -1, -1):
            here = first[links > i + 1] + i
            after[here] = unit(np.einsum("nij,nj->ni", product[here + 1], after[here + 1]) @ move.T)
    out = np.empty((len(score), k))
    for a in range(0, total, at_once):
        which = order[a : a + at_once]
        e, s, row, col, places = tables(which)
        out[places] = marginals(e, s, step, np.log(np.maximum(before[which], 1e-300)), after=after[which])[row, col]
    return out


def label_words(block: tb.Block, model: Model) -> list[list[tuple[int, int, str]]]:
    """Of each text the runs of words with the same likeliest language: first and past-the-last character, language."""
    lo, hi, fixed, word, grams, h = word_features(block)
    if not len(h):
        return [[] for _ in block.docs]
    best = chained(model.emissions(fixed, word, grams, h), lo, hi, model.step, model.begin).argmax(axis=1)
    start, end = block.runs(tb.ALNUM)
    chars = block.code_points()
    out = []
    for i, (a, z) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        cut = a + np.flatnonzero(np.concatenate(([True], best[a + 1 : z] != best[a : z - 1]))) if z > a else np.zeros(0, np.int64)
        base = chars[block.start[i]]
        out.append([(int(chars[start[x]] - base), int(chars[end[y - 1]] - base), model.langs[best[x]]) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), z])])
    return out



def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> list[tuple[str, bytes]]:
    """(language, text) of the rows to learn from."""
    t = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").cast("string").alias("l"), t.alias("t")).where("i is not null and l is not null and t <> ''")
    # One row of each id, however often it is repeated; of different ones that with the smallest hash.
    one = rows.groupBy("i").agg(F.min(F.struct(F.xxhash64("t").alias("x"), "l")).alias("m")).select("i", "m.l", "m.x", F.xxhash64(F.col("i").cast("string")).alias("h"))
    # First within 64 parts of each language, so that none is ranked by one task.
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("l", F.pmod("h", F.lit(64))).orderBy("h", "i"))).where(F.col("r") <= per_lang)
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).where(F.col("r") <= per_lang)
    chosen = one.orderBy("r", "l", "i").limit(max_rows).select("i", "l", "x")
    n = F.length("t")
    part = MAX_CHARS // PIECES
    from_all_over = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substr("t", (k * (n - part) / (PIECES - 1)).cast("int") + 1, F.lit(part))), " ")
    held = rows.select("i", "l", F.xxhash64("t").alias("x"), "t").join(F.broadcast(chosen), ["i", "l", "x"], "left_semi")
    held = held.select("i", "l", F.when(n <= MAX_CHARS, F.col("t")).otherwise(from_all_over).alias("t")).dropDuplicates(["i"])
    return [(r.l, r.t.encode()) for r in held.select("l", "t").collect()]


def identify(docs: DataFrame, learn_from: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", runs: bool = False) -> DataFrame:
    """The id with lang_pred and score; with runs also `runs`, the stretches of words of one language (start and end in
    characters of the text, lang), from which code-switched texts are seen.
    """
    model = learn(sample(learn_from, id_col=id_col, text_col=text_col, lang_col=lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches):
        m = sent.value
        for b in batches:
            docs_ = tb.texts(b.column(1))
            pred, score, found = ["und"] * len(docs_), np.zeros(len(docs_)), [[] for _ in docs_]
            for at, block in tb.blocks(docs_) if m else ():
                total, n = label_block(block, m)
                best = total.argmax(axis=1)
                for i, d in enumerate(block.docs):
                    if n[i] and _LETTER.search(d.decode()):
                        pred[at + i] = m.langs[best[i]]
                        score[at + i] = min(1.0, total[i, best[i]] / n[i])
                if runs:
                    found[at : at + len(block.docs)] = label_words(block, m)
            columns = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = [id_col, "lang_pred", "score"]
            if runs:
                columns.append(pa.array([[{"start": a, "end": z, "lang": x} for a, z, x in r] for r in found], run_type))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text_of_the_row"))
    more = ", runs array<struct<start: bigint, `end`: bigint, lang: string>>" if runs else ""
    return rows.mapInArrow(label, f"`{id_col}` {kind}, lang_pred string, score double{more}")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
