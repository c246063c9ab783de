"""Quality classifier from weak labels.

Ten heuristic labellers look at every text and vote good, bad or not at all: size, symbols,
repeated windows, equal lines, length of words, capitals, loud words, loose marks, share of hostile
words, hostile words aimed at somebody (a second person near, or an exclamation mark). The corpus is
summed up as the number of texts with each pattern of votes (3 ** 10 at most, however large the
corpus); expectation-maximisation over these patterns, without any true label, estimates how often
each labeller votes which way on good texts and on several kinds of bad ones, and so every pattern's posterior of being
good. The posteriors are the labels from which a linear scorer over hashed byte trigrams is
trained, by logistic loss on at most SAMPLE texts (those with the smallest hashes of their
digests). Every text gets the scorer's probability, and is kept if the scorer finds it good, alone
and together with the votes: score >= 1/2, and the log odds of posterior and score add up to zero or
more, which is score + posterior >= 1.
No single word decides: hostile words count by their share of the text, and what such votes are
worth is estimated like that of the others.

Null, empty and word-less texts have no trigrams; they have size votes like others and the scorer's
constant. Equal texts get equal results, whatever their ids. Without any text there is no row.
Other columns don't matter and aren't read.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .quality_rules import SYMBOLS, duplicate_lines, per_byte, repeated_windows, word_hashes

SAMPLE, BITS = 4000, 15
ROUNDS, EPOCHS, RATE = 60, 250, 0.15
#: What is thought of a labeller beforehand, in shares of the corpus: bad and good votes on good texts, and on bad ones.
PRIOR = ({0: 0.0005, 2: 0.2}, {0: 0.001, 2: 0.001})
LABELLERS = ("size", "symbols", "windows", "lines", "length", "capitals", "loud", "marks", "hostile", "aimed")
#: What can be wrong with a text, by the labellers that see it.
FAULTS = (("symbols", "marks"), ("windows", "lines"), ("capitals", "loud"), ("size", "length"), ("hostile", "aimed"))
#: In a pattern's number no vote is digit 1 for the first eight labellers and digit 0 for the last two.
SHIFT = np.array([0] * 8 + [1] * 2)

#: Words of abuse by language. Written by hand as general vocabulary, since no published lexicon is at
#: hand without network; not drawn from the documents or their labels.
STRONG = {
    "en": "arsehole asshole bastard bitch bonehead bootlicker cretin cunt dickhead dimwit dipshit douchebag dullard dumbass dunce fathead fucker fuckface halfwit hypocrite idiot idiotic imbecile jackass jerk knucklehead lowlife moron moronic motherfucker nincompoop nitwit numbskull peabrain pervert scoundrel scum scumbag shithead shitty simpleton sleazebag slut subhuman thickhead turd twat twit wanker whore wimp wretch",
    "de": "abschaum arsch arschloch bastard blödmann depp drecksack drecksau dummkopf dumpfbacke fotze hackfresse hohlkopf hornochse hure hurensohn idiot idiotisch missgeburt mistkerl miststück pisser saukerl scheisskerl scheißkerl schlampe schuft schwachkopf schweinehund trottel untermensch vollidiot vollpfosten wichser widerling",
    "fr": "abruti batard bouffon branleur bâtard charogne connard connasse conne crétin crétine débile enculé enfoiré idiot idiote imbécile merdeux pleutre pute pétasse raclure salaud salopard salope taré trouduc vaurien",
    "es": "bastardo bobo boludo cabrón cretino escoria estúpida estúpido gilipollas hijoputa huevón idiota imbécil mamón mierdoso necio pelotudo pendejo puta puto retrasado tarado tonto",
    "it": "bastarda bastardo cazzone coglione cretina cretino feccia idiota imbecille merdoso pezzente puttana scemo stronza stronzo stupido vigliacco",
    "pt": "babaca bastardo cretino desgraçado escória estúpido idiota imbecil otário puta puto retardado vadia vagabundo",
    "nl": "debiel hoer hufter idioot imbeciel klootzak lul lulhannes mafkees rotzak schoft sukkel trut tyfuslijer uilskuiken",
    "pl": "bydlak cham debil dupek frajer gnój idiota kretyn kurwa palant sukinsyn",
    "tr": "ahmak aptal gerizekalı kaltak mankafa orospu salak şerefsiz",
    "ru": "дебил дура дурак идиот идиотка козел козёл кретин мразь подонок сволочь скотина сука тварь ублюдок урод",
}
#: Also words of abuse, which have plain uses as well: they count half. Words that are plain
#: ones in another of the languages ("con", "it", "sale", "gross") are left out.
MILD = {
    "en": "brainless clown contemptible coward crap creep cringe degenerate dirtbag disgrace disgusting dumb fool foolish freak garbage hateful hideous hopeless ignorant laughable lazy liar loser lousy nasty pathetic pest phony pig pitiful prick ridiculous rotten rubbish shameful slimy stupid stupidity swine thug traitor trash ugly useless vermin vile weasel weirdo witless worthless",
    "de": "abartig armselig blöd doof dreck dumm ekelhaft erbärmlich feigling hässlich jämmerlich lächerlich lügner nutzlos sau schwein verlierer versager wertlos widerlich witzfigur",
    "fr": "andouille déchet dégoûtant dégueulasse fumier gourde hideux honteux lamentable lâche menteur minable moche ordure pathétique perdant pitoyable pourri pourriture ridicule répugnant stupide traître",
    "es": "asqueroso basura capullo cobarde desgraciado despreciable feo fracasado ignorante inútil lamentable maldito mentiroso miserable patético payaso perdedor repugnante ridículo subnormal sucio traidor vergonzoso",
    "it": "codardo deficiente disgustoso fallito inutile pagliaccio patetico perdente ridicolo schifoso spazzatura traditore verme",
    "pt": "burro covarde feio fracassado inútil lixo miserável nojento palhaço patético perdedor ridículo traidor",
    "nl": "belachelijk lelijk loser nutteloos waardeloos walgelijk zielig",
    "pl": "brzydki głupi szmata śmieszny śmieć żałosny",
    "tr": "korkak rezil çirkin",
    "ru": "глупый жалкий мерзкий ничтожество трус тупой",
}
SECOND_PERSON = "you your yours yourself yourselves youre ur u ya thou du dich dir dein deine deinen deiner deinem ihr euch euer eure tu toi te ton ta tes vous votre vos ti tú vos vosotros usted ustedes vuestro vuestra tuyo voi vostro lei você voce vocês seu sua jij je jou jouw jullie ty ciebie cię sen sana siz seni ты тебя тебе твой вы вас вам ваш"
#: The weight of hostile words to all words above which they are a bad vote: in any text, and if they weigh SEVERAL or are
#: aimed at somebody, which a second person within NEAR words tells.
HOSTILE, LESS, SEVERAL, NEAR = 0.02, 0.005, 2, 3

_c = np.arange(256)
_symbol = np.isin(_c, list(SYMBOLS))
_upper, _letter = (_c >= 65) & (_c <= 90), ((_c >= 65) & (_c <= 90)) | ((_c >= 97) & (_c <= 122)) | (_c >= 128)


def spellings(word: str) -> set[str]:
    """The word with usual endings, without accents, with them in capitals, and with digits for letters."""
    forms = {word + x for x in ("", "s", "es", "e", "en", "er", "n")}
    for f in list(forms):
        forms.add("".join(c for c in unicodedata.normalize("NFD", f) if not unicodedata.combining(c)))
        forms.add(f.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"))
        forms.add(unicodedata.normalize("NFD", f))
    for digits in itertools.product((False, True), repeat=5):
        forms.add("".join(dict(zip("ieoas", "13045", strict=True)).get(c, c) if dict(zip("ieoas", digits, strict=True)).get(c) else c for c in word))
    # Only ASCII letters are lowered before words are looked up.
    return forms | {"".join(c if c.isascii() else c.upper() for c in f) for f in forms} | {f[:1].upper() + f[1:] for f in forms if not f[:1].isascii()}


@functools.cache
def _known() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that are looked up, in order, and what each is: its hostile weight, -1 for a second person."""
    weight = {w: -1.0 for w in SECOND_PERSON.split()}
    for lists, x in ((MILD, 0.5), (STRONG, 1.0)):
        weight |= {f: x for words in lists.values() for w in words.split() for f in spellings(w) if len(f) > 1}
    block = tb.Block([w.encode() for w in weight])
    start, end = block.start, block.end
    h = block.hashes(block.prefix(tb.BYTE_LOWER), start, end)
    order = np.argsort(h)
    return h[order], np.array(list(weight.values()))[order]


def hostility(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words, the weight of hostile ones, and of those aimed at somebody."""
    start, end = block.runs(tb.ALNUM)
    lo, hi = block.of(start)
    known, what = _known()
    h = block.hashes(block.prefix(tb.BYTE_LOWER), start, end)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    kind = np.where(known[at] == h, what[at], 0.0)
    second = np.concatenate(([0], np.cumsum(kind < 0)))
    word = np.flatnonzero(kind > 0)
    text = np.searchsorted(hi, word, "right")
    near = second[np.minimum(word + NEAR + 1, hi[text])] > second[np.maximum(word - NEAR, lo[text])]
    weight = kind[word]
    aimed = near | (block.buf[end[word]] == ord("!"))
    n = len(block.docs)
    return hi - lo, np.bincount(text, weights=weight, minlength=n), np.bincount(text, weights=weight * aimed, minlength=n)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 2, 1))


def votes(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """For each text the votes (0 bad, 1 none, 2 good) of the labellers, and whether it has hostile words aimed at somebody."""
    pre = block.prefix()
    start, end, lo, hi, h = word_hashes(block, pre)
    n = hi - lo
    some = np.maximum(n, 1)
    letters = per_byte(_letter[block.buf], block)
    share = lambda x, of: x / np.maximum(of, 1)
    symbols = share(per_byte(_symbol[block.buf], block), n)
    windows = share(tb.per_text(repeated_windows(h, lo, hi), lo, hi), n)
    breaks = per_byte(block.buf == 10, block) + 1
    lines = share(duplicate_lines(block, pre, start), breaks)
    length = tb.per_text(end - start, lo, hi) / some
    capitals = share(per_byte(_upper[block.buf], block), letters)
    loud = tb.per_text(block.buf[end - 1] == ord("!"), lo, hi) / some
    marks = tb.per_text((end - start == 1) & ~tb.ALNUM[block.buf[start]], lo, hi) / some
    spoken, hostile, aimed = hostility(block)
    out = np.stack(
        [
            _vote(n < 3, n >= 30),
            _vote(symbols > 0.1, symbols < 0.02),
            _vote(windows > 0.3, (windows < 0.05) & (n >= 20)),
            _vote(lines > 0.5, (lines < 0.05) & (breaks > 2)),
            _vote((length < 3) | (length > 12), (length >= 4) & (length <= 9)),
            _vote(capitals > 0.3, (capitals < 0.1) & (letters > 0)),
            _vote(loud > 0.1, (loud < 0.01) & (n >= 20)),
            _vote(marks > 0.1, (marks < 0.01) & (n >= 20)),
            _vote((hostile > HOSTILE * spoken) | ((hostile > LESS * spoken) & (hostile >= SEVERAL)), (hostile == 0) & (spoken >= 20)),
            _vote(aimed > LESS * spoken, (hostile == 0) & (spoken >= 20)),
        ],
        axis=1,
    )
    return out, aimed > 0


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v - SHIFT) % 3 * 3 ** np.arange(v.shape[1])).sum(axis=1)


def posteriors(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pattern the probability of good, and how each labeller votes on good texts and each kind of bad ones.

    Bad texts differ in what is wrong with them, so that bad votes come together: there is one kind of
    good text, and a kind of bad text for each of FAULTS, from which the expectation starts.
    """
    m = len(LABELLERS)
    names = np.array(sorted(counts), np.int64)
    weight = np.array([counts[k] for k in names.tolist()], np.float64)
    v = (names[:, None] // 3 ** np.arange(m) + SHIFT) % 3
    spoken = v != 1
    fault = np.array([[x in kind for x in LABELLERS] for kind in FAULTS])
    bad = np.stack([((v == 0) & f).any(axis=1) for f in fault], 1).astype(float)
    any_bad = bad.any(axis=1)
    p = np.concatenate((np.where(any_bad, 0.1, 0.95)[:, None], np.where(any_bad[:, None], 0.9 * bad / np.maximum(bad.sum(axis=1, keepdims=True), 1), 0.05 / len(FAULTS))), axis=1)
    total = max(weight.sum(), 1e-9)
    rates = np.zeros((p.shape[1], m, 3))
    for _ in range(ROUNDS):
        share = ((weight[:, None] * p).sum(axis=0) / total + 1e-4) / (1 + 1e-4 * p.shape[1])
        for k in range(p.shape[1]):
            for x in (0, 2):
                rates[k, :, x] = ((v == x) * (weight * p[:, k])[:, None]).sum(axis=0) + PRIOR[min(k, 1)][x] * total
        rates /= rates.sum(axis=2, keepdims=True)
        # Not voting says nothing.
        log = np.stack([np.log(share[k]) + np.where(spoken, np.log(np.maximum(rates[k, np.arange(m), v], 1e-12)), 0).sum(axis=1) for k in range(p.shape[1])], 1)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    out = np.full(3**m, 0.5)
    out[names] = p[:, 0]
    return out, rates


def trigrams(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each byte trigram."""
    n = np.maximum(block.end - block.start - 2, 0)
    at = tb.ranges(block.start, n)
    h = block.hashes(block.prefix(), at, at + 3) >> np.uint64(64 - BITS)
    return np.repeat(np.arange(len(n)), n), h.astype(np.int64)


def train(rows: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and constant of the scorer from (label, buckets, shares) of texts; full-batch AdaGrad."""
    size = 1 << BITS
    w, b = np.zeros(size), 0.0
    if not rows:
        return w, b
    label = np.array([r[0] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    bucket = np.concatenate([r[1] for r in rows]).astype(np.int64)
    value = np.concatenate([r[2] for r in rows])
    # Both kinds weigh the same, however rare the bad are.
    good = max(label.sum(), 1e-6)
    bad = max((1 - label).sum(), 1e-6)
    weight = label * (0.5 / good) + (1 - label) * (0.5 / bad)
    gw, gb = np.full(size, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(doc, weights=value * w[bucket], minlength=len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) * weight
        g = np.bincount(bucket, weights=value * d[doc], minlength=size) + 1e-7 * w
        gw += g**2
        gb += d.sum() ** 2
        w -= RATE * g / np.sqrt(gw)
        b -= RATE * d.sum() / np.sqrt(gb)
    return w, b


def good_enough(posterior: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Whether good is likelier by the score and by both; a/(1-a) * b/(1-b) >= 1 where a + b >= 1."""
    return (score >= 0.5) & (posterior + score >= 1)


SCALE = 100.0
#: Features of the sample's texts together; with very long texts it has fewer of them.
MAX_FEATURES = 1 << 24


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The id with votes (labeller to good, bad or none), posterior, score and kept."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("t")

    def patterns(batches):
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, block in tb.blocks(tb.texts(b.column(0))):
                total += np.bincount(pattern(votes(block)[0]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["pattern", "n"])

    counts = docs.select(text).mapInArrow(patterns, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    good, _ = posteriors({r.pattern: r.n for r in counts})
    sent = spark.sparkContext.broadcast(good)

    # The sample's digests first, then its texts' features: short lists of buckets and shares.
    key = F.xxhash64(F.coalesce(text_col, F.lit("")))
    chosen = docs.select(key.alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = docs.select(key.alias("k"), text).join(F.broadcast(chosen), "k", "left_semi")

    def features(batches):
        done: set[int] = set()
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, block in tb.blocks(tb.texts(b.column(1))):
                label = sent.value[pattern(votes(block)[0])]
                doc, bucket = trigrams(block)
                pair, count = np.unique(doc << BITS | bucket, return_counts=True)
                cut = np.searchsorted(pair, np.arange(len(block.docs) + 1) << BITS)
                n = np.maximum(np.bincount(doc, minlength=len(block.docs)), 1)
                for i in range(len(block.docs)):
                    if keys[at + i] not in done:
                        done.add(keys[at + i])
                        mine = slice(cut[i], cut[i + 1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([keys[at + i]]), pa.array([label[i]]), pa.array([(pair[mine] & ((1 << BITS) - 1)).astype(np.int32).tobytes()]), pa.array([(count[mine] * (SCALE / n[i])).astype(np.float32).tobytes()])],
                            names=["k", "label", "buckets", "shares"],
                        )

    got, held = [], 0
    for r in texts.mapInArrow(features, "k bigint, label double, buckets binary, shares binary").dropDuplicates(["k"]).orderBy(F.xxhash64("k"), "k").toLocalIterator():
        if got and held + len(r.buckets) > MAX_FEATURES * 4:
            break
        got.append(r)
        held += len(r.buckets)
    w, const = train([(r.label, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32).astype(np.float64)) for r in got])
    scorer = spark.sparkContext.broadcast((w.astype(np.float32), const))
    kind = docs.schema[id_col].dataType.simpleString()
    said = np.array(["bad", "none", "good"], object)

    def score(batches):
        w, const = scorer.value
        for b in batches:
            parts = []
            for _, block in tb.blocks(tb.texts(b.column(1))):
                v = votes(block)[0]
                doc, bucket = trigrams(block)
                n = np.bincount(doc, minlength=len(block.docs))
                z = np.bincount(doc, weights=w[bucket], minlength=len(block.docs)) * SCALE / np.maximum(n, 1) + const
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                post = sent.value[pattern(v)]
                parts.append((v, post, p, good_enough(post, p)))
            v, post, p, kept = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, len(LABELLERS)), int), np.zeros(0), np.zeros(0), np.zeros(0, bool))
            shown = pa.StructArray.from_arrays([pa.array(said[v[:, j]], pa.string()) for j in range(len(LABELLERS))], names=list(LABELLERS))
            yield pa.RecordBatch.from_arrays([b.column(0), shown, pa.array(post, pa.float64()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())], names=[id_col, "votes", "posterior", "score", "kept"])

    struct = ", ".join(f"{x}: string" for x in LABELLERS)
    return docs.select(F.col(id_col), text).mapInArrow(score, f"`{id_col}` {kind}, votes struct<{struct}>, posterior double, score double, kept boolean")
