"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words, of second-person words and of lexicon words near
them; the same for stems, a second lexicon of word beginnings that labelled texts teach; lexicon words that appear once digits and signs are read as letters; capitals, wholly capital
words, punctuation, digits, signs inside words, repeated letters, non-ASCII letters; and the length.
They are counted over the bytes of whole Arrow batches. Trees are fitted by second-order boosting of
the logistic loss on histograms of the features; a third of the sample is kept from the trees and
calibrates their output (pool adjacent violators, linear between the blocks, so order is kept).

The model is fitted on the features of at most ``SAMPLE`` labelled training documents, those with the
least hash of their id; only their features and the stems reach the driver. Scoring shuffles nothing.

Defined results: a null or empty text has zero features and a score like others; a null label teaches
nothing, and of several labels of an id, or of equal texts, the largest counts; without labels, or with one class, all
scores are the share of toxic ones (0 if there are none); repeated rows give repeated results; an empty
table gives an empty result; other columns of the input do not matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fold, least_hashed, mapped, table
from .textops import ALNUM, LOWER, HashSet, Tokenizer, slices, text_buffer, word_hash

SAMPLE = 16_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
NEAR = 5
TREES, DEPTH, BINS, RATE, LEAF = 80, 3, 32, 0.12, 1.0

#: A stem has 3 to 8 bytes; so many toxic texts at least have it, and so large a part of the texts that have it is toxic.
STEM_SIZES = range(3, 9)
STEM_TEXTS, STEM_SHARE = 8, 0.85

LEXICON = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools loser losers clown clowns scum trash garbage
worthless pathetic disgusting filth filthy vermin pig pigs bastard bastards bitch bitches asshole assholes shit shitty crap fuck
fucking fucked fucker dick dickhead prick cunt whore slut hate hated hateful ugly kill die retard retarded imbecile cretin dimwit
halfwit jerk creep freak coward cowardly liar liars parasite rat rats lunatic psycho degenerate subhuman brainless useless
dumm dummkopf idioten trottel arschloch scheisse scheiße schlampe hure versager abschaum müll wertlos erbärmlich widerlich ekelhaft
hässlich schwein schweine dreckig drecksack blöd blödmann depp vollidiot
stupide imbécile crétin crétine connard connasse salope merde ordure ordures minable pathétique dégoûtant dégoûtante débile nul
nulle pute putain enculé raclure abruti abrutie
estúpido estúpida idiota idiotas imbécil basura inútil patético patética asqueroso asquerosa puta puto mierda cabrón cabrona
pendejo pendeja escoria tonto tonta maldito maldita
""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton tes vous votre vos tú ti usted ustedes vosotros".split()

LEET = LOWER.copy()
for _a, _b in zip(b"0134578@$!|+", b"oieastbasiit"):
    LEET[_a] = _b
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
SIGN = np.zeros(256, dtype=bool)
SIGN[list(b"@$*#%&!|+")] = True
PUNCT = np.zeros(256, dtype=bool)
PUNCT[33:127] = True
PUNCT &= ~(LETTER | DIGIT)

NAMES = (
    "log_words stems stem_count near_stems lexicon lexicon_count second_person near_second_person hidden_lexicon capitals capital_words exclamation question "
    "punctuation digits signs_inside repeats non_ascii".split()
)


class Features:
    def __init__(self, stems=()):
        self.stems = HashSet(np.asarray(stems, dtype=np.uint64))
        self.tokenize = Tokenizer(ALNUM)
        self.lexicon = HashSet(np.array([word_hash(w.encode()) for w in set(LEXICON)], dtype=np.uint64))
        self.second = HashSet(np.array([word_hash(w.encode()) for w in set(SECOND_PERSON)], dtype=np.uint64))

    @staticmethod
    def near(words: np.ndarray, second: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Those of the words that have a second-person word of the same row within NEAR words."""
        out = np.zeros(len(words), dtype=bool)
        i, at = np.flatnonzero(words), np.flatnonzero(second)
        if len(i) and len(at):
            after = np.searchsorted(at, i)
            for k in (np.minimum(after, len(at) - 1), np.maximum(after - 1, 0)):
                out[i] |= (np.abs(at[k] - i) <= NEAR) & (row[at[k]] == row[i])
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, features) of a slice whose first offset is the first byte of data."""
        n = len(offsets) - 1
        offsets = offsets - offsets[0]
        per_row = lambda mask: (lambda c: (c[offsets[1:]] - c[offsets[:-1]]).astype(np.float64))(np.concatenate([[0], np.cumsum(mask)]))
        words = self.tokenize(data, offsets)
        count = lambda mask: np.bincount(words.row[mask], minlength=n).astype(np.float64)
        bad = self.lexicon.find(words.hash) >= 0
        second = self.second.find(words.hash) >= 0
        stem = np.zeros(len(bad), dtype=bool)
        if len(self.stems.keys):
            for k in STEM_SIZES:
                at, key = words.prefixes(k)
                stem[at[self.stems.find(key) >= 0]] = True
        near, near_stem = self.near(bad, second, words.row), self.near(stem, second, words.row)
        hidden = self.tokenize(LEET[data], offsets)
        hidden_bad = np.bincount(hidden.row[self.lexicon.find(hidden.hash) >= 0], minlength=n).astype(np.float64)
        capital = np.concatenate([[0], np.cumsum(UPPER[data])])
        small = np.concatenate([[0], np.cumsum(LETTER[data] & ~UPPER[data])])
        shout = (capital[words.end] - capital[words.start] >= 2) & (small[words.end] == small[words.start])
        inside, same = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        if len(data) > 2:
            odd = SIGN[data] | DIGIT[data]
            inside[1:-1] = odd[1:-1] & LETTER[data[:-2]] & LETTER[data[2:]]
            same[2:] = LETTER[data[2:]] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
        size, letters, total = np.maximum(1.0, np.diff(offsets)), np.maximum(1.0, per_row(LETTER[data])), np.maximum(1.0, words.count)
        return np.stack(
            [
                np.log1p(words.count),
                count(stem) / total,
                np.minimum(count(stem), 50),
                count(near_stem) / total,
                count(bad) / total,
                np.minimum(count(bad), 50),
                count(second) / total,
                count(near) / total,
                np.maximum(0, hidden_bad - count(bad)) / total,
                per_row(UPPER[data]) / letters,
                count(shout) / total,
                per_row(data == 33) / size,
                per_row(data == 63) / size,
                per_row(PUNCT[data]) / size,
                per_row(DIGIT[data]) / size,
                per_row(inside) / total,
                per_row(same) / total,
                per_row(data >= 128) / size,
            ],
            axis=1,
        )


class Boosted:
    """Depth-limited regression trees; ``nodes``: (feature, threshold) in heap order; ``leaves``: values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], axis=1)
        n_features = x.shape[1]
        shift = binned + BINS * np.arange(n_features)
        self.trees = []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            place = np.zeros(len(y), dtype=np.int64)
            feature, threshold, bin_of = (np.full((1 << DEPTH) - 1, v) for v in (0, np.inf, BINS))
            feature = feature.astype(np.int64)
            bin_of = bin_of.astype(np.int64)
            for level in range(DEPTH):
                for node in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    own = np.flatnonzero(place == node)
                    if len(own) < 2:
                        continue
                    flat = shift[own].ravel()
                    sums = [np.bincount(flat, weights=np.repeat(v[own], n_features), minlength=BINS * n_features).reshape(n_features, BINS).cumsum(axis=1) for v in (g, h)]
                    (gl, hl), gs, hs = sums, g[own].sum(), h[own].sum()
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < LEAF) | (hs - hl < LEAF)] = -1
                    f, b = divmod(int(gain.argmax()), BINS)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        feature[node], threshold[node], bin_of[node] = f, cuts[f][b], b
                inner = np.flatnonzero(place >= (1 << level) - 1)
                node = place[inner]
                place[inner] = 2 * node + 1 + (binned[inner, feature[node]] > bin_of[node])
            leaf = place - ((1 << DEPTH) - 1)
            value = RATE * np.bincount(leaf, weights=g, minlength=1 << DEPTH) / (np.bincount(leaf, weights=h, minlength=1 << DEPTH) + 1)
            margin += value[leaf]
            self.trees.append((feature, threshold, value))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, threshold, value in self.trees:
            place = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                place = 2 * place + 1 + (x[at, feature[place]] > threshold[place])
            out += value[place - ((1 << DEPTH) - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve that fits y best: both ends and mean y of each block."""
    blocks: list[list[float]] = []  # first x, last x, sum of y, rows
    for a, b in sorted(zip(x.tolist(), y.tolist())):
        blocks.append([a, a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return np.array([e for a, b, _, _ in blocks for e in (a, b)]), np.array([t / n for _, _, t, n in blocks for _ in (0, 1)])


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, stems):
        """held: the rows that calibrate."""
        self.constant, self.stems = None, stems
        if not len(y) or y.min() == y.max() or y[~held].min() == y[~held].max() or not held.any():
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        self.trees = Boosted(x[~held], y[~held])
        self.knots = isotonic(self.trees(x[held]), y[held])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin = self.trees(x)
        return (0.99 * np.interp(margin, *self.knots) + 0.01 / (1 + np.exp(-margin))).clip(0, 1)


def stems_of(batches):
    """(key, toxic) for each beginning of a word that a text has."""
    tokenize = Tokenizer(ALNUM)
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi in slices(offsets):
            words = tokenize(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
            for i in range(hi - lo):
                own = []
                first, last = words.bounds[i : i + 2]
                words_of = object.__new__(type(words))
                words_of.start, words_of.end, words_of.total, words_of.down = words.start[first:last], words.end[first:last], words.total, words.down
                for k in STEM_SIZES:
                    own.append(words_of.prefixes(k)[1])
                keys = np.unique(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), toxic[lo + i], dtype=np.int32))], names=["key", "toxic"])


def featured(stems):
    def run(batches):
        features = Features(stems)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "toxic", "part")), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "part", "x"])

    return run


def scored(model):
    def run(batches):
        features = Features(model.value.stems)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets):
                score = model.value(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled training documents."""
    known = labels.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).select(F.xxhash64("id").alias("h"), "id", "toxic")
    chosen = least_hashed(chosen, "h", sample)
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # A sample of a size that is set: its texts are written once. Of equal ones the largest label counts.
    texts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    texts = checkpoint(texts.select("doc_id", "toxic", "text", F.pmod(F.xxhash64("text"), F.lit(4)).alias("part")))
    toxic = F.sum("toxic")
    stems = texts.where("part < 2").select("text", "toxic").transform(mapped, stems_of, "key long, toxic int").groupBy("key").agg(toxic.alias("toxic"), F.count("*").alias("n")).where((F.col("toxic") >= STEM_TEXTS) & (F.col("toxic") >= STEM_SHARE * F.col("n")))
    stems = np.array([r.key for r in stems.select("key").collect()], dtype=np.int64).view(np.uint64)
    got = texts.where("part >= 2").select("doc_id", "toxic", "part", "text").transform(mapped, featured(stems), "doc_id long, toxic int, part long, x array<double>").orderBy("doc_id", "x").collect()
    return Model(np.array([r.x for r in got], dtype=np.float64).reshape(-1, len(NAMES)), np.array([r.toxic for r in got], dtype=np.float64), np.array([r.part == 3 for r in got], dtype=bool), stems)


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    docs = documents.select(F.col("doc_id").cast("long"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    return docs.transform(mapped, scored(model), "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
