"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (a small fixed list, and words and word stems learned from
labelled rows by log-odds), how near second-person words are to them, capitals, punctuation, digits, and
signs of obfuscation (digits or symbols inside words, stretched letters, lexicon words that
appear once such marks are undone). The labelled sample (at most about `max_rows` rows, drawn by a hash
of the id, so that it is the same each time) is split by another hash: a part teaches the lexicon, the rest the
trees; each third of that rest is also scored by trees of the others, and the isotonic calibration learns from these scores.
This is done alike for any number of labels. Everything else covers all rows.

Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get features of zero and a score like any other; a label row with
null id or null label is no training row; a document labelled more than once is toxic if any label says
so; repeated document ids train once; with no labelled rows, or one class only, there is nothing to learn and every score is the
training rate (0 without rows); where only the lexicon's part has one of the classes, trees and calibration learn the other's rate;
with labels in the lexicon's part alone, the trees learn from these; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piispan.llm.common import cut, narrow, sliced

THRESHOLD = 0.3
MAX_ROWS, MAX_LEXICON = 12_000, 4_000
#: Common insults; what is toxic in a corpus beyond these is learned from its labels.
SEED_WORDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic disgusting worthless clown fool imbecile garbage filth".split())
SECOND_PERSON = frozenset("you your yours yourself youre ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())
_WORD = re.compile(r"[^\W_]+(?:[@$*!|0-9'’][^\W_]+)*")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, "'": None, "’": None})
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_NOT_LETTERS = re.compile(r"[\d@$*!|]")
FEATURES = ("words", "chars", "strong", "strong_rate", "weak_rate", "weight_rate", "top_weight", "kinds", "near_you", "you_rate", "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "punct_rate", "digit_rate", "odd_rate", "hidden_rate", "stretch_rate", "repeat_rate", "line_rate")
STRONG, WEAK = 3.0, 1.0
#: Parts of the labelled rows: those that teach the lexicon, and the folds of the others, each scored by trees of the rest.
TEACH, FOLDS = (0, 1, 2), ((3, 4), (5, 6), (7,))
#: A word has to occur in so many toxic texts to be learned.
LEAST_SEEN = 4


def _stems(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in range(4, min(len(word), 9)))]


@dataclass
class Lexicon:
    weights: dict[str, float]
    seen: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        """The largest weight of a word and its stems."""
        w = self.seen.get(word)
        if w is None:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            get = self.weights.get
            w = max(6.0 if word in SEED_WORDS else 0.0, max(get(s, 0.0) for s in _stems(word)))
            self.seen[word] = w
        return w

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        n = max(len(text), 1)
        low = text.lower()
        words = _WORD.findall(low)
        m = max(len(words), 1)
        weights = list(map(self.weight, words))
        strong = [i for i, w in enumerate(weights) if w >= STRONG]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = j = 0
        for i in strong:
            while j < len(you) and you[j] < i - 5:
                j += 1
            near += j < len(you) and you[j] <= i + 5
        odd = [w for w in words if _NOT_LETTERS.search(w) and not w.isdigit()] if _NOT_LETTERS.search(low) else []
        stretched = len(_STRETCHED.findall(low))
        hidden = sum(self.weight(_STRETCHED.sub(r"\1", w.translate(_LEET))) >= STRONG > self.weight(w) for w in odd)
        capitals = sum(map(str.isupper, text)) if low != text else 0
        shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if capitals > 0.05 * n else 0
        letters = sum(map(len, words))
        return [
            math.log1p(len(words)), math.log1p(len(text)), math.log1p(len(strong)), len(strong) / m, sum(WEAK <= w < STRONG for w in weights) / m,
            sum(weights) / m, max(weights, default=0.0), math.log1p(len({words[i] for i in strong})), near / m, len(you) / m, capitals / n, shouted / m,
            text.count("!") / n, text.count("?") / n, max(0, n - letters - text.count(" ")) / n, sum(c.isdigit() for c in "".join(odd)) / n,
            len(odd) / m, hidden / m, stretched / m, 1 - len(set(words)) / m, text.count("\n") / n,
        ]


class Trees:
    """Boosted regression trees for log loss, on features binned at their quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: float = 4.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start, self.trees = math.log(rate / (1 - rate)), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            node, tree = np.zeros(len(y), np.int64), []
            g, h = y - p, p * (1 - p)
            for level in range(self.depth):
                splits = np.zeros((1 << level, 2), np.int64)
                best = np.full(1 << level, 1e-6)
                splits[:, 1] = self.bins  # nothing goes right
                k = (1 << level) * (self.bins + 1)
                for c in range(b.shape[1]):
                    at = node * (self.bins + 1) + b[:, c]
                    gs = np.cumsum(np.bincount(at, g, k).reshape(-1, self.bins + 1), 1)
                    hs = np.cumsum(np.bincount(at, h, k).reshape(-1, self.bins + 1), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least / 8) | (ht - hs < self.least / 8)] = 0
                    i = gain.argmax(1)
                    top = gain[np.arange(len(i)), i]
                    better = top > best
                    best[better], splits[better] = top[better], np.stack((np.full(len(i), c), i), 1)[better]
                tree.append(splits)
                node = node * 2 + (b[np.arange(len(y)), splits[node, 0]] > splits[node, 1])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + 1)
            self.trees.append((tree, leaf))
            f += leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for splits in tree:
                node = node * 2 + (b[rows, splits[node, 0]] > splits[node, 1])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function of x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least x, greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    total, n = sum(b[0] for b in blocks), sum(b[1] for b in blocks)
    prior = total / n
    knots = [(e, (b[0] + prior) / (b[1] + 1)) for b in blocks for e in (b[2], b[3])]
    return np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def _id_text(c) -> F.Column:
    return F.col(c).cast("string")


def held_out(c: str) -> F.Column:
    return F.coalesce(F.crc32(_id_text(c).cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic, part (0 to 7) of a bounded sample of labelled rows that are not held out."""
    known = narrow(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    # a draw of 63 bits, so that the sample is as large as asked for however many labels there are
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("draw")), 1)
    sample = known if n <= max_rows else known.filter(draw < int((1 << 63) * (max_rows / n)))
    # the sample is bounded by max_rows (and the hash's evenness): about 16 bytes a row are broadcast
    ids = F.broadcast(sample.withColumnRenamed("doc_id", "label_id"))
    d = narrow(docs, "doc_id", "text").join(ids, F.col("doc_id") == F.col("label_id"))
    return d.dropDuplicates(["doc_id"]).select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(8)).cast("int").alias("part"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        terms, toxic = [], []
        for text, t in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            own = {s for w in set(_WORD.findall((text or "").lower())) for s in _stems(w)}
            terms += own
            toxic += [t] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])


def _features(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Lexicon(lexicon)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64())), batch["toxic"], batch["part"]], names=["x", "toxic", "part"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_lexicon: int = MAX_LEXICON) -> Model:
    """The model, from a sample of about `max_rows` labelled rows at most; what reaches the driver is
    `max_lexicon` terms and a row of numbers for each sampled row."""
    rows = cut(training_rows(docs, labels, max_rows))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    rate = sum(n for t, n in sizes.items() if t) / total if total else 0.0
    if not 0 < rate < 1:
        return Model(Lexicon({}), None, None, rate)
    teach = rows.filter(F.col("part").isin(*TEACH))
    n1, n0 = (teach.filter(c).count() for c in (F.col("toxic") > 0, F.col("toxic") == 0))
    df = teach.mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("b"))
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    top = df.filter(F.col("a") >= LEAST_SEEN).withColumn("w", weight).filter(F.col("w") >= WEAK).orderBy(F.desc(F.col("w") * F.sqrt("a")), "term").limit(max_lexicon)
    lexicon = {r["term"]: float(r["w"]) for r in top.select("term", "w").collect()}
    features = lambda df: df.mapInArrow(_features(lexicon), "x array<double>, toxic int, part int").collect()
    got = features(rows.filter(~F.col("part").isin(*TEACH))) or features(rows)
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    y, part = np.array([float(r["toxic"] > 0) for r in got]), np.array([r["part"] for r in got])
    order = np.lexsort((*x.T, y, part))
    x, y, part = x[order], y[order], part[order]
    trees = Trees().fit(x, y)
    # calibrated on scores of rows by trees that have not seen them
    unseen = np.zeros(len(y))
    for fold in FOLDS:
        own = np.isin(part, fold)
        if own.any():
            unseen[own] = (Trees().fit(x[~own], y[~own]) if (~own).any() else trees).raw(x[own])
    return Model(Lexicon(lexicon), trees, isotonic(unseen, y), rate)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """doc_id, h, held_out, score, predicted for each row of `docs`."""
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_lexicon and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["held_out"], pa.array(m.scores(batch["text"].to_pylist()), pa.float64())], names=["doc_id", "h", "held_out", "score"])

    d = narrow(docs, "doc_id", "text").withColumn("h", F.xxhash64("doc_id", "text")).withColumn("held_out", held_out("doc_id"))
    out = d.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, without those whose score reaches the threshold."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches):
            scores = m.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
