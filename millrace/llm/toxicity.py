"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon (terms and word beginnings that mark toxic texts,
learned from labelled rows), lexicon words near second-person words, capitals, punctuation,
and obfuscated words (digits or signs inside words; lexicon words that appear only after
look-alike characters are undone), and length.

The classifier is fitted on at most SAMPLE labelled rows, chosen by the hash of their id: half
of them give the lexicon, most of the others the trees, the rest the calibration. Scores cover
every row and whole texts.

Defined results: null text counts as empty; empty texts get a score, too. Without labelled rows
of both kinds every score is the share of toxic rows (0 if there are none). A row labelled
twice counts as toxic if either label says so.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, flat, id_crc, materialise

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
LEXICON = 1000
MIN_DOCS = 6
MIN_LOG_ODDS = 2.0
NEAR = 4
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 64, 20
REMEMBERED = 200_000
CHUNK = 1 << 20

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes tú ti vosotros".split())
# Characters that stand for letters in obfuscated words.
LOOK_ALIKES = str.maketrans("013457@$!", "oieastasi")

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W_]")
FEATURES = ("hits", "density", "weight", "weight_density", "most", "near_you", "near_density", "second_person", "capitals", "caps_words", "exclaims", "questions", "punctuation", "obfuscated", "hidden_hits", "log_words", "word_length")


def folded(word: str) -> tuple[str, str]:
    """A word without punctuation at its ends, in lower case, and the same with look-alikes undone."""
    plain = _EDGES.sub("", word.lower())
    if plain.isalpha() or not plain:
        return plain, plain
    return plain, _INSIDE.sub("", word.lower().translate(LOOK_ALIKES))


def terms(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 characters."""
    w = folded(word)[1]
    return [w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n)] if w else []


class Lexicon:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, tuple] = {}

    def look(self, word: str) -> tuple[float, int, int, int]:
        """Weight (0: not in the lexicon), second person, obfuscated, found only by undoing look-alikes."""
        got = self.known.get(word)
        if got is None:
            plain, undone = folded(word)
            get = self.weights.get
            weigh = lambda w: max([get(w, 0.0), *(get(f"{w[:n]}*", 0.0) for n in (4, 5, 6) if len(w) > n)]) if w else 0.0
            weight = weigh(undone)
            odd = bool(plain) and not plain.isalpha() and any(c.isalpha() for c in plain)
            got = weight, int(plain in SECOND_PERSON), int(odd), int(weight > 0 and weigh(plain) == 0)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    seen = [lexicon.look(w) for w in words]
    hits = [i for i, x in enumerate(seen) if x[0] > 0]
    weight = sum(seen[i][0] for i in hits)
    near = sum(any(x[1] for x in seen[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    size = max(1, len(text))
    upper = len(re.findall(r"[A-Z]", text)) if text.isascii() else sum(map(str.isupper, text))
    return [
        len(hits), len(hits) / n, weight, weight / n, max((seen[i][0] for i in hits), default=0.0), near, near / n,
        sum(x[1] for x in seen) / n, upper / size, sum(w.isupper() and len(w) > 1 for w in words) / n, text.count("!") / size,
        text.count("?") / size, sum(map(text.count, ".,;:|*&%$#")) / size, sum(x[2] for x in seen) / n, sum(x[3] for x in seen),
        math.log1p(len(words)), sum(map(len, words)) / n,
    ]


class Trees:
    """Boosted regression trees on the logistic loss, grown on binned features."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(p / (1 - p))
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(b, q - y, q * (1 - q), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += self._apply(tree, b)
        return self

    def _grow(self, b, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = -RATE * gs / (hs + 1.0)
        if depth == 0 or len(rows) < 2 * LEAF:
            return leaf
        best = (1e-6, None, None)
        for j in range(b.shape[1]):
            size = len(self.edges[j]) + 1
            gl = np.cumsum(np.bincount(b[rows, j], g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(b[rows, j], h[rows], size))[:-1]
            nl = np.cumsum(np.bincount(b[rows, j], minlength=size))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _apply(self, tree, b):
        out = np.zeros(len(b))

        def walk(t, rows):
            if isinstance(t, tuple):
                left = b[rows, t[0]] <= t[1]
                walk(t[2], rows[left])
                walk(t[3], rows[~left])
            else:
                out[rows] = t

        walk(tree, np.arange(len(b)))
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        return self.base + sum((self._apply(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    knots = [(p, (s + 0.5 * (y.mean())) / (n + 0.5)) for s, n, lo, hi in blocks for p in ({lo, hi} if lo < hi else {lo})]
    knots.sort()
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


class Model:
    def __init__(self, lexicon: dict[str, float], prior: float, trees: Trees | None = None, knots=None):
        self.lexicon, self.prior, self.trees, self.knots = lexicon, prior, trees, knots

    def scores(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        m = self.trees.margins(np.array([features(t, lexicon) for t in texts]).reshape(-1, len(FEATURES)))
        return np.clip(np.interp(m, *self.knots), 0, 1)


def _texts(column: pa.Array):
    raw, off = flat(column)
    for i, j in chunks(off, CHUNK):
        yield i, j, [raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]


def _termed(batches):
    out = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for i, j, texts in _texts(batch.column("text")):
            rows: dict[str, list[int]] = {}
            for y, t in zip(toxic[i:j], texts, strict=True):
                for x in {x for w in set(t.split()) for x in terms(w)}:
                    r = rows.setdefault(x, [0, 0])
                    r[0] += y
                    r[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array([r[0] for r in rows.values()], pa.int64()), pa.array([r[1] for r in rows.values()], pa.int64())], schema=out)


def _featured(lexicon: dict[str, float]):
    def run(batches):
        lex = Lexicon(lexicon)
        for batch in batches:
            for i, j, texts in _texts(batch.column("text")):
                x = np.array([features(t, lex) for t in texts]).reshape(-1, len(FEATURES))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(i, j - i), batch.column("toxic").slice(i, j - i), lists], names=["part", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, lexicon_size: int = LEXICON) -> Model:
    """``train_on`` is a condition on ``doc_id``, the id of the labels' rows. ``sample``: labelled rows that the model
    is fitted on, at most. ``lexicon_size``: terms of the lexicon, at most, those of the highest log odds."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train_on)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = materialise(marked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).cast("int")), "toxic-sample")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialise(slim.join(F.broadcast(marked), "doc_id").select("text", "toxic", "part"), "toxic-texts")  # at most `sample` ids
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = positive / n if n else 0.0
    if not 0 < positive < n:
        return Model({}, prior)
    words = rows.where("part < 5")
    total, bad = words.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = words.select("text", "toxic").mapInArrow(_termed, "term string, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n"))
    odds = F.log((F.col("a") + 0.1) / (bad - F.col("a") + 0.1)) - F.log((F.col("n") - F.col("a") + 0.1) / (total - bad - F.col("n") + F.col("a") + 0.1))
    rule = counts.where((F.col("a") >= min(MIN_DOCS, max(2, bad // 20))) & (odds >= MIN_LOG_ODDS)).select("term", odds.alias("w"))
    lexicon = {r["term"]: float(r["w"]) for r in rule.orderBy(F.col("w").desc(), "term").limit(lexicon_size).collect()}
    got = rows.where("part >= 5").mapInArrow(_featured(lexicon), "part int, toxic int, x array<double>").collect()  # at most `sample` rows of len(FEATURES) numbers
    x, y, part = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in got], float), np.array([r["part"] for r in got])
    fit, cal = part < 8, part >= 8
    if y[fit].min(initial=1) == y[fit].max(initial=0) or not cal.any():
        return Model(lexicon, prior)
    trees = Trees().fit(x[fit], y[fit])
    return Model(lexicon, prior, trees, isotonic(trees.margins(x[cal]), y[cal]))


def _scored(model):
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m: Model = model.value
        lexicon = Lexicon(m.lexicon)
        for batch in batches:
            for i, j, texts in _texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(m.scores(texts, lexicon))], schema=out)

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 4 == 2
