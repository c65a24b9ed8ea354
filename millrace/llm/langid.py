"""Language identification by multilingual mixture inference.

Training counts letter trigrams (words padded by a mark at both ends) per language over
every training text. A document is then taken as a mixture: each of its words comes from
one language, with the likelihood of the word's trigrams there. Expectation-maximisation
estimates the language proportions; of the nested sets of the most probable languages,
the one with the best penalised likelihood (half the log of the number of words for each
further language) is kept, and its largest proportion is the prediction.

The broadcast model has ``2 ** BITS * languages`` floats, half a MB a language, whatever the size
of the corpus. The distinct languages and one count for each language and bucket reach the driver.

Defined results: null text, or one without a letter, gives ``und`` with score 0; so does
every text if there is nothing to learn from. Ties go to the language first in code-point
order. Whole texts are read; nothing is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, flat

BITS = 17
SMOOTHING = 0.3
CHUNK = 1 << 20
EM_STEPS = 8
REFIT_STEPS = 3
UND = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, start of each word among the trigrams, and each word's text number.

    There is one trigram for each letter: its neighbours and itself, lower-cased."""
    cps = np.frombuffer("\n".join(t.lower().replace("\n", " ") for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    letter = _is_letter()[cps]
    c = np.where(letter, cps, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    before = np.where(at > 0, c[at - 1], 0).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = before * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ (c[at + 1] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(before == 0)
    lines = np.flatnonzero(cps == 10)
    return (h >> np.uint32(32 - bits)).astype(np.int32), first, np.searchsorted(lines, at[first])


def _counted(bits: int, labels: list[str]):
    number = {x: i for i, x in enumerate(labels)}
    out = pa.schema([("bucket", pa.int32()), ("lang_no", pa.int32()), ("n", pa.int64())])

    def count(batches):
        table = np.zeros((len(labels), 1 << bits), np.int64)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            raw, off = flat(batch.column("text"))
            for i, j in chunks(off, CHUNK):
                texts = [raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                for lang in set(langs[i:j]):
                    b, _, _ = trigrams([t for t, x in zip(texts, langs[i:j], strict=True) if x == lang], bits)
                    table[number[lang]] += np.bincount(b, minlength=1 << bits)
        lang, bucket = np.nonzero(table)
        for i in range(0, len(lang), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[part].astype(np.int32)), pa.array(lang[part].astype(np.int32)), pa.array(table[lang[part], bucket[part]])], schema=out)

    return count


class Model:
    """labels: in code-point order; logp: (buckets, languages) natural log likelihoods."""

    def __init__(self, labels: list[str], logp: np.ndarray):
        self.labels, self.logp = labels, logp

    @property
    def bits(self) -> int:
        return int(self.logp.shape[0]).bit_length() - 1


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram likelihoods per language from all rows of ``docs`` with text and language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not labels:
        return Model([], np.zeros((1 << 8, 0), np.float32))
    bits = BITS
    counts = rows.mapInArrow(_counted(bits, labels), "bucket int, lang_no int, n long").groupBy("bucket", "lang_no").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << bits, len(labels)))
    table[counts["bucket"].to_numpy(), counts["lang_no"].to_numpy()] = counts["n"].to_numpy()
    seen = max(1, int((table.sum(1) > 0).sum()))
    logp = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * seen))
    return Model(labels, logp.astype(np.float32))


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def infer(words: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: (words, languages) log likelihoods; owner: ascending document of each word.

    Returns language number (-1: no word), its proportion, and the size of the chosen set."""
    best, share, chosen = np.full(n_docs, -1), np.zeros(n_docs), np.zeros(n_docs, np.int64)
    if not len(words):
        return best, share, chosen
    docs, starts, sizes = np.unique(owner, return_index=True, return_counts=True)
    at = np.repeat(np.arange(len(docs)), sizes)
    peak = words.max(1, keepdims=True)
    like = np.exp(np.maximum(words - peak, -60)).astype(np.float32)
    rest = _sums(peak[:, 0].astype(np.float64), starts)
    n_lang = words.shape[1]

    def steps(mix: np.ndarray, times: int) -> np.ndarray:
        for _ in range(times):
            r = like * mix[at]
            r /= r.sum(1, keepdims=True)
            mix = _sums(r, starts) / sizes[:, None].astype(np.float32)
        return mix

    mix = steps(np.full((len(docs), n_lang), 1 / n_lang, np.float32), EM_STEPS)
    # A single language has no proportions to fit: its likelihood is that of the words.
    singles = _sums(np.log(np.maximum(like, 1e-30)).astype(np.float64), starts) + rest[:, None]
    found = singles.argmax(1)
    top_ll = singles.max(1)
    final = np.zeros_like(mix)
    final[np.arange(len(docs)), found] = 1
    size = np.ones(len(docs), np.int64)
    order = np.argsort(-mix, axis=1, kind="stable")
    most = int((mix > 1e-3).sum(1).max())
    for m in range(2, most + 1):
        inside = np.zeros_like(mix)
        np.put_along_axis(inside, order[:, :m], 1, axis=1)
        part = mix * inside + 1e-9 * inside
        part = steps(part / part.sum(1, keepdims=True), REFIT_STEPS)
        ll = _sums(np.log(np.maximum((like * part[at]).sum(1), 1e-30)).astype(np.float64), starts) + rest - 0.5 * (m - 1) * np.log(sizes + 1.0)
        better = ll > top_ll
        top_ll = np.where(better, ll, top_ll)
        final[better], size[better] = part[better], m
    best[docs] = final.argmax(1)
    share[docs] = final.max(1)
    chosen[docs] = size
    return best, share, chosen


def _predicted(model, text_col: str, passed: list[str], schema: pa.Schema | None = None):
    def predict(batches):
        m: Model = model.value
        for batch in batches:
            raw, off = flat(batch.column(text_col))
            lang, score, several = [], [], []
            for i, j in chunks(off, CHUNK if len(m.labels) < 16 else CHUNK // 8):
                texts = [raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                b, first, owner = trigrams(texts, m.bits)
                if len(first) and m.labels:
                    best, share, size = infer(_sums(m.logp[b], first), owner, j - i)
                else:
                    best, share, size = np.full(j - i, -1), np.zeros(j - i), np.zeros(j - i, np.int64)
                lang += [m.labels[x] if x >= 0 else UND for x in best]
                score.append(np.clip(share, 0, 1).astype(np.float64))
                several.append(size.astype(np.int32))
            cols = [batch.column(c) for c in passed]
            cols += [pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else []), pa.array(np.concatenate(several) if several else [], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*passed, "lang_pred", "score", "n_languages"])

    return predict


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) with lang_pred, score (its proportion) and n_languages.

    A column of ``docs`` that bears one of these three names is left out."""
    added = ("lang_pred", "score", "n_languages")
    passed = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    needed = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*passed, text_col])])
    schema = needed.select(*passed).schema.add("lang_pred", "string").add("score", "double").add("n_languages", "integer")
    return needed.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model), text_col, passed), schema)


def identify(docs: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows where ``train_on`` holds and predict every row: id, lang_pred, score, n_languages."""
    return predict(docs, train(docs.where(train_on), text_col=text_col, lang_col=lang_col), text_col=text_col, keep=[id_col])
