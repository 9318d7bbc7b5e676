"""Language identification by a mixture of character n-gram models.

A document's n-grams are a mixture of the languages' n-gram distributions.
Expectation-maximisation estimates the proportions; the set of languages
is the one with the best penalised likelihood (half a log of the n-gram
count for each further language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwatch.llm.common import append_columns

#: N-grams are hashed to this many buckets.
BUCKETS = 1 << 15
#: Characters of a text that are worked on at once.
PIECE_CHARS = 1 << 20
#: At most this many distinct labelled texts are learnt from, whole, chosen by hash.
SAMPLE = 8000
UNDETERMINED = "und"
_STEPS, _MOVE = 30, 1e-4
_SPACE = 32


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of non-letters is one space."""
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ascii_letter = (codes >= 97) & (codes <= 122)
    other = codes > 127
    if other.any():
        points, back = np.unique(codes[other], return_inverse=True)
        letters = np.fromiter((chr(int(p)).isalpha() for p in points), bool, len(points))
        ascii_letter[other] = letters[back]
    codes = np.where(ascii_letter, codes, _SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    return codes[keep]


def _hashed(codes: np.ndarray, known: int) -> np.ndarray:
    """Buckets of the 2- and 3-grams of ``codes``, but not of those in the first ``known`` (0 to 2)."""
    two = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93) + codes[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((two[1:] if known == 2 else two, three))
    return ((both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64) % BUCKETS


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces, cut at spaces where there are any."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = text.rfind(" ", at + 1, at + PIECE_CHARS)
        end = at + PIECE_CHARS if end < 0 else end
        yield text[at:end]
        at = end
    yield text[at:]


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket has one of the text's 2- and 3-grams, word borders included."""
    total = np.zeros(BUCKETS, np.int64)
    if not text:
        return total
    held = np.array([_SPACE], np.uint64)
    first = True
    for piece in _pieces(text):
        codes = _codes(piece)
        if not first and held[-1] == _SPACE and codes[0] == _SPACE:
            codes = codes[1:]  # one run of non-letters
        joined = np.concatenate((held, codes))
        total += np.bincount(_hashed(joined, len(held)), minlength=BUCKETS)
        held, first = joined[-2:], False
    return total + np.bincount(_hashed(np.append(held, np.uint64(_SPACE)), len(held)), minlength=BUCKETS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log probability, languages x buckets
    logp: np.ndarray

    def mixture(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Dominant language, its proportion, and all proportions.

        ``und`` and 0 for texts that are null or have no letter, and for a
        model that learnt no language. Ties go to the first name.
        """
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, {}
        counts = ngram_counts(text)
        seen = np.flatnonzero(counts)
        c = counts[seen].astype(np.float64)
        logp = self.logp[:, seen]
        p = np.exp(logp - logp.max(axis=0))
        base = float(c @ logp.max(axis=0))
        penalty = 0.5 * np.log(c.sum())
        best, share = self._single(p, c)
        score = base + float(c @ np.log(p[best])) - penalty
        chosen, weights = [best], np.ones(1)
        # no set can do better than each n-gram's best language
        if len(self.languages) > 1 and base - penalty * 2 > score:
            order = np.argsort(-self._em(p, c, np.full(len(p), 1 / len(p)))[0], kind="stable")
            for size in range(2, len(order) + 1):
                tried = order[:size]
                w, ll = self._em(p[tried], c, np.full(size, 1 / size))
                if base + ll - penalty * size <= score:
                    break
                chosen, weights, score = list(tried), w, base + ll - penalty * size
        top = max(range(len(chosen)), key=lambda i: (weights[i], -chosen[i]))
        shares = {self.languages[k]: float(w) for k, w in zip(chosen, weights)}
        return self.languages[chosen[top]], min(1.0, float(weights[top])), shares

    @staticmethod
    def _single(p: np.ndarray, c: np.ndarray) -> tuple[int, float]:
        ll = np.log(p) @ c
        return int(ll.argmax()), float(ll.max())

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        total = c.sum()
        for _ in range(_STEPS):
            mixed = w @ p
            new = w * (p @ (c / mixed)) / total
            moved = np.abs(new - w).max()
            w = new
            if moved < _MOVE:
                break
        return w, float(c @ np.log(w @ p))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", *, sample: int = SAMPLE) -> LanguageModel:
    """Learn n-gram distributions from labelled texts.

    The model is fitted on a bounded sample: the ``sample`` distinct texts
    with the smallest hashes, each counted once for each of its languages,
    so that a group of copies weighs no more than one text. Counting is
    distributed; the driver gets at most one count per language and bucket.
    Rows without text or language are left out; without any rows the model
    knows no language.
    """
    rows = (
        labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .withColumn("_h", F.xxhash64("text"))
    )
    picked = rows.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h").alias("top")).first()["top"]
    if picked is None:
        return LanguageModel([], np.empty((0, BUCKETS)))
    rows = rows.where(F.col("_h") <= picked).dropDuplicates(["_h", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = totals.setdefault(language, np.zeros(BUCKETS, np.int64))
                mine += ngram_counts(t)
        for language, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], names=["lang", "bucket", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(languages), BUCKETS), 0.5)
    row = {k: i for i, k in enumerate(languages)}
    table[[row[k] for k in counts.column("lang").to_pylist()], np.asarray(counts.column("bucket"))] += np.asarray(counts.column("n"))
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` (string), ``score`` (its proportion) and ``lang_mix``.

    ``lang_mix`` maps each selected language to its proportion; it is empty
    for undetermined texts. Only the text decides: repeated rows get equal
    results, and clashing columns are replaced.
    """
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def told(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [shared.value.mixture(t.as_py()) for t in batch.column(at)]
        return [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
            pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64())),
        ]

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_mix", T.MapType(T.StringType(), T.DoubleType()))]
    return append_columns(df, fields, told, keep)


def dominant_only(told: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is determined with at least the proportion ``least``."""
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
