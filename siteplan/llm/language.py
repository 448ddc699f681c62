"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letter slots: 0 for what lies between words, 1 to 26 for a-z, the rest shared by all other letters.
SLOTS = 64
SEED = 20

_slots: np.ndarray | None = None
_space: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Prototypes(NamedTuple):
    """Languages in order, and a unit vector for each."""

    languages: list[str]
    vectors: np.ndarray


def _slot_table() -> np.ndarray:
    global _slots
    if _slots is None:
        points = np.arange(0x10000)
        letter = np.array([not 0xD800 <= p < 0xE000 and chr(p).isalpha() for p in points.tolist()])
        _slots = np.where(letter, 27 + points % 37, 0).astype("i4")
        _slots[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return _slots


def _vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Random +1/-1 letter vectors, and for each pair of slots the twice and once permuted vectors bound together."""
    if dimensions not in _space:
        letters = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], "f4"), (SLOTS, dimensions))
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        _space[dimensions] = letters, (first[:, None, :] * second[None, :, :]).reshape(SLOTS * SLOTS, dimensions)
    return _space[dimensions]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a text, as numbers in base 64, and their counts; a run of other characters is one gap."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _slot_table()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        codes[i] = 27 + int(points[i]) % 37 if chr(points[i]).isalpha() else 0
    if not codes.any():
        return np.zeros(0, "i4"), np.zeros(0, "i8")
    codes = np.concatenate([[0], codes, [0]]).astype("i4")
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    return np.unique((codes[:-2] * SLOTS + codes[1:-1]) * SLOTS + codes[2:], return_counts=True)


def bundle(grams: np.ndarray, weights: np.ndarray, dimensions: int) -> np.ndarray:
    """Sum of the bound trigram vectors: letters are summed under each leading pair first, then bound to it."""
    letters, bound = _vectors(dimensions)
    pairs, at = np.unique(grams // SLOTS, return_inverse=True)
    table = np.zeros((len(pairs), SLOTS), "f4")
    table[at, grams % SLOTS] = weights
    return np.einsum("ij,ij->j", table @ letters, bound[pairs])


def language_prototypes(prompts: DataFrame, dimensions: int = 512) -> Prototypes:
    """Learn a prototype per language from case prompts (``prompt, language``), over all of them.

    Each prompt with a letter and a language counts once: its trigram counts are divided by their number. A task adds
    up trigram weights per language and bundles them once; Spark adds the bundles. The driver receives
    ``dimensions`` numbers per language. Rows without a language or letter teach nothing; without any such row there
    is no language.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = trigrams(text)
                if len(grams):
                    if language not in sums:
                        sums[language] = np.zeros(SLOTS**3)
                    sums[language][grams] += counts / counts.sum()
        for language, weights in sums.items():
            grams = np.flatnonzero(weights)
            vector = bundle(grams, weights[grams], dimensions)
            yield pa.RecordBatch.from_arrays([pa.array([language] * dimensions), pa.array(np.arange(dimensions, dtype="i4")), pa.array(vector.astype("f8"))], names=["language", "at", "value"])

    rows = (
        prompts.select("prompt", "language").where(F.col("prompt").isNotNull() & F.col("language").isNotNull())
        .mapInArrow(learn, "language string, at int, value double").groupBy("language", "at").agg(F.sum("value").alias("value")).collect()
    )
    languages = sorted({r["language"] for r in rows})
    vectors = np.zeros((len(languages), dimensions))
    for r in rows:
        vectors[languages.index(r["language"]), r["at"]] = r["value"]
    return Prototypes(languages, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12))


def identified(prompt: Column | str, prototypes: Prototypes) -> Column:
    """The language of a prompt as a struct: ``language`` and ``score``, the cosine with its prototype, at least 0.

    The nearest prototype wins, the first by name on a tie. A prompt that is null or has no letter is ``und`` with
    score 0, as is every prompt if no language is known. Whole texts are used, however long.
    """
    languages, vectors = prototypes
    dimensions = vectors.shape[1]

    @F.pandas_udf("language string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for text in texts:
            grams, counts = trigrams(text)
            if not len(grams) or not languages:
                names.append("und")
                scores.append(0.0)
                continue
            vector = bundle(grams, counts, dimensions).astype("f8")
            cosine = vectors @ (vector / max(np.linalg.norm(vector), 1e-12))
            best = int(np.argmax(cosine))
            names.append(languages[best])
            scores.append(float(min(1.0, max(0.0, cosine[best]))))
        return pd.DataFrame({"language": names, "score": scores})

    return run(prompt)


def identify_languages(prompts: DataFrame, prototypes: Prototypes) -> DataFrame:
    """``record_id, language, score`` of each case prompt (``record_id, prompt``); other columns are not read.

    Repeated rows keep their rows, null ids stay null, empty input gives no rows. See ``identified``.
    """
    return prompts.select("record_id", identified("prompt", prototypes).alias("_l")).select("record_id", "_l.language", "_l.score")
