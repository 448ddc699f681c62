"""Toxicity of prompts: maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan.llm.common import stage

#: A token is a run of letters, lower-cased.
TOKEN = re.compile(r"[^\W\d_]+")
STEM = 5


class ToxicityModel(NamedTuple):
    """Log-odds of tokens and of stems of other tokens, the penalty per token, and the calibration.

    The evidence of a passage of score S in a prompt of n tokens is ``decay * S - log_k - log(n)``, minus the log of the
    expected number of such passages in clean text. ``intercept`` and ``slope`` turn summed evidence into a score.
    """

    tokens: dict[str, float]
    stems: dict[str, float]
    penalty: float
    decay: float
    log_k: float
    intercept: float
    slope: float


class _Scores(dict):
    """Log-odds by token, with the stem's where the token is unknown; bounded."""

    def __init__(self, model: ToxicityModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        known = self.model.tokens.get(token)
        value = (self.model.stems.get(token[:STEM], 0.0) if known is None else known) - self.model.penalty
        if len(self) > 300_000:
            self.clear()
        if len(token) <= 40:
            self[token] = value
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` with a positive sum, in linear time.

    Runs of one sign are added up first, then runs are merged from left to right: a new positive run joins back to the
    nearest earlier segment with a lower left sum whose right sum it exceeds, until none is left.
    """
    positive = scores > 0
    if not positive.any():
        return []
    cuts = np.append(0, np.flatnonzero(positive[1:] != positive[:-1]) + 1)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    ends = np.append(cuts[1:], len(scores))
    stack: list[list[float]] = []
    lower: list[int] = []
    for a, b in zip(cuts[positive[cuts]].tolist(), ends[positive[cuts]].tolist(), strict=True):
        left, right = total[a], total[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= right:
                stack.append([a, b, left, right])
                lower.append(j)
                break
            a, left = int(stack[j][0]), stack[j][2]
            del stack[j:], lower[j:]
    return [(int(a), int(b), float(right - left)) for a, b, left, right in stack]


def _passages(text: str | None, scores: _Scores, decay: float, log_k: float) -> tuple[float | None, float, list[tuple[int, int, float]]]:
    """Evidence of the best passage, if any, summed evidence of the significant ones (else the best), and those by token positions."""
    tokens = TOKEN.findall((text or "").lower())
    if not tokens:
        return None, -10.0, []
    values = np.fromiter(map(scores.__getitem__, tokens), "f8", len(tokens))
    found = [(a, b, decay * s - log_k - np.log(len(tokens))) for a, b, s in maximal_segments(values)]
    if not found:
        return None, -10.0, []
    best = float(max(p[2] for p in found))
    significant = [p for p in found if p[2] > 3.0]
    evidence = sum(p[2] for p in significant) if significant else best
    return best, float(min(12.0, max(-10.0, evidence))), significant


def fit_toxicity(labelled: DataFrame, max_terms: int = 100_000, prior_stem: float = 20.0, prior_token: float = 10.0, penalty: float = 0.5) -> ToxicityModel:
    """Learn a model from labelled case prompts (``prompt, toxic``), two thirds for log-odds, one third to calibrate.

    The rate of a token among toxic prompts has a Dirichlet prior centred on the rate of its stem (its first five
    letters), which has one centred on the overall rate; ``prior_token`` and ``prior_stem`` are their weights. A token
    counts once per prompt, and its log-odds are drawn towards 0 by their standard deviation. The model keeps the ``max_terms`` tokens and as many stems of largest absolute log-odds;
    all others count as neutral. ``decay`` solves the equation of expected exponentiated clean scores, ``log_k`` is
    fitted to the best segments of clean prompts, and a logistic curve over binned evidence gives the score.
    Null prompts and labels are left out; with no labels left every score is that of no evidence.
    """
    spark = labelled.sparkSession
    rows = labelled.select("prompt", (F.col("toxic") == 1).alias("toxic")).where(F.col("prompt").isNotNull() & F.col("toxic").isNotNull())
    rows = stage(rows.withColumn("_fold", F.pmod(F.xxhash64("prompt"), F.lit(3))), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            names, pairs = list(seen), list(seen.values())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.int64())], names=["token", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token in set(TOKEN.findall(text.lower())):
                    seen.setdefault(token, [0, 0])[toxic] += 1
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    tokens = rows.where("_fold > 0").select("prompt", "toxic").mapInArrow(count, "token string, toxic long, clean long")
    tokens = stage(tokens.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "token-counts")
    total = tokens.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    share = min(0.99, max(0.01, (total["t"] or 0) / max(1, (total["t"] or 0) + (total["c"] or 0))))
    stem = F.substring("token", 1, STEM)
    stems = tokens.groupBy(stem.alias("stem")).agg(F.sum("toxic").alias("_t"), F.sum("clean").alias("_c"))
    stems = stems.select("stem", (F.col("_t") + prior_stem * share).alias("_a"), (F.col("_c") + prior_stem * (1 - share)).alias("_b"))
    odds = float(np.log(share / (1 - share)))

    def log_odds(toxic: Column, clean: Column) -> Column:
        """Against the overall odds, drawn towards 0 by one standard deviation."""
        value = F.log(toxic / clean) - odds
        return F.signum(value) * F.greatest(F.abs(value) - F.sqrt(1 / toxic + 1 / clean), F.lit(0.0))

    share_of_stem = F.col("_a") / (F.col("_a") + F.col("_b"))
    weight = log_odds(F.col("toxic") + prior_token * share_of_stem, F.col("clean") + prior_token * (1 - share_of_stem))
    weighted = stage(tokens.join(stems, stem == stems["stem"]).select("token", "clean", weight.alias("_w")), "token-odds")
    strong = F.abs("_w") >= 0.3
    kept = {r["token"]: r["_w"] for r in weighted.where(strong).orderBy(F.desc(F.abs("_w")), "token").limit(max_terms).select("token", "_w").collect()}
    stem_odds = stems.select("stem", log_odds(F.col("_a"), F.col("_b")).alias("_w")).where(strong)
    kept_stems = {r["stem"]: r["_w"] for r in stem_odds.orderBy(F.desc(F.abs("_w")), "stem").limit(max_terms).collect()}
    bins = weighted.groupBy(F.round(F.when(strong, F.col("_w")).otherwise(0.0), 1).alias("w")).agg(F.sum("clean").alias("n")).collect()
    decay = _decay(np.array([r["w"] for r in bins]) - penalty, np.array([r["n"] for r in bins], "f8"))
    model = ToxicityModel(kept, kept_stems, penalty, decay, 0.0, -3.0, 0.6)
    best = rows.where((F.col("_fold") == 0) & ~F.col("toxic")).select(_scored("prompt", model, spark)["best"].alias("b"))
    clean = best.agg(F.avg("b").alias("m")).first()["m"]
    log_k = clean - 0.5772156649 if clean is not None else 0.0
    model = model._replace(log_k=log_k)
    held = rows.where("_fold = 0").select("toxic", F.round(_scored("prompt", model, spark)["evidence"], 1).alias("e"))
    curve = held.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("int")).alias("t")).collect()
    intercept, slope = _logistic(np.array([r["e"] for r in curve], "f8"), np.array([r["n"] for r in curve], "f8"), np.array([r["t"] for r in curve], "f8"))
    return model._replace(intercept=intercept, slope=slope)


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of the mean of ``exp(decay * score)`` = 1; 1.0 where there is none."""
    if not len(scores) or weights.sum() <= 0 or scores.max() <= 0 or (weights * scores).sum() >= 0 or not (weights[scores > 0] > 0).any():
        return 1.0
    p = weights / weights.sum()
    low, high = 1e-6, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def _logistic(x: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Logistic curve of ``t`` of ``n`` over ``x``, held near intercept -3 and slope 0.6 by one pseudo-observation."""
    start = beta = np.array([-3.0, 0.6])
    design = np.stack([np.ones_like(x), x], 1)

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float((n * np.logaddexp(0, z) - t * z).sum() + ((at - start) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (t - n * p) - (beta - start)
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.eye(2), gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
    return float(beta[0]), float(max(beta[1], 0.01))


def _scored(prompt: Column | str, model: ToxicityModel, spark: SparkSession) -> Column:
    sent = spark.sparkContext.broadcast(model)
    cache: list[_Scores] = []

    @F.pandas_udf("best double, evidence double, score double, passages array<struct<start:int,end:int,evidence:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        if not cache:
            cache.append(_Scores(m))
        best, evidence, passages = [], [], []
        for text in texts:
            b, e, found = _passages(text, cache[0], m.decay, m.log_k)
            best.append(b)
            evidence.append(e)
            passages.append([{"start": a, "end": b, "evidence": float(s)} for a, b, s in found])
        e = np.array(evidence, "f8")
        return pd.DataFrame({"best": pd.array(best, "Float64"), "evidence": e, "score": 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * e, -30, 30))), "passages": passages})

    return run(prompt)


def score_toxicity(prompts: DataFrame, model: ToxicityModel) -> DataFrame:
    """``record_id, score, passages`` of each case prompt (``record_id, prompt``), whole texts in linear time.

    ``passages`` lists every significant passage as token positions (start, end past the last) with its evidence;
    ``score`` rises with their sum. A null or empty prompt has no passage and the score of no evidence. Repeated rows
    keep their rows, null ids stay null, empty input gives no rows; other columns are not read.
    """
    scored = prompts.select("record_id", _scored("prompt", model, prompts.sparkSession).alias("_s"))
    return scored.select("record_id", "_s.score", "_s.passages")
