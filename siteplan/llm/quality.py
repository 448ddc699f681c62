"""Quality rules on prompts: measured once, failures kept as bits, policies applied to the bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules by bit. Each is true where a prompt fails; columns are those of ``measured``.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * n_capital_words > n_words",
    "few_letters": "2 * n_letter_words < n_words",
    "few_distinct_words": "n_words >= 50 and 10 * n_distinct_words < n_words",
}

#: Versioned policies: the rules whose failure rejects a prompt.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2": tuple(RULES),
}


def mask_of(policy: str) -> int:
    return sum(1 << bit for bit, rule in enumerate(RULES) if rule in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one prompt, in the order of ``MEASURES``. Words are runs of anything but ASCII white space."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        distinct = len(set(windows))
        if distinct < len(windows):
            count: dict[tuple[bytes, ...], int] = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    chars = len(text or "") - sum(raw.count(c) for c in b" \t\n\v\f\r")
    symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    capitals = sum(map(bytes.isupper, words))
    letters = sum(w != w.upper() or w != w.lower() or not w.isascii() for w in words)
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated, capitals, letters, len(set(words))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capital_words", "n_letter_words", "n_distinct_words")


def measured(prompt: Column | str) -> Column:
    """All measurements of a prompt as one struct of longs."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return run(prompt)


def rule_ledger(prompts: DataFrame) -> DataFrame:
    """Evaluate every rule once per case prompt (``record_id, prompt``): ``record_id``, the measurements, ``failures``.

    Bit k of ``failures`` is set where the k-th rule of ``RULES`` fails. Policies are masks over these bits, so a new
    version needs no second look at the texts. A null or empty prompt has zero measurements and fails ``few_words``.
    Repeated rows keep their rows, null ids stay null, empty input gives no rows; other columns are not read.
    """
    rows = prompts.select("record_id", measured("prompt").alias("_m")).select("record_id", *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return rows.withColumn("failures", failures.cast("long"))


def kept_by(policy: str, failures: Column | str = "failures") -> Column:
    """Whether a policy keeps a prompt: none of its bits is set."""
    failures = F.col(failures) if isinstance(failures, str) else failures
    return failures.bitwiseAND(F.lit(mask_of(policy))) == 0


def policy_ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many prompts fail it (``failed``) and how many only it rejects (``only``).

    Prompts are added up per bit pattern first, so the rules meet at most ``2 ** len(RULES)`` rows.
    """
    mask = mask_of(policy)
    patterns = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    rules = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, rule in enumerate(RULES) if mask >> bit & 1]))
    rows = patterns.select("_bits", "_n", rules.alias("_r"))
    hit = F.col("_bits").bitwiseAND(F.col("_r.bit")) != 0
    return rows.groupBy("_r.rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("_bits") == F.col("_r.bit"), F.col("_n"))), F.lit(0)).alias("only")
    )
