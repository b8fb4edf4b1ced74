"""Score columns: diminishing-return curves over weighted counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["critical", "high", "medium", "low", "info"]
#: hundredths of a point that one finding of a severity weighs; null counts as low, an unknown severity as OTHER
WEIGHTS = {"critical": 100, "high": 50, "medium": 20, "low": 8, "info": 0}
OTHER = 10


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): what half-up rounding means for every score here."""
    return F.floor(x + 0.5).cast("int")


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info, 5 for anything else."""
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def penalty_hundredths(severity: Column) -> Column:
    out = F.lit(OTHER)
    for s, w in WEIGHTS.items():
        out = F.when(severity == s, w).otherwise(out)
    return F.when(severity.isNull(), WEIGHTS["low"]).otherwise(out)


def curve(hundredths: Column, k: float = 5, floor: int = 5) -> Column:
    """100 / (1 + penalty / k), rounded, never under `floor`."""
    return F.greatest(F.lit(floor), round_half_up(F.lit(100.0) / (F.lit(1.0) + hundredths / F.lit(100.0) / F.lit(float(k)))))


def count_score(count: Column, k: float = 8, floor: int = 5) -> Column:
    return curve(count * 100, k, floor)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# Terms of each overall score. A term is a column with its default and weight in hundredths, or one of the sums below.
PROFILES: dict[str, list[tuple[str, int | None, int]]] = {
    "cli": [("vision", 50, 15), ("stack", 60, 10), ("criticals", None, 20), ("unit", 50, 10), ("accessibility", 70, 10), ("contract", 50, 10), ("chaos", 50, 10), ("predictive", 50, 15)],
    "save": [("vision", 50, 25), ("stack", 60, 15), ("unit", 50, 10), ("accessibility", 70, 10), ("any_finding", None, 40)],
    "local": [("agentic", 50, 20), ("stack", 60, 15), ("unit", 50, 15), ("criticals", None, 30), ("accessibility", 70, 10), ("dora", 50, 10)],
    "dashboard": [("vision", 50, 30), ("stack", 60, 20), ("found_criticals", None, 30), ("unit", 50, 20)],
    "report": [("accessibility", 70, 10), ("criticals_and_highs", None, 15), ("few_users", None, 10), ("unit", 50, 10), ("vision", 50, 25), ("scope", 30, 15), ("stack", 60, 15)],
    "digest": [("criticals_and_highs", None, 1), ("unit", 0, 1), ("stack", 0, 1), ("scope", 0, 1), ("accessibility", 0, 1)],
}


def overall(profile: str) -> Column:
    """The overall score of a row by one of PROFILES, from columns of dimension scores (null: missing).

    A zero counts as missing too, but for `local`, which keeps it. `digest` is the plain mean of scores kept within 0
    and 100, without accessibility where accessibility_applies is false. Other columns: critical, high and findings of
    the security dimension, max_users of the load test.
    """
    number = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    less = lambda c: F.greatest(F.lit(0), F.lit(100) - c)
    criticals = less(20 * number("critical", 0))
    sums = {
        "criticals": criticals, "any_finding": less(5 * number("findings", 0)), "found_criticals": F.when(number("findings", 0) > 0, criticals).otherwise(50),
        "criticals_and_highs": less(20 * number("critical", 0) + 5 * number("high", 0)), "few_users": F.when(F.col("max_users") < 50, 70).otherwise(100),
    }
    if profile == "digest":
        clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), number(c, 0)))
        terms = [sums[c] if c in sums else clamp(c) for c, _, _ in PROFILES[profile]]
        applies = F.coalesce("accessibility_applies", F.lit(True))
        sum_of = lambda some: sum(some, F.lit(0))
        return round_half_up(F.when(applies, sum_of(terms) / F.lit(5.0)).otherwise(sum_of(terms[:-1]) / F.lit(4.0)))
    known = lambda c: F.col(c) if profile == "local" else F.nullif(F.col(c), F.lit(0))
    total = sum((weight * (sums[c] if default is None else F.coalesce(known(c), F.lit(default))) for c, default, weight in PROFILES[profile]), F.lit(0))
    return round_half_up(total / F.lit(100.0))
