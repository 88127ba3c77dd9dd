"""Small scoring expressions: grades, link states, memory estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade thresholds, credit per status, HTTP codes that say nothing about a link.
GRADES = (
    (90.0, "A+", "Exemplary Reproducibility"),
    (80.0, "A", "Highly Reproducible"),
    (70.0, "B", "Moderately Reproducible"),
    (55.0, "C", "Limited Reproducibility"),
    (40.0, "D", "Poor Reproducibility"),
    (0.0, "F", "Non-Reproducible"),
)
CREDIT = {"specified": 1.0, "partial": 0.5, "inferred": 0.4, "missing": 0.0}
UNCLEAR_STATUS = (401, 403, 407, 408, 429)


def _band(score: Column, field: int) -> Column:
    out = None
    for threshold, *labels in GRADES:
        out = (F if out is None else out).when(score >= threshold, labels[field])
    return out.otherwise(GRADES[-1][1 + field])


def grade_for(score: Column) -> Column:
    return _band(score, 0)


def classification_for(score: Column) -> Column:
    return _band(score, 1)


def status_tenths(status: Column) -> Column:
    """Credit in tenths, so that sums are exact in any order of addition."""
    out = None
    for name, credit in CREDIT.items():
        out = (F if out is None else out).when(status == name, round(credit * 10))
    return out


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "success").when(score >= 60, "tertiary").otherwise("error")


def link_state(status: Column) -> Column:
    """True: resolves. False: certainly gone. Null: nothing can be said."""
    return F.when(status < 400, True).when((status < 500) & ~status.isin(*UNCLEAR_STATUS), False)


def estimate_vram(billions: Column) -> Column:
    """struct(inference_gb, training_gb), null when the size is not a positive number."""
    p = billions.cast("string").try_cast("double")
    return F.when(
        p > 0,
        F.struct(F.round(p * 2 * 1.2, 1).alias("inference_gb"), F.round(p * 16 * 1.2, 1).alias("training_gb")),
    )
