"""From prepared loans to risk classes: discretize, select, search for a model, score and class."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_modality
from ..operators import binning, logit, preparation, scorecard, selection, woe
from ..sources.files import once


@dataclass
class Scorecard:
    """What scorecard_of() makes: the model and the tables that describe it, all lazy but for the model."""

    model: scorecard.Model
    rows: DataFrame
    classes: DataFrame
    stability: DataFrame
    contributions: DataFrame


def discretized(loans: DataFrame, continuous: Sequence[str], target: str = "def", bins: int = 3) -> DataFrame:
    """loans with <v>_dis for each continuous variable: its bin between the displayed cutoffs fitted on the training sample, 1 at the riskiest end."""
    table = once(woe.woe_table(loans.where("dataset = 'Train'"), continuous, target, bins))  # a row a bin
    way = {r["variable"]: r["direction"] for r in woe.label_directions(table).collect()}
    out = loans
    for v in continuous:
        edges = woe.cutoffs(table, v)
        if edges:
            labels = [str(k + 1) for k in range(len(edges))]
            out = binning.apply_cutoffs(out, v, edges, f"{v}_dis", labels[::-1] if way[v] == "down" else labels)
    return out


def scorecard_of(
    loans: DataFrame, continuous: Sequence[str], categorical: Sequence[str], row_key: Sequence[str], constants: dict[str, float], medians: Sequence[str], folds: Sequence[int], size: int = 3, target: str = "def", period: str = "year"
) -> Scorecard:
    """Winsorize and impute on the training sample, select variables there by all four rules, discretize, fit all models of up to `size`
    variables, take the best that passes the checks (or the best of all if none passes), and build its scorecard.

    loans: the variables, target, period, dataset (Train, Test, OOT) and fold. Rows stay in Spark throughout; what comes to
    the driver are edges, medians, names and the patterns of the chosen variables.
    """
    ready = preparation.impute(preparation.winsorize(loans, continuous), constants, medians)  # outliers first: the medians are those of clipped values
    train = ready.where("dataset = 'Train'").withColumn("_target_period", F.concat_ws("_", target, period))
    kept = selection.select(train, continuous, categorical, folds, "_target_period", target)
    binned = discretized(ready, kept.continuous, target)
    candidates = [f"{v}_dis" for v in kept.continuous if f"{v}_dis" in binned.columns] + kept.categorical
    if not candidates:
        raise ValueError("the rules keep no variable")
    binned = binned.withColumns({c: as_modality(F.col(c)) for c in candidates})
    results = logit.search(binned, candidates, range(1, size + 1), target).persist()
    try:
        try:
            top = logit.best(results)
        except ValueError:
            top = logit.best(results, checked=False)
    finally:
        results.unpersist()
    references = logit.reference_modalities(binned.where("dataset = 'Train'"), top["variables"], target)
    model = logit.model_of(top, references)
    rows = scorecard.with_classes(scorecard.score(binned, model), row_key)
    return Scorecard(model, rows, scorecard.class_table(rows, target=target), scorecard.class_stability(rows, period, target), scorecard.contributions(binned, model))
