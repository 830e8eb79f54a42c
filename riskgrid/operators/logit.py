"""Exhaustive search of categorical logistic models.

Rows are collapsed to patterns (the modalities of all candidate variables) per split by one aggregate, and those to the
marginal patterns of each subset of variables. A model over a subset is a binomial model on its own patterns: few of
them go to the one task that fits the model; of many, tasks sum up the parts of each step, and only matrices as
large as the model's coefficients go to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_modality
from ..sources.files import once
from .metrics import measured, metrics
from .scorecard import Model, probability

#: A model of more patterns than this is not fitted within one task.
MOST_PATTERNS = 500_000
#: The fit on all training rows, in place of a fold that is left out.
WHOLE = -1
SAMPLES = {"train": "Train", "test": "Test", "oot": "OOT"}
METRICS = ("auc", "gini", "pr_auc", "recall", "f1")
PENALISED = ("gini", "pr_auc", "recall", "f1")
RESULT = (
    "k int, formula string, variables array<string>, error string, intercept double, coefficients map<string,double>, p_values map<string,double>, joint_p map<string,double>, "
    "vif map<string,double>, llr_p double, significant_ok boolean, modalities_ok boolean, variables_ok boolean, vif_ok boolean, all_ok boolean, "
    + ", ".join(f"{m}_{s} double" for s in ("train", "test", "oot", "fold_mean", "fold_min", "fold_sd") for m in METRICS)
    + ", "
    + ", ".join(f"{m}_penalised double" for m in PENALISED)
)


def reference_modalities(df: DataFrame, variables: Sequence[str], target: str = "def") -> dict[str, str]:
    """The modality of least default rate of each variable, the first in text order on ties; missing counts as 'nan'."""
    rows = df.select(F.col(target).cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), as_modality(F.col(v)).alias("modality")) for v in variables])).alias("p"))
    rates = rows.groupBy("p.variable", "p.modality").agg(F.avg("_y").alias("rate"))
    least = Window.partitionBy("variable").orderBy("rate", "modality")
    return {r["variable"]: r["modality"] for r in rates.withColumn("_k", F.row_number().over(least)).where("_k = 1").collect()}  # a row per variable


def patterns(df: DataFrame, variables: Sequence[str], target: str = "def", sample: str = "dataset", fold: str = "fold") -> DataFrame:
    """(variables..., dataset, fold, n, events): counts of each combination of modalities per sample and fold."""
    return df.groupBy(*[as_modality(F.col(v)).alias(v) for v in variables], F.col(sample).alias("dataset"), F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("events"))


def formulas(variables: Sequence[str], sizes: Sequence[int]) -> list[tuple[str, ...]]:
    return [c for k in sizes for c in combinations(variables, k)]


def formula_text(variables: Sequence[str], references: dict[str, str], target: str = "def") -> str:
    return f"{target} ~ " + " + ".join(f"{v} (reference {references[v]})" for v in variables)


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-squared variable, in closed form by the recurrence from df 1 or 2."""
    if df < 1 or not math.isfinite(x):
        return math.nan
    y = max(x, 0.0) / 2
    if y == 0:
        return 1.0
    out, term_at = (math.erfc(math.sqrt(y)), 0.5) if df % 2 else (math.exp(-y), 1.0)
    while term_at < df / 2:
        out += math.exp(term_at * math.log(y) - y - math.lgamma(term_at + 1))
        term_at += 1
    return out


def design(levels: pd.DataFrame, variables: Sequence[str], references: dict[str, str], known: dict[str, list[str]]) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Treatment coding with an intercept; known: the modalities of each variable in the fitted sample."""
    names = [(v, m) for v in variables for m in known[v] if m != references[v]]
    return np.column_stack([np.ones(len(levels)), *[(levels[v] == m).to_numpy(float) for v, m in names]]), names


def steps(x: np.ndarray, n: np.ndarray, s: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What rows of n trials and s events add to the information, the score and the log likelihood at beta."""
    mu = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -700, 700))), 1e-300, 1 - 1e-16)
    return x.T @ (x * (n * mu * (1 - mu))[:, None]), x.T @ (s - n * mu), float((s * np.log(mu) + (n - s) * np.log1p(-mu)).sum())


Sums = Callable[[Mapping[Hashable, np.ndarray]], Mapping[Hashable, tuple[np.ndarray, np.ndarray, float]]]


def newton(sums: Sums, starts: Mapping[Hashable, np.ndarray], rounds: int = 60) -> dict[Hashable, tuple[np.ndarray, np.ndarray, float] | str]:
    """Coefficients, covariance and log likelihood of several binomial logits, or what is wrong with one: separation or collinearity.

    sums gives the information, score and log likelihood of each fit at its coefficients; all fits that have not
    settled take a step at once.
    """
    out: dict[Hashable, tuple[np.ndarray, np.ndarray, float] | str] = {}
    live, settled = dict(starts), {}
    for _ in range(rounds):
        if not live:
            break
        got = sums(live)
        for key, beta in list(live.items()):
            info, gradient, _ = got[key]
            if not np.isfinite(info).all() or np.linalg.cond(info) > 1e13:
                out[key] = "singular information: separation or collinear modalities"
                del live[key]
                continue
            step = np.linalg.solve(info, gradient)
            live[key] = beta + step
            if np.abs(step).max() < 1e-10:
                settled[key] = live.pop(key)
    out |= dict.fromkeys(live, "no convergence")
    got = sums(settled) if settled else {}
    return out | {key: (beta, np.linalg.inv(got[key][0]), got[key][2]) for key, beta in settled.items()}


def start_of(n: float, s: float, width: int) -> np.ndarray | None:
    """The intercept of the overall rate; None where only one class is there."""
    return np.concatenate(([math.log(s / (n - s))], np.zeros(width - 1))) if 0 < s < n else None


def vifs(moments: np.ndarray) -> np.ndarray:
    """Variance inflation of each dummy: the diagonal of the inverse of their weighted correlations; infinite if singular.

    moments: the weighted sums of products of the columns of a design, the intercept first.
    """
    if len(moments) <= 2:
        return np.ones(len(moments) - 1)
    n, mean = moments[0, 0], moments[0, 1:] / moments[0, 0]
    cov = moments[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    try:
        return np.diag(np.linalg.inv(cov / np.outer(sd, sd)))
    except np.linalg.LinAlgError:
        return np.full(len(mean), np.inf)


def grouped_metrics(p: np.ndarray, n: np.ndarray, s: np.ndarray) -> dict[str, float]:
    """The metrics of scores p of patterns with n rows and s events."""
    values, at = np.unique(p, return_inverse=True)
    n, s = np.bincount(at, n)[::-1], np.bincount(at, s)[::-1]
    tp, fp, score = np.cumsum(s), np.cumsum(n - s), values[::-1]
    pos, neg = s.sum(), (n - s).sum()
    hit, wrong = s[score >= 0.5].sum(), (n - s)[score >= 0.5].sum()
    auc = float(((n - s) * (tp - s / 2)).sum() / (pos * neg)) if pos and neg else math.nan
    return {
        "auc": auc, "gini": 2 * auc - 1, "pr_auc": float((s * tp / (tp + fp)).sum() / pos) if pos else math.nan,
        "recall": float(hit / pos) if pos else math.nan, "f1": float(2 * hit / (hit + wrong + pos)) if hit + wrong + pos else math.nan,
    }


def described(variables: Sequence[str], names: Sequence[tuple[str, str]], fit: tuple[np.ndarray, np.ndarray, float], moments: np.ndarray, n: float, s: float, alpha: float, most_vif: float) -> dict[str, object]:
    """Coefficients, tests and checks of a fit on n rows with s events."""
    beta, cov, ll = fit
    label = [f"{v}={m}" for v, m in names]
    z, rate = beta / np.sqrt(np.diag(cov)), s / n
    ll0 = s * math.log(rate) + (n - s) * math.log(1 - rate)
    joint = {}
    for v in variables:
        i = [k + 1 for k, (w, _) in enumerate(names) if w == v]
        joint[v] = chi2_tail(float(beta[i] @ np.linalg.pinv(cov[np.ix_(i, i)]) @ beta[i]), len(i))
    inflation = vifs(moments)
    p_values = {k: math.erfc(abs(t) / math.sqrt(2)) for k, t in zip(label, z[1:].tolist())}
    row = {"intercept": float(beta[0]), "coefficients": dict(zip(label, beta[1:].tolist())), "p_values": p_values, "joint_p": joint, "vif": dict(zip(label, inflation.tolist())), "llr_p": chi2_tail(2 * (ll - ll0), len(beta) - 1)}
    row |= {"significant_ok": row["llr_p"] < alpha, "modalities_ok": all(p < alpha for p in p_values.values()), "variables_ok": all(p < alpha for p in joint.values()), "vif_ok": bool((inflation < most_vif).all())}
    return row | {"all_ok": all(row[f"{c}_ok"] for c in ("significant", "modalities", "variables", "vif"))}


def over_samples(samples: Mapping[str, Mapping[str, float]], folds: Sequence[Mapping[str, float]]) -> dict[str, object]:
    """Metrics by sample, over the folds, and what is left of the folds' mean after the gaps between samples."""
    row: dict[str, object] = {f"{m}_{name}": x for name, found in samples.items() for m, x in found.items()}
    if not folds:
        return row
    for m in METRICS:
        values = np.array([math.nan if f[m] is None else f[m] for f in folds], float)
        row |= {f"{m}_fold_mean": float(values.mean()), f"{m}_fold_min": float(values.min()), f"{m}_fold_sd": float(values.std(ddof=1)) if len(values) > 1 else None}
    for m in PENALISED:
        if f"{m}_test" in row and f"{m}_oot" in row:
            row[f"{m}_penalised"] = row[f"{m}_fold_mean"] - abs(row[f"{m}_train"] - row[f"{m}_test"]) - abs(row[f"{m}_train"] - row[f"{m}_oot"])
    return row


def start_row(variables: Sequence[str], references: Mapping[str, str]) -> dict[str, object]:
    return {"k": len(variables), "formula": formula_text(variables, references), "variables": list(variables), "error": None}


def score_of(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probabilities, rounded so that equal ones are equal in whatever order their terms were added."""
    return np.round(1 / (1 + np.exp(-x @ beta)), 12)


def fitted(table: pd.DataFrame, variables: Sequence[str], references: dict[str, str], alpha: float, most_vif: float) -> dict[str, object]:
    """One model on its own patterns (variables..., dataset, fold, n, events): its checks, metrics on all samples, and fits that leave a fold out."""
    row = start_row(variables, references)
    train = table[table["dataset"] == "Train"]
    parts, folds = {WHOLE: train}, sorted(train["fold"][train["fold"] >= 0].unique())
    parts |= {i: train[train["fold"] != i] for i in folds}
    designs, starts = {}, {}
    for key, part in parts.items():
        part = part.groupby(list(variables), as_index=False)[["n", "events"]].sum()
        x, names = design(part, variables, references, {v: sorted(part[v].unique()) for v in variables})
        n, s = part["n"].to_numpy(float), part["events"].to_numpy(float)
        designs[key], starts[key] = (x, names, n, s), start_of(n.sum(), s.sum(), x.shape[1])

    def sums(at: Mapping[Hashable, np.ndarray]) -> dict:
        return {key: steps(designs[key][0], designs[key][2], designs[key][3], beta) for key, beta in at.items()}

    fits = newton(sums, {k: b for k, b in starts.items() if b is not None}) | {k: "one class only" for k, b in starts.items() if b is None}

    def measure(part: pd.DataFrame, key: int) -> dict[str, float]:
        names = designs[key][1]
        x, _ = design(part, variables, references, {v: [m for w, m in names if w == v] for v in variables})
        return grouped_metrics(score_of(x, fits[key][0]), part["n"].to_numpy(float), part["events"].to_numpy(float))

    if isinstance(fits[WHOLE], str):
        return row | {"error": fits[WHOLE]}
    x, names, n, s = designs[WHOLE]
    row |= described(variables, names, fits[WHOLE], x.T @ (x * n[:, None]), n.sum(), s.sum(), alpha, most_vif)
    samples = {name: table[table["dataset"] == sample] for name, sample in SAMPLES.items()}
    failed = [f"fold {i}: {fits[i]}" for i in folds if isinstance(fits[i], str)]
    row["error"] = failed[-1] if failed else None
    return row | over_samples({name: measure(part, WHOLE) for name, part in samples.items() if len(part)}, [measure(train[train["fold"] == i], i) for i in folds if not isinstance(fits[i], str)])


def marginal_patterns(found: DataFrame, variables: Sequence[str], subsets: Sequence[Sequence[str]]) -> DataFrame:
    """(subset, levels, dataset, fold, n, events): counts by the modalities of each subset of variables, which is named by its place.

    found: patterns() of all variables. The largest subsets are summed up from it in one aggregate, the others from
    one that holds them.
    """
    of = {tuple(c): i for i, c in enumerate(subsets)}
    most = max(map(len, of))
    top = [c for c in of if len(c) == most]
    held = {c: next(t for t in top if set(c) <= set(t)) for c in of if len(c) < most and any(set(c) <= set(t) for t in top)}
    top += [c for c in of if len(c) < most and c not in held]
    sums = [F.sum("n").alias("n"), F.sum("events").alias("events")]
    each = F.explode(F.array(*[F.struct(F.lit(of[c]).alias("subset"), F.array(*[F.col(v) for v in c]).alias("levels")) for c in top])).alias("s")
    large = found.select(each, "dataset", "fold", "n", "events").groupBy("s.subset", "s.levels", "dataset", "fold").agg(*sums)
    if not held:
        return large
    large = once(large)
    down = found.sparkSession.createDataFrame([(of[t], of[c], [t.index(v) for v in c]) for c, t in held.items()], "subset int, below int, places array<int>")  # a row a subset
    below = large.join(F.broadcast(down), "subset").select(F.col("below").alias("subset"), F.transform("places", lambda p: F.get("levels", p)).alias("levels"), "dataset", "fold", "n", "events")
    return large.unionByName(below.groupBy("subset", "levels", "dataset", "fold").agg(*sums))


def coded(frame: pd.DataFrame, variables: Sequence[str], names: Sequence[tuple[str, str]]) -> np.ndarray:
    """The design of rows with a list of levels."""
    levels = pd.DataFrame(frame["levels"].tolist(), columns=list(variables), index=frame.index)
    return np.column_stack([np.ones(len(levels)), *[(levels[v] == m).to_numpy(float) for v, m in names]])


def fitted_apart(large: DataFrame, subsets: Mapping[int, Sequence[str]], references: dict[str, str], alpha: float, most_vif: float) -> list[dict[str, object]]:
    """What fitted() gives, for models whose patterns (rows of marginal_patterns()) no task holds.

    Each step of all models and folds is one aggregate: tasks add up their patterns' parts of the information and the
    score, and the sums, squares of the number of coefficients, go to the driver. Metrics are taken from counts by score.
    """
    spark = large.sparkSession
    train = large.where("dataset = 'Train'")
    seen = train.select("subset", "fold", "n", "events", F.posexplode("levels").alias("place", "level")).groupBy("subset", "fold", "place", "level").agg(F.sum("n").alias("n"), F.sum("events").alias("events")).toPandas()  # a row a modality and fold
    names: dict[tuple[int, int], list[tuple[str, str]]] = {}
    totals: dict[tuple[int, int], tuple[float, float]] = {}
    for i, variables in subsets.items():
        own = seen[seen["subset"] == i]
        for left in [WHOLE, *sorted(f for f in own["fold"].unique() if f >= 0)]:
            part = own[own["fold"] != left] if left != WHOLE else own
            names[i, left] = [(v, m) for k, v in enumerate(variables) for m in sorted(part.loc[part["place"] == k, "level"].unique()) if m != references[v]]
            first = part[part["place"] == 0]
            totals[i, left] = (float(first["n"].sum()), float(first["events"].sum()))

    def gathered(at: Mapping[Hashable, np.ndarray], moments: bool = False) -> dict[Hashable, np.ndarray]:
        """Sums of steps() over all patterns, flat; of products of columns instead, where moments are wanted."""

        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for frame in frames:
                for i, rows in frame.groupby("subset"):
                    for key in [k for k in at if k[0] == i]:
                        part = rows[rows["fold"] != key[1]] if key[1] != WHOLE else rows
                        x, n, s = coded(part, subsets[i], names[key]), part["n"].to_numpy(float), part["events"].to_numpy(float)
                        found = [x.T @ (x * n[:, None])] if moments else steps(x, n, s, at[key])
                        flat = np.concatenate([np.ravel(v) for v in found])
                        held[key] = held.get(key, 0) + flat
            for (i, left), flat in held.items():
                yield pd.DataFrame({"subset": i, "left_out": left, "place": np.arange(len(flat)), "x": flat})

        parts = train.mapInPandas(of, "subset int, left_out int, place int, x double").groupBy("subset", "left_out", "place").agg(F.sum("x").alias("x"))
        got = parts.orderBy("subset", "left_out", "place").toPandas()
        return {key: rows["x"].to_numpy() for key, rows in got.groupby(["subset", "left_out"])}

    def sums(at: Mapping[Hashable, np.ndarray]) -> dict[Hashable, tuple[np.ndarray, np.ndarray, float]]:
        out = {}
        for key, flat in gathered(at).items():
            p = len(at[key])
            out[key] = (flat[: p * p].reshape(p, p), flat[p * p : -1], float(flat[-1]))
        return out

    starts = {key: start_of(*totals[key], 1 + len(names[key])) for key in names}
    fits = newton(sums, {k: b for k, b in starts.items() if b is not None}) | {k: "one class only" for k, b in starts.items() if b is None}
    whole = [key for key in fits if key[1] == WHOLE and not isinstance(fits[key], str)]
    moments = gathered({key: fits[key][0] for key in whole}, moments=True) if whole else {}

    def rated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (i, sample, fold), rows in frame.groupby(["subset", "dataset", "fold"]):
                parts = [(name, (i, WHOLE)) for name, x in SAMPLES.items() if x == sample] + [(f"fold {fold}", (i, fold))] * bool(sample == "Train" and fold >= 0)
                for part, key in parts:
                    if not isinstance(fits.get(key, ""), str):
                        yield pd.DataFrame({"subset": i, "part": part, "score": score_of(coded(rows, subsets[i], names[key]), fits[key][0]), "n": rows["n"], "events": rows["events"]})

    counts = large.mapInPandas(rated, "subset int, part string, score double, n long, events long").groupBy("subset", "part", "score").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    found = {(r["subset"], r["part"]): {m: r[m] for m in METRICS} for r in measured(counts, ["subset", "part"]).collect()} if whole else {}  # a row a model and sample
    out = []
    for i, variables in subsets.items():
        row, fit = start_row(variables, references), fits[i, WHOLE]
        if isinstance(fit, str):
            out.append(row | {"error": fit})
            continue
        p = len(fit[0])
        row |= described(variables, names[i, WHOLE], fit, moments[i, WHOLE].reshape(p, p), *totals[i, WHOLE], alpha, most_vif)
        left = sorted(f for j, f in names if j == i and f != WHOLE)
        failed = [f"fold {f}: {fits[i, f]}" for f in left if isinstance(fits[i, f], str)]
        row["error"] = failed[-1] if failed else None
        out.append(row | over_samples({name: found[i, name] for name in SAMPLES if (i, name) in found}, [found[i, f"fold {f}"] for f in left if (i, f"fold {f}") in found]))
    return out


def search(df: DataFrame, variables: Sequence[str], sizes: Sequence[int] | None = None, target: str = "def", alpha: float = 0.05, most_vif: float = 10.0) -> DataFrame:
    """A row per model over each subset of variables of the given sizes (all, if none are given); see RESULT for the columns.

    df: the variables, target, dataset (Train, Test, OOT) and fold (rows of a null fold are in no fold that is left out). A model that
    can't be fitted has an error and nulls. One aggregate collapses the rows, another gives each subset its own patterns. Those
    of a subset with at most MOST_PATTERNS go to the task that fits it; the other subsets are fitted by fitted_apart().
    """
    references = reference_modalities(df.where("dataset = 'Train'"), variables, target)
    subsets = formulas(variables, sizes or range(1, len(variables) + 1))
    found = patterns(df, variables, target).withColumn("fold", F.coalesce(F.col("fold").cast("int"), F.lit(WHOLE - 1)))
    table = once(marginal_patterns(found, variables, subsets))
    columns = [c.strip().split(" ")[0] for c in RESULT.replace("map<string,double>", "map").split(",")]
    large = [r[0] for r in table.groupBy("subset").count().where(F.col("count") > MOST_PATTERNS).select("subset").collect()]  # at most a row a subset

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = subsets[key[0]]
        levels = pd.DataFrame(frame["levels"].tolist(), columns=list(own), index=frame.index)
        row = fitted(pd.concat([levels, frame[["dataset", "fold", "n", "events"]]], axis=1), own, references, alpha, most_vif)
        return pd.DataFrame([{c: row.get(c) for c in columns}], columns=columns)

    out = table.where(~F.col("subset").isin(large)).groupBy("subset").applyInPandas(of, RESULT)
    if not large:
        return out
    rows = fitted_apart(table.where(F.col("subset").isin(large)), {i: subsets[i] for i in large}, references, alpha, most_vif)
    return out.unionByName(df.sparkSession.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], RESULT))


def best(results: DataFrame, k: int | None = None, checked: bool = True) -> dict[str, object]:
    """The model of the largest penalised Gini among those that pass all checks, as a dict; ValueError if none does."""
    rows = results.where("gini_penalised is not null")
    rows = rows.where("all_ok") if checked else rows
    rows = rows.where(F.col("k") == k) if k else rows
    top = rows.orderBy(F.desc("gini_penalised"), "formula").limit(1).collect()
    if not top:
        raise ValueError("no model passes the checks")
    return top[0].asDict()


#: What models are ordered by, the best first.
ORDER = ("all_ok", "gini_penalised", "pr_auc_penalised", "recall_penalised", "f1_penalised", "gini_fold_mean")


def ordered(results: DataFrame) -> DataFrame:
    """Add place: 1 for the best model of its size, by ORDER (each falling, nulls last), then formula."""
    by = Window.partitionBy("k").orderBy(*[F.col(c).desc_nulls_last() for c in ORDER], "formula")  # models of a size, not rows
    return results.withColumn("place", F.row_number().over(by))


def model_of(result: dict[str, object], references: dict[str, str]) -> Model:
    """A row of search() as a model that scorecard.score(), scorecard.probability() and sources.files.save_model() take."""
    coefficients: dict[str, dict[str, float]] = {v: {} for v in result["variables"]}
    for name, value in result["coefficients"].items():
        v = next(v for v in result["variables"] if name.startswith(f"{v}="))
        coefficients[v][name[len(v) + 1 :]] = value
    return {"intercept": result["intercept"], "references": {v: references[v] for v in coefficients}, "coefficients": coefficients}


def scorecard_table(spark: SparkSession, model: Model) -> DataFrame:
    """(variable, modality, coefficient, is_reference) of a model, the intercept among them."""
    rows = [("Intercept", "", float(model["intercept"]), False)]
    for v, c in model["coefficients"].items():
        rows += [(v, model["references"][v], 0.0, True), *[(v, m, float(x), False) for m, x in c.items()]]
    return spark.createDataFrame(rows, "variable string, modality string, coefficient double, is_reference boolean")


def evaluate(df: DataFrame, model: Model, target: str = "def", by: str = "dataset") -> DataFrame:
    """metrics() of a saved model's probabilities per sample."""
    return metrics(probability(df, model, "_p"), "_p", target, [by])
