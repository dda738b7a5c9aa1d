"""Evidence of four families per dataset and model: association (A), increment (B), limited responses (C), unseen items (D).

Predictions are summed to one loss per cell, seed and fold before anything is paired; every later table is as small as the list of
hypotheses. ``flags`` put all families into one long table, which ``matrix``, ``audit`` and ``verdict`` fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.operators import evaluation
from gaugewell.operators.association import holm, p_df4, t_two_sided_p
from gaugewell.operators.resampling import REPLICATES, percentiles, poisson_counts

ALPHA = 0.05
SEEDS = 5
#: The 0.975 quantile of Student's t with four degrees of freedom.
T_DF4 = 2.7764451051977987
HYPOTHESIS = ("family", "dataset", "backbone", "model", "comparator")

# The labels of a cell and of the whole.
DISTINCTIVE = "DISTINCTIVE_SUPPORT"
PARTIAL = "PARTIAL_ASSOCIATION_AND_DEPLOYMENT_WITHOUT_INCREMENTAL"
MEASUREMENT = "MEASUREMENT_ONLY_NO_DEPLOYMENT_SUPPORT"
DEPLOYMENT = "DEPLOYMENT_SIGNAL_WITHOUT_MEASUREMENT_SUPPORT"
NONE = "NO_DISTINCTIVE_SUPPORT"
MIXED = "MIXED_OR_PARTIAL_DISTINCTIVE_SUPPORT"


def pooled_losses(rows: DataFrame, *cell: str) -> DataFrame:
    """Log loss per cell with the predictions of its folds pooled: ``n``, ``folds``, ``log_loss``; rows have ``fold``, ``y``, ``p``."""
    each = evaluation.binary_metrics(rows, *cell, "fold").select(*cell, "n", "log_loss")
    mean = F.sum(F.col("n") * F.col("log_loss")) / F.sum("n")
    return each.groupBy(*cell).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("folds"), mean.alias("log_loss"))


def comparator_deltas(losses: DataFrame, models: tuple[str, ...], comparators: tuple[str, ...]) -> DataFrame:
    """Loss of each comparator less that of each model, in the same family, dataset, backbone, exposure and seed.

    Columns: those of a hypothesis, ``exposure``, ``seed``, ``d`` and ``paired``, whether both hold as many predictions and folds. A
    model's row without the comparator's has no row here, so that its hypothesis comes out with fewer seeds or exposures.
    """
    keys = ["family", "dataset", "backbone", "exposure", "seed"]
    own = losses.where(F.col("condition").isin(*models)).select(*keys, F.col("condition").alias("model"), "n", "folds", "log_loss")
    other = losses.where(F.col("condition").isin(*comparators)).select(*keys, F.col("condition").alias("comparator"), F.col("n").alias("_n"), F.col("folds").alias("_folds"), F.col("log_loss").alias("_loss"))
    paired = (F.col("n") == F.col("_n")) & (F.col("folds") == F.col("_folds"))
    return own.join(other, keys).select(*HYPOTHESIS, "exposure", "seed", (F.col("_loss") - F.col("log_loss")).alias("d"), paired.alias("paired"))


def seed_tests(deltas: DataFrame) -> DataFrame:
    """One row per hypothesis: the mean of ``d`` over exposures in a seed, tested against 0 over five seeds.

    ``exposures`` (the fewest of a seed), ``seeds``, ``effect``, ``sd``, 95 % interval by Student's t (``low``, ``high``), ``t``, ``p``,
    ``p_holm`` over the family, and ``paired``. Without exactly five seeds that differ there is no test: nulls.
    """
    by_seed = deltas.groupBy(*HYPOTHESIS, "seed").agg(F.avg("d").alias("d"), F.count_distinct("exposure").alias("exposures"), F.bool_and("paired").alias("paired"))
    found = by_seed.groupBy(*HYPOTHESIS).agg(F.min("exposures").alias("exposures"), F.count(F.lit(1)).alias("seeds"), F.avg("d").alias("effect"), F.stddev_samp("d").alias("sd"), F.bool_and("paired").alias("paired"))
    se = F.when(F.col("seeds") == SEEDS, F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt(F.lit(float(SEEDS))))
    tested = found.withColumn("_se", se).withColumn("low", F.col("effect") - T_DF4 * F.col("_se")).withColumn("high", F.col("effect") + T_DF4 * F.col("_se")).withColumn("t", F.col("effect") / F.col("_se")).drop("_se")
    return holm(tested.withColumn("p", p_df4(F.col("t"))), "p", "family", ties=HYPOTHESIS[1:])


def _gains(rows: DataFrame, y: str, known: str, score: str, weight: str, *cell: str) -> DataFrame:
    """Adjusted R2 of y on known and score less that on known alone, rows counted ``weight`` times; null where it has no value."""
    w = F.col(weight).cast("double")
    names = {"y": F.col(y).cast("double"), "k": F.col(known).cast("double"), "s": F.col(score).cast("double")}
    pairs = ("yy", "kk", "ss", "yk", "ys", "ks")
    sums = rows.groupBy(*cell).agg(F.sum(w).alias("n"), *[F.sum(w * v).alias(f"_{a}") for a, v in names.items()], *[F.sum(w * names[a] * names[b]).alias(f"_{a}{b}") for a, b in pairs])
    spread = lambda a, b: F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}") / F.col("n")
    varied = reduce(lambda a, b: a & b, [spread(a, a) > 1e-12 * F.col(f"_{a}{a}") for a in names])
    corr = lambda a, b: spread(a, b) / F.sqrt(spread(a, a) * spread(b, b))
    found = sums.select(*cell, "n", *[F.when(varied & (F.col("n") > 4), corr(a, b)).alias(f"_r{a}{b}") for a, b in ("yk", "ys", "ks")])
    both = F.when(F.abs("_rks") < 1 - 1e-9, (F.pow("_ryk", F.lit(2)) + F.pow("_rys", F.lit(2)) - 2 * F.col("_ryk") * F.col("_rys") * F.col("_rks")) / (1 - F.pow("_rks", F.lit(2))))
    found = found.withColumn("_one", F.pow("_ryk", F.lit(2))).withColumn("_both", F.least(both, F.lit(1.0)))
    adjusted = lambda r2, k: 1 - (1 - F.col(r2)) * (F.col("n") - 1) / (F.col("n") - k - 1)
    return found.select(*cell, "n", F.col("_one").alias("r2_known"), F.col("_both").alias("r2_both"), F.when(F.col("n") > 4, adjusted("_both", 2) - adjusted("_one", 1)).alias("gain"))


def increments(rows: DataFrame, y: str, known: str, score: str, key: str, *cell: str, replicates: int = REPLICATES) -> DataFrame:
    """What ``score`` explains of ``y`` beyond ``known``: per cell n, r2_known, r2_both, ``gain`` of adjusted R2 with a 95 % interval over
    Poisson resamples of ``key``, two-sided ``p`` of the score's coefficient and ``p_holm`` over all cells.

    Rows that lack a value are left out. A cell of fewer than five rows, with a constant column or with score and known in line has nulls.
    """
    rows = rows.select(*cell, key, y, known, score).dropna()
    point = _gains(rows.withColumn("_w", F.lit(1)), y, known, score, "_w", *cell)
    ends = percentiles(_gains(poisson_counts(rows, key, replicates), y, known, score, "w", *cell, "b"), "gain", *cell, low="low", high="high")
    df = F.col("n") - 3
    t = F.sqrt(F.greatest(F.col("r2_both") - F.col("r2_known"), F.lit(0.0)) * df / F.greatest(1 - F.col("r2_both"), F.lit(1e-300)))
    tested = point.withColumn("p", F.when(F.col("gain").isNotNull(), t_two_sided_p(t, df))).join(ends, list(cell), "left")
    return holm(tested.withColumn("_family", F.lit("all")), "p", "_family", ties=cell).drop("_family").withColumn("n", F.col("n").cast("long"))


def flags(association: DataFrame, increment: DataFrame, tests: DataFrame) -> DataFrame:
    """All families as one long table: family, dataset, model, backbone, comparator, effect, low, high, p_holm, supported.

    A is supported by Holm's p alone, B if besides its interval lies above 0, C and D if besides the effect is above 0. What has no
    p is not supported; C and D also not where predictions are not paired.
    """
    significant = F.coalesce(F.col("p_holm") < ALPHA, F.lit(False))
    columns = ("family", "dataset", "model", "backbone", "comparator", "effect", "low", "high", "p_holm", "supported")
    single = lambda frame, family, value, low, high, rule: frame.select(F.lit(family).alias("family"), "dataset", "model", F.lit("-").alias("backbone"), F.lit("-").alias("comparator"), F.col(value).alias("effect"), F.col(low).alias("low"), F.col(high).alias("high"), "p_holm", rule.alias("supported"))
    a = single(association, "A", "rho", "rho_low", "rho_high", significant)
    b = single(increment, "B", "gain", "low", "high", significant & F.coalesce(F.col("low") > 0, F.lit(False)))
    c = tests.withColumn("supported", significant & F.coalesce(F.col("effect") > 0, F.lit(False)) & F.coalesce("paired", F.lit(False)))
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in (a, b, c)])


def label(a: Column, b: Column, deployed: Column) -> Column:
    """The first of five labels whose rule holds."""
    return F.when(a & b & deployed, DISTINCTIVE).when(a & deployed & ~b, PARTIAL).when(a & b & ~deployed, MEASUREMENT).when(~a & deployed, DEPLOYMENT).otherwise(NONE)


def matrix(long: DataFrame, limited: tuple[str, ...], unseen: tuple[str, ...], backbones: tuple[str, ...], strict: bool = True) -> DataFrame:
    """One row per dataset and model with the four families side by side, and the label of the evidence.

    ``limited`` and ``unseen`` are the comparators of families C and D. Columns: ``a`` and ``b`` with ``_low``, ``_high``, ``_holm``, ``_ok``;
    ``c_<comparator>`` and ``d_<backbone>_<comparator>`` with ``_holm``; ``c_ok`` (every comparator beaten), ``d_ok`` (every comparator
    beaten on one backbone), ``complete`` (no value is missing) and ``label``. With ``strict`` a row that is not complete raises
    an error when it is computed, and so does a part that stands twice.
    """
    fields = {"effect": "", "low": "_low", "high": "_high", "p_holm": "_holm"}
    parts = {f"c_{c}": (F.col("family") == "C") & (F.col("comparator") == c) for c in limited}
    parts |= {f"d_{b}_{c}": (F.col("family") == "D") & (F.col("backbone") == b) & (F.col("comparator") == c) for b in backbones for c in unseen}
    whole = {"a": F.col("family") == "A", "b": F.col("family") == "B"}
    values = [F.max(F.when(test, F.col(f))).alias(name + end) for name, test in whole.items() for f, end in fields.items()]
    values += [F.max(F.when(test, F.col(f))).alias(name + fields[f]) for name, test in parts.items() for f in ("effect", "p_holm")]
    held = {name: F.coalesce(F.bool_or(F.when(test, F.col("supported"))), F.lit(False)).alias(f"_{name}") for name, test in {**whole, **parts}.items()}
    most = F.greatest(*[F.count_if(test) for test in {**whole, **parts}.values()]).alias("_most")
    wide = long.groupBy("dataset", "model").agg(*values, *held.values(), most)
    every = lambda names: reduce(lambda a, b: a & b, [F.col(f"_{n}") for n in names])
    c_ok = every([f"c_{c}" for c in limited])
    d_ok = reduce(lambda a, b: a | b, [every([f"d_{b}_{c}" for c in unseen]) for b in backbones])
    shown = [n for n in wide.columns if not n.startswith("_")]
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in shown])
    labelled = label(F.col("_a"), F.col("_b"), c_ok | d_ok)
    if strict:
        wrong = F.concat(F.lit("evidence is missing or stands twice: "), F.col("dataset"), F.lit(", "), F.col("model"))
        labelled = F.when(complete & (F.col("_most") == 1), labelled).otherwise(F.raise_error(wrong))
    return wide.select(*shown, F.col("_a").alias("a_ok"), F.col("_b").alias("b_ok"), c_ok.alias("c_ok"), d_ok.alias("d_ok"), complete.alias("complete"), labelled.alias("label"))


def audit(long: DataFrame, unseen: tuple[str, ...]) -> DataFrame:
    """Each significant hypothesis of family D: direction, which comparators its dataset, backbone and model beat, and whether all."""
    d = long.where("family = 'D'")
    cell = ["dataset", "model", "backbone"]
    beaten = d.groupBy(*cell).agg(*[F.coalesce(F.bool_or(F.when(F.col("comparator") == c, F.col("supported"))), F.lit(False)).alias(f"clears_{c}") for c in unseen])
    found = d.where((F.col("p_holm") < ALPHA) & (F.col("effect") != 0)).select(*cell, "comparator", "effect", "low", "high", "p_holm", F.when(F.col("effect") > 0, "better").otherwise("worse").alias("direction"))
    whole = reduce(lambda a, b: a & b, [F.col(f"clears_{c}") for c in unseen])
    return found.join(beaten, cell).withColumn("full_triplet", whole)


def verdict(cells: DataFrame) -> DataFrame:
    """One row over the labels of ``matrix``: how many cells have each of them, and the verdict on the whole."""
    names = {"distinctive": DISTINCTIVE, "partial": PARTIAL, "measurement_only": MEASUREMENT, "deployment_only": DEPLOYMENT, "none": NONE}
    counts = cells.agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("label") == v).alias(k) for k, v in names.items()])
    full = (F.col("distinctive") == F.col("cells")) & (F.col("cells") > 0)
    return counts.withColumn("verdict", F.when(full, DISTINCTIVE).when(F.col("distinctive") > 0, MIXED).otherwise(NONE))
