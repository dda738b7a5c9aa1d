"""Bootstrap intervals without drawing rows: in each replicate a row counts as often as a Poisson(1) number says.

The number is a hash of the row's key and the replicate, so that no row is numbered, no draw is joined back, and all
statistics of a replicate, in whatever cell, see the same resample of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.hashing import hashed
from gaugewell.operators.association import holm, kendall, pearson, pearson_of, spearman, with_rank_p
from gaugewell.operators.replicates import EDGES, PER_DIGEST, counted_pairs, moments, rank_correlations

REPLICATES = 500


def poisson_counts(rows: DataFrame, key: str, replicates: int = REPLICATES, stream: str = "boot") -> DataFrame:
    """``rows`` for each replicate ``b`` in which they count, with ``w``, how often: about 0.63 rows per row and replicate."""
    number = lambda j: F.conv(F.substring("_digest", 8 * j + 1, 8), 16, 10).cast("long")
    edges = F.array(*[F.lit(e) for e in EDGES])
    dealt = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // PER_DIGEST)))).withColumn("_digest", hashed(F.lit(stream), key, "_g"))
    times = F.transform(F.array(*[number(j) for j in range(PER_DIGEST)]), lambda u: F.size(F.filter(edges, lambda e: e <= u)))
    each = dealt.select(*rows.columns, "_g", F.posexplode(times).alias("_j", "w")).withColumn("b", F.col("_g") * PER_DIGEST + F.col("_j"))
    return each.where((F.col("w") > 0) & (F.col("b") < replicates)).select(*rows.columns, "b", "w")


def percentiles(rows: DataFrame, value: str, *cell: str, low: str, high: str, alpha: float = 0.05) -> DataFrame:
    """The central interval of ``value`` over the rows of a cell, which are its replicates; nulls are left out."""
    at = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*cell).agg(at(alpha / 2).alias(low), at(1 - alpha / 2).alias(high))


def intervals(rows: DataFrame, x: str, y: str, key: str, *cell: str, replicates: int = REPLICATES, kinds: tuple[str, ...] = ("r", "rho")) -> DataFrame:
    """95 % intervals of the correlation (``r_low``, ``r_high``) and of the rank correlation (``rho_low``, ``rho_high``) per cell,
    over resamples of ``key``, which no cell has twice."""
    found = None
    for kind, each in replicated(rows, x, y, key, *cell, replicates=replicates, kinds=kinds).items():
        part = percentiles(each, kind, *cell, low=f"{kind}_low", high=f"{kind}_high")
        found = part if found is None else found.join(part, list(cell))
    return found


def replicated(rows: DataFrame, x: str, y: str, key: str, *cell: str, replicates: int = REPLICATES, kinds: tuple[str, ...] = ("r", "rho")) -> dict[str, DataFrame]:
    """The correlation ``r`` and the rank correlation ``rho`` of each cell and replicate ``b``, by kind; rows that lack x or y are left out."""
    pairs = counted_pairs(rows, x, y, key, *cell, replicates=replicates)
    each = {"r": lambda: pearson_of(moments(pairs, replicates, *cell), *cell, "b"), "rho": lambda: rank_correlations(pairs, replicates, *cell)}
    return {kind: each[kind]() for kind in kinds}


def correlation_table(rows: DataFrame, x: str, y: str, key: str, *cell: str, kinds: tuple[str, ...] = ("r", "rho"), tau: bool = False, replicates: int = REPLICATES) -> DataFrame:
    """Per cell: n, the correlations of ``kinds`` (``r``, ``rho``) with 95 % intervals, ``tau`` if asked for, and of the rank
    correlation its p and Holm's over all cells. Rows that lack x or y are left out; ``key`` is what is resampled."""
    rows = rows.select(*cell, key, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = with_rank_p(spearman(rows, x, y, *cell))
    if "r" in kinds:
        found = found.join(pearson(rows, x, y, *cell).drop("n"), list(cell))
    if tau:
        found = found.join(kendall(rows, x, y, *cell).drop("n"), list(cell))
    found = found.join(intervals(rows, x, y, key, *cell, replicates=replicates, kinds=kinds), list(cell), "left")
    return holm(found.withColumn("_family", F.lit("all")), "p", "_family", ties=cell).drop("_family")


def sql_counts(source: str, key: str, replicates: int = REPLICATES, stream: str = "boot") -> str:
    """SQL of the keys' counts: ``key``, ``b``, ``w``."""
    times = " + ".join(f"(u >= {e})::BIGINT" for e in EDGES)
    number = f"CAST('0x' || substr(sha256('{stream}|' || {key} || '|' || g), 8 * j + 1, 8) AS BIGINT)"
    return f"SELECT {key}, b, w FROM (SELECT {key}, b, {times} AS w FROM (SELECT {key}, {PER_DIGEST} * g + j AS b, {number} AS u FROM (SELECT DISTINCT {key} FROM {source}), (SELECT unnest(range(0, {(replicates - 1) // PER_DIGEST + 1})) AS g), (SELECT unnest(range(0, {PER_DIGEST})) AS j)) WHERE b < {replicates}) WHERE w > 0"


def weighted_sql(x: str, y: str, source: str, cell: str, name: str, least: float = 5) -> str:
    """SQL of the correlation ``name`` of rows that count ``w`` times."""
    spread = lambda a, b: f"(sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b}) / sum(w))"
    flat = lambda a: f"{spread(a, a)} > 1e-12 * sum(w * {a} * {a})"
    return f"SELECT {cell}, CASE WHEN sum(w) >= {least} AND {flat(x)} AND {flat(y)} THEN {spread(x, y)} / sqrt({spread(x, x)} * {spread(y, y)}) END AS {name} FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {cell}"


def ranked_sql(x: str, y: str, source: str, cell: str, w: str = "w") -> str:
    """SQL of rows with ``rx`` and ``ry``, their average ranks in the cell less the mean rank, and ``w``."""
    rank = lambda v: f"sum({w}) OVER (PARTITION BY {cell} ORDER BY {v} RANGE UNBOUNDED PRECEDING)::DOUBLE - sum({w}) OVER (PARTITION BY {cell}, {v}) / 2.0::DOUBLE - sum({w}) OVER (PARTITION BY {cell}) / 2.0::DOUBLE"
    return f"SELECT {cell}, {w} AS w, {rank(x)} AS rx, {rank(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


def p_sql(t: str, df: str) -> str:
    """SQL of the two-sided p of Student's t with a whole number of degrees of freedom, by its finite series."""
    a, c = f"atan(abs({t}) / sqrt({df}))", f"cos(atan(abs({t}) / sqrt({df})))"
    even = f"sin({a}) * list_sum(list_transform(range(0, ({df}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow({c}, 2 * k)))"
    odd = f"2 / pi() * ({a} + sin({a}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow({c}, 2 * k + 1))), 0))"
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def rank_p_sql(rho: str = "rho", n: str = "n") -> str:
    """SQL of the p of a rank correlation by the t approximation."""
    return f"CASE WHEN {rho} IS NOT NULL THEN " + p_sql(f"({rho} * sqrt(({n} - 2) / greatest(1 - {rho} * {rho}, 1e-300)))", f"({n} - 2)::BIGINT") + " END"


def correlation_sql(long: str, cell: str, key: str = "item", kinds: tuple[str, ...] = ("r", "rho"), tau: str | None = None, more: str = "") -> tuple[str, dict[str, str]]:
    """SQL of :func:`correlation_table` over the named table ``long`` (cell, key, x, y): the last query, and what goes before it.

    ``tau`` is a query of cell and tau; ``more`` goes before the list of columns.
    """
    one = f"(SELECT *, 1 AS w FROM {long})"
    parts = {
        "counts": sql_counts(long, key),
        "drawn": f"SELECT {cell}, b, x, y, sum(w) AS w FROM {long} JOIN counts USING ({key}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {cell}, b, x, y",
        "ranked": ranked_sql("x", "y", "drawn", f"{cell}, b"),
        "rho_each": weighted_sql("rx", "ry", "ranked", f"{cell}, b", "rho"),
        "r_each": weighted_sql("x", "y", "drawn", f"{cell}, b", "r"),
        "point": f"SELECT * FROM (SELECT {cell}, count(*) AS n FROM {long} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {cell}) JOIN ({weighted_sql('rx', 'ry', '(' + ranked_sql('x', 'y', one, cell) + ')', cell, 'rho')}) USING ({cell}) JOIN ({weighted_sql('x', 'y', one, cell, 'r')}) USING ({cell})",
        "tested": f"SELECT *, {rank_p_sql()} AS p FROM point",
        "stepped": f"SELECT *, CASE WHEN p IS NOT NULL THEN max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY p IS NULL ORDER BY p, {cell} ROWS UNBOUNDED PRECEDING) END AS p_holm FROM (SELECT *, count(*) OVER (PARTITION BY p IS NULL) AS m, row_number() OVER (PARTITION BY p IS NULL ORDER BY p, {cell}) AS k FROM tested)",
    }
    for kind in kinds:
        parts[f"{kind}_ends"] = f"SELECT {cell}, quantile_cont({kind}, 0.025) AS {kind}_low, quantile_cont({kind}, 0.975) AS {kind}_high FROM {kind}_each GROUP BY {cell}"
    columns = ["n", *[f"round({kind}{end}, 6) AS {kind}{end}" for kind in kinds for end in ("", "_low", "_high")], "round(p, 6) AS p", "round(p_holm, 6) AS p_holm"]
    joins = "".join(f" LEFT JOIN {kind}_ends USING ({cell})" for kind in kinds)
    if tau is not None:
        columns.append("tau")
        joins += f" LEFT JOIN (SELECT {cell}, tau FROM ({tau})) USING ({cell})"
    return f"SELECT {more}{cell}, {', '.join(columns)} FROM stepped{joins}", parts
