"""Stage three: screen variables by up to seven sources, vote, prune, select."""

from __future__ import annotations

import logging
import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components, information, moments, profiles, regression, sampling, stepwise, voting
from ..operators.rows import prefixed, work_file
from ..sources.sinks import write_table, write_variable_list
from .config import ReduceConfig, Roles

LOG = logging.getLogger("scorewright")
STEPWISE_GROUP = 100


def groups_of(names: list[str], count: int) -> list[list[str]]:
    """The names in ``count`` runs whose lengths differ by at most one."""
    count = max(min(count, len(names)), 1)
    small, extra = divmod(len(names), count)
    out, at = [], 0
    for i in range(count):
        n = small + (i < extra)
        out.append(names[at : at + n])
        at += n
    return [g for g in out if g]


def _table(spark, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _number(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


#: Groups of more variables than this have their components found by products with the data, without a matrix of all pairs.
MATRIX_VARIABLES = 600


def principal(df: DataFrame, names: list[str], k: int, least: float, weight: str | None = None, known: moments.Gram | None = None) -> dict[str, float | None]:
    """Largest correlation with a leading component: by groups of about 5 k, survivors once more together."""

    def one(group: list[str]) -> dict[str, float | None]:
        if not known and len(group) > MATRIX_VARIABLES:
            total, multiply = moments.correlation_products(df, group, weight)
            if not total:
                return dict.fromkeys(group)
            values, vectors, error = components.leading_pairs(multiply, len(group), min(k, len(group)))
            LOG.debug("components of %d variables: residual %g", len(group), error)
            return dict(zip(group, np.abs(vectors * np.sqrt(np.maximum(values, 0))).max(1).tolist()))
        g = known.part(group) if known else moments.gram(df, group, weight)
        return dict(zip(group, components.best_component_correlation(g.correlation(), k).tolist())) if g.rows else dict.fromkeys(group)

    groups = groups_of(names, max(math.ceil(len(names) / (5 * k)), 1)) if names else []
    out = {v: f for g in groups for v, f in one(g).items()}
    if len(groups) > 1:
        left = [v for v, f in out.items() if f is not None and f >= least]
        out = one(left) if left else {}
    return out


def clusters(df: DataFrame, names: list[str], most: int, ratio: float, weight: str | None = None, known: moments.Gram | None = None) -> list[tuple[str, int, float]]:
    """(variable, cluster, ratio): by groups of about 5 times ``most``, survivors once more together."""

    def one(group: list[str]) -> list[tuple[str, int, float]]:
        g = known.part(group) if known else moments.gram(df, group, weight)
        return sorted(((group[v], c, r) for v, c, r in components.cluster(g.correlation(), most)), key=lambda x: (x[1], x[0])) if g.rows else []

    groups = groups_of(names, max(math.ceil(len(names) / (5 * most)), 1)) if names else []
    out = [x for g in groups for x in one(g)]
    if len(groups) > 1:
        left = [v for v, _, r in out if r <= ratio]
        out = one(left) if left else []
    return out


def reduce_variables(df: DataFrame, roles: Roles, config: ReduceConfig = ReduceConfig(), output: str | None = None, keys: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(master table of the variables, selected names in order).

    Variables are the columns with the roles' prefix.  The master table has
    basic statistics, one 0/1 column per source that ran, num_sources, infv and
    the drop marks, and the figures behind the flags.  The row order of a
    variable's ties in rank bins follows ``keys`` (the id column).
    """
    cfg = config.normal()
    spark, dep = df.sparkSession, roles.dep_var
    keys = keys or [roles.id]
    weight = (cfg.weight or roles.weight) if cfg.redu_weight else None
    if cfg.redu_weight and not weight:
        raise ValueError("weighted reduction needs a weight column")
    work = work_file(df)
    if cfg.samplesize is not None:
        work = sampling.row_cap(work, keys, cfg.samplesize, cfg.random_seed)
    names = sorted(prefixed(df, roles.prefix, (*roles.keep_list, dep)))
    random.Random(cfg.random_seed).shuffle(names)
    work = work.select(*dict.fromkeys([*keys, dep, *([weight] if weight else []), *names])).persist()
    try:
        return _reduce(spark, work, names, dep, keys, weight, cfg, output)
    finally:
        work.unpersist()


def _reduce(spark, work, names, dep, keys, weight, cfg: ReduceConfig, output):
    sources: dict[str, DataFrame] = {}
    flag = lambda ok: int(bool(ok))
    # Without missing values, as after a recode, the moments of all variables together serve every group of them.
    known = None
    if names and len(names) <= MATRIX_VARIABLES and (cfg.principal_flg or cfg.cluster_flg or cfg.regression_flg):
        whole = moments.gram(work, [*names, dep], weight)
        known = whole if whole.rows == whole.seen else None
    if cfg.univ_reg_flg:
        fits = regression.univariate(work, names, dep, cfg.binary_dv, weight)
        sources["univsource"] = _table(spark, [(v, flag(f.p <= cfg.maxpuni), _number(f.p), f.sign, _number(f.r2)) for v, f in fits.items()], "variable string, univsource int, pvalue double, sign string, cc_rsq double")
    if cfg.correlation_flg:
        corr = moments.correlation_with(work, names, dep)
        sources["corrsource"] = _table(spark, [(v, flag(r is not None and r >= cfg.corrcut), r) for v, r in corr.items()], "variable string, corrsource int, corr double")
    if cfg.principal_flg:
        found = principal(work, names, cfg.nprin, cfg.minprin, weight, known)
        sources["prinsource"] = _table(spark, [(v, flag(f is not None and f >= cfg.minprin), f) for v, f in found.items()], "variable string, prinsource int, factor double")
    if cfg.cluster_flg:
        sources["clusource"] = _table(spark, [(v, flag(r <= cfg.maxratio), c, float(r)) for v, c, r in clusters(work, names, cfg.maxc, cfg.maxratio, weight, known)], "variable string, clusource int, cluster int, rsquare_ratio double")
    parts = groups_of(names, math.ceil(len(names) / STEPWISE_GROUP)) if names else []
    if cfg.logistic_flg:
        rows = [(v, 1, s, float(p)) for g in parts for v, s, p in stepwise.stepwise_logistic(work, g, dep, cfg.alphalog, weight, cfg.likelihood_ratio)]
        sources["logsource"] = _table(spark, rows, "variable string, logsource int, log_step int, log_pvalue double")
    if cfg.regression_flg:
        rows = [(v, 1, s, float(p)) for g in parts for v, s, p in stepwise.stepwise_linear(work, g, dep, cfg.alphareg, weight, known)]
        sources["regsource"] = _table(spark, rows, "variable string, regsource int, reg_step int, reg_pvalue double")
    if cfg.information_flg:
        iv = information.information(work, names, dep, keys, cfg.decile, max(len(names), 1), weight)
        rows = [(r.variable, flag(r.infv is not None and r.infv >= cfg.infvcut), r.infv, r.gini, r.ks) for r in iv.collect()]
        sources["infvsource"] = _table(spark, rows, "variable string, infvsource int, infv double, gini double, ks double")

    stats = profiles.basic_stats(work, names) if names else _table(spark, [], "variable string, count bigint, minimum double, maximum double, mean double")
    rows = stats.collect()
    master = voting.vote(_table(spark, [tuple(r) for r in rows], "variable string, count bigint, minimum double, maximum double, mean double"), sources)
    always = tuple(n for n, on in (("logsource", cfg.logistic_flg), ("regsource", cfg.regression_flg)) if on)
    target = None
    if cfg.ind_correlation_flg:
        pool = sorted(r.variable for r in master.where(voting.candidates(master, cfg.sources, always)).select("variable").collect())
        dropped: list[str] = []
        if len(pool) > 1:
            target = moments.correlation_with(work, pool, dep)
            dropped = voting.prune(pool, [(i, j) for i, j, _ in moments.strong_pairs(work, pool, cfg.maxcorr)], target)
        master = master.withColumn("drop_corr", F.when(F.col("variable").isin(*dropped), "Y").otherwise("") if dropped else F.lit(""))
    if cfg.ind_dv_corr_flg:
        with_dep = moments.correlation_with(work, names, dep)
        table = _table(spark, [(v, r or 0.0) for v, r in with_dep.items()], "variable string, dv_corr double")
        master = master.join(F.broadcast(table), "variable", "left").withColumn("drop_dv_corr", F.when(F.col("dv_corr") > cfg.max_dv_corr, "Y").otherwise(""))
    master = voting.ordered(master)
    selected = [r.variable for r in voting.select(master, cfg.sources, always).select("variable").collect()]
    LOG.info("reduce: sources %s, %d variables, %d selected: %s", ", ".join(sources), len(names), len(selected), " ".join(selected))
    if output:
        write_table(master.coalesce(1), f"{output}/reduction", "csv")
        write_variable_list(spark, selected, f"{output}/selected_variables.txt")
    return master, selected
