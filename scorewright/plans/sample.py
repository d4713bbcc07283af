"""Stage one: exclude, split, oversample, carve out validation."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.predicates import speaks_of_table
from ..operators.rows import exclude
from ..sources.sinks import write_table
from .config import LABEL, MODEL, TEST, Roles, SampleConfig


LOG = logging.getLogger("scorewright")


def target_frequency(df: DataFrame, dep_var: str, most: int = 1000) -> DataFrame:
    """(target, count), the most frequent first; a target with more than ``most`` values shows only those."""
    return df.groupBy(F.col(dep_var).alias("target")).count().orderBy(F.col("count").desc(), "target").limit(most)


def sample(df: DataFrame, roles: Roles, config: SampleConfig = SampleConfig(), output: str | None = None, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, sample rates).

    ``exclusion_if`` is SQL, or Python over ``inds`` in which ``id``, ``dep_var``
    and ``weight`` stand for those columns' names.
    Rows are drawn by hashed keys (the id column, or ``keys``).  Oversampling
    works on a binary target and draws with replacement, before validation rows
    are carved out, so copies of one row may be in Model and Val.  With an
    ``output`` folder both results are written there too.
    """
    keys = keys or [roles.id]
    text = config.exclusion_if
    if text and speaks_of_table(text):
        kept = exclude(df, python=text, names={k: v for k, v in (("id", roles.id), ("dep_var", roles.dep_var), ("weight", roles.weight)) if v})
    else:
        kept = exclude(df, text)
    labelled = sampling.split(kept, keys, config.split_portion, config.seed)
    if config.binary_dv and config.bootstrap:
        model, test = labelled.where(F.col(LABEL) == MODEL), labelled.where(F.col(LABEL) == TEST)
        rows, rate = model.agg(F.count("*"), F.avg(roles.dep_var)).first()
        size = sampling.bootstrap_size(rows, rate, config.oversampled_rr, config.min_num_resp)
        LOG.info("sample: %d model rows, target rate %s, resampled to %d at %s", rows, rate, size, config.oversampled_rr)
        model = sampling.resample(model, keys, roles.dep_var, size, config.oversampled_rr, config.min_num_resp, config.seed)
        if LOG.isEnabledFor(logging.INFO):
            LOG.info("sample: target values of the resampled rows: %s", {r[0]: r[1] for r in target_frequency(model, roles.dep_var).collect()})
        labelled = model.unionByName(test.withColumn(sampling.COPY, F.lit(0)))
    out = sampling.carve_validation(labelled, keys, config.seed)
    if sampling.COPY in out.columns and sampling.COPY not in df.columns:
        out = out.drop(sampling.COPY)
    rates = sampling.rate_table(out, roles.dep_var)
    if output:
        write_table(out, f"{output}/resampled")
        write_table(rates, f"{output}/sample_rates", "csv")
    return out, rates
