"""Stage two: profile, impute and recode variables by type; the fitted recode is a list of SQL expressions."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TRUE_RECODE
from ..operators import levels, nominal, numeric, profiles
from ..operators.moments import signed_correlation_with
from ..operators.quantiles import crossings, edges_bin, picked, thresholds, width_bin
from ..operators.rows import work_file
from ..sources.readers import check_variables
from ..sources.sinks import write_recodes, write_table
from .config import LABEL, Recode, RecodeConfig, Roles

LOG = logging.getLogger("scorewright")
META = "var_name string, type string, overall_good int, miss_cnt bigint, uniq_cnt bigint, max_cnt bigint, ones_cnt bigint, p_lo double, p_hi double, var_lb double, var_ub double, var_median double, miss_impute double, chisq double, fvalue double, pvalue double, new_var string, sign string, relationship string"
_FIELDS = [x.split()[0] for x in META.split(", ")]


@dataclass
class Recoded:
    """What the stage has learned: expressions, facts of each variable, and report rows.

    Variables of many levels are scored by tables (level, fgroup, score), by
    variable in ``tables``; ``close`` lets go of those that are cached.
    """

    recodes: list[Recode] = field(default_factory=list)
    meta: list[dict] = field(default_factory=list)
    profile: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, df: DataFrame, roles: Roles) -> DataFrame:
        """id, label, target, kept columns and the new columns, in one projection; works on a stream as well.

        A variable with a score table is joined to it by its level, by broadcast
        if the table is small.
        """
        base = [c for c in dict.fromkeys([roles.id, LABEL, roles.dep_var, roles.weight, *roles.keep_list]) if c and c in df.columns]
        kept = [r for r in self.recodes if r.keep]
        for r in {r.source: r for r in kept if r.kind == "lookup"}.values():
            table = self.tables[r.source] if r.source in self.tables else df.sparkSession.read.parquet(r.facts["path"])
            df = levels.with_lookup(df, r.source, table, r.facts["levels"])
        return df.select(*base, *[F.expr(r.sql).alias(r.name) for r in kept])

    def close(self) -> None:
        for table in self.tables.values():
            table.unpersist()

    def meta_table(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(m.get(f) for f in _FIELDS) for m in self.meta], META)

    def write_report(self, recoded: DataFrame, roles: Roles, folder: str) -> None:
        """Five tables under ``folder``: facts of the good variables of each type, and the correlations of the new columns with the target.

        ``recoded`` is what ``apply`` gave.  Each is a CSV of its own.
        """
        meta = self.meta_table(recoded.sparkSession).where("overall_good = 1")
        for kind, names in (("binary", roles.bin_vars), ("nominal", roles.nom_vars), ("ordinal", roles.ord_vars), ("continuous", roles.cont_vars)):
            write_table(meta.where(F.col("var_name").isin(*names)).coalesce(1), f"{folder}/{kind}_variables", "csv")
        made = [r.name for r in self.recodes if r.keep and r.name in recoded.columns]
        found = signed_correlation_with(recoded, made, roles.dep_var)
        table = recoded.sparkSession.createDataFrame(sorted(found.items(), key=lambda x: -abs(x[1] or 0.0)), "variable string, correlation double")
        write_table(table.coalesce(1), f"{folder}/correlations", "csv")

    def programs(self) -> list[dict]:
        """The recodes as plain data, to be written and read back; those by table name its path, which they have if the stage had an output folder."""
        return [{"name": r.name, "kind": r.kind, "source": r.source, "sql": r.sql, "keep": r.keep} | ({"facts": r.facts} if r.kind == "lookup" else {}) for r in self.recodes]

    @staticmethod
    def from_programs(items: list[dict]) -> Recoded:
        return Recoded([Recode(**x) for x in items])


def _text(v) -> str:
    """A literal in Spark SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)


def _member_sql(var: str, dtype: str, some: list) -> str:
    x = f"`{var}`" if dtype == "string" else f"cast(`{var}` as string)"
    listed = ", ".join(_text(v) for v in some if v is not None)
    hit = f"coalesce({x} in ({listed}), false)" if listed else "false"
    return f"({hit} or `{var}` is null)" if None in some else hit


#: Counters of the sketch that finds the most frequent levels, and levels of it that are counted exactly.
COUNTERS, CANDIDATES = 4000, 20
#: Stands for all levels that can't be the most frequent one.
_OTHER = "\0other"


class _Facts:
    """What the gates, fits and reports of all variables ask of the data, answered by three scans.

    The first is one aggregate: counts, extremes, means, sketches of quantiles and
    of frequent levels.  The second counts values inside the brackets of all
    quantiles that any step needs.  The third is one long aggregate over levels: all
    levels of a nominal variable that may pass its gate and of ordinal ones with
    few; of others only the candidates for the most frequent level.
    """

    def __init__(self, work: DataFrame, roles: Roles, cfg: RecodeConfig):
        self.work, self.roles, self.cfg, self.types = work, roles, cfg, dict(work.dtypes)
        self.numeric = [*roles.ord_vars, *roles.cont_vars]
        self._first()
        self._levels()

    def _first(self) -> None:
        roles, cfg = self.roles, self.cfg
        # Columns go by number, so that no name clashes with those of the scan.
        names = list(dict.fromkeys([roles.dep_var, *roles.bin_vars, *roles.nom_vars, *self.numeric]))
        at = {n: f"c{i}" for i, n in enumerate(names)}
        data = self.work.select(*[F.col(f"`{n}`").alias(c) for n, c in at.items()])
        y = F.col(at[roles.dep_var])
        asked: dict[tuple, F.Column] = {("rows", ""): F.count(F.lit(1)), ("mean", ""): F.avg(y)}
        for v in roles.bin_vars:
            asked |= {("missing", v): F.count_if(F.col(at[v]).isNull()), ("ones", v): F.count_if(profiles.binary_recode(at[v], self.types[v]) == 1)}
        for v in (*roles.nom_vars, *roles.ord_vars):
            text = F.col(at[v]).cast("string")
            asked |= {("top", v): F.expr(f"approx_top_k(cast({at[v]} as string), {CANDIDATES}, {COUNTERS})"), ("distinct", v): F.approx_count_distinct(text)}
        for v in (*roles.nom_vars, *self.numeric):
            asked["missing", v] = F.count_if(F.col(at[v]).isNull())
        for v in self.numeric:
            x = F.col(at[v])
            number, there = x.cast("double"), F.when(x.isNotNull(), y)
            asked |= {("low", v): F.min(number), ("high", v): F.max(number), ("average", v): F.avg(number), ("missing_rate", v): F.avg(F.when(x.isNull(), y)), ("varies", v): F.min(there) != F.max(there)}
        self.probs = {"nearest": list(numeric.PROBS), "gate": [cfg.p_lo / 100, cfg.p_hi / 100], "bins": [0.01, 0.99] if cfg.equal_dist else [i / cfg.num_category for i in range(cfg.num_category + 1)]}
        method = {"nearest": "nearest", "gate": "linear", "bins": "linear"}
        also = list(asked.values())
        shares = sorted({float(q) for probs in self.probs.values() for q in probs})
        wanted = lambda _, n: [t for k, probs in self.probs.items() for t in thresholds(n, probs, method[k])]
        spreads = crossings(data, [at[v] for v in self.numeric], shares, wanted, also=also, keep=tuple(at.values()))
        self.found = dict(zip(asked, also))
        self.nobs, self.mean = self.found["rows", ""], self.found["mean", ""]
        self.quantiles = {v: {k: picked(spreads[at[v]], probs, method[k]) for k, probs in self.probs.items()} for v in self.numeric if at[v] in spreads}
        self.present = {v: spreads[at[v]].rows for v in self.quantiles}

    def summary(self, v: str) -> numeric.Numeric:
        f, n = self.found, self.quantiles[v]["nearest"]
        s = numeric.Numeric(v, self.present[v], f["missing", v], f["low", v], f["high", v], f["average", v], *n, f["missing_rate", v])
        s.lb, s.ub = numeric.bounds(s.low, s.p1, s.p25, s.p75, s.p99, s.high)
        return s

    def _levels(self) -> None:
        cfg, ask = self.cfg, {}
        self.full: set[str] = set()
        for v in dict.fromkeys([*self.roles.nom_vars, *self.roles.ord_vars]):
            top, distinct, nominal_one = self.found["top", v] or [], self.found["distinct", v], v in self.roles.nom_vars
            # The sketch's counts are off by 4 rows a counter and rows at most.
            most = max((t["count"] for t in top), default=0) + 4 * self.nobs / COUNTERS
            if nominal_one and self.found["missing", v] <= self.nobs * cfg.missrate and most >= self.nobs * (1 - cfg.concrate) or distinct <= 20 * CANDIDATES:
                self.full.add(v)
                ask[v] = F.col(f"`{v}`").cast("string")
            else:
                x = F.col(f"`{v}`").cast("string")
                some = [t["item"] for t in top if t["item"] is not None]
                ask[v] = F.when(x.isNull() | x.isin(*some), x).otherwise(F.lit(_OTHER))
        self.level_rows = levels.level_table(self.work, ask, self.roles.dep_var).persist() if ask else None
        self.sizes: dict[str, tuple[int, int]] = {}
        if ask:
            known = self.level_rows.where(~F.col("level").eqNullSafe(_OTHER))
            for r in known.groupBy("variable").agg(F.count("*").alias("uniq"), F.max("dcount").alias("most")).collect():
                self.sizes[r.variable] = (r.uniq if r.variable in self.full else max(self.found["distinct", r.variable] + (self.found["missing", r.variable] > 0), r.uniq), r.most)

    def few(self, variables: list[str]) -> dict[str, list[tuple]]:
        """Level statistics (level, count, mean, variance) of variables whose number of levels is bounded."""
        out: dict[str, list[tuple]] = {v: [] for v in variables}
        for r in self.level_rows.where(F.col("variable").isin(*variables)).collect() if variables else []:
            out[r.variable].append((r.level, r.dcount, r.dmean, r.dvar))
        return out

    def close(self) -> None:
        if self.level_rows is not None:
            self.level_rows.unpersist()


def _binary(facts: _Facts, out: Recoded, reports: list) -> None:
    roles, cfg, nobs = facts.roles, facts.cfg, facts.nobs
    for v in roles.bin_vars:
        miss, ones = facts.found["missing", v], facts.found["ones", v]
        good = nobs * cfg.missrate >= miss and nobs * (1 - cfg.concrate) <= ones <= nobs * cfg.concrate
        out.meta.append({"var_name": v, "type": facts.types[v], "overall_good": int(good), "miss_cnt": miss, "ones_cnt": ones})
        if not good:
            continue
        test = f"cast(`{v}` as double) = 1D" if facts.types[v] != "string" else f"trim(cast(`{v}` as string)) in ({', '.join(_text(x) for x in TRUE_RECODE)})"
        out.recodes.append(Recode(f"{roles.prefix}{v}", "binary", v, f"cast(coalesce({test}, false) as int)"))
        if cfg.profiling:
            reports.append(profiles.Profile(v, profiles.binary_group(v, facts.types[v])))


def _nominal(facts: _Facts, out: Recoded, reports: list, direct: list, output: str | None) -> None:
    roles, cfg, nobs = facts.roles, facts.cfg, facts.nobs
    passed = []
    for v in roles.nom_vars:
        miss, (uniq, most) = facts.found["missing", v], facts.sizes.get(v, (0, 0))
        meta = {"var_name": v, "type": facts.types[v], "overall_good": 0, "miss_cnt": miss, "uniq_cnt": uniq, "max_cnt": most}
        out.meta.append(meta)
        if v in facts.full and uniq and nobs * cfg.missrate >= miss and nobs * (1 - cfg.concrate) <= most <= nobs * cfg.concrate:
            passed.append((v, meta))
    rows = facts.few([v for v, m in passed if m["uniq_cnt"] <= cfg.many_levels])
    settings = {"minbinnp": cfg.minbinnp, "minbinnc": cfg.minbinnc, "talpha": cfg.talpha, "bonfer": cfg.bonfer}
    for v, meta in passed:
        few = cfg.valcnt == 0 or meta["uniq_cnt"] <= cfg.valcnt
        meta["overall_good"] = int(few)
        if v in rows:
            _few_levels(facts, out, reports, v, few, nominal.collapse_rows(rows[v], nobs, facts.mean, **settings))
        else:
            _many_levels(facts, out, direct, v, few, meta["uniq_cnt"], settings, output)


def _few_levels(facts: _Facts, out: Recoded, reports: list, v: str, few: bool, made: nominal.Nominal) -> None:
    roles, cfg, dtype = facts.roles, facts.cfg, facts.types[v]
    if few and cfg.nom_method.upper() == "BINARY":
        out.recodes += [Recode(f"{roles.prefix}{v}_X{g}", "nominal", v, f"cast({_member_sql(v, dtype, some)} as int)") for g, some in enumerate(made.groups, 1)]
    elif few:
        values = made.indexes if cfg.nom_method.upper() == "INDEX" else made.means
        cases = " ".join(f"when {_member_sql(v, dtype, some)} then {_text(None if x is None else float(x))}" for some, x in zip(made.groups, values))
        out.recodes.append(Recode(f"{roles.prefix}{v}", "nominal", v, f"coalesce(cast(case {cases} end as double), 0D)"))
    if cfg.profiling:
        group = F.lit(None).cast("string")
        for some in made.groups:
            group = F.when(nominal.member(F.col(f"`{v}`").cast("string"), some), F.lit(",".join("Missing" if x is None else str(x) for x in some))).otherwise(group)
        reports.append(profiles.Profile(v, group, with_target=True))


def _many_levels(facts: _Facts, out: Recoded, direct: list, v: str, few: bool, count: int, settings: dict, output: str | None) -> None:
    roles, cfg = facts.roles, facts.cfg
    binary = cfg.nom_method.upper() == "BINARY"
    made = levels.collapse_many(facts.level_rows.where(F.col("variable") == v), count, facts.nobs, facts.mean, index=cfg.nom_method.upper() == "INDEX", **settings)
    if cfg.profiling:
        direct += [(v, *row) for row in zip(made.labels, made.rows, made.averages)]
    if not few:
        made.close()
        return
    about = {"levels": count, "path": None}
    out.tables[v] = made.table
    if output:
        about["path"] = f"{output}/nominal_levels/{v}"
        write_table(made.table, about["path"])
        made.close()
        out.tables[v] = facts.work.sparkSession.read.parquet(about["path"])
    if binary:
        out.recodes += [Recode(f"{roles.prefix}{v}_X{g}", "lookup", v, f"cast(coalesce(`__group_{v}` = {g}, false) as int)", facts=about) for g in range(1, len(made.means) + 1)]
    else:
        out.recodes.append(Recode(f"{roles.prefix}{v}", "lookup", v, f"coalesce(`__score_{v}`, 0D)", facts=about))


def _numeric(facts: _Facts, out: Recoded, reports: list) -> None:
    roles, cfg, nobs = facts.roles, facts.cfg, facts.nobs
    metas: dict[str, dict] = {}
    passed: dict[bool, list[str]] = {True: [], False: []}
    for v in facts.numeric:
        ordinal, miss = v in roles.ord_vars, facts.found["missing", v]
        meta = metas[v] = {"var_name": v, "type": facts.types[v], "overall_good": 0, "miss_cnt": miss}
        out.meta.append(meta)
        if miss > nobs * cfg.missrate or v not in facts.quantiles:
            continue
        if ordinal:
            meta |= dict(zip(("uniq_cnt", "max_cnt"), facts.sizes.get(v, (0, 0))))
            good = nobs * cfg.concrate >= meta["max_cnt"]
        else:
            meta |= dict(zip(("p_lo", "p_hi"), facts.quantiles[v]["gate"]))
            good = meta["p_lo"] != meta["p_hi"]
        if good and facts.found["varies", v]:
            passed[ordinal].append(v)
    summaries = {v: facts.summary(v) for some in passed.values() for v in some}
    rules = {v: (cfg.impmethodO, cfg.transformationO, cfg.cap_flrO) if v in roles.ord_vars else (cfg.impmethodC, cfg.transformationC, cfg.cap_flrC) for v in summaries}
    numeric.fit_all(facts.work, summaries, roles.dep_var, binary=cfg.binary_dv, min_size=cfg.min_size, rules={v: r[:2] for v, r in rules.items()})
    for v, s in summaries.items():
        ordinal, meta = v in roles.ord_vars, metas[v]
        significant = s.fit.p <= cfg.pvalue
        meta |= {"overall_good": 1, "var_lb": s.lb, "var_ub": s.ub, "var_median": s.median, "miss_impute": s.impute, "pvalue": s.fit.p, "chisq" if cfg.binary_dv else "fvalue": s.fit.stat, "new_var": f"{roles.prefix}{v}"}
        if significant:
            meta |= {"sign": s.fit.sign, "relationship": f"{s.prefix}{s.fit.sign}"}
        out.recodes += numeric.recodes(s, roles.prefix, rules[v][2], significant, cfg.keep_transforms)
        if not cfg.profiling:
            continue
        x, edges = F.col(f"`{v}`").cast("double"), facts.quantiles[v]["bins"]
        if ordinal and meta["uniq_cnt"] - (meta["miss_cnt"] > 0) <= cfg.num_category:
            reports.append(profiles.Profile(v, F.coalesce(x.cast("string"), F.lit("Missing")), x))
        else:
            bin_of = width_bin(x, *edges, cfg.num_category) if cfg.equal_dist else edges_bin(x, sorted(set(edges)))
            reports.append(profiles.Profile(v, bin_of, F.col(f"`{v}`"), bins=True))


def fit_recode(df: DataFrame, roles: Roles, config: RecodeConfig = RecodeConfig(), output: str | None = None) -> Recoded:
    """Learn the recodes of all variables from the rows that aren't Test; ``output`` also gets the program files.

    Before the fits of numeric variables the data is scanned three times, whatever
    the number and types of the variables (up to some dozens a scan; see _Facts).
    ``uniq_cnt`` of a variable that the gates refuse, or of an ordinal one, is an
    estimate where there are many levels; ``max_cnt`` then is that of the most
    frequent level the sketch of the first scan holds.
    """
    roles = roles.exclusive()
    check_variables(df, [*roles.bin_vars, *roles.nom_vars, *roles.ord_vars, *roles.cont_vars, roles.dep_var])
    # All variables are read several times, the other columns never. Report rows are computed later, in one pass over the table itself.
    work = work_file(df).select(*dict.fromkeys([roles.dep_var, *roles.bin_vars, *roles.nom_vars, *roles.ord_vars, *roles.cont_vars])).persist()
    out, reports, direct = Recoded(), [], []
    facts = None
    try:
        facts = _Facts(work, roles, config)
        nobs, mean = facts.nobs, facts.mean
        _binary(facts, out, reports)
        _nominal(facts, out, reports, direct, output)
        _numeric(facts, out, reports)
    finally:
        if facts:
            facts.close()
        work.unpersist()
    out.profile = profiles.report_all(work, reports, roles.dep_var, nobs, mean)
    if direct:
        more = profiles.report_rows(df.sparkSession, direct, nobs, mean)
        out.profile = out.profile.unionByName(more) if out.profile is not None else more
    LOG.info("recode: %d rows, %d variables looked at, %d new columns", nobs, len(out.meta), len(out.recodes))
    for m in out.meta:
        LOG.debug("recode: %s", m)
    if output:
        kinds = {"binary": ("binary",), "nominal": ("nominal", "lookup"), "numeric": ("numeric", "transform")}
        for kind, some in kinds.items():
            write_recodes(df.sparkSession, [p for p in out.programs() if p["kind"] in some], f"{output}/{kind}_recode.json")
    return out


def recode(df: DataFrame, roles: Roles, config: RecodeConfig = RecodeConfig(), output: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(recoded rows, profile report)."""
    made = fit_recode(df, roles, config, output)
    return made.apply(df, roles), made.profile
