"""Settings of the stages, with readers of flat option dictionaries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

LABEL = "mod_val_test"
MODEL, VAL, TEST = 1, 2, 3


def as_bool(x: Any) -> bool:
    return x if isinstance(x, bool) else str(x).strip().upper() in ("Y", "YES", "TRUE", "1")


@dataclass(frozen=True)
class Roles:
    """Which columns are what. A variable has one role; a later list wins over an earlier one."""

    id: str | None = None
    dep_var: str = ""
    weight: str | None = None
    keep_list: tuple[str, ...] = ()
    prefix: str = "R1_"
    bin_vars: tuple[str, ...] = ()
    nom_vars: tuple[str, ...] = ()
    ord_vars: tuple[str, ...] = ()
    cont_vars: tuple[str, ...] = ()

    def exclusive(self) -> Roles:
        seen: set[str] = set()
        out = {}
        for kind in ("cont_vars", "ord_vars", "nom_vars", "bin_vars"):
            out[kind] = tuple(v for v in dict.fromkeys(getattr(self, kind)) if v not in seen and v != self.dep_var)
            seen |= set(out[kind])
        return Roles(**{f.name: out.get(f.name, getattr(self, f.name)) for f in fields(self)})


class _FromDict:
    #: Spellings in option dictionaries that differ from the field's name.
    ALSO: Mapping[str, str] = {}

    @classmethod
    def from_dict(cls, options: Mapping[str, Any]):
        """Known options only; Y/N strings become booleans, missing ones keep their defaults."""
        out = {}
        for f in fields(cls):
            key = next((k for k in (f.name, cls.ALSO.get(f.name)) if k in options), None)
            if key is not None:
                v = options[key]
                out[f.name] = as_bool(v) if f.type == "bool" else tuple(v) if str(f.type).startswith("tuple") else v
        return cls(**out)


def roles_from_dict(options: Mapping[str, Any]) -> Roles:
    names = {f.name for f in fields(Roles)}
    return Roles(**{k: tuple(v) if isinstance(v, (list, tuple)) else v or None if k in ("id", "weight") else v for k, v in options.items() if k in names}).exclusive()


@dataclass(frozen=True)
class SampleConfig(_FromDict):
    split_portion: float = 0.7
    exclusion_if: str | None = None
    binary_dv: bool = True
    bootstrap: bool = False
    oversampled_rr: float = 0.1
    min_num_resp: int = 2000
    seed: int = 123456


@dataclass(frozen=True)
class RecodeConfig(_FromDict):
    binary_dv: bool = True
    profiling: bool = True
    missrate: float = 0.75
    concrate: float = 0.9
    valcnt: int = 50  # 0: any number of levels
    many_levels: int = 10_000  # variables of more levels are collapsed in partitions and scored by a join
    minbinnc: int = 500
    minbinnp: float = 0.05
    talpha: float = 0.05
    bonfer: bool = False
    nom_method: str = "INDEX"
    impmethodC: str = "median"
    impmethodO: str = "mean"
    cap_flrC: bool = False
    cap_flrO: bool = False
    transformationC: bool = True
    transformationO: bool = False
    pvalue: float = 0.05
    min_size: int = 500
    num_category: int = 10
    equal_dist: bool = False
    p_lo: float = 1
    p_hi: float = 99
    keep_transforms: bool = False


@dataclass(frozen=True)
class ReduceConfig(_FromDict):
    binary_dv: bool = True
    random_seed: int = 123456
    fast_opt: bool = False
    samplesize: int | None = 50000  # None: all rows
    redu_weight: bool = False
    weight: str | None = None
    sources: int = 3
    univ_reg_flg: bool = True
    maxpuni: float = 0.0001
    correlation_flg: bool = True
    corrcut: float = 0.01
    principal_flg: bool = True
    nprin: int = 10
    minprin: float = 0.5
    cluster_flg: bool = True
    maxc: int = 20
    maxratio: float = 0.5
    regression_flg: bool = True
    alphareg: float = 0.05
    logistic_flg: bool = True
    alphalog: float = 0.05
    likelihood_ratio: bool = False
    information_flg: bool = True
    infvcut: float = 0.01
    decile: int = 20
    ind_correlation_flg: bool = True
    maxcorr: float = 0.7
    ind_dv_corr_flg: bool = True
    max_dv_corr: float = 0.7

    def normal(self) -> ReduceConfig:
        """The fast option keeps only the regression that fits the target; no logistic one for other targets."""
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        if self.fast_opt:
            out |= {k: False for k in ("univ_reg_flg", "correlation_flg", "principal_flg", "cluster_flg", "information_flg", "ind_correlation_flg", "ind_dv_corr_flg")}
            out |= {"sources": 1, "regression_flg": not self.binary_dv, "logistic_flg": self.binary_dv}
        out["logistic_flg"] = out["logistic_flg"] and self.binary_dv
        return ReduceConfig(**out)


@dataclass
class Recode:
    """A new column: Spark SQL text over the source column."""

    name: str
    kind: str
    source: str
    sql: str
    keep: bool = True
    facts: dict = field(default_factory=dict)
