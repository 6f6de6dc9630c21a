"""Data-quality checks that return findings, and guards that fail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, required: Sequence[str], rejected: Sequence[str] = ()) -> DataFrame:
    """Q01, Q11: every required column is there and no rejected one."""
    missing, old = [c for c in required if c not in df.columns], [c for c in rejected if c in df.columns]
    if missing or old:
        raise ContractError(f"missing columns {missing}, deprecated columns {old}")
    return df


def require_rows(df: DataFrame, exact: int | None = None, least: int | None = None) -> DataFrame:
    """Q02."""
    n = df.count()
    if (exact is not None and n != exact) or (least is not None and n < least):
        raise ContractError(f"{n} rows, expected {exact if exact is not None else f'at least {least}'}")
    return df


def violations(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Q03-Q07: (rule, severity, n) for each rule, n counting rows for which the test is true, in one pass."""
    one = df.agg(*[F.count_if(test).alias(name) for name, (_, test) in rules.items()])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.col(n).alias("n")) for n, (sev, _) in rules.items()])
    return one.select(F.explode(each).alias("f")).select("f.rule", "f.severity", "f.n")


def observed(rules: dict[str, tuple[str, Column]], least: int = 0):
    """Q01-Q07 on the write itself: (names of the metrics and their columns, check of the metrics that were observed).

    The columns go to ``DataFrame.observe``, so that rows are counted and tested as they are written; the check raises where a
    CRITICAL rule has a row or fewer than ``least`` rows were written, and returns (rule, severity, n) of the others."""
    columns = {"_rows": F.count(F.lit(1)), **{name: F.count_if(test) for name, (_, test) in rules.items()}}

    def check(found: dict[str, int]) -> list[tuple[str, str, int]]:
        broken = [name for name, (severity, _) in rules.items() if severity == "CRITICAL" and found[name]]
        if broken or found["_rows"] < least:
            raise ContractError(f"{found['_rows']} rows, expected at least {least}; critical findings {broken}")
        return [(name, severity, found[name]) for name, (severity, _) in rules.items()]

    return columns, check


def require_floor(counts: DataFrame, key: str, n: str, least: int, invariants: DataFrame | None = None) -> DataFrame:
    """The counts, if every key has at least ``least`` and no row of ``invariants`` is there; else raises and names them."""
    low = [(r[key], r[n]) for r in counts.where(F.coalesce(F.col(n), F.lit(0)) < least).select(key, n).limit(20).collect()]
    bad = invariants.limit(1).count() if invariants is not None else 0
    if low or bad:
        raise ContractError(f"fewer than {least}: {low}" + ("; an invariant is broken" if bad else ""))
    return counts


def report(findings: DataFrame, fail_on: str | None = None) -> DataFrame:
    """Q08: findings with rows, by severity; raises if one has the severity to fail on."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])
    found = findings.where("n > 0").withColumn("severity_rank", rank)
    if fail_on and not found.where(F.col("severity") == fail_on).isEmpty():
        raise ContractError(f"{fail_on} findings")
    return found


def fail_on_unknown(df: DataFrame, col: str, known: DataFrame, key: str, most: int = 0) -> DataFrame:
    """Q09: raises if more than ``most`` rows have a code outside the table."""
    n = df.join(known.select(F.col(key).alias(col)), col, "left_anti").count()
    if n > most:
        raise ContractError(f"{n} rows with unknown {col}")
    return df


def label_gaps(df: DataFrame, col: str, dimension: DataFrame, key: str) -> DataFrame:
    """Q10: labels in the data that the dimension lacks."""
    return df.select(F.col(col).alias(key)).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Q12: number of rows that two runs do not share, columns in ``ignore`` left out."""
    cols = [c for c in a.columns if c not in ignore]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("different"))
