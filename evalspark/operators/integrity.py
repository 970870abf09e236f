"""Integrity checks as validators returning violations.

Driven by the constraint metadata in :mod:`evalspark.schemas`; each check is
one aggregate or anti-join per table, and only tables / columns present in
the given DataFrames are checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def key_specs(tables: dict[str, DataFrame]) -> list[tuple[str, tuple[str, ...]]]:
    """(table, key columns) for every PRIMARY KEY / UNIQUE whose columns are present."""
    out = []
    for name, t in TABLES.items():
        if name not in tables:
            continue
        for key in (t.pk,) + t.uniques:
            if all(c in tables[name].columns for c in key):
                out.append((name, key))
    return out


def dup_keys(tables: dict[str, DataFrame], case_insensitive: bool = False) -> DataFrame:
    """K1: key values held by more than one row (NULLs count as equal, as in a UNIQUE index)."""
    parts = []
    for name, key in key_specs(tables):
        df = tables[name]
        cols = [F.lower(F.col(c)) if case_insensitive and dict(df.dtypes)[c] == "string" else F.col(c)
                for c in key]
        g = df.groupBy(*[c.alias(k) for c, k in zip(cols, key)]).agg(F.count(F.lit(1)).alias("n"))
        parts.append(g.where(F.col("n") > 1).select(
            F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_name"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key_value"), "n"))
    return _union(parts)


def fk_specs(tables: dict[str, DataFrame]):
    out = []
    for name, t in TABLES.items():
        if name not in tables:
            continue
        for fk in t.fks:
            if fk.ref_table in tables and all(c in tables[name].columns for c in fk.cols):
                out.append((name, fk))
    return out


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """K2: per foreign key, the number of child rows whose parent does not exist."""
    parts = []
    for name, fk in fk_specs(tables):
        child = tables[name].select(*fk.cols)
        for c in fk.cols:
            child = child.where(F.col(c).isNotNull())
        parent = tables[fk.ref_table].select(*[F.col(r).alias(c) for r, c in zip(fk.ref_cols, fk.cols)])
        lost = child.join(parent, list(fk.cols), "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(fk.cols)).alias("fk"),
            F.lit(fk.ref_table).alias("ref_table"), "orphans"))
    return _union(parts)


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """K3: per CHECK constraint, rows where the condition is false (unknown passes)."""
    parts = []
    for name, t in TABLES.items():
        if name not in tables:
            continue
        for check, cond in t.checks:
            parts.append(tables[name].agg(F.count_if(~F.expr(cond)).alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit(check).alias("check_name"), "violations"))
    return _union(parts)


def length_null_specs(tables: dict[str, DataFrame]):
    out = []
    for name, t in TABLES.items():
        if name not in tables:
            continue
        for c in t.cols:
            if c.name in tables[name].columns and (not c.nullable or c.max_len):
                out.append((name, c))
    return out


def length_null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """K4: per constrained column, NULLs in a NOT NULL column and text over NVARCHAR(n)."""
    parts = []
    by_table: dict[str, list] = {}
    for name, c in length_null_specs(tables):
        by_table.setdefault(name, []).append(c)
    for name, cols in by_table.items():
        aggs = []
        for c in cols:
            nulls = F.count_if(F.col(c.name).isNull()) if not c.nullable else F.lit(0).cast("long")
            long_ = F.count_if(F.length(c.name) > c.max_len) if c.max_len else F.lit(0).cast("long")
            aggs += [nulls.alias(f"{c.name}__n"), long_.alias(f"{c.name}__l")]
        wide = tables[name].agg(*aggs)  # one pass over the table for all its columns
        stack = ", ".join(f"'{c.name}', `{c.name}__n`, `{c.name}__l`" for c in cols)
        parts.append(wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, nulls, too_long)")
                     .select(F.lit(name).alias("table_name"), "column_name", "nulls", "too_long"))
    return _union(parts)
