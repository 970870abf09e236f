"""Registered queries: integrity checks over all fixture tables."""

from __future__ import annotations

from types import SimpleNamespace

from ..fixtures import FIXTURE_COLUMNS, fixture_tables
from ..operators import integrity
from .registry import query
from .sqlparts import oracle

_TABLES = tuple(FIXTURE_COLUMNS)
_SHAPES = {n: SimpleNamespace(columns=list(c)) for n, c in FIXTURE_COLUMNS.items()}


def _dup_sql() -> str:
    parts = []
    for name, key in integrity.key_specs(_SHAPES):
        cols = ", ".join(key)
        kv = "concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in key) + ")"
        parts.append(f"select '{name}' as table_name, '{','.join(key)}' as key_name, {kv} as key_value,"
                     f" count(*) as n from {name} group by {cols} having count(*) > 1")
    return " union all ".join(parts)


def _orphan_sql() -> str:
    parts = []
    for name, fk in integrity.fk_specs(_SHAPES):
        nn = " and ".join(f"c.{c} is not null" for c in fk.cols)
        on = " and ".join(f"p.{r} = c.{c}" for c, r in zip(fk.cols, fk.ref_cols))
        parts.append(f"select '{name}' as table_name, '{','.join(fk.cols)}' as fk, '{fk.ref_table}' as ref_table,"
                     f" count(*) as orphans from {name} c where {nn}"
                     f" and not exists (select 1 from {fk.ref_table} p where {on})")
    return " union all ".join(parts)


def _check_sql() -> str:
    from ..schemas import TABLES
    parts = []
    for name in _TABLES:
        for check, cond in TABLES[name].checks:
            parts.append(f"select '{name}' as table_name, '{check}' as check_name,"
                         f" count(*) filter (where not ({cond})) as violations from {name}")
    return " union all ".join(parts)


def _length_sql() -> str:
    parts = []
    for name, c in integrity.length_null_specs(_SHAPES):
        nulls = f"count(*) filter (where {c.name} is null)" if not c.nullable else "cast(0 as bigint)"
        long_ = f"count(*) filter (where length({c.name}) > {c.max_len})" if c.max_len else "cast(0 as bigint)"
        parts.append(f"select '{name}' as table_name, '{c.name}' as column_name, {nulls} as nulls,"
                     f" {long_} as too_long from {name}")
    return " union all ".join(parts)


@query("dup_keys", oracle(_TABLES, "", _dup_sql()))
def q_dup_keys(spark, sf_dir):
    """K1: duplicated PRIMARY KEY / UNIQUE values in every table."""
    return integrity.dup_keys(fixture_tables(spark, sf_dir, list(_TABLES)))


@query("orphans", oracle(_TABLES, "", _orphan_sql()))
def q_orphans(spark, sf_dir):
    """K2: orphan rows per foreign key."""
    return integrity.orphans(fixture_tables(spark, sf_dir, list(_TABLES)))


@query("check_violations", oracle(_TABLES, "", _check_sql()))
def q_check_violations(spark, sf_dir):
    """K3: CHECK constraint violations."""
    return integrity.check_violations(fixture_tables(spark, sf_dir, list(_TABLES)))


@query("length_null_violations", oracle(_TABLES, "", _length_sql()))
def q_length_null_violations(spark, sf_dir):
    """K4: NOT NULL and NVARCHAR(n) length violations per column."""
    return integrity.length_null_violations(fixture_tables(spark, sf_dir, list(_TABLES)))


_KEY_VIEWS = ("key_users", "key_links")


@query("dup_keys_found", oracle(_KEY_VIEWS, "",
                                "select 'users' as table_name, 'email' as key_name, email as key_value, count(*) as n from key_users"
                                " group by email having count(*) > 1 union all"
                                " select 'users', 'person_code', person_code, count(*) from key_users group by person_code having count(*) > 1"
                                " union all select 'user_companies', 'user_id,company_id', concat_ws('|', cast(user_id as varchar), cast(company_id as varchar)),"
                                " count(*) from key_links group by user_id, company_id having count(*) > 1"))
def q_dup_keys_found(spark, sf_dir):
    """K1: duplicated keys in tables that hold some."""
    t = fixture_tables(spark, sf_dir, list(_KEY_VIEWS))
    return integrity.dup_keys({"users": t["key_users"], "user_companies": t["key_links"]})
