"""UNIQUE columns under requests that are applied in order.

A request asks for new values of unique columns (an email, a person code) for
its owner.  It is refused when another owner holds one of them at that moment,
and a refused request changes nothing; an accepted one gives up the values that its owner held
before, so that others may take them later.

Most requests can be decided at once: when no other owner ever held or asked
for any of its values, a request can't be refused.  Owners that share a value are tied
together (:func:`contended`), and only their requests are replayed in order, each
group of owners that are tied, directly or through others, by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import at_rest
from .common import components

#: Up to so many rows are replayed in one task without looking for groups first; the result is the same.
ONE_TASK_ROWS = 200_000


def _claims(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, value, owner) of every value that ``rows`` (owner, keys) hold or ask for."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys])
    return rows.select("owner", F.explode(each).alias("c")).where("c.value IS NOT NULL").select("c.kind", "c.value", "owner")


def contended(claims: DataFrame) -> DataFrame:
    """(owner, with_owner): every owner that shares a value, and the least owner that has to do with it."""
    shared = claims.groupBy("kind", "value").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most")
    return claims.join(shared.select("kind", "value", "least"), ["kind", "value"]).select("owner", F.col("least").alias("with_owner")).distinct()


def _replay(keys: list[str]):
    """One partition sorted by (group, seq): what owners hold (seq NULL) comes first, then requests in order.

    Memory holds the values in use of the group at hand, not its requests.
    """
    def run(batches):
        import pandas as pd

        group, held_by, holds = None, {}, {}
        for pdf in batches:
            refused = []
            for row in pdf.itertuples(index=False):
                if row.grp != group:
                    group, held_by, holds = row.grp, {}, {}
                asked = [(k, getattr(row, k)) for k in keys if pd.notna(getattr(row, k))]
                if any(held_by.get(a, row.owner) != row.owner for a in asked):
                    refused.append(row.seq)
                    continue
                own = holds.setdefault(row.owner, {})
                for k, v in asked:
                    if k in own and held_by.get((k, own[k])) == row.owner:
                        del held_by[k, own[k]]
                    own[k] = v
                    held_by[k, v] = row.owner
            yield pd.DataFrame({"seq": pd.Series(refused, dtype="int64")})
    return run


def refused_requests(requests: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """(seq) of the requests that are refused.

    ``requests``: seq, owner and ``keys`` (NULL: not asked for); ``held``: owner and
    ``keys`` as stored (at most one owner per value).  Equal values of one owner never refuse.
    """
    req = at_rest(requests.select("seq", "owner", *keys), "asked")
    owners = req.select("owner").distinct()
    # only what requesting owners hold, and who holds what is asked for, has a part in this
    named = held.select("owner", *keys)
    mine = named.join(owners, "owner", "left_semi")
    for k in keys:
        mine = mine.unionByName(named.join(req.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").select("owner", *keys))
    mine = at_rest(mine.distinct(), "held")
    tied = at_rest(contended(_claims(req, keys).unionByName(_claims(mine, keys)).distinct()), "tied")
    few = tied.select("owner").distinct()
    rows = mine.withColumn("seq", F.lit(None).cast("long")).unionByName(req, allowMissingColumns=True).select("seq", "owner", *keys)
    rows = at_rest(rows.join(few, "owner", "left_semi"), "contended")
    if rows.count() <= ONE_TASK_ROWS:
        placed = rows.withColumn("grp", F.lit(0).cast("long")).coalesce(1)
    else:
        groups = components(tied.select(F.col("owner").alias("a"), F.col("with_owner").alias("b")))
        placed = rows.join(groups.select(F.col("node").alias("owner"), F.col("component").alias("grp")), "owner")
        placed = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp")
    ordered = placed.sortWithinPartitions("grp", F.col("seq").asc_nulls_first())
    # absent ids travel as -1, so that pandas keeps them exact
    ordered = ordered.select("grp", F.coalesce("seq", F.lit(-1)).alias("seq"), "owner", *keys)
    return at_rest(ordered.mapInPandas(_replay(keys), "seq long"), "refused")
