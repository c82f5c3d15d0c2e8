"""Row numbers and running totals within groups of any size.

A plain window puts a whole group into one task, and a single file name or run may
hold a third of all rows. Here the table is range-partitioned by group *and* order,
so a large group spreads over many slices; each slice counts on its own and adds
what the slices before it hold.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def running(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    ordinal: str | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add a 1-based ``ordinal`` and running sums (``totals``: new column → summed column).

    ``order`` must tell the rows of a group apart; rows that agree in it stay in one slice.
    Sums of decimals and integers are exact whatever the slicing.
    """
    totals = totals or {}
    kept = df.columns
    sliced = settle(
        df.repartitionByRange(*[F.col(c) for c in [*groups, *order]]).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "running",
    )
    group = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))
    sums = {"_n": F.count(F.lit(1)), **{f"_s_{k}": F.sum(c) for k, c in totals.items()}}

    # Only the last group of a slice can go on in the next one, and only the first can have begun
    # before: two rows per slice, however many groups there are.
    edges = sliced.groupBy("_slice").agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    held = (
        sliced.withColumn("_group", group)
        .join(F.broadcast(edges), "_slice")
        .where(F.col("_group").eqNullSafe(F.col("_hi")))
        .groupBy("_slice", "_group")
        .agg(*[agg.alias(name) for name, agg in sums.items()])
    )
    opened = edges.select(
        "_slice",
        F.col("_lo").alias("_group"),
        *[F.lit(None).cast(held.schema[name].dataType).alias(name) for name in sums],
    )
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        held.unionByName(opened)
        .groupBy("_slice", "_group")
        .agg(*[F.max(name).alias(name) for name in sums])
        .select(
            F.col("_slice").alias("_o_slice"),
            F.col("_group").alias("_o_group"),
            *[F.sum(name).over(before).alias(f"_before{name}") for name in sums],
        )
    )
    within = Window.partitionBy("_slice", *groups).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.select(
        *kept,
        "_slice",
        group.alias("_group"),
        F.row_number().over(within).cast("bigint").alias("_n"),
        *[F.sum(c).over(so_far).alias(f"_s_{k}") for k, c in totals.items()],
    )
    # at most two offsets per slice: small whatever the data
    out = local.join(
        F.broadcast(offsets),
        (F.col("_slice") == F.col("_o_slice")) & F.col("_group").eqNullSafe(F.col("_o_group")),
        "left",
    )

    def whole(name: str):
        return F.coalesce(F.col(f"_before{name}"), F.lit(0)) + F.col(name)

    added = [whole("_n").alias(ordinal)] if ordinal else []
    added += [whole(f"_s_{k}").alias(k) for k in totals]
    return out.select(*kept, *added)
