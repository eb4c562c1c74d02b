"""Running aggregates per key that no single task has to hold whole.

A plain window gives every key to one task, and one key may hold a third of all
rows.  Here the order inside a key is cut into blocks: each block is scanned on
its own, one summary row per block is carried forward along the key, and the
rows take the carried value back by a join on the block.  Only summaries are
ever gathered per key.  Keys and block columns must not be NULL.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.pin import pin

_SUM, _PEAK = "_run_sum", "_run_peak"
_SUM_BEFORE, _PEAK_BEFORE = "_sum_before", "_peak_before"


def _carry(summary: DataFrame, keys: list[str], levels: list[list[str]], sign: int) -> DataFrame:
    """What each block inherits from all blocks before it in its key."""
    parent = keys + [c for level in levels[:-1] for c in level]
    before = (
        Window.partitionBy(*parent)
        .orderBy(*levels[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = (
        summary.withColumn(
            _SUM_BEFORE, F.coalesce(F.sum(_SUM).over(before), F.lit(0).cast("long"))
        )
        .withColumn("_shifted", F.col(_PEAK) + sign * F.col(_SUM_BEFORE))
        .withColumn(_PEAK_BEFORE, F.max("_shifted").over(before))
    )
    block = parent + levels[-1]
    if len(levels) == 1:
        return within.select(*block, _SUM_BEFORE, _PEAK_BEFORE)
    totals = within.groupBy(*parent).agg(F.sum(_SUM).alias(_SUM), F.max("_shifted").alias(_PEAK))
    outer = _carry(totals, keys, levels[:-1], sign).withColumnsRenamed(
        {_SUM_BEFORE: "_outer_sum", _PEAK_BEFORE: "_outer_peak"}
    )
    return within.join(outer, parent, "left").select(
        *block,
        (F.col("_outer_sum") + F.col(_SUM_BEFORE)).alias(_SUM_BEFORE),
        F.greatest("_outer_peak", F.col(_PEAK_BEFORE) + sign * F.col("_outer_sum")).alias(
            _PEAK_BEFORE
        ),
    )


def running(
    rows: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[str]],
    order: Sequence[str],
    add: Column,
    peak: Column | None = None,
    sign: int = 1,
    own_row: bool = True,
    sum_as: str = "running_sum",
    peak_as: str = "running_peak",
) -> DataFrame:
    """Add ``S = running sum(add)`` and ``running max(peak + sign * S)`` per key.

    ``levels`` name block columns from coarse to fine.  Inside a key, the order
    by (levels..., order...) must be the order by (order...), and
    (levels..., order...) must identify a row.  Rows with a NULL ``peak`` take no
    part in the maximum.  ``own_row=False`` gives both values as they were before
    the row.  ``keys`` may be empty: one global order.
    """
    keys, levels = list(keys), [list(level) for level in levels]
    block = keys + [c for level in levels for c in level]
    upto = Window.partitionBy(*block).orderBy(*order)
    through = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = add.cast("long")

    local = rows.withColumn("_add", added).withColumn(_SUM, F.sum("_add").over(through))
    if peak is None:
        totals = rows.groupBy(*block).agg(
            F.sum(added).alias(_SUM), F.lit(None).cast("long").alias(_PEAK)
        )
    else:
        local = local.withColumn("_cand", peak.cast("long") + sign * F.col(_SUM))
        totals = local.groupBy(*block).agg(
            F.sum("_add").alias(_SUM), F.max("_cand").alias(_PEAK)
        )
        scan = through if own_row else upto.rowsBetween(Window.unboundedPreceding, -1)
        local = local.withColumn(_PEAK, F.max("_cand").over(scan))

    joined = local.join(_carry(totals, keys, levels, sign), block, "left")
    total = F.col(_SUM) + F.col(_SUM_BEFORE)
    out = [(total if own_row else total - F.col("_add")).alias(sum_as)]
    if peak is not None:
        out.append(
            F.greatest(_PEAK_BEFORE, F.col(_PEAK) + sign * F.col(_SUM_BEFORE)).alias(peak_as)
        )
    return joined.select(*rows.columns, *out)


def numbered(
    rows: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[str]],
    order: Sequence[str],
    out: str,
) -> DataFrame:
    """Row number 1..n per key, cut into blocks as in :func:`running`."""
    return running(rows, keys, levels, order, F.lit(1), sum_as=out)


def range_blocks(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None
) -> tuple[DataFrame, list[list[str]]]:
    """The rows, written once in the order by (keys..., order...), with a block column.

    Blocks are ranges of that order with about as many rows each, whatever the keys
    and however many rows share a value; ``blocks`` is the session's number of shuffle
    partitions unless given.  (keys..., order...) should identify a row.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(*by) if blocks is None else rows.repartitionByRange(blocks, *by)
    return pin(dealt.withColumn("_block", F.spark_partition_id())), [["_block"]]
