"""Counts, unique observations and largest gaps in time bands around every instant.

All bands are differences of running totals over one ordered window per
(subject, chunk): a frame from the partition start to ``anchor + offset`` is
extended row by row, so the work does not grow with the number of rows a band
holds. Neighbouring bands that share an edge share its running total.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjectseries.functions.scalars import bucket_index
from subjectseries.operators.chunks import with_halo

PARTITION = ("subject_id", "chunk")


def _name(prefix: str, offset: int) -> str:
    return f"_{prefix}_{'m' if offset < 0 else 'p'}{abs(offset)}"


class BandPlan:
    """Collects the band edges a rule set needs, then adds them in one pass.

    Usage: ask for columns (``count``, ``last``, ...), then ``apply`` to the
    chunked observations; the asked-for columns are valid on the result.
    """

    def __init__(self) -> None:
        self._counts: set[int] = set()
        self._copies: set[int] = set()
        self._lasts: set[int] = set()
        self._pairs: set[int] = set()

    def count(self, low: int, high: int) -> Column:
        """Observations with ``low <= t - anchor <= high`` (µs), copies included."""
        if high < low:
            return F.lit(0).cast("bigint")
        self._counts |= {high, low - 1}
        return F.col(_name("c", high)) - F.col(_name("c", low - 1))

    def repeated(self, low: int, high: int) -> Column:
        """Instants in the band that occur more than once."""
        self._copies |= {high, low - 1}
        return F.col(_name("d", high)) - F.col(_name("d", low - 1))

    def last(self, high: int) -> Column:
        """Latest observation up to ``anchor + high``: struct of us, value, source.

        Where a band ending at ``high`` holds exactly one observation, this is it.
        """
        self._lasts.add(high)
        return F.col(_name("l", high))

    def neighbours(self, offset: int) -> Column:
        """The latest instant up to ``anchor + offset`` and the one after it."""
        self._pairs.add(offset)
        return F.col(_name("p", offset))

    def apply(self, df: DataFrame) -> DataFrame:
        order = Window.partitionBy(*PARTITION).orderBy("us")

        def upto(offset: int):
            return order.rangeBetween(Window.unboundedPreceding, offset)

        zero = F.lit(0).cast("bigint")
        added: dict[str, Column] = {}
        for offset in sorted(self._counts):
            added[_name("c", offset)] = F.coalesce(F.sum("n").over(upto(offset)), zero)
        for offset in sorted(self._copies):
            copies = F.sum((F.col("n") > 1).cast("bigint"))
            added[_name("d", offset)] = F.coalesce(copies.over(upto(offset)), zero)
        entry = F.struct("us", "value", "source")
        for offset in sorted(self._lasts):
            added[_name("l", offset)] = F.last(entry).over(upto(offset))
        if self._pairs:
            df = df.withColumn("next_us", F.lead("us").over(order))
        for offset in sorted(self._pairs):
            added[_name("p", offset)] = F.last(F.struct("us", "next_us")).over(upto(offset))
        return df.withColumns(added)


def chunked(obs: DataFrame, width_us: int, before_us: int, after_us: int) -> DataFrame:
    return with_halo(obs, width_us, before_us, after_us)


def with_block_maxima(df: DataFrame, span_us: int) -> DataFrame:
    """Prepare ``largest_gap``: gap to the next instant and block-wise running maxima.

    Time is cut into blocks of ``span_us``. ``_ahead`` is the largest gap from a row
    to the end of its block, ``_behind`` the largest gap from the start of its block
    up to, not including, the row's own. A window of length ``span_us`` meets two
    neighbouring blocks, so the two maxima together cover it.
    """
    descending = Window.partitionBy(*PARTITION).orderBy(F.col("us").desc())
    running = descending.rowsBetween(Window.unboundedPreceding, 0)
    ascending = Window.partitionBy(*PARTITION).orderBy("us")
    return (
        df.withColumn("_block", bucket_index("us", span_us))
        .withColumn("_gap", F.lag("us").over(descending) - F.col("us"))
        .withColumn("_ahead", F.max(F.struct(-F.col("_block"), "_gap")).over(running)["_gap"])
        .withColumns(
            {
                "_behind_s": F.max(F.struct("_block", "_gap")).over(
                    ascending.rowsBetween(Window.unboundedPreceding, -1)
                ),
                "_next_start": F.lead(F.struct("us", "_block", "_ahead")).over(ascending),
            }
        )
    )


def largest_gap(df: DataFrame, span_us: int) -> DataFrame:
    """Add ``max_gap_us``: the largest gap between neighbours inside ``[anchor - span, anchor]``.

    Null when the window holds a single instant.
    """
    order = Window.partitionBy(*PARTITION).orderBy("us")
    before_window = order.rangeBetween(Window.unboundedPreceding, -span_us - 1)
    own = F.struct("us", "_block", "_ahead")
    so_far = order.rangeBetween(Window.unboundedPreceding, 0)
    first_inside = F.coalesce(
        F.last("_next_start").over(before_window), F.first(own).over(so_far)
    )
    behind = F.when(F.col("_behind_s._block") == F.col("_block"), F.col("_behind_s._gap"))
    ahead = F.when(F.col("_f._block") < F.col("_block"), F.col("_f._ahead"))
    return (
        df.withColumn("_f", first_inside)
        .withColumn("max_gap_us", F.when(F.col("_f.us") < F.col("us"), F.greatest(ahead, behind)))
        .drop("_block", "_gap", "_ahead", "_behind_s", "_next_start", "_f")
    )


def unique_in_band(count: Column, last: Column) -> Column:
    """The single observation of a band, or null."""
    return F.when(count == 1, last)


def first_code(pairs: Iterable[tuple[Column, str]]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    codes = [F.when(condition, F.lit(code)) for condition, code in pairs]
    return F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")
