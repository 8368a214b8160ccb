"""Expressions over small sorted arrays: quantiles, outlier bounds, overlaps and the range intersection.

Elements carry a multiplicity ``n``, so equal values are held once; ranks and quantiles run over sums of
multiplicities, whatever their size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: up to so many ranges all pairs are compared, which then is faster
FEW_RANGES = 64


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])


def by_value(items: Column, value: str) -> Column:
    """The items as (value, n), sorted by the value."""
    return F.sort_array(F.transform(items, lambda x: F.struct(x[value].alias("value"), x["n"].alias("n"))))


def at_rank(ordered: Column, rank: Column, kind: str) -> Column:
    """The value of this rank, from 0, of sorted (value, n); null beyond the last."""
    begin = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(kind).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["found"], F.when(rank < seen, x["value"].cast(kind))).alias("found"))

    return F.aggregate(ordered, begin, step)["found"]


def quantile(ordered: Column, share: float) -> Column:
    """Linearly interpolated quantile of sorted (value, n); null for none."""
    at = (total(ordered) - 1) * F.lit(share)
    low, high = (at_rank(ordered, rank, "double") for rank in (F.floor(at), F.ceil(at)))
    return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))


def _touching_by_pairs(ranges: Column, r: Column) -> Column:
    return F.aggregate(
        ranges,
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.when(
            m["start"].between(r["start"], r["end"]) | m["end"].between(r["start"], r["end"]), m["n"]
        ).otherwise(F.lit(0)),
    )


def _classes(ranges: Column) -> Column:
    """Ranges of equal length: (days, starts in order, sums of n up to each). A month range of the code list
    gives its ranges one length, so there are few."""
    lengths = F.array_distinct(F.transform(ranges, lambda r: F.date_diff(r["end"], r["start"])))

    def one(days: Column) -> Column:
        own = F.filter(ranges, lambda r: F.date_diff(r["end"], r["start"]) == days)
        sums = F.aggregate(own, F.array(F.lit(0).cast("bigint")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["n"])))
        return F.struct(days.alias("days"), F.transform(own, lambda r: F.unix_date(r["start"])).alias("starts"), sums.alias("sums"))

    return F.transform(lengths, one)


def _up_to(group: Column, day: Column) -> Column:
    """How many ranges of a class start up to the day, by binary search."""
    n = F.size(group["starts"])
    begin = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        is_open, earlier = acc["low"] < acc["high"], F.get(group["starts"], middle) <= day
        return F.struct(
            F.when(is_open & earlier, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(is_open & ~earlier, middle).otherwise(acc["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.get(group["sums"], F.aggregate(steps, begin, halve)["low"])


def _touching_by_class(classes: Column, r: Column) -> Column:
    """Of a class with ranges of d days, those count that start in the range or d days before one of its days."""
    first, last = F.unix_date(r["start"]), F.unix_date(r["end"])

    def of_class(acc: Column, group: Column) -> Column:
        days = group["days"]
        early = _up_to(group, last) - _up_to(group, first - days - 1)
        between = F.when(days > last - first + 1, _up_to(group, first - 1) - _up_to(group, last - days)).otherwise(F.lit(0).cast("bigint"))
        return acc + early - between

    return F.aggregate(classes, F.lit(0).cast("bigint"), of_class)


def overlap_counts(ranges: Column) -> Column:
    """For each of the sorted ranges (start, end, n) how many others have an end point inside it, bounds
    included. Few ranges are compared in pairs; beyond that, counts come from the sorted starts of each
    length by binary search, so the work is in proportion to the ranges times lengths."""
    def counted(touching: Callable[[Column], Column]) -> Column:
        # led by the negative count, so that a plain sort puts the most overlapped range first
        return F.transform(ranges, lambda r: _bound(touching(r) - 1, lambda k: F.struct(
            (-k).alias("fewer"), r["start"].alias("start"), r["end"].alias("end"), r["n"].alias("n"), k.alias("overlaps")
        )))

    many = _bound(_classes(ranges), lambda classes: counted(lambda r: _touching_by_class(classes, r)))
    return F.when(F.size(ranges) <= FEW_RANGES, counted(lambda r: _touching_by_pairs(ranges, r))).otherwise(many)


def intersect(ordered: Column) -> Column:
    """Fold ranges in the given order into their span and a narrowing core.

    The core end moves first, and the core start is tested against the moved end.
    """
    first = F.get(ordered, F.lit(0))
    begin = F.struct(
        first["start"].alias("span_start"), first["end"].alias("span_end"),
        first["start"].alias("core_start"), first["end"].alias("core_end"),
    )

    def step(acc: Column, x: Column) -> Column:
        core_end = F.when(
            (x["end"] < acc["core_end"]) & (x["end"] > acc["core_start"]), x["end"]
        ).otherwise(acc["core_end"])
        core_start = F.when(
            (x["start"] > acc["core_start"]) & (x["start"] < core_end), x["start"]
        ).otherwise(acc["core_start"])
        return F.struct(
            F.least(acc["span_start"], x["start"]).alias("span_start"),
            F.greatest(acc["span_end"], x["end"]).alias("span_end"),
            core_start.alias("core_start"), core_end.alias("core_end"),
        )

    return F.when(F.size(ordered) > 0, F.aggregate(ordered, begin, step))
