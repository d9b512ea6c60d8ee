"""Column expressions on long arrays and texts whose cost stays near linear: blocks of about the square root of the length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although the body uses it often or within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(n: Column) -> Column:
    return F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element the fold of all elements before it, ``zero`` for the first; null for null.

    ``combine`` must be associative. Elements are folded within blocks, and blocks with each other, so that the
    cost is the 1.5th power of the length, not the square.
    """

    def blocks(s: Column) -> Column:
        fold = lambda part: F.aggregate(part, zero, combine)
        part = lambda b: F.slice(s["v"], b * s["size"] + 1, s["size"])
        numbers = F.sequence(F.lit(0), F.floor((F.size(s["v"]) - 1) / s["size"]).cast("int"))
        within = lambda values, start: F.transform(values, lambda _, i: combine(start, fold(F.slice(values, F.lit(1), i))))

        def placed(folds: Column) -> Column:
            start = lambda b: fold(F.slice(folds, F.lit(1), b))
            return F.flatten(F.transform(numbers, lambda b: let(F.struct(part(b).alias("v"), start(b).alias("at")), lambda p: within(p["v"], p["at"]))))

        return let(F.transform(numbers, lambda b: fold(part(b))), placed)

    whole = let(F.struct(values.alias("v"), _block(F.size(values)).alias("size")), blocks)
    return F.when(F.size(values) > 0, whole).otherwise(F.when(values.isNotNull(), F.array().cast("array<long>")))


def running_totals(lengths: Column) -> Column:
    """For each number the sum of all before it."""
    return running(lengths, F.lit(0).cast("long"), lambda a, b: (a + b).cast("long"))


def cut(text: Column, spans: Column) -> Column:
    """The parts of a text at spans (start, end) in code points, end exclusive, that are in order and don't overlap.

    A text is walked through once for each block of spans, not for each span.
    """

    def blocks(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(s["v"]) - 1) / s["size"]).cast("int"))

        def parts(part: Column) -> Column:
            low = F.get(part, F.lit(0))["start"].cast("int")
            high = F.element_at(part, -1)["end"].cast("int")
            local = F.struct(F.substring(text, low + 1, high - low).alias("text"), low.alias("low"))
            piece = lambda q, x: F.substring(q["text"], x["start"].cast("int") - q["low"] + 1, (x["end"] - x["start"]).cast("int"))
            return let(local, lambda q: F.transform(part, lambda x: piece(q, x)))

        return F.flatten(F.transform(numbers, lambda b: let(F.slice(s["v"], b * s["size"] + 1, s["size"]), parts)))

    whole = let(F.struct(spans.alias("v"), _block(F.size(spans)).alias("size")), blocks)
    return F.when(F.size(spans) > 0, whole).otherwise(F.when(spans.isNotNull(), F.array().cast("array<string>")))
