"""Small scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of(t: Column, utc_offset_s: float = 0.0) -> Column:
    """Hour of day of an epoch-seconds number at a fixed offset from UTC."""
    return F.pmod(F.floor((t + F.lit(utc_offset_s)) / 3600.0), F.lit(24)).cast("int")


def epoch_seconds(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Datetime text to epoch seconds in the session zone."""
    return F.unix_timestamp(text, fmt)


def ms_to_s(ms: Column) -> Column:
    return ms / 1000.0


def noise_probability(text: Column) -> Column:
    """``"50%noise"`` gives 0.5; any other text gives 1."""
    share = F.regexp_extract(text, r"^(.*)%noise$", 1)
    return F.when(text.endswith("%noise"), share.cast("double") / 100.0).otherwise(F.lit(1.0))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda e: e / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cross_entropy(scores: Column, target: Column) -> Column:
    """Log-sum-exp of the scores minus the score of ``target``."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.log(total) + top - F.get(scores, target)


def hours_minutes_seconds(seconds: Column) -> list[Column]:
    """Hours, minutes and seconds of a duration in seconds."""
    return [
        F.floor(seconds / 3600).alias("hours"),
        F.pmod(F.floor(seconds / 60), F.lit(60)).alias("minutes"),
        F.pmod(seconds, F.lit(60.0)).alias("seconds"),
    ]


def rounded(col: Column, digits: int = 4) -> Column:
    """Report rounding; nulls stay null and a negative zero becomes zero."""
    return F.round(col, digits) + F.lit(0.0)


def hash32(*parts: Column | int) -> Column:
    """A 32-bit number from the MD5 of whole-number parts.

    Every sampled choice ranks or thresholds this value, so a choice depends on
    the row's key and the seed only, never on partitioning, and any engine can
    repeat it.
    """
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform01(*parts: Column | int) -> Column:
    """A draw in [0, 1) that depends only on ``parts``."""
    return hash32(*parts) / F.lit(float(2**32))


def typed_parameters(text: Column) -> Column:
    """``key=value;...`` text to an array of (key, value, kind), one per parameter.

    Kinds are bool, int, float and string, tried in that order.
    """
    pieces = F.filter(F.split(text, ";"), lambda p: p.contains("="))

    def parse(piece: Column) -> Column:
        at = F.instr(piece, F.lit("="))
        key = F.trim(F.substr(piece, F.lit(1), at - 1))
        value = F.trim(F.substr(piece, at + 1))
        kind = (
            F.when(F.lower(value).isin("true", "false"), "bool")
            .when(value.rlike(r"^[0-9]+$"), "int")
            .when(value.try_cast("double").isNotNull(), "float")
            .otherwise("string")
        )
        return F.struct(key.alias("key"), value.alias("value"), kind.alias("kind"))

    return F.transform(pieces, parse)
