"""Names, fingerprints and shown values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def agent_name(name: Column) -> Column:
    """Trimmed of all white space; null if empty, over 256 characters, with control characters, or the compaction agent."""
    trimmed = F.regexp_replace(name, r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$", "")
    fits = (F.length(trimmed) > 0) & (F.length(trimmed) <= 256) & ~trimmed.rlike(r"\p{Cc}") & (trimmed != "compaction")
    return F.when(fits, trimmed)


def agent_set(name: Column) -> Column:
    """Aggregate: the different names in order."""
    return F.array_sort(F.collect_set(name))


def fingerprint(*columns: str) -> Column:
    """A key over the canonical form of the columns, nulls told apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*(F.struct(F.col(c).isNull().alias("n"), F.col(c).cast("string").alias("v")).alias(c) for c in sorted(columns)))), 256)


def _nearest(x: Column) -> Column:
    """Rounded, halves up."""
    return F.floor(x + F.lit(0.5)).cast("long")


def shown_number(x: Column, most: int = 2) -> Column:
    """Thousands parted by commas, with so many decimals at most; 0 for what is no number."""
    safe = F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")), x).otherwise(F.lit(0))
    fixed = F.format_number(F.round(safe.cast("decimal(38,10)"), most), most)
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "") if most > 0 else fixed


def shown_tokens(x: Column) -> Column:
    return F.format_number(_nearest(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))), 0)


def shown_compact(x: Column) -> Column:
    """1234 as 1.2k, 123456 as 123k, 1234567 as 1.2M."""
    size = F.abs(x)
    tenth = lambda d: F.concat((_nearest(size / (d / 10)) / 10).cast("long").cast("string"), F.lit("."), (_nearest(size / (d / 10)) % 10).cast("string"))
    shown = (
        F.when(size < 1000, _nearest(size).cast("string"))
        .when(size < 100_000, F.concat(F.regexp_replace(tenth(1000), r"\.0$", ""), F.lit("k")))
        .when(size < 1_000_000, F.concat(_nearest(size / 1000).cast("string"), F.lit("k")))
        .when(size < 1_000_000_000, F.concat(tenth(1_000_000), F.lit("M")))
        .otherwise(F.concat(tenth(1_000_000_000), F.lit("B")))
    )
    return F.concat(F.when(x < 0, "-").otherwise(""), shown)


def shown_percent(x: Column) -> Column:
    known = x.isNotNull() & ~F.isnan(x.cast("double"))
    return F.when(known, F.concat(_nearest(F.greatest(F.lit(0), F.least(F.lit(1), x)) * 100).cast("string"), F.lit("%"))).otherwise(F.lit("--"))


def shown_cost(x: Column) -> Column:
    return F.concat(F.lit("$"), shown_number(x, 4))


def shown_duration(ms: Column) -> Column:
    """950ms, 12.5s, 3m 05s, 1h 02m 05s."""
    value = F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0))
    s = F.floor(value / 1000)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(value < 1000, F.concat(_nearest(value).cast("string"), F.lit("ms")))
        .when(value < 60_000, F.concat(F.regexp_replace(F.round((value / 1000).cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string"), r"\.0$", ""), F.lit("s")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
    )


def shown_clock(ms: Column) -> Column:
    """HH:MM:SS in UTC; dashes for no time."""
    s = F.floor(ms / 1000) % 86400
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(ms > 0, F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))).otherwise(F.lit("--:--:--"))


def short_tail(text: Column, size: int = 12) -> Column:
    """The end of a text, with dots before it if something is left out."""
    some = F.coalesce(text, F.lit(""))
    return F.when(some == "", "-").when(F.length(some) <= size, some).otherwise(F.concat(F.lit("..."), F.right(some, F.lit(size - 3))))


def shortened(text: Column, size: int) -> Column:
    """The middle left out if the text is longer than `size`."""
    some = F.coalesce(text, F.lit(""))
    left = max(0, (size - 3 + 1) // 2)
    right = max(0, size - 3 - left)
    cut = F.substring(some, 1, size) if size <= 3 else F.concat(F.substring(some, 1, left), F.lit("..."), F.right(some, F.lit(right)) if right else F.lit(""))
    return F.when(some == "", "-").when(F.length(some) <= size, some).otherwise(cut)


def history_row() -> Column:
    """A record as one line of fixed columns: time, session, model, tokens and cost."""
    right = lambda c, n: F.rpad(c, n, " ")
    left = lambda c, n: F.when(F.length(c) >= n, F.right(c, F.lit(n))).otherwise(F.lpad(c, n, " "))
    amount = F.concat_ws("/", shown_number(F.col("output"), 9), shown_number(F.col("reasoning"), 9))
    return F.concat_ws(" ", right(shown_clock(F.coalesce("completed", "start")), 8), right(short_tail(F.col("session_id"), 11), 11), right(shortened(F.col("model"), 14), 14), left(amount, 9), left(shown_cost(F.col("cost")), 9))
