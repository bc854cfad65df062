"""Token counters: reading them under their many names, and ratios over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TOKENS
from .leaves import Leaves

#: Names under which a counter may be reported, the first number found counts.
ALIASES = {
    "cache_read": ["cacheRead", "cache_read", "cache.read", "cachedInputTokens", "cacheReadTokens", "inputTokenDetails.cacheReadTokens", "inputTokenDetails.cacheRead"],
    "cache_write": ["cacheWrite", "cache_write", "cache.write", "cacheWriteTokens", "inputTokenDetails.cacheWriteTokens", "inputTokenDetails.cacheWrite"],
    "reasoning": ["reasoning", "reasoningTokens", "outputTokenDetails.reasoningTokens", "outputTokenDetails.reasoning"],
    "input": ["input"],
    "raw_input": ["inputTokens"],
    "output": ["output"],
    "raw_output": ["outputTokens"],
}


def clamp(x: Column) -> Column:
    """At least 0; NaN and infinities are no numbers."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(x, F.lit(0.0)))


def floored(x: Column) -> Column:
    """A finite number or null, at least 0."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def said(number: Callable[[str], Column], prefix: str = "", aliases: dict[str, list[str]] = ALIASES) -> list[Column]:
    """Columns `said_...`: each counter as the first of its names reports it. `number` reads a path."""
    return [F.coalesce(*(number(prefix + p) for p in paths)).alias(f"said_{name}") for name, paths in aliases.items()]


def counters() -> Column:
    """struct of the five counters, from columns `said_...`: reported totals less cache and reasoning where only totals are given."""
    cache_read, cache_write, reasoning = (F.coalesce(floored(F.col(f"said_{c}")), F.lit(0.0)) for c in ("cache_read", "cache_write", "reasoning"))
    given = F.coalesce("said_input", floored(F.col("said_raw_input")) - cache_read - cache_write)
    made = F.coalesce("said_output", floored(F.col("said_raw_output")) - reasoning)
    parts = {"input": given, "output": made, "reasoning": reasoning, "cache_read": cache_read, "cache_write": cache_write}
    return F.struct(*(F.coalesce(floored(parts[c]), F.lit(0.0)).alias(c) for c in TOKENS))


def partial(whole: Column) -> Column:
    """The counters `whole`, but null where nothing was reported."""
    known = {"input": F.coalesce("said_input", "said_raw_input"), "output": F.coalesce("said_output", "said_raw_output"), **{c: F.col(f"said_{c}") for c in ("reasoning", "cache_read", "cache_write")}}
    return F.struct(*(F.when(known[c].isNotNull(), whole.getField(c)).alias(c) for c in TOKENS))


def read(rows: DataFrame, column: str = "value") -> DataFrame:
    """The rows with the columns `said_...` of a column of JSON texts, or of VARIANT."""
    leaves = Leaves(column)
    columns = said(leaves.number)
    return leaves.over(rows).select(*rows.columns, *columns)


#: Names that only a reader of stored records knows, and those whose presence says that a counter was reported.
READER = {
    "fresh": ["noCacheTokens", "inputTokenDetails.noCacheTokens", "inputTokenDetails.noCacheInputTokens"],
    "text": ["outputTokenDetails.textTokens", "outputTokenDetails.text", "outputTokenDetails.outputTokens"],
    "raw_input": ["inputTokens", "promptTokens"],
    "raw_output": ["outputTokens", "completionTokens"],
    "has_input": ["cacheReadTokens", "cacheWriteTokens", "cache_read", "cache_write", "inputTokenDetails.cacheReadTokens", "inputTokenDetails.cacheWriteTokens", "inputTokenDetails.cacheRead", "inputTokenDetails.cacheWrite"],
    "has_output": ["reasoning", "outputTokenDetails.reasoningTokens", "outputTokenDetails.reasoning"],
}
HOLDERS = ["tokens", "usage", "tokenUsage"]


def reader_source(variant: str) -> Column:
    """Where a record keeps its counters: the first of `HOLDERS` that is an object, else the record itself."""
    held = F.array(*(F.try_variant_get(F.col(variant), f"$.{h}", "variant") for h in HOLDERS))
    return F.coalesce(F.get(F.filter(held, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(0)), F.col(variant))


def reader_fields(rows: DataFrame, source: str, name: str = "fields") -> DataFrame:
    """The rows with a struct of the counters that are reported at a VARIANT column, the others null."""
    leaves = Leaves(source)
    own = said(leaves.number) + [F.coalesce(*map(leaves.number, paths)).alias(f"read_{n}") for n, paths in READER.items()]
    whole = counters()
    col = F.col
    has_input = F.coalesce("said_input", "read_raw_input", "read_fresh", "read_has_input").isNotNull()
    has_output = F.coalesce("said_output", "read_raw_output", "read_text", "read_has_output").isNotNull()
    rest = floored(col("read_raw_output") - whole["reasoning"])
    output = F.when(col("read_text").isNotNull(), floored(col("read_text"))).when(col("read_raw_output").isNotNull() & (whole["reasoning"] > 0), rest).otherwise(whole["output"])
    parts = {"input": F.when(has_input, F.coalesce(floored(col("read_fresh")), whole["input"])), "output": F.when(has_output, output)}
    for c in ("reasoning", "cache_read", "cache_write"):
        parts[c] = F.when(col(f"said_{c}").isNotNull(), whole[c])
    read_ = leaves.over(rows).select(*rows.columns, *own)
    return read_.select(*rows.columns, F.struct(*(parts[c].alias(c) for c in TOKENS)).alias(name))


def total(prefix: str = "") -> Column:
    return sum((F.col(f"{prefix}{c}") for c in TOKENS[1:]), F.col(f"{prefix}{TOKENS[0]}"))


def generated(prefix: str = "") -> Column:
    return F.col(f"{prefix}output") + F.col(f"{prefix}reasoning")


def cache_hit_rate(read: Column, given: Column, write: Column) -> Column:
    """cache_read / (input + cache_read + cache_write), null if nothing went in."""
    den = given + read + write
    return F.when(den > 0, read / den)


def estimate(text: Column) -> Column:
    """Tokens of a text by its bytes, 5.5 each; 0 for none."""
    return F.coalesce(F.octet_length(text) / F.lit(5.5), F.lit(0.0))


def scaled(factor: Column, prefix: str = "") -> list[Column]:
    """The five counters times a factor, which is at least 0."""
    by = F.greatest(F.coalesce(factor, F.lit(0.0)), F.lit(0.0))
    return [(F.col(f"{prefix}{c}") * by).alias(c) for c in TOKENS]
