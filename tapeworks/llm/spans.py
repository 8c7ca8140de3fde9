"""Spans of regular expressions by DataFrame expressions: code-point positions of all leftmost matches, and their digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, CONTEXT = 256, 40
SPANS = "array<struct<start:bigint,end:bigint,match:string,before:string>>"


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)


def _block_sums(x: str) -> Column:
    """Sums of the blocks of an array that isn't empty."""
    return F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK).cast("int")), lambda i: _total(F.slice(x, i * BLOCK + 1, BLOCK)))


def _running_sums(x: str, blocks: str) -> Column:
    """The sums of the first 1, 2, ... elements of ``x``: by ``blocks``, so that long arrays take no square time."""
    return F.transform(x, lambda y, k: _total(F.slice(blocks, 1, (k / BLOCK).cast("int"))) + _total(F.slice(x, (k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK + 1)))


def with_matches(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``docs`` with a column of spans (start, end, match, before) for each pattern (Java's, without groups that capture).

    A pattern is first run alone. Only where it matches is it run again with the text between matches, whose lengths
    give the positions and whose last characters are the context ``before``. Columns are added step by step, so that
    no pattern runs more often than that.
    """
    for name, pattern in patterns.items():
        found, gaps, lengths, blocks, ends = (f"_{name}_{x}" for x in ("found", "gaps", "lengths", "blocks", "ends"))
        docs = docs.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1)))
        docs = docs.withColumn(gaps, F.when(F.size(found) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s)\\G(.*?)(?:{pattern})"), F.lit(1))))
        docs = docs.withColumn(lengths, F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("long")))
        docs = docs.withColumn(blocks, F.when(F.size(found) > 0, _block_sums(lengths)))
        docs = docs.withColumn(ends, F.when(F.size(found) > 0, _running_sums(lengths, blocks)))
        spans = F.transform(
            F.arrays_zip(F.col(ends).alias("e"), F.col(found).alias("m"), F.col(gaps).alias("g")),
            lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("match"), F.lower(F.right(z["g"], F.lit(CONTEXT))).alias("before")),
        )
        docs = docs.withColumn(name, F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as {SPANS})"))).drop(found, gaps, lengths, blocks, ends)
    return docs


def joined(spans: Column) -> Column:
    """kind:start:end of sorted ``spans``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
