"""Catalyst's own Bloom filter as Column expressions.

Spark builds and probes these filters for its runtime join filters but lists neither as a function.
Both stay in the JVM. The size is bounded by `spark.sql.optimizer.runtime.bloomFilter.maxNumBits`
(8 MB by default); beyond that the filter only lets more keys through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 12
MAX_BITS = 64 * 1024 * 1024


def _jvm():
    return SparkSession.getActiveSession()._jvm


def _utils():
    return _jvm().org.apache.spark.sql.classic.ExpressionUtils


def _expr(c: Column):
    return _utils().expression(c._jc)


def _column(expr) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(_utils().column(expr))


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> Column:
    """A scalar subquery holding the filter over `keys[key]`; NULL (nothing known) when there are no keys."""
    bits = max(8192, min(MAX_BITS, BITS_PER_KEY * max(1, n_keys)))
    agg = _jvm().org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(
        _expr(F.xxhash64(key)), _expr(F.lit(max(1, n_keys)).cast("long")), _expr(F.lit(bits).cast("long"))
    )
    return keys.agg(_column(agg.toAggregateExpression()).alias("bloom")).scalar()


def might_contain(bloom: Column, key: Column) -> Column:
    """False: surely absent. True or NULL: unknown."""
    return _column(
        _jvm().org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(_expr(bloom), _expr(F.xxhash64(key)))
    )
