"""How large tables are met: what can't meet is left where it is, and no key gathers its rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve, 1 MB however many values there are, and how many numbers of 64 bits are filled side by side.
SIEVE_BITS, WIDE = 1 << 23, 1 << 4

#: Parts into which the rows of keys that have many are dealt.
SALTS = 8

#: Parts of all keys by hash, and rows from which such a part counts as one of many rows.
BUCKETS, MANY = 1 << 16, 1_000_000


def _bit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))


def sieve(values: DataFrame):
    """A condition on a column that all values (one column) meet, and few others: that a bit of a fixed set
    is that of a value."""
    bit = _bit(F.col(values.columns[0]))
    filled = values.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int")).alias("bits"))
    # one row for WIDE numbers, so that few rows are moved, however many there are without a value
    of = filled.select(F.shiftright("at", 4).alias("row"), F.col("at").bitwiseAND(15).alias("i"), "bits")
    every = of.unionByName(values.sparkSession.range((SIEVE_BITS >> 6) // WIDE).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("bits")))
    rows = every.groupBy("row").agg(*[F.bit_or(F.when(F.col("i") == i, F.col("bits")).otherwise(0)).alias(f"n{i}") for i in range(WIDE)])
    parts = rows.select("row", F.array(*[f"n{i}" for i in range(WIDE)]).alias("n")).agg(F.array_sort(F.collect_list(F.struct("row", "n"))).alias("all"))
    whole = parts.select(F.flatten(F.transform("all", lambda x: x["n"]))).scalar()
    return lambda c: F.getbit(F.element_at(whole, F.shiftright(_bit(c), 6).cast("int") + 1), _bit(c).bitwiseAND(63).cast("int")) == 1


def beside(rows: DataFrame, others: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``rows`` joined to ``others`` by ``key``; ``rows`` are read twice.

    Keys of as many rows as no task should hold are dealt into SALTS parts by the columns ``by``, and the
    others are repeated for them alone; only then there is a column ``part``, which goes by key and ``by``."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    many = [r[0] for r in rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("bucket").collect()]
    if not many:
        return rows.join(others, key)
    part = lambda some, one: F.when(bucket.isin(many), some).otherwise(one)
    dealt = rows.withColumn("part", part(F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"), F.lit(0)))
    return dealt.join(others.withColumn("part", F.explode(part(F.array(*map(F.lit, range(SALTS))), F.array(F.lit(0))))), [key, "part"])
