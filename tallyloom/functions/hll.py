"""Approximate distinct counts.

Two kinds of state, both mergeable: 'sketch' is Spark's own HLL sketch, wholly in the JVM; 'exact' keeps 2^14
registers of MurmurHash3, as the data model defines its estimates, which are thereby reproducible to the last digit. A state of
the latter kind is a sorted array of register * 64 + rho, of 16,384 entries at most; it is built and merged by grouping by register.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyloom.functions.murmur import murmur64

# The precision, and the coefficients of the LogLog-Beta estimator for it.
P = 14
REGISTERS = 1 << P
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)
BETA = (-0.370393911, 0.070471823, 0.17393686, 0.16339839, -0.09237745, 0.03738027, -0.005384159, 0.00042419)


def registers(values: pa.Array) -> np.ndarray:
    """register * 64 + rho of each string: the register is the hash's top 14 bits, rho one more than the zeros that follow."""
    return registers_of(murmur64(values))


def registers_of(h: np.ndarray) -> np.ndarray:
    """The same of hashes."""
    h = h | np.uint64(1)
    rest = h << np.uint64(P)
    # Smear the highest bit down; what is left above it are the leading zeros.
    for shift in (1, 2, 4, 8, 16, 32):
        rest |= rest >> np.uint64(shift)
    rho = 65 - np.bitwise_count(rest).astype(np.int64)
    return (h >> np.uint64(64 - P)).astype(np.int64) * 64 + rho


@F.pandas_udf(IntegerType())
def register_of(values: pd.Series) -> pd.Series:
    return pd.Series(registers(pa.array(values, pa.string(), from_pandas=True)).astype(np.int32))


def exact_partial(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): keys and the state of each group's non-empty strings. Strings are hashed where they are: a task sends on the greatest rho
    of each register and group, 16,384 numbers a group at most, however many strings there are."""
    each = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).select(*keys, value)
    return _collected(each.select(*keys, register_of(value).alias("_at")), keys, value)


def exact_merge(states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the register-wise maximum of states."""
    return _collected(states.select(*keys, F.explode(value).alias("_at")), keys, value)


def _collected(each: DataFrame, keys: list[str], value: str) -> DataFrame:
    by_register = each.groupBy(*keys, F.shiftright("_at", 6).alias("_register")).agg(F.max(F.col("_at").bitwiseAND(63)).alias("_rho"))
    packed = F.col("_register") * 64 + F.col("_rho")
    return by_register.groupBy(*keys).agg(F.sort_array(F.collect_list(packed.cast("int"))).alias(value))


def exact_estimate(state: Column) -> Column:
    used = F.coalesce(F.size(state), F.lit(0)).cast("double")
    empty = F.lit(float(REGISTERS)) - used
    total = F.aggregate(state, empty, lambda acc, x: acc + F.pow(F.lit(2.0), -(x.bitwiseAND(63)).cast("double")))
    z = F.log(empty + 1)
    beta = F.lit(BETA[0]) * empty
    for i, c in enumerate(BETA[1:], 1):
        beta = beta + F.lit(c) * F.pow(z, F.lit(float(i)))
    estimate = F.floor(F.lit(ALPHA * REGISTERS) * (REGISTERS - empty) / (total + beta) + 0.5).cast("bigint")
    return F.when(state.isNull() | (F.size(state) == 0), F.lit(0).cast("bigint")).otherwise(estimate)


def sketch_partial(value: Column) -> Column:
    return F.hll_sketch_agg(F.when(value != "", value), F.lit(P))


def sketch_merge(state: Column) -> Column:
    return F.hll_union_agg(state, F.lit(True))


def sketch_estimate(state: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(state), F.lit(0).cast("bigint"))
