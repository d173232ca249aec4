"""Vector expressions over arrays. Components are widened to DOUBLE before any arithmetic, so TINYINT never overflows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit vector; a vector shorter than 1e-10 stays as it is."""
    n = norm(v)
    return F.when(n < TINY, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for unequal lengths, empty or (nearly) zero vectors."""
    na, nb = norm(a), norm(b)
    bad = (F.size(a) != F.size(b)) | (F.size(a) <= 0) | (na < TINY) | (nb < TINY)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / F.when(bad, F.lit(1.0)).otherwise(na * nb))


def cosine_int8(a: Column, b: Column) -> Column:
    """Cosine of quantised vectors; 0 for unequal lengths or zero vectors."""
    na, nb = dot(a, a), dot(b, b)
    bad = (F.size(a) != F.size(b)) | (F.size(a) <= 0) | (na < TINY) | (nb < TINY)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / F.when(bad, F.lit(1.0)).otherwise(F.sqrt(na) * F.sqrt(nb)))


def quantize(v: Column) -> Column:
    """INT8 components: clamped to [-1, 1], times 127, rounded half away from zero."""
    return F.transform(v, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127.0).cast("tinyint"))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127.0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit signatures."""
    return F.bit_count(a.bitwiseXOR(b))


def gaussian_planes(n: int, dims: int, seed: int = 42) -> np.ndarray:
    """Seeded random unit hyperplanes."""
    p = np.random.default_rng(seed).standard_normal((n, dims))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def hashed_planes(n: int, dims: int) -> np.ndarray:
    """Planes of +1 and -1 from the first hex digit of md5("plane:dim"); any engine can make them."""
    import hashlib

    return np.array([[1.0 if int(hashlib.md5(f"{i}:{j}".encode()).hexdigest()[0], 16) >= 8 else -1.0 for j in range(dims)] for i in range(n)])


def hashed_gaussian_planes(n: int, dims: int) -> np.ndarray:
    """Random unit hyperplanes that any engine can make: normal numbers by the polar formula from two uniform ones, which are
    the first 32 bits of md5("u:plane:dim") and md5("v:plane:dim")."""
    import hashlib

    u = lambda tag: np.array([[(int(hashlib.md5(f"{tag}:{i}:{j}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for j in range(dims)] for i in range(n)])
    p = np.sqrt(-2 * np.log(u("u"))) * np.cos(2 * np.pi * u("v"))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def with_signatures(vectors: DataFrame, vec_col: str, planes: np.ndarray, prefix_bits: int = 8) -> DataFrame:
    """``vectors`` with ``sig`` (planes 0-63), ``sig_high`` (planes 64-127) and ``bucket`` (low bits of ``sig``).

    Bit i is set where the product with plane i is not negative, so a zero vector has all bits. Vectors that are null or of
    another length than the planes are left out. One matrix product per Arrow batch.
    """
    dims, n = planes.shape[1], planes.shape[0]
    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes) + ", sig bigint, sig_high bigint, bucket int"

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            on = np.stack(pdf[vec_col].to_numpy()).astype(np.float64) @ planes.T >= 0
            bits = np.zeros((len(pdf), 128), dtype=bool)
            bits[:, : min(n, 128)] = on[:, :128]
            words = np.packbits(bits, axis=1, bitorder="little").copy().view("<i8")
            yield pdf.assign(sig=words[:, 0], sig_high=words[:, 1], bucket=(words[:, 0] & ((1 << prefix_bits) - 1)).astype(np.int32))

    return vectors.where(F.size(vec_col) == dims).mapInPandas(sign, schema)


def register_sql(spark: SparkSession) -> None:
    """The same functions for SQL; the optimiser inlines them into the plan."""
    d = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {d.format('a', 'b')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt({d.format('a', 'a')})")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        f"if(size(a) <> size(b) OR size(a) <= 0, 0D, coalesce(try_divide({d.format('a', 'b')}, sqrt({d.format('a', 'a')}) * sqrt({d.format('b', 'b')})), 0D))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_quantize(a ARRAY<DOUBLE>) RETURNS ARRAY<TINYINT> RETURN transform(a, x -> cast(round(greatest(-1D, least(1D, x)) * 127D) as tinyint))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dequantize(q ARRAY<TINYINT>) RETURNS ARRAY<DOUBLE> RETURN transform(q, x -> x / 127D)")
