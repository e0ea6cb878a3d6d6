"""Differences between two copies of a table, found through a column-by-bucket checksum matrix.

1. Each copy is reduced to the current row of every key. Keys fall into buckets of about ROWS_PER_BUCKET rows; per bucket
   and column, hashes of (key, value) are summed. As the key is part of the hash, values that change places within a bucket
   change the sums. A hash has 128 bits and is summed in four parts of 32 bits, so sums are exact, additive (partial sums of
   partitions, days or files may be added) and can't overflow a bigint below 2^31 rows a bucket.
2. The two matrices are compared. A bucket whose row counts or key sums differ, or a column whose sum differs in a
   bucket, is unequal. Buckets that agree in their low COARSE_BITS bits form a coarse bucket.
3. Only rows of unequal buckets are read again, with the columns unequal somewhere: the list of unequal coarse buckets has at
   most 2^COARSE_BITS rows and is broadcast, so it prunes the scan; beyond that many buckets the exact list is joined, by
   whatever way its size asks for. Both copies then meet in one aggregate by key.

The current row of a key is the one latest by the columns `latest` (null is earliest); ties go to the greatest hash of the
compared columns, by the same rule in both passes. Repeated rows of a key, however many, are combined before the shuffle.

Rows without a key can't be paired: each is reported as missing on the other side, with a null key, whether the other copy
holds an equal one or not, and repetitions included. Two null values are equal; what else counts as equal is up to the
expressions given. Empty tables give no differences on their side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsift.shared import materialize

ROWS_PER_BUCKET = 4
COARSE_BITS = 16
_LOW = 0xFFFFFFFF
WHITE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def loose(col: Column) -> Column:
    """col without regard to letter case, white space, '-' and '_'."""
    return F.upper(F.regexp_replace(col, f"{WHITE[:-1]}_-]+", ""))


def squeezed(col: Column) -> Column:
    """col with runs of white space as one blank, none at the ends, and null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(col, f"{WHITE}+", " ")), F.lit(""))


def bucket_bits(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """The number of bits of a bucket for tables of n_rows: buckets grow in number, not in rows."""
    return max(COARSE_BITS, (max(1, n_rows) // rows_per_bucket).bit_length())


def _bucket(key: str, bits: int) -> Column:
    return F.xxhash64(F.lit("bucket"), F.col(key)).bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket")


def _coarse(bucket: Column) -> Column:
    return bucket.bitwiseAND(F.lit((1 << COARSE_BITS) - 1))


def _parts(what: Sequence[Column]) -> list[Column]:
    """A 128-bit hash as four non-negative bigints of 32 bits."""
    wide = [F.xxhash64(F.lit(seed), *what) for seed in ("a", "b")]
    return [x for h in wide for x in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]


def _states(df: DataFrame, key: str, latest: Sequence[str], fields: Mapping[str, Callable[[Column], Column]], live: Sequence[str]) -> DataFrame:
    """`<key>, state` of the rows with a key: a struct whose greatest is the current one, with the values of `live`."""
    forms = {f: form(F.col(f)) for f, form in fields.items()}
    tie = F.xxhash64(*[x for v in forms.values() for x in (v.isNull(), v)]) if forms else F.lit(0)
    order = F.struct(*[F.col(c).alias(f"at{i}") for i, c in enumerate(latest)], tie.alias("tie"))
    values = F.struct(F.lit(0).alias("_"), *[forms[f].alias(f) for f in live])
    return df.where(F.col(key).isNotNull()).select(F.col(key), F.struct(order.alias("order"), values.alias("v")).alias("state"))


def checksums(df: DataFrame, key: str, latest: Sequence[str], fields: Mapping[str, Callable[[Column], Column]], bits: int = COARSE_BITS) -> DataFrame:
    """`bucket`, `n`, and the array of sums `key_sum` and `<field>_sum` of every bucket of one copy."""
    now = _states(df, key, latest, fields, list(fields)).groupBy(key).agg(F.max("state").alias("s"))
    # rows go to their bucket before they are hashed: few of a bucket meet by chance, and values are smaller than their sums
    now = now.withColumn("bucket", _bucket(key, bits)).repartition("bucket")
    parts = {"": _parts([F.col(key)])} | {f: _parts([F.col(key), F.col(f"s.v.`{f}`").isNull(), F.col(f"s.v.`{f}`")]) for f in fields}
    hashed = now.select("bucket", *[x.alias(f"{f}~{i}") for f, four in parts.items() for i, x in enumerate(four)])
    total = lambda f: F.array(*[F.sum(F.col(f"`{f}~{i}`")) for i in range(4)])
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), total("").alias("key_sum"), *[total(f).alias(f"{f}_sum") for f in fields])


def unequal_buckets(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Of two results of `checksums`: `bucket`, `keys_differ`, `fields` (those unequal), for unequal buckets only."""
    both = left.alias("l").join(right.alias("r"), "bucket", "full_outer")
    differ = lambda c: ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return both.select(
        "bucket",
        (differ("n") | differ("key_sum")).alias("keys_differ"),
        F.array_compact(F.array(*[F.when(differ(f"{f}_sum"), F.lit(f)) for f in fields])).alias("fields"),
    ).where(F.col("keys_differ") | (F.size("fields") > 0))


def differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    latest: Sequence[str],
    fields: Mapping[str, Callable[[Column], Column]],
    names: tuple[str, str] = ("only_left", "only_right"),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """`<key>, difference`: names[0] or names[1] for a key on one side only, else the name of each field that differs."""
    order = list(fields)
    bits = bucket_bits(max(left.count(), right.count()), rows_per_bucket)
    found = materialize(unequal_buckets(checksums(left, key, latest, fields, bits), checksums(right, key, latest, fields, bits), order), "unequal-buckets")
    marks = found.agg(*[F.max(F.array_contains("fields", f)).alias(f) for f in order]).first()
    live = [f for f in order if marks[f]]
    coarse = F.broadcast(found.select(_coarse(F.col("bucket")).alias("_coarse")).distinct())  # at most 2^COARSE_BITS rows

    def side(df: DataFrame, number: int) -> DataFrame:
        read = _states(df.withColumn("_coarse", _coarse(_bucket(key, bits))).join(coarse, "_coarse", "left_semi"), key, latest, fields, live)
        if bits > COARSE_BITS:
            read = read.withColumn("bucket", _bucket(key, bits)).join(found.select("bucket"), "bucket", "left_semi")
        return read.select(key, F.lit(number).alias("side"), "state")

    state = lambda n: F.max(F.when(F.col("side") == n, F.col("state")))
    both = side(left, 0).unionByName(side(right, 1)).groupBy(key).agg(state(0).alias("l"), state(1).alias("r"))
    fielded = [F.when(~F.col(f"l.v.`{f}`").eqNullSafe(F.col(f"r.v.`{f}`")), F.lit(f)) for f in live]
    which = (
        F.when(F.col("r").isNull(), F.array(F.lit(names[0])))
        .when(F.col("l").isNull(), F.array(F.lit(names[1])))
        .otherwise(F.array_compact(F.array(*fielded)) if fielded else F.array().cast("array<string>"))
    )
    keyed = both.select(key, F.explode(which).alias("difference"))
    lone = [df.where(F.col(key).isNull()).select(key, F.lit(name).alias("difference")) for df, name in zip((left, right), names, strict=True)]
    return keyed.unionByName(lone[0]).unionByName(lone[1])


def same(col: Column) -> Column:
    """col as it is."""
    return col
