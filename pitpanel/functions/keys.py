"""Telling rows whose key may be among some keys from those whose key surely isn't, without shuffling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap, 8 MB of a broadcast at most; beyond some millions of keys it lets more and more rows through, and nothing else.
BITS = 1 << 26
#: Bits that one row of a bitmap holds.
_PART = 32_768


def split_by_keys(rows: DataFrame, keys: Sequence[str], others: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among those of others, and rows whose key surely isn't; nulls are equal to each other.

    A bitmap of hashed keys, of bounded size, is built by aggregation and broadcast; both parts read rows once. Keys must have the
    same types on both sides.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1
    part, held, may = "_bitmap_part", "_bitmap", "_may_be"
    bitmap = others.groupBy(F.bitmap_bucket_number(place).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(held))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = rows.withColumn(part, F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), part, "left")
    marked = marked.withColumn(may, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return marked.filter(F.col(may)).select(*rows.columns), marked.filter(~F.col(may)).select(*rows.columns)
