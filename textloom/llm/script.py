"""Script variants of Han characters, by the public Unicode transform that Spark's own ICU library carries."""

from __future__ import annotations

from pyspark.sql import SparkSession

_HAN = "".join(chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)))


def simplified(spark: SparkSession) -> dict[int, int]:
    """For each Han character that has one its simplified form, as code points (for ``str.translate``).

    The table is made on the driver (some 3,000 pairs, a fixed size) and sent to the tasks. Several traditional
    characters may have the same simplified one; no character is equated with an unrelated one.
    """
    to = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(_HAN)
    return {ord(a): ord(b) for a, b in zip(_HAN, to, strict=True) if a != b}
