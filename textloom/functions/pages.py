"""Pages of scanned or badly embedded files: glyph numbers, replayed recognition, extraction by quality."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X

# The placeholder of a glyph number, and the encodings tried for it, in order.
_GLYPH = re.compile(r"\(cid:(\d+)\)")
_CODECS = ("gbk", "gb2312", "gb18030", "big5")


def glyph(number: int) -> str | None:
    """The character of a glyph number read as two bytes; None if no encoding has it or it needs more bytes."""
    if number > 0xFFFF:
        return None
    for codec in _CODECS:
        try:
            return number.to_bytes(2, "big").decode(codec)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def decode_glyphs(texts: pd.Series) -> pd.Series:
    """Texts with their glyph placeholders decoded; what can't be decoded stays, null stays null."""
    known: dict[str, str] = {}

    def one(m: re.Match) -> str:
        if m.group() not in known:
            known[m.group()] = glyph(int(m.group(1))) or m.group()
        return known[m.group()]

    return texts.map(lambda t: _GLYPH.sub(one, t) if isinstance(t, str) else None)


def repaired_glyphs(c: Column) -> Column:
    """The decoded text if it has placeholders and reads well then, else the text."""
    decoded = decode_glyphs(c)
    return F.when(c.contains("(cid:") & ~X.is_garbled(decoded), decoded).otherwise(c)


def with_recognition(pages: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose text is garbled take a recognised one from ``replies`` (keys, reply), fences stripped; the
    others are never looked up."""
    bad = pages.where(X.is_garbled(F.col("text")))
    good = pages.where(~X.is_garbled(F.col("text")))
    r = replies.select(*keys, X.strip_fences(F.col("reply")).alias("reply"))
    mended = bad.join(r, keys, "left").withColumn("text", F.coalesce(F.when(F.col("reply") != "", F.col("reply")), F.col("text"))).drop("reply")
    return good.unionByName(mended.select(*good.columns))


def read_pages(extractions: DataFrame, replies: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys, text: of each page the text the cascade settles on.

    ``extractions``: keys, ord, text, what parsers made of a page; ord 0 and 1 are the quick readings of its text layer,
    higher ones second parsers, which count only if the best quick one is garbled. The most readable wins (the first of
    equals), glyph numbers in it are decoded if that reads well, and a page that is garbled still takes its recognised
    text from ``replies`` (keys, reply) or comes out empty.
    """
    keys = list(keys)
    text = X.normalize_page_text(F.col("text"))
    c = extractions.select(*keys, "ord", text.alias("text"))
    best = lambda on: F.max_by(F.when(on, F.col("text")), F.when(on & (F.col("text") != ""), F.struct(X.quality_score(F.col("text")), -F.col("ord"))))
    got = c.groupBy(*keys).agg(F.coalesce(best(F.col("ord") < 2), F.lit("")).alias("quick"), F.coalesce(best(F.col("ord") >= 0), F.lit("")).alias("every"))
    got = got.select(*keys, F.when(X.is_garbled(F.col("quick")), F.col("every")).otherwise(F.col("quick")).alias("text"))
    decoded = X.normalize_page_text(decode_glyphs(F.col("text")))
    got = got.withColumn("text", F.when(F.col("text").contains("(cid:") & ~X.is_garbled(decoded), decoded).otherwise(F.col("text")))
    if replies is not None:
        r = replies.select(*keys, X.normalize_page_text(X.strip_fences(F.col("reply"))).alias("reply"))
        got = got.join(r, keys, "left").withColumn("text", F.when(X.is_garbled(F.col("text")), F.coalesce("reply", F.lit(""))).otherwise(F.col("text"))).drop("reply")
    return got.withColumn("text", F.when(X.is_garbled(F.col("text")), "").otherwise(F.col("text")))


def join_pages(pages: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """key, text: a file's pages in order, joined by line ends. A file is one value, as the stages after need it whole."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce("text", F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("text"))
