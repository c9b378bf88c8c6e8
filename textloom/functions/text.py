"""Column expressions on text: cleaning, readability, terms, types. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.profile import Profile

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SPACE = r"(?U)\s"
ASCII_WORD = r"\A[A-Za-z][A-Za-z0-9\-]*\z"


def any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def unify_newlines(c: Column) -> Column:
    """Line feeds only, no control characters, no-break spaces as spaces."""
    return F.translate(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), CONTROL, ""), "\u00a0", " ")


def _lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), strip)


def _rule_line(x: Column) -> Column:
    """A line of at least 12 characters, at most three of them different."""
    return (F.length(x) >= 12) & (F.size(F.array_distinct(F.split(x, ""))) <= 3)


def clean_text(c: Column) -> Column:
    """Lines without control characters, blanks at the ends, page numbers and rules; runs of blanks are one."""
    kept = F.filter(_lines(unify_newlines(F.coalesce(c, F.lit("")))), lambda x: (x != "") & ~x.rlike(r"\A[0-9]{1,4}\z") & ~_rule_line(x))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"[ \t\f\x0B]+", " ")), "\n")


def normalize_page_text(c: Column) -> Column:
    """As clean_text, but numbers of pages stay and blanks are collapsed first."""
    s = F.regexp_replace(unify_newlines(F.coalesce(c, F.lit(""))), r"[ \t\f\x0B]+", " ")
    return F.array_join(F.filter(_lines(s), lambda x: (x != "") & ~_rule_line(x)), "\n")


def split_sentences(c: Column, marks: str) -> Column:
    """Array of sentences: a break after every mark and at line ends, trimmed, none empty."""
    broken = F.regexp_replace(c, f"([{re.escape(marks)}])", "$1\n")
    return F.filter(F.transform(F.split(broken, "\n+"), strip), lambda x: x != "")


def _counts(c: Column) -> dict[str, Column]:
    bare = F.regexp_replace(c, SPACE, "")
    n = lambda p, x=bare: F.regexp_count(x, F.lit(p))
    return {"bare": bare, "len": F.length(bare), "han": n("[一-鿿]"), "latin": n("[A-Za-z]+"), "valid": n("[一-龥a-zA-Z0-9]"),
            "symbol": n("[^一-龥a-zA-Z0-9]"), "noisy": n("[A-Za-z0-9]{8,}"), "control": n(CONTROL, c), "weird": n("[�•■●▪▫★☆]", c)}


def is_garbled(c: Column) -> Column:
    """Whether text looks wrongly extracted; null counts as empty, which does."""
    c = F.coalesce(c, F.lit(""))
    k = _counts(c)
    size = F.greatest(k["len"], F.lit(1))
    han, symbol, valid = k["han"] / size, k["symbol"] / size, k["valid"] / size
    return (
        F.when(k["len"] < 10, True).when(k["control"] > 0, True)
        .when((han < 0.05) & (symbol > 0.25), True)
        .when((han < 0.08) & (k["noisy"] >= 2) & (symbol > 0.15), True)
        .when((han < 0.02) & (k["latin"] >= 3) & (symbol > 0.35) & ~c.contains(" "), True)
        .otherwise((valid < 0.45) & (han < 0.12))
    )


def quality_score(c: Column) -> Column:
    """Readability, the higher the better; 0 for empty text."""
    k = _counts(F.coalesce(c, F.lit("")))
    size = F.greatest(k["len"], F.lit(1))
    score = (k["valid"] + 0.8 * k["han"] - 0.6 * k["symbol"] - (k["control"] + k["weird"])) / size
    return F.when(k["len"] == 0, F.lit(0.0)).otherwise(score)


def normalize_term(c: Column) -> Column:
    return F.when(c.rlike(ASCII_WORD), F.lower(c)).otherwise(c)


def is_noise(c: Column, p: Profile) -> Column:
    """Whether a term says nothing: stop words, citations, figure numbers, glued and plain foreign words."""
    low = F.lower(c)
    word = c.rlike(ASCII_WORD)
    noise = c.isin(*p.stopwords) if p.stopwords else F.lit(False)
    if p.latin_stopwords:
        noise = noise | low.isin(*p.latin_stopwords)
    if p.noise_parts:
        noise = noise | c.rlike(any_of(p.noise_parts)) | c.isin(*p.noise_terms)
        noise = noise | (c.startswith("第") & c.endswith("章")) | c.rlike(r"\A[图表式][0-9]+\z") | (c.rlike("\\A[图表]") & (F.length(c) <= 4))
        noise = noise | c.rlike("[a-z]{2,}[A-Z][a-z]+") | low.rlike(any_of(p.noise_latin_parts))
        noise = noise | (c.rlike("[一-鿿]") & c.rlike("[A-Za-z]"))
        plain = word & (c.rlike(r"\A[a-z][a-z0-9\-]*\z") | (F.length(c) <= 3) | c.rlike(r"\A[A-Z]"))
        noise = noise | (plain & ~low.isin(*(p.latin_whitelist | p.latin_keep)))
    return noise


def token_shape(c: Column, p: Profile) -> Column:
    """Whether a token has the length and letters of one; the cheap half of valid_token."""
    shape = r"\A[一-鿿A-Za-z][一-鿿A-Za-z0-9\-]*\z" if p.name == "zh" else r"\A\p{L}+\z"
    return F.length(c).between(2, p.max_token) & c.rlike(shape)


def valid_token(c: Column, p: Profile) -> Column:
    return token_shape(c, p) & ~is_noise(c, p)


def infer_type(c: Column, rules, default: str) -> Column:
    """The first type one of whose keywords the term contains."""
    out = None
    for kind, words in rules:
        hit = c.rlike(any_of(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


def strip_fences(c: Column) -> Column:
    """A model's reply without the fence lines around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"\A```[A-Za-z]*\s*", ""), r"\s*```\z", ""))


def drop_fence_lines(c: Column) -> Column:
    """A reply without its first and last line if it begins with a fence; whatever these lines say."""
    c = strip(c)
    lines = F.split(c, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(c.startswith("```"), inner).otherwise(c)


def entity_id(c: Column) -> Column:
    """The node id of a name: trimmed, white space as underscores."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", "_")


def occurrences(text: Column, term: Column) -> Column:
    """Starts (from 0) of a term in a text, left to right, none overlapping the one before."""
    n = F.length(term)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, n) == term)
    kept = F.aggregate(places, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (i >= F.element_at(acc, -1) + n), F.array_append(acc, i)).otherwise(acc))
    return F.when(n > 0, F.transform(kept, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def slug_name(doc_id: Column, slug: Column) -> Column:
    """ASCII file name of a document."""
    return F.concat(F.lower(doc_id), F.lit("_"), F.coalesce(slug, F.lit("file")), F.lit(".txt"))


def sections(c: Column) -> Column:
    """The chapters of a LaTeX text, each from its section command on."""
    return F.filter(F.split(c, r"(?=\\section\{)"), lambda x: x.startswith("\\section{"))
