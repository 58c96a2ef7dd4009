"""Text clean-up that keeps the layout: columns are told apart by two or more spaces."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Variants of dash, quotes and blank with what stands for them; the last two vanish.
DASHES, QUOTES, DOUBLE_QUOTES, BLANKS, NOTHING = "–—−‐‑", "‘’", "“”", "    |", "​﻿"
_FROM = DASHES + QUOTES + DOUBLE_QUOTES + BLANKS + NOTHING
_TO = "-" * len(DASHES) + "'" * len(QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(BLANKS)


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only rows with characters beyond ASCII are sent to Python; the others are theirs already."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(_compatible(F.when(~plain, text)))


def tidy_layout(text: Column) -> Column:
    """Lines without trailing white space, no two blank lines together, none at either end."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "\t", "    ")
    t = F.translate(t, _FROM, _TO)
    t = F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def normalize_text(text: Column) -> Column:
    """NFKC and ``tidy_layout``; null becomes the empty text."""
    return tidy_layout(nfkc(F.coalesce(text, F.lit(""))))


def is_useful_text(text: Column, least: int = 40) -> Column:
    """A text layer worth reading: enough visible characters, half of them letters or digits."""
    visible = F.regexp_replace(text, r"(?U)\s+", "")
    return (F.length(visible) >= least) & (2 * F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", "")) >= F.length(visible))


def display_name(name: Column) -> Column:
    """Last part of a path, printable characters only, at most 255 of them."""
    base = F.substring_index(F.replace(F.coalesce(name, F.lit("upload")), F.lit("\\"), F.lit("/")), "/", -1)
    clean = F.left(F.regexp_replace(F.trim(base), r"[\p{C}\p{Zl}\p{Zp}]", ""), F.lit(255))
    return F.when(clean == "", "upload").otherwise(clean)


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; empty where there is none or only a leading dot."""
    return F.lower(F.regexp_extract(name, r"^.*[^.].*?(\.[^.\s]+)$", 1))
