"""Column functions on text: everything but NFKC is a built-in expression."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import ABBREVIATIONS, CLOSERS, CONTRACTION, DISCOURSE_MARKERS, STOPWORDS, TOKEN, WORD

_MARK = "\x01"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """NFKC (Arrow, and only where the text is not ASCII), then line ends as ``\\n``."""
    out = F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(F.when(text.rlike("[^\\x00-\\x7F]"), text))).otherwise(text) if nfkc else text
    return F.regexp_replace(out, "\r\n?", "\n")


def tokenize_words(text: Column) -> Column:
    """Words of ASCII letters, apostrophes and hyphens, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def word_count(text: Column) -> Column:
    """Words of ``tokenize_words``."""
    return F.regexp_count(text, F.lit(WORD))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def raw_word_count(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(TOKEN))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Stripped, each run of white space as one space: the key of dedup."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def excerpt(text: Column, chars: int = 400) -> Column:
    return F.substring(text, 1, chars)


def excerpt_line(text: Column, chars: int = 150) -> Column:
    """The excerpt on one line, cut."""
    return F.substring(collapsed(text), 1, chars)


def _among(words: Column, known: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: w.isin(*known))


def discourse_markers_in(text: Column) -> Column:
    """Connectives in order of appearance, repeated ones too."""
    return _among(tokenize_words(text), DISCOURSE_MARKERS)


def stopwords_in(words: Column) -> Column:
    return _among(words, STOPWORDS)


def markers_among(words: Column) -> Column:
    return _among(words, DISCOURSE_MARKERS)


def contraction_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CONTRACTION))


def punctuation_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{P}"))


def digit_count(text: Column) -> Column:
    """Decimal digits, and the superscript, subscript and circled ones that count as digits."""
    return F.regexp_count(text, F.lit("[\\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"))


def upper_tokens(text: Column) -> Column:
    """Tokens of two or more characters with letters, all in upper case."""
    return F.filter(raw_tokens(text), lambda t: (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 1))


def sentence_boundary() -> str:
    """A boundary as one pattern; group 1 is the sentence's end.

    A lone period after an abbreviation or one letter is none; the word before
    the period is looked at up to the last character that it cannot hold.
    """
    short = "|".join(re.escape(a) for a in ABBREVIATIONS)
    no_abbreviation = rf"(?<!(?<![\p{{L}}\p{{N}}.])(?i:{short}|\p{{L}}))"
    return rf"(?U)([.!?]{{2,}}{CLOSERS}*|[!?]{CLOSERS}*|\.{CLOSERS}+|(?=\.){no_abbreviation}\.)(?=\s|\z)"


def sentence_pieces(text: Column) -> Column:
    """The text cut after each sentence end: the pieces joined are the text again."""
    return F.split(F.regexp_replace(F.translate(text, _MARK, " "), sentence_boundary(), "$1" + _MARK), _MARK)


def sentences(text: Column) -> Column:
    """Trimmed sentences in order, without empty ones."""
    return F.filter(F.transform(sentence_pieces(text), strip), lambda s: s != "")
