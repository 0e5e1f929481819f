"""Text expressions: keywords, names, tokens, fingerprints, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell a claim.
CLAIM_STOPWORDS = tuple(
    "a an the and or but if of for to in on at by with from as is are was were be been being it its this that these those they them their he she his her we our you your "
    "will would can could should may might must do does did has have had not no about into over under than then there here so such very more most much many "
    "company stock shares share price".split()
)


def quoted(text: Column) -> Column:
    """A pattern, for regexp functions, that takes the text as it stands."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def words_array(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


#: What patterns of keywords ask of the characters on either side; the longer first.
KEYWORD_SIDES = (r"(^|[^A-Za-z0-9])\$?", "(^|[^A-Za-z0-9])", "([^A-Za-z0-9]|$)")


def keyword_pattern(word: str) -> str:
    """A pattern without lookaround: all capitals match with case and an optional $, other phrases without case, with
    any white space between their words. The character on either side is consumed."""
    if word.isupper():
        return rf"(^|[^A-Za-z0-9])\$?{re.escape(word)}([^A-Za-z0-9]|$)"
    return "(?i)(^|[^A-Za-z0-9])" + r"\s+".join(map(re.escape, word.split())) + r"([^A-Za-z0-9]|$)"


def tokens(text: Column) -> Column:
    """Distinct runs of letters a-z and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def claim_tokens(text: Column) -> Column:
    # a list of constants is looked up in a set made once; array_except would make it for every row
    return F.sort_array(F.filter(tokens(text), lambda w: ~w.isin(*CLAIM_STOPWORDS)))


def fingerprint(kind: Column, claim: Column) -> Column:
    """16 hex digits for a claim's kind and sorted tokens."""
    return F.substring(F.sha1(F.concat(kind, F.lit(":"), F.array_join(claim, " ")).cast("binary")), 1, 16)


def hashed_id(length: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, length)


def iso_duration(text: Column) -> Column:
    """PT1H2M3S in seconds; 0 where nothing is found."""
    part = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+){u}", 1).try_cast("int"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def clean_handle(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), "^@+", ""))


def clean_subreddit(text: Column) -> Column:
    """The name in r/NAME or an address, null unless 3 to 21 letters, digits or underscores."""
    name = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(https?://[^/]+)?/*(r/)?", ""), r"/.*$", "")
    return F.when(name.rlike("^[A-Za-z0-9_]{3,21}$"), name)


def is_ticker_shape(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z]{1,6}([.-][A-Za-z])?$")


def collapse(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def capped(payload: Column, most: int) -> Column:
    return F.substring(payload, 1, most)


def joined_media(urls: Column) -> Column:
    """Addresses with commas between; null for none."""
    return F.when(F.size(urls) > 0, F.array_join(urls, ","))


def finite(x: Column) -> Column:
    """Null for what isn't a number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
