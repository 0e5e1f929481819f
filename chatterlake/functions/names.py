"""Names of companies and communities: short names, stems, attribution and match relevance, market classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterlake.functions.text import normal_name, quoted, words_array

# Legal endings that a short company name loses.
LEGAL_ENDINGS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "holdings", "holding", "nv", "sa", "se", "ag", "the")
# Words of a company name that don't tell it.
COMPANY_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "holdings", "holding", "group", "sa", "nv", "ag", "se",
    "technologies", "technology", "tech", "systems", "usa", "international", "industries", "the",
)
# Endings that a community's name may add to a ticker or company.
NAME_ENDINGS = ("stock", "stocks", "investing", "investor", "investors", "trading", "trader", "traders", "dd", "options", "stockmarket", "market", "community", "official", "hq")
# Tickers that are everyday words, for attribution and for match and search.
ATTRIBUTION_WORDS = (
    "cake", "eat", "coin", "poet", "open", "run", "car", "all", "key", "net", "app", "gold", "cash", "play", "love", "fire", "real", "air",
    "well", "fun", "live", "nice", "best", "free", "step", "form", "site",
)
MATCH_WORDS = (
    "path", "poet", "coin", "hut", "net", "app", "cake", "eat", "open", "run", "lite", "car", "all", "key", "gold", "cash", "play", "love", "fire", "real", "air",
    "well", "fun", "live", "nice", "best", "free", "step", "form", "site", "arm", "on", "it", "up", "so", "by", "we", "me", "go", "big", "new",
)
# Words that make a text financial, for attribution and for match.
ATTRIBUTION_FINANCE = (
    "stock", "stocks", "invest", "investing", "investor", "investors", "trading", "trader", "traders", "shares", "share", "shareholder", "shareholders", "ticker",
    "nasdaq", "nyse", "earnings", "dividend", "dividends", "bullish", "bearish", "options", "equity", "equities", "dd", "calls", "puts", "portfolio", "valuation",
)
MATCH_FINANCE = (
    "stock", "stocks", "invest", "investing", "investor", "investors", "trading", "trader", "traders", "shareholder", "shareholders", "ticker",
    "nasdaq", "nyse", "amex", "earnings", "dividend", "dividends", "bullish", "bearish", "options", "equity", "equities", "dd", "calls", "puts",
    "portfolio", "valuation", "float", "premarket", "holders",
)
# Words of a name that are enough for a market community, endings that are, words that need company,
# and finance words of a text that are beyond doubt.
MARKET_STRONG = (
    "stock", "stocks", "stockmarket", "stockmarkets", "stonks", "stonk", "wallstreetbets", "wallstreet", "wsb", "investing", "investment", "investments", "investor", "investors",
    "pennystocks", "pennystock", "daytrading", "swingtrading", "valueinvesting", "dividends", "dividend", "shortsqueeze", "nasdaq", "nyse", "etf", "etfs", "spac", "spacs",
    "hedgefund", "hedgefunds", "brokerage", "shareholders", "smallcaps", "microcaps", "bagholders", "tickers", "premarket", "aftermarket",
)
MARKET_ENDINGS = ("stocks", "stockmarket", "investing", "investors", "investor", "wallstreetbets", "pennystocks", "stonks")
MARKET_WEAK = (
    "market", "markets", "trading", "trader", "traders", "trade", "options", "calls", "puts", "shares", "equity", "equities", "finance", "financial", "portfolio", "earnings", "ipo",
    "bull", "bulls", "bear", "bears", "bullish", "bearish", "ticker", "securities", "capital", "money", "dd", "yolo", "valuation", "fundamentals", "technicals",
)
TEXT_STRONG = (
    "stock", "stocks", "invest", "investing", "investor", "investors", "shareholder", "shareholders", "nasdaq", "nyse", "ticker", "earnings", "dividend", "dividends",
    "bullish", "bearish", "equity", "equities", "trading", "traders", "puts", "calls", "valuation",
)


def short_name(company: Column) -> Column:
    """The company name without punctuation, legal words at its end and "the" at its start; null below three characters."""
    words = F.filter(F.split(F.regexp_replace(company, r"(?U)[^\w\s&'-]", " "), r"\s+"), lambda w: w != "")
    told = F.transform(words, lambda w, i: F.when(~F.lower(w).isin(*LEGAL_ENDINGS), i + 1))
    words = F.slice(words, F.lit(1), F.coalesce(F.array_max(told), F.lit(0)))
    starts = F.array_min(F.transform(words, lambda w, i: F.when(F.lower(w) != "the", i + 1)))
    name = F.array_join(F.when(starts.isNotNull(), F.slice(words, starts, F.size(words))), " ")
    return F.when(F.length(name) >= 3, name)


def ticker_keywords(ticker: Column, company: Column) -> Column:
    """The ticker, and the short company name where it is another word."""
    short = short_name(company)
    return F.array_compact(F.array(ticker, F.when(F.upper(short) != ticker, short)))


def is_noisy(ticker: Column) -> Column:
    """Tickers of up to two letters and everyday words prove nothing on their own."""
    return (F.length(ticker) <= 2) | F.lower(ticker).isin(*MATCH_WORDS)


def telling_words(company: Column) -> Column:
    """Runs of letters and digits of a company name, three at least, that aren't suffixes."""
    words = F.split(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*COMPANY_SUFFIXES))


def spoken_words(company: Column) -> Column:
    """As ``telling_words``, with words parted by white space and commas only."""
    words = F.transform(F.split(F.replace(F.lower(F.coalesce(company, F.lit(""))), F.lit(","), F.lit(" ")), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*COMPANY_SUFFIXES))


def stems(ticker: Column, company: Column) -> Column:
    """Starts of names to look for: the ticker, the first word, all words joined; 21 characters at most."""
    words = spoken_words(company)
    found = F.array_distinct(F.array_compact(F.array(F.lower(ticker), normal_name(F.get(words, 0)), normal_name(F.array_join(words, "")))))
    return F.filter(found, lambda s: F.length(s).between(1, 21))


def is_about(name: Column, base: Column, with_ending: Column) -> Column:
    """A normalised name is the base, or the base and a known ending; never a mere part of it."""
    rest = F.substr(name, F.length(base) + 1)
    return (F.length(base) > 0) & ((name == base) | (with_ending & F.startswith(name, base) & rest.isin(*NAME_ENDINGS)))


def attribution_relevance(name: Column, text: Column, ticker: Column, company: Column) -> Column:
    """0, 0.6 or 1: 0.6 for the ticker, 0.6 for the company, 1 at most. A mere mention needs finance words too, and
    everyday words as tickers need them for any match."""
    t, nm = F.lower(ticker), normal_name(name)
    raw = F.lower(F.concat_ws(" ", name, text))
    hay = F.split(raw, "[^a-z0-9]+")
    finance = F.arrays_overlap(hay, words_array(ATTRIBUTION_FINANCE)) | F.contains(raw, F.concat(F.lit("$"), t))
    form, mention = is_about(nm, t, F.length(t) >= 3), F.array_contains(hay, t)
    hit = F.when(t.isin(*ATTRIBUTION_WORDS), (form | mention) & finance).otherwise(form | (mention & finance))
    words = telling_words(company)
    told = (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(hay, w)) & finance
    named = is_about(nm, F.array_join(words, ""), F.lit(True))
    return F.least(F.lit(1.0), F.when(hit, 0.6).otherwise(0.0) + F.when(named | told, 0.6).otherwise(0.0))


def match_relevance(name: Column, text: Column, lang: Column, ticker: Column, company: Column) -> Column:
    """0, 0.4, 0.6, 0.7 or 1 that a community is a company's. The text is title and description without the name, so a
    name can't vouch for itself: what only repeats the ticker or the company, and texts in other languages that don't
    name the company or $TICKER, stay at 0.4."""
    t, nm, hay = F.lower(ticker), normal_name(name), F.lower(F.coalesce(text, F.lit("")))
    found = F.split(hay, "[^a-z0-9$]+")
    words = spoken_words(company)
    everyday = t.isin(*MATCH_WORDS)
    by_ticker = F.when(everyday, nm == t).otherwise((F.length(t) >= 2) & is_about(nm, t, F.lit(True)))
    base = normal_name(F.array_join(words, ""))
    named = by_ticker | ((F.length(base) >= 2) & is_about(nm, base, F.lit(True)))
    dollar = F.regexp_like(hay, F.concat(F.lit(r"\$"), quoted(t), F.lit(r"\b")))
    token = F.array_contains(found, t) & ~everyday
    told = (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(found, w)) & ~((F.size(words) == 1) & (F.get(words, 0) == t))
    finance = F.arrays_overlap(found, words_array(MATCH_FINANCE))
    foreign = F.substring(F.lower(F.coalesce(lang, F.lit("en"))), 1, 2) != "en"
    guarded = (named & ~by_ticker & ~dollar & ~token & ~finance) | (by_ticker & ~told & ~finance) | (foreign & ~told & ~dollar)
    said = dollar | token | told
    return F.when(guarded, 0.4).when(named & said, 1.0).when(named & finance, 0.7).when(said & finance, 0.6).when(named | said, 0.4).otherwise(0.0)


def humps(text: Column) -> Column:
    """Words in lower case; capitals within a word start a new one: ASTSpaceMobile is ast, space, mobile."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"), F.lit(1))
    return F.transform(found, lambda w: F.lower(w))


def strong_words(words: Column) -> Column:
    ending = lambda w: (F.length(w) > 6) & w.rlike("(" + "|".join(MARKET_ENDINGS) + ")$")
    return F.filter(words, lambda w: w.isin(*MARKET_STRONG) | ending(w))


def market_rule(name: Column, text: Column, attributed: Column) -> Column:
    """Which route makes a community one of the market: ticker, name-strong, name-weak+context, text; else no."""
    n, x = humps(name), humps(text)
    strong, finance = F.size(strong_words(x)) > 0, F.array_intersect(x, words_array(ATTRIBUTION_FINANCE))
    return (
        F.when(attributed, "ticker").when(F.size(strong_words(n)) > 0, "name-strong")
        .when(F.arrays_overlap(n, words_array(MARKET_WEAK)) & (strong | (F.size(finance) > 0)), "name-weak+context")
        .when((F.size(finance) >= 2) & (strong | F.arrays_overlap(finance, words_array(TEXT_STRONG))), "text").otherwise("no")
    )
