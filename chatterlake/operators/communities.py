"""Communities of stocks: attribution, catalog, match, the gate on noisy tickers, what is new or unsupported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import names
from chatterlake.functions.text import normal_name, quoted
from chatterlake.operators.signals import last_rows

LEAST_RELEVANCE, LEAST_MEMBERS, FINALISTS, LONGEST_NAME = 0.6, 10, 3, 21


def noisy_gate(matches: DataFrame, posts: DataFrame, stocks: DataFrame) -> DataFrame:
    """Matches of a noisy ticker stay where the post has $TICKER or matched the short company name.
    ``matches``: post_id, keyword, ticker; ``stocks``: ticker, company."""
    short = stocks.select("ticker", names.short_name(F.col("company")).alias("short"))
    j = matches.join(short, "ticker", "left").join(posts.select("post_id", F.concat_ws("\n", "title", "body").alias("text")), "post_id")
    marked = F.regexp_like("text", F.concat(F.lit(r"\$"), quoted(F.col("ticker")), F.lit("(?![A-Za-z0-9])")))
    j = j.select("post_id", "keyword", "ticker", (~names.is_noisy(F.col("ticker")) | marked).alias("passes"), (F.col("keyword") == F.col("short")).alias("by_company"))
    real = j.groupBy("post_id", "ticker").agg(F.bool_or(F.col("passes") | F.coalesce("by_company", F.lit(False))).alias("real")).where("real")
    return matches.join(real.select("post_id", "ticker"), ["post_id", "ticker"], "left_semi").select("post_id", "keyword", "ticker")


def relevant_pairs(communities: DataFrame, stocks: DataFrame, least_members: int = 0) -> DataFrame:
    """(name, ticker, relevance) of the pairs at 0.6 or more. ``communities``: name, text, subscribers; ``stocks``: ticker,
    company. Only pairs meet that share a token or a base of the name: without one, no rule can give 0.6."""
    nm = normal_name(F.col("name"))
    cut = lambda s: F.when(F.endswith(nm, s), F.substring(nm, F.lit(1), F.length(nm) - F.length(s)))
    bases = F.array_compact(F.concat(F.array(nm), F.transform(F.array(*map(F.lit, names.NAME_ENDINGS)), cut)))
    keys = F.array_union(F.split(F.lower(F.concat_ws(" ", "name", "text")), "[^a-z0-9]+"), bases)
    a = communities.where(F.col("subscribers") >= least_members).select("name", "text", F.explode(keys).alias("key"))
    words = names.telling_words(F.col("company"))
    b = stocks.select("ticker", "company", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("ticker"), F.get(words, 0), F.array_join(words, ""))))).alias("key"))
    pairs = a.join(b.where("key != ''"), "key").select("name", "text", "ticker", "company").distinct()
    scored = pairs.withColumn("relevance", names.attribution_relevance(F.col("name"), F.col("text"), F.col("ticker"), F.col("company")))
    return scored.where(F.col("relevance") >= LEAST_RELEVANCE).select("name", "ticker", "relevance")


def attributed(communities: DataFrame, stocks: DataFrame, least_members: int = 0) -> DataFrame:
    """(name, ticker, relevance): the one stock that a community is about; what ties stays unattributed."""
    # the best score and how many stocks have it, in aggregates
    each = relevant_pairs(communities, stocks, least_members).groupBy("name", "relevance").agg(F.count("*").alias("n"), F.min("ticker").alias("ticker"))
    best = each.groupBy("name").agg(F.max_by(F.struct("n", "ticker", "relevance"), "relevance").alias("best"))
    return best.where("best.n = 1").select("name", "best.ticker", "best.relevance")


def community_score(subscribers: Column, posts: Column, relevance: Column) -> Column:
    return F.round(relevance * (F.log10(subscribers + 1) * 10 + F.least(posts, F.lit(50))), 2)


def catalog(communities: DataFrame, stocks: DataFrame, least_members: int = 1000, least_for_stock: int = 50) -> DataFrame:
    """The catalog's rows at the floor of members: (name, subscribers, rule, ticker, relevance)."""
    kept = communities.where(F.col("subscribers") >= least_members)
    found = attributed(kept, stocks, least_for_stock)
    j = kept.join(found, "name", "left")
    rule = names.market_rule(F.col("name"), F.col("text"), F.col("ticker").isNotNull())
    return j.select("name", "subscribers", rule.alias("rule"), "ticker", "relevance")


def matches(communities: DataFrame, stocks: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """Candidates for each stock: (ticker, name, relevance, subscribers, activity, score, selected), of relevance 0.6 at least.

    ``communities``: name, text, lang, subscribers, over18; ``activity``: subreddit in lower case, posts_7d, commenters, else
    ``communities`` has these. A candidate's name begins with a stem of
    the ticker or company: names are cut to all their starts, which meet the stems by equality. Only the three with most
    members are measured; the others count no posts and no commenters."""
    low = F.lower("name")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(LONGEST_NAME))), lambda i: F.substring(low, F.lit(1), i))
    a = communities.select("*", F.explode(starts).alias("stem"))
    b = stocks.select("ticker", "company", F.explode(names.stems(F.col("ticker"), F.col("company"))).alias("stem"))
    found = a.join(b, "stem").drop("stem").distinct()
    found = found.withColumn("relevance", names.match_relevance(F.col("name"), F.col("text"), F.col("lang"), F.col("ticker"), F.col("company"))).where(F.col("relevance") >= LEAST_RELEVANCE)
    finalists = last_rows(found.select("ticker", "name", "subscribers"), ["ticker"], FINALISTS, F.desc("subscribers"), F.col("name")).select("ticker", "name", F.lit(True).alias("measured"))
    if activity is not None:  # of finalists alone
        finalists = finalists.join(activity.withColumnRenamed("subreddit", "__low"), F.lower("name") == F.col("__low"), "left").drop("__low")
        found = found.drop("posts_7d", "commenters")
    j = found.join(finalists, ["ticker", "name"], "left")
    seen = lambda c: F.when(F.col("measured"), F.coalesce(c, F.lit(0))).otherwise(0)
    activity = seen("commenters") * 3 + seen("posts_7d") + F.floor(F.col("subscribers") / 100)
    dead = (F.col("subscribers") < LEAST_MEMBERS) & (seen("posts_7d") == 0)
    return j.select(
        "ticker", "name", "relevance", "subscribers", activity.cast("long").alias("activity"), F.round(F.col("relevance") * activity, 2).alias("score"),
        (~dead & ~F.col("over18")).alias("selected"), F.coalesce("measured", F.lit(False)).alias("finalist"),
    )


def winners(candidates: DataFrame) -> DataFrame:
    """The best match of each stock: of the selected ones that of the highest score, then of most members."""
    order = F.struct("score", "subscribers", F.col("name"))
    return candidates.where("selected").groupBy("ticker").agg(F.max_by("name", order).alias("name"), F.max_by("score", order).alias("score"))


def new_and_unsupported(found: DataFrame, mapped: DataFrame) -> DataFrame:
    """(ticker, subreddit, state): found to be of the stock but not in the map: new; in the map but found otherwise:
    unsupported. ``found``: ticker, subreddit, verdict; ``mapped``: ticker, subreddit."""
    keys = ["ticker", "subreddit"]
    new = found.where("verdict = 'stock'").join(mapped, keys, "left_anti").select(*keys, F.lit("new").alias("state"))
    return new.unionByName(found.where("verdict != 'stock'").join(mapped, keys, "left_semi").select(*keys, F.lit("unsupported").alias("state")))


