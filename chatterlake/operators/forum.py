"""Forum posts: keyword links, rankings, digest input, threading, where a stock is discussed, community attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import text as tx
from chatterlake.operators.signals import last_rows
from chatterlake.sources import landed

#: Authors who aren't people; limits of a discovery verdict.
NOT_PEOPLE = ("", "[deleted]", "[unknown]", "automoderator")
MIN_MENTIONS, MIN_AUTHORS, STOCK_SHARE, NAMED_SHARE = 3, 2, 0.25, 0.05
#: Size of the filter of first tokens: 128 KB.
FILTER_LONGS = 16_384
#: Sketches have 2^14 registers: exact to about 1500 distinct values, then within 0.8 % (one standard error).
SKETCH_BITS = 14
#: Counts above this are counted exactly where a result must be exact.
SKETCH_EXACT = 1000
#: Pairs of a key that one task makes of a join on hubs.
HUB_PAIRS = 100_000


def filter_longs(n: int) -> int:
    """The size of a filter of n tokens: 16 bits a token, 128 KB at least and 8 MB at most."""
    return min(max(FILTER_LONGS, 1 << (max(n, 1) // 4).bit_length()), 64 * FILTER_LONGS)


def token_filter(tokens: DataFrame, longs: int = FILTER_LONGS) -> Column:
    """A bloom filter of a column ``token`` as a scalar subquery of 16384 longs, or as many as are asked for, whatever the number of tokens."""
    return _filter_words(tokens, longs).scalar()


def constant_token_filter(tokens: DataFrame) -> Column:
    """The same as a constant, for functions of arrays, where no subquery may stand. The driver has its 16384 longs."""
    return F.split(F.lit(",".join(map(str, _filter_words(tokens).first()[0]))), ",").cast("array<bigint>")


def _filter_words(tokens: DataFrame, longs: int = FILTER_LONGS) -> DataFrame:
    bits = F.array(*(F.pmod(h, F.lit(64 * longs)) for h in _filter_hashes(F.col("token"))))
    each = tokens.select(F.explode(bits).alias("bit")).select((F.col("bit") / 64).cast("long").alias("id"), F.expr("shiftleft(1L, int(bit % 64))").alias("long"))
    words = tokens.sparkSession.range(longs).join(each.groupBy("id").agg(F.bit_or("long").alias("long")), "id", "left").fillna(0, ["long"])
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "long"))), lambda x: x["long"]))


def _filter_hashes(token: Column) -> list[Column]:
    return [F.xxhash64(token), F.xxhash64(F.lit(1), token)]


def may_hold(words: Column, token: Column, longs: int = FILTER_LONGS) -> Column:
    """Whether the filter has the token, or by a chance of a hundredth at 50,000 tokens another one's bits."""
    at = [F.pmod(h, F.lit(64 * longs)) for h in _filter_hashes(token)]
    found = [F.getbit(F.get(words, (h / 64).cast("int")), (h % 64).cast("int")) == 1 for h in at]
    return found[0] & found[1]


def hash_held(words: Column, hashed: Column) -> Column:
    """``may_hold`` by the first hash of a token alone, which is given."""
    return F.getbit(F.get(words, F.shiftright(hashed, 6).bitwiseAND(FILTER_LONGS - 1).cast("int")), hashed.bitwiseAND(63).cast("int")) == 1


def keyword_matches(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(post_id, keyword, ticker). ``keywords``: keyword, ticker, pattern; as many as there may be.

    A post's distinct tokens meet the keywords' first tokens by equality, those alone that pass a filter of these; texts come
    to the pairs that are left, and only there the exact pattern runs: first without what it asks of the characters on either side, which
    takes a fraction of the time and few texts pass. So posts never meet all keywords."""
    first = F.get(F.regexp_extract_all(F.lower("keyword"), F.lit("([a-z0-9]+)"), F.lit(1)), 0)
    wanted = landed.saved(keywords.withColumn("token", first), "keywords")
    text = F.concat_ws(" ", "title", "body")
    posts = landed.spread(posts.select("post_id", "title", "body"))
    tokens = posts.select("post_id", F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("token"))
    tokens = tokens.where(may_hold(token_filter(wanted.select("token").distinct()), F.col("token")))
    pairs = landed.saved(tokens.join(landed.small(wanted), "token").select("post_id", "keyword", "ticker", "pattern").distinct(), "keyword-pairs")
    said = posts.select("post_id", text.alias("text")).join(landed.small(pairs), "post_id")
    inner = F.col("pattern")
    for side in tx.KEYWORD_SIDES:
        inner = F.replace(inner, F.lit(side), F.lit(""))
    return said.where(F.when(F.rlike("text", inner), F.expr("text rlike pattern"))).select("post_id", "keyword", "ticker").distinct()


def rank_posts(posts: DataFrame, by: str, most: int) -> DataFrame:
    orders = {"new": ["created_at"], "top": ["score", "num_comments"], "comments": ["num_comments", "score"]}
    order = [F.desc(c) for c in orders[by]] + [F.col("post_id")]
    return posts.orderBy(*order).limit(most)


def top_posts(links: DataFrame, n: int = 30) -> DataFrame:
    """Each ticker's n posts by score + 2 comments."""
    weight = F.col("score") + 2 * F.col("num_comments")
    return last_rows(links.withColumn("weight", weight), ["ticker"], n, F.desc("weight"), F.desc("created_at"), F.col("post_id"))


def top_comments(comments: DataFrame, n: int = 5) -> DataFrame:
    return last_rows(comments, ["post_id"], n, F.desc("score"), F.col("comment_id"))


def need_comments(posts: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """Notable posts never read, or young and read long ago; ``fetched_at`` may be null."""
    notable = (F.col("score") >= 20) | (F.col("num_comments") >= 15)
    hours = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 3600
    due = F.col("fetched_at").isNull() | ((hours("created_at") < 72) & (hours("fetched_at") > 20))
    return posts.where(notable & due).orderBy(F.desc("num_comments"), F.desc("score"), "post_id").limit(most)


def subreddit_rollup(links: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("subreddit", F.lit("")) == "", "unknown").otherwise(F.col("subreddit"))
    return links.groupBy("ticker", name.alias("subreddit")).agg(F.count("*").alias("posts"), F.sum("score").alias("score"))


def digest_input(links: DataFrame, comments: DataFrame, digests: DataFrame, now: Column, n: int = 30, n_comments: int = 5) -> DataFrame:
    """Each ticker's top posts of the last 7 days, first seen after its last good digest, with their top comments."""
    good = digests.where("status = 'ok'").groupBy("ticker").agg(F.max("created_at").alias("last_good"))
    fresh = links.join(good, "ticker", "left").where((F.col("created_at") >= F.date_sub(F.to_date(now), 7)) & (F.col("last_good").isNull() | (F.col("first_seen") > F.col("last_good"))))
    top = top_posts(fresh.drop("last_good"), n)
    said = top_comments(comments, n_comments).groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "comment_id", "body"))), lambda c: F.struct(c.comment_id, c.body)).alias("comments"))
    return top.join(said, "post_id", "left")


def prompt_pack(picked: DataFrame, cap: int = 200) -> DataFrame:
    """One text block a ticker: its posts tagged P1 on, with their comments."""
    lines = F.concat_ws("\n", F.concat(F.lit("[P"), F.col("rank"), F.lit("] "), tx.collapse(F.col("title"), cap)), F.array_join(F.transform(F.coalesce("comments", F.array().cast("array<struct<comment_id:bigint,body:string>>")), lambda c: F.concat(F.lit("- "), tx.collapse(c.body, cap))), "\n"))
    block = picked.select("ticker", "rank", lines.alias("block"))
    return block.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x.block), "\n").alias("prompt"))


def thread_depths(comments: DataFrame) -> DataFrame:
    """(comment_id, depth): 0 without a parent, else one more than the parent's, however deep; null where the way up
    ends at an unknown comment or in a circle.

    Pointers double: each round a comment's ancestor is replaced by that one's ancestor, so depth d takes log2(d)
    rounds. Each round is written to the shared folder, so lineage stays short."""
    rows = comments.select("comment_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    done = landed.saved(rows.where("up is null"), "depths")
    open_ = landed.saved(rows.where("up is not null").join(comments.select(F.col("comment_id").alias("up")).distinct(), "up", "left_semi").select("comment_id", "up", "steps"), "ways-up")
    left = open_.count()
    for _ in range(max(left, 1).bit_length() + 1):  # a way up has no more steps than there are replies
        if not left:
            break
        ends = done.select(F.col("comment_id").alias("up"), F.col("steps").alias("more"), F.lit(None).cast(open_.schema["up"].dataType).alias("next"))
        further = open_.select(F.col("comment_id").alias("up"), F.col("steps").alias("more"), F.col("up").alias("next"))
        above = ends.unionByName(further).groupBy("up").agg(F.min(F.struct("next", "more")).alias("above"))
        step = open_.join(above, "up").select("comment_id", F.col("above.next").alias("up"), (F.col("steps") + F.col("above.more")).alias("steps"))
        step = landed.saved(step, "ways-up")
        done, open_ = landed.saved(done.unionByName(step.where("up is null")), "depths"), step.where("up is not null")
        left = open_.count()
    return comments.select("comment_id").join(done.select("comment_id", F.col("steps").cast("int").alias("depth")), "comment_id", "left")


def people(df: DataFrame) -> DataFrame:
    return df.where(~F.lower(F.coalesce("author", F.lit(""))).isin(*NOT_PEOPLE))


def hub_join(a: DataFrame, b: DataFrame, keys: list[str], most: int = HUB_PAIRS, how: str = "inner") -> DataFrame:
    """The join on keys, inner or right (all rows of ``b``). Keys that give more pairs than ``most`` are hubs: their rows in ``b`` are dealt out over
    salts by their values, their rows in ``a`` are repeated for every salt, so no task makes all pairs of one key."""
    many = a.groupBy(*keys).agg(F.count("*").alias("na")).join(b.groupBy(*keys).agg(F.count("*").alias("nb")), keys)
    hubs = landed.saved(many.select(*keys, F.ceil(F.col("na") * F.col("nb") / most).cast("int").alias("__salts")).where("__salts > 1"), "hubs")
    salts = F.coalesce("__salts", F.lit(1))
    marked = lambda df: df.join(landed.small(hubs), keys, "left")
    left = marked(a).select(*a.columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    right = marked(b).select(*b.columns, F.pmod(F.xxhash64(*(c for c in b.columns if c not in keys)), salts).cast("int").alias("__salt"))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def followed_subreddits(posts: DataFrame, matches: DataFrame, most_authors: int = 40, most: int = 20) -> DataFrame:
    """From the posts that mention a stock to their most active authors, and on to the subreddits where those post:
    (ticker, subreddit, authors, rank). Authors are cut before the second hop."""
    seeds = people(posts.join(matches.select("post_id", "ticker").distinct(), "post_id")).groupBy("ticker", "author").agg(F.count("*").alias("n"))
    chosen = landed.saved(last_rows(seeds, ["ticker"], most_authors, F.desc("n"), F.col("author")).select("ticker", "author"), "authors")
    # a post's row isn't needed again: where an author posts is a row a subreddit
    where = landed.saved(posts.join(landed.small(chosen.select("author").distinct()), "author", "left_semi").select("author", "subreddit").distinct(), "authors-subreddits")
    counts = hub_join(chosen, where, ["author"]).groupBy("ticker", "subreddit").agg(F.count("*").alias("authors"))
    return last_rows(counts, ["ticker"], most, F.desc("authors"), F.col("subreddit"))


def mention_shares(posts: DataFrame, matches: DataFrame) -> DataFrame:
    """Per subreddit and ticker: mentions, posts, share, authors of mentions, last mention."""
    total = posts.groupBy("subreddit").agg(F.count("*").alias("posts"))
    hits = posts.join(matches.select("post_id", "ticker").distinct(), "post_id").groupBy("subreddit", "ticker").agg(F.count("*").alias("mentions"), F.count_distinct("author").alias("authors"), F.max("created_at").alias("last_mention"))
    return hits.join(total, "subreddit").withColumn("share", F.col("mentions") / F.col("posts"))


def days_covered(posts: DataFrame, now: Column, window: int, cap: int) -> DataFrame:
    """(subreddit, days_covered): the window, or less where the listing is as long as its cap."""
    return posts.withColumn("__now", now).groupBy("subreddit").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("__now").alias("last")).select(
        "subreddit", F.when(F.col("n") >= cap, F.round((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400e6, 1)).otherwise(float(window)).alias("days_covered")
    )


def discovery_verdict(named: Column) -> Column:
    weak = (F.col("mentions") < MIN_MENTIONS) | (F.col("authors") < MIN_AUTHORS)
    return F.when(F.startswith(F.lower("subreddit"), F.lit("u_")), "excluded").when(weak, "weak").when(F.col("share") >= F.when(named, NAMED_SHARE).otherwise(STOCK_SHARE), "stock").otherwise("general")


def subreddit_activity(posts: DataFrame, comments: DataFrame, now: Column) -> DataFrame:
    """Posts of 7 days and people who comment, exact."""
    recent = posts.groupBy("subreddit").agg(F.count_distinct(F.when(F.to_date("created_at") >= F.date_sub(F.to_date(now), 7), F.col("post_id"))).alias("posts_7d"))
    who = people(comments.join(posts.select("post_id", "subreddit"), "post_id")).groupBy("subreddit").agg(F.count_distinct("author").alias("commenters"))
    return recent.join(who, "subreddit", "left").fillna(0, ["commenters"])


def measured_activity(posts: DataFrame, comments: DataFrame, now: Column) -> DataFrame:
    """As ``subreddit_activity``: by sketches where these are exact, and for the larger subreddits by exact counts."""
    near = landed.saved(sketched_activity(activity_sketches(posts, comments).withColumn("__now", now), F.col("__now")), "activity")
    large = near.where((F.col("posts_7d") > SKETCH_EXACT) | (F.col("commenters") > SKETCH_EXACT)).select("subreddit")
    exact = subreddit_activity(posts.join(landed.small(large), "subreddit", "left_semi"), comments, now)
    return near.join(landed.small(large), "subreddit", "left_anti").unionByName(exact)


def activity_sketches(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(subreddit, day, posts, commenters): the distinct posts of a day and the people who comment on them, as sketches that can be
    merged. A day's row is made once; what is asked of a window later is a union of its days."""
    days = posts.select("subreddit", "post_id", F.to_date("created_at").alias("day"))
    made = days.groupBy("subreddit", "day").agg(F.hll_sketch_agg("post_id", F.lit(SKETCH_BITS)).alias("posts"))
    who = people(comments.join(days, "post_id")).groupBy("subreddit", "day").agg(F.hll_sketch_agg("author", F.lit(SKETCH_BITS)).alias("commenters"))
    return made.join(who, ["subreddit", "day"], "left")


def sketched_activity(sketches: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(subreddit, posts_7d, commenters) from sketches by day: posts of the last days, people who comment on posts of any day."""
    recent = F.when(F.col("day") >= F.date_sub(F.to_date(now), days), F.col("posts"))
    count = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("long"))
    return sketches.groupBy("subreddit").agg(count(recent).alias("posts_7d"), count(F.col("commenters")).alias("commenters"))
