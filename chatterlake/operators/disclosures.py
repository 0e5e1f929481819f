"""Public trade disclosures: cleaning, member matching, committees, tracked trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions.money import amount_range
from chatterlake.functions.text import hashed_id

#: Funds that stand for the whole market; parts of names of assets that aren't stocks; parts that are known.
BROAD_FUNDS = ("SPY", "VOO", "VTI", "QQQ", "BND", "IVV", "SCHB", "VT", "ITOT", "SPTM")
BOND_LIKE = ("bond", "municipal", "treasury", "mutual fund", "money market")
KNOWN_TYPES = ("stock", "option", "etf", "bond", "mutual", "treasury", "fund")
#: Types of transactions.
TRANSACTION_TYPES = {"purchase": "buy", "sale (full)": "sell", "sale (partial)": "sell", "sale": "sell", "exchange": "exchange"}
#: Parts of the names of the committees whose leaders are watched.
WATCHED_COMMITTEES = (
    "house armed services", "armed services committee", "senate armed services", "house financial services", "financial services committee", "senate banking",
    "house energy and commerce", "energy and commerce", "senate energy and natural resources", "house permanent select committee on intelligence",
    "permanent select committee on intelligence", "senate select committee on intelligence", "select committee on intelligence", "house foreign affairs",
    "foreign affairs committee", "senate foreign relations", "foreign relations committee", "senate commerce, science", "commerce, science, and transportation",
    "house science, space", "science, space, and technology",
)


def transaction_type(text: Column) -> Column:
    t, kind = F.lower(F.trim(text)), F.lit("other")
    for name, k in TRANSACTION_TYPES.items():
        kind = F.when(t == name, k).otherwise(kind)
    return kind


def party_letter(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.isin("D", "DEMOCRAT", "DEMOCRATIC"), "D").when(t.isin("R", "REPUBLICAN"), "R").otherwise("I")


def person_name(first: Column, last: Column, name: Column) -> Column:
    """First and last name, else the name as it is given, else Unknown."""
    both = F.trim(F.concat_ws(" ", F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))))
    return F.when(both != "", both).otherwise(F.coalesce(name, F.lit("Unknown")))


def clean_trades(raw: DataFrame) -> DataFrame:
    """Trades of single assets: a bad transaction date drops the row, a bad disclosure date falls back on it.
    Broad funds and bond-like types are dropped; types that aren't known stay, flagged."""
    low, high = amount_range(F.col("amount"))
    kind = F.lower(F.coalesce("asset_type", F.lit("")))
    dropped = F.upper(F.trim("ticker")).isin(*BROAD_FUNDS) | kind.rlike("|".join(BOND_LIKE))
    rows = raw.where(~dropped).select(
        "filing_id", F.trim("full_name").alias("full_name"), F.upper(F.trim("ticker")).alias("ticker"), F.expr("try_cast(transaction_date as date)").alias("transaction_date"),
        F.coalesce(F.expr("try_cast(disclosure_date as date)"), F.expr("try_cast(transaction_date as date)")).alias("disclosure_date"), transaction_type(F.col("type")).alias("transaction_type"),
        party_letter(F.col("party")).alias("party"), low.alias("amount_low"), high.alias("amount_high"), ((kind != "") & ~kind.rlike("|".join(KNOWN_TYPES))).alias("unknown_type"), "amount",
    )
    rows = rows.where("transaction_date is not null and ticker != ''")
    return rows.withColumn("trade_id", hashed_id(24, F.col("full_name"), F.col("transaction_date").cast("string"), F.col("ticker"), F.col("amount"))).drop("amount")


def match_people(trades: DataFrame, people: DataFrame) -> DataFrame:
    """Adds bioguide_id by full name, else by last name. Of equal full names the last person counts, of equal last
    names the first. ``people``: bioguide_id, full_name, in the order of bioguide_id."""
    last = lambda c: F.lower(F.element_at(F.split(F.trim(c), r"\s+"), -1))
    full_map = people.groupBy(F.lower("full_name").alias("full_key")).agg(F.max("bioguide_id").alias("by_full"))
    last_map = people.groupBy(last(F.col("full_name")).alias("last_key")).agg(F.min("bioguide_id").alias("by_last"))
    t = trades.withColumn("full_key", F.lower("full_name")).withColumn("last_key", last(F.col("full_name")))
    j = t.join(full_map, "full_key", "left").join(last_map, "last_key", "left")
    return j.withColumn("bioguide_id", F.coalesce("by_full", "by_last")).drop("full_key", "last_key", "by_full", "by_last")


def merge_members(watched: DataFrame, stars: DataFrame) -> DataFrame:
    """Watched and star members in one table, both flags kept; a star alone gets a minimal record."""
    w = watched.select("bioguide_id", F.col("full_name").alias("w_name"), F.col("party").alias("w_party"))
    s = stars.select("bioguide_id", F.col("full_name").alias("s_name"))
    j = w.join(s, "bioguide_id", "full")
    name = F.coalesce("w_name", "s_name")
    parts = F.split(name, r"\s+")
    return j.select("bioguide_id", name.alias("full_name"), F.get(parts, 0).alias("first_name"), F.element_at(parts, -1).alias("last_name"), F.coalesce("w_party", F.lit("I")).alias("party"), F.col("w_name").isNotNull().alias("is_watched"), F.col("s_name").isNotNull().alias("is_star"))


def watched_by_committee(seats: DataFrame, committees: DataFrame, legislators: DataFrame) -> DataFrame:
    """Members with the chair or first minority seat of a watched full committee, or the chair of a subcommittee of one:
    (bioguide_id, full_name, party, chamber, committees).

    ``seats``: bioguide_id, committee_id, title, rank; ``committees``: committee_id, name, parent_id (null: full). An id
    that no committee has is of the watched committee whose id it begins with: ids are cut to their starts, which meet
    by equality. People whom ``legislators`` lacks are skipped."""
    watched = F.lower("name").rlike("|".join(WATCHED_COMMITTEES))
    full = committees.where(F.col("parent_id").isNull() & watched).select(F.col("committee_id").alias("root"))
    subs = committees.where("parent_id is not null").join(full, F.col("parent_id") == F.col("root"), "left_semi")
    known = committees.join(full, F.col("committee_id") == F.col("root"), "left_semi").select("committee_id", "name", F.lit(True).alias("is_full"))
    known = known.unionByName(subs.select("committee_id", "name", F.lit(False).alias("is_full")))
    named = seats.join(known, "committee_id")
    strange = seats.join(committees, "committee_id", "left_anti")
    starts = F.transform(F.sequence(F.lit(1), F.length("committee_id") - 1), lambda i: F.substring("committee_id", F.lit(1), i))
    strange = strange.where(F.length("committee_id") > 1).withColumn("root", F.explode(starts)).join(full, "root", "left_semi").drop("root").distinct()
    j = named.unionByName(strange.select(*seats.columns, F.col("committee_id").alias("name"), F.lit(False).alias("is_full")))
    leads = j.where((F.col("title") == "Chair") | ((F.col("title") == "Ranking Member") & F.col("is_full")))
    each = leads.groupBy("bioguide_id").agg(F.array_sort(F.collect_list(F.struct("committee_id", "name", "title", "rank"))).alias("committees"))
    return legislators.select("bioguide_id", "full_name", "party", "chamber").join(each, "bioguide_id")


def tracked_trades(trades: DataFrame, members: DataFrame, now: Column, days: int) -> DataFrame:
    recent = trades.where(F.col("disclosure_date") >= F.date_sub(now, days))
    return recent.join(members.select("bioguide_id"), "bioguide_id", "left_semi")


def tracked_views(trades: DataFrame, members: DataFrame, views: dict[str, str], days: int) -> DataFrame:
    """Trades of the last days by members, a row for each view whose flag the member has, with ``view``: people are matched and
    trades read once for all views. ``trades``: of one row an id; the newest disclosure tells what the last days are."""
    now = trades.agg(F.date_sub(F.max("disclosure_date"), days).alias("__first"))
    recent = trades.join(F.broadcast(now), F.col("disclosure_date") >= F.col("__first")).drop("__first")  # one row
    marks = members.select("bioguide_id", F.array_compact(F.array(*(F.when(F.col(flag), F.lit(name)) for name, flag in views.items()))).alias("__views"))
    return match_people(recent, members).join(marks, "bioguide_id").withColumn("view", F.explode("__views")).drop("__views")


def trade_table(trades: DataFrame) -> DataFrame:
    """Midpoint of the range, and days from trade to disclosure."""
    mid = F.when(F.col("amount_high").isNotNull(), (F.col("amount_low") + F.col("amount_high")) / 2).otherwise(F.col("amount_low"))
    return trades.withColumns({"estimate": mid, "open_ended": F.col("amount_high").isNull() & F.col("amount_low").isNotNull(), "lag_days": F.datediff("disclosure_date", "transaction_date").cast("long")})
