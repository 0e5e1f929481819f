"""Nested documents to flat tables: legislators, committees and seats; configuration in its shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEGISLATORS = "id struct<bioguide:string>, name struct<first:string,last:string>, bio struct<party:string,state:string>, terms array<struct<type:string>>"
COMMITTEES = "thomas_id string, id string, name string, subcommittees array<struct<thomas_id:string,name:string>>"
SEATS = "committee string, members array<struct<bioguide:string,bioguide_id:string,title:string,rank:int>>"
FUNDS = "sector string, entries array<string>"
THEMES = "id string, display_name string, description string, stage string, speculative boolean, tickers array<string>"
NOTES = "ticker string, catalyst string, red_flag string"
COMPANIES = "ticker string, name string"
SUBREDDITS = "ticker string, subreddits string, details array<struct<name:string,source:string,added:string,subscribers:long,note:string>>"
STARS = "bioguide_id string, name string, note string"


def read_legislators(spark: SparkSession, path: str) -> DataFrame:
    """(bioguide_id, full_name, first_name, last_name, party, state, chamber); the last term decides the chamber."""
    d = spark.read.schema(LEGISLATORS).json(path).where(F.coalesce("id.bioguide", F.lit("")) != "")
    first, last = F.coalesce("name.first", F.lit("")), F.coalesce("name.last", F.lit(""))
    kind = F.when(F.size("terms") > 0, F.element_at("terms", -1)["type"])
    return d.select(
        F.col("id.bioguide").alias("bioguide_id"), F.trim(F.concat_ws(" ", first, last)).alias("full_name"), first.alias("first_name"), last.alias("last_name"),
        F.coalesce("bio.party", F.lit("I")).alias("party"), F.coalesce("bio.state", F.lit("")).alias("state"),
        F.when(kind == "sen", "senate").when(kind == "rep", "house").otherwise("unknown").alias("chamber"),
    )


def read_committees(spark: SparkSession, path: str) -> DataFrame:
    """(committee_id, name, parent_id): a subcommittee's id is its parent's with its own after it; full ones have no parent."""
    c = spark.read.schema(COMMITTEES).json(path).select(F.coalesce("thomas_id", "id").alias("committee_id"), F.coalesce("name", F.lit("")).alias("name"), "subcommittees")
    c = c.where(F.coalesce("committee_id", F.lit("")) != "")
    subs = c.select(F.col("committee_id").alias("parent_id"), F.col("name").alias("parent"), F.explode("subcommittees").alias("s")).where(F.coalesce("s.thomas_id", F.lit("")) != "")
    subs = subs.select(F.concat("parent_id", "s.thomas_id").alias("committee_id"), F.coalesce("s.name", F.concat("parent", F.lit(" Subcommittee"))).alias("name"), "parent_id")
    return c.select("committee_id", "name", F.lit(None).cast("string").alias("parent_id")).unionByName(subs)


def read_seats(spark: SparkSession, path: str) -> DataFrame:
    """(bioguide_id, committee_id, title, rank)."""
    s = spark.read.schema(SEATS).json(path).select(F.col("committee").alias("committee_id"), F.explode("members").alias("m"))
    s = s.select(F.coalesce("m.bioguide", "m.bioguide_id").alias("bioguide_id"), "committee_id", F.coalesce("m.title", F.lit("")).alias("title"), "m.rank")
    return s.where(F.coalesce("bioguide_id", F.lit("")) != "")


def read_funds(spark: SparkSession, path: str) -> DataFrame:
    """(sector, tickers): entries are tickers or objects that hold one; other entries are skipped, a sector may be empty."""
    f = spark.read.schema(FUNDS).json(path)
    found = F.transform("entries", lambda e: F.upper(F.when(F.startswith(e, F.lit("{")), F.get_json_object(e, "$.ticker")).otherwise(e)))
    return f.select("sector", F.coalesce(F.array_compact(found), F.array().cast("array<string>")).alias("tickers"))


def read_stars(spark: SparkSession, path: str) -> DataFrame:
    """(bioguide_id, name, note): entries without an id are skipped."""
    s = spark.read.schema(STARS).json(path).where(F.coalesce("bioguide_id", F.lit("")) != "")
    return s.select("bioguide_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("note", F.lit("")).alias("note"))


def read_themes(spark: SparkSession, path: str) -> DataFrame:
    """(sector, display_name, description, stage, speculative, tickers): tickers in capitals, once each; themes without an id are skipped."""
    t = spark.read.schema(THEMES).json(path).where(F.coalesce("id", F.lit("")) != "")
    tickers = F.array_distinct(F.transform(F.array_compact(F.coalesce("tickers", F.array().cast("array<string>"))), lambda x: F.upper(x)))
    return t.select(F.col("id").alias("sector"), "display_name", "description", "stage", F.coalesce("speculative", F.lit(False)).alias("speculative"), tickers.alias("tickers"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, catalyst, red_flag): entries whose ticker isn't in capitals are skipped; empty texts, nan and none are null."""
    said = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.trim(c)).alias(c)
    return spark.read.schema(NOTES).json(path).where("ticker = upper(ticker)").select("ticker", said("catalyst"), said("red_flag"))


def read_company_names(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name): tickers in capitals; entries without a name are skipped."""
    c = spark.read.schema(COMPANIES).json(path).select(F.upper("ticker").alias("ticker"), F.trim("name").alias("name"))
    return c.where("coalesce(ticker, '') != '' and coalesce(name, '') != ''")


def read_subreddit_map(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name, place, source, added, subscribers, note), ticker null for the general list.

    An entry's names are taken once without regard to case, in their order; an entry whose names aren't a list is skipped. Details are
    told by name; a source that isn't manual or resolved is null."""
    m = spark.read.schema(SUBREDDITS).json(path).withColumn("names", F.from_json("subreddits", "array<string>"))
    m = m.where(F.startswith(F.trim("subreddits"), F.lit("["))).select(F.upper("ticker").alias("ticker"), "details", F.filter("names", lambda x: F.coalesce(x, F.lit("")) != "").alias("names"))
    low = F.transform("names", lambda x: F.lower(x))
    each = m.select("ticker", "details", F.posexplode(F.filter("names", lambda x, i: F.array_position(low, F.lower(x)) == i + 1)).alias("place", "name"))
    detail = F.get(F.filter("details", lambda d: F.lower(d["name"]) == F.lower(F.col("name"))), 0)
    j = each.select("ticker", "name", "place", detail.alias("d"))
    return j.select("ticker", "name", "place", F.when(F.col("d.source").isin("manual", "resolved"), F.col("d.source")).alias("source"), "d.added", "d.subscribers", "d.note")
