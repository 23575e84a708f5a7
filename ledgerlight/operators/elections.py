"""Race margins, candidates and their committees, and race totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import district_era
from ..functions.money import MONEY, margin_points
from ..functions.text import candidate_key, historical_key, nickname_key, norm_district
from .ranking import top_n
from .resolve import set_matches


def race_margins(results: DataFrame) -> DataFrame:
    """Winner, runner-up and margin of each general contest; write-ins and measures left out; a district may be null.

    Margins are points of all votes, null without votes; a contest of one is unopposed. Equal votes go by name.
    """
    rows = results.filter((F.col("election_type") == "general") & ~F.coalesce(F.col("is_measure"), F.lit(False)) & ~F.lower("candidate").like("%write-in%"))
    race = ["year", "office", "district"]
    rank = F.row_number().over(W.partitionBy(*race).orderBy(F.desc_nulls_last("votes"), "candidate"))
    rows = rows.withColumns({"rank": rank, "of": F.sum("votes").over(W.partitionBy(*race)), "n": F.count(F.lit(1)).over(W.partitionBy(*race))})

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("rank") == k, F.col(c)))

    out = rows.filter("rank <= 2").groupBy(*race).agg(
        at(1, "candidate").alias("winner"), at(2, "candidate").alias("runner_up"), at(1, "votes").alias("winner_votes"), at(2, "votes").alias("runner_up_votes"), F.max("of").alias("votes"), (F.max("n") == 1).alias("unopposed")
    )
    return out.withColumns({"margin": margin_points("winner_votes", "runner_up_votes", "votes"), "era": district_era("year")})


def match_candidates(ballot: DataFrame, committees: DataFrame, overrides: DataFrame | None = None, least: float = 80.0) -> DataFrame:
    """Ballot candidates beside their committee of the same district, by the best tier.

    0 a reviewer's override, 1 same name, 2 same with nicknames in full, 3 all words of one in the other (two at least), 4 similar
    with the same surname, 5 same surname and initial.
    """
    left = ballot.withColumns({"k": candidate_key("ballot_name"), "nick": nickname_key("ballot_name")})
    right = committees.withColumns({"ck": candidate_key("candidate_name"), "cnick": nickname_key("candidate_name")}).select("district", "slug", "ck", "cnick")
    words, cwords = F.split("nick", " "), F.split("cnick", " ")
    common = F.size(F.array_intersect(words, cwords))
    surname = F.element_at(words, -1) == F.element_at(cwords, -1)
    rows = left.join(right, "district")
    inside = (common >= 2) & ((common == F.size(F.array_distinct(words))) | (common == F.size(F.array_distinct(cwords))))
    near = surname & (F.levenshtein("nick", "cnick") * 100 <= (F.length("nick") + F.length("cnick")) * (100 - least) / 2)
    initial = surname & (F.substring("nick", 1, 1) == F.substring("cnick", 1, 1))
    tier = F.when(F.col("k") == F.col("ck"), 1).when(F.col("nick") == F.col("cnick"), 2).when(inside, 3).when(near, 4).when(initial, 5)
    rows = rows.withColumn("tier", tier).filter("tier is not null").select("district", "ballot_name", "slug", "tier")
    if overrides is not None:
        rows = rows.unionByName(overrides.select("district", "ballot_name", "slug", F.lit(0).alias("tier")))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("district", "ballot_name").orderBy("tier", "slug"))).filter("_n = 1").drop("_n")


def match_historical(results: DataFrame, committees: DataFrame) -> DataFrame:
    """Past candidates by word sets: of the district (95), else of the office (95), else of all (the same words)."""
    left = results.select(norm_district("district").alias("district"), "office", "candidate", historical_key("candidate").alias("hk")).distinct()
    right = committees.select(norm_district("district").alias("district"), "office", "slug", historical_key("candidate_name").alias("ck")).distinct()
    one = set_matches(left, right.drop("office"), "district", "hk", "ck", 95.0).select("district", "hk", F.col("slug").alias("s1"))
    two = set_matches(left, right.drop("district"), "office", "hk", "ck", 95.0).select("office", "hk", F.col("slug").alias("s2"))
    three = right.groupBy(F.col("ck").alias("hk")).agg(F.min("slug").alias("s3"))
    out = left.join(one, ["district", "hk"], "left").join(two, ["office", "hk"], "left").join(three, "hk", "left")
    return out.withColumn("slug", F.coalesce("s1", "s2", "s3")).select("district", "office", "candidate", "slug")


def race_totals(candidates: DataFrame, money: DataFrame, race: list[str]) -> DataFrame:
    """Raised in each race, candidates matched and in all."""
    rows = candidates.join(money, "slug", "left")
    return rows.groupBy(*race).agg(
        F.coalesce(F.sum("raised"), F.lit(0)).cast(MONEY).alias("raised"), F.count("slug").alias("matched"), F.count(F.lit(1)).alias("candidates")
    )


def contested(totals: DataFrame, tier: str, others: int = 5, least: int = 2) -> DataFrame:
    """Races of two candidates or more: all statewide ones and the largest others."""
    rows = totals.filter(F.col("candidates") >= least)
    return rows.filter(F.col(tier) == "statewide").withColumn("rank", F.lit(None).cast("int")).unionByName(top_n(rows.filter(F.col(tier) != "statewide"), others, [F.desc("raised"), F.asc("race")]))


def races_to_watch(rows: DataFrame, races: int = 6, candidates: int = 4) -> DataFrame:
    """The races with most money, and the leading candidates of each."""
    sums = rows.groupBy("race").agg(F.sum("raised").cast(MONEY).alias("race_total"))
    best = top_n(sums, races, [F.desc("race_total"), F.asc("race")], rank="race_rank")
    return top_n(rows.join(best, "race"), candidates, [F.desc("raised"), F.asc("candidate")], ["race"])


def party_attribution(explicit: str, nature: str) -> Column:
    """A committee's party: as it says, else by what a caucus committee says of itself."""
    n = F.lower(F.coalesce(F.col(nature), F.lit("")))
    return F.when(F.trim(F.coalesce(F.col(explicit), F.lit(""))) != "", F.col(explicit)).when(n.contains("democrat"), "Democrat").when(n.contains("republican"), "Republican")


def district_history(margins: DataFrame, matched: DataFrame, cycle_money: DataFrame) -> DataFrame:
    """Per year and district: margin, votes, money of the matched candidates in that cycle, candidates matched and in all.

    ``matched``: year, district, candidate, slug (null if none); ``cycle_money``: year, slug, raised.
    """
    sums = matched.join(cycle_money, ["year", "slug"], "left").groupBy("year", "district").agg(
        F.coalesce(F.sum("raised"), F.lit(0)).cast(MONEY).alias("raised"), F.count("slug").alias("matched"), F.count(F.lit(1)).alias("candidates")
    )
    return margins.select("year", "district", "winner", "votes", "margin").join(sums, ["year", "district"], "left")
