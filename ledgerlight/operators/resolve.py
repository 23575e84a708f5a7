"""Donor resolution: exact names first, then similar names inside blocks, then clusters under reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import values as V
from ..functions.fuzzy import name_ratio, token_set_ratio, token_sort_ratio
from ..functions.text import alias_key, blank, committee_eligible, committee_norm, embedded_id, entity_id, norm_addr, norm_employer, norm_name, soundex, zip5
from ..session import ship
from ..store import small
from .graph import components

AUTO, REVIEW = 90.0, 80.0
BLOCK = 200


def contributor_tuples(txn: DataFrame) -> DataFrame:
    """Distinct contributors with their number of rows."""
    keys = ["raw_name", "addr", "city", "state", "zip", "employer", "occupation", "cid", "book_type"]
    return txn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def keyed(tuples: DataFrame) -> DataFrame:
    """Tuples with their normalised name, address, employer, surname block and alias key."""
    out = tuples.withColumns({"nname": norm_name("raw_name"), "akey": norm_addr("addr", "zip"), "emp": norm_employer("employer"), "z5": zip5("zip")})
    surname = F.element_at(F.split("nname", " "), -1)
    return out.withColumns({"alias": alias_key("nname", "akey"), "block": F.concat(soundex(surname), F.lit("|"), F.col("z5"))})


def exact_committees(tuples: DataFrame, committees: DataFrame) -> DataFrame:
    """Each tuple's committee: its own id, else the id in its name, else the only committee of that exact name (guarded)."""
    names = committees.select(norm_name("name").alias("nname"), F.col("filer_id").alias("by_name")).groupBy("nname").agg(F.min("by_name").alias("by_name"), F.countDistinct("by_name").alias("k")).filter("k = 1").drop("k")
    ids = committees.select(F.col("filer_id").alias("by_id")).distinct()
    out = tuples.withColumn("named", embedded_id("raw_name")).join(ids, F.col("named") == F.col("by_id"), "left").join(names, "nname", "left")
    guarded = F.when(committee_eligible("raw_name", "book_type"), F.col("by_name"))
    return out.withColumn("committee", F.coalesce(F.nullif(blank("cid"), F.lit("")), "by_id", guarded)).drop("named", "by_id", "by_name")


def name_edges(rows: DataFrame, key: str = "alias") -> DataFrame:
    """Same name and same zip: each alias to the smallest of them."""
    least = F.min(key).over(W.partitionBy("nname", "z5"))
    return rows.filter("z5 <> ''").withColumn("b", least).filter(F.col(key) != F.col("b")).select(F.col(key).alias("a"), "b").distinct()


def alike(rows: DataFrame, key: str, by: str, carried: list[str], block: int, least: float, also: Column | None = None) -> DataFrame:
    """Every pair of rows of one ``by`` whose ``nname`` scores ``least`` or more (or for which ``also`` holds), in columns with _a and _b; ``key`` orders the pair.

    A group of more than ``block`` rows is dealt into parts, and each two parts (and each with itself) are compared as one tile, so no
    task gets a whole group. The score is the greater of the ratios of sorted words and of word sets. Names that share no word, and repeat none, have the
    same of both; a score of s then needs a common subsequence of s/200 of both lengths, which has no more of any character
    than either name, so such pairs are scored only if their common characters reach it. No pair is lost, whatever the size of its group.
    """
    parts = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_g")).filter("_g > 1")
    rows = rows.join(parts, by, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    rows = rows.withColumn("_i", F.pmod(F.xxhash64(key, "nname", *carried), F.col("_g")).cast("int"))
    # The words in order, as the score has them.
    words = F.array_sort(F.filter(F.split(F.coalesce("nname", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    rows = rows.withColumn("_w", words).withColumn("_t", F.array_join("_w", " ")).withColumn("_l", F.length("_t"))
    rows = rows.withColumn("_r", F.size(F.array_distinct("_w")) < F.size("_w"))
    # Characters with their number so far, so that a set has each as often as the name: a, a1, a2.
    letters = F.array_sort(F.filter(F.split("_t", ""), lambda c: c != ""))
    rows = rows.withColumn("_c", letters).withColumn("_c", F.transform("_c", lambda c, i: F.concat(c, (i - F.array_position("_c", c)).cast("string"))))
    each = F.sequence(F.lit(0), F.col("_g") - 1)
    held = [key, "nname", *carried, "_l", "_c", "_i", "_w", "_r"]
    tiles = F.transform(each, lambda j: F.struct(F.least("_i", j).alias("x"), F.greatest("_i", j).alias("y")))
    rows = rows.withColumn("_tile", F.explode(tiles))
    a, b = (rows.select(by, F.col("_tile.x").alias("_x"), F.col("_tile.y").alias("_y"), *[F.col(c).alias(f"{c}_{x}") for c in held]) for x in "ab")
    lengths = F.least("_l_a", "_l_b") * 200 >= (F.col("_l_a") + F.col("_l_b")) * least
    shared = F.size(F.array_intersect("_c_a", "_c_b")) * 200 >= (F.col("_l_a") + F.col("_l_b")) * least
    able = (lengths & shared) | F.arrays_overlap("_w_a", "_w_b") | F.col("_r_a") | F.col("_r_b")
    able = able if also is None else able | also
    first = F.col(f"{key}_a") < F.col(f"{key}_b")
    a, b = a.alias("a"), b.alias("b")
    met = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    # A pair of one part is compared in that part's own tile only.
    same = ((F.col("_i_a") != F.col("_i_b")) | (F.col("a._x") == F.col("a._y"))) & first & able
    pairs = a.join(b, met & same).select(f"a.{by}", *[f"{c}_{x}" for x in "ab" for c in held if not c.startswith("_")])
    enough = F.col("score") >= least
    return pairs.withColumn("score", name_ratio("nname_a", "nname_b")).filter(enough if also is None else enough | also)


def _changed_name() -> Column:
    """Same address, same first name, another surname."""
    first, last = (tuple(F.element_at(F.split(f"nname_{x}", " "), k) for x in "ab") for k in (1, -1))
    return (F.col("akey_a") != "") & (F.col("akey_a") == F.col("akey_b")) & (first[0] != "") & (first[0] == first[1]) & (last[0] != last[1])


def similar_pairs(rows: DataFrame, key: str = "alias", block: int = BLOCK, least: float = REVIEW) -> DataFrame:
    """All pairs of one block (surname's sound and zip; rows without a zip are in none) with other names that are similar, or whose surname may have
    changed, scored; large blocks are compared in tiles.
    """
    ship(rows.sparkSession)
    names = rows.filter(~F.col("block").endswith("|")).select("block", key, "nname", "akey", "emp").distinct()
    return alike(names, key, "block", ["akey", "emp"], block, least, _changed_name()).filter("nname_a <> nname_b")


def constrained(pairs: DataFrame, decisions: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs without those decided separate; only the pair itself is barred, not what chains may join."""
    apart = decisions.filter("decision = 'separate'").select(F.least("name_a", "name_b").alias("_x"), F.greatest("name_a", "name_b").alias("_y"))
    return pairs.join(apart, (F.least(a, b) == F.col("_x")) & (F.greatest(a, b) == F.col("_y")), "left_anti")


def verdicts(pairs: DataFrame, auto: float = AUTO) -> DataFrame:
    """auto, or the class under which a reviewer sees the pair: same_address, name_only, possible_name_change; null for a pair that nobody has to see."""
    address = (F.col("akey_a") == F.col("akey_b")) & (F.col("akey_a") != "")
    employer = (F.col("emp_a") == F.col("emp_b")) & (F.col("emp_a") != "")
    strong = F.col("score") >= auto
    verdict = F.when(strong & (address | employer), "auto").when((F.col("score") >= REVIEW) & ~strong & address, "same_address").when(strong, "name_only").when(_changed_name(), "possible_name_change")
    return pairs.withColumn("verdict", verdict)


def clusters(rows: DataFrame, decisions: DataFrame | None = None, auto: float = AUTO) -> DataFrame:
    """(alias, entity_id): aliases joined by same name and zip, by similar names with address or employer, and by reviewers."""
    pairs = verdicts(similar_pairs(rows), auto).filter("verdict = 'auto'")
    edges = name_edges(rows).unionByName(pairs.select(F.col("alias_a").alias("a"), F.col("alias_b").alias("b")))
    if decisions is not None:
        edges = constrained(edges, decisions, "a", "b").select("a", "b")
        edges = edges.unionByName(decisions.filter("decision = 'merge'").select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    found = components(edges)
    return rows.select("alias").distinct().join(found, F.col("alias") == F.col("node"), "left").select("alias", entity_id(F.coalesce("root", "alias")).alias("entity_id"))


def review_queue(pairs: DataFrame, limit: int = V.REVIEW_ROWS) -> DataFrame:
    """What reviewers see: the best scored first."""
    return pairs.filter("verdict <> 'auto'").orderBy(F.desc("score"), "alias_a", "alias_b").limit(limit)


def committee_suggestions(tuples: DataFrame, committees: DataFrame, least: float = 88.0, first: int | None = 50) -> DataFrame:
    """Names that may be a committee's under another spelling: the first hit among the ``first`` candidates (None: all) of the same first word."""
    ship(tuples.sparkSession)
    names = committees.select(committee_norm("name").alias("cname"), "filer_id").withColumn("word", F.get(F.split("cname", " "), F.lit(0)))
    names = names.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("cname", "filer_id")))
    names = names if first is None else names.filter(F.col("place") <= first)
    rows = tuples.filter(committee_eligible("raw_name", "book_type") & (F.col("n") >= 5)).withColumn("dname", committee_norm("raw_name")).withColumn("word", F.get(F.split("dname", " "), F.lit(0)))
    hits = rows.select("raw_name", "dname", "word").distinct().join(small(names), "word").withColumn("score", token_sort_ratio("dname", "cname"))
    hits = hits.filter((F.col("score") >= least) & (F.col("score") < 100))
    return hits.withColumn("_n", F.row_number().over(W.partitionBy("raw_name").orderBy("place"))).filter("_n = 1").select("raw_name", "filer_id", "cname", "score")


def frequent_name_matches(txn: DataFrame, name: str, limit: int | None = 10_000, least: float = REVIEW, matches: int = 10) -> DataFrame:
    """Similar pairs among the most frequent names, ten best of each; names meet those that share a word, however common.

    The most frequent names are a stated top-k; with ``limit`` None all names take part. Names that share no word (each word spelt differently) are not compared.
    """
    ship(txn.sparkSession)
    top = txn.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    top = top if limit is None else top.orderBy(F.desc("n"), "name").limit(limit)
    words = top.withColumn("nname", norm_name("name")).withColumn("word", F.explode(F.array_distinct(F.split("nname", " "))))
    pairs = alike(words, "name", "word", ["n"], BLOCK, least).drop("word").distinct().filter("name_a <> name_b")
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy("name_a").orderBy(F.desc("score"), "name_b"))).filter(F.col("_n") <= matches).drop("_n")


def most_common_name(rows: DataFrame, key: str = "entity_id", name: str = "raw_name", n: str = "n") -> DataFrame:
    sums = rows.groupBy(key, name).agg(F.sum(n).alias("n"))
    return sums.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias("name"))


def stamp(txn: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows with the donor of their raw name, address and zip (null as ''); a committee's id wins over any name."""
    keys = ["raw_name", "addr", "zip"]
    named = aliases.select(*[blank(c).alias(f"_{c}") for c in keys], F.col("entity_id").alias("_entity")).dropDuplicates([f"_{c}" for c in keys])
    on = [blank(c) == F.col(f"_{c}") for c in keys]
    out = txn.join(named, on, "left")
    return out.withColumn("donor_id", F.when(blank("cid") != "", F.concat(F.lit("c"), "cid")).otherwise(F.col("_entity"))).drop("_entity", *[f"_{c}" for c in keys])


def assign_new(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """New rows' entities: the alias's, else a provisional one made of the alias."""
    known = aliases.select(F.col("alias"), F.col("entity_id").alias("_known"))
    return rows.join(known, "alias", "left").withColumn("entity_id", F.coalesce("_known", entity_id("alias"))).drop("_known")


def candidate_links(people: DataFrame, committees: DataFrame, key: Column) -> DataFrame:
    """People beside their own candidate committees: related, never merged."""
    named = committees.filter("candidate_name is not null").select(norm_name("candidate_name").alias("_k"), F.col("slug").alias("related_filer_slug"))
    return people.withColumn("_k", key).join(small(named), "_k", "left").drop("_k")


def search(donors: DataFrame, aliases: DataFrame, identity: DataFrame, term: str, limit: int = 12) -> DataFrame:
    """Entities whose name or alias holds a term, with the group's totals and the smallest alias that matched."""
    like = f"%{term}%"
    hits = donors.filter(F.col("display_name").ilike(like)).select("donor_id", F.lit(None).cast("string").alias("alias")).unionByName(aliases.filter(F.col("raw_name").ilike(like)).select("donor_id", F.col("raw_name").alias("alias")))
    groups = hits.join(identity, "donor_id", "left").groupBy(F.coalesce("entity_id", "donor_id").alias("entity_id")).agg(F.min("alias").alias("matched_alias"))
    sums = donors.join(identity, "donor_id", "left").withColumn("entity_id", F.coalesce("entity_id", "donor_id")).join(groups, "entity_id")
    out = sums.groupBy("entity_id", "matched_alias").agg(F.sum("total_given").alias("total_given"), F.sum("gift_count").alias("gift_count"), F.max_by("display_name", F.col("donor_id") == F.col("entity_id")).alias("display_name"))
    return out.orderBy(F.desc("total_given"), "entity_id").limit(max(1, min(50, limit)))


def match_committee_donors(donors: DataFrame, committees: DataFrame) -> DataFrame:
    """Donors that are committees: exact lower name, then normalised, then the id in the name; a name of several committees is ambiguous."""
    by_lower = committees.groupBy(F.lower("name").alias("k")).agg(F.min("filer_id").alias("f1"), F.countDistinct("filer_id").alias("n1"))
    by_norm = committees.groupBy(committee_norm("name").alias("k")).agg(F.min("filer_id").alias("f2"), F.countDistinct("filer_id").alias("n2"))
    by_id = committees.select(F.col("filer_id").cast("string").alias("k"), F.col("filer_id").alias("f3")).distinct()
    out = donors.join(by_lower.withColumnRenamed("k", "_l"), F.lower("name") == F.col("_l"), "left").join(by_norm.withColumnRenamed("k", "_m"), committee_norm("name") == F.col("_m"), "left")
    out = out.join(by_id.withColumnRenamed("k", "_i"), embedded_id("name") == F.col("_i"), "left")
    tier = F.when(F.col("n1") == 1, "exact").when(F.col("n2") == 1, "normalised").when(F.col("f3").isNotNull(), "id").when((F.col("n1") > 1) | (F.col("n2") > 1), "ambiguous")
    filer = F.when(F.col("n1") == 1, F.col("f1")).when(F.col("n2") == 1, F.col("f2")).otherwise(F.col("f3"))
    return out.select("name", tier.alias("tier"), F.when(tier != "ambiguous", filer).alias("filer_id"))


def set_matches(a: DataFrame, b: DataFrame, key: str, name_a: str, name_b: str, least: float) -> DataFrame:
    """Pairs of one key whose word sets are alike, the best of each left name."""
    ship(a.sparkSession)
    pairs = a.join(b, key).withColumn("score", token_set_ratio(name_a, name_b)).filter(F.col("score") >= least)
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy(key, name_a).orderBy(F.desc("score"), name_b))).filter("_n = 1").drop("_n")
