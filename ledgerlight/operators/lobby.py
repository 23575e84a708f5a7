"""Paths between donors and lobbyists: direct links, and links by way of a client that both share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_by


def paths(links: DataFrame, client_links: DataFrame, clients: DataFrame) -> DataFrame:
    """One row per donor and lobbyist: donor_id, lobbyist_id, confirmed, score, clients.

    ``links``: donor_id, lobbyist_id, status, score. ``client_links``: donor_id, client_key, client_name, status, score,
    decided_at; a donor's best link to each client counts, unless it is rejected. ``clients``: client_key, lobbyist_id,
    is_lead, active. A client's lead lobbyists count, all its active ones if it has no lead. A pair that was rejected
    directly has no path.
    """
    best = first_by(
        client_links, ["donor_id", "client_key"], [F.asc(F.col("status") == "rejected"), F.desc(F.col("status") == "confirmed"), F.desc_nulls_last("decided_at"), F.desc_nulls_last("score"), F.asc("client_name")]
    ).filter("status <> 'rejected'")
    active = clients.filter("active")
    leads = active.filter("is_lead")
    others = active.join(leads.select("client_key").distinct(), "client_key", "left_anti")
    counted = leads.unionByName(others).select("client_key", "lobbyist_id")
    direct = links.filter("status <> 'rejected'").select("donor_id", "lobbyist_id", (F.col("status") == "confirmed").alias("confirmed"), "score", F.lit(None).cast("string").alias("client"))
    through = best.join(counted, "client_key").select("donor_id", "lobbyist_id", (F.col("status") == "confirmed").alias("confirmed"), "score", F.col("client_name").alias("client"))
    rejected = links.filter("status = 'rejected'").select("donor_id", "lobbyist_id").distinct()
    rows = direct.unionByName(through).join(rejected, ["donor_id", "lobbyist_id"], "left_anti")
    return rows.groupBy("donor_id", "lobbyist_id").agg(F.bool_or("confirmed").alias("confirmed"), F.max("score").alias("score"), F.array_sort(F.collect_set("client")).alias("clients"))
