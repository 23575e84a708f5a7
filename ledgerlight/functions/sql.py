"""Functions and table functions for ad-hoc SQL, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import values as V

SCALARS = {
    "normalize_label(value STRING) RETURNS STRING": f"""
        CASE WHEN lower(trim(regexp_replace(replace(coalesce(value, ''), chr(160), ' '), '\\\\s+', ' '))) = '{V.POOLED.lower()}' THEN '{V.POOLED}'
             ELSE trim(regexp_replace(replace(coalesce(value, ''), chr(160), ' '), '\\\\s+', ' ')) END""",
    "bucket_label(value STRING) RETURNS STRING": f"CASE WHEN lower(value) = '{V.POOLED_REFUND.lower()}' THEN '{V.POOLED}' ELSE value END",
    "identity_label(value STRING) RETURNS STRING": "lower(regexp_replace(trim(value), '\\\\s+', ' '))",
    "district_era(year INT) RETURNS STRING": "CASE WHEN year < 2012 THEN '2002-2010' WHEN year < 2022 THEN '2012-2020' ELSE '2022-' END",
    "cycle_of(day DATE) RETURNS INT": "year(day) + year(day) % 2 + CASE WHEN month(day) = 12 AND year(day) % 2 = 0 THEN 2 ELSE 0 END",
    "is_cash_gift(tran_type STRING, sub_type STRING) RETURNS BOOLEAN": "tran_type = 'C' AND NOT coalesce(sub_type, '') IN (" + ", ".join(f"'{s}'" for s in V.IN_KIND) + ")",
}
#: Over the views ``transactions`` (filer_id, tran_date, amount, tran_type, sub_type, ...) and ``identity`` (donor_id, entity_id).
TABLES = {
    "daily_contributions(first DATE, last DATE) RETURNS TABLE (tran_date DATE, total DECIMAL(18,2), gifts BIGINT)": """
        SELECT t.tran_date, CAST(sum(t.amount) AS DECIMAL(18,2)), count(*) FROM transactions t
        WHERE is_cash_gift(t.tran_type, t.sub_type) AND t.tran_date BETWEEN daily_contributions.first AND daily_contributions.last GROUP BY t.tran_date""",
    "donor_group(donor STRING) RETURNS TABLE (donor_id STRING)": """
        SELECT i.donor_id FROM identity i JOIN identity j ON i.entity_id = j.entity_id WHERE j.donor_id = donor_group.donor""",
}
#: Over these (with filer, donor_id, contributor_payee, book_type, tran_id) and the views ``donors`` (donor_id, display_name, total_given, gift_count)
#: and ``donor_names`` (donor_id, raw_name). An empty text or a null disables a condition.
SEARCHES = {
    """search_transactions(filer STRING, payee STRING, donor STRING, kind STRING, book STRING, first DATE, last DATE, least DECIMAL(18,2), most DECIMAL(18,2))
    RETURNS TABLE (tran_date DATE, tran_type STRING, amount DECIMAL(18,2), filer STRING, contributor_payee STRING, book_type STRING, tran_id BIGINT)""": """
        SELECT t.tran_date, t.tran_type, t.amount, t.filer, t.contributor_payee, t.book_type, t.tran_id FROM transactions t
        WHERE (search_transactions.filer = '' OR t.filer ILIKE concat('%', search_transactions.filer, '%'))
          AND (search_transactions.donor <> '' OR search_transactions.payee = '' OR t.contributor_payee ILIKE concat('%', search_transactions.payee, '%'))
          AND (search_transactions.donor = '' OR t.donor_id = search_transactions.donor)
          AND (search_transactions.kind = '' OR t.tran_type = search_transactions.kind) AND (search_transactions.book = '' OR t.book_type = search_transactions.book)
          AND (search_transactions.first IS NULL OR t.tran_date >= search_transactions.first) AND (search_transactions.last IS NULL OR t.tran_date <= search_transactions.last)
          AND (search_transactions.least IS NULL OR t.amount >= search_transactions.least) AND (search_transactions.most IS NULL OR t.amount <= search_transactions.most)""",
    "search_donors(term STRING, most INT) RETURNS TABLE (donor_id STRING, display_name STRING, total_given DECIMAL(18,2), gift_count BIGINT, matched_alias STRING)": """
        WITH hits AS (
          SELECT d.donor_id, CAST(NULL AS STRING) AS alias FROM donors d WHERE length(trim(search_donors.term)) >= 2 AND d.display_name ILIKE concat('%', trim(search_donors.term), '%')
          UNION SELECT a.donor_id, a.raw_name FROM donor_names a WHERE length(trim(search_donors.term)) >= 2 AND a.raw_name ILIKE concat('%', trim(search_donors.term), '%')),
        found AS (SELECT coalesce(i.entity_id, h.donor_id) AS id, min(h.alias) AS alias FROM hits h LEFT JOIN identity i ON i.donor_id = h.donor_id GROUP BY 1),
        sums AS (SELECT f.id, f.alias, sum(d.total_given) AS given, sum(d.gift_count) AS gifts FROM donors d LEFT JOIN identity i ON i.donor_id = d.donor_id JOIN found f ON f.id = coalesce(i.entity_id, d.donor_id) GROUP BY 1, 2),
        ranked AS (SELECT s.id, d.display_name, s.given, s.gifts, s.alias, row_number() OVER (ORDER BY s.given DESC NULLS LAST, s.id) AS n FROM sums s JOIN donors d ON d.donor_id = s.id)
        SELECT id, display_name, CAST(given AS DECIMAL(18,2)), CAST(gifts AS BIGINT), alias FROM ranked WHERE n <= greatest(1, least(coalesce(search_donors.most, 12), 50))""",
    "first_gifts(donors ARRAY<STRING>, filers ARRAY<STRING>, through DATE) RETURNS TABLE (donor_id STRING, filer_id STRING, first_date DATE, amount DECIMAL(18,2))": """
        WITH asked AS (SELECT DISTINCT coalesce(i.entity_id, x.id) AS id FROM (SELECT explode(first_gifts.donors) AS id) x LEFT JOIN identity i ON i.donor_id = x.id),
        gifts AS (
          SELECT coalesce(i.entity_id, t.donor_id) AS donor_id, t.filer_id, t.tran_date, t.amount, t.tran_id FROM transactions t LEFT JOIN identity i ON i.donor_id = t.donor_id
          WHERE array_contains(first_gifts.filers, t.filer_id) AND t.tran_date <= first_gifts.through AND t.amount > 0 AND is_cash_gift(t.tran_type, t.sub_type))
        SELECT g.donor_id, g.filer_id, min(g.tran_date), CAST(min_by(g.amount, struct(g.tran_date, g.tran_id)) AS DECIMAL(18,2)) FROM gifts g JOIN asked a ON a.id = g.donor_id GROUP BY 1, 2""",
}


def register(spark: SparkSession, tables: bool = False, searches: bool = False) -> None:
    """Adds the functions to a session; ``tables`` and ``searches`` too, for which the views must be there."""
    for head, body in (SCALARS | (TABLES if tables else {}) | (SEARCHES if searches else {})).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
