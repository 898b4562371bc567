"""The whole audit of a page corpus as one job.

HTML is the wide column, so it is read once: features go to a table, and everything
else reads that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagewarden.operators import extract, findings, inventory, links, page_health, site
from pagewarden.sources import sinks


def store_features(pages: DataFrame, folder: str) -> DataFrame:
    """Extract once, write, read back."""
    place = f"{folder}/page_features"
    extract.page_features(pages).write.mode("overwrite").parquet(place)
    return pages.sparkSession.read.parquet(place)


def audit_tables(features: DataFrame, link_status: DataFrame) -> dict[str, DataFrame]:
    """All page and site tables on stored features."""
    edges = extract.edges(features)
    audited = findings.page_audit(features)
    issues = page_health.page_issues(features)
    broken = links.broken_summary(links.checked_links(edges, link_status))
    summary = site.site_summary(features)
    return {
        "findings": findings.findings(audited),
        "page_scores": page_health.page_scores(features),
        "page_summaries": page_health.page_summary(features),
        "inventory": inventory.inventory(features),
        "issues": issues,
        "issue_matrix": site.issue_matrix(issues),
        "issue_pages": site.issue_pages(issues),
        "coverage": site.coverage(features),
        "site_scores": site.site_scores(features, broken),
        "site_summary": summary,
        "site_summary_table": site.summary_table(summary),
        "internal_linking": links.internal_linking(features),
        "outbound_profile": links.outbound_profile(features),
        "domain_authority": site.domain_authority(features),
        "broken_links": broken,
        "word_counts": site.word_count_table(features),
        "external_domains": site.distinct_values(features, "external_domains", "domain"),
        "external_domain_report": site.external_domain_report(features),
    }


def run(pages: DataFrame, link_status: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Extract, audit and write every table below ``folder``."""
    tables = audit_tables(store_features(pages, folder), link_status)
    sinks.write_report_tables(tables, folder)
    return {name: pages.sparkSession.read.parquet(f"{folder}/{name}") for name in tables}
