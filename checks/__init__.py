"""Queries over the given tables with their oracles."""


def load_all() -> None:
    from checks import io_queries, local_queries, page_queries, site_queries  # noqa: F401
