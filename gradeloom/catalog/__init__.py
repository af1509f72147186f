"""Every operator as a named query over the parquet tables."""


def all_queries():
    """(queries, checks), filled by importing the catalog modules."""
    from gradeloom.catalog import registry
    from gradeloom.catalog import (  # noqa: F401
        scores, attempts, conversations, search, traces, generation, files, progress, judging, chains,
    )

    return registry.QUERIES, registry.ORACLES
