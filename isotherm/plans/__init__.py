"""Reports, and the registry of queries over the given tables."""


def _load():
    from isotherm.plans import (  # noqa: F401
        catalog,
        ingest_queries,
        link_queries,
        panel_queries,
        rollup_queries,
        stream_queries,
        text_queries,
    )

    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
