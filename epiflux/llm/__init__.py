"""Operators for training-data pipelines: queries and SQL are in ``epiflux.llm.queries``."""


def load_all():
    """``(queries, oracles)`` of this subpackage."""
    from epiflux.llm import queries

    return queries.QUERIES, queries.ORACLES
