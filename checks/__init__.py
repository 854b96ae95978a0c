"""Queries over the test tables, each with the SQL that has to give the same rows."""


def all_checks():
    """(queries, oracles) of all check modules."""
    from checks import base, feed, ingest, scoring, search, sources, stored, values  # noqa: F401

    return base.QUERIES, base.ORACLES
