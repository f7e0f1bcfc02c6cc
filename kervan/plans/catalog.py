"""Registered queries and their reference SQL."""

from . import extraction, jobs, offers, web

QUERIES: dict = {**web.QUERIES, **extraction.QUERIES, **offers.QUERIES, **jobs.QUERIES}
ORACLE: dict = {**web.ORACLE, **extraction.ORACLE, **offers.ORACLE, **jobs.ORACLE}
