"""All registered queries of the engine and their oracle SQL."""

from . import access, changes, histories, reads, rules  # noqa: F401  each registers its queries

QUERIES = {**reads.QUERIES}
SQL = {**reads.SQL}
