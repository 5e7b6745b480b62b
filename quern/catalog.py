"""All queries and their SQL: importing the modules below registers theirs."""

from quern import queries_search, queries_state  # noqa: F401
from quern.queries import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
