"""All queries of the core and their SQL."""

from talliflow.plans import problems, reference

QUERIES = reference.QUERIES | problems.QUERIES
SQL = reference.SQL | problems.SQL
