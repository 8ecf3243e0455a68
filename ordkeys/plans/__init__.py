"""The registered queries of the key-set engine and the SQL that checks them."""

from ordkeys.plans import file_queries  # noqa: F401  adds its queries to those of keyset_queries
from ordkeys.plans.keyset_queries import oracle_sql, queries  # noqa: F401
