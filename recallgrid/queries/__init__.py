"""All queries outside the text subpackage, with their SQL."""

from . import memory, nested_sql, problems, problems_sql, relational, retrieval, surface, upkeep, upkeep_sql

QUERIES = {**problems.QUERIES, **retrieval.QUERIES, **memory.QUERIES, **relational.QUERIES, **surface.QUERIES, **upkeep.QUERIES}
ORACLE: dict[str, str] = {**problems_sql.ORACLE, **nested_sql.ORACLE, **retrieval.ORACLE, **memory.ORACLE, **relational.ORACLE, **surface.ORACLE, **upkeep_sql.ORACLE}
