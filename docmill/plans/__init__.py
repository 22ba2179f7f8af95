"""Registered queries and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from docmill.plans import domain, driver, indexes, knowledge, tables

    return driver.QUERIES | domain.QUERIES | tables.QUERIES | knowledge.QUERIES | indexes.QUERIES


def oracle_sql() -> dict[str, str]:
    from docmill.plans import domain, driver, indexes, knowledge, tables

    return driver.SQL | domain.SQL | tables.SQL | knowledge.SQL | indexes.SQL
