"""Operators for preparing training text at scale.

Nothing outside this package imports it.  ``queries()`` and ``oracle_sql()`` of
:mod:`clausemill.llm.registry` are picked up by ``__spark_entry__.py`` when the
package is present.
"""
