"""Registered queries over the test tables and the SQL each one must agree with."""

from strayline.suite import points, states, stored

QUERIES = {**points.QUERIES, **states.QUERIES, **stored.QUERIES}
ORACLE = {**points.ORACLE, **states.ORACLE, **stored.ORACLE}
