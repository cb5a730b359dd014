"""Training-data operators.

Nothing outside this subpackage imports it.  ``registry`` holds the queries and
their oracle SQL; the entry file adds them when the subpackage is present.
"""
