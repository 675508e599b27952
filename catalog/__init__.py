"""Registered queries: the Spark call next to the SQL it must agree with."""
