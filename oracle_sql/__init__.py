"""Reference SQL for the registered queries, written apart from the library.

Only the derivation of the input cases (plain arithmetic on the given tables) is
shared with the library; rules, limits and weights are spelled out again here.
"""
