"""Training-data pipeline operators.

Nothing outside this package imports it; ``queries.py`` holds the thin ``opN_*`` queries.
"""
