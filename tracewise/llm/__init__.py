"""Training-data operators: dedup, chat formatting, language and quality models, tokenising, mixing.

Nothing else in the library imports this subpackage.  Each operator module holds
the general DataFrame operator; ``queries.py`` registers the thin ``opN_*`` queries.
"""
