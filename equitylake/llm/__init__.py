"""Training-data operators: ten corpus jobs on Spark DataFrames.

Nothing else in the library imports this package; ``queries.py`` registers
one query per operator. Each operator keeps a general interface in its own
module, the registered query derives its digest columns from that.
"""
