"""chorus: opinion analytics as Spark DataFrame plans.

Operators take and return DataFrames; vocabularies (stop words, lexicon,
model families, URL rules) are small DataFrames passed as arguments, so
extending a rule means adding rows, not code.
"""

__version__ = "0.1.0"
