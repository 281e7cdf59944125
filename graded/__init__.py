"""graded: Spark-native labelling, resampling and evaluation engine.

Corpora are DataFrames with an explicit ``example_id``; every operator takes
and returns DataFrames or Columns, never collects rows, and names its keys.
"""

__version__ = "0.1.0"
