"""proofloom: curation and evaluation of generated formal-proof data sets on Spark.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns).  The heavy lifting is done by Catalyst-planned built-in expressions;
Python runs only inside the two pluggable batch stages (model call and
checker), which are Arrow-batched ``mapInPandas`` functions.
"""

__version__ = "0.1.0"
