"""revisit: repeated-visit (readmission) analytics as Spark DataFrame operators.

Sub-packages
------------
sources    table bindings, CSV / JSON / model I/O
functions  scalar column expressions (dates, bins, labels, recodes)
operators  relational, journey, profiling, set and ordering operators
ml         feature preparation, model training, scoring and evaluation
plans      the end-to-end cohort pipeline and the query catalog
streaming  Structured Streaming scoring
"""

__version__ = "0.1.0"
