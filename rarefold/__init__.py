"""rarefold: rare-event (imbalanced binary) analytics as Spark DataFrame operators.

Every operator is a function from DataFrame(s) to DataFrame; fitted steps return a
small model object whose state is itself a set of DataFrames (metadata tables).
"""

__version__ = "0.1.0"
