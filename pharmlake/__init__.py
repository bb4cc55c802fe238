"""pharmlake: compound preparation, instruction text and evaluation metrics on Spark.

Every operator is a DataFrame -> DataFrame or Column -> Column function built
from pyspark.sql expressions, windows, aggregates and joins, so Catalyst can
push filters and prune columns down to the scan.
"""

__version__ = "0.1.0"
