"""Print the executed plan of registered queries.

usage: python scripts/show_plan.py SF_DIR query [query ...]
"""

import os
import sys

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from registry.all import QUERIES  # noqa: E402

spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:]:
    print(f"=== {name}")
    QUERIES[name](spark, sys.argv[1]).explain("simple")
spark.stop()
