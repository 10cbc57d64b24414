"""stormcell: hourly city weather and class/work suspension analytics on Spark.

Every public function takes and returns Spark DataFrames; the heavy work is
expressed with built-in DataFrame / SQL operators so Catalyst can push filters
and prune columns, and nothing is pulled to the driver except fitted scalars
and dimension-sized tables whose size is checked first.
"""

__version__ = "0.1.0"
