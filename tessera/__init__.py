"""tessera: profiling, text analytics, retrieval and training-set preparation
for tables, documents and web pages, written as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except bounded, size-checked dictionaries.
"""

__version__ = "0.1.0"
