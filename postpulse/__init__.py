"""Spark-native analytics for open job-posting corpora.

Every public function takes and returns DataFrames (or Columns) and is
lazy: nothing here collects corpus-sized data to the driver.
"""
