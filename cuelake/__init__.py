"""Set-at-a-time transcript retrieval, evaluation and corpus preparation on PySpark."""
