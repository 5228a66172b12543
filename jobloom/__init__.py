"""jobloom: job-posting analytics and corpus preparation on PySpark."""
