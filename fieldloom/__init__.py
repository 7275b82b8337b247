"""fieldloom: a PySpark engine for schemaless JSON records."""
