"""latticework: a PySpark engine for databases of atomistic structures and their run records."""
