"""A PySpark-native engine for open-data catalogs and their tabular datastores."""
