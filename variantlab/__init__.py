"""A PySpark-native engine for grouped, labelled sample tables and protein-variant effect data."""
