"""granella: a PySpark-native document and drawing analytics engine."""
