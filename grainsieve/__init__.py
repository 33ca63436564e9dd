"""grainsieve: a PySpark-native engine for verifying packaged-food label claims at scale."""
