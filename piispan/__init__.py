"""PySpark-native detection, scoring and redaction of personal data."""
