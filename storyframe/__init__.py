"""storyframe: a PySpark-native engine for long-form text."""
