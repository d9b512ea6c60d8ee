"""PySpark-native analytics over multi-channel volumetric tables."""
