"""hexflow: a PySpark-native engine for geo-mobility event analytics and training-data processing."""
