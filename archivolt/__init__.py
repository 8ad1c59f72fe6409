"""archivolt: a PySpark-native analytics engine for web-capture archives."""
