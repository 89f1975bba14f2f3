"""memspark: a PySpark-native analytics engine for long-lived agent memory."""
