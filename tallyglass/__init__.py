"""tallyglass: a PySpark-native analytics engine for labelled metrics and traces."""
