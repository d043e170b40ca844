"""lodegraph: a PySpark-native engine for evidence graphs and question plans."""
