"""linkloom: a PySpark-native engine for link, temporal, money-flow and text analytics."""
