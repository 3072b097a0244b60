"""webloom: Spark-native collection, keyed-table, web-page and search analytics."""
