"""Column functions. All are native expressions, save stemming, which is a Pandas UDF."""
