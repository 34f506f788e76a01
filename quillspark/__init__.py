"""Spark-native analytics for collections of submitted long-form writing."""
