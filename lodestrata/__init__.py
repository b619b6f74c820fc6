"""lodestrata: a Spark-native batch analytics engine (DataFrame / SQL / pyspark.ml)."""
