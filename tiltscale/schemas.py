"""Row types of the messages and tables."""

from pyspark.sql import types as T

REQUEST_BODY = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
])

ARTICLE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("url", T.StringType()),
])

RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

STORED_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("bias_score", T.DoubleType()),
])

NEWS = T.StructType([
    T.StructField("Link", T.StringType(), False),
    T.StructField("Title", T.StringType()),
    T.StructField("Content", T.StringType()),
    T.StructField("Source", T.StringType()),
    T.StructField("CollectDate", T.DateType()),
])

RATED = T.StructType([
    T.StructField("Link", T.StringType(), False),
    T.StructField("Model", T.StringType()),
    T.StructField("Score", T.IntegerType()),
    T.StructField("Reason", T.StringType()),
])

RESPONSE = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("Link", T.StringType()),
    T.StructField("Score", T.IntegerType()),
    T.StructField("Comments", T.StringType()),
])
