"""Schemas of the tables that operators hand on."""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("line", T.IntegerType()),  # 0: the document as a whole
    T.StructField("span_start", T.IntegerType()),  # characters from 1, both ends included
    T.StructField("span_end", T.IntegerType()),
    T.StructField("layer", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])

RULE_TOKEN = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("token", T.StringType()),
    T.StructField("replacement", T.StringType()),
])

PAIR = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("axis", T.StringType()),
    T.StructField("observer", T.StringType()),
    T.StructField("performer", T.StringType()),
    T.StructField("note", T.StringType()),
])
