"""Fixed schema of the canonical listing."""

from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("external_id", T.StringType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("company", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
    T.StructField("salary_min", T.LongType(), True),
    T.StructField("salary_max", T.LongType(), True),
    T.StructField("visa_sponsorship", T.BooleanType(), True),
    T.StructField("four_day_week", T.BooleanType(), True),
    T.StructField("remote", T.BooleanType(), True),
    T.StructField("posted_at", T.TimestampNTZType(), True),
    T.StructField("raw", T.StringType(), True),
])

CANONICAL_FIELDS = [f.name for f in CANONICAL.fields]
