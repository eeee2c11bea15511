"""Record types shared by all modules."""

from pyspark.sql import types as T

#: Rows extracted by an older version are not reused.
EXTRACTOR_VERSION = 3

SYMBOL = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("parent", T.StringType()),
    ]
)
IMPORT = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("module", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("local_name", T.StringType()),
        T.StructField("imported_name", T.StringType()),
        T.StructField("is_star", T.BooleanType()),
    ]
)
CALL = T.StructType(
    [
        T.StructField("callee_name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("containing_symbol", T.StringType()),
        T.StructField("is_method_call", T.BooleanType()),
    ]
)
#: One row a file; also the cache that incremental analysis reads.
FILE = T.StructType(
    [
        T.StructField("analysis_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("line_count", T.IntegerType()),
        T.StructField("parse_ok", T.BooleanType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("imports", T.ArrayType(IMPORT)),
        T.StructField("calls", T.ArrayType(CALL)),
        T.StructField("extractor_version", T.IntegerType()),
    ]
)
JOB_EVENT = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("repository_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)
REPOSITORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
