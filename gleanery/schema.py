"""The chunk record and its keys."""

from pyspark.sql import types as T

#: Identity of a chunk. ``id`` hashes only path and span, so it is not unique
#: across repositories and refs and is never used as a key.
NATURAL_KEY = ["repository", "ref", "path", "line_start", "line_end"]

#: The key without ``ref``: the same file on another branch shares it.
SPAN_KEY = ["repository", "path", "line_start", "line_end"]

#: Columns a search result carries for its chunk, in output order.
RESULT_COLUMNS = [
    "id",
    "repository",
    "ref",
    "path",
    "language",
    "summary",
    "content",
    "line_start",
    "line_end",
    "created_at",
]

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("repository", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("summary_vec", T.ArrayType(T.FloatType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("summarized_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CHUNK_COLUMNS = CHUNK.fieldNames()

#: A file as the scanners deliver it.
FILES = T.StructType(
    [
        T.StructField("repository", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)
