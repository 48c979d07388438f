"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

_TEXT = ["date_raw", "from_name", "subject", "category", "body_raw", "body_clean"]


def _of(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_texts = {c: T.StringType() for c in _TEXT}
LIVE = _of(message_number=T.LongType(), message_id=T.StringType(), date=T.TimestampType(), **_texts, in_reply_to_number=T.LongType(), thread_id=T.LongType())
LEGACY = _of(source=T.StringType(), source_file=T.StringType(), date=T.TimestampType(), **_texts)
PIPERMAIL = _of(source=T.StringType(), source_file=T.StringType(), date=T.TimestampType(), **_texts, archive_month=T.StringType(), archive_id=T.LongType())
TOPIC = _of(source=T.StringType(), source_file=T.StringType(), date=T.TimestampType(), **_texts, source_url=T.StringType())
MESSAGES = _of(
    date=T.TimestampType(), from_name=T.StringType(), subject=T.StringType(), category=T.StringType(), body_clean=T.StringType(),
    source=T.StringType(), source_url=T.StringType(), thread_id=T.LongType(), message_number=T.LongType(), in_reply_to_number=T.LongType(),
)
MANIFEST = _of(timestamp=T.StringType(), url=T.StringType())
SOURCES = ("live", "pipermail", "legacy", "topic")  # in the order of their priority
