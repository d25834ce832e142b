"""Schemas of the index tables. The vectors' length is a parameter everywhere."""

from pyspark.sql import types as T

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILE_INFO = _struct(
    id=_L, name=_S, path=_S, category=_I, content=_S, metadata=_S, md5=_S, file_ext=_S, file_size=_L, file_create_time=_TS, file_update_time=_TS,
    is_invalid=_B, invalid_reason=_S, content_index_status=_I, content_index_status_msg=_S, meta_index_status=_I, meta_index_status_msg=_S,
    create_time=_TS, update_time=_TS)
CONTENT_EMBEDDING = _struct(id=_L, file_id=_L, chunk_index=_L, chunk_text=_S, embedding=T.ArrayType(T.FloatType()), create_time=_TS)
META_EMBEDDING = _struct(id=_L, file_id=_L, embedding=T.ArrayType(T.FloatType()), create_time=_TS)
FILE_EVENT = _struct(event_id=_L, ts=_TS, kind=_S, path=_S, to_path=_S, is_file=_B, arrive_time=_TS)
METADATA = _struct(name=_S, extension=_S, category=_S, attributes=_L, size=_L, created=_S, modified=_S, author=_S)
CONFIG = _struct(id=_L, name=_S, value=_S, create_time=_TS, update_time=_TS)

# The codes of categories and statuses.
DOCUMENT, IMAGE, AUDIO, VIDEO, OTHER = 1, 2, 3, 4, 5
CATEGORIES = {DOCUMENT: "document", IMAGE: "image", AUDIO: "audio", VIDEO: "video", OTHER: "other"}
WAITING, INDEXING, INDEXED, FAILED = 1, 2, 3, 4
STATUSES = {WAITING: "waiting", INDEXING: "indexing", INDEXED: "indexed", FAILED: "failed"}
