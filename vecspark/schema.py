"""Row types, encodings and errors of the embedding store."""

from __future__ import annotations

from enum import Enum

from pyspark.sql.types import ArrayType, ByteType, DataType, FloatType, IntegerType, LongType, StringType, StructField, StructType


class Encoding(str, Enum):
    """Physical form of a vector; a column never mixes the two."""

    F32 = "f32"
    QINT8 = "qint8"

    @property
    def width(self) -> int:
        return 4 if self is Encoding.F32 else 1

    @property
    def sql_type(self) -> ArrayType:
        return ArrayType(FloatType() if self is Encoding.F32 else ByteType(), True)

    @classmethod
    def of(cls, kind: DataType) -> Encoding:
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, ByteType):
            return cls.QINT8
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType):
            return cls.F32
        raise InvalidEmbeddingType(f"not an embedding column: {kind.simpleString()}")


def stored_schema(encoding: Encoding = Encoding.F32) -> StructType:
    return StructType([StructField("id", LongType()), StructField("date", LongType()), StructField("embedding", encoding.sql_type)])


def cluster_schema(encoding: Encoding = Encoding.F32) -> StructType:
    return StructType(
        [
            StructField("cluster_id", LongType()),
            StructField("embedding", encoding.sql_type),
            StructField("prototype_size", IntegerType()),
            StructField("mean_similarity", FloatType()),
            StructField("std_similarity", FloatType()),
            StructField("label", StringType()),
        ]
    )


class EngineError(Exception):
    """Root of the typed errors."""


class InvalidEmbeddingStoreFile(EngineError):
    pass


class CodecMismatch(EngineError):
    pass


class InvalidEmbeddingType(EngineError):
    pass


class InvalidEmbeddingDimension(EngineError):
    pass


class ModelNotInitialised(EngineError):
    pass


class InvalidTextEmbedderResourceFiles(EngineError):
    pass


class InvalidModelFile(EngineError):
    pass


class ModelDownloadFailed(EngineError):
    pass


class InvalidModelType(EngineError):
    pass


class ModelNotDownloaded(EngineError):
    pass


class ConfigParseFailed(EngineError):
    pass


class InvalidInput(EngineError):
    pass


class InferenceFailed(EngineError):
    pass
