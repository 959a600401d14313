"""Codecs, their levels and the presets of the dataset writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codec, default level, lowest and highest level.
CODECS = (
    ("ZSTD", 3, 1, 22),
    ("LZ4", 0, 0, 0),
    ("SNAPPY", 0, 0, 0),
    ("GZIP", 6, 0, 9),
    ("NONE", 0, 0, 0),
    ("XZ", 6, 0, 9),
    ("BROTLI", 9, 0, 11),
    ("BZIP2", 6, 0, 9),
)

#: Preset, block size in KiB, data codec and level, index codec and level.
PRESETS = (
    ("fastest", 8, "ZSTD", 1, "ZSTD", -3),
    ("fast", 16, "ZSTD", 1, "ZSTD", 1),
    ("default", 512, "ZSTD", 9, "ZSTD", 1),
    ("small", 2048, "ZSTD", 22, "ZSTD", 22),
    ("smallest", 8192, "XZ", 9, "XZ", 9),
)


def codec_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "codec string, default_level int, min_level int, max_level int")


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, block_kib int, data_codec string, data_level int, index_codec string, index_level int")


def clamped(level: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, level))


def resolve(preset: str = "default", codec: str | None = None, level: int | None = None, block_kib: int | None = None) -> dict:
    """Codec, level and block size that a preset and overrides come to; a level counts only with a codec."""
    _, block, own, own_level, _, _ = next(p for p in PRESETS if p[0] == preset)
    if codec:
        _, usual, low, high = next(c for c in CODECS if c[0] == codec.upper())
        own, own_level = codec.upper(), max(low, min(high, usual if level is None else level))
    return {"codec": own, "level": own_level, "block_kib": block_kib or block}


#: The order in which flags are applied; the last one that is given counts.
PRESET_ORDER = ("fast", "fastest", "small", "smallest")
CODEC_ORDER = ("ZSTD", "XZ", "BROTLI", "GZIP", "SNAPPY", "NONE", "BZIP2", "LZ4")


def resolve_flags(flags: set[str], level: int | None = None, block_kib: int | None = None) -> dict:
    """The choice that a set of flags comes to: preset names and codec names; codecs override presets."""
    names = {f.lower() for f in flags}
    preset = next((p for p in reversed(PRESET_ORDER) if p in names), "default")
    codec = next((c for c in reversed(CODEC_ORDER) if c.lower() in names), None)
    return resolve(preset, codec, level, block_kib)


def writer_options(choice: dict) -> dict[str, str]:
    """Parquet options for a choice; codecs that Parquet lacks become the strongest ZSTD."""
    codec, level = choice["codec"], choice["level"]
    if codec in ("XZ", "BROTLI", "BZIP2"):
        codec, level = "ZSTD", 22
    out = {"compression": codec.lower(), "parquet.block.size": str(max(1 << 20, choice["block_kib"] << 10))}
    return out | ({"parquet.compression.codec.zstd.level": str(max(1, level))} if codec == "ZSTD" else {})
