"""Format detection by anchored signatures and by plugins' rules: all parts must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format, extension, confidence, parts (offset, bytes) and description, in registry order.
SIGNATURES = (
    ("PNG", "png", 100, ((0, "89504E470D0A1A0A"),), "Portable Network Graphics"),
    ("JPEG", "jpg", 95, ((0, "FFD8FF"),), "JPEG picture"),
    ("GIF", "gif", 100, ((0, "47494638"),), "GIF picture"),
    ("BMP", "bmp", 80, ((0, "424D"),), "Windows bitmap"),
    ("PDF", "pdf", 100, ((0, "255044462D"),), "PDF document"),
    ("ELF", "elf", 100, ((0, "7F454C46"),), "ELF program or object"),
    ("PE", "exe", 70, ((0, "4D5A"),), "DOS or Windows program"),
    ("Mach-O", "dylib", 100, ((0, "CFFAEDFE"),), "64-bit Mach-O"),
    ("Mach-O", "dylib", 100, ((0, "CEFAEDFE"),), "32-bit Mach-O"),
    ("Mach-O fat", "dylib", 60, ((0, "CAFEBABE"),), "universal Mach-O, or a Java class"),
    ("PCAPNG", "pcapng", 100, ((0, "0A0D0D0A"),), "pcapng capture"),
    ("PCAP", "pcap", 100, ((0, "D4C3B2A1"),), "pcap capture"),
    ("ZIP", "zip", 90, ((0, "504B0304"),), "ZIP archive"),
    ("GZIP", "gz", 95, ((0, "1F8B"),), "gzip data"),
    ("XZ", "xz", 100, ((0, "FD377A585A00"),), "xz data"),
    ("BZIP2", "bz2", 85, ((0, "425A68"),), "bzip2 data"),
    ("ZSTD", "zst", 100, ((0, "28B52FFD"),), "Zstandard data"),
    ("LZ4", "lz4", 95, ((0, "04224D18"),), "LZ4 frame"),
    ("CAB", "cab", 95, ((0, "4D534346"),), "cabinet archive"),
    ("7-Zip", "7z", 100, ((0, "377ABCAF271C"),), "7-Zip archive"),
    ("RAR", "rar", 100, ((0, "526172211A07"),), "RAR archive"),
    ("TAR", "tar", 90, ((257, "7573746172"),), "tar archive"),
    ("WAV", "wav", 100, ((0, "52494646"), (8, "57415645")), "WAVE sound"),
    ("AVI", "avi", 100, ((0, "52494646"), (8, "41564920")), "AVI video"),
    ("WebP", "webp", 100, ((0, "52494646"), (8, "57454250")), "WebP picture"),
    ("MP4", "mp4", 90, ((4, "66747970"),), "ISO base media"),
    ("Matroska", "mkv", 90, ((0, "1A45DFA3"),), "Matroska or WebM"),
    ("TIFF", "tif", 90, ((0, "49492A00"),), "TIFF, little-endian"),
    ("TIFF", "tif", 90, ((0, "4D4D002A"),), "TIFF, big-endian"),
    ("MP3", "mp3", 85, ((0, "494433"),), "MP3 with an ID3 tag"),
    ("OGG", "ogg", 100, ((0, "4F676753"),), "Ogg container"),
    ("FLAC", "flac", 100, ((0, "664C6143"),), "FLAC sound"),
    ("SquashFS", "squashfs", 100, ((0, "68737173"),), "SquashFS, little-endian"),
    ("SquashFS", "squashfs", 100, ((0, "73717368"),), "SquashFS, big-endian"),
    ("uImage", "img", 100, ((0, "27051956"),), "U-Boot image"),
    ("DEX", "dex", 100, ((0, "6465780A"),), "Dalvik program"),
    ("SQLite", "sqlite", 100, ((0, "53514C69746520666F726D6174203300"),), "SQLite database"),
    ("WASM", "wasm", 100, ((0, "0061736D"),), "WebAssembly module"),
    ("Java class", "class", 60, ((0, "CAFEBABE"),), "Java class, or a universal Mach-O"),
)
HEAD = 512


def registry(rows=SIGNATURES, first: int = 0) -> list[dict]:
    """Signatures with their place in the registry and the number of bytes they test."""
    return [{"ordinal": first + i, "format": f, "extension": e, "confidence": c, "parts": p, "description": d, "magic_bytes": sum(len(h) // 2 for _, h in p)} for i, (f, e, c, p, d) in enumerate(rows)]


def detect(objects: DataFrame, signatures: list[dict] | None = None, content: str = "content") -> DataFrame:
    """object_id, ordinal, format, extension, description, confidence, magic_bytes: a row per match.

    The registry is a constant of the plan: each signature is a test in one projection over the head, so a row meets all of them without a join."""
    signatures = registry() if signatures is None else signatures
    hexed = F.hex(F.substring(F.col(content), 1, HEAD))
    found = []
    for s in signatures:
        fits = F.lit(bool(s["parts"]))
        for offset, magic in s["parts"]:
            fits = fits & (F.lit(bool(magic))) & (F.substring(F.col("_head"), 2 * offset + 1, max(1, len(magic))) == magic.upper())
        found.append(F.when(fits, F.struct(*[F.lit(s[c]).alias(c) for c in ("ordinal", "format", "extension", "description", "confidence", "magic_bytes")])))
    headed = objects.select(F.col("object_id").cast("string").alias("object_id"), hexed.alias("_head"))
    return headed.select("object_id", F.explode(F.array_compact(F.array(*found))).alias("s")).select("object_id", "s.*")



def best_first(detections: DataFrame) -> DataFrame:
    """Detections with `rank`: by confidence, then specificity, then place in the registry."""
    return detections.withColumn("rank", F.expr("row_number() OVER (PARTITION BY object_id ORDER BY confidence DESC, magic_bytes DESC, ordinal)"))


def with_schema(detections: DataFrame, library: DataFrame) -> DataFrame:
    """The first detection of each object that has a schema, with it: built-in ones before plugins'.

    library (format, source, schema_id) has a row per known format, so Spark broadcasts it by its size."""
    ranked = best_first(detections).join(library, "format")
    return ranked.withColumn("_at", F.expr("row_number() OVER (PARTITION BY object_id ORDER BY CASE source WHEN 'built-in' THEN 0 ELSE 1 END, rank, schema_id)")).filter("_at = 1").drop("_at")


def signature_table(spark: SparkSession) -> DataFrame:
    """The registry as a table: ordinal, format, extension, confidence, magic_bytes."""
    return spark.createDataFrame([(s["ordinal"], s["format"], s["extension"], s["confidence"], s["magic_bytes"]) for s in registry()], "ordinal int, format string, extension string, confidence int, magic_bytes int")
