"""What kind of file an upload is: content first, name second."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.fixed_values import (
    CAPTION_EXTENSIONS,
    DEFAULT_MEDIA_FILE_NAME,
    EXTENSION_TYPES,
    FILE_SIGNATURES,
    MEDIA_FILE_NAMES,
    XML_MARKERS,
)


def file_type(content: Column, name: Column) -> Column:
    """Type by leading bytes, then by XML markers in the first 2,000 bytes, then by extension, then by separators."""

    def first_bytes(count: int) -> Column:
        # One character per byte, whatever the file's own encoding is.
        return F.decode(F.substring(content, 1, count), "ISO-8859-1")

    magic = F.hex(F.substring(content, 1, 8))
    result = F.when(magic.startswith(FILE_SIGNATURES[0][0]), FILE_SIGNATURES[0][1])
    for signature, kind in FILE_SIGNATURES[1:]:
        result = result.when(magic.startswith(signature), kind)
    for marker in XML_MARKERS:
        result = result.when(F.contains(first_bytes(2000), F.lit(marker)), "tally_xml")
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    for ending, kind in EXTENSION_TYPES.items():
        result = result.when(extension == ending, kind)
    for separator in (",", "\t"):
        result = result.when(F.regexp_count(first_bytes(1000), F.lit(separator)) > 3, "csv")
    return result.otherwise("unknown")


def file_catalog(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files under a folder with size, time and type."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    return files.select("path", "length", "modificationTime", file_type(F.col("content"), F.substring_index("path", "/", -1)).alias("type"))


def media_file_name(media_type: Column, caption: Column) -> Column:
    """File name for a media message: a caption that names a file, else by media type."""
    names = F.create_map(*[F.lit(x) for pair in MEDIA_FILE_NAMES.items() for x in pair])
    text = F.coalesce(caption, F.lit(""))
    has_ending = F.lit(False)
    for ending in CAPTION_EXTENSIONS:
        has_ending = has_ending | F.lower(text).endswith(ending)
    return F.when(has_ending, F.trim(text)).otherwise(
        F.coalesce(F.try_element_at(names, media_type), F.lit(DEFAULT_MEDIA_FILE_NAME))
    )
