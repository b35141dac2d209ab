"""Image folders with caption files beside the images."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samphire.functions.text import collapse_white_space, extension, is_blank

#: Extensions of images, and endings of caption files by kind, first choice first.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff")
SIDECARS = {"booru_tags": (".booru.txt", ".tags.txt"), "short_caption": (".caption.txt", ".txt"), "style_tags": (".style.txt",)}
#: Segments before a JPEG's frame header that are stepped over; each may hold 64 KB.
SEGMENTS = 500


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _folder(spark: SparkSession, directory: str):
    """The Hadoop path of the folder; it must exist."""
    if directory is None or not directory.strip():
        raise ValueError("directory: a path is expected")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(conf)
    if not system.exists(path):
        raise FileNotFoundError(f"Dataset directory not found: {directory}")
    return system.makeQualified(path).toString()


def binary_files(spark: SparkSession, directory: str, endings: tuple[str, ...]) -> DataFrame:
    """(path, content) of files below the folder; endings are matched, in any case, before a byte is read."""
    glob = "*.{" + ",".join(map(_any_case, endings)) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory).select("path", "content")


def _absolute(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def clean_paths(paths: DataFrame) -> DataFrame:
    """(path): the distinct paths that aren't null or blank."""
    return paths.select("path").where(~is_blank(F.col("path"))).distinct()


def listed_files(spark: SparkSession, paths: Sequence[str | None]) -> list[str]:
    """A list of files as absolute paths: blank ones left out, each once, by path. A missing file is an error."""
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    found = sorted({_absolute(r["path"]) for r in clean_paths(frame).collect()})  # the caller's own list
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in found:
        file = jvm.org.apache.hadoop.fs.Path(path)
        if not file.getFileSystem(conf).exists(file):
            raise FileNotFoundError(f"no such file: {path}")
    return found


def literal_paths(paths: Sequence[str]) -> list[str]:
    """Paths with the signs that a reader would take as patterns escaped."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def _units(content: Column, digits: int, little: bool) -> Column:
    """Code units of whole bytes in hexadecimal, big end first, a blank after each."""
    pairs = digits // 2
    order = reversed(range(1, pairs + 1)) if little else range(1, pairs + 1)
    return F.regexp_replace(F.hex(content), "(..)" * pairs, "".join(f"${i}" for i in order) + " ")


def _wide(content: Column, digits: int, little: bool) -> Column:
    """Text of UTF-16 (4 digits a unit) or UTF-32 (8): lone surrogates, numbers of no character and a cut last unit become U+FFFD."""
    size = digits // 2
    whole = (F.octet_length(content) / size).cast("int") * size
    units = _units(F.substring(content, F.lit(1), whole), digits, little)
    if digits == 4:
        units = F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD ")
        units = F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    else:
        units = F.regexp_replace(units, "0000D[89A-F].. |(?!00(?:0[0-9A-F]|10))[0-9A-F]{8} ", "0000FFFD ")
    text = F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16BE" if digits == 4 else "UTF-32")
    return F.when(F.octet_length(content) > whole, F.concat(text, F.lit("\ufffd"))).otherwise(text)


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-8 without its mark, or UTF-16 or UTF-32 by their marks; bad bytes become U+FFFD."""
    head = F.hex(F.substring(content, 1, 4))
    utf8 = lambda x: F.make_valid_utf8(x.cast("string"))
    rest = lambda n: F.substring(content, n + 1, (1 << 31) - 1)
    return (
        F.when(head.startswith("EFBBBF"), utf8(rest(3)))
        .when(head == "FFFE0000", _wide(rest(4), 8, True))
        .when(head == "0000FEFF", _wide(rest(4), 8, False))
        .when(head.startswith("FEFF"), _wide(rest(2), 4, False))
        .when(head.startswith("FFFE"), _wide(rest(2), 4, True))
        .otherwise(utf8(content))
    )


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def jpeg_size(content: Column) -> Column:
    """struct(width, height) of the first frame header; the segments before it are stepped over, no pixel is decoded."""
    at = lambda pos, n: F.hex(F.substring(content, pos, F.lit(n)))

    def step(state: Column, _: Column) -> Column:
        head = at(state["pos"], 4)
        marker = F.substring(head, 3, 2)
        size = F.when(marker == "FF", 1).when(marker.rlike("^(D[0-9]|01)$"), 2).otherwise(2 + _number(F.substring(head, 5, 4)))
        frame = marker.rlike("^C[0-35-79-BD-F]$")
        stop = state["done"] | frame | ~head.startswith("FF")
        return F.struct(F.when(stop, state["pos"]).otherwise(state["pos"] + F.coalesce(size, F.lit(2))).cast("int").alias("pos"), stop.alias("done"))

    start = F.struct(F.lit(3).alias("pos"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step, lambda state: state["pos"])
    frame = F.hex(F.substring(content, found, F.lit(9)))
    size = F.struct(_number(F.substring(frame, 15, 4)).cast("int").alias("width"), _number(F.substring(frame, 11, 4)).cast("int").alias("height"))
    return F.when(frame.rlike("^FFC[0-35-79-BD-F]"), size)


def tiff_size(content: Column) -> Column:
    """struct(width, height) of the first image's directory, in either byte order."""
    little = F.hex(F.substring(content, 1, 2)) == "4949"

    def number(at: Column, n: int) -> Column:
        digits = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(n)))
        turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
        return _number(F.when(little, turned).otherwise(digits))

    directory = number(F.lit(4), 4)
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), number(directory, 2)) - 1), lambda i: directory + 2 + 12 * i)
    value = lambda at: F.when(number(at + 2, 2) == 3, number(at + 8, 2)).otherwise(number(at + 8, 4))
    tag = lambda k: F.try_element_at(F.transform(F.filter(places, lambda p: number(p, 2) == k), value), F.lit(1)).cast("int")
    return F.when(tag(256).isNotNull() & tag(257).isNotNull(), F.struct(tag(256).alias("width"), tag(257).alias("height")))


def dimensions(content: Column) -> Column:
    """struct(width, height) from the header of a PNG, GIF, BMP, WebP, JPEG or TIFF file; null for other kinds."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    byte = lambda at: F.conv(F.hex(F.substring(content, at, 1)), 16, 10).cast("long")
    little = lambda at, n: sum((byte(at + i) * (1 << (8 * i)) for i in range(1, n)), byte(at))
    head = F.hex(F.substring(content, 1, 4))
    pair = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    webp = F.hex(F.substring(content, 13, 4))
    bits = little(22, 4)
    return (
        F.when(head == "89504E47", pair(number(17, 4), number(21, 4)))
        .when(head.startswith("FFD8"), jpeg_size(content))
        .when(head.isin("49492A00", "4D4D002A"), tiff_size(content))
        .when(head == "47494638", pair(little(7, 2), little(9, 2)))
        .when(head.startswith("424D"), pair(little(19, 4), F.least(little(23, 4), (1 << 32) - little(23, 4))))
        .when((head == "52494646") & (webp == "56503858"), pair(little(25, 3) + 1, little(28, 3) + 1))
        .when((head == "52494646") & (webp == "5650384C"), pair(bits.bitwiseAND(F.lit(16383)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(16383)) + 1))
        .when((head == "52494646") & (webp == "56503820"), pair(little(27, 2).bitwiseAND(F.lit(16383)), little(29, 2).bitwiseAND(F.lit(16383))))
    )


def captions(files: DataFrame) -> DataFrame:
    """(base, booru_tags, short_caption, style_tags) of caption files (path, content).

    ``base`` is the image's path without its extension. Of a kind's endings the first whose text isn't blank counts; a
    base without any such text has no row. A file can play two parts: a.style.txt is the style of a and the caption of an
    image a.style. Null contents read as blank; of files that repeat a path the smallest text counts.
    """
    text = collapse_white_space(decode_text(F.col("content")))
    parts = [F.when(F.col("path").endswith(end), F.struct(F.expr(f"substring(path, 1, length(path) - {len(end)})").alias("base"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))) for kind, ends in SIDECARS.items() for rank, end in enumerate(ends)]
    # blank texts are told apart in the aggregate: a filter before it would decode each text twice
    rows = files.select(text.alias("text"), F.array_compact(F.array(*parts)).alias("parts")).select("text", F.explode("parts").alias("p"))
    best = lambda kind: F.min(F.when((F.col("p.kind") == kind) & (F.col("text") != ""), F.struct("p.rank", "text")))["text"]
    found = rows.groupBy("p.base").agg(*[best(kind).alias(kind) for kind in SIDECARS])
    return found.where(F.coalesce(*SIDECARS).isNotNull())


def with_captions(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images (path, ...) with caption_sources and caption_presence."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    joined = images.withColumn("base", base).join(sidecars, "base", "left").drop("base")
    present = F.struct(*[(~is_blank(F.col(k))).alias(f"has_{k}") for k in SIDECARS])
    return joined.select(*images.columns, F.struct(*SIDECARS).alias("caption_sources"), present.alias("caption_presence"))


def image_records(spark: SparkSession, directory: str) -> DataFrame:
    """A row for each image below the folder: relative path, size, hashes and captions. An unknown format is an error."""
    root = _folder(spark, directory)
    return records(binary_files(spark, directory, IMAGE_EXTENSIONS), binary_files(spark, directory, ("txt",)), root)


def records(files: DataFrame, sidecars: DataFrame, root: str) -> DataFrame:
    """``image_records`` of image files and caption files (path, content) below ``root``."""
    rows = files.select("path", dimensions(F.col("content")).alias("size"), F.struct(F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")).alias("hashes"))
    size = F.col("size")
    known = F.when(size.isNotNull(), size).otherwise(F.raise_error(F.concat(F.lit("Unsupported image format: "), F.col("path"))).cast("struct<width:int,height:int>"))
    found = with_captions(rows.select("path", known.alias("size"), "hashes"), captions(sidecars))
    relative = F.replace(F.substring("path", len(root) + 2, 1 << 30), F.lit("\\"), F.lit("/"))
    return found.select(relative.alias("relative_image_path"), "size.width", "size.height", "hashes", "caption_sources", "caption_presence")


def summarize(records: DataFrame) -> DataFrame:
    """One row: total_images, with_..., total_pixels and by_extension of image records."""
    by = records.groupBy(extension(F.col("relative_image_path")).alias("ext")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"caption_presence.has_{k}")).alias(k) for k in SIDECARS], F.sum(F.col("width").cast("long") * F.col("height")).alias("pixels")
    )
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "total_images"), ("booru_tags", "with_booru_tags"), ("short_caption", "with_short_caption"), ("style_tags", "with_style_tags"), ("pixels", "total_pixels"))]
    return by.agg(*totals, F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("by_extension"))

