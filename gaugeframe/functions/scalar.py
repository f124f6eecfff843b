"""Scalar, string and identifier functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bucket_round(c: Column, digits: int) -> Column:
    """Round half up to ``digits``; the floor form gives the same buckets in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(c.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def digits_for(buckets: int) -> int:
    """10, 100 or 1000 buckets are 1, 2 or 3 digits."""
    return {10: 1, 100: 2, 1000: 3}[buckets]


def make_identifier(label: Column, unit: Column, frame: Column, *objects: Column) -> Column:
    """``label_unit_frame[_object...]`` with the frame padded to five digits."""
    return F.concat_ws("_", label, unit, F.format_string("%05d", frame), *objects)


def split_identifier(c: Column) -> Column:
    parts = F.split(c, "_")
    return F.struct(
        parts[0].alias("label_hash"),
        parts[1].alias("du_hash"),
        parts[2].cast("int").alias("frame"),
        F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))).alias("object_hashes"),
    )


def identifier_prefix(c: Column) -> Column:
    """The frame part (first three fields) of an identifier."""
    return F.substring_index(c, "_", 3)


def snake_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def metric_unique_name(title: Column, *descriptions: Column) -> Column:
    """Stable short name: eight md5 characters of the full text, then the snake-cased title."""
    return F.concat(F.substring(F.md5(F.concat(title, *descriptions)), 1, 8), F.lit("_"), snake_case(title))


def frame_timestamp(frame: Column, fps: Column) -> Column:
    """Middle of the frame in seconds."""
    return (frame.cast("double") + F.lit(0.5)) / fps.cast("double")


def uri_to_path(uri: Column, root: Column) -> Column:
    """Local path of plain, file:, relative:// and absolute:// URIs; anything else is remote and null."""
    def after(prefix: str) -> Column:
        return F.substr(uri, F.lit(len(prefix) + 1))

    plain = F.lit(False)
    for start in ("/", "./", "../", "~/"):
        plain = plain | uri.startswith(start)
    return (
        F.when(plain, uri)
        .when(uri.startswith("file:"), F.url_decode(F.regexp_replace(uri, "^file:(//[^/]*)?", "")))
        .when(uri.startswith("relative://"), F.concat(root, F.lit("/"), after("relative://")))
        .when(uri.startswith("absolute://"), F.concat(F.lit("/"), F.ltrim(after("absolute://"), F.lit("/"))))
    )


def path_to_uri(path: Column, root: Column) -> Column:
    """relative:// below the project root, file:// elsewhere."""
    below = path.startswith(F.concat(root, F.lit("/")))
    return F.when(below, F.concat(F.lit("relative://"), F.substr(path, F.length(root) + 2))).otherwise(F.concat(F.lit("file://"), path))


def natural_key(c: Column) -> Column:
    """Sort key under which embedded numbers of any length compare numerically: a digit run is led by its length.

    Leading zeros do not count; the length takes ten places, as many as a string can have.
    """
    runs = F.regexp_extract_all(c, F.lit("(\\d+|\\D+)"), F.lit(1))

    def number(r: Column) -> Column:
        digits = F.regexp_replace(r, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^\\d+$"), number(r)).otherwise(F.lower(r))), "")


def drop_nan(c: Column) -> Column:
    """NaN becomes NULL at ingestion."""
    return F.when(~F.isnan(c), c)
