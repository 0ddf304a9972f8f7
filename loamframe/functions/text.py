"""Text, path and JSON helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamframe.functions.arith import as_col

#: File names of sample collections; a fixed format.
SAMPLE_NAME = r"year(\d{4})_zone(\d+)_id(\d+)_p(\d+)"


def sample_path_parts(path: Column | str) -> Column:
    """struct<year, zone, crop, part> of a sample file's name, null where it is none."""
    path = as_col(path)

    def part(g: int) -> Column:
        found = F.regexp_extract(path, SAMPLE_NAME, g)
        return F.when(found != "", found.cast("int"))

    return F.struct(*[part(g).alias(n) for g, n in enumerate(("year", "zone", "crop", "part"), 1)])


def sample_path(year: Column | str, zone: Column | str, crop: Column | str, part: Column | str) -> Column:
    return F.format_string("sampleable_polygons_year%d_zone%d_id%d_p%d.json", *(as_col(c) for c in (year, zone, crop, part)))


def trailing_number(path: Column | str, extension: str) -> Column:
    """The whole number before the extension, null where there is none."""
    found = F.regexp_extract(as_col(path), r"(\d+)\." + extension + "$", 1)
    return F.when(found != "", found.cast("int"))


def deep_get(json: Column | str, *path: str, default: str | None = None) -> Column:
    """Text at a path of a JSON string, or the default."""
    found = F.get_json_object(as_col(json), "$" + "".join(f".{p}" for p in path))
    return found if default is None else F.coalesce(found, F.lit(default))


def with_unit(value: Column | str, unit: Column | str) -> Column:
    """`value unit`, without what is null."""
    return F.trim(F.concat_ws(" ", as_col(value).cast("string"), as_col(unit).cast("string")))


def country_of(ref_id: Column | str) -> Column:
    """The two country letters of year_CC_source_kind_nnn."""
    return F.substring(as_col(ref_id), 6, 2)


def is_country(ref_id: Column | str, country: str) -> Column:
    return F.substring(as_col(ref_id), 5, 4) == f"_{country}_"


def product_of_message(message: Column | str, length: int = 60) -> Column:
    """The product name that a log message holds after six letters."""
    return F.substring(as_col(message), 7, length)


def time_label(t: Column | str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A time as text, for names of jobs and files."""
    return F.date_format(as_col(t), pattern)


def title(label: Column | str, value: Column | str) -> Column:
    """`label value` with one digit, null if either is."""
    label, value = as_col(label), as_col(value)
    return F.when(label.isNotNull() & value.isNotNull(), F.format_string("%s %.1f", label, value))
