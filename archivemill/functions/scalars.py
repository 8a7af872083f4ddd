"""Column-to-column functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def created_at_to_timestamp(text: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008`` -> timestamp; NULL for anything else.

    The weekday is skipped (it cannot be parsed, and carries no information);
    only the offset ``+0000`` is accepted.
    """
    parsed = F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM d HH:mm:ss Z yyyy"))
    return F.when(F.contains(text, F.lit(" +0000 ")), parsed)


def epoch_ms_to_timestamp(millis: Column) -> Column:
    """Epoch milliseconds (text or number) -> timestamp cut to the second."""
    return F.date_trunc("second", F.timestamp_millis(millis.try_cast("bigint")))


def clean_newlines(text: Column) -> Column:
    """CR and LF become one blank each, so CRLF becomes two."""
    return F.translate(text, "\r\n", "  ")


def clean_or_empty(text: Column) -> Column:
    return F.coalesce(clean_newlines(text), F.lit(""))


def _anchor_part(source: Column, part: Column) -> Column:
    usable = source.isNotNull() & (F.length(source) > 1)
    return F.when(usable, F.coalesce(part, source)).otherwise(F.lit(""))


def client_label(source: Column) -> Column:
    """Label of an HTML anchor: between the first ``>`` and the next ``<``."""
    after = F.get(F.split(source, ">"), F.lit(1))
    return _anchor_part(source, F.get(F.split(after, "<"), F.lit(0)))


def client_link(source: Column) -> Column:
    """Link of an HTML anchor: between the first two double quotes."""
    return _anchor_part(source, F.get(F.split(source, '"'), F.lit(1)))


def url_host(url: Column) -> Column:
    """Text between the first ``//`` and the next ``/``, port kept; '' if there is none."""
    rest = F.get(F.split(url, "//"), F.lit(1))
    return F.coalesce(F.get(F.split(rest, "/"), F.lit(0)), F.lit(""))


def path_date(path: Column) -> Column:
    """``.../2018/05/02/13/07.json.bz2`` -> ``2018-05-02``."""
    parts = F.split(path, "/")
    return F.concat_ws("-", *(F.try_element_at(parts, F.lit(i)) for i in (-5, -4, -3)))


def path_time(path: Column) -> Column:
    """``.../2018/05/02/13/07.json.bz2`` -> ``2018-05-02 13:07:00``."""
    parts = F.split(path, "/")
    clock = F.concat_ws(":", *(F.try_element_at(parts, F.lit(i)) for i in (-2, -1)))
    return F.concat(path_date(path), F.lit(" "), F.substr(clock, F.lit(1), F.lit(5)), F.lit(":00"))


def one_line(text: Column) -> Column:
    """A text without line ends: LF, CR and the backslash become two characters each."""
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def from_one_line(text: Column) -> Column:
    """What ``one_line`` was made from."""

    def ends(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), ends), "\\")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def as_text(df: DataFrame) -> DataFrame:
    """Timestamps as ``yyyy-MM-dd HH:mm:ss`` text, the form of the CSV files."""
    return df.select(
        *(
            F.date_format(f.name, TEXT_TIMESTAMP).alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )
