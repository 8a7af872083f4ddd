"""Mine an archive for messages that carry the withheld marker.

A message can be kept up to five times: for itself, for its author, and for the
message it repeats or quotes and that one's author.  A JSON null under the
marker key counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.functions.scalars import path_date, path_time
from archivemill.functions.variants import scalar
from archivemill.operators.carry import carry_forward, carry_in_order
from archivemill.operators.decode import POSITION, decode

MARKER = "withheld_in_countries"
# Only these fields are decoded; a VARIANT is NULL just when its key is absent.
_MARKED = f"{MARKER}: variant, user: struct<{MARKER}: variant>"
FIELDS = (
    f"created_at: variant, {_MARKED}, retweeted_status: struct<{_MARKED}>, "
    f"quoted_status: struct<{_MARKED}>"
)


def _hit(kind: str, linked: str | None, cond: Column) -> Column:
    fields = F.struct(F.lit(kind).alias("kind"), F.lit(linked).cast("string").alias("linked"))
    return F.when(cond, fields)


def _marked(message: str) -> Column:
    """The key counts as soon as it is there, whatever its value."""
    return F.col(f"{message}.{MARKER}").isNotNull()


def _withheld_rules() -> list[Column]:
    dated = F.col("v.created_at").isNotNull()
    # The quote is looked at only where there is no usable repeated message.
    quote = dated & F.col("v.retweeted_status.user").isNull()
    return [
        _hit("tweets", "no", dated & _marked("v")),
        _hit("users", "no", dated & _marked("v.user")),
        _hit("tweets", "retweeted", dated & _marked("v.retweeted_status")),
        _hit("users", "retweeted", dated & _marked("v.retweeted_status.user")),
        _hit("tweets", "quoted", quote & _marked("v.quoted_status")),
        _hit("users", "quoted", quote & _marked("v.quoted_status.user")),
    ]


def _message_rule() -> Column:
    return _hit("messages", None, F.col("v.created_at").isNull() & _marked("v"))


def mine_withheld(lines: DataFrame) -> DataFrame:
    """One row per reason to keep a dated line: ``(position, date, kind, linked, value)``.

    All rules are tried in one pass over the lines; nothing is shuffled.
    """
    rules = F.explode(F.array(*_withheld_rules()))
    hits = decode(lines, FIELDS).select(*POSITION, "value", rules.alias("hit"))
    return hits.filter(F.col("hit").isNotNull()).select(
        *POSITION, path_date(F.col("file")).alias("date"), "hit.kind", "hit.linked", "value"
    )


def _mine_dated(lines: DataFrame, rules: list[Column], *, in_order: bool = False) -> DataFrame:
    """Lines kept by ``rules``, with the time carried from the lines before them.

    All lines take part in the carry, but the text travels for kept lines only.
    ``in_order``: the lines of a file stand in order in one partition, as the archive gives them.
    """
    created = F.col("v.created_at")
    clock = F.when(created.isNotNull(), F.struct(scalar(created, "string").alias("at")))
    tried = decode(lines, FIELDS).select(
        *POSITION, "value", clock.alias("clock"), F.array(*rules).alias("hits")
    )
    kept = F.coalesce(*(F.col("hits")[i] for i in range(len(rules)))).isNotNull()
    narrow = tried.select(
        *POSITION,
        "clock",
        F.when(kept, F.col("value")).alias("value"),
        F.when(kept, F.col("hits")).alias("hits"),
    )
    if in_order:
        carried = carry_in_order(narrow, "file", "clock", "carried")
    else:
        carried = carry_forward(narrow, ["file"], ["line"], "clock", "carried", chunk="block")
    start = path_time(F.col("file"))
    time = F.when(F.col("carried").isNull(), start).otherwise(F.col("carried.at"))
    rows = carried.filter(F.col("value").isNotNull()).select(
        *POSITION,
        path_date(F.col("file")).alias("date"),
        time.alias("time"),
        "value",
        F.explode("hits").alias("hit"),
    )
    undated = F.col("hit.kind") == "messages"
    return rows.filter(F.col("hit").isNotNull()).select(
        *POSITION,
        "date",
        "hit.kind",
        "hit.linked",
        F.when(undated, F.col("time")).alias("approx_time"),
        "value",
    )


def mine_messages(lines: DataFrame) -> DataFrame:
    """Marked lines without ``created_at``, dated by the nearest earlier line with one.

    ``approx_time`` falls back to the time in the file's path.
    """
    return _mine_dated(lines, [_message_rule()]).drop("kind", "linked")


def mine(lines: DataFrame, *, in_order: bool = False) -> DataFrame:
    """``mine_withheld`` and ``mine_messages`` together, in one pass over the lines."""
    return _mine_dated(lines, [*_withheld_rules(), _message_rule()], in_order=in_order)


def mine_read(read: DataFrame) -> DataFrame:
    """``mine`` over what ``read_archive`` gives; a broken file is one row of kind ``unusable``.

    Its value is a JSON object with the file's path and what is wrong with it.
    """
    report = F.to_json(F.struct(F.col("file").alias("path"), "reason"))
    lines = read.select(*POSITION, F.coalesce("value", report).alias("value"), F.col("reason").isNotNull().alias("broken"))
    broken = _hit("unusable", None, F.col("broken"))
    usable = [F.when(~F.col("broken"), rule) for rule in [*_withheld_rules(), _message_rule()]]
    return _mine_dated(lines, [*usable, broken], in_order=True)


def withheld_profiles(mined: DataFrame) -> DataFrame:
    """Ids of the users whose own profile carries the marker, from mined lines."""
    users = "user: struct<withheld_in_countries: variant, id: bigint>"
    fields = f"{users}, retweeted_status: struct<{users}>, quoted_status: struct<{users}>"
    paths = ("v.user", "v.retweeted_status.user", "v.quoted_status.user")
    marked = [F.when(_marked(p), F.col(f"{p}.id")) for p in paths]
    ids = decode(mined, fields).select(F.explode(F.array(*marked)).alias("author_id"))
    return ids.filter(F.col("author_id").isNotNull()).distinct()


def as_json(mined: DataFrame) -> DataFrame:
    """``(kind, date, value)``: the kept lines with ``linked`` or ``approx_time`` added."""
    value = F.col("value")
    added = (
        F.when(F.col("kind") == "messages", with_fields(value, F.struct("approx_time")))
        .when(F.col("kind") == "unusable", value)
        .otherwise(with_fields(value, F.struct("linked")))
    )
    return mined.select("kind", "date", added.alias("value"))


def with_fields(value: Column, fields: Column) -> Column:
    """The JSON object text ``value`` with the fields of a struct added at its end; NULL fields as JSON null."""
    ended = F.rtrim(value, F.lit(" \t\r\n"))
    return F.concat(
        F.left(ended, F.length(ended) - 1),
        F.lit(","),
        F.substr(F.to_json(fields, {"ignoreNullFields": "false"}), F.lit(2)),
    )
