"""Text of telecommands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, SUFFIX = "CTS1+", "!"  # fixed values: what every telecommand starts and ends with
FORBIDDEN = ")!@"  # fixed value: a tag behind the end of a command


def bare(command: Column) -> Column:
    """Without one prefix and one suffix."""
    text = F.trim(command)
    text = F.when(text.startswith(PREFIX), F.substring(text, F.lit(len(PREFIX) + 1), F.length(text))).otherwise(text)
    return F.when(text.endswith(SUFFIX), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pass_command(command: Column, tssent_ms: Column, tsexec_ms: Column) -> Column:
    """A command of a pass agenda with both tags and a readable remark; execution at 0 is immediate."""
    when = F.when(tsexec_ms == 0, F.lit("immediate")).otherwise(stamp(tsexec_ms))
    return F.concat(F.lit(PREFIX), bare(command), F.lit("@tssent="), tssent_ms.cast("string"), F.lit("@tsexec="), tsexec_ms.cast("string"), F.lit(f"{SUFFIX}  # tssent="), stamp(tssent_ms), F.lit(" tsexec="), when)


def sheet_command(command: Column, tssent_ms: Column, tsexec_ms: Column, response: Column) -> Column:
    """A command of an agenda sheet; ``response`` may be empty."""
    core = F.regexp_replace(F.regexp_replace(command, "^!+", ""), "!+$", "")
    name = F.when(F.length(F.coalesce(response, F.lit(""))) > 0, F.concat(F.lit("@resp_fname="), response)).otherwise("")
    return F.concat(core, F.lit("@tssent="), tssent_ms.cast("string"), F.lit("@tsexec="), tsexec_ms.cast("string"), name, F.lit(SUFFIX))


def tagged(command: Column, tssent_ms: Column, tsexec_ms: Column) -> Column:
    """A command with the tags that are not null."""
    tag = lambda n, v: F.when(v.isNotNull(), F.concat(F.lit(f"@{n}="), v.cast("string"))).otherwise("")
    return F.concat(F.regexp_replace(command, "!+$", ""), tag("tssent", tssent_ms), tag("tsexec", tsexec_ms), F.lit(SUFFIX))


def priority_parts(command: Column) -> tuple[Column, Column]:
    """(command without affixes and without its first tsexec tag, that tag's value or 0)."""
    core = bare(command)
    value = F.regexp_extract(core, r"@tsexec=(\d+)", 1)
    rest = F.trim(F.regexp_replace(core, r"^(.*?)@tsexec=\d+", "$1"))
    return F.when(value != "", rest).otherwise(core), F.when(value != "", value.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def readable(line: Column) -> Column:
    """A line with its tag times in front, if it has any."""
    parts = []
    for tag in ("tssent", "tsexec"):
        ms = F.regexp_extract(line, rf"@{tag}=(\d+)", 1)
        parts.append(F.when(ms != "", F.concat(F.lit(f"{tag}: "), F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))))
    return F.concat_ws(" | ", *parts, line)


#: line ends, and the blanks that are cut off lines
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_OUTER_BLANKS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank, without outer blanks, as an array."""
    return F.filter(F.transform(F.split(text, _LINE_END), lambda x: F.regexp_replace(x, F.lit(_OUTER_BLANKS), F.lit(""))), lambda x: x != "")
