"""Decoding of downlink packets into one wide typed table.

A packet that is null or empty is undecodable: all decoded columns are null, the row stays. An unknown type byte
gives packet_type UNKNOWN; a known type that is too short gives its name and no more. A checksum failure only
clears ``csp_crc_valid``; a trailer is not taken off the data. Columns of other packet types are null.

Two generators share one layout: "native" expressions, and "arrow", which reads the numbers of a batch with NumPy and
serves wide queries. A query names the columns it wants, and nothing else is built or read. Neither shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundlake import layouts as L
from groundlake.functions import binary as B
from groundlake.functions.crc import _buffers, _valid, trailer_valid
from groundlake.functions.csp import header_hex, header_u32

_TYPES = {"Q": "decimal(20,0)", "I": "bigint"}
_ARROW_TYPES = {"Q": pa.decimal128(20, 0), "I": pa.int64()}
_WIDTH = L.LEAST_BYTES["BEACON_EXTENDED"]

START = ["packet_type", "general_message"]
END = ["log_message", "tcmd_response_text", "bulk_data_hex"]


def from_archive(packets: DataFrame, *keep: str) -> DataFrame:
    """Rows of the archive's packet table with ``rs_errs >= 0``: the header is encoded from its fields."""
    out = packets.filter("rs_errs >= 0")
    extra = [F.col(c) for c in keep]
    return out.select(*extra, F.col("ts_received").alias("received_timestamp"), observation_id(F.col("session_dir")).alias("observation_id"), F.lit(None).cast("string").alias("ground_station"), header_hex().alias("csp_header_hex"), trailer_valid(header_u32(), F.col("payload")).alias("csp_crc_valid"), "payload")


def from_hex(lines: DataFrame, column: str = "hex_payload") -> DataFrame:
    """Splits packets given as hex text into header and payload; text that is no hex, or at most 4 bytes, is undecodable."""
    raw = B.hex_bytes(F.col(column))
    out = lines.withColumn("_raw", F.when(F.length(raw) > 4, raw))
    head, rest = F.substring("_raw", 1, 4), F.expr("substring(_raw, 5)")
    word = F.conv(F.hex(head), 16, 10).cast("bigint")
    return out.select("*", B.lower_hex(head).alias("csp_header_hex"), F.when(F.col("_raw").isNotNull(), trailer_valid(word, rest)).alias("csp_crc_valid"), rest.alias("payload")).drop("_raw")


def observation_id(session_dir: Column) -> Column:
    """The number at the end of a session folder, with or without a slash; null if there is none or it is too large."""
    digits = F.regexp_extract(session_dir, r"(\d+)/?$", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def _map(name: str) -> Column:
    return F.expr("map(" + ", ".join(f"{k}, '{v}'" for k, v in L.CODES[name].items()) + ")")


def named(name: str, code: Column, numbered: bool = False) -> Column:
    """The name of a code, UNKNOWN(n) for a miss; numbered: with the code in front."""
    label = F.coalesce(F.try_element_at(_map(name), code.cast("int")), F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")")))
    return F.concat(code.cast("string"), F.lit(" - "), label) if numbered else label


def packet_kind(payload: str = "payload") -> Column:
    """Name of the type byte; UNKNOWN for others, null for a null or empty payload."""
    code = B.number(payload, 0, "B")
    return F.when(F.length(payload) > 0, F.coalesce(F.try_element_at(_map("PACKET_TYPE"), code), F.lit("UNKNOWN")))


def complete(kind: Column, payload: str = "payload") -> Column:
    """Is the payload long enough for its type?"""
    least = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in L.LEAST_BYTES.items()) + ")")
    return F.coalesce(F.length(payload) >= F.try_element_at(least, kind), F.lit(False))


def with_numbers(df: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
    """Adds ``_{code}{offset}`` for each wanted (offset, code), read with NumPy."""
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema]
    names = [f"_{c}{o}" for o, c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = b.column(b.schema.get_field_index("payload"))
            data, off = _buffers(payload)
            length = np.where(_valid(payload), off[1:] - off[:-1], 0)
            rows = B.padded(data, off[:-1], length, _WIDTH)
            made = [pa.array(B.numbers(rows, o, c)).cast(_ARROW_TYPES.get(c, pa.int32())) for o, c in wanted]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    schema = ", ".join([f"`{n}` {t}" for n, t in fields] + [f"`{n}` {_TYPES.get(c, 'int')}" for (_, c), n in zip(wanted, names, strict=True)])
    return df.mapInArrow(run, schema)


def _shown(value: Column, meaning: str, argument) -> Column:
    if meaning == "enum":
        return named(argument, value)
    if meaning == "flag":
        return value != 0
    if meaning == "hex":
        return F.format_string(f"0x%0{argument}X", value)
    if meaning == "scaled":
        return F.round(value / F.lit(float(argument)), 3 if argument == 1000 else 2)
    return value


def utc_text(ms: Column) -> Column:
    """ISO text with ``+00:00Z`` of epoch milliseconds from 1 to the latest valid one, else null."""
    whole = ms.cast("bigint")
    at = F.timestamp_millis(whole)
    text = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(whole % 1000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00Z"))
    return F.when((ms > 0) & (ms <= L.LATEST_MS), text)


def bulk_text(data: Column) -> Column:
    """Bulk data as text, or a placeholder if it is no UTF-8 or under 85 % of it is printable."""
    digits, text = B.lower_hex(data), data.cast("string")
    hint = F.concat(F.when(digits.contains("0cffff0c"), ", maybe MPI data").otherwise(""), F.when(digits.contains("aa4412"), ", maybe binary GNSS data").otherwise(""))
    placeholder = F.concat(F.lit("<BINARY DATA: "), F.length(data).cast("string"), F.lit(" bytes"), hint, F.lit(">"))
    printable = F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]|[ \n\r\t]"))
    readable = F.is_valid_utf8(text) & (printable / F.greatest(F.length(text), F.lit(1)) >= 0.85)
    return F.when(F.length(data) == 0, "").when(readable, text).otherwise(placeholder)


def _json(names: dict[int, str], bit) -> Column:
    present = F.filter(F.array(*[F.when(bit(k), F.lit(f'"{v}"')) for k, v in names.items()]), lambda x: x.isNotNull())
    return F.concat(F.lit("["), F.array_join(present, ", "), F.lit("]"))


def _formulas(raw: Callable[[int, str], Column]) -> dict[str, tuple[tuple[str, ...], Callable[[], Column]]]:
    """{column: (types of complete packets that have it, how to make it)}; nothing is made before it is asked for."""
    basic, extended = ("BEACON_BASIC", "BEACON_EXTENDED"), ("BEACON_EXTENDED",)
    reply, log, bulk, peripheral = ("TCMD_RESPONSE",), ("LOG_MESSAGE",), ("BULK_FILE_DOWNLINK",), ("BEACON_PERIPHERAL",)
    part = lambda place: F.substring("payload", *_at(place))
    data = lambda: part((5, L.BULK_DATA))
    out: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {"satellite_name": (basic, lambda: B.ascii_text(part(L.NAME_AT)))}

    def listed(fields: tuple, types: tuple[str, ...]) -> None:
        for o, c, name, meaning, argument in fields:
            out[name] = (types, lambda o=o, c=c, m=meaning, a=argument: _shown(raw(o, c), m, a))
            if name == "uptime_ms":
                out["uptime_sec"] = (types, lambda o=o, c=c: F.round(raw(o, c) / 1000.0, 3))
            if name == "unix_epoch_time_ms":
                out["utc_time"] = (types, lambda o=o, c=c: utc_text(raw(o, c)))

    listed(L.BASIC_FIELDS[1:], basic)
    out["friendly_message"] = (basic, lambda: B.until_nul(B.utf8(part(L.MESSAGE_AT))))
    out["end_version_number"] = (extended, lambda: B.until_nul(B.utf8(part(L.END_AT))))
    listed(L.EXTENDED_FIELDS, extended)
    bits = lambda low, n: F.shiftright(raw(164, "I") + raw(168, "H").cast("bigint") * (1 << 32), low).bitwiseAND((1 << n) - 1)
    for name, codes, low, n in (("adcs_attitude_estimation_mode", "ADCS_ESTIM_MODE", 0, 4), ("adcs_control_mode", "ADCS_CONTROL_MODE", 4, 4), ("adcs_run_mode", "ADCS_RUN_MODE", 8, 2), ("adcs_asgp4_mode", "ADCS_ASGP4_MODE", 10, 2)):
        out[name] = (extended, lambda codes=codes, low=low, n=n: named(codes, bits(low, n), numbered=True))
    out["adcs_sun_above_local_horizon"] = (extended, lambda: bits(23, 1) == 1)
    for name, names in L.STATE_BITS.items():
        out[name] = (extended, lambda names=names: _json(names, lambda b: bits(b, 1) == 1))
    return out | {
        "raw_payload_hex": (peripheral, lambda: B.lower_hex(F.col("payload"))), "_note": (peripheral, lambda: F.lit(L.PERIPHERAL_NOTE)),
        "tcmd_ts_sent": (reply, lambda: raw(1, "Q")), "tcmd_response_code": (reply, lambda: raw(9, "B")), "tcmd_duration_ms": (reply, lambda: raw(10, "H")),
        "tcmd_response_seq_num": (reply, lambda: raw(12, "B")), "tcmd_response_max_seq_num": (reply, lambda: raw(13, "B")),
        "tcmd_response_text": (reply, lambda: B.until_nul(B.utf8(part((14, L.TCMD_DATA))))),
        "log_message": (log, lambda: B.until_last_newline(B.utf8(part((1, L.LOG_DATA))))),
        "bulk_file_offset": (bulk, lambda: raw(1, "I")), "bulk_data_len": (bulk, lambda: F.length(data())), "bulk_data_hex": (bulk, lambda: B.lower_hex(data())),
        "_bulk_text": (bulk, lambda: bulk_text(data())),
    }


def decoded_columns() -> list[str]:
    """All decoded columns in canonical order."""
    known = [n for n in _formulas(lambda *_: None) if n != "_bulk_text"]
    return ordered([*START, *known, "csp_header_hex", "csp_crc_valid"])


def decode(df: DataFrame, engine: str = "arrow", columns: list[str] | None = None) -> DataFrame:
    """Decoded columns (all, or the given ones) in canonical order behind those of ``df``.

    ``df`` must have payload, csp_header_hex and csp_crc_valid. Only what is asked for is made: the plan holds no other
    expressions, "arrow" reads no other numbers, and the checksum runs only for ``csp_crc_valid``.
    """
    if engine not in ("arrow", "native"):
        raise ValueError("engine: arrow or native")
    wanted = [c for c in decoded_columns() if columns is None or c in columns]
    if columns is not None and (unknown := set(columns) - set(wanted)):
        raise ValueError(f"no decoded columns: {sorted(unknown)}")
    numbers: dict[tuple[int, str], None] = {}

    def raw(offset: int, code: str) -> Column:
        numbers[offset, code] = None
        return F.col(f"_{code}{offset}") if engine == "arrow" else B.number("payload", offset, code)

    known, whole = _formulas(raw), F.col("_whole")
    make = lambda name: F.when(whole.isin(*known[name][0]), known[name][1]())
    out: dict[str, Column] = {}
    for name in wanted:
        if name == "packet_type":
            out[name] = F.col("_kind")
        elif name == "general_message":
            out[name] = F.coalesce(make("log_message"), make("tcmd_response_text"), make("_bulk_text"))
        elif name in ("csp_header_hex", "csp_crc_valid"):
            out[name] = F.when(F.length("payload") > 0, F.col(name))
        else:
            out[name] = make(name)
    own = [c for c in df.columns if c not in ("payload", "csp_header_hex", "csp_crc_valid")]
    rows = df.select(*own, "payload", *[c for c in ("csp_header_hex", "csp_crc_valid") if c in out])
    if engine == "arrow" and numbers:
        rows = with_numbers(rows, list(numbers))
    rows = rows.withColumn("_kind", packet_kind())
    rows = rows.withColumn("_whole", F.when(complete(F.col("_kind")), F.col("_kind")))
    return rows.select(*own, *[c.alias(n) for n, c in out.items()])


def _at(place: tuple[int, int]) -> tuple[int, int]:
    return place[0] + 1, place[1]


def ordered(names: list[str]) -> list[str]:
    """Canonical column order: fixed first, replies, bulk data, the rest, fixed last."""
    reply = [n for n in names if n.startswith("tcmd_") and n not in END]
    bulk = [n for n in names if n.startswith("bulk_") and n not in END]
    taken = {*START, *END, *reply, *bulk}
    return [*[n for n in START if n in names], *reply, *bulk, *[n for n in names if n not in taken], *[n for n in END if n in names]]


def by_receipt(rows: DataFrame) -> DataFrame:
    """Latest first; rows without a time come first. Decoding keeps the order, so narrow packets are best ordered before it."""
    return rows.orderBy(F.desc_nulls_first("received_timestamp"))


def type_counts(df: DataFrame) -> DataFrame:
    """(packet_type, n), most frequent first; undecodable packets are the null type. Reads one byte of each payload."""
    return df.select(packet_kind().alias("packet_type")).groupBy("packet_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "packet_type")


def last_beacon(decoded: DataFrame, order: str = "received_timestamp", tie: str | None = None) -> DataFrame:
    """The latest basic beacon, without columns of other packet types; extended ones don't count."""
    drop = [c for c in decoded.columns if c.startswith(("tcmd_", "bulk_", "log_"))]
    keys = [F.desc_nulls_last(order), *([F.desc(tie)] if tie else [])]
    return decoded.filter("packet_type = 'BEACON_BASIC'").drop(*drop).orderBy(*keys).limit(1)
