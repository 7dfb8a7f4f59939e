"""Decode queries. Their SQL reads the bytes anew with DuckDB's own hex functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundlake import layouts as L
from groundlake.functions.binary import SIZES
from groundlake.functions.ordered import running_sums
from groundlake.operators import decode, rejects
from groundlake.plans import problems
from groundlake.plans.tables import table
from groundlake.session import new_folder
from groundlake.sources import packets


def _decoded(spark: SparkSession, folder: str, engine: str = "arrow", columns: list[str] | None = None) -> DataFrame:
    return decode.decode(decode.from_archive(table(spark, folder, "packet"), "packet_id"), engine, columns)


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).try_cast("bigint") for f in df.schema if f.dataType.simpleString() == "decimal(20,0)"})


def _some(spark: SparkSession, folder: str, columns: list[str], present: str, engine: str = "native") -> DataFrame:
    """The given columns of packets that have the column ``present``."""
    out = _decoded(spark, folder, engine, columns).filter(F.col(present).isNotNull())
    return _typed(out.select("packet_id", *columns))


_BASIC = ["satellite_name", "uptime_sec", "utc_time", "friendly_message", *[f[2] for f in L.BASIC_FIELDS[1:]]]
_STATE = ["adcs_attitude_estimation_mode", "adcs_control_mode", "adcs_run_mode", "adcs_asgp4_mode", "adcs_sun_above_local_horizon", *L.STATE_BITS]


def packet_type_summary(spark: SparkSession, folder: str) -> DataFrame:
    return decode.type_counts(table(spark, folder, "packet").filter("rs_errs >= 0"))


def beacon_basic(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["packet_type", *_BASIC], "satellite_name", "arrow")


def beacon_extended(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["end_version_number", *[f[2] for f in L.EXTENDED_FIELDS], *_STATE], "end_version_number", "arrow")


def beacon_native(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["unix_epoch_time_ms", "eps_mode", "eps_battery_voltage_V", "obc_temperature_C"], "eps_mode")


def telecommand_replies(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["tcmd_ts_sent", "tcmd_response_code", "tcmd_duration_ms", "tcmd_response_seq_num", "tcmd_response_max_seq_num", "tcmd_response_text"], "tcmd_ts_sent")


def log_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["log_message"], "log_message")


def bulk_downlinks(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["bulk_file_offset", "bulk_data_len", "bulk_data_hex"], "bulk_data_len")


def peripheral_beacons(spark: SparkSession, folder: str) -> DataFrame:
    return _some(spark, folder, ["raw_payload_hex", "_note"], "raw_payload_hex")


def general_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _decoded(spark, folder, "native", ["packet_type", "general_message"]).select("packet_id", "packet_type", "general_message")


def partial_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets tagged with a type only, and undecodable ones."""
    rows = decode.from_archive(table(spark, folder, "packet"), "packet_id")
    kind = decode.packet_kind()
    return rows.filter(~decode.complete(kind)).select("packet_id", kind.alias("packet_type"), F.when(F.length("payload") > 0, F.col("csp_header_hex")).alias("csp_header_hex"))


def csp_headers(spark: SparkSession, folder: str) -> DataFrame:
    return decode.from_archive(table(spark, folder, "packet"), "packet_id").select("packet_id", "csp_header_hex", "observation_id", "ground_station")


def crc_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.from_archive(table(spark, folder, "packet"))
    return rows.groupBy(decode.packet_kind().alias("packet_type")).agg(F.count("*").alias("n"), F.count_if("csp_crc_valid").alias("n_valid"))


#: columns of the table beacon, which holds decoded beacons of its own: what decoding must give, with their scale
FIELDS = {
    "packet_type": None, "satellite_name": None, "uptime_ms": None, "unix_epoch_time_ms": None, "last_time_sync_source": None, "total_beacon_count_since_boot": None, "eps_mode": None, "eps_battery_percent": None, "eps_total_fault_count": None,
    "reboot_reason": None, "cts1_operation_state": None, "friendly_message": None, "eps_battery_voltage_V": ("eps_battery_voltage_mv", 1000), "eps_battery_temperature_0_C": ("eps_battery_temperature_0_cc", 100), "eps_battery_temperature_1_C": ("eps_battery_temperature_1_cc", 100), "obc_temperature_C": ("obc_temperature_cc", 100),
}


def beacon_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded fields of the packets that the table beacon lists, null where it lost the reading."""
    known = table(spark, folder, "beacon").alias("b")
    found = _decoded(spark, folder, "arrow", list(FIELDS)).alias("p")
    names = {n: f[0] if f else n for n, f in FIELDS.items()}
    value = lambda n, f: F.round(F.col(f"p.{n}") * f[1]).cast("int") if f else F.col(f"p.{n}")
    out = known.join(found, F.col("b.packet_id") == F.col("p.packet_id"))
    return _typed(out.select("b.beacon_id", *[F.when(F.col(f"b.{names[n]}").isNotNull(), value(n, f)).alias(names[n]) for n, f in FIELDS.items()]))


def hex_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of the text exports, split into header and payload and tagged."""
    lines = rejects.loaded(rejects.parse_lines(table(spark, folder, "packet_line")))
    rows = decode.from_hex(lines, "payload_hex")
    return rows.select("line_id", "csp_header_hex", decode.packet_kind().alias("packet_type"), F.length("payload").alias("n_bytes"))


def exported_packets(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines written as a text export and read again."""
    lines = rejects.loaded(rejects.parse_lines(table(spark, folder, "packet_line")))
    at = F.date_format(F.timestamp_micros("received_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    path = new_folder(spark, "export")
    lines.select(at, "payload_hex", "observation_id", F.nullif("ground_station", F.lit(""))).write.options(sep="|", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return packets.read_csv(spark, path, strict=True)


def last_beacon(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["packet_type", "satellite_name", "uptime_ms", "eps_mode", "eps_battery_percent"]
    return _typed(decode.last_beacon(_decoded(spark, folder, "native", columns), tie="packet_id").select("packet_id", *columns[1:]))


def decoded_by_receipt(spark: SparkSession, folder: str) -> DataFrame:
    """The whole decoded table in canonical column order with each row's place, latest first, rows without a time before all."""
    rows = decode.from_archive(table(spark, folder, "packet"), "packet_id")
    late_first = F.coalesce(-F.unix_micros(F.col("received_timestamp").cast("timestamp")), F.lit(-(2**62)))
    placed = running_sums(rows.withColumn("_late", late_first), [], F.floor(F.col("_late") / F.lit(86_400_000_000)), ["_late", "packet_id"], {"place": F.lit(1)})
    return _typed(decode.decode(decode.by_receipt(placed.drop("_late").withColumn("place", F.col("place").cast("bigint")))))


QUERIES = {f.__name__: f for f in (packet_type_summary, beacon_basic, beacon_extended, beacon_native, telecommand_replies, log_messages, bulk_downlinks, peripheral_beacons, general_messages, beacon_fields, partial_packets, csp_headers, crc_summary, hex_packets, exported_packets, last_beacon, decoded_by_receipt)}


def _byte(offset: int) -> str:
    return f"CAST('0x' || substr(h, {2 * offset + 1}, 2) AS BIGINT)"


def _number(offset: int, code: str) -> str:
    size, signed = SIZES[code]
    value = " + ".join(f"{_byte(offset + k)} * {256**k}" for k in range(size)) if size < 8 else f"CAST(({' + '.join(f'CAST({_byte(offset + k)} AS HUGEINT) * {256**k}' for k in range(8))}) AS BIGINT)"
    if signed:
        half = 1 << (8 * size - 1)
        value = f"(({value}) + {half}) % {2 * half} - {half}"
    return f"({value})"


def _code(name: str, value: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in L.CODES[name].items())
    return f"CASE {value} {cases} ELSE 'UNKNOWN(' || {value} || ')' END"


def _sql_field(o: int, c: str, name: str, meaning: str, argument) -> str:
    value = _number(o, c)
    if meaning == "enum":
        value = _code(argument, value)
    elif meaning == "flag":
        value = f"{value} <> 0"
    elif meaning == "hex":
        value = f"printf('0x%0{argument}X', {value})"
    elif meaning == "scaled":
        value = f"round({value} / {argument}.0, {3 if argument == 1000 else 2})"
    return f'{value} AS "{name}"'


_KIND = "CASE WHEN payload IS NULL OR octet_length(payload) = 0 THEN NULL ELSE CASE substr(h, 1, 2) " + " ".join(f"WHEN '{k:02X}' THEN '{v}'" for k, v in L.CODES["PACKET_TYPE"].items()) + " ELSE 'UNKNOWN' END END"
_LEAST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.LEAST_BYTES.items()) + " END"
_P = f"p AS (SELECT * FROM (SELECT *, hex(payload) AS h FROM packet WHERE rs_errs >= 0)), k AS (SELECT *, octet_length(payload) AS n, {_KIND} AS kind FROM p), w AS (SELECT *, coalesce(n >= {_LEAST}, false) AS whole FROM k)"


def _text(offset: int, size: int) -> str:
    """ASCII text of bytes; the tables hold no others there."""
    return f"decode(unhex(substr(h, {2 * offset + 1}, {2 * size})))"


_STATE_SQL = "(" + _number(164, "I") + " + " + _number(168, "H") + " * 4294967296)"
_state_bits = lambda low, n: f"(({_STATE_SQL} >> {low}) & {(1 << n) - 1})"
_numbered = lambda name, low, n: f"{_state_bits(low, n)} || ' - ' || {_code(name, _state_bits(low, n))}"
_HEADER = "lower(lpad(to_hex(((((CAST(csp_prio & 3 AS BIGINT) * 32 + (csp_src & 31)) * 32 + (csp_dst & 31)) * 64 + (csp_dport & 63)) * 64 + (csp_sport & 63)) * 256 + (csp_flags & 255)), 8, '0'))"
_MS = _number(15, "Q")
_UNTIL_NUL_HEX = "regexp_extract(substr(h, {a}, {n}), '^((?:0[1-9A-F]|[1-9A-F].)*)', 1)"


def _until_nul(offset: int, size: int) -> str:
    return f"decode(unhex({_UNTIL_NUL_HEX.format(a=2 * offset + 1, n=2 * size)}))"


def _json_list(names: dict[int, str]) -> str:
    cases = ", ".join(f"CASE WHEN {_state_bits(b, 1)} = 1 THEN '\"{v}\"' END" for b, v in names.items())
    return f"'[' || array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ', ') || ']'"


#: hex digits of one well-formed character, and of a malformed part (the longest start of a character, else a byte)
_CHARACTER = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB]."
_MALFORMED = "E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].(?:[89AB].)?|F[1-3][89AB].(?:[89AB].)?|F48.(?:[89AB].)?|.."


def _replaced(digits: str) -> str:
    """Text of bytes, U+FFFD for each malformed part."""
    return f"decode(unhex(array_to_string(list_transform(regexp_extract_all({digits}, '{_CHARACTER}|{_MALFORMED}'), lambda x: CASE WHEN regexp_full_match(x, '{_CHARACTER}') THEN x ELSE 'EFBFBD' END), '')))"


_cut = lambda offset, size: f"substr(h, {2 * offset + 1}, {2 * size})"
_UNTIL_NUL_BYTES = "regexp_extract({digits}, '^((?:0[1-9A-F]|[1-9A-F].)*)', 1)"
_LOG = f"(CASE WHEN contains({_replaced(_cut(1, L.LOG_DATA))}, chr(10)) THEN regexp_extract({_replaced(_cut(1, L.LOG_DATA))}, '(?s)^(.*)\n', 1) ELSE {_replaced(_cut(1, L.LOG_DATA))} END)"
_REPLY = _replaced(_UNTIL_NUL_BYTES.format(digits=_cut(14, L.TCMD_DATA)))
_BULK_HEX = f"lower({_cut(5, L.BULK_DATA)})"
_BULK_LENGTH = f"least(n - 5, {L.BULK_DATA})"
_PRINTED = f"decode(unhex({_cut(5, L.BULK_DATA)}))"
_BULK_TEXT = rf"""CASE WHEN {_BULK_LENGTH} = 0 THEN '' WHEN regexp_full_match({_cut(5, L.BULK_DATA)}, '(?:{_CHARACTER})*') AND length(regexp_replace({_PRINTED}, '[\pC\pZ]', '', 'g')) + length(regexp_replace({_PRINTED}, '[^ \n\r\t]', '', 'g')) >= 0.85 * length({_PRINTED})
  THEN {_PRINTED} ELSE '<BINARY DATA: ' || {_BULK_LENGTH} || ' bytes' || CASE WHEN contains({_BULK_HEX}, '0cffff0c') THEN ', maybe MPI data' ELSE '' END || CASE WHEN contains({_BULK_HEX}, 'aa4412') THEN ', maybe binary GNSS data' ELSE '' END || '>' END"""
#: CRC-32C byte by byte: the table by eight shifts of each byte, then the bytes of header and payload before the trailer
_CRC = f"""crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0x82F63B78}) ELSE c >> 1 END)) AS t),
  framed AS (SELECT w.*, {_HEADER} AS head, {_HEADER} || lower(substr(h, 1, greatest(0, 2 * n - 8))) AS body FROM w),
  checked AS (SELECT framed.*, coalesce(n >= 4 AND xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(body) // 2), lambda k: CAST('0x' || substr(body, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) = CAST('0x' || substr(h, 2 * n - 7, 8) AS BIGINT), false) AS crc_ok FROM framed, crc_table)"""


def _only(kinds: tuple[str, ...], value: str, name: str) -> str:
    return f"""CASE WHEN whole AND kind IN ({', '.join(f"'{k}'" for k in kinds)}) THEN {value} END AS "{name}\""""


def _all_columns() -> str:
    basic, extended, reply, log, bulk, peripheral = ("BEACON_BASIC", "BEACON_EXTENDED"), ("BEACON_EXTENDED",), ("TCMD_RESPONSE",), ("LOG_MESSAGE",), ("BULK_FILE_DOWNLINK",), ("BEACON_PERIPHERAL",)
    out = [_only(basic, f"{_until_nul(1, 4)}", "satellite_name"), _only(basic, f"round({_number(7, 'I')} / 1000.0, 3)", "uptime_sec"), _only(basic, _UTC_TEXT, "utc_time"), _only(basic, _until_nul(84, 42), "friendly_message"), _only(extended, _until_nul(126, 4), "end_version_number")]
    for fields, kinds in ((L.BASIC_FIELDS[1:], basic), (L.EXTENDED_FIELDS, extended)):
        out += [_only(kinds, _sql_field(*f).rpartition(" AS ")[0], f[2]) for f in fields]
    out += [_only(extended, v, n) for n, v in _STATE_COLUMNS.items()]
    out += [_only(peripheral, "lower(h)", "raw_payload_hex"), _only(peripheral, f"'{L.PERIPHERAL_NOTE}'", "_note")]
    out += [_only(reply, v, n) for n, v in _REPLY_COLUMNS.items()] + [_only(log, _LOG, "log_message")]
    out += [_only(bulk, _number(1, "I"), "bulk_file_offset"), _only(bulk, _BULK_LENGTH, "bulk_data_len"), _only(bulk, _BULK_HEX, "bulk_data_hex")]
    return ",\n  ".join(out)


_GENERAL = f"CASE WHEN NOT whole THEN NULL WHEN kind = 'LOG_MESSAGE' THEN {_LOG} WHEN kind = 'TCMD_RESPONSE' THEN {_REPLY} WHEN kind = 'BULK_FILE_DOWNLINK' THEN {_BULK_TEXT} END"
_UTC_TEXT = f"CASE WHEN {_MS} BETWEEN 1 AND {L.LATEST_MS} THEN strftime(make_timestamp({_MS} * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {_MS} % 1000 = 0 THEN '' ELSE strftime(make_timestamp({_MS} * 1000), '.%f') END || '+00:00Z' END"
_STATE_COLUMNS = {
    "adcs_attitude_estimation_mode": _numbered("ADCS_ESTIM_MODE", 0, 4), "adcs_control_mode": _numbered("ADCS_CONTROL_MODE", 4, 4), "adcs_run_mode": _numbered("ADCS_RUN_MODE", 8, 2), "adcs_asgp4_mode": _numbered("ADCS_ASGP4_MODE", 10, 2),
    "adcs_sun_above_local_horizon": f"{_state_bits(23, 1)} = 1", **{c: _json_list(names) for c, names in L.STATE_BITS.items()},
}
_REPLY_COLUMNS = {"tcmd_ts_sent": _number(1, "Q"), "tcmd_response_code": _number(9, "B"), "tcmd_duration_ms": _number(10, "H"), "tcmd_response_seq_num": _number(12, "B"), "tcmd_response_max_seq_num": _number(13, "B"), "tcmd_response_text": _REPLY}
_KEPT = lambda columns: ", ".join(f"{v} AS {n}" for n, v in columns.items())
_BEACONS = "FROM w WHERE whole AND kind IN ('BEACON_BASIC', 'BEACON_EXTENDED')"
_FIELD_SQL = ", ".join(f[0] if f else n for n, f in FIELDS.items())
ORACLE = {
    "packet_type_summary": f"WITH {_P} SELECT kind AS packet_type, count(*) AS n FROM w GROUP BY ALL",
    "beacon_basic": f"WITH {_P} SELECT packet_id, kind AS packet_type, {_until_nul(1, 4)} AS satellite_name, round({_number(7, 'I')} / 1000.0, 3) AS uptime_sec, {_UTC_TEXT} AS utc_time, {_until_nul(84, 42)} AS friendly_message, {', '.join(_sql_field(*f) for f in L.BASIC_FIELDS[1:])} {_BEACONS}",
    "beacon_extended": f"WITH {_P} SELECT packet_id, {_until_nul(126, 4)} AS end_version_number, {', '.join(_sql_field(*f) for f in L.EXTENDED_FIELDS)}, {_KEPT(_STATE_COLUMNS)} FROM w WHERE whole AND kind = 'BEACON_EXTENDED'",
    "beacon_native": f"WITH {_P} SELECT packet_id, {', '.join(_sql_field(*f) for f in L.BASIC_FIELDS if f[2] in ('unix_epoch_time_ms', 'eps_mode', 'eps_battery_voltage_V', 'obc_temperature_C'))} {_BEACONS}",
    "beacon_fields": f"SELECT beacon_id, {_FIELD_SQL} FROM beacon",
    "telecommand_replies": f"WITH {_P} SELECT packet_id, {_KEPT(_REPLY_COLUMNS)} FROM w WHERE whole AND kind = 'TCMD_RESPONSE'",
    "log_messages": f"WITH {_P} SELECT packet_id, {_LOG} AS log_message FROM w WHERE whole AND kind = 'LOG_MESSAGE'",
    "bulk_downlinks": f"WITH {_P} SELECT packet_id, {_number(1, 'I')} AS bulk_file_offset, {_BULK_LENGTH} AS bulk_data_len, {_BULK_HEX} AS bulk_data_hex FROM w WHERE whole AND kind = 'BULK_FILE_DOWNLINK'",
    "peripheral_beacons": f"WITH {_P} SELECT packet_id, lower(h) AS raw_payload_hex, '{L.PERIPHERAL_NOTE}' AS _note FROM w WHERE whole AND kind = 'BEACON_PERIPHERAL'",
    "general_messages": f"WITH {_P} SELECT packet_id, kind AS packet_type, {_GENERAL} AS general_message FROM w",
    "partial_packets": f"WITH {_P} SELECT packet_id, kind AS packet_type, CASE WHEN n > 0 THEN {_HEADER} END AS csp_header_hex FROM w WHERE NOT whole",
    "csp_headers": f"SELECT packet_id, {_HEADER} AS csp_header_hex, try_cast(nullif(regexp_extract(session_dir, '(\\d+)/?$', 1), '') AS BIGINT) AS observation_id, CAST(NULL AS VARCHAR) AS ground_station FROM packet WHERE rs_errs >= 0",
    "crc_summary": f"WITH {_P}, {_CRC} SELECT kind AS packet_type, count(*) AS n, count_if(crc_ok) AS n_valid FROM checked GROUP BY ALL",
    "hex_packets": f"""WITH {problems._REASON} SELECT line_id, lower(substr(p, 1, 8)) AS csp_header_hex, CASE upper(substr(p, 9, 2)) {' '.join(f"WHEN '{k:02X}' THEN '{v}'" for k, v in L.CODES['PACKET_TYPE'].items())} ELSE 'UNKNOWN' END AS packet_type, CAST(length(p) // 2 - 4 AS INT) AS n_bytes FROM judged WHERE reason IS NULL""",
    "exported_packets": f"""WITH loaded AS ({problems.ORACLE['p2_loaded']}) SELECT strftime(make_timestamp(received_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS received_timestamp, payload_hex AS hex_payload, observation_id, nullif(ground_station, '') AS ground_station FROM loaded""",
    "last_beacon": f"WITH {_P} SELECT packet_id, {_until_nul(1, 4)} AS satellite_name, {_number(7, 'I')} AS uptime_ms, {_code('EPS_MODE', _number(33, 'B'))} AS eps_mode, {_number(43, 'B')} AS eps_battery_percent FROM w WHERE kind = 'BEACON_BASIC' ORDER BY ts_received DESC NULLS LAST, packet_id DESC LIMIT 1",
    "decoded_by_receipt": f"""WITH {_P}, {_CRC} SELECT packet_id, row_number() OVER (ORDER BY ts_received DESC NULLS FIRST, packet_id) AS place, ts_received AS received_timestamp, try_cast(nullif(regexp_extract(session_dir, '(\\d+)/?$', 1), '') AS BIGINT) AS observation_id, CAST(NULL AS VARCHAR) AS ground_station,
  kind AS packet_type, {_GENERAL} AS general_message, CASE WHEN n > 0 THEN head END AS csp_header_hex, CASE WHEN n > 0 THEN crc_ok END AS csp_crc_valid,
  {_all_columns()} FROM checked""",
}
