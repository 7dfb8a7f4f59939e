import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundlake.functions.crc import crc32c, crc32c_rows
from groundlake.operators.redelivery import HORIZON_US, MessageArchive, mark_copies, packet_copies
from groundlake.session import new_folder

SCHEMA = "message_id binary, ts bigint, row_id bigint"
PACKETS = "packet_id bigint, ts_received timestamp, payload binary, rs_errs int, session_dir string, csp_prio int, csp_src int, csp_dst int, csp_dport int, csp_sport int, csp_flags int"


def brute(rows, horizon=HORIZON_US):
    last, out = {}, []
    for m, t, r in sorted(rows, key=lambda x: (x[1], x[2] is None, x[2] or 0)):
        if m in last and t - last[m] <= horizon:
            out.append((m, t, r))
        else:
            last[m] = t
    return sorted(out, key=str)


def marked(df):
    return sorted([(bytes(r.message_id), r.ts, r.row_id) for r in df.collect() if r.superfluous], key=str)


def some_rows(n, seed, span=40 * 3_600_000_000):
    g = random.Random(seed)
    times = [g.randrange(span) for _ in range(n)]
    return [(bytes([g.randrange(6)]) * 16, t if g.random() < 0.5 else t // 60_000_000 * 60_000_000, k) for k, t in enumerate(times)]


def test_chain_over_blocks_matches_brute_force(spark):
    rows = some_rows(3000, 1)
    assert marked(mark_copies(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_identifier_without_holes(spark):
    rows = [(b"h" * 16, k * 170_000_000, k) for k in range(2000)]
    assert marked(mark_copies(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_archive_in_batches_equals_one_pass(spark):
    rows = some_rows(900, 2, 5 * 86_400_000_000)
    random.Random(3).shuffle(rows)
    archive = MessageArchive(spark, new_folder(spark, "t"))
    for k in range(3):
        archive.merge(spark.createDataFrame(rows[k::3], SCHEMA))
    assert marked(archive.copies()) == brute(rows)
    assert archive.manifest()["at"] == 3


def test_only_touched_partitions_are_replaced(spark):
    day = 86_400_000_000
    archive = MessageArchive(spark, new_folder(spark, "t"))
    archive.merge(spark.createDataFrame([(b"a" * 16, k * day + 5, k) for k in range(4)], SCHEMA))
    assert archive.merge(spark.createDataFrame([(b"a" * 16, 2 * day + 9, 9)], SCHEMA)) == [2]
    assert {p: int(v.split("-")[0]) for p, v in archive.manifest()["parts"].items()} == {"0": 1, "1": 1, "2": 2, "3": 1}
    assert archive.manifest()["rows"] == {"0": 1, "1": 1, "2": 2, "3": 1}
    assert archive.merge(spark.createDataFrame([], SCHEMA)) == []
    assert marked(archive.copies()) == [(b"a" * 16, 2 * day + 9, 9)]


def test_a_losing_writer_changes_nothing(spark):
    root, day = new_folder(spark, "t"), 86_400_000_000
    first, second = MessageArchive(spark, root), MessageArchive(spark, root)
    first.merge(spark.createDataFrame([(b"a" * 16, 5, 1)], SCHEMA))
    original = second._commit

    def late_commit(manifest):  # another writer commits while this one is at work
        first.merge(spark.createDataFrame([(b"b" * 16, 6, 2)], SCHEMA))
        original(manifest)

    second._commit = late_commit
    with pytest.raises(RuntimeError, match="another writer"):
        second.merge(spark.createDataFrame([(b"c" * 16, 7, 3)], SCHEMA))
    assert sorted(r.row_id for r in first.copies().collect()) == [1, 2]
    second._commit = original
    second.merge(spark.createDataFrame([(b"c" * 16, 7, 3), (b"a" * 16, day, 4)], SCHEMA))
    assert sorted(r.row_id for r in first.copies().collect()) == [1, 2, 3, 4]
    assert first.vacuum(keep=1) and sorted(r.row_id for r in first.copies().collect()) == [1, 2, 3, 4]
    assert first._names("incoming") == [] and len(first._names("manifest")) == 1 and len(first._names("data")) == 1


def test_islands_are_followed_over_periods(spark):
    step, day = 500_000_000, 86_400_000_000
    rows = [(b"h" * 16, 3 * day - 400 * step + k * step, k) for k in range(800)]  # one chain over five days
    archive = MessageArchive(spark, new_folder(spark, "t"))
    archive.merge(spark.createDataFrame(rows, SCHEMA))
    early = [(b"h" * 16, rows[0][1] - 400_000_000, -1)]  # shifts every anchor behind it
    assert len(archive.merge(spark.createDataFrame(early, SCHEMA))) == len({t // day for _, t, _ in rows})
    assert marked(archive.copies()) == brute(rows + early)


def test_packets_with_nulls_trailers_and_ties(spark):
    from datetime import datetime

    t = datetime(2026, 1, 5)
    head, body = [1, 2, 3, 4, 5, 6], bytearray(b"hello")
    raw = np.frombuffer(bytes.fromhex("%08x" % ((1 << 30) | (2 << 25) | (3 << 20) | (4 << 14) | (5 << 8) | 6)) + bytes(body), np.uint8)
    crc = int(crc32c_rows(raw, np.array([0]), np.array([len(raw)]))[0] ^ 0xFFFFFFFF)
    trailed = body + bytearray(crc.to_bytes(4, "big"))
    rows = [(2, t, body, 0, None, *head), (1, t, trailed, 0, "x", *head), (3, t, body, -1, None, *head), (4, t, None, 0, None, *head), (5, None, body, 0, None, *head), (6, t, body, None, None, *head), (7, t, bytearray(b""), 0, None, *[None] * 6), (7, t, bytearray(b""), 0, None, *[None] * 6)]
    df = spark.createDataFrame(rows, PACKETS)
    found = mark_copies(packet_copies(df.selectExpr("*", "1 AS ts", "2 AS block", "3 AS message_id")))
    assert sorted(r.row_id for r in found.collect() if r.superfluous) == [2, 7]
    assert mark_copies(packet_copies(df.limit(0))).count() == 0


def test_check_value(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(crc32c(df.b)).collect()] == [0xE3069283, 0, None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=12))
def test_crc_rows_match_bytewise(values):
    def one(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    data = np.frombuffer(b"".join(values) + b"\0", np.uint8)
    off = np.cumsum([0, *map(len, values)])
    assert (crc32c_rows(data, off[:-1], off[1:]) ^ np.uint32(0xFFFFFFFF)).tolist() == [one(v) for v in values]
