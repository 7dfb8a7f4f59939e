"""Messages that were delivered more than once (problem 1).

An archive of received copies, partitioned by period of receipt, with an identifier index beside it. A batch is
merged in five steps: look its identifiers up in the index, read only the historical partitions found there,
combine their copies with the incoming ones, choose the winners of the touched messages again, and replace just
those partitions by one atomic change of the manifest. The lookup reads the index of periods near the batch only.

Identity: equal identifier bytes and ``ts`` at most ``horizon`` after the message's earliest copy. Equal bytes
further apart are another message, so winners form a chain: each anchor is the first copy beyond the horizon of
the one before. The chain is cut into time blocks; a block only needs the last anchor of the block before, and
that is resolved over one summary row a block. No task ever holds all copies of an identifier.

Defined results: rows with a null identifier or time are not comparable, and the caller leaves them out (they
stay, each a message of its own). Copies with equal times are ordered by ``row_id``, nulls last; fully equal
rows count as copies of each other, one of them stays. An empty batch changes nothing. Other columns of the
input, whatever their names, are not carried into the archive.
"""

from __future__ import annotations

import itertools
import json
import os
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundlake.functions.batches import laid_out, whole_groups
from groundlake.functions.crc import trailer_valid
from groundlake.functions.csp import HEADER_BITS, header_u32

HORIZON_US = 600_000_000
BLOCK_US = 10_800_000_000
PERIOD_US = 86_400_000_000

_FLAGGED = "message_id binary, ts bigint, row_id bigint, superfluous boolean"
_LINKS = "message_id binary, block bigint, fresh boolean, entries array<bigint>, exits array<bigint>"
_CARRY = "message_id binary, block bigint, carry bigint"


def packet_copies(packets: DataFrame) -> DataFrame:
    """(message_id, ts, row_id) of the packets that count: ``rs_errs >= 0``, a payload and a time of receipt.

    The identifier is 16 bytes of SHA-256 over the six header fields and the payload without a valid CRC trailer.
    """
    rows = packets.select("packet_id", "ts_received", "payload", "rs_errs", *[n for n, _ in HEADER_BITS])
    rows = rows.filter("rs_errs >= 0 AND payload IS NOT NULL AND ts_received IS NOT NULL")
    header = F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n, _ in HEADER_BITS])
    rows = rows.withColumn("_valid", trailer_valid(header_u32(), F.col("payload")))
    core = F.when(F.col("_valid"), F.expr("substring(payload, 1, length(payload) - 4)")).otherwise(F.col("payload"))
    digest = F.unhex(F.sha2(F.concat(F.encode(F.concat(header, F.lit("|")), "UTF-8"), core), 256))
    return rows.select(F.substring(digest, 1, 16).alias("message_id"), F.unix_micros(F.col("ts_received").cast("timestamp")).alias("ts"), F.col("packet_id").cast("bigint").alias("row_id"))


def _block_tables(batches: Iterator[pa.RecordBatch], horizon: int, block_us: int) -> Iterator[pa.RecordBatch]:
    """For blocks linked to a neighbour: from each possible first anchor of the block to its last anchor."""
    for t, starts in whole_groups(batches, ["message_id", "block"]):
        ts, ends = t.column("ts").to_numpy(), [*starts[1:], t.num_rows]
        block, ids, fresh = t.column("block").to_numpy(), t.column("message_id"), t.column("fresh")
        out: dict[str, list] = {"message_id": [], "block": [], "fresh": [], "entries": [], "exits": []}
        for a, z in zip(starts, ends, strict=True):
            own = np.unique(ts[a:z])
            then = np.searchsorted(own, own + horizon, side="right")
            last = np.arange(len(own))
            for i in range(len(own) - 1, -1, -1):
                if then[i] < len(own):
                    last[i] = last[then[i]]
            k = min(len(own), int(np.searchsorted(own, block[a] * block_us + horizon, side="right")) + 1)
            out["message_id"].append(ids[a].as_py())
            out["block"].append(int(block[a]))
            out["fresh"].append(fresh[a].as_py())
            out["entries"].append(own[:k].tolist())
            out["exits"].append(own[last[:k]].tolist())
        yield pa.RecordBatch.from_pydict(out, pa.schema([("message_id", pa.binary()), ("block", pa.int64()), ("fresh", pa.bool_()), ("entries", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))]))


def _carries(batches: Iterator[pa.RecordBatch], horizon: int) -> Iterator[pa.RecordBatch]:
    """Streams the block tables in order; holds one anchor."""
    carry = None
    for b in batches:
        out: list[tuple] = []
        for i, block, fresh, entries, exits in zip(*(b.column(c).to_pylist() for c in ("message_id", "block", "fresh", "entries", "exits")), strict=True):
            if fresh:
                carry = None
            if carry is not None:
                out.append((i, block, carry))
            k = 0 if carry is None else int(np.searchsorted(entries, carry + horizon, side="right"))
            if k < len(entries):
                carry = exits[k]
        if out:
            i, k, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.binary()), pa.array(k, pa.int64()), pa.array(c, pa.int64())], ["message_id", "block", "carry"])


def _flags(batches: Iterator[pa.RecordBatch], horizon: int, block_us: int) -> Iterator[pa.RecordBatch]:
    """Marks every row that is not an anchor. All groups of a batch advance together, one anchor a step.

    A group that is linked to the block before starts with a row that holds nothing but the anchor carried over.
    """
    for t, starts in whole_groups(batches, ["message_id", "block"]):
        begins = np.asarray(starts)
        carried = t.column("carry").combine_chunks()
        has = np.asarray(carried.is_valid().to_numpy(zero_copy_only=False), bool)[begins]
        carry = np.asarray(carried.fill_null(0).to_numpy(zero_copy_only=False), np.int64)[begins]
        ts = np.asarray(t.column("ts").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        n = t.num_rows
        start, end = begins + has, np.append(begins[1:], n)
        base = t.column("block").to_numpy()[begins] * block_us
        wide = np.int64(block_us + horizon + 2)
        group = np.repeat(np.arange(len(begins)), end - begins)
        key = group * wide + np.maximum(ts - base[group], 0)
        target = np.where(has, carry + horizon - base, -1)
        reached = np.searchsorted(key, np.arange(len(begins)) * wide + np.clip(target, 0, wide - 1), side="right")
        at = np.where(has & (target >= 0), np.maximum(reached, start), start)
        keep = np.zeros(n, bool)
        live = np.flatnonzero(at < end)
        while len(live):
            keep[at[live]] = True
            reach = np.minimum(ts[at[live]] + horizon - base[live], wide - 1)
            at[live] = np.searchsorted(key, live * wide + reach, side="right")
            live = live[at[live] < end[live]]
        copies = np.ones(n, bool)
        copies[begins[has]] = False
        own = pa.array(np.flatnonzero(copies))
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(own) for c in ("message_id", "ts", "row_id")] + [pa.array(~keep[copies])], ["message_id", "ts", "row_id", "superfluous"])


def mark_copies(rows: DataFrame, horizon_us: int = HORIZON_US, block_us: int = BLOCK_US) -> DataFrame:
    """(message_id, ts, row_id, superfluous) of rows (message_id, ts, row_id), no column null but row_id.

    ``block_us`` must be at least ``horizon_us``. ``rows`` is read three times, so it should be a stored table; only
    the last pass shuffles it whole. Blocks are linked where the copies nearest to their common border are within
    the horizon, for which only rows near a border count.
    """
    if block_us < horizon_us:
        raise ValueError("a block must not be shorter than the horizon")
    key = ["message_id", "block"]
    rows = rows.select("message_id", "ts", "row_id", F.floor(F.col("ts") / F.lit(block_us)).cast("bigint").alias("block"))
    into = F.col("ts") - F.col("block") * block_us
    nothing = F.lit(None).cast("bigint")
    low = F.when(into <= horizon_us, F.struct(F.col("block").alias("border"), F.col("ts").alias("lo"), nothing.alias("hi")))
    high = F.when(into >= block_us - horizon_us, F.struct((F.col("block") + 1).alias("border"), nothing.alias("lo"), F.col("ts").alias("hi")))
    edges = rows.filter((into <= horizon_us) | (into >= block_us - horizon_us)).select("message_id", F.explode(F.array_compact(F.array(low, high))).alias("_e")).select("message_id", "_e.*")
    linked = edges.groupBy("message_id", "border").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("lo") - F.col("hi") <= horizon_us)
    sides = F.explode(F.array(F.struct(F.col("border").alias("block"), F.lit(False).alias("fresh")), F.struct((F.col("border") - 1).alias("block"), F.lit(True).alias("fresh"))))
    links = linked.select("message_id", sides.alias("_s")).select("message_id", "_s.*").groupBy(*key).agg(F.min("fresh").alias("fresh"))
    tables = laid_out(rows.join(links, key).select("message_id", "block", "ts", "fresh"), key, "ts").mapInArrow(lambda it: _block_tables(it, horizon_us, block_us), _LINKS)
    carry = laid_out(tables, ["message_id"], "block").mapInArrow(lambda it: _carries(it, horizon_us), _CARRY)
    both = rows.select(*key, "ts", "row_id", nothing.alias("carry")).unionByName(carry.select(*key, nothing.alias("ts"), nothing.alias("row_id"), "carry"))
    return laid_out(both, key, F.asc_nulls_first("ts"), F.asc_nulls_last("row_id")).mapInArrow(lambda it: _flags(it, horizon_us, block_us), _FLAGGED)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last time of each identifier and period of a batch; entries of one identifier may stand in several."""
    for b in batches:
        found = pa.Table.from_batches([b]).group_by(["message_id", "part"]).aggregate([("ts", "min"), ("ts", "max")])
        yield from found.select(["message_id", "part", "ts_min", "ts_max"]).rename_columns(["message_id", "part", "lo", "hi"]).combine_chunks().to_batches()


class MessageArchive:
    """The partitioned archive, its identifier index and its manifest below ``root`` (a path of Spark's file system).

    Every merge writes to folders of its own name, so a writer that loses the race has changed nothing that can be
    read. The commit is the creation of the next numbered manifest, which must not exist: on a local or mounted file
    system a hard link to the finished draft, elsewhere ``create`` without overwriting, which HDFS and stores with
    conditional writes hold to. Stores without these need a lock around ``merge``.
    """

    def __init__(self, spark: SparkSession, root: str, horizon_us: int = HORIZON_US, block_us: int = BLOCK_US, period_us: int = PERIOD_US, file_rows: int = 4_000_000) -> None:
        if period_us % block_us:
            raise ValueError("a period must be a whole number of blocks")
        self.spark, self.root = spark, root.rstrip("/")
        self.horizon, self.block, self.period, self.file_rows = horizon_us, block_us, period_us, file_rows
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _committed(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> dict:
        for wait in (0.1, 0.5, 2.0, 0):  # the file exists a moment before its content does
            try:
                return json.loads(self.spark.read.text(f"{self.root}/manifest/{number:010d}.json", wholetext=True).head()[0])
            except (TypeError, ValueError):
                time.sleep(wait)
        raise RuntimeError(f"manifest {number} is not complete; its writer failed while committing, remove the file")

    def manifest(self) -> dict:
        """{"at": number of the last commit, "parts": {period: version}, "rows": {period: copies in it}}."""
        done = self._committed()
        return self._load(done[-1]) if done else {"at": 0, "parts": {}, "rows": {}}

    def _commit(self, manifest: dict) -> None:
        """Makes the new partitions visible at once; fails if another writer has taken the number."""
        target = self._path(f"{self.root}/manifest/{manifest['at']:010d}.json")
        self._fs.mkdirs(target.getParent())
        content = json.dumps(manifest).encode()
        uri = self._fs.makeQualified(target).toUri()
        try:
            if uri.getScheme() == "file":
                draft = f"{uri.getPath()}.{uuid.uuid4().hex}"
                Path(draft).write_bytes(content)
                try:
                    os.link(draft, uri.getPath())
                except FileExistsError:
                    raise
                except OSError:  # a mount without hard links: the file is created before its content
                    with Path(uri.getPath()).open("xb") as f:
                        f.write(content)
                finally:
                    os.unlink(draft)
            else:
                out = self._fs.create(target, False)
                out.write(bytearray(content))
                out.close()
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and not self._fs.exists(target):
                raise
            raise RuntimeError("another writer has committed; merge again") from e

    def _read(self, kind: str, parts: dict[str, str], schema: str) -> DataFrame:
        """The given partitions in their given versions: one scan, whatever the number of commits."""
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, part bigint")
        paths = [f"{self.root}/{kind}/version={v}/part={p}" for p, v in sorted(parts.items())]
        return self.spark.read.schema(f"{schema}, part bigint, version string").option("basePath", f"{self.root}/{kind}").parquet(*paths).drop("version")

    def copies(self, parts: dict[str, str] | None = None) -> DataFrame:
        """(message_id, ts, row_id, superfluous, part) of all copies, or of the given partitions."""
        return self._read("data", self.manifest()["parts"] if parts is None else parts, _FLAGGED)

    def _stored(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _part(self) -> Column:
        return F.floor(F.col("ts") / F.lit(self.period)).cast("bigint").alias("part")

    def merge(self, incoming: DataFrame) -> list[int]:
        """Takes a batch (message_id, ts, row_id); returns the periods whose partitions were replaced.

        The driver holds one number a period. A commit by another writer in between raises and leaves the archive as
        that writer made it.
        """
        old = self.manifest()
        version = f"{old['at'] + 1:010d}-{uuid.uuid4().hex[:12]}"
        staged = f"{self.root}/incoming/{version}"
        try:
            batch = self._stored(incoming.select("message_id", "ts", "row_id", self._part()), f"{staged}/batch")
            sizes = {r[0]: r[1] for r in batch.groupBy("part").count().collect()}
            if not sizes:
                return []
            rows, kept = batch, None
            if old["parts"]:
                touched = self._touched(batch, old["parts"], set(sizes), staged)
                sizes |= {r[0]: sizes.get(r[0], 0) for r in touched.select("part").distinct().collect()}
                before = self.copies({p: v for p, v in old["parts"].items() if int(p) in sizes})
                again = before.join(touched, ["message_id", "part"], "left_semi").select("message_id", "ts", "row_id")
                rows = self._stored(again.unionByName(batch.select("message_id", "ts", "row_id")), f"{staged}/again")
                kept = before.join(touched, ["message_id", "part"], "left_anti").select("message_id", "ts", "row_id", "superfluous")
            fresh = mark_copies(rows, self.horizon, self.block)
            fresh = fresh if kept is None else fresh.unionByName(kept)
            files = max(-(-(n + old["rows"].get(str(p), 0)) // self.file_rows) for p, n in sizes.items())
            placed = fresh.withColumn("part", self._part()).repartition("part", F.pmod(F.xxhash64("message_id"), F.lit(files))).sortWithinPartitions("part", "message_id", "ts")
            placed.write.partitionBy("part").parquet(f"{self.root}/data/version={version}")
            new = self._read("data", dict.fromkeys(map(str, sizes), version), _FLAGGED)
            index = new.select("message_id", "part", "ts").mapInArrow(_spans, "message_id binary, part bigint, lo bigint, hi bigint")
            index.sortWithinPartitions("part", "message_id").write.partitionBy("part").parquet(f"{self.root}/index/version={version}")
            counts = {str(r[0]): r[1] for r in new.groupBy("part").count().collect()}
            self._commit({"at": old["at"] + 1, "parts": old["parts"] | dict.fromkeys(counts, version), "rows": old["rows"] | counts})
            return sorted(sizes)
        finally:
            self._fs.delete(self._path(staged), True)

    def _touched(self, batch: DataFrame, parts: dict[str, str], periods: set[int], folder: str) -> DataFrame:
        """(message_id, part) of the historical partitions whose chains can change.

        Index entries of the batch's identifiers and the batch itself are laid out by time; an island is a run
        without a hole longer than the horizon, and only islands that hold an incoming copy are touched. The index is
        read for the batch's own and the neighbouring periods, then further for islands that reach a border.
        """
        have = {int(p) for p in parts}
        near = {p + d for p in periods for d in (-1, 0, 1)} & have
        asked = batch.groupBy("message_id", "part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        for turn in itertools.count():
            index = self._read("index", {str(p): parts[str(p)] for p in near}, "message_id binary, lo bigint, hi bigint")
            known = index.join(asked.select("message_id"), "message_id", "left_semi")
            both = known.withColumn("new", F.lit(0)).unionByName(asked.withColumn("new", F.lit(1)))
            by_id = W.partitionBy("message_id").orderBy("lo", "hi", "new")
            before = F.max("hi").over(by_id.rowsBetween(W.unboundedPreceding, -1))
            both = both.withColumn("_start", F.coalesce(F.col("lo") > before + self.horizon, F.lit(True)).cast("int"))
            both = both.withColumn("_island", F.sum("_start").over(by_id.rowsBetween(W.unboundedPreceding, 0)))
            both = both.withColumn("_asked", F.max("new").over(W.partitionBy("message_id", "_island")))
            found = both.filter("_asked = 1 AND new = 0").groupBy("message_id", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            found = self._stored(found, f"{folder}/touched-{turn}")
            beyond = F.array(F.when(F.col("lo") - self.horizon < F.col("part") * self.period, F.col("part") - 1), F.when(F.col("hi") + self.horizon >= (F.col("part") + 1) * self.period, F.col("part") + 1))
            more = {r[0] for r in found.select(F.explode(F.array_compact(beyond)).alias("p")).distinct().collect()} & have - near
            if not more:
                return found.select("message_id", "part")
            near |= more
        raise AssertionError

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes version folders that none of the last ``keep`` manifests names, and older manifests; returns them.

        Not to be run beside a merge, whose folders no manifest names yet, or while older states are still read.
        """
        done = self._committed()
        used = {f"version={v}" for n in done[-keep:] for v in self._load(n)["parts"].values()}
        gone = [f"{kind}/{n}" for kind in ("data", "index") for n in self._names(kind) if n not in used]
        gone += [f"incoming/{n}" for n in self._names("incoming")] + [f"manifest/{n:010d}.json" for n in done[:-keep]]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone
