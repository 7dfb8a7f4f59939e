"""Mixing sources to target weights (problem 8).

Total size: without ``total_tokens`` the largest at which every source that has documents reaches its share without any
document being used more than its source's ``max_repeats`` times. A given total is kept as long as the documents allow
it: sources that cannot reach their share stop at their cap (``capped``), the others share what is left in proportion
to their targets, and the shares reached are reported beside those asked for. Shares of target sources without
documents are spread over the others in proportion. A source's budget is filled by as
many complete epochs as fit, then by a weighted sample without replacement (Efraimidis and Spirakis): each document
draws an exponential key divided by its quality weight, documents are taken in key order, and a prefix sum over
tokens fills the rest of the budget. Documents are never cut, so a source ends below its budget by less than its
next document.

Scale: keys are cut into bins of equal probability, token sums of (source, bin) are prefix-summed over bins, and
only the one bin in which a source's budget ends is ordered document by document. The number of bins follows the
largest source's documents, so that bin holds about ``bin_rows`` of them whatever the size of a source.
Ids are written once and read twice, to fit the quality model on all of them and to weigh each; only the model's
counts, a row a target source and bucket, meet in the driver.

Quality weight: see ``quality_model``; any positive column may take its place. Draws are hashes of seed, source and
document id, so the result depends on neither partitioning nor retries.

Defined results: documents with a null source, a source without target, or no token have no size to mix and are left
out; targets with a null or not positive share or repeats take no part and are reported with no tokens; equal keys
are ordered by id, and repeated rows of one id are documents of their own; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundlake.llm.encode import encode
from groundlake.session import written


BUCKETS = 4096  # of token ids in the quality model
LEAST, MOST = 0.25, 1.0  # range of the weight


def _buckets(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every id, tokens a row)."""
    offsets = ids.offsets.to_numpy()
    values = ids.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint32)
    return values * np.uint32(2_654_435_761) >> np.uint32(20), np.diff(offsets)  # modulo 2^32, as 32 bits wrap


def quality_model(ids: DataFrame) -> dict[str, np.ndarray]:
    """{source: log ratio by bucket of tokens}: how much more frequent a bucket is in the source than in all of them.

    A naive Bayes classifier of the source, fitted on all rows of (k: doc_id and source, ids). Counts are smoothed by
    the frequencies of all sources.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, size = _buckets(b.column(1))
            source = b.column(0).field("source").dictionary_encode()
            own = np.repeat(source.indices.to_numpy(zero_copy_only=False), size) * BUCKETS + bucket
            times = np.bincount(own)
            found = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([source.dictionary.take(pa.array(found // BUCKETS)), pa.array(found % BUCKETS), pa.array(times[found])], ["source", "bucket", "n"])

    cells = ids.select("k", "ids").mapInArrow(count, "source string, bucket bigint, n bigint").groupBy("source", "bucket").agg(F.sum("n").alias("n"))
    cells = cells.toArrow()  # at most BUCKETS rows a target source, whatever the number of documents
    names = cells.column("source").combine_chunks().dictionary_encode()
    tables = np.zeros((len(names.dictionary), BUCKETS))
    tables[names.indices.to_numpy(zero_copy_only=False), cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
    whole = tables.sum(axis=0) + 1.0
    whole /= whole.sum()
    return {s: np.log((t + BUCKETS * whole) / (t.sum() + BUCKETS) / whole) for s, t in zip(names.dictionary.to_pylist(), tables, strict=True)}


def weighed(ids: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, source, weight, n_tokens) of (k: doc_id and source, ids) with tokens.

    Weight in [LEAST, MOST]: the logistic of the mean log ratio of a document's tokens in its own source, so texts that
    are typical of their source draw more often than mislabelled or broken ones. A source without model weighs evenly.
    """
    kind = ids.schema["k"].dataType["doc_id"].dataType.simpleString()
    nothing = np.zeros(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, size = _buckets(b.column(1))
            key, source = b.column(0).field("doc_id"), b.column(0).field("source")
            names = source.dictionary_encode()
            tables = np.stack([model.get(s, nothing) for s in names.dictionary.to_pylist()] or [nothing])
            own = np.repeat(names.indices.to_numpy(zero_copy_only=False), size)
            total = np.bincount(np.repeat(np.arange(len(size)), size), tables[own, bucket], minlength=len(size))
            weight = LEAST + (MOST - LEAST) / (1 + np.exp(-total / np.maximum(size, 1)))
            yield pa.RecordBatch.from_arrays([key, source, pa.array(weight), pa.array(size.astype(np.int64))], ["doc_id", "source", "weight", "n_tokens"])

    return ids.mapInArrow(run, f"doc_id {kind}, source string, weight double, n_tokens bigint").filter("n_tokens > 0")


@dataclass(frozen=True)
class Mix:
    """``documents``: (doc_id, source, n_tokens, uses) of the used ones; ``shares``: a row for each target, with what it
    asks for, what it got, and whether its documents ran out."""

    documents: DataFrame
    shares: DataFrame


def sized(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, weight, n_tokens) of documents with a target, written once and read back.

    Ids are written too: the model is fitted on all of them before the first one is weighed.
    """
    wanted = targets.filter("target_share > 0 AND max_repeats > 0").select("source").distinct()
    rows = documents.select("doc_id", "text", "source").filter("source IS NOT NULL AND text IS NOT NULL").join(wanted, "source", "left_semi")
    ids = written(encode(rows.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text", path=path), "ids")
    return written(weighed(ids, quality_model(ids)), "sized")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, n_source, share, budget, epochs, rest, capped): a row for each usable target."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_source"))
    t = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats")
    t = t.join(have, "source")
    every = W.partitionBy(F.lit(1))  # over one row a target
    t = t.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    t = t.withColumn("_cap", F.col("max_repeats") * F.col("source_tokens")).withColumn("_reach", F.col("_cap") / F.col("share"))
    if total_tokens is None:
        budget = F.col("share") * F.min("_reach").over(every)
    else:
        # in order of the total at which they run out, a source is capped if the level that those before it leave reaches its own
        up = every.orderBy("_reach", "source")
        before = F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        t = t.withColumn("_level", (F.lit(float(total_tokens)) - before) / F.sum("share").over(up.rowsBetween(0, W.unboundedFollowing)))
        t = t.withColumn("_free", F.when(F.col("_level") < F.col("_reach"), F.col("_level")))
        level = F.first("_free", ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        budget = F.least(F.col("_cap"), F.col("share") * F.coalesce(level, F.lit(float("inf"))))
    t = t.withColumn("budget", F.floor(budget + 1e-6).cast("bigint"))
    t = t.withColumn("capped", F.lit(False) if total_tokens is None else F.col("budget") >= F.col("_cap"))
    t = t.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("source_tokens")), F.col("max_repeats")).cast("bigint"))
    return t.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens")).drop("_cap", "_reach", "_level", "_free")


def keyed(sizes: DataFrame, seed: int, bins: int) -> DataFrame:
    """Adds ``key``, exponential with the weight as rate, and its bin.

    u is uniform in (0, 1) from 52 bits of MD5. The bin is that of exp(-key) = u^(1/weight) from high to low.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "source", F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double")
    key = -F.log((bits + 0.5) / F.lit(float(2**52))) / F.col("weight")
    return sizes.withColumn("key", key).withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("bigint"))


def select_documents(sizes: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 7, bin_rows: int = 1000) -> Mix:
    """Mixes (doc_id, source, weight, n_tokens); weights are positive, tokens too."""
    goals = written(plan(sizes, targets, total_tokens), "mix-plan")
    bins = -(-(goals.agg(F.max("n_source")).head()[0] or 1) // bin_rows)
    rows = keyed(sizes, seed, bins)
    cells = rows.groupBy("source", "bin").agg(F.sum("n_tokens").alias("_tokens"))
    upto = F.sum("_tokens").over(W.partitionBy("source").orderBy("bin"))
    cells = cells.select("source", "bin", (upto - F.col("_tokens")).alias("_before"), upto.alias("_upto"))
    cells = cells.join(goals.select("source", "epochs", "rest"), "source")
    placed = rows.join(cells, ["source", "bin"])
    whole = placed.filter("_upto <= rest OR _before >= rest").withColumn("_more", (F.col("_upto") <= F.col("rest")).cast("bigint"))
    edge = placed.filter("_upto > rest AND _before < rest")
    so_far = F.sum("n_tokens").over(W.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("_more", (F.col("_before") + so_far <= F.col("rest")).cast("bigint"))
    used = whole.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("_more")).alias("uses")).filter("uses > 0")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("n_documents"))
    shares = targets.select("source", "target_share", "max_repeats").join(goals.select("source", "source_tokens", "share", "budget", "capped"), "source", "left").join(got, "source", "left")
    shares = shares.withColumn("_all", F.sum("tokens").over(W.partitionBy(F.lit(1)))).select(
        "source", "target_share", "share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("budget", F.lit(0)).alias("budget"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("_all")).alias("actual_share"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("capped", F.lit(False)).alias("capped"),
    )
    return Mix(used, shares)


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 7, path: str | None = None) -> Mix:
    """Mixes documents to targets (source, target_share, max_repeats)."""
    return select_documents(sized(documents, targets, path), targets, total_tokens=total_tokens, seed=seed)
