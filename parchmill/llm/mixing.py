"""Problem 7: mixing sources to target weights.

Weighted fair queueing: each source shuffles its documents (a new order for each repetition), and a document's virtual
finish time is the source's tokens up to it, divided by the source's weight. Documents of all sources are range-sorted
by finish time and the order is cut at the total budget, so at every point of the order the sources have had their
shares, as far as whole documents allow.

The totals of the sources tell, before anything is ordered, by which virtual time the budget is spent. Repetitions and
documents that finish later are never made, so the order holds little more than the budget. Up to that time every
source gives tokens at its weight, so equal steps of virtual time hold equal numbers of tokens and are the range
partitions. Running sums are taken in two steps (:mod:`..operators.running`), so no source and no order ever passes
through one task. Only keys and sizes are shuffled, never texts.

Defined results: null and empty texts have no tokens and are left out; sources without a target, and targets of share
0, are left out; a source that runs out of repetitions stays below its share, which the report shows; other columns
are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import bucket_count, running
from ..session import cut
from .arrow import map_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts text before this vocabulary's merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Targets up to this number of rows are broadcast.
BROADCAST_ROWS = 10_000


@lru_cache(maxsize=2)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """(key, keep columns, tokens) of each non-empty text."""
    source = df.select(key, *keep, F.col(text).alias("__text")).filter("__text IS NOT NULL AND __text <> ''")
    schema = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:-1]) + ", tokens long"

    def make():
        encode = encoding(ranks).encode_ordinary

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

        return step

    return map_batches(source, make, schema)


def spent_by(totals: DataFrame, budget: int) -> float:
    """The virtual time by which the sources together have given the budget; ``totals`` has (total, weight, max_repeats).

    A source gives tokens at its weight until its repetitions are used up. Sources end in the order of that time, so two
    running sums over the table of sources, a row each, tell how much has been given when each one ends.
    """
    ends = totals.select((F.col("total") * F.col("max_repeats") / F.col("weight")).alias("end"), F.col("weight"), (F.col("total") * F.col("max_repeats")).alias("all"))
    ends = ends.groupBy("end").agg(F.sum("weight").alias("w"), F.sum("all").alias("all"))
    before = Window.partitionBy(F.lit(0)).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(F.lit(0)).orderBy("end").rowsBetween(0, Window.unboundedFollowing)
    given = ends.select("end", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("done"), F.sum("w").over(after).alias("live"))
    # the first source that is live when the budget is spent
    spent = given.filter(F.col("done") + F.col("end") * F.col("live") >= budget).agg(F.min_by((F.lit(budget) - F.col("done")) / F.col("live"), "end").alias("first"))
    found = spent.first()["first"]
    if found is None:  # the budget is more than all sources have
        found = ends.agg(F.max("end").alias("m")).first()["m"] or 0.0
    return max(0.0, float(found))


def mixture(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source", ranks: str = RANKS) -> DataFrame:
    """(position, key, source, copy, tokens): the chosen documents in their order; ``position`` counts tokens before it.

    ``targets`` has (source, target_share, max_repeats). ``budget`` is the total in tokens; None takes the greatest
    total that every source can fill its share of.
    """
    few = targets.filter("target_share > 0 AND max_repeats > 0").select(F.col("source").alias("__s"), F.col("target_share").alias("weight"), "max_repeats")
    near = F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few
    counted = token_counts(documents, key, text, [source], ranks)
    sized = cut(counted.join(near, counted[source] == F.col("__s")).filter("tokens > 0").select(F.col(key).alias("id"), F.col("__s").alias("source"), "tokens", "weight", "max_repeats"), "sizes")
    totals = cut(sized.groupBy("source", "weight", "max_repeats").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("largest"), F.count("*").alias("n")), "totals")
    facts = totals.agg(F.min(F.col("total") * F.col("max_repeats") / F.col("weight")).alias("fills"), F.sum("largest").alias("largest")).first()
    if budget is None:
        budget = int(facts["fills"] or 0)
    # each source may be at most one document behind, so whatever finishes later is beyond the cut and never made
    last = spent_by(totals, budget + (facts["largest"] or 0))
    needed = F.least(F.col("max_repeats"), F.floor(F.lit(last) * F.col("weight") / F.col("total")).cast("int") + 1)
    per = totals.select("source", F.col("total").alias("all"), needed.alias("copies"))
    few_sources = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = totals.select(F.sum(F.col("n") * needed).alias("r")).first()["r"] or 0
    parts = bucket_count(rows)
    copies = sized.join(F.broadcast(per) if few_sources else per, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    shuffled = copies.withColumn("h", F.xxhash64("id", "copy", F.lit(seed)))
    spread = F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) * parts)
    ordered = running(shuffled, ["source", "copy"], spread, [F.shiftrightunsigned("h", 1), "h", "id"], "tokens", "upto")
    timed = ordered.withColumn("finish", ((F.col("copy") - 1) * F.col("all") + F.col("upto")) / F.col("weight"))
    timed = cut(timed.filter(F.col("finish") <= F.lit(last) * 1.000001).select("id", "source", "copy", "tokens", "finish"), "finish")
    place = F.least(F.floor(F.col("finish") / F.lit(last or 1.0) * parts), F.lit(parts))
    queued = running(timed.withColumn("one", F.lit(0)), ["one"], place, ["finish", "source", "id", "copy"], "tokens", "total")
    return queued.filter(F.col("total") <= budget).select((F.col("total") - F.col("tokens")).alias("position"), F.col("id").alias(key), "source", "copy", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, documents, most_copies): what each target's source got of the whole."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copy").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    return (
        targets.select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    )
