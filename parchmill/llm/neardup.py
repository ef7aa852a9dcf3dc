"""Problem 3: records that share most of their text, by b-bit MinHash.

1. Texts whose compared characters agree are one class; only a class's representative goes on.
2. A representative's runs of ten characters are hashed once; the hash range is divided into ``bins``, and each bin
   keeps its least hash (one-permutation MinHash; empty bins borrow from filled ones).
3. Bands of minima give candidate pairs. Bands of many members are paired block by block over several tasks.
4. The low ``bits`` bits of the minima, packed into 64-bit words, estimate the similarity of each candidate by bit
   counts, corrected for chance collisions. The estimate decides where it is more than ``sure`` standard deviations
   from the threshold.
5. Only candidates in between are held against the exact similarity of the two sets of runs.

Groups (:func:`near_duplicate_groups`) are the connected components of the similar texts. They need no pairs of a band's
members: each member is held against the band's least id only, and members that other components share a band with are
paired in a second step. So a template with any number of fillings costs as many comparisons as it has bands.

Nothing is collected: classes, candidates and links stay distributed. The chance that a pair of similarity s shares no
band is (1 - s^rows)^bands: with the defaults 0.2 % at 0.62, 0.04 % at 0.65 and under 0.001 % from 0.7 on.

Defined results: null texts and texts without a letter or digit are in no pair; equal texts are, however short; texts
of fewer than ten compared characters are only similar to equal ones; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from ..session import cut
from .arrow import map_batches
from .forms import VOCABULARY, canonical
from .lookalikes import digest


#: Lists of texts to look at again of at most this many rows are broadcast, longer ones go through a shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class MinHash:
    """Parameters: runs of ``width`` characters, ``bands`` bands of ``rows`` minima, ``bits`` bits kept of each."""

    width: int = 10
    bands: int = 64
    rows: int = 5
    bits: int = 4
    threshold: float = 0.6
    sure: float = 5.0
    block: int = 256
    stripe: int = 8
    path: str = VOCABULARY

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        return -(-self.bins * self.bits // 64)


@lru_cache(maxsize=1)
def _compared() -> np.ndarray:
    """Per code point: whether it counts when texts are compared (no white space, punctuation, symbol or control)."""
    import sys
    import unicodedata

    return np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def compared(text: str, form_of) -> np.ndarray:
    """The code points that are compared: the one form in lower case, without white space, punctuation and symbols."""
    codes = np.frombuffer(form_of(text).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return codes[_compared()[codes]]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` consecutive characters."""
    n = len(codes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            h *= _ODD
            h += wide[k : n + k]
    h = _mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


@lru_cache(maxsize=8)
def _borrow(bins: int) -> np.ndarray:
    """For each attempt, where each empty bin looks (fixed pseudo-random positions)."""
    return (_mix(np.arange(1, 65 * bins + 1, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64).reshape(65, bins)


@lru_cache(maxsize=8)
def _edges(bins: int) -> np.ndarray:
    return np.array([(k << 64) // bins for k in range(bins)], np.uint64)


def minima(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin of the hash range; empty bins take another bin's."""
    at = np.searchsorted(hashes, _edges(bins))
    stop = np.append(at[1:], len(hashes))
    filled = at < stop
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not filled.all():
        source = np.arange(bins)
        source[~filled] = -1
        empty = np.flatnonzero(~filled)
        for attempt in _borrow(bins):
            target = attempt[empty]
            good = filled[target]
            source[empty[good]] = target[good]
            empty = empty[~good]
            if not len(empty):
                break
        if len(empty):
            source[empty] = np.flatnonzero(filled)[0]
        out = out[source]
    return out


def packed(least: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    per = 64 // bits
    low = np.zeros(words * per, np.uint64)
    low[: len(least)] = _mix(least) & np.uint64((1 << bits) - 1)
    return np.bitwise_or.reduce(low.reshape(words, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = least[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = _mix(key * _ODD + grid[:, k])
    return key


def signatures(df: DataFrame, key: str, text: str, p: MinHash) -> DataFrame:
    """(id, class, runs, sketch, bands) of each text with a letter or digit; short texts have no runs and no bands."""

    def make():
        form_of = canonical(p.path)
        empty = np.empty(0, np.uint64)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, classes, runs, sketches, bands = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not any(map(str.isalnum, t)):
                    continue
                codes = compared(t, form_of)
                hashes = run_hashes(codes, p.width)
                least = minima(hashes, p.bins) if len(hashes) else empty
                ids.append(k)
                runs.append(len(hashes))
                classes.append(digest(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")))
                sketches.append(packed(least, p.bits, p.words).view(np.int64) if len(least) else empty.view(np.int64))
                bands.append(band_keys(least, p.bands, p.rows).view(np.int64) if len(least) else empty.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(classes, pa.binary()), pa.array(runs, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["id", "class", "runs", "sketch", "bands"]
            )

        return step

    source = df.select(F.col(key).alias("id"), F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    return map_batches(source, make, f"id {dict(source.dtypes)['id']}, class binary, runs int, sketch array<long>, bands array<long>")


def pairs_within(rows: DataFrame, key: str, block: int = 256, stripe: int = 8) -> DataFrame:
    """(a, b), a < b, of ``id`` (long) values that share a ``key`` (long); pairs of different keys may repeat.

    Runs of one key of at most ``block`` members are paired as they stream by in key order. Longer runs are only cut
    into blocks; each pair of stripes of ``stripe`` blocks then is a key of its own, so that a long run is paired by all
    tasks, and no task holds more than two stripes of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("run", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64()))])

        def out(a, b, blocks) -> pa.RecordBatch:
            n, m = len(a), len(blocks)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([r for r, _, _ in blocks], pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array([q for _, q, _ in blocks], pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([i for _, _, i in blocks], pa.list_(pa.int64()))]),
            ], schema=schema)

        rest_k, rest_i = np.empty(0, np.int64), np.empty(0, np.int64)
        part, broken = 0, None  # the run that is longer than a block, and its next block

        def runs(keys, ids, final):
            """Pairs and blocks of the runs that end here; what is left waits for more rows."""
            nonlocal part, broken, rest_k, rest_i
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(cuts, len(keys)))
            left, right, blocks = [], [], []
            done = len(cuts) if final else max(0, len(cuts) - 1)
            live = np.flatnonzero(sizes[:done] > 1) if broken is None else np.arange(done)
            for r in live:
                at, size = int(cuts[r]), int(sizes[r])
                if size <= block and broken != keys[at]:
                    if size > 1:
                        i, j = np.triu_indices(size, 1)
                        member = ids[at : at + size]
                        left.append(member[i])
                        right.append(member[j])
                else:
                    if broken != keys[at]:
                        part, broken = 0, keys[at]
                    for s in range(at, at + size, block):
                        blocks.append((int(keys[at]), part, ids[s : min(s + block, at + size)]))
                        part += 1
            at = int(cuts[done]) if done < len(cuts) else len(keys)
            rest_k, rest_i = keys[at:], ids[at:]
            while len(rest_k) > block:  # a long run leaves in whole blocks
                if broken != rest_k[0]:
                    part, broken = 0, rest_k[0]
                blocks.append((int(rest_k[0]), part, rest_i[:block]))
                part += 1
                rest_k, rest_i = rest_k[block:], rest_i[block:]
            a = np.concatenate(left) if left else np.empty(0, np.int64)
            b = np.concatenate(right) if right else np.empty(0, np.int64)
            return out(np.minimum(a, b), np.maximum(a, b), blocks)

        for batch in batches:
            keys = np.concatenate((rest_k, batch.column(0).to_numpy(zero_copy_only=False)))
            ids = np.concatenate((rest_i, batch.column(1).to_numpy(zero_copy_only=False)))
            yield runs(keys, ids, False)
        yield runs(rest_k, rest_i, True)

    ordered = rows.select(F.col(key).alias("key"), "id").repartition("key").sortWithinPartitions("key")
    found = cut(ordered.mapInArrow(run, "a long, b long, run long, part int, ids array<long>"), "band-pairs")
    short = found.filter("run is null").select("a", "b")
    blocks = found.filter("run is not null").select("run", "part", "ids", F.floor(F.col("part") / stripe).cast("int").alias("s"))
    stripes = blocks.groupBy("run").agg(F.max("s").alias("last"))
    blocks = blocks.join(stripes, "run")
    x = blocks.select("run", F.col("s").alias("sx"), F.explode(F.sequence("s", "last")).alias("sy"), F.col("part").alias("px"), F.col("ids").alias("ix"))
    y = blocks.select("run", F.explode(F.sequence(F.lit(0), "s")).alias("sx"), F.col("s").alias("sy"), F.col("part").alias("py"), F.col("ids").alias("iy"))
    members = x.join(y.hint("merge"), ["run", "sx", "sy"]).filter("px <= py").select(F.explode("ix").alias("m"), "iy").select("m", F.explode("iy").alias("n")).filter("m <> n")
    return short.unionByName(members.select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b")))


def estimate(a: str, b: str, p: MinHash):
    """Similarity of two sketches: matching lanes by bit counts, corrected for chance collisions."""
    lanes = 64 // p.bits
    low = sum(1 << (k * p.bits) for k in range(lanes))
    low = low - (1 << 64) if low >= 1 << 63 else low

    def misses(x, y):
        v = x.bitwiseXOR(y)
        folded = v
        for k in range(1, p.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(v, k))
        return F.bit_count(folded.bitwiseAND(F.lit(low)))

    unequal = F.aggregate(F.zip_with(a, b, misses), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << p.bits)
    return ((1 - unequal / p.bins) - chance) / (1 - chance)


def exact(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """(a, b, similarity): the exact similarity of the pairs' sets of runs. ``texts`` has (id, text)."""
    x, y = (texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b")

    def make():
        form_of = canonical(p.path)
        cache: dict[str, np.ndarray] = {}

        def hashes(t: str) -> np.ndarray:
            if t not in cache:
                if len(cache) > 512:
                    cache.clear()
                cache[t] = run_hashes(compared(t, form_of), p.width)
            return cache[t]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            shares = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = hashes(s), hashes(t)
                common = len(np.intersect1d(u, v, assume_unique=True))
                shares.append(common / max(1, len(u) + len(v) - common))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["a", "b", "similarity"])

        return step

    return map_batches(both.select("a", "b", "ta", "tb"), make, "a long, b long, similarity double")


def decided(pairs: DataFrame, reps: DataFrame, df: DataFrame, key: str, text: str, p: MinHash) -> DataFrame:
    """(a, b): the pairs whose similarity reaches the threshold, by their sketches or, where those don't tell, exactly."""
    x, y = (reps.select(F.col("id").alias(k), F.col("sketch").alias(f"s{k}"), F.col("runs").alias(f"n{k}")) for k in "ab")
    chance = 1 / (1 << p.bits)
    agree = p.threshold + (1 - p.threshold) * chance
    # borrowed bins repeat others, which costs at most a fifth of what the filled bins tell
    filled = p.bins * (1 - F.exp(-F.least("na", "nb") / p.bins))
    doubt = p.sure * F.sqrt(F.lit(agree * (1 - agree)) / (0.8 * filled)) / (1 - chance)
    # no set that is smaller than the threshold's share of another can be that similar
    able = F.least("na", "nb") >= p.threshold * F.greatest("na", "nb")
    rated = pairs.join(x, "a").join(y, "b").filter(able).select("a", "b", (estimate("sa", "sb", p) - p.threshold).alias("over"), doubt.alias("doubt"))
    rated = cut(rated.filter(F.col("over") >= -F.col("doubt")).select("a", "b", (F.col("over") >= F.col("doubt")).alias("sure")), "near")
    open_ = rated.filter("NOT sure").select("a", "b")
    wanted = small(open_.select(F.explode(F.array("a", "b")).alias("id")).distinct(), BROADCAST_ROWS)
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    exactly = exact(open_, texts, p).filter(F.col("similarity") >= p.threshold).select("a", "b")
    return rated.filter("sure").select("a", "b").unionByName(exactly)


def equal_classes(df: DataFrame, key: str, text: str, p: MinHash) -> tuple[DataFrame, DataFrame]:
    """(id, rep): every text and the least id of its class of equal texts; (id, runs, sketch, bands) of those with runs."""
    signed = cut(signatures(df, key, text, p), "signatures")
    classes = signed.groupBy("class").agg(F.min("id").alias("rep"))  # copies fold before the shuffle
    members = cut(signed.select("id", "class").join(classes, "class").select("id", "rep"), "classes")
    reps = signed.join(members.filter("id = rep").select("id"), "id", "left_semi").filter("runs > 0").drop("class")
    return members, reps


def similar_classes(df: DataFrame, key: str, text: str, p: MinHash) -> tuple[DataFrame, DataFrame]:
    """(id, rep): every text and its class's representative; (a, b): similar representatives, a < b."""
    members, reps = equal_classes(df, key, text, p)
    candidates = pairs_within(reps.select("id", F.explode("bands").alias("band")), "band", p.block, p.stripe).distinct()
    return members, decided(candidates, reps, df, key, text, p)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (a, b): the least id that each is connected with.

    Large and small stars by turns (Kiveris et al. 2014): every round is two aggregates with partial results and joins,
    no vertex's neighbours are ever put together, and the number of rounds grows with the logarithm of the size.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, after = None, mark(now)
    while before != after:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, after = after, mark(now)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def similar_components(df: DataFrame, key: str, text: str, p: MinHash) -> tuple[DataFrame, DataFrame]:
    """(id, rep): every text and its class's representative; (id, component) of the representatives with similar ones."""
    members, reps = equal_classes(df, key, text, p)
    banded = reps.select("id", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("id").alias("c"), F.count("*").alias("n")).filter("n > 1").select("band", "c")
    shared = cut(banded.join(centres, "band"), "shared")
    stars = shared.filter("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(decided(stars, reps, df, key, text, p), "stars")
    # what the stars leave apart: members of one band in different components
    known = components(links)
    placed = shared.select("band", "id").join(known, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    rest = cut(placed.join(mixed, "band", "left_semi"), "mixed")
    if not rest.isEmpty():
        x, y = (rest.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")).distinct() for k in "ab")
        pairs = pairs_within(rest.select("band", "id"), "band", p.block, p.stripe).distinct().join(x, "a").join(y, "b").filter("ca <> cb").select("a", "b")
        links = links.unionByName(decided(pairs, reps, df, key, text, p))
        known = components(links)
    return members, known


def near_duplicate_pairs(df: DataFrame, key: str = "record_id", text: str = "core_text", p: MinHash = MinHash()) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of rows with similar or equal texts."""
    members, links = similar_classes(df, key, text, p)
    x, y = (members.select(F.col("id").alias(f"i{s}"), F.col("rep").alias(s)) for s in "ab")
    across = links.select("a", "b").join(x, "a").join(y, "b").select("ia", "ib")
    shared = members.groupBy("rep").count().filter("count > 1").select("rep")
    copies = members.join(shared, "rep", "left_semi")
    within = copies.select("rep", F.col("id").alias("ia")).join(copies.select("rep", F.col("id").alias("ib")), "rep").filter("ia < ib").select("ia", "ib")
    return across.unionByName(within).select(F.least("ia", "ib").alias(f"{key}_a"), F.greatest("ia", "ib").alias(f"{key}_b"))


def near_duplicate_groups(df: DataFrame, key: str = "record_id", text: str = "core_text", p: MinHash = MinHash()) -> DataFrame:
    """(key, class_id, group_id, group_size): per text the least key of its equal texts, the least key of the texts that
    it is connected with by similar ones, and how many those are."""
    members, groups = similar_components(df, key, text, p)
    placed = members.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("group_id"))
    placed = cut(placed, "groups")
    sizes = placed.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return placed.join(sizes, "group_id").select(F.col("id").alias(key), F.col("rep").alias("class_id"), "group_id", "group_size")
