"""Problem 4: lines that a source repeats throughout its documents.

Every line becomes an identifier of what readers see (the one form, lower case, single spaces, digits levelled). The
identifiers of a source's documents are concatenated, with a separator of its own after each document, and a suffix
array is built over them by prefix doubling, with the common prefixes of neighbours from the ranks of its steps. The
suffixes that share a block of lines are neighbours: they reach as far as the common prefix is no shorter than the block.

A line of at least ``least`` letters or digits is deleted if it is a block that enough documents have. A shorter line
says too little alone (a date, "Contact", a page number): it is deleted if the block from the nearest longer line
before it, or up to the nearest one after it, is in enough documents. No longer block need be looked at, as every part
of a block has at least its documents. Lines without a letter or digit are passed over.

A source of more than ``chunk`` lines is split by document into chunks of about that size, each with an array of its
own; the documents of its blocks are added over the chunks, so splitting changes no result. Lengths of the longest
blocks are counted by :func:`repeated_blocks` over whole sources, whatever their chunks.

Defined results: null texts have no lines; documents without a source are never cases; a document with several
sources counts for each; a line twice in one document counts once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from ..session import cut
from .arrow import map_batches
from .forms import VOCABULARY, canonical

_digits = re.compile(r"\d+")
_letters = re.compile(r"[^\W_]")
CHUNK = 100_000
#: Lists of large sources of at most this many rows are broadcast.
BROADCAST_ROWS = 100_000


def line_id(form: str) -> int:
    """A 63-bit identifier of a line in the one form; equal for lines that differ only in case, spacing and digits."""
    level = _digits.sub("0", " ".join(form.lower().split()))
    return int.from_bytes(hashlib.blake2b(level.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


_BITS = (1 << 63) - 1


def _joined(h: int, line: int) -> int:
    h = (h * 0x9E3779B97F4A7C15 ^ line) & _BITS
    return h ^ h >> 31


def _anchored(lines: list[int], wide: list[bool]) -> list[int | None]:
    """Of each short line the identifier of the block from the nearest wide line before it; None for others."""
    out, h = [], None
    for line, w in zip(lines, wide, strict=True):
        h = line if w else None if h is None else _joined(h, line)
        out.append(None if w else h)
    return out


def document_lines(df: DataFrame, key: str, sources, text: str, least: int = 12, path: str = VOCABULARY) -> DataFrame:
    """(source, id, line_no, line, wide, before, after): identifiers of the lines with a letter or digit, once per source.

    ``wide`` lines have at least ``least``. ``before`` and ``after`` are the identifiers of the blocks that tie a short
    line to the nearest wide one before and after it.
    """

    def make():
        form_of = canonical(path)
        known: dict[str, tuple[int, bool] | None] = {}

        def of(line: str) -> tuple[int, bool] | None:
            if line not in known:
                if len(known) > 100_000:
                    known.clear()
                letters = len(_letters.findall(line))
                known[line] = (line_id(line), letters >= least) if letters else None
            return known[line]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, numbers, lines, wides, before, after = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                seen = [(n, *x) for n, line in enumerate(form_of(t).split("\n")) if (x := of(line))]
                ids, wide = [x[1] for x in seen], [x[2] for x in seen]
                rows += [i] * len(seen)
                numbers += [x[0] for x in seen]
                lines += ids
                wides += wide
                if all(wide):
                    before += [None] * len(seen)
                    after += [None] * len(seen)
                else:
                    before += _anchored(ids, wide)
                    after += [None if h is None else h ^ 1 << 62 for h in _anchored(ids[::-1], wide[::-1])[::-1]]
            index = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(2).take(index), pa.array(numbers, pa.int64()), pa.array(lines, pa.int64()), pa.array(wides, pa.bool_()), pa.array(before, pa.int64()), pa.array(after, pa.int64())],
                names=["id", "sources", "line_no", "line", "wide", "before", "after"],
            )

        return step

    source = df.select(F.col(key).alias("id"), F.col(text).alias("__text"), F.array_distinct(sources).alias("sources")).filter("__text IS NOT NULL AND size(sources) > 0")
    lines = map_batches(source, make, f"id {dict(source.dtypes)['id']}, sources array<string>, line_no long, line long, wide boolean, before long, after long")
    return lines.select(F.explode("sources").alias("source"), "id", "line_no", "line", "wide", "before", "after").filter(F.col("source").isNotNull())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence by prefix doubling, and the common prefix of each suffix with the one before it.

    The ranks of each step tell whether two stretches of its width agree, so the common prefixes are found from the
    widest step down. Time is n log² n, whatever repeats.
    """
    n = len(ids)
    prefix = np.zeros(n, np.int64)
    if not n:
        return np.empty(0, np.int64), prefix
    rank = np.unique(ids, return_inverse=True)[1].reshape(-1)
    steps, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1 and width < n:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        order = np.lexsort((second, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(new)))
        steps.append(rank)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(steps) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[(steps[k][a[inside]] == steps[k][b[inside]]) & (np.maximum(a[inside], b[inside]) + (1 << k) <= n)]
        prefix[same + 1] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, prefix


def first_sharing(prefix: np.ndarray, rank: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each suffix (by rank) the first in order that shares with it, and with all between, a prefix of ``length``."""
    least, rows = [prefix], len(prefix)
    while (1 << len(least)) <= rows:
        low, half = least[-1].copy(), 1 << (len(least) - 1)
        low[half:] = np.minimum(low[half:], least[-1][:-half])
        low[:half] = 0
        least.append(low)
    first = rank.copy()
    for k in range(len(least) - 1, -1, -1):
        first -= (least[k][first] >= length).astype(np.int64) << k
    return first


def _codes(*columns: np.ndarray) -> np.ndarray:
    """One number per distinct row of some columns of whole numbers."""
    code = columns[0] - columns[0].min()
    for c in columns[1:]:
        c = c - c.min()
        if code.max() >= (1 << 62) // (int(c.max()) + 1):
            code = np.unique(code, return_inverse=True)[1].reshape(-1)
        code = code * (int(c.max()) + 1) + c
    return np.unique(code, return_inverse=True)[1].reshape(-1)


def block_documents(source: np.ndarray, doc: np.ndarray, line: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, docs, behind) of each block that decides about a line: the documents of its source that have the block.

    Rows are all lines of whole documents of one or more sources, in order of source, document and line. ``behind``
    tells the blocks that reach from a short line to the wide one after it.
    """
    n = len(line)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    group = _codes(source, doc)
    opens = np.concatenate(([True], group[1:] != group[:-1]))
    at = np.arange(n) + np.cumsum(opens) - 1  # a separator of its own follows each document
    ids = _codes(source, np.unique(line, return_inverse=True)[1].reshape(-1))
    whole = np.full(n + int(opens.sum()), -1, np.int64)
    whole[at] = ids
    ends = np.flatnonzero(whole < 0)
    whole[ends] = ids.max() + 1 + np.arange(len(ends))
    order, prefix = suffix_array(whole)
    rank = np.empty(len(whole), np.int64)
    rank[order] = np.arange(len(whole))
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(opens, place, -1))
    left = np.maximum.accumulate(np.where(wide, place, -1))
    closes = np.concatenate((opens[1:], [True]))
    stop = np.minimum.accumulate(np.where(closes, place, n)[::-1])[::-1]
    right = np.minimum.accumulate(np.where(wide, place, n)[::-1])[::-1]
    alone, tied_left, tied_right = np.flatnonzero(wide), np.flatnonzero(~wide & (left >= start)), np.flatnonzero(~wide & (right <= stop))
    row = np.concatenate((alone, tied_left, tied_right))
    begin = np.concatenate((alone, left[tied_left], tied_right))
    length = np.concatenate((np.ones(len(alone), np.int64), tied_left - left[tied_left] + 1, right[tied_right] - tied_right + 1))
    behind = np.arange(len(row)) >= len(alone) + len(tied_left)
    if not len(row):
        return row, row, behind
    # a block is known by its first suffix and its length; all its occurrences are asked for, as they have the same wide lines
    block = _codes(first_sharing(prefix, rank[at[begin]], length), length, behind.astype(np.int64))
    pairs = np.unique(block * n + group[row])
    docs = np.bincount(pairs // n, minlength=int(block.max()) + 1)
    return row, docs[block], behind


def repeated_lines(df: DataFrame, key: str, sources, text: str, documents: int = 8, least: int = 12, chunk: int = CHUNK, path: str = VOCABULARY) -> DataFrame:
    """(source, id, line_no, line, wide): the occurrences of lines that blocks of at least ``documents`` documents of a source delete."""
    lines = cut(document_lines(df, key, sources, text, least, path), "lines")
    # sources of more lines than a chunk are at most total / chunk; few are broadcast, many go through a shuffle
    large = lines.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select("source", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    split = lines.join(small(large, BROADCAST_ROWS), "source", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    schema = f"source string, id {dict(lines.dtypes)['id']}, line_no long, line long, wide boolean, block long, part int, parts int, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def codes(column: pa.ChunkedArray) -> np.ndarray:
            return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

        def work(tab: pa.Table) -> pa.RecordBatch:
            tab = tab.combine_chunks()
            part = tab["part"].to_numpy().astype(np.int64)
            wide = tab["wide"].to_numpy(zero_copy_only=False).astype(bool)
            row, docs, behind = block_documents(codes(tab["source"]) * (int(part.max()) + 1) + part, codes(tab["id"]), tab["line"].to_numpy(), wide)
            keep = (docs >= documents) | (tab["parts"].to_numpy()[row] > 1)
            row, docs, behind = row[keep], docs[keep], behind[keep]
            line, before, after = (tab[c].fill_null(0).to_numpy()[row] for c in ("line", "before", "after"))
            block = np.where(wide[row], line, np.where(behind, after, before))
            some = tab.take(pa.array(row))
            columns = {n: some[n].combine_chunks() for n in ("source", "id", "line_no", "line", "wide", "part", "parts")} | {"block": pa.array(block), "docs": pa.array(docs)}
            names = ["source", "id", "line_no", "line", "wide", "block", "part", "parts", "docs"]
            return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 50_000:
                continue
            tab = pa.Table.from_batches(held)
            last = (tab["source"][-1].as_py(), tab["part"][-1].as_py())
            open_rows = pc.and_(pc.equal(tab["source"], last[0]), pc.equal(tab["part"], last[1]))
            first = pc.index(open_rows, True).as_py()  # rows come in order, so the open group is at the end
            if first:
                yield work(tab.slice(0, first))
            held, size = tab.slice(first).to_batches(), tab.num_rows - first
        if held and size:
            yield work(pa.Table.from_batches(held))

    arranged = split.select("source", "id", "line_no", "line", "wide", "before", "after", "part", "parts").repartition("source", "part").sortWithinPartitions("source", "part", "id", "line_no")
    found = cut(arranged.mapInArrow(run, schema), "repeated")
    columns = ["source", "id", "line_no", "line", "wide"]
    several = found.filter("parts > 1")
    counts = several.select("source", "block", "part", "docs").distinct().groupBy("source", "block").agg(F.sum("docs").alias("all")).filter(F.col("all") >= documents).select("source", "block")
    kept = found.filter("parts = 1").unionByName(several.join(counts, ["source", "block"], "left_semi"))
    # a short line may be tied to both its neighbours
    return kept.filter("wide").select(columns).unionByName(kept.filter("NOT wide").select(columns).distinct())


def issuers():
    """The issuers of a raw record: the numbers in ``ciks`` without leading zeros."""
    bare = F.transform("metadata.filing.ciks", lambda c: F.regexp_replace(F.trim(c), "^0+(?=.)", ""))
    return F.filter(bare, lambda c: c.isNotNull() & (c != ""))


def record_lines(records: DataFrame, short: bool = False, **options) -> DataFrame:
    """(record_id, line_no): the lines of raw records that an issuer repeats; ``short``: with the short ones of its blocks."""
    found = repeated_lines(records, "record_id", issuers(), "core_text", **options)
    return (found if short else found.filter("wide")).select(F.col("id").alias("record_id"), "line_no").distinct()


def without_lines(df: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(key, text, removed): each text without its repeated lines, and how many were removed. ``found`` has (key, line_no).

    Per document the line numbers fit in a row: they are at most as many as the text has lines. What stands between
    them is sliced out, so the work per text is linear.
    """
    numbers = found.groupBy(key).agg(F.array_sort(F.collect_set(F.col("line_no").cast("int"))).alias("__gone"))
    joined = df.select(key, text).join(numbers, key, "left").withColumn("__lines", F.split(F.col(text), "\n"))
    starts, ends = F.array_insert(F.transform("__gone", lambda k: k + 1), 1, F.lit(0)), F.array_append("__gone", F.size("__lines"))
    left = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("__lines", a + 1, b - a)))
    return joined.select(key, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("removed"))


def _grams(lines: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, identifier) of every run of lines within a run."""
    for a in range(len(lines)):
        h = 0
        for b in range(a, len(lines)):
            h = ((h ^ lines[b]) * 0x9E3779B97F4A7C15F39CC0605CEDC835 + b - a + 1) & (1 << 128) - 1
            h ^= h >> 67
            yield a, b - a + 1, (h >> 64) - (1 << 63)


def repeated_blocks(found: DataFrame, documents: int = 8) -> DataFrame:
    """(source, line, documents, longest): each repeated line with its documents and the longest block that it opens and
    that at least ``documents`` documents of the source have.

    ``found`` has all occurrences of repeated lines, so each line of such a block. Per document they are at most as many
    as its text has lines; documents with the same runs of repeated lines fold before their blocks are written out.
    """
    found = cut(found.select("source", "id", "line_no", "line"), "found")
    pages = found.groupBy("source", "id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("at"))
    # the lines of a document in order; a line that doesn't follow the one before it opens a run
    opens = F.transform("at", lambda x, i: (i == 0) | (x["line_no"] != F.get("at", i - 1)["line_no"] + 1))
    kinds = cut(pages.select("source", F.col("at.line").alias("lines"), opens.alias("opens")).groupBy("source", "lines", "opens").agg(F.count("*").alias("docs")), "kinds")

    def runs(lines: list[int], opens: list[bool]) -> Iterator[list[int]]:
        starts = [k for k, new in enumerate(opens) if new]
        return (lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, lines, opens, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # per document each block counts once; those of one line are counted already
                said = {h: (lines_of[a], n) for lines_of in runs(lines, opens) for a, n, h in _grams(lines_of) if n > 1}
                if said:
                    size = len(said)
                    yield pa.RecordBatch.from_arrays([pa.array([source] * size), pa.array(said.keys(), pa.int64()), pa.array([x[0] for x in said.values()], pa.int64()), pa.array([x[1] for x in said.values()], pa.int64()), pa.array([docs] * size, pa.int64())], names=["source", "block", "line", "n", "docs"])

    blocks = kinds.select("source", "lines", "opens", "docs").mapInArrow(count, "source string, block long, line long, n long, docs long")
    wide = blocks.groupBy("source", "block", "line", "n").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= documents).groupBy("source", "line").agg(F.max("n").alias("n"))
    per = found.groupBy("source", "line").agg(F.countDistinct("id").alias("documents"))
    return per.join(wide, ["source", "line"], "left").select("source", "line", "documents", F.coalesce("n", F.lit(1).cast("long")).alias("longest"))
