"""Problem 6: documents that hold passages of evaluation items.

The items are indexed by word: postings of BM25 impacts in blocks that know their greatest impact. Every document is
cut into overlapping passages of twice ``run`` words, so that each run of ``run`` words lies in one of them, and every
passage is a query, answered by block-max WAND. Impacts are divided by the least score that any run of the item
itself can reach; an item of score 1 or more is retrieved, so no passage with a whole run of an item is ever missed.
Retrieved items are verified word by word. Words that no item has end a passage, as no run holds one.

The index is built on the driver, in blocks of at most ``index_chars`` characters of items, so what is broadcast is
bounded however many items there are; each block is one pass over the documents.

Defined results: null and empty texts and items of fewer than ``run`` words match nothing; every copy of a document
counts; an item counts once per document; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import VOCABULARY, canonical

_word = re.compile(r"[^\W_]+")
BLOCK = 32


def words(text: str, form_of) -> list[str]:
    return _word.findall(form_of(text).lower())


class ItemIndex:
    """BM25 inverted index of items with block-max postings; impacts are scaled so that 1 is each item's threshold."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int, k1: float = 1.2, b: float = 0.75) -> None:
        items = [(i, w) for i, w in items if len(w) >= run]
        self.run, self.ids = run, [i for i, _ in items]
        mean = sum(len(w) for _, w in items) / max(1, len(items))
        seen = Counter(t for _, w in items for t in set(w))
        postings: dict[str, list[tuple[int, float]]] = {}
        self.runs: list[set[tuple[str, ...]]] = []
        for n, (_, w) in enumerate(items):
            tf = Counter(w)
            impact = {t: math.log(1 + (len(items) - seen[t] + 0.5) / (seen[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(w) / mean)) for t, f in tf.items()}
            runs = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
            least = min(sum(impact[t] for t in set(r)) for r in runs)
            self.runs.append(runs)
            for t, v in impact.items():
                postings.setdefault(t, []).append((n, v / least + 1e-12))
        #: term -> (items in order, impacts, last item of each block, greatest impact of each block)
        self.postings = {}
        for t, row in postings.items():
            ns, vs = [n for n, _ in row], [v for _, v in row]
            self.postings[t] = (ns, vs, ns[BLOCK - 1 :: BLOCK] + ([ns[-1]] if len(ns) % BLOCK else []), [max(vs[k : k + BLOCK]) for k in range(0, len(vs), BLOCK)])
        #: term -> the greatest impact it has in any item
        self.most = {t: max(p[3]) for t, p in self.postings.items()}

    def search(self, terms) -> list[int]:
        """Items whose score for these words is 1 or more, by block-max WAND."""
        lists = [[0, *self.postings[t], self.most[t]] for t in set(terms) if t in self.postings]  # cursor first
        found = []
        while lists:
            lists.sort(key=lambda p: p[1][p[0]])
            bound, pivot = 0.0, -1
            for k, p in enumerate(lists):
                bound += p[5]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            # the blocks that hold the pivot item bound its score more closely
            reach, close = 1 << 60, 0.0
            for p in lists[: pivot + 1]:
                k = bisect_left(p[3], item)
                if k < len(p[3]):  # else this list has ended before the item
                    close += p[4][k]
                    reach = min(reach, p[3][k])
            if close >= 1 - 1e-9:
                if lists[0][1][lists[0][0]] == item:
                    if sum(p[2][p[0]] for p in lists[: pivot + 1]) >= 1 - 1e-9:
                        found.append(item)
                    target = item + 1
                else:
                    target = item
            else:  # no item up to the nearest block's end can score enough with these lists
                after = lists[pivot + 1][1][lists[pivot + 1][0]] if pivot + 1 < len(lists) else 1 << 60
                target = max(item + 1, min(reach + 1, after)) if reach >= item else item + 1
            for p in lists[: pivot + 1]:
                p[0] = bisect_left(p[1], target, p[0])
            lists = [p for p in lists if p[0] < len(p[1])]
        return found

    def leaked(self, w: list[str]) -> set[int]:
        """The ids of the items that share a run of words with a text of these words."""
        run, most = self.run, self.most
        out: set[int] = set()
        score, first = [most.get(t) for t in w], 0
        while first <= len(w) - run:
            # a run of an item has only indexed words, so passages are cut from stretches of these
            stop = next((k for k in range(first + run - 1, first - 1, -1) if score[k] is None), None)
            if stop is not None:
                first = stop + 1
                continue
            end = first + run
            while end < len(w) and score[end] is not None:
                end += 1
            sums = [0.0, *accumulate(score[first:end])]
            for at in range(first, max(first + 1, end - run + 1), run):
                last = min(at + 2 * run, end)
                if sums[last - first] - sums[at - first] < 1 - 1e-6:
                    continue
                passage = w[at:last]
                hits = self.search(passage)
                if hits:
                    runs = [tuple(passage[k : k + run]) for k in range(len(passage) - run + 1)]
                    out.update(self.ids[n] for n in hits if self.ids[n] not in out and any(r in self.runs[n] for r in runs))
            first = end + 1
        return out


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12, index_chars: int = 8_000_000, path: str = VOCABULARY, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item): documents and the items of which they hold at least ``run`` consecutive words."""
    spark = documents.sparkSession
    held = items.select(F.col(item).alias("item"), F.col(item_text).alias("t")).filter("t IS NOT NULL AND item IS NOT NULL")
    size = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // index_chars))
    form_of = canonical(path)
    source = documents.select(F.col(key), F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    kinds = f"`{key}` {dict(source.dtypes)[key]}, `{item}` {dict(held.dtypes)['item']}"
    out = None
    for block in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # at most about index_chars characters
        index = spark.sparkContext.broadcast(ItemIndex([(r.item, words(r.t, form_of)) for r in sorted(rows, key=lambda r: r.item)], run))

        def make(index=index):
            form_of, has = canonical(path), index.value

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                docs, found = [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for i in sorted(has.leaked(words(t, form_of))):
                        docs.append(k)
                        found.append(i)
                return pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(found, pa.int64())], names=[key, item])

            return step

        part = map_batches(source, make, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def leak_report(found: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, documents): every item with the number of documents that hold a passage of it."""
    counted = found.groupBy(item).agg(F.count("*").alias("documents"))
    return items.select(item).join(counted, item, "left").select(item, F.coalesce("documents", F.lit(0)).alias("documents"))
