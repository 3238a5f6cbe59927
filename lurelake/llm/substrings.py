"""Substring deduplication: documents factored against the blocks of text that other places share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lurelake.llm.common import HASHES, saved, shipped, window_hashes

#: Words of a window; two places share text if a whole window is equal.
WINDOW = 35
#: Words of the grams whose least hash in a window names the window's block.
GRAM = 8
#: Rows of one block that one task compares; blocks with more are dealt into groups of that size.
GROUP_ROWS = 256


def block_names(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers."""
    least, size = grams, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:len(grams) - width + 1], least[width - size:])


def runs(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(block, first window, windows, places) of each run of windows with one block name; places: how
    often the gram that names it stands in the run, since a run may repeat its own windows."""
    if len(words) < window:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    gram = min(GRAM, window)
    width = window - gram + 1
    grams = window_hashes(HASHES.of(words), gram)
    names = block_names(grams, width)
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    n = np.diff(np.r_[first, len(names)])
    size = n + width - 1
    run = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + first[run]
    return names[first], first, n, np.bincount(run, grams[at] == names[first][run]).astype(np.int64)


def reference_runs(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, block, first, n, places) of every run of every document."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, th, text in zip(batch["doc_id"].array, batch["th"].array, batch["text"].tolist()):
                names, first, n, places = runs((text or "").encode().split(), window)
                out.append(pd.DataFrame({"doc_id": d, "th": th, "block": names.view(np.int64),
                                         "first": first.astype(np.int32), "n": n.astype(np.int32),
                                         "places": places.astype(np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "th", "block", "first", "n", "places"])

    return rows.mapInPandas(find, "doc_id long, th long, block long, first int, n int, places int")


def shared_windows(routed: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, block, salt, hot, first, hashes): the windows' numbers of the runs routed to blocks."""
    def hash_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, th, text, own in zip(batch["doc_id"].array, batch["th"].array, batch["text"].tolist(), batch["runs"]):
                h = window_hashes(HASHES.of((text or "").encode().split()), window).view(np.int64)
                out.extend((d, th, r["block"], r["salt"], r["hot"], r["first"], h[r["first"]:r["first"] + r["n"]]) for r in own)
            yield pd.DataFrame(out, columns=["doc_id", "th", "block", "salt", "hot", "first", "hashes"])

    return routed.mapInPandas(hash_runs, "doc_id long, th long, block long, salt int, hot boolean, first int, hashes array<long>")


def _factors(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Compare the runs of whole groups: a factor is a maximal stretch of windows that stand elsewhere.

    Equal windows have equal block names, so they meet here.  Of hot blocks, which are dealt into several
    groups, windows met once here are handed on with their number (``count`` 1), and of those met
    often one row with count 2.
    """
    sizes = group["hashes"].map(len).to_numpy()
    h = np.concatenate(group["hashes"].to_list()) if len(group) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(group)), sizes)
    start = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + group["first"].to_numpy()[row]
    # A number of its own for each group, so that no other group's windows count.
    groups = group.groupby(["block", "salt"], sort=False).ngroup().to_numpy()[row]
    order = np.lexsort((h, groups))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (groups[order][1:] != groups[order][:-1])][:len(h)]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    count = np.bincount(which, minlength=1)[which] if len(h) else np.empty(0, np.int64)
    double = count > 1
    edge = np.flatnonzero(double & ~np.r_[False, double[:-1] & (row[1:] == row[:-1])][:len(h)])
    end = np.flatnonzero(double & ~np.r_[double[1:] & (row[1:] == row[:-1]), False][:len(h)])
    pick = lambda i, first, last, number, n: pd.DataFrame({
        "doc_id": group["doc_id"].array[row[i]], "th": group["th"].array[row[i]], "first": first, "last": last,
        "number": number, "count": n})
    parts = [pick(edge, start[edge], start[end] + window, pd.array([None] * len(edge), "Int64"), 0)]
    hot = group["hot"].to_numpy(dtype=bool)[row]
    single = np.flatnonzero(hot & ~double)
    often = np.flatnonzero(hot & double)
    often = often[np.unique(which[often], return_index=True)[1]]
    for i, n in ((single, 1), (often, 2)):
        parts.append(pick(i, start[i], start[i] + window, pd.array(h[i], "Int64"), n))
    return pd.concat([p for p in parts if len(p)] or parts[:1])


def compare_runs(hashed: DataFrame, window: int) -> DataFrame:
    """Factors, and what is left of hot blocks, group after group of rows sorted by group."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last group of a batch may go on in the next one
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (batch["block"] == batch["block"].iloc[-1]) & (batch["salt"] == batch["salt"].iloc[-1]) \
                if len(batch) else pd.Series([], dtype=bool)
            held, whole = batch[last].reset_index(drop=True), batch[~last].reset_index(drop=True)
            if len(whole):
                yield _factors(whole, window)
        if held is not None and len(held):
            yield _factors(held, window)

    dealt = hashed.repartition("block", "salt").sortWithinPartitions("block", "salt")
    return dealt.mapInPandas(compare, "doc_id long, th long, first int, last int, number long, count int")


def repeated_spans(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, spans): for each document with repeated text the word ranges [first, last) to remove; th is
    ``xxhash64(text)``.

    1. The reference's blocks are indexed by name: a window's name is the least hash of its 8-word grams, so
       equal windows lie in blocks of one name.  Names met once drop out (their windows are unique).
    2. Documents are routed to every block they share a name with, and factored greedily: a factor goes on
       as long as the next window stands elsewhere in the block too.  Windows are compared whole, also at
       a factor's ends, so a factor has at least ``window`` words.
    Blocks with many rows are dealt into groups; windows met once in a group are then counted over all.
    """
    shipped(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    index = saved(reference_runs(rows, window), "runs")
    names = index.groupBy("block").agg(F.sum("places").alias("c")).where("c > 1")
    salt = F.pmod(F.hash("doc_id", "th", "first"), F.ceil(F.col("c") / GROUP_ROWS).cast("int"))
    own = index.join(names, "block").select(
        "doc_id", "th", F.struct("block", "first", "n", salt.alias("salt"), (F.col("c") > GROUP_ROWS).alias("hot")).alias("run"))
    routes = own.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list("run").alias("runs"))
    # Of rows with equal keys and texts one carries the runs of all, which the list has once for each.
    texts = rows.dropDuplicates(["doc_id", "th"])
    routed = texts.join(routes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select(
        "doc_id", "th", "text", "runs")
    found = saved(compare_runs(shared_windows(routed, window), window), "factors")
    left = found.where("count > 0")
    often = left.groupBy("number").agg(F.sum("count").alias("c")).where("c > 1")
    late = left.where("count = 1").join(often, "number", "left_semi")
    spans = found.where("count = 0").union(late.select(found.columns))
    return spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove_repeats(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): every row's words (between ASCII white space) without those that a
    window of ``window`` words covers whose words also start at another place, the same document included.

    Null and empty texts have no words.  Repeated rows are places of their own: all their windows repeat.
    Texts shorter than a window keep their words.  Other columns are left out.
    """
    spans = repeated_spans(df, window, key, text).select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, text, own in zip(batch["doc_id"].array, batch["text"].tolist(), batch["spans"]):
                words = (text or "").encode().split()
                n = len(words)
                if own is not None and len(own):
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, [s["first"] for s in own], 1)
                    np.add.at(gone, [s["last"] for s in own], -1)
                    keep = np.cumsum(gone)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                out.append((d, n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    out = both.select("doc_id", "text", "spans").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc_id", key)
