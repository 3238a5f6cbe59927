"""N-gram Jaccard join: subsets of small sets, inverted lists of large ones."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurelake.llm.common import HASHES, forget_words, saved, shipped, smallest_reachable, window_hashes, xxh3_64_intdigest

#: A link needs 100 * intersection >= PERCENT * union of the sets of word shingles.
WORDS, PERCENT = 4, 85
#: Shingles that most documents share come last in every list order; so many at most are told to the
#: tasks (8 bytes each).  Which ones they are changes the cost alone, never the links.
COMMON, COMMON_FROM = 100_000, 64
#: The share of the hash range in which common shingles are counted: that of the lists' prefixes.
COUNTED = 0.18
#: Sizes for which subsets are considered at all; above them there are too many.
LARGEST_SMALL = 20
#: The end of the range in which shingles are counted.
BOUND = np.uint64(int(COUNTED * (1 << 64)))
#: Bits of the number of slots at most, in which the elements of large sets are counted.
MOST_SLOTS = 12
#: Elements of the sets that a task holds while it tests pairs.
HELD = 1 << 20
#: Hash slots of shingles; the broadcast table of those in use has no more rows.
USED_SLOTS = 1 << 20


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct numbers of the runs of ``words`` words; of a shorter text, of all its words."""
    return shingles_of((text or "").encode(), words)


def shingles_of(text: bytes, words: int) -> np.ndarray:
    own = text.lower().split()
    if not own:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(HASHES.of(own), min(words, len(own)), 0xA24BAED4963EE407 + 2 * min(words, len(own))))


def set_number(s: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64))


def least_overlap(a, b, percent: int):
    """The least intersection of linked sets of sizes a and b: percent (a + b) / (100 + percent), rounded up."""
    return -(-percent * (a + b) // (100 + percent))


def most_missing(n: int, percent: int) -> int:
    """So many of a set's elements at most may be missing in a linked set."""
    return n - -(-percent * n // 100)


def subsets(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in range(most_missing(n, percent) + 1))


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """Sets below the boundary enumerate subsets.  A subset costs one key; a prefix entry costs a key and
    a scan of its list, of mean length ``list_length``.  The boundary has the least sum over all sets."""
    def cost(x: int) -> float:
        return sum(c * (subsets(n, percent) if n < x else (most_missing(n, percent) + 1) * (1 + list_length))
                   for n, c in sizes.items())

    return min(range(1, LARGEST_SMALL + 2), key=lambda x: (cost(x), x))


def ordered_prefix(s: np.ndarray, common: np.ndarray, percent: int, n: int | None = None) -> np.ndarray:
    """The first most_missing + 1 elements in the order (common last, by number): of linked sets at least
    one element is in both prefixes.  ``s``: the set, or the ``head`` of a set of ``n`` elements."""
    late = np.zeros(len(s), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~late], s[late]])[:most_missing(len(s) if n is None else n, percent) + 1]


def head(s: np.ndarray, percent: int) -> np.ndarray:
    """So many of the least numbers that they hold the ordered prefix, whichever of those counted are common."""
    return s[:int(np.searchsorted(s, BOUND)) + most_missing(len(s), percent) + 1]


def slot_counts(s: np.ndarray) -> bytes:
    """How many elements fall in each of 2^k slots, one to two on average; empty where a count exceeds a byte.

    Slots are the last bits, so halves of a table add up to that of half as many slots."""
    slots = 1 << max(6, min(MOST_SLOTS, len(s).bit_length() - 1))
    counts = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> int | None:
    """No more elements than these can be in both sets: the sum of the lesser counts.  None: not known."""
    if not a or not b:
        return None
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, least).sum(0), y.reshape(-1, least).sum(0)).sum())


def set_classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, set, head, slots): the size of each row's set, a number that equal sets share (of size 0: null),
    ``head`` of the set (of sets below LARGEST_SMALL + 1: all of it) and its ``slot_counts``.  The only pass over
    the texts but for those of pairs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                sets = [shingles(t, words) for t in part["text"].tolist()]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "n": [len(s) for s in sets],
                    "set": pd.array([set_number(s) if len(s) else None for s in sets], "Int64"),
                    "head": [(s if len(s) <= LARGEST_SMALL else head(s, percent)).view(np.int64) for s in sets],
                    "slots": [slot_counts(s) if len(s) else b"" for s in sets]})
        forget_words()

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, set long, head array<long>, slots binary")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, float]:
    """The numbers of the most frequent shingles, sorted, and the mean list length; see COMMON."""
    seen = sets.select(F.explode("head").alias("s")).where((F.col("s") >= 0) & (F.col("s") < int(BOUND)))
    many = saved(seen.groupBy("s").count().where(F.col("count") > 1), "list-lengths")
    top = many.where(F.col("count") > COMMON_FROM).orderBy(F.desc("count"), "s").limit(COMMON).select("s").toPandas()
    mean = many.agg(F.avg("count")).first()[0] or 1.0
    return np.sort(top["s"].to_numpy(dtype=np.int64).view(np.uint64)), float(mean)


def postings(sets: DataFrame, percent: int, boundary: int, common: np.ndarray) -> DataFrame:
    """(s, set, n, i): the prefixes of sets that may meet a set of the boundary's size or more."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                own = [ordered_prefix(np.asarray(h).view(np.uint64), shared.value, percent, n)
                       for h, n in zip(part["head"], part["n"])]
                sizes = [len(p) for p in own]
                yield pd.DataFrame({"s": np.concatenate(own).view(np.int64), "set": np.repeat(part["set"].to_numpy(), sizes),
                                    "n": np.repeat(part["n"].to_numpy(), sizes),
                                    "i": np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])})

    rows = sets.where((F.col("n") > 0) & (100 * F.col("n") >= percent * boundary)).select("set", "n", "head")
    return rows.mapInPandas(run, "s long, set long, n long, i int")


def subset_keys(sets: DataFrame, percent: int, boundary: int) -> DataFrame:
    """(s, set, n, i): numbers of the subsets that a set below the boundary can share with a linked set.  The
    intersection of linked sets is such a subset of both."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = [(set_number(np.array(c, np.uint64)), number, n, 0)
                        for number, n, s in batch.iloc[at:at + 512][["set", "n", "head"]].itertuples(index=False)
                        for d in range(most_missing(n, percent) + 1)
                        for c in combinations(np.asarray(s).view(np.uint64), n - d)]
                yield pd.DataFrame(rows, columns=["s", "set", "n", "i"])

    rows = sets.where((F.col("n") > 0) & (F.col("n") < boundary)).select("set", "n", "head")
    return rows.mapInPandas(run, "s long, set long, n long, i int")


def _close(a: str, b: str, percent: int):
    """Sizes and places in the lists allow a link: what comes before the first common element is lost."""
    least = F.ceil(percent * (F.col(f"{a}n") + F.col(f"{b}n")) / (100 + percent))
    return (F.col(f"{a}i") + least <= F.col(f"{a}n")) & (F.col(f"{b}i") + least <= F.col(f"{b}n"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs of set numbers (a, b) whose sets are linked, by their whole texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    holders = classes.join(wanted, "set").select("set", "rep")
    texts = docs.join(holders, docs["doc_id"] == holders["rep"]).select("set", "text")
    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0

        def get(number, text):
            nonlocal size
            if number not in held:
                held[number] = shingles_of(text.as_buffer().to_pybytes(), words)
                size += len(held[number])
                while size > HELD and len(held) > 2:
                    size -= len(held.popitem(last=False)[1])
            return held[number]

        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ta"], batch["tb"]):
                x, y = get(a, ta), get(b, tb)
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        forget_words()

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(key, n_shingles, n_links, component_id) of every row: the links of documents whose sets of word
    shingles have a Jaccard similarity of ``percent`` or more, and the least key they reach.

    Equal sets are one class.  Classes below the boundary, which costs decide, meet in equal subsets;
    the others in inverted lists of prefixes.  All members of a list whose sizes and places of the common
    shingle allow a link are tested, so no link between classes is left out; documents that merely share a
    passage are kept apart by the order, size and place of its shingles.  n_links counts the links of the
    row's class with all other classes: as many tests as a group of near copies has pairs.

    Null and empty texts: size 0, no links, their own component.  Rows with equal keys are one document.
    Rows with a null key that link to none with a key have a null component.  Other columns are left out.
    """
    shipped(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = saved(set_classes(docs, words, percent), "sets")
    classes = sets.where("n > 0").groupBy("set", "n").agg(F.min("doc_id").alias("rep"))
    sizes = {r[0]: r[1] for r in classes.where(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()}
    common, mean = common_shingles(sets)
    boundary = choose_boundary(sizes, mean, percent)

    lists = [subset_keys(sets, percent, boundary), postings(sets, percent, boundary, common)]
    links = [_linked_in_lists(x, sets, classes, docs, words, percent) for x in lists]
    links = saved(links[0].union(links[1]).distinct(), "links")
    names = classes.select("set", "rep")
    edges = links.join(names.select(F.col("set").alias("a"), F.col("rep").alias("ra")), "a").join(
        names.select(F.col("set").alias("b"), F.col("rep").alias("rb")), "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = smallest_reachable(df.sparkSession, edges, "jaccard-edges")
    degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("n_links"))
    ends = names.join(roots, F.col("rep") == F.col("id"), "left").join(degree, "set", "left").select(
        "set", F.coalesce("root", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sets.select("doc_id", "n", "set").join(ends, "set", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked_in_lists(lists: DataFrame, sets: DataFrame, classes: DataFrame, docs: DataFrame, words: int,
                     percent: int) -> DataFrame:
    """Every linked pair (a < b) of sets that stand in one list: all pairs whose sizes, places and slots allow a link
    are tested.  Lists of one set have no pair; they are known by their least and greatest set and go first."""
    lists = lists.select("s", "set", "n", "i")
    shared = saved(lists.groupBy("s").agg(F.min("set").alias("least"), F.max("set").alias("most")).where(
        "least <> most").select("s"), "lists-shared")
    used = F.broadcast(shared.select(F.pmod("s", F.lit(USED_SLOTS)).alias("slot")).distinct())  # USED_SLOTS rows at most
    own = lists.withColumn("slot", F.pmod("s", F.lit(USED_SLOTS))).join(used, "slot", "left_semi").drop("slot")
    own = saved(own.groupBy("s", "set", "n").agg(F.min("i").alias("i")), "lists")
    other = own.select("s", F.col("set").alias("oset"), F.col("n").alias("on"), F.col("i").alias("oi"))
    met = own.join(other, "s").where((F.col("set") < F.col("oset")) & _close("", "o", percent))
    pairs = saved(met.select(F.col("set").alias("a"), F.col("oset").alias("b")).distinct(), "pairs")
    return verified(saved(_by_slots(pairs, sets, percent), "pairs-left"), classes, docs, words, percent)


def _by_slots(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set numbers without those whose slot counts allow no link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    facts = saved(sets.join(ends, "set", "left_semi").groupBy("set", "n").agg(F.first("slots").alias("slots")), "pair-slots")
    both = pairs.join(facts.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("slots").alias("sa")), "a").join(
        facts.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("slots").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, nb, sa, sb in zip(batch["na"].to_pylist(), batch["nb"].to_pylist(), batch["sa"], batch["sb"]):
                most = most_shared(sa.as_buffer(), sb.as_buffer())
                ok.append(most is None or most >= least_overlap(na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()
