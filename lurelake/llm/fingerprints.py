"""Document fingerprints by consistent weighted sampling of word counts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lurelake.llm.common import SPACE

#: Samples of a signature; the standard error of a likeness p is sqrt(p (1 - p) / SAMPLES).
SAMPLES = 24
#: Equally likely values that stand for a gamma variate's distribution.
GRID = 512
#: Steps of a level: beta and the place within a level are kept in 24 bits.
PLACES = 1 << 24
#: Characters of text that one task fingerprints, so that its words' counts fit its memory; beyond the
#: greatest number of tasks they get more (and may spill).
TASK_CHARS, MOST_TASKS = 4_000_000, 20_000
#: Documents in a row, by id, that are worked on together.
RUN = 64


def _quantiles(of: Callable[[float], float], n: int = GRID) -> Column:
    """``of`` a gamma(2, 1) variate at n equally likely values, as a literal array."""
    values = []
    for k in range(n):
        p, low, high = (k + 0.5) / n, 0.0, 60.0
        for _ in range(80):  # the distribution function is 1 - exp(-x) (1 + x)
            mid = (low + high) / 2
            low, high = (mid, high) if 1 - math.exp(-mid) * (1 + mid) < p else (low, mid)
        values.append(f"{of(low):.12g}")
    return F.split(F.lit(",".join(values)), ",").cast("array<double>")


def sample(i: int, tables: tuple[Column, Column, Column]) -> Column:
    """The i-th draw of a term (h, lw: log of its count): 38 bits of the logarithm of Ioffe's a, then 24
    bits that name the pair (term, level).  The least of a document's terms is its i-th sample.

    r and c are gamma(2, 1) variates, read off their quantiles; beta is uniform.  With
    x = ln w / r + beta, the level is floor(x) and ln a = ln c - ln w - r (1 - x + floor(x)), between
    -60 and 60; x is kept in 24 binary places.
    """
    g = F.xxhash64(F.col("h").bitwiseXOR(F.lit(i * 0x5851F42D4C957F2D & (1 << 62) - 1)))
    at = g.bitwiseAND(F.lit(GRID - 1)).cast("int")
    r, inverse = F.get(tables[0], at), F.get(tables[1], at)
    ln_c = F.get(tables[2], F.shiftright(g, 12).bitwiseAND(F.lit(GRID - 1)).cast("int"))
    x = (F.col("lw") * inverse).cast("long") + F.shiftright(g, 24).bitwiseAND(F.lit(PLACES - 1))
    left = (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES - 1))).cast("double")
    rank = ((ln_c - F.col("lw") - r * left) * float(1 << 31)).cast("long") + F.lit(1 << 37)
    name = F.xxhash64(F.col("h") + F.shiftright(x, 24)).bitwiseAND(F.lit(0xFFFFFF))
    # A branch of its own keeps the code of each sample in a method of its own.
    return F.when(F.col("lw") >= 0, F.shiftleft(rank, 24).bitwiseOR(name))


def signatures(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """One row per distinct ``keys`` with ``sig``, the samples of the text's words with their counts; a
    text without words has the empty word.  If df is dealt by some of the keys, nothing is shuffled."""
    tables = (_quantiles(lambda x: x / PLACES), _quantiles(lambda x: PLACES / x), _quantiles(math.log))
    body = F.regexp_replace(F.col(text), f"^{SPACE}+|{SPACE}+$", "")
    words = df.select(*keys, F.explode_outer(F.split(body, SPACE + "+")).alias("w"))
    # Shifted right, so that adding a level to a term's number cannot overflow.
    terms = words.groupBy(*keys, F.shiftright(F.xxhash64("w"), 1).alias("h")).count()
    terms = terms.select(*keys, "h", F.log(F.col("count").cast("double")).alias("lw"))
    mins = terms.groupBy(*keys).agg(*[F.min(sample(i, tables)).alias(f"_s{i}") for i in range(samples)])
    return mins.select(*keys, F.array(*[
        F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFF)).cast("int") for i in range(samples)]).alias("sig"))


def signature_text(sig: Column) -> Column:
    """Six hexadecimal digits for each sample."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: it estimates the generalised Jaccard similarity of the counts."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def with_successors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(run, key, _h, text, guest): rows cut into runs of some ``RUN`` consecutive keys.  Each run ends
    with a guest, the first row of the next run (after the last: of the first), so that every row's
    successor is in its run.  Equal keys are ordered by their texts' hashes; null keys come first."""
    low, high, n, size = df.agg(F.min(key), F.max(key), F.count("*"), F.sum(F.length(text))).first()
    low, high = low if low is not None else 0, high if high is not None else 0
    width = max(1, (high - low + 1) * RUN // max(1, n))
    first = low // width if low >= 0 else -(-low // width)
    run = F.coalesce(F.expr(f"`{key}` div {width}L"), F.lit(first - 1)).cast("long")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(run.alias("run"), F.col(key).alias("key"), F.xxhash64(body).alias("_h"),
                     body.alias("text"))
    heads = rows.groupBy("run").agg(F.min(F.struct("key", "_h", "text")).alias("head"))
    # The run before each run: within blocks of runs, then over the blocks' ends.
    known = rows.select("run").distinct().withColumn("block", F.expr("run div 4096"))
    inside = Window.partitionBy("block").orderBy("run")
    known = known.select("run", "block", F.lag("run").over(inside).alias("before"))
    ends = known.groupBy("block").agg(F.max("run").alias("end"))
    over = Window.orderBy("block")
    ends = ends.select("block", F.lag("end").over(over).alias("end_before"),
                       F.max("end").over(over.rowsBetween(Window.unboundedPreceding,
                                                          Window.unboundedFollowing)).alias("last"))
    before = known.join(ends, "block").select(
        "run", F.coalesce("before", "end_before", "last").alias("host"))
    guests = heads.join(before, "run").select(
        F.col("host").alias("run"), "head.key", "head._h", "head.text", F.lit(True).alias("guest"))
    tasks = min(MOST_TASKS, 1 + (size or 0) // TASK_CHARS)
    return rows.withColumn("guest", F.lit(False)).union(guests).repartition(tasks, "run")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text",
                      samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last quarter of its characters replaced by the
    first as many of the next document) and their likeness; see ``fingerprint_documents`` for texts alone.

    One shuffle carries the texts, cut into runs of consecutive keys; everything after it stays within a
    run.  Null text: empty.  Empty texts: the fingerprint of the empty word.  Repeated keys:
    a row each, ordered by their texts.  A single row is its own successor.
    """
    rows = with_successors(df, key, text)
    order = Window.partitionBy("run").orderBy("guest", F.col("key").asc_nulls_first(), "_h")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select(
        "run", "guest", "key", "_h", "text", F.row_number().over(order).alias("_at"),
        n.cast("long").alias("n_chars"),
        F.when(~F.col("guest"), F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"),
                                         F.substring(F.lead("text").over(order), F.lit(1), cut))).alias("edited"))
    rows = rows.withColumn("edited", F.coalesce("edited", F.lit("")))
    rows = rows.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    keys = ["run", "_at", "key", "guest", "n_chars", "sha"]
    sides = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), "text"),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s"))
    sides = sides.select(*keys, "s.side", "s.text").where("not (guest and side = 1)")
    pairs = signatures(sides, [*keys, "side"], "text", samples).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("sig"),
        F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("edited_sig"))
    after = Window.partitionBy("run").orderBy("_at")
    pairs = pairs.withColumn("next_sig", F.lead("sig").over(after)).where("not guest")
    return pairs.select(
        F.col("key").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        signature_text(F.col("sig")).alias("fingerprint"),
        signature_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text",
                          samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint) of every row with a distinct key and text."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    return signatures(rows, ["key", "_h"], "text", samples).select(
        F.col("key").alias(key), signature_text(F.col("sig")).alias("fingerprint"))
