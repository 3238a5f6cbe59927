"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from string import ascii_letters, ascii_lowercase

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lurelake.llm.common import saved, shipped

MAX_TOKENS = 2048
#: The id that ends a document.
END = bytes(4)
#: Pieces of one length that one task numbers.
RANK_ROWS = 4096


#: Encoded whole and stretch by stretch once, to see whether a tokenizer drops white space.
PROBE = "Ab, c\td  don't\n\n12 3.5 \u00e9\u6f22 x_y "


#: Each ASCII letter in both cases, to see whether a tokenizer tells them apart.
LETTERS = "The quick BROWN fox JUMPS over the lazy DOG, pack my BOX with five dozen LIQUOR jugs"
#: Marks that may follow a word's last letter; those of contractions are left out.
MARKS = b".,;:!?$%&*#@)]}\"-"


class WordTokens(dict):
    """Token ids (four bytes each) of the stretches between white space, kept for those met last.

    For tokenizers that drop white space (``by_word``) a text's ids are those of its stretches, one after the
    other; for all others whole texts are encoded.  A stretch that is not known is parted: into its stem, up to its
    last letter, in lower case where the tokenizer does not tell cases apart (``folds``), and the marks behind it,
    where the tokenizer always parts those from letters.  Stems that are looked up stay for another ``STEMS`` of
    them.
    """

    LIMIT, STEMS = 300_000, 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = self.encoded([w.decode() for w in PROBE.encode().split()])
        self.by_word = b"".join(parts) == self.encoded([PROBE])[0]
        one, other, lower = self.encoded([LETTERS, LETTERS.swapcase(), LETTERS.lower()])
        self.folds = one == other == lower
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain_added = any(a.strip(MARKS + ascii_lowercase.encode()) == b"" for a in self.added)
        self.loose: dict[bytes, bool] = {}
        self.stems: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def is_loose(self, marks: bytes) -> bool:
        """Whether the tokenizer parts the marks from any letter before them."""
        if marks not in self.loose:
            cut = self.tokenizer.pre_tokenizer
            self.loose[marks] = cut is not None and all(
                any(start == 1 for _, (start, _) in cut.pre_tokenize_str(c + marks.decode())) for c in ascii_letters)
        return self.loose[marks]

    def parted(self, word: bytes) -> tuple[bytes, bytes]:
        stem = word.rstrip(MARKS)
        if not stem.isalpha() or self.plain_added:
            if not stem[-1:].isalpha() or any(a in word.lower() for a in self.added):
                return word, b""
        marks = word[len(stem):]
        if marks and not self.is_loose(marks):
            return word, b""
        return stem.lower() if self.folds else stem, marks

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = words
        new = [(w, *self.parted(w)) for w in new]
        wanted = {part for _, *parts in new for part in parts if part}
        if len(self.stems) + len(wanted) > self.STEMS:
            self.before, self.stems = self.stems, {}
        stems, before = self.stems, self.before
        missing = []
        for part in wanted:
            if part not in stems:
                if part in before:
                    stems[part] = before[part]
                else:
                    missing.append(part)
        stems.update(zip(missing, self.encoded([w.decode() for w in missing])))
        self.update((w, stems[stem] + stems[marks] if marks else stems[stem]) for w, stem, marks in new)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.encoded(texts)
        words = [text.encode().split() for text in texts]
        self.learn(set(chain.from_iterable(words)))
        return [b"".join(map(self.__getitem__, own)) for own in words]

    def forget(self) -> None:
        """Spark uses a Python worker again for other stages."""
        self.clear()
        self.stems, self.before = {}, {}


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    """One cache for a Python worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def token_pieces(df: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, key: str = "doc_id",
                 text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): every text's ids, then id 0, cut after each
    ``max_tokens``.  Whole texts are encoded.  Null and empty texts have id 0 alone."""
    schema = f"key {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _tokens(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                out = []
                for k, ids in zip(part["key"].tolist(), known.ids([x or "" for x in part["text"].tolist()])):
                    ids += END
                    for piece, start in enumerate(range(0, len(ids) // 4, max_tokens)):
                        own = ids[4 * start:4 * (start + max_tokens)]
                        out.append((k, piece, start, len(own) // 4, zlib.crc32(own), own))
                frame = pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids_crc32", "ids"])
                yield frame if keep_ids else frame.drop(columns="ids")
        known.forget()

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shipped(df.sparkSession)
    return rows.mapInPandas(encode, schema + (", ids binary" if keep_ids else ""))


def fullest_bin(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest item and those others that leave the least slack beside it.

    Subset sums are bits of a whole number; each length comes in groups of 1, 2, 4, ... items, long
    ones first, and the groups are walked back to find the combination.
    """
    top = max(length for length, n in counts.items() if n)
    room, reach, steps = capacity - top, 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left = min(counts[length] - (length == top), room // length)
        group = 1
        while left > 0 and not reach >> room & 1:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            left, group = left - take, group * 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {top: 1}
    for length, take, before in reversed(steps):
        if best and not before >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(combination, times) until no item is left.  The fullest combination stays the fullest as long as
    its items last, so it is repeated; each step uses up a length, hence at most ``capacity`` steps."""
    counts = {length: n for length, n in counts.items() if n}
    while counts:
        chosen = fullest_bin(counts, capacity)
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        yield chosen, times


def place_pieces(pieces: DataFrame, capacity: int = MAX_TOKENS, length: str = "length",
                 order: tuple[str, ...] = ("key", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces of lengths 1 to ``capacity``; sequences have no gaps.

    The plan is made on the driver from the count of each length: at most ``capacity`` numbers, whatever
    the number of pieces.  A piece's place follows from its rank among those of its length; a length's
    pieces are ranked in hash buckets of some ``RANK_ROWS`` rows, so no length is in one task.  The
    bucket and place tables are bounded by ``capacity`` too and are broadcast.  Pieces should be a
    written table, as they are read three times.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    ranges, used, base = [], dict.fromkeys(counts, 0), 0
    for chosen, times in minimum_bin_slack(counts, capacity):
        at = 0
        for x, n in sorted(chosen.items(), reverse=True):
            ranges.append((x, used[x], used[x] + n * times, n, base, at))
            used[x] += n * times
            at += x * n
        base += times
    places = spark.createDataFrame(ranges, f"`{length}` long, _from long, _to long, _per long, _base long, _at long")
    salts = spark.createDataFrame([(x, -(-n // RANK_ROWS)) for x, n in counts.items()], f"`{length}` long, _salts long")
    rows = pieces.join(F.broadcast(salts), length).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(length, "_salt").count().select(
        length, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(length, "_salt").orderBy(*order)
    ranked = rows.join(starts, [length, "_salt"]).withColumn(
        "_rank", F.row_number().over(within) - 1 + F.col("_start"))
    p = F.broadcast(places).alias("p")
    hit = (F.col(f"r.{length}") == F.col(f"p.{length}")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    local = F.col("_rank") - F.col("_from")
    return ranked.alias("r").join(p, hit).select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("_base") + F.floor(local / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + local % F.col("_per") * F.col(f"r.{length}")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, key: str = "doc_id",
                   text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cut every document into pieces and pack all of them into sequences of at most ``max_tokens``.

    Null key: kept.  Repeated keys or rows: each row is packed.  Empty table: empty result.  Other
    columns are left out.
    """
    pieces = saved(token_pieces(df, tokenizer_path, max_tokens, key, text, keep_ids), "pieces")
    placed = place_pieces(pieces, max_tokens, order=("key", "piece", "ids_crc32"))
    return placed.withColumnRenamed("key", key)
