"""Findings of round 3: caches that end with a task, one pass for Jaccard sets, words read once for the latent space, stems."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lurelake.llm import decontamination, jaccard, packing, quality, queries
from lurelake.llm.common import HASHES, WordHashes
from tests.llm.test_corpus import ODD, frame, prose


def test_caches_are_empty_after_a_task(spark):
    """A Python worker serves many stages; what one kept must not add up with the others'."""
    docs = frame(spark, [prose(random.Random(1), 50)] * 20 + ODD).repartition(1)
    jaccard.jaccard_components(docs).collect()
    decontamination.find_contamination(docs, spark.createDataFrame([(1, prose(random.Random(2), 30))], "item_id long, text string")).collect()
    packing.pack_documents(docs, queries.tokenizer_path()).collect()
    path = queries.tokenizer_path()

    def held(batches):
        import pandas as pd

        from lurelake.llm import common, decontamination as d, packing as p

        n = len(common.HASHES) + len(d.TERMS) + sum(len(t) + len(t.stems) + len(t.before) for t in p._TOKENS.values())
        for b in batches:
            yield pd.DataFrame({"n": [n] * len(b)})

    assert path and spark.range(40).repartition(8).mapInPandas(held, "n long").agg(F.max("n")).first()[0] == 0
    assert not hasattr(quality, "HASHES") and WordHashes.LIMIT <= 200_000 and isinstance(HASHES, WordHashes)


def test_head_holds_every_prefix():
    """Whichever counted shingles are common, the head gives the prefix of the whole set."""
    rng = np.random.default_rng(3)
    for n in (1, 7, 21, 200, 3000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        low = s[s < jaccard.BOUND]
        for common in (low[:0], low, low[::2]):
            want = jaccard.ordered_prefix(s, common, 85)
            assert (jaccard.ordered_prefix(jaccard.head(s, 85), common, 85, len(s)) == want).all()


def test_slots_never_lose_a_link():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    own = [np.unique(rng.choice(pool, n)) for n in (3, 60, 90, 700, 2500, 2600)]
    own += [own[-1][10:], np.unique(pool), np.arange(0, 1 << 20, 1 << 10, dtype=np.uint64)]
    for a, b in itertools.combinations(own, 2):
        most = jaccard.most_shared(jaccard.slot_counts(a), jaccard.slot_counts(b))
        assert most is None or most >= len(np.intersect1d(a, b))
    x, y = (np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2))
    assert jaccard.most_shared(jaccard.slot_counts(x), jaccard.slot_counts(y)) < jaccard.least_overlap(500, 500, 85)


def test_bucketed_words(spark):
    """Each text's words are read once; their number of parts is that of Spark's split."""
    docs = frame(spark, ["A b.", " lead", "trail ", " \n ", "", None, "É (x) ΑΣ. ß"])
    want = [r[0] for r in docs.orderBy("doc_id").select(F.size(F.split("text", r"\s+"))).collect()]
    got = decontamination.bucketed(docs.coalesce(1).orderBy("doc_id").select("text", F.lit(0.0).alias("weight"))).collect()
    assert [r.parts for r in got] == [w if w and w > 0 else None for w in want]
    assert [len(r.words) // 2 for r in got] == [2, 1, 1, 0, 0, 0, 4]
    assert (decontamination.terms("Foo, (BAR)") == decontamination.terms("foo bar")).all()


def test_stems_are_encoded_once():
    """Words that differ in case and marks share their stem's ids; ids are those of whole texts."""
    known = packing.WordTokens(queries.tokenizer_path())
    sent = []
    encode = known.encoded
    known.encoded = lambda texts: sent.extend(texts) or encode(texts)
    text = ["Word word, WORD... (word) word!!", "<|ENDOFTEXT|>, <|endoftext|>. It's don'T. É! é́?? a=) ΑΣ. İx! 漢字!! x1. 5%% foo.́ . 'S"]
    got = known.ids(text)
    assert sent.count("word") == 1 and not {"Word", "word,", "WORD..."} & set(sent)
    assert got == encode(text)
    known.forget()
    assert not known and not known.stems
