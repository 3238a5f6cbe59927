"""The corpus operators against brute force, and on nulls, empty tables, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lurelake.llm import (decontamination, fingerprints, jaccard, licenses, lines, packing, quality, queries, sharding,
                          substrings, toxicity)
from lurelake.llm.common import smallest_reachable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (3, 4, 7, 9, 40, 60, 120, 400)]
    near = base[5].split()
    near[30] = "changed"
    passage = prose(rng, 80)
    return base + [base[4], base[4], " ".join(near), base[6] + " tail", prose(rng, 30) + " " + passage,
                   passage + " " + prose(rng, 10), "", None, None, " \t\n ", "a " * 90, "x" * 70_000, base[2].upper()]


ODD = [None, "", " \n ", "one", "one", "é ß 漢 " * 3, "word " * 3000]


def test_shards(spark, texts):
    rows = sharding.shard_rows(frame(spark, texts), [1.0] * 5, [1.0] * 6).collect()
    assert len(rows) == len(texts)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        assert r.grown_shard in (r.shard, 5)
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    want = min(range(5), key=lambda s: -math.log((int(hashlib.md5(f"3:{s}".encode()).hexdigest()[:13], 16) + .5) / 2 ** 52))
    assert next(r.shard for r in rows if r.doc_id == 3) == want


def test_weights_follow(spark):
    rows = spark.range(4000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count()
    n = {r.s: r["count"] for r in rows.collect()}
    assert set(n) == {0, 1} and abs(n[1] / 4000 - 0.75) < 0.04


def test_licenses(spark):
    mit = ". ".join(s for i, s in licenses.SENTENCES if i in "bcd")
    docs = frame(spark, ["Intro here. " + mit + ". End.", "Released under the MIT License.", None, "", "nothing"])
    got = {r.doc_id: r for r in licenses.recognise_licenses(docs).collect()}
    assert "MIT" in got[0].licenses and "MIT" in got[1].licenses
    assert got[2].licenses == got[3].licenses == got[4].licenses == ""


def repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    starts = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i:i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return {d: (len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g).decode())
            for d, (w, g) in enumerate(zip(words, gone))}


def test_substrings(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    want = repeats(texts, 35)
    assert got == want
    assert sum(v[1] for v in want.values()) > 300


def sets(texts, words):
    out = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def components(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_jaccard(spark, texts):
    rng = random.Random(5)
    docs = list(texts)
    for n in (8, 12, 19, 30):  # near copies of small and large sets
        w = [rng.choice(WORDS) for _ in range(n)]
        docs += [" ".join(w), " ".join(w + ["end"]), " ".join(w[1:])]
    own = sets(docs, 4)
    links = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2)
             if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, docs)).collect()}
    assert got == {d: (len(own[d]), c) for d, c in enumerate(components(len(docs), links))}


def test_every_link_of_near_copies_counts(spark):
    """A group whose sets are all linked, and a chain: n_links of each row as by brute force over the different sets."""
    rng = random.Random(21)
    docs = []
    for n in (16, 90):
        w = [rng.choice(WORDS) + str(k) for k in range(n)]
        docs += [" ".join(w)] + [" ".join([*w, f"end{k}"]) for k in range(5)] + [" ".join(w[k:]) for k in (1, 2, 9)]
    own = sets(docs, 4)
    want = {d: sum(a != b and 100 * len(a & b) >= 85 * len(a | b) for b in {frozenset(x) for x in own})
            for d, a in enumerate(map(frozenset, own))}
    assert max(want.values()) >= 6
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(frame(spark, docs)).collect()} == want


def test_subsets_alone_and_lists_alone_agree(spark, texts, monkeypatch):
    short = [t for t in texts if len((t or "").split()) < 45]
    want = sorted(jaccard.jaccard_components(frame(spark, short)).collect())
    for boundary in (1, 12):
        monkeypatch.setattr(jaccard, "choose_boundary", lambda *a, b=boundary: b)
        assert [r[:2] + r[3:] for r in sorted(jaccard.jaccard_components(frame(spark, short)).collect())] == \
            [r[:2] + r[3:] for r in want]


def test_smallest_reachable(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(smallest_reachable(spark, spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_lines(spark):
    long = "the committee will meet again on the second floor of the old library building to discuss next year and the plans for it"
    docs = ["Header 12\nunique words here\n---", "header 12!\nother text", long + "\n---", long + "s\nlast", None, "", "a\nb\na"]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(frame(spark, docs)).collect()}
    assert got[0].text == docs[0] and got[1].text == "other text" and got[1].n_removed == 1
    assert got[2].text == docs[2] and got[4].text is None and got[5].text == ""
    assert got[6].text == "a\nb" and (got[6].n_lines, got[4].n_lines, got[5].n_lines) == (3, 0, 1)
    assert (got[3].text, got[3].n_lines, got[3].n_removed) == ("last", 2, 1)


def test_lines_with_other_numbers_stay(spark):
    docs = ["Invoice total 120 euro for all of the goods\nRoom 7 opens at 9\n2024-01-05", "Invoice total 950 euro for all of the goods\nRoom 8 opens at 5\n2024-01-06",
            "Invoice total 120 euro for all of the good\n12", "12\n13"]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(frame(spark, docs)).collect()}
    assert got == {0: docs[0], 1: docs[1], 2: "12", 3: "13"}


def plain_simhash(spark, features):
    """(bits, numbers of features) of each block from lists of features."""
    known = sorted({f for own in features for f in own})
    hashes = dict(spark.createDataFrame([(w,) for w in known], "w string").select("w", F.xxhash64("w")).collect())
    out = []
    for own in features:
        blocks = [[hashes[f] for f in own if hashes[f] % lines.BLOCKS == j] for j in range(lines.BLOCKS)]
        out.append(tuple((sum((2 * sum(h >> 8 + b & 1 for h in block) > len(block)) << b for b in range(lines.BITS)), len(block))
                         for block in blocks))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = list(itertools.accumulate(
            enumerate(b), lambda left, jy, row=row, x=x: min(left + 1, row[jy[0] + 1] + 1, row[jy[0]] + (x != jy[1])), initial=i + 1))
    return row[-1]


def test_simhashes(spark):
    rng = random.Random(9)
    norms = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 5, 6, 7, 40, 400)] + ["x", "w1 " * 300 + "w2"]
    got = {(r.id, r.kind): tuple((r[f"b{j}"], r[f"w{j}"]) for j in range(lines.BLOCKS))
           for r in lines.simhashes(spark.createDataFrame(list(enumerate(norms)), "id long, norm string")).collect()}
    want = {}
    by_word = [(i, n.split(" ")) for i, n in enumerate(norms) if len(n.split(" ")) >= lines.WORDS_FROM]
    by_letter = [(i, [n[k:k + 2] for k in range(len(n) - 1)]) for i, n in enumerate(norms)
                 if len(n.split(" ")) <= lines.LETTERS_TO and len(n) > 1]
    for kind, own in ((0, by_word), (1, by_letter)):
        want |= {(i, kind): s for (i, _), s in zip(own, plain_simhash(spark, [f for _, f in own]))}
    assert got == want


def edited(rng, line, how, known):
    words = line.split(" ")
    at = rng.randrange(len(words))
    if how == "word":
        words[at] = rng.choice(known)
    elif how == "typo":
        k = rng.randrange(len(words[at]))
        words[at] = words[at][:k] + rng.choice("abcxyz") + words[at][k + 1:]
    elif how == "gone":
        del words[at]
    else:
        words.insert(at, rng.choice(known))
    return " ".join(words)


def linked(spark, norms):
    texts = spark.createDataFrame(list(enumerate(norms)), "id long, norm string")
    return {tuple(sorted(r)) for r in lines.linked_lines(lines.hashed_lines(texts).cache(), texts).collect()}


def test_recall_of_edited_lines_against_brute_force(spark):
    """Pairs of edit similarity 0.9 or more: nine of ten are found, none besides is."""
    rng = random.Random(17)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    norms, pairs = [], []
    for n in range(3, 41):
        for how in ("word", "typo", "gone", "more"):
            for _ in range(3):
                line = " ".join(rng.choice(letters) for _ in range(n))
                norms += [line, edited(rng, line, how, letters)]
                pairs.append((len(norms) - 2, len(norms) - 1, how))
    near = [p for p in pairs if norms[p[0]] != norms[p[1]]
            and distance(norms[p[0]], norms[p[1]]) <= int(0.1 * max(len(norms[p[0]]), len(norms[p[1]])) + 1e-9)]
    found = linked(spark, norms)
    for how in ("word", "typo", "gone", "more"):
        own = [p for p in near if p[2] == how]
        recall = sum((a, b) in found for a, b, _ in own) / len(own)
        assert len(own) > 50 and recall >= 0.9, (how, recall)
    for a, b in found:
        assert distance(norms[a], norms[b]) <= 0.1 * max(len(norms[a]), len(norms[b])) + 1e-9


def test_groups_of_near_copies_join(spark):
    """Many variants of one line, and lines that share most words but are not alike."""
    rng = random.Random(4)
    base = [rng.choice(WORDS) + "x" for _ in range(30)]
    norms = [" ".join("z" if i == k else x for i, x in enumerate(base)) for k in range(30)]
    norms += [" ".join(base[:12]) + " " + prose(rng, 12) + " tail" + "abcdefgh"[k] for k in range(8)]
    norms = [n.translate(str.maketrans("0123456789", "abcdefghij")) for n in norms]
    want = {(a, b) for a, b in itertools.combinations(range(len(norms)), 2)
            if distance(norms[a], norms[b]) <= int(0.1 * max(len(norms[a]), len(norms[b])) + 1e-9)}
    found = linked(spark, norms)
    assert found <= want and components(len(norms), found) == components(len(norms), want)


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, texts)).collect()}
    whole = [t or "" for t in texts]
    for d, t in enumerate(whole):
        cut, following = len(t) // 4, whole[(d + 1) % len(whole)]
        edited = t[:len(t) - cut] + following[:cut]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[4].fingerprint == got[8].fingerprint == got[9].fingerprint
    assert got[8].near_next == 1.0


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontamination.common_subsequence(a, b) == brute_lcs(a, b)


def test_no_common_subsequence_is_longer_than_the_shared_words():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.array([rng.randrange(8) for _ in range(rng.randrange(1, 40))], np.uint64) for _ in range(2))
        shared = sum(min(a.tolist().count(w), b.tolist().count(w)) for w in set(a.tolist()))
        own = np.unique(a, return_counts=True)
        assert decontamination.shared_words(b, *own) == shared >= brute_lcs(a.tolist(), b.tolist())


def changed(rng, item, how):
    """An item word for word, with some words replaced, or with a stretch moved."""
    words = item.split()
    if how == "edited":
        for k in rng.sample(range(len(words) - 5), len(words) // 8):
            words[k] = rng.choice(WORDS)
    elif how == "moved":
        n = len(words) // 8
        words = words[n:-6] + words[:n] + words[-6:]
    return " ".join(words)


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    """Above a thousand documents, too, every document and every item gives its passages."""
    own = decontamination.latent_space
    seen = []

    def fitted(texts, idf, **kw):
        seen.append((texts.where("weight = 0").count(), texts.where("weight > 0").count()))
        return own(texts, idf, **kw)

    monkeypatch.setattr(decontamination, "latent_space", fitted)
    benchmark = spark.createDataFrame([(1, "one two three. Answer: four")], "item_id long, text string")
    decontamination.find_contamination(frame(spark, [f"words of {i}" for i in range(2500)]), benchmark).collect()
    assert seen == [(2500, 1)]


def test_sums_of_passages():
    rng = np.random.default_rng(4)
    q, weights = rng.standard_normal((decontamination.BUCKETS, 5)).astype(np.float32), rng.random(decontamination.BUCKETS).astype(np.float32) + 0.1
    own = [rng.integers(0, 9, n) for n in (1, 40, 7, 40)]
    often = np.array([1.0, 2.5, 1.0, 1.0])
    want = np.zeros_like(q)
    for p, o in zip(own, often):
        at, tf = np.unique(p, return_counts=True)
        a = tf * weights[at]
        a = a / np.linalg.norm(a)
        want[at] += np.outer(a, o * (a @ q[at]))
    got = np.zeros_like(q)
    decontamination.add_products(got, q, weights, np.concatenate(own), np.array([len(p) for p in own]), often)
    assert np.allclose(got, want, atol=1e-5)


def test_recall_of_planted_items(spark):
    """Word for word, edited and moved items: nine of ten are found, and all that is found is planted."""
    rng = random.Random(13)
    items = [prose(rng, rng.randrange(20, 60)) + ". Answer: " + prose(rng, 4) for _ in range(30)]
    docs, planted = [prose(rng, rng.randrange(50, 600)) for _ in range(60)], set()
    for i, item in enumerate(items):
        for how in ("same", "edited", "moved"):
            own = prose(rng, rng.randrange(0, 300)).split()
            at = rng.randrange(len(own) + 1)
            planted.add((len(docs), i, how))
            docs.append(" ".join(own[:at] + [changed(rng, item, how)] + own[at:]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(frame(spark, docs), benchmark).collect()}
    for how in ("same", "edited", "moved"):
        own = [(d, i) for d, i, h in planted if h == how]
        assert sum(p in found for p in own) >= 0.9 * len(own), how
    assert found <= {(d, i) for d, i, _ in planted}


def test_decontamination(spark):
    rng = random.Random(8)
    items = [prose(rng, 30) + ". Answer: " + prose(rng, 4) for _ in range(6)]
    changed = items[1].split()
    changed[5] = changed[17] = "other"
    docs = [prose(rng, 300) for _ in range(20)]
    docs[2] += " " + items[0]
    docs[3] = docs[3] + " " + " ".join(changed) + " " + prose(rng, 200)
    docs += ODD
    benchmark = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(frame(spark, docs), benchmark).collect()}
    assert got == {(2, 0), (3, 1)}
    assert decontamination.find_contamination(frame(spark, docs), benchmark.limit(0)).count() == 0


def tokens(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_packing(spark, texts, name, by_word):
    import public_tokenizers

    path = public_tokenizers.path(name)
    assert packing.WordTokens(path).by_word == by_word
    docs = texts + ["word more " * 3000, "a <|endoftext|> b<|startoftext|>c", "it's Don't 3.5,6 x_y..é漢"]
    got = packing.pack_documents(frame(spark, docs), path).toPandas().sort_values(["doc_id", "piece"])
    want = [(d, p, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()))
            for d, ids in enumerate(tokens(docs, path)) for p, s in enumerate(range(0, len(ids), 2048))]
    assert list(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1


def test_fullest_bin_is_the_fullest():
    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randrange(1, 30) for _ in range(9)]
        counts = {x: items.count(x) for x in items}
        got = packing.fullest_bin(counts, 50)
        assert all(counts[x] >= n for x, n in got.items()) and max(items) in got
        rest = sorted(items)[:-1]
        best = max(max(items) + sum(c) for k in range(9) for c in itertools.combinations(rest, k)
                   if max(items) + sum(c) <= 50)
        assert sum(x * n for x, n in got.items()) == best


def test_classifiers(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["clear", "useful", "explain", "river", "stone"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["CLICK", "you idiot!!!", "stup1d", "buy", "stone"]) for _ in range(30)) for _ in range(60)]
    y = np.array([0, 1] * 60)
    mixed = [t for pair in zip(good, bad) for t in pair]
    docs = frame(spark, mixed[60:] + ODD).withColumn("score", F.lit("clash"))
    for scored in (quality.score_texts(docs, quality.train(mixed[:60], y[:60])),
                   toxicity.score_toxicity(docs, toxicity.train(mixed[:60], y[:60]))):
        own = scored.toPandas()
        assert len(own) == 60 + len(ODD) and own["score"].between(0, 1).all()
        own = own[own["doc_id"] < 60].sort_values("doc_id")
        assert ((own["score"] >= 0.5) == (y[60:] == 1)).mean() > 0.95


def every(spark, docs):
    """Each operator's result over docs."""
    model = quality.train(["good text", "bad text"] * 4, np.array([1, 0] * 4))
    toxic = toxicity.train(["good text", "you bad text"] * 4, np.array([0, 1] * 4))
    items = spark.createDataFrame([(1, "one two three. four")], "item_id long, text string")
    return {
        "shards": sharding.shard_rows(docs, [1.0, 2.0], [1.0, 2.0, 1.0]),
        "licenses": licenses.recognise_licenses(docs), "substrings": substrings.remove_repeats(docs),
        "jaccard": jaccard.jaccard_components(docs), "lines": lines.drop_repeated_lines(docs),
        "fingerprints": fingerprints.fingerprint_edits(docs), "decontamination": decontamination.find_contamination(docs, items),
        "packing": packing.pack_documents(docs, queries.tokenizer_path()),
        "quality": quality.score_texts(docs, model), "toxicity": toxicity.score_toxicity(docs, toxic),
    }


def test_odd_rows_and_clashing_names(spark):
    docs = frame(spark, ODD + ODD, ids=[None, 1, 2, 3, 4, 5, 6] * 2)
    for c in ("score", "id", "sim", "n", "shard", "slot", "component_id", "set", "key", "length", "norm", "place"):
        docs = docs.withColumn(c, F.lit("clash"))
    n = {name: df.count() for name, df in every(spark, docs).items()}
    for name in ("shards", "licenses", "lines", "quality", "toxicity"):
        assert n[name] == 2 * len(ODD), name
    assert n["packing"] >= 2 * len(ODD) and n["substrings"] >= len(ODD) and n["jaccard"] >= len(ODD)


def test_empty_table(spark):
    for name, df in every(spark, frame(spark, [])).items():
        assert df.count() == 0, name


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["clear", "useful", "explain", "river"]) + str(i) for i in range(30)) + f" doc {k}" for k in range(40)]
    bad = [" ".join(rng.choice(["buy", "click", "cheap", "now"]) for _ in range(30)) for _ in range(40)]
    texts = good + bad + [good[0], good[1] + " plus", None, ""]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = pd.DataFrame({"doc_id": range(80), "quality": [1] * 40 + [0] * 40, "toxic": [0] * 80})
    spark.createDataFrame(labels).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, good[7])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(range(2, 40)) <= seen["quality_classifier"] and not seen["quality_classifier"] & set(range(40, 80))
    assert 80 not in seen["line_dedup"]  # nothing is left of an exact copy
    assert 7 not in seen["decontamination"] and len(seen["decontamination"] & set(range(40))) == 39
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) == seen["decontamination"]
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
