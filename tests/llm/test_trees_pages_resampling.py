"""Main text, Merkle manifest and resampling against brute force and on odd rows."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelake.llm import mainblocks, merkle, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---- main text ----------------------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "clash", "clash") for i, h in rows],
                                 "page_id long, url string, html string, text string, n_chars string")


def marked_page(rng, blocks, wrap):
    """A page around the blocks, with parts that are none of the article before, in and after it."""
    body = [rng.choice([f"<p>{b}</p>", f"<p>{b}", f"<p><b>{b}<br>", f"<h2 class=x>{b}</h2>", f"<ul><li>{b}</ul>",
                        f"<div><span>{b}</span></div>"]) for b in map(html.escape, blocks)]
    for part in ('<div class="ad">Buy this now</div>', "<aside><p>Beside <b>it</aside>", "<script>if (a < b) '<p>no</p>'</script>",
                 '<p class="cookie-notice">We store things', "<!-- <p>hidden</p> -->", "<form><p>mail<input></form>"):
        body.insert(rng.randrange(len(body) + 1), part)
    tail = '<section id="comments"><article><p>First! great post</p></article></section>'
    return ("<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class='has-sidebar'>"
            "<header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>" + wrap[0] + "".join(body) + wrap[1] + tail
            + "<footer>&copy; x</footer></body></html>")


def test_main_text_of_built_pages():
    rng = random.Random(5)
    for _ in range(60):
        blocks = [" ".join(rng.choice(["a", "<b>", "&amp;", "words", "ß", "'q'"]) for _ in range(rng.randrange(1, 40)))
                  for _ in range(rng.randrange(1, 9))]
        page = marked_page(rng, blocks, ("<article>", "</article>"))
        assert mainblocks.main_text(page) == "\n\n".join(blocks)


def test_main_text_without_an_article():
    long = "Words that tell a story go on for a while here, and on."
    page = (f"<div>Shop</div><ul><li><a href=1>one</a><li><a href=2>two</a></ul><h1>Title</h1><p>{long} {long}</p><p>Short.</p>"
            f"<p>{long} {long}</p>" + "<p></p>" * 4 + "<div class='ad'>x</div><p><a href=3>next page</a></p>")
    assert mainblocks.main_text(page) == f"Title\n\n{long} {long}\n\nShort.\n\n{long} {long}"
    assert mainblocks.main_text("<p>only this") == "only this"
    assert mainblocks.main_text("no markup, 1 < 2") == "no markup, 1 < 2"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  ", ""), ("<article></article>", ""), ("<script>var a = '</p>'", ""), ("a<!-- b", "a"),
    ("<article>a<br>b&nbsp; c&#33;&am</article>", "a b c!&am"), ("<article><p>x<p>x</article>", "x\n\nx"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2\n\n3"),
    ("<article><header><h1>T</h1></header>x</article><header>no</header>", "T\n\nx"),
    ("<article>in" + "<b>" * 5000 + "side" + "</b>" * 5000 + "</article>", "inside"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<article>" + "<p>word</p>" * 20_000 + "</article>", "\n\n".join(["word"] * 20_000)),
])
def test_main_text_of_odd_pages(page, text):
    assert mainblocks.main_text(page) == text


def test_surges_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, 3, 20, 90]) for _ in range(rng.randrange(1, 25))]
        window, least = rng.choice([1, 3, 4]), rng.choice([1, 25, 80])
        want, inside = [], None
        for i in range(len(w)):
            s = sum(w[i:i + window])
            if inside is None and s >= least:
                inside = i
            elif inside is not None and s == 0:
                want.append((inside, i))
                inside = None
        if inside is not None:
            want.append((inside, len(w)))
        assert mainblocks.surges(np.array(w), window, least) == want


def test_main_text_rows(spark):
    rows = [(1, "<article>a</article>"), (1, "<article>a</article>"), (None, None), (2, "")]
    got = mainblocks.extract_main_text(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert mainblocks.extract_main_text(pages(spark, [])).count() == 0


# ---- manifest -----------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fan):
    """Rows (doc_id, text, lang, source, n_chars) to the manifest's rows."""
    def leaf(r, text):
        values = (r[0], r[3], r[2], r[4], text)
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def climb(nodes):
        """The top, and for each node the runs that it meets: (left, right) from the bottom."""
        steps, place = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(place):
                base = at // fan * fan
                steps[k].append((nodes[base:at], nodes[at + 1:base + fan]))
                place[k] = at // fan
            nodes = [sha(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        return nodes[0], steps

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = (own, *climb([leaf(r, r[1]) for r in own]))
    root, upper = climb([trees[lang][1] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        own, subroot, steps = trees[lang]
        for r, path in zip(own, steps):
            path = path + upper[k]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = leaf(r, text)
            for left, right in path:
                folded = sha(*left, folded, *right)
            proof = sha(*[h for left, right in path for h in left + right])
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, folded, folded == root))
    return out


def manifest(df, fan):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lower_ascii(F.col("text"))
                      ).otherwise(F.col("text"))
    return merkle.merkle_manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": tampered}, fan)


def order(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("fan, n", [(8, 150), (2, 21), (8, 1)])
def test_manifest_against_brute_force(spark, fan, n):
    rng = random.Random(fan * n)
    rows = [(i, rng.choice(["Text " + "Ab" * rng.randrange(9), "é", "", None]), rng.choice(["en", "en", "en", "fr", None, "", "Ü"]),
             rng.choice(["web", None]), rng.choice([3, None])) for i in rng.sample(range(10 * n), n)]
    got = manifest(spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit("clash")).withColumn("path", F.lit(1)), fan)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute_manifest(rows, fan), key=order)
    if n > 100:
        assert {r[-1] for r in got.collect()} == {True, False}


def test_manifest_of_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr("lurelake.llm.common.RANGE_ROWS", 4)  # a group over many ranges
    rows = [(None, "a", "en", "s", 1)] * 9 + [(7, "B", "en", "s", 1)] * 9 + [(7, "A", "en", "s", 1), (9, "x" * 100_000, "en", "s", 1)]
    got = manifest(spark.createDataFrame(rows, SCHEMA), 8)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute_manifest(rows, 8), key=order)
    assert manifest(spark.createDataFrame([], SCHEMA), 8).count() == 0


# ---- resampling ---------------------------------------------------------------------------------

def brute_resample(rows, target, buckets, most, least, percent):
    def grams(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in rows:
        np.add.at(s, grams(text)[0], 1)
    for text in target:
        np.add.at(t, grams(text)[0], 1)
    scored = []
    for key, text in rows:
        own, words = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), words))
    fit = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {}
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    return [(*r[:4], (rank.get(r[:4]) or [None]).pop(0) if r[4] >= least and rank.get(r[:4]) else None) for r in scored]


@pytest.mark.parametrize("most, batch", [(1, 4 << 20), (3, 200)])
def test_resampling_against_brute_force(spark, monkeypatch, most, batch):
    monkeypatch.setattr(resampling, "BATCH_BYTES", batch)
    monkeypatch.setattr("lurelake.llm.common.RANGE_ROWS", 20)
    rng = random.Random(most)
    words = ["Alpha", "beta", "ÉTÉ", "x1", "漢字", "a-b", "It's", "\x7f", "q_q"] + [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice([None, "", " , ", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))] + [
        " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(4)])) for i in range(200)]
    rows += [(None, "beta " * 30), (3, rows[3][1]), (500, "beta w1 " * 20_000)]
    target = ["beta x1 w1 w2 w3", None, "", "It's alpha " * 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.resample(docs, items, buckets=97, most=most, least_words=10, percent=30).collect()]
    assert sorted(got, key=order) == sorted(brute_resample(rows, target, 97, most, 10, 30), key=order)


def test_batches_mask_runs_over_two_texts():
    texts = [b"a b", b"", b"c", b"d e f"]
    features, owner, words = resampling.batch_features(texts, 1 << 32, 2)
    runs = {(t, g) for t, grams in enumerate([["a", "b", "a b"], [], ["c"], ["d", "e", "f", "d e", "e f"]]) for g in grams}
    assert sorted(zip(owner.tolist(), features.tolist())) == sorted((t, zlib.crc32(g.encode())) for t, g in runs)
    assert words.tolist() == [2, 0, 1, 3]
    assert resampling.batch_features([], 10, 2)[0].size == 0


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).count() == 0
    row = resampling.resample(docs, docs.limit(0), least_words=1, percent=100).first()
    assert (row.n_features, row["rank"]) == (3, 1)
