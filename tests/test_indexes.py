"""Brand, look-alike and suffix indexes, span resolution, sitemaps and selection against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import Observation, functions as F

from lurelake import params as P
from lurelake.functions import answers as A
from lurelake.operators import answers as OA, dataset as DS, joins as J, suffixes as SU, urls as U
from lurelake.sources import readers as R


# ---- brands -------------------------------------------------------------------------------------

def mentions(brand, text):
    low, compact = text.lower(), re.sub("[^a-z0-9]", "", brand)
    if len(compact) >= 4:
        return compact in re.sub("[^a-z0-9]", "", low)
    return re.search(rf"(?<!\w){re.escape(brand)}(?!\w)", low) is not None


def test_one_index_for_twenty_thousand_brands(spark):
    rng = random.Random(2)
    syllables = ["ba", "ko", "mi", "ru", "te", "sol", "van", "x", "pay", "net"]
    brands = {"@@", "+x", "é", "a b", "q", "mb", "-", "tê x", "pay-pal"}
    while len(brands) < 20_001:
        brands.add(rng.choice(["", "", " "]).join(rng.choice(syllables) for _ in range(rng.randrange(2, 6))) + rng.choice(["", "1", "z9"]))
    some = sorted(brands)
    texts = [" ".join(rng.choice([rng.choice(some), rng.choice(some).upper(), "plain", "words", "@@", "a@@b", "+x", "++x-", "q"])
                      for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["", None, "PayPal", "MB.", "a  b"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "again @@"), (None, "mb")], "msg_id long, text string")
    table = spark.createDataFrame([(b,) for b in some] + [("  MB ",), ("",), (None,)], "brand string")
    rows = list(enumerate(texts)) + [(3, "again @@"), (None, "mb")]
    want = sorted((i is None, i or 0, b) for i, t in rows if t for b in some if mentions(b, t))
    got = sorted((r["msg_id"] is None, r["msg_id"] or 0, r["brand"]) for r in J.brand_mentions(df, table).collect())
    assert got == want and any(b == "@@" for *_, b in want) and any(b == "+x" for *_, b in want)


def test_brands_meet_no_text(spark):
    df = spark.createDataFrame([(1, "nothing here")], "msg_id int, text string")
    assert J.brand_mentions(df, spark.createDataFrame([("zebra",)], "brand string")).count() == 0
    assert J.brand_mentions(df.limit(0), spark.createDataFrame([("here",)], "brand string")).count() == 0


# ---- look-alikes --------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def imitates(a, b):
    if a == b:
        return False
    if any(s in a for s in P.SQUAT_AFFIXES) and b in a:
        return True
    return (abs(len(a) - len(b)) <= 3 and min(len(a), len(b)) > 3
            and len(set(a) & set(b)) >= min(len(a), len(b)) / 2 and distance(a, b) <= 2)


def label(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(n))


def test_look_alikes_with_a_common_prefix(spark):
    rng = random.Random(4)
    official = [f"www.{label(rng, rng.randrange(5, 14))}" for _ in range(60)] + ["abcd", "ab", "x", "www"]
    domains = []
    for _ in range(300):
        name = list(rng.choice(official))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(name))
            name[at:at + rng.randrange(0, 2)] = [rng.choice(["", "a", "z", "1"])]
        domains.append("".join(name) + rng.choice(["", "", "-login", "-secure"]))
    domains += ["", "a" * 250, official[0] + "-verify"]
    d = spark.createDataFrame([(f"{x}.com",) for x in domains], "domain string")
    o = spark.createDataFrame([(f"{x}.vn",) for x in official], "official_domain string")
    want = {(f"{x}.com", f"{y}.vn") for x in domains for y in official if imitates(x, y)}
    rows = [tuple(r) for r in J.squatting_match(d, o).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_common_prefix_makes_few_candidates(spark):
    rng = random.Random(6)
    names = [f"www.{label(rng, 10)}" for _ in range(4000)]
    d = spark.createDataFrame([(x,) for x in names[:2000]], "d string")
    o = spark.createDataFrame([(x,) for x in names[2000:]], "o string")
    assert J.squatting_candidates(d, o).count() < 10_000


# ---- suffixes -----------------------------------------------------------------------------------

def public_suffix(host, rules):
    """The textbook rule: an exception, else the longest rule, else the last label."""
    labels = host.split(".")
    best = None
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if "!" + tail in rules:
            return ".".join(labels[i + 1:])
        if best is None and (tail in rules or i + 1 < len(labels) and "*." + ".".join(labels[i + 1:]) in rules):
            best = tail
    return best or labels[-1]


def test_ten_thousand_suffix_rules(spark):
    rng = random.Random(8)
    names = [label(rng, 3).replace("-", "q") for _ in range(60)]
    rules = {"com", "co.uk", "*.ck", "!www.ck", "a.b.c.d.e"}
    while len(rules) < 10_000:
        rule = ".".join(rng.choice(names) for _ in range(rng.randrange(1, 5)))
        rules.add(rng.choice(["", "", "", "*.", "!" if "." in rule else ""]) + rule)
    hosts = [".".join(rng.choice(names) for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    hosts += ["x.com", "com", "www.ck", "a.www.ck", "b.c.ck", "ck", "z.a.b.c.d.e", "shop.unknownsuffix", "localhost", "x..com", ""]
    hosts += ["x.com"] * 200  # a hot host
    df = spark.createDataFrame([(i, f"https://{h}/p?q=1") for i, h in enumerate(hosts)] + [(10_000, "http://10.2.3.4/x"), (10_001, None)],
                               "id long, url string").withColumn("registered", F.lit("clash"))
    table = spark.createDataFrame([(f" {r.upper()} ",) for r in rules] + [("// note",), ("",), (".dotted.test",)], "suffix string")

    def registered(host):
        suffix = public_suffix(host, rules)
        head = host[:-len(suffix) - 1] if suffix and host != suffix else ""
        return head.split(".")[-1] + "." + suffix if head and "" not in host.split(".") else ""

    got = {r["id"]: r["registered_domain"] for r in SU.registered_domain(df, table).collect()}
    assert len(got) == len(hosts) + 2
    for i, h in enumerate(hosts):
        assert got[i] == registered(h), h
    assert got[hosts.index("shop.unknownsuffix")] == "shop.unknownsuffix" and got[10_000] == "" and got[10_001] == ""
    none = {r["id"]: r["registered_domain"] for r in SU.registered_domain(df, table, unknown="none").collect()}
    assert none[hosts.index("shop.unknownsuffix")] == ""
    keys = {r["id"]: r["group_key"] for r in SU.group_key(df, table).collect()}
    assert keys[hosts.index("a.www.ck")] == "www.ck" and keys[10_000] == "10.2.3.4" and keys[10_001] is None
    assert keys[hosts.index("localhost")] == "localhost"


# ---- spans --------------------------------------------------------------------------------------

def greedy(hits, nested):
    kept = []
    for span, s, e in sorted(set(hits), key=lambda h: (-len(h[0]), h[1], h[0], h[2])):
        met = [k for k in kept if k[1] < e and s < k[2]]
        if s < e and all(nested and k[1] <= s and e <= k[2] for k in met):
            kept.append((span, s, e))
    return set(kept)


@pytest.mark.parametrize("nested", [False, True])
def test_spans_against_brute_force(spark, nested):
    rng = random.Random(1 + nested)
    hits = []
    for doc in range(40):
        for _ in range(rng.randrange(1, 25)):
            s, n = rng.randrange(60), rng.randrange(0, 12)
            hits.append((doc, rng.choice("abc") * n, s, s + n))
    hits += hits[:20]
    df = spark.createDataFrame(hits, "doc long, span string, start int, end int")
    got = {(r["doc"], r["span"], r["start"], r["end"]) for r in OA.resolve_spans(df, "doc", nested=nested).collect()}
    assert got == {(d, *h) for d in range(40) for h in greedy([x[1:] for x in hits if x[0] == d], nested)}


def test_link_targets(spark):
    docs = spark.createDataFrame([(1, ["https://www.Evil.com/login/", "mailto:x", "", None]), (2, None), (3, ["http://a.b/c"])],
                                 "doc int, links array<string>")
    spans = spark.createDataFrame([(1, "evil.com"), (1, "evil.com/login"), (1, "plain words"), (3, "http://www.a.b/c/d"), (3, "/"), (2, "a.b")],
                                  "doc int, span string")
    got = {tuple(r) for r in OA.link_targets(docs, spans, "doc").collect()}
    assert got == {(1, "https://www.Evil.com/login/", "evil.com/login"), (3, "http://a.b/c", "http://www.a.b/c/d")}


# ---- balanced objects ---------------------------------------------------------------------------

def balanced(text):
    """The shortest text from the first brace that holds as many closing as opening braces outside strings."""
    start = text.find("{")
    for end in range(start + 1, len(text) + 1):
        part = text[start:end]
        bare = re.sub(r'"(?:[^"\\]|\\.)*(?:"|$)', "", part, flags=re.S)
        if part.endswith("}") and bare.endswith("}") and bare.count("{") == bare.count("}"):
            return part
    return None


def parsed(text):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def test_first_object_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(['{', '}', '"', 'a', ' ', '\n', ':']) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    texts += ["".join(rng.choice(['{', '}', '"a"', '"\\""', '"}{"', '"\\\\"', ',', '"\\u007d"', '{"a": "\\"}"}']) for _ in range(12)) for _ in range(200)]
    texts += ["{" * 3000 + "}" * 3000, '{"a": "' + '\\"}' * 20_000 + '"} tail', "x" * 50_000 + "{é: 漢}😀}", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["o"] for r in df.select("i", A.first_object(F.col("t")).alias("o")).collect()}
    for i, t in enumerate(texts[:400]):
        assert got[i] == balanced(t), t
    # a backslash outside strings may move the end, but only of what is no JSON either way
    assert sum(parsed(balanced(t)) is not None for t in texts[400:600]) > 5
    for i, t in enumerate(texts[400:600], 400):
        assert got[i] == balanced(t) or parsed(got[i]) is parsed(balanced(t)) is None, t
    n = len(texts)
    assert got[n - 5] == texts[n - 5] and got[n - 4] == texts[n - 4][:-5] and got[n - 3] == "{é: 漢}"
    assert got[n - 2] is None and got[n - 1] is None


# ---- sitemaps -----------------------------------------------------------------------------------

def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def test_sitemaps_of_three_levels_with_a_cycle(spark):
    def at(name):
        return f"https://a.test/{name}.xml"

    leaf = "<urlset>{}</urlset>".format
    rows = [("a.test", at("top"), index(at("m1"), at("m2"), at("gone"), at("m1")), True),
            ("a.test", at("m1"), index(at("top"), at("l1"), at("l2")), False),
            ("a.test", at("m2"), index(at("m1"), at("l2"), at("l3"), at("l4"), at("l5")), False),
            ("b.test", "https://b.test/top.xml", leaf("<loc>https://b.test/p.html</loc>"), True),
            ("c.test", "https://c.test/top.xml", None, True)]
    rows += [("a.test", at(f"l{k}"), leaf(f"<loc>https://www.a.test/p{k}/x</loc><loc>https://else.test/x.html</loc><loc>https://a.test/</loc>"), False)
             for k in range(1, 6)] + [("a.test", at("never"), leaf("<loc>https://a.test/never/x</loc>"), False)]
    df = spark.createDataFrame(rows, "domain string, url string, xml string, is_entry boolean")
    got = {tuple(r) for r in R.extract_sitemap_locs(df).collect()}
    assert got == {("a.test", f"https://www.a.test/p{k}/x") for k in range(1, 6)} | {("b.test", "https://b.test/p.html")}
    assert R.extract_sitemap_locs(df, max_children=1).count() == 1
    assert R.extract_sitemap_locs(df.limit(0)).count() == 0


# ---- selection ----------------------------------------------------------------------------------

def test_quotas_are_exact_and_lazy(spark, monkeypatch):
    from hashlib import md5

    monkeypatch.setattr(DS, "PREFIX", 1)
    rows = [(i, None if i % 7 == 0 else "abc"[i % 3]) for i in range(300)]
    quotas = {"a": 10, "b": 0, "c": 1000, None: 17}
    df = spark.createDataFrame(rows, "id long, g string")
    q = spark.createDataFrame(list(quotas.items()), "g string, quota long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "no job before the action")
    taken = DS.take_quota(df, q, ["g"], "id")
    balanced_rows = DS.balance_by_source(df.selectExpr("id", "coalesce(g, 'n') AS source", "id % 2 AS label", "repeat('x', int(id % 11)) AS text"), "id")
    split = DS.stratified_split(df, "id", 0.2, "g")
    mix = DS.language_mix(df, df.withColumn("id", F.col("id") + 1000), 0.5, "id")
    groups = DS.group_split(df, "g", 0.5)
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def least(own, n, seed=42):
        return sorted(own, key=lambda i: (md5(f"{seed}:{i}".encode()).hexdigest(), i))[:n]

    members = {g: [i for i, x in rows if x == g] for g in quotas}
    want = sorted(i for g, n in quotas.items() for i in least(members[g], n))
    assert sorted(r["id"] for r in taken.collect()) == want
    held = {r["id"] for r in split.where("split = 'eval'").collect()}
    assert held == {i for g, own in members.items() for i in least(own, round(len(own) * 0.2))} and split.count() == 300
    assert mix.count() == 450 and balanced_rows.where("label = 1").count() == 150
    sides = {r["split"]: r["n"] for r in groups.select("g", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sides == {"test": 2, "train": 2} and groups.count() == 300


def test_removal_counts_come_with_the_pass(spark):
    rows = [("long enough text", "1", '[{"signal": "urgency", "exact_span": "text", "severity": "low"}]'), ("long enough text", "1", "[]"),
            ("tiny", "0", "[]"), ("tiny", "1", "[]"), ("fine and legit", "0", "[]"), (None, "0", None)]
    df = spark.createDataFrame(rows, "text string, label string, evidence string")
    seen = Observation("counts")
    out = DS.message_preprocess(df, "s", seen)
    assert len(out.collect()) == 2 == DS.message_preprocess(df, "s").count()
    assert out.columns == DS.message_preprocess(df, "s").columns
    assert seen.get == {"rows": 6, "removed_short": 3, "removed_no_evidence": 1, "kept": 2, "kept_phishing": 1, "kept_legit": 1}
