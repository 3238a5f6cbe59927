"""Join operators: list membership, brands, look-alike domains, layers, gold labels.

No cross joins: containment and similarity are reached through exact blocking keys, so
each is an equi-join followed by a check on the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurelake import params as P
from lurelake.functions import brands as B, text as T, urls as U
from lurelake.functions.arrays import let

def semi_list(df: DataFrame, items: DataFrame, key: str, item_col: str) -> DataFrame:
    """Rows whose key is in the list table; Spark broadcasts the list only if it is small."""
    return df.join(items.select(F.col(item_col).alias(key)).distinct(), key, "left_semi")


def anti_list(df: DataFrame, items: DataFrame, key: str, item_col: str) -> DataFrame:
    return df.join(items.select(F.col(item_col).alias(key)), key, "left_anti")


def status_attach(urls: DataFrame, results: DataFrame, key: str = "url",
                  defaults: dict | None = None) -> DataFrame:
    """Left lookup of per-URL results, missing ones filled with the defaults."""
    out = urls.join(results, key, "left")
    return out.na.fill(defaults) if defaults else out


#: A run of letters and digits; a short brand's runs are whole words of any text that mentions it.
RUN = r"[\p{L}\p{N}_]+"
#: What is neither in a run nor a space.
SYMBOL = r"[^\p{L}\p{N}_ ]"


def _classed(mark: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(mark), k))


def _grams(compact: Column) -> Column:
    return _classed("g", F.regexp_extract_all(compact, F.lit("(?=(.{4}))"), F.lit(1)))


#: Hash slots of the keys; the broadcast table of those in use has no more rows, whatever the brands.
SLOTS = 1 << 20


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def brand_keys(brand: Column, compact: Column) -> Column:
    """The index keys of a brand, every one of which a text that mentions it holds: the four-character grams
    of its compact form; of shorter brands the words; of those without any, the symbols."""
    words = F.regexp_extract_all(brand, F.lit(RUN), F.lit(0))
    symbols = F.regexp_extract_all(brand, F.lit(SYMBOL), F.lit(0))
    return F.array_distinct(F.when(F.length(compact) >= 4, _grams(compact)).when(
        F.size(words) > 0, _classed("w", words)).otherwise(_classed("s", symbols)))


def text_keys(low: Column, compact: Column) -> Column:
    words = F.regexp_extract_all(low, F.lit(RUN), F.lit(0))
    symbols = F.regexp_extract_all(low, F.lit(SYMBOL), F.lit(0))
    return F.array_distinct(F.concat(_grams(compact), _classed("w", F.array_distinct(words)),
                                     _classed("s", F.array_distinct(symbols))))


def brand_mentions(messages: DataFrame, brands: DataFrame, text_col: str = "text",
                   id_col: str = "msg_id") -> DataFrame:
    """(id, brand) for every brand of a table mentioned in a text.

    One index for brand tables of any size.  A brand is filed under the one of its keys that the fewest texts
    hold; texts meet brands by an equi-join on the key, and only narrow rows move until the candidates of a
    text are gathered and tested beside it.  Keys whose hash slot no brand uses go before anything moves.
    Brands with a key that no text holds are never looked up.
    """
    low = F.lower(F.trim("brand"))
    table = brands.select(low.alias("brand")).where("brand <> ''").distinct().withColumn(
        "compact", T.compact(F.col("brand")))
    filed = table.withColumn("keys", brand_keys(F.col("brand"), F.col("compact")))
    filed = filed.select("brand", "compact", F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    texts = messages.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("low"))
    held = texts.select("_id", F.explode_outer(text_keys(F.col("low"), T.compact(F.col("low")))).alias("key"))
    used = F.broadcast(filed.select(_slot(F.col("key")).alias("slot")).distinct())  # SLOTS rows at most
    held = held.where(F.col("key").isNotNull()).withColumn("slot", _slot(F.col("key"))).join(
        used, "slot", "left_semi").select("_id", "key")
    met = held.join(filed.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.count(F.struct("_id")).alias("texts"))
    rarest = filed.join(met, "key").groupBy("brand", "compact", "n_keys").agg(
        F.min(F.struct("texts", "key"))["key"].alias("key"), F.count("*").alias("found")).where("found = n_keys")
    wanted = held.join(rarest, "key").groupBy("_id").agg(F.collect_set(F.struct("brand", "compact")).alias("wanted"))
    wanted = wanted.withColumnRenamed("_id", "_wanted_id")
    beside = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_wanted_id")))
    forms = F.struct(F.col("low").alias("low"), T.compact(F.col("low")).alias("compact"))
    named = let(forms, lambda t: F.filter(
        F.col("wanted"), lambda b: B.mentioned(b["brand"], b["compact"], t["low"], t["compact"])))
    return beside.select(F.col("_id").alias(id_col), F.explode(named).alias("b")).select(id_col, "b.brand")


def official_domains(brands: DataFrame, suffixes=P.PUBLIC_SUFFIXES) -> DataFrame:
    """(brand, domain) rows -> (brand, domain, registered_domain)."""
    return brands.withColumn("registered_domain", U.registered_domain(F.col("domain"), suffixes))


def official_domain_join(df: DataFrame, brands: DataFrame, domain_col: str) -> DataFrame:
    """Inner equi-join of domains to the brands that own them."""
    owned = official_domains(brands).select(
        "brand", F.col("registered_domain").alias(domain_col)).distinct()
    return df.join(owned, domain_col)


def squatting_match(domains: DataFrame, official: DataFrame, domain_col: str = "domain",
                    official_col: str = "official_domain") -> DataFrame:
    """(domain, official) pairs where the domain imitates the official one.

    Main labels are compared once each, however many domains share them; see ``squatting_candidates``.
    """
    d = domains.select(F.col(domain_col).alias("domain")).distinct().withColumn("d", U.squat_main(F.col("domain")))
    o = official.select(F.col(official_col).alias("official")).distinct().withColumn(
        "o", U.squat_main(F.col("official"))).where("o <> ''")
    pairs = squatting_candidates(d.select("d").distinct(), o.select("o").distinct()).where(
        U.squat_by_affix(F.col("d"), F.col("o")) | U.squat_by_distance(F.col("d"), F.col("o")))
    return d.join(pairs, "d").join(o, "o").select("domain", "official")


def squatting_candidates(d: DataFrame, o: DataFrame) -> DataFrame:
    """(d, o): different labels that share a deletion variant, or of which the first has a suspicious affix
    and holds the second.

    Labels at an edit distance of two or less become equal when up to two characters are removed from each, so
    an equi-join of the variants' hashes finds them all, and a common prefix brings no pair together.
    """
    near = _by_deletion(d, "d").join(_by_deletion(o, "o"), "variant").where(
        (F.abs(F.length("d") - F.length("o")) <= 2) & (F.col("d") != F.col("o"))).select("d", "o")
    inside = d.where((F.length("d") > 0) & U.has_squat_affix(F.col("d"))).select(
        "d", F.explode(_substrings(F.col("d"))).alias("o")).where("d <> o").join(o, "o", "left_semi").select("d", "o")
    return near.unionByName(inside).distinct()


def _by_deletion(labels: DataFrame, name: str) -> DataFrame:
    """(label, variant) with the 64-bit hash of each variant of labels of four characters or more."""
    return labels.where(F.length(name) > 3).select(name, F.explode(F.array_distinct(F.transform(
        _deletions(F.col(name)), lambda v: F.xxhash64(v)))).alias("variant"))


def _deletions(label: Column) -> Column:
    """A label of two characters or more, and what is left of it without any one or two of them."""
    n = F.length(label)

    def without(i, j):
        return F.concat(label.substr(F.lit(1), i - 1), label.substr(i + 1, j - i - 1), label.substr(j + 1, n))

    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(label.substr(F.lit(1), i - 1), label.substr(i + 1, n)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
        F.sequence(i + 1, n), lambda j: without(i, j))))
    return F.concat(F.array(label), one, two)


def _substrings(label: Column) -> Column:
    n = F.length(label)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: label.substr(i, k)))))


def join_layers(rules: DataFrame, urls: DataFrame, answers: DataFrame,
                id_col: str = "msg_id") -> DataFrame:
    """Outer merge of the three layers on the message id, which is unique in each."""
    return rules.join(urls, id_col, "full_outer").join(answers, id_col, "full_outer")


def gold_predictions(samples: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """Samples with their finished predictions; ``is_done`` marks what is still to do."""
    flagged = done.withColumn("_done", F.lit(True))
    return samples.join(flagged, key, "left").withColumn(
        "is_done", F.coalesce("_done", F.lit(False))).drop("_done")
