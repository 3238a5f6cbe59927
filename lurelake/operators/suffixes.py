"""Public suffixes from a table of rules: any number of rules, any depth, wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurelake import params as P
from lurelake.functions import urls as U


def suffix_rules(lines: DataFrame, col: str = "suffix") -> DataFrame:
    """(tail, kind) of rule lines: ``co.uk``, ``*.ck`` (one more label) and ``!www.ck`` (one label fewer).
    Blank lines, comments (``//``) and exceptions of one label are left out; a leading dot is ignored."""
    rule = F.regexp_replace(F.lower(F.regexp_extract(F.trim(F.col(col)), r"^\S*", 0)), r"^\.+|\.+$", "")
    kind = F.when(F.col("rule").startswith("!"), -1).when(F.col("rule").startswith("*."), 1).otherwise(0)
    tail = F.regexp_replace("rule", r"^(!|\*\.)", "")
    return (lines.select(rule.alias("rule")).where("rule <> '' AND rule NOT LIKE '//%' AND rule <> '*'")
            .select(tail.alias("tail"), kind.alias("kind")).where("kind >= 0 OR contains(tail, '.')").distinct())


def public_suffixes(hosts: DataFrame, rules: DataFrame, host_col: str = "host", unknown: str = "last") -> DataFrame:
    """(host, suffix, registered) of distinct hosts; ``suffix`` and ``registered`` are '' where there is none.

    Every tail of a host meets the rules by equality.  The longest exception wins, else the rule with the most labels.
    Where no rule matches, ``unknown="last"`` takes the last label, ``unknown="none"`` gives ''.  Addresses and
    hosts with empty labels have no suffix.  A rule's tail may be that of most hosts: the join's rule side has
    one row a rule and kind, and hosts are aggregated before they move.
    """
    host = F.col(host_col)
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("tail")))
    named = hosts.select(host).where(host.isNotNull()).distinct()
    usable = (host != "") & ~U.is_ip(host) & ~U.is_ipv4(host) & ~F.array_contains(labels, "")
    met = named.where(usable).select(host_col, F.explode(tails).alias("t")).select(
        host_col, F.col("t.tail").alias("tail"), F.col("t.at").alias("at")).join(rules, "tail")
    start = F.col("at") - F.col("kind")
    found = met.where(start >= 1).groupBy(host_col).agg(
        F.min(F.when(F.col("kind") == -1, start)).alias("exception"), F.min(F.when(F.col("kind") >= 0, start)).alias("longest"))
    default = F.size(labels) if unknown == "last" else F.lit(None).cast("int")
    known = named.join(found, host_col, "left").withColumn(
        "start", F.when(usable, F.coalesce("exception", "longest", default)))

    def tail(first: Column) -> Column:
        return F.coalesce(F.when((first >= 1) & (first <= F.size(labels)), F.array_join(F.slice(labels, first, F.size(labels)), ".")),
                          F.lit(""))

    at = F.greatest(F.col("start"), F.lit(1))
    registered = F.when(F.col("start") >= 2, tail(F.greatest(F.col("start") - 1, F.lit(1))))
    return known.select(host_col, F.when(F.col("start").isNotNull(), tail(at)).otherwise(F.lit("")).alias("suffix"),
                        F.coalesce(registered, F.lit("")).alias("registered"))


def _attached(df: DataFrame, host: Column, suffixes: DataFrame, unknown: str, finish, out: str) -> DataFrame:
    rows = df.withColumn("_host", host)
    found = public_suffixes(rows.select("_host"), suffix_rules(suffixes), "_host", unknown).select(
        F.col("_host").alias("_known"), F.col("registered").alias("_registered"))
    return rows.join(found, F.col("_host") == F.col("_known"), "left").withColumn(
        out, finish(F.col("_host"), F.coalesce("_registered", F.lit("")))).select(*[c for c in df.columns if c != out], out)


def registered_domain(df: DataFrame, suffixes: DataFrame, col: str = "url", unknown: str = "last",
                      out: str = "registered_domain") -> DataFrame:
    """The rows with the registered domain of a URL, address or host by a table of suffix rules; '' for
    addresses, bare suffixes and empty values."""
    return _attached(df, U.address_host(F.col(col)), suffixes, unknown, lambda h, r: r, out)


def group_key(df: DataFrame, suffixes: DataFrame, col: str = "url", shared_hosts=P.SHARED_HOSTS,
              unknown: str = "last", out: str = "group_key") -> DataFrame:
    """The rows with their split key by a table of suffix rules; see ``operators.urls.group_key``."""
    return _attached(df, U.group_host(F.col(col)), suffixes, unknown,
                     lambda h, r: U.group_key(h, r, shared_hosts), out)
