"""Policies and catalogs that are tables (C5, C3): joins through a prefix index.

A rule names a whole key or a prefix.  Keys are cut to the lengths that rules
have, so a prefix is found by equality: one hash join, no comparison of every
key with every rule.  Only distinct keys are cut, after a partial aggregation,
so a key on many rows is looked up once.

A pattern of a catalog is indexed by the literal text it begins with; the
regular expression itself runs only on names that begin with that text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.operators.policy import ACCEPTED, BLACKLISTED, NOT_ALLOWED


def _cut(keys: DataFrame, key: str, lengths: Sequence[int]) -> DataFrame:
    """Every key with its beginnings of the given lengths, as ``_start``."""
    fits = F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= F.length(key)) if lengths else \
        F.array().cast("array<int>")
    return keys.withColumn("_n", F.explode(fits)).withColumn("_start", F.col(key).substr(F.lit(1), F.col("_n"))).drop("_n")


def _lengths(rules: DataFrame, text: str) -> list[int]:
    """Distinct lengths of the prefixes: at most as many as the longest prefix has characters."""
    return sorted(r[0] for r in rules.select(F.length(text)).where(F.col(text).isNotNull()).distinct().collect())


def policy_by_rules(conf: DataFrame, rules: DataFrame, key: str = "key", by: Sequence[str] = ()) -> DataFrame:
    """Per conf row ``verdict``: ``blacklisted`` if a deny rule holds (deny
    always wins), else ``accepted`` if an allow rule does, else ``not in whitelist``.

    ``rules``: (*by, effect, match, pattern): effect ``allow`` or ``deny``; match
    ``key`` for the whole key or ``prefix``.  ``by`` names columns of both tables,
    such as the tenant; each group has its own rules, and NULL is a group.
    A NULL key matches no rule; an empty prefix matches every key.
    """
    by = list(by)
    rules = rules.where(F.col("pattern").isNotNull() & F.col("effect").isin("allow", "deny")).select(*by, "effect", "match", "pattern")
    prefixes = rules.where(F.col("match") == "prefix")
    asked = conf.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("_key")).distinct()
    starts = _cut(asked, "_key", _lengths(prefixes, "pattern")).withColumn("_match", F.lit("prefix")).unionByName(
        asked.withColumn("_start", F.col("_key")).withColumn("_match", F.lit("key")))
    index = rules.groupBy(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], F.col("match").alias("_m"), F.col("pattern").alias("_p")) \
        .agg(F.max(F.col("effect") == "deny").alias("_deny"))
    same = (F.col("_start") == F.col("_p")) & (F.col("_match") == F.col("_m"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    found = starts.join(index, same).groupBy(*by, "_key").agg(F.max("_deny").alias("_deny")).select(
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], "_key", "_deny")
    same = F.col(key) == F.col("_key")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    verdict = (F.when(F.col("_deny"), F.lit(BLACKLISTED)).when(F.col("_deny").isNull(), F.lit(NOT_ALLOWED))
               .otherwise(F.lit(ACCEPTED)))
    return conf.join(found, same, "left").select(*conf.columns, verdict.alias("verdict"))


def literal_start(pattern: Column) -> Column:
    """The text that every full match of a regular expression begins with;
    empty if it can't be told (alternatives at the top level)."""
    body = F.regexp_replace(pattern, r"^\^", "")
    # escapes, classes and up to three levels of groups away: is a bar left?
    bare = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), r"\[[^\]]*\]", "")
    for _ in range(3):
        bare = F.regexp_replace(bare, r"\([^()]*\)", "")
    # plain characters and escaped symbols, none of which may be left out or repeated
    start = F.regexp_extract(body, r"^((?:(?:\\[^A-Za-z0-9]|[^\\\[\](){}|*+?.^$])(?![*?{+]))*)", 1)
    return F.when(bare.contains("|") | bare.contains("("), F.lit("")).otherwise(F.regexp_replace(start, r"\\(.)", "$1"))


def match_by_catalog(names: DataFrame, catalog: DataFrame, name: str = "placeholder") -> DataFrame:
    """Every row with ``variable``: of the catalog's entries whose pattern
    matches the whole name the one declared first, NULL without any.

    ``catalog``: (position, variable, pattern).  Equal positions go by variable.
    """
    entries = catalog.where(F.col("pattern").isNotNull()).select(
        F.struct(F.col("position").alias("p"), F.col("variable").alias("v")).alias("_entry"),
        F.concat(F.lit("^(?:"), F.regexp_replace(F.regexp_replace("pattern", r"^\^", ""), r"(?<!\\)\$$", ""), F.lit(")\\z")).alias("_whole"),
        literal_start(F.col("pattern")).alias("_begin"))
    asked = names.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    found = _cut(asked, "_name", _lengths(entries, "_begin")).join(entries, F.col("_start") == F.col("_begin")) \
        .where(F.expr("_name rlike _whole")).groupBy("_name").agg(F.min("_entry").alias("_entry"))
    return names.join(found, F.col(name) == F.col("_name"), "left").select(*names.columns, F.col("_entry.v").alias("variable"))
