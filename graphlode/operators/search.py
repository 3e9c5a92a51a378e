"""Keyword search, navigation scores and fuzzy symbol resolution."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphlode.functions import text as tx

SOURCE_WEIGHT = {"name": 3, "docstring": 2, "tag": 2, "file_path": 1}


def extract_keywords(nodes: DataFrame) -> DataFrame:
    """(keyword, node_id, source) of the columns name, docstring, tags and file_path, each once.

    Arrays are made and exploded inside the row, so nothing is shuffled.
    """
    name = F.concat(F.array("name"), tx.identifier_parts(F.col("name")))
    words = F.regexp_extract_all(F.coalesce("docstring", F.lit("")), F.lit(r"[a-zA-Z_]\w*"), F.lit(0))
    bases = lambda t: F.concat(F.array(F.lit("extends")), F.split(F.substr(t, F.lit(9)), ","))
    tags = F.flatten(F.transform("tags", lambda t: F.when(t.startswith("extends:"), bases(t)).otherwise(F.array(t))))
    stems = F.transform(F.split(F.translate("file_path", "\\", "/"), "/"), lambda p: F.regexp_replace(p, r"\.[^.]*$", ""))
    path = F.flatten(F.transform(stems, lambda s: F.concat(F.array(s), tx.identifier_parts(s))))

    def from_(source: str, found: Column) -> Column:
        return F.transform(tx.keyword_array(found), lambda k: F.struct(k.alias("keyword"), F.lit(source).alias("source")))

    each = [from_("name", name), from_("docstring", words), from_("tag", tags), from_("file_path", path)]
    return nodes.select(F.col("id").alias("node_id"), F.explode(F.concat(*each)).alias("k")).select("k.keyword", "node_id", "k.source")


def search_counts(keywords: DataFrame, terms: list[str]) -> DataFrame:
    """(node_id, matches): how many of the terms are keywords of a node."""
    return keywords.where(F.col("keyword").isin(terms)).groupBy("node_id").agg(F.countDistinct("keyword").alias("matches"))


def _weighted(rows: DataFrame) -> DataFrame:
    weight = F.create_map(*(F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv))[F.col("source")]
    return rows.groupBy("node_id").agg(F.sum(F.coalesce(weight, F.lit(1))).cast("long").alias("score"))


def search_weighted(keywords: DataFrame, terms: list[str]) -> DataFrame:
    """(node_id, score): 3 for a term in the name, 2 in docstring or tags, 1 in the path."""
    return _weighted(keywords.where(F.col("keyword").isin(terms)))


def search_prefix(keywords: DataFrame, prefixes: list[str]) -> DataFrame:
    """The same of keywords that begin with one of the prefixes of three letters or more; a keyword counts once."""
    hit = F.lit(False)
    for p in prefixes:
        if len(p) >= 3:
            hit = hit | F.col("keyword").startswith(p.lower())
    return _weighted(keywords.where(hit))


def search_names(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(node_id, matches): how many of the terms a symbol's name contains."""
    n = sum((F.lower("name").contains(t.lower()).cast("long") for t in terms), F.lit(0).cast("long"))
    return nodes.where("kind <> 'file'").select(F.col("id").alias("node_id"), n.alias("matches")).where("matches > 0")


def seed_scores(keywords: DataFrame, query: str) -> DataFrame:
    """(node_id, score): exact matches in full, matches by stem alone at 0.6, by synonym at 0.5; the best of them counts.

    One pass over the keywords: each row is tested for all three and gives three sums.
    """
    terms = tx.query_terms(query)
    stems = [s for s in dict.fromkeys(tx.stem(t) for t in terms) if len(s) >= 3]
    others = [t for t in tx.with_synonyms(terms) if t not in terms]
    k, none = F.col("keyword"), F.lit(False)
    exact, synonym, prefix = k.isin(terms) if terms else none, k.isin(others) if others else none, none
    for s in stems:
        prefix = prefix | k.startswith(s)
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv))[F.col("source")], F.lit(1)).cast("double")
    each = keywords.where(exact | prefix | synonym).groupBy("node_id").agg(F.sum(F.when(exact, weight)).alias("e"), F.sum(F.when(prefix, weight)).alias("p"), F.sum(F.when(synonym, weight)).alias("s"))
    first = F.when(F.col("e").isNotNull(), F.greatest("e", "p")).otherwise(F.col("p") * 0.6)
    return each.select("node_id", F.greatest(first, F.col("s") * 0.5).alias("score"))


def coverage(terms: list[str], name: Column, path: Column) -> Column:
    """How many of the terms a node's name or path contains."""
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return sum(((n.contains(t) | p.contains(t)).cast("int") for t in terms), F.lit(0))


def navigate_scores(nodes: DataFrame, keywords: DataFrame, query: str, exclude: list[str] = (), include: list[str] = (), window: int = 40, kept: int = 20) -> DataFrame:
    """(node_id, match, coverage, strong, score) of the seeds of a query: the `window` best matches, `kept` of them after the
    category filter. nodes must have importance. strong: a term is in the name or path."""
    terms = tx.query_terms(query)
    seeds = seed_scores(keywords, query).orderBy(F.desc("score"), "node_id").limit(window)
    tag = tx.category_of_tags(F.col("tags"))
    fits = F.lit(True)
    if exclude:
        fits = fits & ~tag.isin(list(exclude))
    if include:
        fits = fits & tag.isin(list(include))
    met = seeds.join(nodes, seeds["node_id"] == nodes["id"]).where(fits).orderBy(F.desc("score"), "node_id").limit(kept)
    n = coverage(terms, F.col("name"), F.col("file_path"))
    kind = F.when(F.col("kind").isin("function", "method"), 1.5).otherwise(0.5)
    total = F.col("score") * 2.0 + F.col("importance") * 0.15 + kind + n * 1.8
    return met.select("node_id", F.col("score").alias("match"), n.alias("coverage"), (n > 0).alias("strong"), total.alias("score"), "name", "kind", "file_path", "importance")


# -- fuzzy resolution


@F.pandas_udf(T.DoubleType())
def _ratio(name: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, q, n).ratio() for n, q in zip(name, query)], dtype="float64")


def fuzzy_scores(nodes: DataFrame, query: str, similar: bool = True) -> DataFrame:
    """(id, score) of the symbols that a query may mean. Names like the query's come by similarity, which alone takes
    Python, and only for names that no other rule fits; similar=False leaves them out."""
    query = query.lower().translate({92: "/"})
    qualified = query.split("::")[-1]
    short = qualified.split(".")[-1]
    context = query.split("::", 1)[0]
    i, n = F.lower("id"), F.lower("name")
    ends = i.endswith("::" + qualified) | (i == qualified)
    tiers = F.when(F.lit("." in qualified) & ends, 0.99).when(n == short, 0.98).when(ends, 0.95)
    tiers = tiers.when(i.contains("::") & (F.substring(i, F.instr(i, "::") + 2, F.length(i)) == query), 0.94).when(i.endswith(query), 0.80).when(n.contains(short), 0.70).when(i.contains(query), 0.60)
    rows = nodes.where("kind <> 'file'").select("id", "name", tiers.cast("double").alias("tier"))
    near = F.lit(0.01) if context and context != short else F.lit(0.0)
    bonus = lambda s: s + F.when((s >= 0.5) & F.lower("id").contains(context), near).otherwise(0.0)
    known = rows.where("tier IS NOT NULL").select("id", bonus(F.col("tier")).alias("score"))
    if not similar:
        return known
    ratio = rows.where("tier IS NULL").select("id", _ratio(F.lower("name"), F.lit(short)).alias("r")).where("r > 0.5").select("id", (F.col("r") * 0.5).alias("score"))
    return known.unionByName(ratio.where("score > 0.3"))


def fuzzy_find(nodes: DataFrame, query: str, top: int = 5) -> DataFrame:
    """(id, score): the best `top`, equal ones by id."""
    return fuzzy_scores(nodes, query).orderBy(F.desc("score"), "id").limit(top)


def tiebreak(query: str) -> Column:
    """Bonus of a node (tags, importance, file_path) among equal ones: low-priority categories lose, importance and a
    file named as the query's class win."""
    low = F.when(tx.category_of_tags(F.col("tags")).isin(tx.LOW_PRIORITY), -10.0).otherwise(0.0)
    out = low + F.coalesce("importance", F.lit(0.0)) * 0.01
    name = query.rpartition("::")[2]
    if "." in name:
        stem = F.lower(F.regexp_replace(F.substring_index(F.translate("file_path", "\\", "/"), "/", -1), r"\.[^.]*$", ""))
        out = out + F.when(stem == name.partition(".")[0].lower(), 2.0).otherwise(0.0)
    return out


def resolve(nodes: DataFrame, query: str, pick: int | None = None) -> tuple[str | None, list[tuple[str, float]]]:
    """(the id that a query means or None, the candidates). At most five rows come to the driver."""
    query = query.replace("\\", "/")
    if pick is None and not nodes.where(F.col("id") == query).isEmpty():
        return query, [(query, 1.0)]
    best = fuzzy_find(nodes, query)
    rows = best.join(nodes, "id").select("id", "score", tiebreak(query).alias("bonus")).orderBy(F.desc("score"), "id").collect()
    found = [(r["id"], r["score"]) for r in rows]
    if pick is not None:
        return (found[pick - 1][0] if 1 <= pick <= len(found) else None), found
    if not rows:
        return None, []
    tied = sorted((r for r in rows if r["score"] == rows[0]["score"]), key=lambda r: -r["bonus"])
    if len(tied) == 1 or tied[0]["bonus"] > tied[1]["bonus"]:
        return tied[0]["id"], found
    return None, found
