"""Matching records of two sources: exact joins under a guard, cascades, prefixes, rules, with the unmatched beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.exprs import common_prefix_length, glob_regex


def exact_guard(left: DataFrame, right: DataFrame, key: str, value: Column) -> DataFrame:
    """left with `value` of the only row of its key on the right; outcome: matched, no_exact_match or ambiguous_match."""
    guard = right.groupBy(key).agg(F.count("*").alias("candidates"), F.min(value).alias("matched"))
    found = left.join(guard, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    outcome = F.when(F.col("candidates") == 1, "matched").when(F.col("candidates") == 0, "no_exact_match").otherwise("ambiguous_match")
    return found.withColumn("outcome", outcome).withColumn("matched", F.when(F.col("candidates") == 1, F.col("matched")))


def cascade(left: DataFrame, left_id: str, right: DataFrame, right_id: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """The first rule (name, key on the left, key on the right) by which a left row has any hit: rule, number of hits, the smallest one."""
    hits = None
    for n, (name, a, b) in enumerate(rules):
        found = left.select(left_id, a.alias("k")).join(right.groupBy(b.alias("k")).agg(F.count("*").alias("hits"), F.min(right_id).alias("hit")), "k").select(left_id, F.lit(n).alias("n"), F.lit(name).alias("rule"), "hits", "hit")
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy(left_id).agg(F.min(F.struct("n", "rule", "hits", "hit")).alias("b")).select(left_id, "b.rule", "b.hits", "b.hit")
    return left.join(best, left_id, "left").withColumn("rule", F.coalesce("rule", F.lit("unmatched")))


def upsert(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' rows by a key, case aside: matched, left_only or inserted."""
    a = left.select(F.upper(key).alias("k"), *[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(F.upper(key).alias("k"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    state = F.when(F.col(f"l_{key}").isNull(), "inserted").when(F.col(f"r_{key}").isNull(), "left_only").otherwise("matched")
    return a.join(b, "k", "full_outer").withColumn("state", state)


def longest_prefix(rows: DataFrame, templates: DataFrame, family: str, name: str, template: str, position: str, row_id: str) -> DataFrame:
    """For each row the template of its family with the longest common prefix; ties to the first.

    A family's templates are one array, so that the best is found inside the row: the rows are neither multiplied nor
    shuffled for it. The join is by family; Spark broadcasts the templates if their size allows it.
    """
    held = templates.groupBy(family).agg(F.collect_list(F.struct((-F.col(position)).alias("p"), F.col(template).alias("t"))).alias("_templates"))
    both = rows.join(held, family, "left")
    each = F.transform("_templates", lambda x: F.struct(F.coalesce(common_prefix_length(F.col(name), x["t"]), F.lit(-1)).alias("n"), x["p"].alias("p"), x["t"].alias("t")))
    best = both.withColumn("_best", F.array_max(each)).drop("_templates")
    return best.withColumn("prefix", F.when(F.col("_best.n") >= 0, F.col("_best.n"))).withColumn(template, F.col("_best.t")).withColumn(position, -F.col("_best.p")).drop("_best")


def exploded_first(rows: DataFrame, row_id: str, items: Column, known: DataFrame, item: str, accept: Column) -> DataFrame:
    """The first item of a list that is known and accepted."""
    each = rows.select(row_id, F.posexplode(items).alias("pos", item)).join(known, item).filter(accept)
    return each.groupBy(row_id).agg(F.min(F.struct("pos", item)).alias("f")).select(row_id, F.col("f.pos").alias("pos"), F.col(f"f.{item}").alias(item))


def rule_hits(kind: Column, value: Column, name: Column, line: Column, series: Column) -> Column:
    """Whether an override rule applies: glob or prefix on the name (case matters), or equality with the line or series."""
    # a pattern of two ends around one star needs no regular expression, which would be made anew for each row
    head, tail = F.substring_index(value, "*", 1), F.substring_index(value, "*", -1)
    ends = (F.length(name) >= F.length(value) - 1) & F.startswith(name, head) & F.endswith(name, tail)
    glob = F.when(value.rlike(r"^[^*?\[]*\*[^*?\[]*$"), ends).otherwise(F.call_function("rlike", name, glob_regex(value)))
    return F.when(kind == "glob", glob).when(kind == "prefix", F.startswith(name, value)).when(kind == "line", line == value).when(kind == "series", series == value).otherwise(False)


def last_enclosing(parents: DataFrame, children: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Children with the value of their last parent; null without one."""
    return children.join(parents.groupBy(key).agg(F.max_by(value, order).alias(value)), key, "left")


def path_match(wanted: DataFrame, paths: DataFrame, want: str, path: str) -> DataFrame:
    """An exact path, else the only path that ends with it (after a slash). Suffixes are joined by equality, not by a scan."""
    exact = wanted.join(paths.select(F.col(path).alias("found")).distinct(), F.col(want) == F.col("found"), "left")
    parts = F.split(F.col(path), "/")
    tails = paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("tail"))
    only = tails.groupBy("tail").agg(F.countDistinct(path).alias("n"), F.min(path).alias("by_suffix")).filter("n = 1")
    out = exact.join(only, F.col(want) == F.col("tail"), "left")
    how = F.when(F.col("found").isNotNull(), "exact").when(F.col("by_suffix").isNotNull(), "unique_suffix").otherwise("none")
    return out.select(*wanted.columns, F.coalesce("found", "by_suffix").alias("matched_path"), how.alias("how"))
