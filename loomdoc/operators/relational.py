"""Relational operators that a document store needs beyond single DataFrame calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(df: DataFrame, **equal: object) -> DataFrame:
    """AND of equalities; a value of None leaves its filter out, a list means any of it."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).isin(value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def with_excluded(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is none of ``values`` (!= ALL); an empty list keeps all rows, null rows go otherwise."""
    return df.filter(~F.col(column).isin(values)) if values else df


def numbered(df: DataFrame, keys: str | list[str], order: list[str]) -> DataFrame:
    """Rows with n, their number within the key from 1."""
    by = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)
    return df.withColumn("n", F.row_number().over(by))


def join_either(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """Edges that touch a node at either end, each pair once: a union of two equi joins, where an OR would be a nested loop."""
    left = edges.join(nodes, edges[a] == nodes[node])
    return left.unionByName(edges.filter(~edges[a].eqNullSafe(edges[b])).join(nodes, edges[b] == nodes[node]))


def not_in(df: DataFrame, column: str, excluded: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN: no row passes if the list holds a null, nor a null row unless the list is empty."""
    keys = excluded.select(F.col(key).alias("_x"))
    state = keys.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_x").isNull()).alias("_nulls"))
    kept = df.join(keys.distinct(), df[column] == F.col("_x"), "left_anti").crossJoin(F.broadcast(state))  # one row
    return kept.filter((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group (DISTINCT ON)."""
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row with the greatest ``at`` of each group: one aggregate, combined before the shuffle. Other columns must be of ordered types, so no maps."""
    rest = [c for c in df.columns if c not in keys and c != at]
    top = df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_top"))
    return top.select(*keys, "_top.*").select(*df.columns)


def with_count(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str) -> DataFrame:
    """Parents with their number of children, 0 for none: a correlated count as a grouped join."""
    counts = children.groupBy(F.col(foreign).alias("_k")).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, parents[key] == counts["_k"], "left").drop("_k").fillna(0, [name])


def reconcile(parsed: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: parsed rows, rows not stored, and stored rows whose field differs, by field; null differs from any value."""
    other = stored.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = parsed.join(other, parsed[key] == other["_k"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("rows_parsed"),
        F.count_if(F.col("_k").isNull()).alias("missing"),
        *[F.count_if(F.col("_k").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f))).alias(f"{f}_differs") for f in fields],
    )


def exactly_members(df: DataFrame, group: str, member: str, members: list) -> DataFrame:
    """Groups whose distinct members are exactly ``members`` (relational division)."""
    known = F.col(member).isin(members)
    counted = df.groupBy(group).agg(F.count_distinct(F.when(known, F.col(member))).alias("_in"), F.count_if(~known).alias("_out"))
    return counted.filter((F.col("_in") == len(members)) & (F.col("_out") == 0)).select(group)


def compare_periods(df: DataFrame, at: str, value: str, day: str) -> DataFrame:
    """Count and sum of a day and of the day before; a day without rows counts 0."""
    when = F.lit(day).cast("date")
    period = F.when(F.to_date(at) == when, "today").when(F.to_date(at) == F.date_sub(when, 1), "yesterday")
    sums = df.withColumn("period", period).filter("period is not null").groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    names = df.sparkSession.createDataFrame([("today",), ("yesterday",)], "period string")
    return names.join(sums, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


def limit_check(usage: DataFrame, caps: DataFrame, key: str, at: str, day: str) -> DataFrame:
    """Each key's use of the day and whether it may go on; a cap of 0 is no cap, and a key whose ``enabled`` is false may not."""
    used = usage.filter(F.to_date(at) == F.lit(day).cast("date")).groupBy(key).agg(F.count(F.lit(1)).alias("used"))
    rows = caps.join(used, key, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    on = F.coalesce("enabled", F.lit(True)) if "enabled" in caps.columns else F.lit(True)
    return rows.select(key, "used", (on & ((F.col("cap") == 0) | (F.col("used") < F.col("cap")))).alias("allowed"))


def json_array(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """A JSON array of objects for each group, in the order of the fields."""
    items = F.sort_array(F.collect_list(F.struct(*fields)))
    return df.groupBy(*keys).agg(F.to_json(items).alias(name))


def mode(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The commonest value of each key; among equals the first seen."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    best = counts.groupBy(key).agg(F.max(F.struct("_n", (-F.col("_first")).alias("_early"), value)).alias("_b"))
    return best.select(key, F.col(f"_b.{value}").alias(value))


def with_cost(df: DataFrame, model: str, tokens_in: str, tokens_out: str, rates: dict[str, tuple[float, float]]) -> DataFrame:
    """cost in units for a million tokens; unknown models cost 0."""
    rate = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, r in rates.items() for x in (m, r[k])]), F.col(model)), F.lit(0.0))
    return df.withColumn("cost", (F.col(tokens_in) * rate(0) + F.col(tokens_out) * rate(1)) / 1e6)


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, sep: str) -> DataFrame:
    """The texts of each group in order, joined."""
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x[text]), sep).alias(text))


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page by number, from 1, with the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def keyset_page(df: DataFrame, at: str, key: str, before: Column, size: int) -> DataFrame:
    """The ``size`` rows before a cursor, oldest first, and whether there are more."""
    more = df.filter(F.col(at) < before).orderBy(F.desc(at), F.desc(key)).limit(size + 1)
    n = Window.partitionBy()  # of at most size + 1 rows
    ranked = more.withColumn("has_more", F.count(F.lit(1)).over(n) > size).withColumn("_r", F.row_number().over(n.orderBy(F.desc(at), F.desc(key))))
    return ranked.filter(F.col("_r") <= size).drop("_r").orderBy(at, key)


def shuffled(rows: DataFrame, id_: str, by: Sequence[str] = (), seed: int = 0, name: str = "place") -> DataFrame:
    """``rows`` with a place from 0 in a random order of each group that the seed fixes: that of a digest of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(digest, id_)) - 1)


def with_uuid(rows: DataFrame, name: str = "uuid") -> DataFrame:
    return rows.withColumn(name, F.expr("uuid()"))


def sampled(rows: DataFrame, id_: str, share: float, seed: int = 0) -> DataFrame:
    """A share of the rows, the same ones each time, as for clean-up now and then."""
    digest = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))), F.lit(8)), 16, 10).cast("long")
    return rows.filter(digest < F.lit(int(share * 2**32)))
