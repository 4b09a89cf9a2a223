"""Mutations as DataFrame transformations: old table and change in, new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key. A null in the key never conflicts, so such rows all stay. Columns must be of ordered types, so no maps."""
    both = old.unionByName(new)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rest = [c for c in both.columns if c not in keys and c != version]
    top = both.filter(known).groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_t")).select(*keys, "_t.*")
    return top.select(*old.columns).unionByName(both.filter(~known).select(*old.columns))


def upsert_max(old: DataFrame, new: DataFrame, keys: list[str], score: str, context: str) -> DataFrame:
    """Keep the greatest score of each key, and the context of the newest row; rows of ``new`` are newer."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy(*keys).agg(F.max(score).alias(score), F.max(F.struct("_v", context))[context].alias(context))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add the rows whose key is not there; of equal keys in ``new`` one is added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def increment(old: DataFrame, new: DataFrame, keys: list[str], amount: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum(amount).alias(amount))


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Each non-null value of ``changes`` replaces the old one."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    out = df.join(new, df[key] == new["_k"], "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in df.columns])


def toggle(df: DataFrame, column: str, rows: Column) -> DataFrame:
    """Flip a flag; a null flag counts as false."""
    flag = F.coalesce(column, F.lit(False))
    return df.withColumn(column, F.when(rows, ~flag).otherwise(F.col(column)))


def soft_delete(df: DataFrame, rows: Column, at: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(rows & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def restore(df: DataFrame, rows: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(~rows, F.col("deleted_at")))


def purge(parents: DataFrame, key: str, *levels: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """Remove deleted parents, and level after level the children (table, own key, parent's key) without a parent."""
    out = [parents.filter(F.col("deleted_at").isNull())]
    gone = parents.filter(F.col("deleted_at").isNotNull()).select(F.col(key).alias("_gone"))
    for child, own, foreign in levels:
        lost = child.join(gone, child[foreign] == F.col("_gone"), "left_semi")
        out.append(child.join(gone, child[foreign] == F.col("_gone"), "left_anti"))
        gone = lost.select(F.col(own).alias("_gone"))
    return out


def delete_orphans(nodes: DataFrame, key: str, edges: DataFrame, ends: list[str]) -> DataFrame:
    """Nodes that are an end of an edge."""
    used = edges.select(F.explode(F.array(*ends)).alias("_u")).distinct()
    return nodes.join(used, nodes[key] == F.col("_u"), "left_semi")


def next_sequence(old: DataFrame, new: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """Number new rows on from each group's greatest number, from 0 where it has none."""
    top = old.groupBy(*keys).agg(F.max(number).alias("_m"))
    by = Window.partitionBy(*keys).orderBy(*order)
    return new.join(top, keys, "left").withColumn(number, F.coalesce("_m", F.lit(-1)) + F.row_number().over(by)).drop("_m")


def reorder(df: DataFrame, key: str, ids: list, column: str) -> DataFrame:
    """Positions as in ``ids`` (a user's list); others keep theirs."""
    places = F.create_map(*[F.lit(x) for i, k in enumerate(ids) for x in (k, i)])
    return df.withColumn(column, F.coalesce(F.element_at(places, F.col(key)), F.col(column)))


def current_state(log: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """The last state of each key of an event log."""
    return log.groupBy(*keys).agg(F.max(F.struct(at, state))[state].alias(state))


def guarded_state(log: DataFrame, keys: list[str], at: str, event: str, steps: dict[tuple[str | None, str], str | None]) -> DataFrame:
    """The state of each key after its events in order, where only the steps (state, event) -> state of the table count, others change nothing; a state of None is none, and has no row.

    A key's events are one array, as with the history of one relation.
    """
    to = [(s or "", e, t or "") for (s, e), t in steps.items()]

    def apply(state: Column, e: Column) -> Column:
        out = F.when(F.lit(False), "")
        for s, name, t in to:
            out = out.when((state == s) & (e[event] == name), t)
        return out.otherwise(state)

    events = log.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, event))).alias("_e"))
    return events.select(*keys, F.aggregate("_e", F.lit(""), apply).alias("state")).filter("state <> ''")


def both_ways_gone(pairs: DataFrame, gone: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs without those of ``gone`` (a, b), in either direction."""
    out = gone.select(F.col(a).alias("_x"), F.col(b).alias("_y"))
    out = out.unionByName(out.select(F.col("_y").alias("_x"), F.col("_x").alias("_y"))).distinct()
    return pairs.join(out, (pairs[a] == F.col("_x")) & (pairs[b] == F.col("_y")), "left_anti")


def account_removed(users: DataFrame, user: str, gone: DataFrame, owned: list[tuple[DataFrame, str]], pairs: DataFrame, ends: tuple[str, str], notes: DataFrame, note_owner: str) -> tuple[DataFrame, list[DataFrame], DataFrame, DataFrame]:
    """Users, what they own, pairs with them at either end, and notes that stay without a name, after the accounts ``gone`` (column user) are removed."""
    key = gone.select(F.col(user).alias("_g")).distinct()
    without = lambda df, c: df.join(key, df[c] == F.col("_g"), "left_anti")
    named = notes.join(key, notes[note_owner] == F.col("_g"), "left").withColumn(note_owner, F.when(F.col("_g").isNull(), F.col(note_owner))).drop("_g")
    return without(users, user), [without(df, c) for df, c in owned], without(without(pairs, ends[0]), ends[1]), named


def updated(df: DataFrame, key: str, value: object, **columns: object) -> DataFrame:
    """The table with columns of the row of a key set."""
    return df.select(*[F.when(F.col(key) == value, F.lit(columns[c])).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def deleted(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(~F.col(key).eqNullSafe(F.lit(value)))


def without_json_key(body: Column, key: str) -> Column:
    """A JSON object without a key; other text stays as it is."""
    fields = F.from_json(body, "map<string,variant>")
    return F.when(F.get_json_object(body, f"$.{key}").isNotNull(), F.to_json(F.map_filter(fields, lambda k, v: k != key))).otherwise(body)


def with_total(df: DataFrame, label: str, name: str = "TOTAL") -> DataFrame:
    """Detail rows and a line with the sums of the numbers (as a CSV export has)."""
    sums = [F.sum(c).cast(t).alias(c) if t in ("int", "bigint", "double") else F.lit(name if c == label else None).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(df.agg(*sums))


def replace_partition(spark: SparkSession, df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
