"""The rows that break the schema's constraints, with the rules that each of them breaks.

Two reads of every table.  The first reduces all keys of all tables to one row per key: how often it is there as a primary or
unique key, and how often each reference names it.  All tables meet in one aggregation, whose partial sums take the weight off
frequent keys; of its result only the keys that break a rule are written, a table that is as small as the data is clean.  The
second read tags rows: values are checked in place, keys are looked up among the broken ones.  The summary needs no second
read: the numbers of rows are known by key, and sets of broken value rules are counted along with the keys.

A key that holds more than a thousandth of a rule's offending rows is looked up in a broadcast of at most a thousand keys, so
that no task gets all of its rows; the others by a join that Spark plans by the size of the written table.  Rules that no key
breaks cost no join.

Every row of a repeated key is an offender, also the one that was there first: a table has no order to tell.  Rows without a
primary key are offenders; other keys may be missing, and a condition that is NULL passes, as a CHECK would.  Names of rules
are those of the counting audits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DOMAINS, FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, RANGES, SCHEMAS, TEXT_LENGTHS, UNIQUE_KEYS
from ..session import stored_table
from ..sources.files import BASE_TABLES
from ..sources.tables import Tables
from .audits import checked_columns, key_label

#: Keys with more than this part of a rule's offending rows are looked up on their own; there are at most as many.
HOT_PART = 1_000
BROKEN = "broken_rules"


@dataclass(frozen=True)
class KeyRule:
    """A primary key (also its rows without one), a unique key, or a reference to the key of ``space``."""

    number: int
    name: str
    table: str
    columns: tuple[str, ...]
    space: tuple[str, ...]  # keys that can be the same: table and columns

    @property
    def is_reference(self) -> bool:
        return self.space[0] != self.table or self.space[1:] != self.columns


def key_rules(names: list[str]) -> list[KeyRule]:
    found: list[KeyRule] = []

    def add(name: str, table: str, columns: list[str], space: tuple[str, ...]) -> None:
        found.append(KeyRule(len(found), name, table, tuple(columns), space))

    for table in names:
        key = PRIMARY_KEYS[table]
        add(f"primary key {key_label(key)}", table, key, (table, *key))
    for table, key in UNIQUE_KEYS:
        if table in names:
            add(f"unique {key_label(key)}", table, key, (table, *key))
    for child, column, parent, key in FOREIGN_KEYS:
        if child in names:
            add(f"{column} in {parent}", child, [column], (parent, key))
    return found


def _is_number(table: str, columns: tuple[str, ...]) -> bool:
    return len(columns) == 1 and isinstance(SCHEMAS[table][columns[0]].dataType, T.IntegralType)


def _parts(df: DataFrame, table: str, columns: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """A key as two whole numbers and a text, each NULL if the key does not need it, all if a part of the key is missing.

    The text is what the key's other columns say, as JSON if there are several.
    """
    nothing = F.lit(None)
    if _is_number(table, columns):
        return F.col(columns[0]).cast("bigint"), nothing.cast("bigint"), nothing.cast("string")
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)][:2]
    others = [F.col(c) for c in columns if c not in numbers]
    text = nothing if not others else others[0] if len(others) == 1 else F.to_json(F.struct(*others))
    number, second = [*[F.col(c) for c in numbers], nothing, nothing][:2]
    return tuple(F.when(whole, part).cast(kind) for part, kind in [(number, "bigint"), (second, "bigint"), (text, "string")])


def _joined(number: Column, second: Column, text: Column) -> Column:
    """The parts of a key in one text, NULL without a key; keys of one rule have the same parts."""
    return F.nullif(F.concat(F.lit("="), F.concat_ws(" ", number, second, text)), F.lit("="))


class KeyCounts:
    """How often every key is there and each reference names it: all keys of all tables in one aggregation.

    A row stands under each of its keys, in the ``space`` of keys that can be the same, with the place it has there: 0 for the
    key itself, others for references.  A unique key that is also a reference is counted as the reference only.  With
    ``values``, a row that breaks value rules also stands under their set, a bit for each, in a space of its table.
    """

    def __init__(self, t: Tables, names: list[str], values: bool = False):
        self.rules = key_rules(names)
        references = {(r.table, r.columns): r for r in self.rules if r.is_reference}
        #: Which place of which space decides each rule.
        self.spaces: list[tuple[str, ...]] = []
        places: dict[tuple, tuple[int, int]] = {}
        used: dict[int, int] = {}
        tables: dict[str, list[tuple[int, int, tuple[str, ...]]]] = {}
        self.at: dict[int, tuple[int, int]] = {}
        for rule in sorted(self.rules, key=lambda r: not r.is_reference):
            counted = references.get((rule.table, rule.columns), rule) if rule.name.startswith("unique") else rule
            if counted.space not in self.spaces:  # with the key itself, which references need too
                self.spaces.append(counted.space)
                tables.setdefault(counted.space[0], []).append((len(self.spaces) - 1, 0, counted.space[1:]))
            space = self.spaces.index(counted.space)
            at = (counted.table, counted.columns, space)
            if not counted.is_reference:
                places[at] = (space, 0)
            elif at not in places:
                used[space] = used.get(space, 0) + 1
                places[at] = (space, used[space])
                tables.setdefault(counted.table, []).append((space, used[space], counted.columns))
            self.at[rule.number] = places[at]
        self.value_rules = [(name, rule, bad) for name in names for rule, bad in _own_rules(name)] if values else []
        checked = {name: len(self.spaces) + k for k, name in enumerate(dict.fromkeys(name for name, _, _ in self.value_rules))}
        self.value_at = [
            (checked[name], k - next(i for i, one in enumerate(self.value_rules) if one[0] == name))
            for k, (name, _, _) in enumerate(self.value_rules)
        ]
        self.most = max([0, *used.values()])

        def struct(space: int, place: int, number: Column, second: Column, text: Column) -> Column:
            return F.struct(
                F.lit(space).alias("space"), F.lit(place).alias("place"), number.alias("number"), second.alias("second"),
                text.alias("text"),
            )

        def keys(name: str) -> DataFrame:
            df = checked_columns(t, name, [c for _, _, columns in tables[name] for c in columns])
            parts = [struct(space, place, *_parts(df, name, columns)) for space, place, columns in tables[name]]
            if name in checked:
                broken = [
                    F.when(bad, F.lit(1 << bit).cast("bigint")).otherwise(0)
                    for (_, bit), (table, _, bad) in zip(self.value_at, self.value_rules, strict=True) if table == name
                ]
                bits = F.nullif(reduce(Column.__add__, broken), F.lit(0).cast("bigint"))
                parts.append(struct(checked[name], 0, bits, F.lit(None).cast("bigint"), F.lit(None).cast("string")))
            return df.select(F.inline(F.array(*parts)))

        every = reduce(DataFrame.unionByName, [keys(name) for name in tables])
        present = every.filter(F.col("number").isNotNull() | F.col("text").isNotNull())
        self.counted = present.groupBy("space", "number", "second", "text").agg(*[
            F.sum(F.when(F.col("place") == place, 1).otherwise(0)).cast("bigint").alias(f"n{place}")
            for place in range(self.most + 1)
        ])

    def broken(self) -> DataFrame:
        """``(number, second, text, rule, n)``: a key under each rule that it breaks, with its number of rows."""
        found, suspect = [], F.lit(False)
        for rule in self.rules:
            space, place = self.at[rule.number]
            n = F.col(f"n{place}")
            bad = (F.col("space") == space) & ((F.col("n0") == 0) & (n > 0) if rule.is_reference else n > 1)
            suspect = suspect | bad
            found.append(F.when(bad, F.struct(F.lit(rule.number).alias("rule"), n.alias("n"))))
        listed = F.inline(F.filter(F.array(*found), lambda one: one.isNotNull()))
        return self.counted.filter(suspect).select("number", "second", "text", listed)  # few keys are looked at rule by rule

    def rows_by_rule(self) -> DataFrame:
        """``(table_name, rule, n)``: the rows that break each rule that any row breaks.

        Keys are summed up by space first, and sets of value rules by set; rules are told apart in what is left.
        """
        places = range(self.most + 1)
        sums = self.counted.groupBy("space", F.when(F.col("space") >= len(self.spaces), F.col("number")).alias("bits")).agg(
            F.sum("n0").alias("rows"), *[F.sum(F.when(F.col(f"n{k}") > 1, F.col(f"n{k}"))).alias(f"repeated{k}") for k in places],
            *[F.sum(F.when(F.col("n0") == 0, F.col(f"n{k}"))).alias(f"orphans{k}") for k in places],
        )
        found = []
        for rule in self.rules:
            space, place = self.at[rule.number]
            n = F.col(f"orphans{place}" if rule.is_reference else f"repeated{place}")
            found.append((F.col("space") == space, rule.table, rule.name, n))
        for (space, bit), (name, rule, _) in zip(self.value_at, self.value_rules, strict=True):
            has = F.col("bits").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0
            found.append(((F.col("space") == space) & has, name, rule, F.col("rows")))
        counts = F.array(*[
            F.when(here, F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), n.alias("n")))
            for here, name, rule, n in found
        ])
        return sums.select(F.inline(counts)).filter("n > 0").groupBy("table_name", "rule").agg(F.sum("n").alias("n"))


def broken_keys(t: Tables, names: list[str] = BASE_TABLES) -> DataFrame:
    """``(number, second, text, rule, n)``: every key that breaks a rule, and its number of rows; each table is read once.

    Parents of the named tables are read too.
    """
    return KeyCounts(t, names).broken()


def _value_rules(name: str) -> list[tuple[str, Column]]:
    """Rules that a row can break on its own."""
    rules = [(f"{c} not null", F.col(c).isNull()) for c in NOT_NULL.get(name, [])]
    rules += [(f"{c} domain", ~F.col(c).isin(values)) for (table, c), values in DOMAINS.items() if table == name]
    rules += [(f"{c} length", F.length(c) > longest) for (table, c), longest in TEXT_LENGTHS.items() if table == name]
    rules += [(f"{label} range", ~F.expr(holds)) for table, label, holds in RANGES if table == name]
    return rules


def _own_rules(name: str) -> list[tuple[str, Column]]:
    """Value rules, and that there is a primary key."""
    key = PRIMARY_KEYS[name]
    return [(f"primary key {key_label(key)}", reduce(Column.__or__, [F.col(c).isNull() for c in key])), *_value_rules(name)]


class Offenders:
    """The broken keys of a set of tables, found once, when rows are first asked for, and the rows that have them."""

    def __init__(self, t: Tables, names: list[str] = BASE_TABLES):
        self.tables, self.names = t, names
        self.rules = key_rules(names)
        self._broken = broken_keys(t, names)  # also checks the columns

    @cached_property
    def keys(self) -> DataFrame:
        return stored_table(self._broken)

    @cached_property
    def rows_of(self) -> dict[int, int]:
        rows = self.keys.groupBy("rule").agg(F.sum("n").alias("rows")).collect()  # a row per rule
        return {row["rule"]: row["rows"] for row in rows}

    def _flagged(self, rows: DataFrame, rule: KeyRule, flag: str) -> DataFrame:
        """The rows with a column that says whether their key is among the rule's broken ones."""
        is_number, parts = _is_number(rule.table, rule.columns), _parts(rows, rule.table, rule.columns)
        key, kept = parts[0] if is_number else _joined(*parts), rows.columns
        found = F.col("number") if is_number else _joined(F.col("number"), F.col("second"), F.col("text"))
        own = self.keys.filter(F.col("rule") == rule.number).select(found.alias("_key"), "n")
        hot = F.col("n") * HOT_PART > self.rows_of[rule.number]
        often = F.broadcast(own.filter(hot).select("_key", F.lit(True).alias("_often")))  # fewer than HOT_PART keys
        seldom = own.filter(~hot).select(F.col("_key").alias("_own"), F.lit(True).alias("_seldom"))
        # Rows without a key or with a frequent one take part in the second join with keys of their own, spread over all
        # tasks; what those find is not used.
        settled = F.col("_often").isNotNull() | F.col("_key").isNull()
        spread = F.xxhash64(*kept)
        joined = (
            rows.withColumn("_key", key).join(often, "_key", "left")
            .withColumn("_own", F.when(settled, spread if is_number else spread.cast("string")).otherwise(F.col("_key")))
            .join(seldom, "_own", "left")
        )
        broken = F.col("_often").isNotNull() | (~settled & F.col("_seldom").isNotNull())
        return joined.select(*kept, broken.alias(flag))

    def rows(self, name: str) -> DataFrame:
        """The rows of a table that break a rule, all their columns, and ``broken_rules``."""
        df = tagged = self.tables[name]
        broken: list[tuple[str, Column]] = []
        for rule in (rule for rule in self.rules if rule.table == name):
            bad = F.lit(False)
            if rule.number in self.rows_of:
                tagged = self._flagged(tagged, rule, f"_broken_{rule.number}")
                bad = F.col(f"_broken_{rule.number}")
            if rule.name.startswith("primary key"):
                bad = bad | reduce(Column.__or__, [F.col(c).isNull() for c in rule.columns])
            broken.append((rule.name, bad))
        broken += _value_rules(name)
        named = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in broken]))
        return tagged.select(*df.columns, named.alias(BROKEN)).filter(F.size(BROKEN) > 0)

    def by_rule(self, name: str) -> DataFrame:
        """An offending row once for each rule it breaks, in column ``rule``."""
        rows = self.rows(name)
        return rows.select(F.explode(BROKEN).alias("rule"), *[c for c in rows.columns if c != BROKEN])

    def summary(self) -> DataFrame:
        """``(table_name, rule, offending_rows)`` of all rules that are broken.

        Counted from keys and from sets of broken value rules in one read of every table; no row is looked up.
        """
        return KeyCounts(self.tables, self.names, values=True).rows_by_rule().withColumnRenamed("n", "offending_rows")

    def quarantine(self, folder: str) -> list[str]:
        """Write the offending rows of every table to ``folder/<table>``, split by rule; returns the tables that have any.

        A row that breaks several rules stands under each of them.  Earlier quarantines of the tables are replaced.
        """
        for name in self.names:
            self.by_rule(name).write.mode("overwrite").partitionBy("rule").parquet(f"{folder}/{name}")
        spark = self.keys.sparkSession
        return [name for name in self.names if not quarantined(spark, folder, name, self.tables[name].schema).isEmpty()]


def quarantined(spark: SparkSession, folder: str, name: str, schema: T.StructType, rule: str | None = None) -> DataFrame:
    """Offending rows of a table as written, of one rule if it is given: other rules' files are not opened."""
    whole = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema], T.StructField("rule", T.StringType(), True)])
    df = spark.read.schema(whole).parquet(f"{folder}/{name}")
    return df if rule is None else df.filter(F.col("rule") == rule)
