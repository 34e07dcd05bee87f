"""Ordered rules as a table: the first rule whose conditions a row meets decides.

A row brings facts, strings such as `amenity=cafe` or `stem=muze`. A rule needs some facts and may forbid others. Facts are
looked up among the rules' conditions, met conditions are counted by row and rule, and the least complete rule wins; so no row
is compared with every rule. A table of up to MOST_CONDITIONS conditions goes to every task, inverted by fact, and rows are
decided where they lie; a larger one is joined to the facts by equality, with the same result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.functions import text as X

#: A fact that every row has, for rules without conditions.
ALWAYS = "always"
#: Letters of a word's beginnings that are facts.
SHORTEST, LONGEST = 3, 10


@dataclass(frozen=True)
class Rule:
    outcome: str
    need: tuple[str, ...]
    never: tuple[str, ...] = ()


def written(lines: str) -> list[Rule]:
    """Rules from lines `fact fact|other !forbidden -> outcome`, in order; alternatives become rules of their own."""
    out = []
    for line in filter(None, map(str.strip, lines.splitlines())):
        left, _, outcome = line.partition("->")
        parts = left.split()
        never = tuple(p[1:] for p in parts if p.startswith("!"))
        choices = [p.split("|") for p in parts if not p.startswith("!")]
        choices = [[c if "=" in c or "=" not in p[0] else f"{p[0].split('=')[0]}={c}" for c in p] for p in choices]
        out += [Rule(outcome.strip(), tuple(dict.fromkeys(need)) or (ALWAYS,), never) for need in itertools.product(*choices)]
    return out


def conditions(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule, outcome, needs, fact, forbids: one row for each condition."""
    rows = [(n, r.outcome, len(r.need), fact, fact in r.never) for n, r in enumerate(rules) for fact in (*r.need, *r.never)]
    return spark.createDataFrame(rows, "rule int, outcome string, needs int, fact string, forbids boolean")


def name_facts(name: Column) -> Column:
    """word= and stem= facts of a name: its folded words and their beginnings."""
    words = X.words(F.coalesce(name, F.lit("")))
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: n <= F.length(w)), lambda n: F.concat(F.lit("stem="), F.left(w, n)))))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("word="), w)), stems)


def facts(pairs: dict[str, Column], flags: dict[str, Column] | None = None) -> Column:
    """key=value facts of columns that are not null, and flags that hold."""
    said = [F.concat(F.lit(f"{k}="), c) for k, c in pairs.items()] + [F.when(c, F.lit(k)) for k, c in (flags or {}).items()]
    return F.array_compact(F.array(*said, F.lit(ALWAYS)))


#: Most conditions that are sent to every task; a larger table is joined instead.
MOST_CONDITIONS = 100_000


class Inverted:
    """Rules by the facts that they need or forbid."""

    def __init__(self, conditions: list):
        self.by_fact: dict[str, list[tuple[int, bool]]] = {}
        self.needs, self.outcome = {}, {}
        for rule, outcome, needs, fact, forbids in conditions:
            self.by_fact.setdefault(fact, []).append((rule, forbids))
            self.needs[rule], self.outcome[rule] = needs, outcome

    def fitting(self, facts: list[str]) -> list[int]:
        left: dict[int, int] = {}
        broken = set()
        for fact in set(facts):
            for rule, forbids in self.by_fact.get(fact, ()):
                if forbids:
                    broken.add(rule)
                else:
                    left[rule] = left.get(rule, self.needs[rule]) - 1
        return [rule for rule, n in left.items() if n == 0 and rule not in broken]


def _narrow(rows: DataFrame, key: str, facts: Column, conditions: list, out: str, said: Callable[[Inverted, list[int]], str | None]) -> DataFrame:
    """One stage, no shuffle: facts are looked up in the inverted rules, which every task has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Inverted(conditions)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([said(rules, rules.fitting(f)) for f in batch.column(1).to_pylist()], pa.string())], [key, out])

    each = rows.select(F.col(key), facts.alias("facts"))
    return each.mapInArrow(work, f"{key} {each.schema[key].dataType.simpleString()}, {out} string")


def _small(rules: DataFrame) -> list | None:
    """The conditions if they are few enough, in order of rules."""
    found = [tuple(r) for r in rules.select("rule", "outcome", "needs", "fact", "forbids").limit(MOST_CONDITIONS + 1).collect()]
    return sorted(found) if len(found) <= MOST_CONDITIONS else None


def _met(rows: DataFrame, key: str, facts: Column, rules: DataFrame) -> DataFrame:
    """key, rule, outcome, fits of every rule that a row has a fact of, by joining facts to conditions."""
    said = rows.select(key, F.explode(F.array_distinct(facts)).alias("fact"))
    met = said.join(rules, "fact", "left").groupBy(key, "rule").agg(F.count_if(~F.col("forbids")).alias("met"), F.coalesce(F.bool_or("forbids"), F.lit(False)).alias("broken"), F.first("needs").alias("needs"), F.first("outcome").alias("outcome"))
    return met.withColumn("fits", (F.col("met") == F.col("needs")) & ~F.col("broken"))


def first_match(rows: DataFrame, key: str, facts: Column, rules: DataFrame) -> DataFrame:
    """key, outcome (null where no rule fits) of every row; rules: from conditions(), or a table of its form. Keys are unique."""
    small = _small(rules)
    if small is not None:
        return _narrow(rows, key, facts, small, "outcome", lambda known, fit: known.outcome[min(fit)] if fit else None)
    met = _met(rows, key, facts, rules)
    return met.groupBy(key).agg(F.min_by("outcome", F.when(F.col("fits"), F.col("rule"))).alias("outcome"), F.bool_or("fits").alias("any")).select(key, F.when(F.col("any"), F.col("outcome")).alias("outcome"))


def every_match(rows: DataFrame, key: str, facts: Column, rules: DataFrame) -> DataFrame:
    """key, outcomes (sorted, distinct, comma-joined, empty where no rule fits): all rules that fit, in place of the first."""
    small = _small(rules)
    if small is not None:
        return _narrow(rows, key, facts, small, "outcomes", lambda known, fit: ",".join(sorted({known.outcome[r] for r in fit})))
    return _met(rows, key, facts, rules).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("fits"), F.col("outcome")))), ",").alias("outcomes"))


def sql_rules(rules: list[Rule]) -> str:
    """The same rules as SQL rows (rule, outcome, need, never)."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    return ", ".join(f"({n}, '{r.outcome}', {quoted(r.need)}, {quoted(r.never)})" for n, r in enumerate(rules))
