"""Reference data over registry rows: lookups, patches, priorities, reports of what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def us_phone(phone: Column) -> Column:
    """(303) 555-0100 from ten digits, or eleven with a leading 1; null otherwise."""
    d = F.regexp_replace(phone, r"\D", "")
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    return F.when(ten.isNotNull(), F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)))


def email(text: Column, excluded: Sequence[str] = ("example.com", "test.com")) -> Column:
    """Address in lower case; null if it has no usual form or an excluded host."""
    e = F.lower(F.trim(text))
    return F.when(e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & ~F.split_part(e, F.lit("@"), F.lit(2)).isin(*excluded), e)


def handle(text: Column) -> Column:
    """Social handle without @, address, query and fragment; null unless 3 to 30 letters, digits, dots or underscores."""
    h = F.regexp_replace(F.regexp_replace(F.trim(text), r"[?#].*$", ""), r"/+$", "")
    h = F.lower(F.regexp_replace(F.regexp_replace(h, r"^.*/", ""), r"^@", ""))
    return F.when(h.rlike(r"^[a-z0-9._]{3,30}$"), h)


def looked_up(rows: DataFrame, table: DataFrame, on: str, columns: dict[str, str]) -> DataFrame:
    """Left join with a default for each looked up column."""
    out = rows.join(table.select(on, *columns), on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in columns.items()})


def patched(base: DataFrame, patch: DataFrame, on: str, columns: Sequence[str], only_missing: bool = False) -> DataFrame:
    """base with the patch's values where they are not null; with only_missing, base's own values win."""
    p = patch.select(on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    pick = lambda c: F.coalesce(c, f"_new_{c}") if only_missing else F.coalesce(f"_new_{c}", c)
    return base.join(p, on, "left").withColumns({c: pick(c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def coverage(rows: DataFrame, columns: Sequence[str], good: float = 80, fair: float = 60) -> DataFrame:
    """Field, rows that have it, per cent, status; one pass for all fields."""
    one = rows.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(c).cast("string") != "", 1)).alias(c) for c in columns])
    out = one.select("_n", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("field", "n"))
    percent = F.round(F.coalesce(F.try_divide(F.col("n") * 100, F.col("_n")), F.lit(0.0)), 2)
    return out.select("field", "n", percent.alias("percent"), F.when(percent >= good, "good").when(percent >= fair, "fair").otherwise("poor").alias("status"))


def first_tier(choices: Sequence[DataFrame], by: str) -> DataFrame:
    """Rows of the first of several tables that has the key; all of that table's rows for the key stay."""
    both = None
    for tier, rows in enumerate(choices):
        rows = rows.withColumn("tier", F.lit(tier))
        both = rows if both is None else both.unionByName(rows)
    best = both.groupBy(by).agg(F.min("tier").alias("tier"))
    return both.join(best, [by, "tier"])


def transformed(rows: DataFrame, rules: DataFrame, text: str, most_rules: int = 1000) -> DataFrame:
    """Rows with what the first rule gives whose pattern is found in their text; null where none is.

    rules has ord and pattern and what a match gives. The short table becomes one expression of
    constant patterns, each compiled once in a task: no join, and a row stops at its first rule.
    """
    short = rules.orderBy("ord").limit(most_rules + 1).collect()
    if len(short) > most_rules:
        raise ValueError(f"more than {most_rules} rules: a table of patterns has to be short")
    given = [f for f in rules.schema if f.name not in ("ord", "pattern")]
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in given])
    hits = [F.when(F.col(text).rlike(r.pattern), F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in given])) for r in short]
    out = rows.withColumn("_rule", F.coalesce(*hits, none))
    return out.select(*rows.columns, *[F.col(f"_rule.{f.name}").alias(f.name) for f in given])
