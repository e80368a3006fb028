"""Column catalog: fuzzy header matching, table choice, foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import (
    is_date_type, is_numeric_type, is_text_type, match_form,
)
from tallymark.operators.foreign_keys import check_keys

GRAM = 4
#: Longest text that is looked up as it is.
SHORT = 16
#: Bits below the level in a rank: 24 for the table, 32 for the column.
LEVEL_SHIFT = 56
LEVEL_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "NONE": 0}


def catalog_of(frames: dict[str, DataFrame]) -> DataFrame:
    """Catalog of the given tables and views, from their schemas alone."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (table, t, f.name, c, f.dataType.simpleString().upper(), f.nullable)
        for t, (table, df) in enumerate(frames.items())
        for c, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table string, table_no int, column string, column_no int, type string, "
              "nullable boolean")


def _substrings(form: Column, lengths: Column) -> Column:
    """Substrings of the given lengths; lengths beyond the text give none."""
    def of_length(n: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(form) - n + 1), lambda i: F.substr(form, i, n))

    fitting = F.filter(lengths, lambda n: n <= F.length(form))
    return F.flatten(F.transform(fitting, of_length))


def _entries(kind: str, keys: Column) -> Column:
    return F.transform(F.array_distinct(keys), lambda k: F.struct(
        F.lit(kind).alias("kind"), k.alias("key")))


def _long_matches(names: DataFrame, forms: DataFrame) -> DataFrame:
    """`(key_of, weight, id)` of long names inside long headers and of long headers inside long names.

    `names(form, id)`, `forms(form, key_of)`. A text that lies inside another shares all of its runs, so one
    run finds it: the one that fewest names have.
    """
    def runs(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(
            _substrings(F.col("form"), F.array(F.lit(SHORT))))).alias("run"))

    held, asked = runs(names, "id"), runs(forms, "key_of")
    counts = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "run"))["run"].alias("run")
    of_names = held.join(counts, "run").groupBy("id").agg(rarest)
    # A header with a run that no name has lies inside none.
    of_forms = asked.join(counts, "run", "left").groupBy("key_of").agg(
        rarest, F.bool_and(F.col("n").isNotNull()).alias("possible")).where("possible").drop("possible")
    inside = asked.join(of_names, "run").select("key_of", "id", F.lit(True).alias("name_inside"))
    around = of_forms.join(held, "run").select("key_of", "id", F.lit(False).alias("name_inside"))
    pairs = inside.unionByName(around).join(names.withColumnRenamed("form", "name"), "id").join(forms, "key_of")
    holds = F.when(F.col("name_inside"), F.contains("form", "name")).otherwise(F.contains("name", "form"))
    return pairs.where(holds).select(
        "key_of", F.when(F.col("form") == F.col("name"), 3).otherwise(2).alias("weight"), "id")


def best_columns(headers: DataFrame, catalog: DataFrame,
                 empty_header_matches: bool = False) -> DataFrame:
    """Best catalog column of each distinct header form, as `(form, best)`.

    HIGH: same letters and digits. MEDIUM: one contains the other. LOW: they share four
    characters in a row. Within a level the first table and column wins.

    Nothing is compared pair by pair. The catalog becomes an index from text to its first column: whole
    names and all texts of up to `SHORT` characters inside names, so its rows are linear in the length of a
    name, and distinct headers look up their own texts of such lengths by equality. Where a name and a
    header are both longer, the one that is to lie inside the other is found by its rarest run of `SHORT`
    characters and then compared.

    `headers(header, ...)`, `catalog(table, table_no, column, column_no, type)`. Headers
    without letters or digits match nothing unless `empty_header_matches`.
    """
    # One number per column in catalog order: sums and minima of numbers stay in hash aggregates.
    numbered = catalog.withColumn(
        "id", F.shiftleft(F.col("table_no").cast("bigint"), 32) + F.col("column_no"))
    columns = numbered.groupBy(match_form(F.col("column")).alias("form")).agg(F.min("id").alias("id"))
    places = numbered.select("id", F.struct(
        "table_no", "column_no", "table", "column", "type").alias("place"))
    form, long = F.col("form"), F.length("form") > SHORT
    named = columns.where(form != "")
    # Headers travel under a short key, as a long one has many lookups.
    forms = headers.select(match_form(F.col("header")).alias("form")).where(
        form != "").distinct().withColumn("key_of", F.md5(form.cast("binary")))

    def short(text: Column) -> Column:
        return _substrings(text, F.sequence(F.lit(1), F.lit(SHORT)))

    none = F.array().cast("array<string>")
    gram = _substrings(form, F.array(F.lit(GRAM)))
    index = named.select("id", F.inline(F.concat(
        _entries("whole", F.when(~long, F.array(form)).otherwise(none)), _entries("inside", short(form)),
        _entries("gram", gram)))).groupBy("kind", "key").agg(F.min("id").alias("id"))
    lookups = forms.select("key_of", (~long).alias("is_short"), F.inline(F.concat(
        _entries("whole", short(form)), _entries("inside", F.when(~long, F.array(form)).otherwise(none)),
        _entries("gram", gram))))
    equal = (F.col("kind") == "whole") & F.col("is_short") & (F.md5(F.col("key").cast("binary")) == F.col("key_of"))
    weight = F.when(equal, 3).when(F.col("kind") != "gram", 2).otherwise(1)
    found = lookups.join(index, ["kind", "key"]).select("key_of", weight.alias("weight"), "id").unionByName(
        _long_matches(named.where(long), forms.where(long)))
    rank = F.shiftleft((LEVEL_WEIGHT["HIGH"] - F.col("weight")).cast("bigint"), LEVEL_SHIFT) + F.col("id")
    level = F.shiftright("rank", LEVEL_SHIFT)
    best = found.groupBy("key_of").agg(F.min(rank).alias("rank")).select(
        "key_of", (level - LEVEL_WEIGHT["HIGH"]).cast("int").alias("weight"),
        (F.col("rank") - F.shiftleft(level, LEVEL_SHIFT)).alias("id"),
    ).join(places, "id").join(forms, "key_of").select("form", F.struct("weight", "place").alias("best"))
    if not empty_header_matches:
        return best
    first = columns.agg(F.min("id").alias("id")).join(places, "id")
    return best.unionByName(first.select(F.lit("").alias("form"), F.struct(
        F.lit(-LEVEL_WEIGHT["MEDIUM"]).alias("weight"), "place").alias("best")))


def match_columns(headers: DataFrame, catalog: DataFrame,
                  empty_header_matches: bool = False) -> DataFrame:
    """Headers with their best catalog column, its confidence and type family."""
    return attach_columns(headers, best_columns(headers, catalog, empty_header_matches))


def attach_columns(headers: DataFrame, best: DataFrame) -> DataFrame:
    """Headers with the columns found by `best_columns`; NONE where there is none."""
    # Nothing after this join needs its partitioning, so Spark may split a hot form.
    matched = headers.withColumn("form", match_form(F.col("header"))).join(
        best, "form", "left").drop("form")
    level = F.lit("NONE")
    for name, value in LEVEL_WEIGHT.items():
        level = F.when(F.col("best.weight") == -value, name).otherwise(level)
    kind = F.col("db_type")
    return (
        matched.withColumn("confidence", level)
        .withColumn("db_table", F.coalesce("best.place.table", F.lit("")))
        .withColumn("db_col", F.coalesce("best.place.column", F.lit("")))
        .withColumn("db_type", F.coalesce("best.place.type", F.lit("")))
        .withColumn("is_numeric", is_numeric_type(kind))
        .withColumn("is_date", is_date_type(kind))
        .withColumn("is_categorical", is_text_type(kind))
        .drop("best")
    )


def _weight(confidence: Column) -> Column:
    weight = F.lit(0)
    for level, value in LEVEL_WEIGHT.items():
        weight = F.when(confidence == level, value).otherwise(weight)
    return weight


def header_sets(matches: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Per visual: the table that fits its headers best and the confidence of the set.

    `matches` is the output of `match_columns`. The table has the largest sum of
    confidence weights; ties go to names that start with `fact`, then to the table matched
    first. The confidence is over all headers: HIGH when every match is, MEDIUM when any
    match is HIGH or MEDIUM, and LOW for weak matches with unmatched headers beside them.
    Gives `(*by, db_table, score, any_numeric, confidence)`; a visual without a match has
    no table and NONE.
    """
    level = F.col("confidence")
    per_table = matches.groupBy(*by, "db_table").agg(
        F.sum(_weight(level)).alias("score"), F.min(ordinal).alias("__first"),
        F.bool_or("is_numeric").alias("any_numeric"),
        F.count_if(level == "HIGH").alias("__high"), F.count_if(level == "MEDIUM").alias("__medium"),
        F.count_if(level == "LOW").alias("__low"), F.count_if(level == "NONE").alias("__none"))
    fact = F.when(F.startswith(F.lower("db_table"), F.lit("fact")), 0).otherwise(1)
    found = F.col("db_table") != ""
    # Ordered so that the smallest struct is the winner; unmatched headers have no table.
    winner = F.min(F.when(found, F.struct(
        (-F.col("score")).alias("lost"), fact.alias("fact"), "__first", "db_table", "any_numeric")))
    high, medium, low, none = (F.sum(c) for c in ("__high", "__medium", "__low", "__none"))
    return per_table.groupBy(*by).agg(
        winner.alias("__best"),
        F.when(high + medium + low == 0, F.lit("NONE"))
        .when(medium + low == 0, F.lit("HIGH"))
        .when(high + medium > 0, F.lit("MEDIUM"))
        .when(none > 0, F.lit("LOW"))
        .otherwise(F.lit("MEDIUM")).alias("confidence"),
    ).select(*by, "__best.db_table", (-F.col("__best.lost")).alias("score"),
             "__best.any_numeric", "confidence")


def flatten_keys(constraints: DataFrame) -> DataFrame:
    """One row per column pair of declared foreign keys with column lists."""
    pair = F.explode(F.arrays_zip(F.col("from_cols"), F.col("to_cols")))
    return constraints.select("from_table", "to_table", pair.alias("__pair")).select(
        "from_table", F.col("__pair.from_cols").alias("from_col"),
        "to_table", F.col("__pair.to_cols").alias("to_col"),
    )


def check_foreign_keys(frames: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """Keys of one column each, `keys(from_table, from_col, to_table, to_col)`, as `flatten_keys` gives
    them; see `check_keys`."""
    single = keys.select("from_table", F.array("from_col").alias("from_cols"), "to_table",
                         F.array("to_col").alias("to_cols"))
    return check_keys(frames, single).select(
        "from_table", F.get("from_cols", F.lit(0)).alias("from_col"), "to_table",
        F.get("to_cols", F.lit(0)).alias("to_col"), "child_rows", "orphan_rows", "repeated_parent_keys", "holds")


def check_foreign_key(child: DataFrame, from_col: str, parent: DataFrame, to_col: str) -> DataFrame:
    """One row: child rows, orphans among them, repeated parent keys.

    Both sides are reduced to distinct keys with counts before they are joined, so a hot
    key crosses the shuffle once per map task.
    """
    children = child.groupBy(F.col(from_col).alias("key")).agg(
        F.count(F.lit(1)).alias("child_rows"))
    parents = parent.groupBy(F.col(to_col).alias("key")).agg(
        F.count(F.lit(1)).alias("parent_rows"))
    tagged = children.withColumn("parent_rows", F.lit(None).cast("bigint")).unionByName(
        parents.withColumn("child_rows", F.lit(None).cast("bigint")))
    keys = tagged.groupBy("key").agg(
        F.sum("child_rows").alias("child_rows"), F.sum("parent_rows").alias("parent_rows"))
    orphan = F.col("parent_rows").isNull() & F.col("key").isNotNull()
    return keys.agg(
        F.coalesce(F.sum("child_rows"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("child_rows"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(F.col("parent_rows") > 1).alias("repeated_parent_keys"),
    ).withColumn("holds", (F.col("orphan_rows") == 0) & (F.col("repeated_parent_keys") == 0))
