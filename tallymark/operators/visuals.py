"""Captured visuals: titles, positions, headings, cards, slicers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import vocab
from tallymark.functions.classify import CHART_TYPES, effective_type
from tallymark.functions.numbers import strip
from tallymark.functions.text import first_line, is_noisy, let, lines_of
from tallymark.operators.ranking import blocked_prefix_sum
from tallymark.session import cut

HEADING_GAP = 80
HEADING_OVERLAP = 0.30
#: Width of the cells in which boxes and charts meet, and boxes that a chart looks at in one step.
CELL = 64
LOOK = 256


def card_pairs(lines: Column) -> Column:
    """Label and value pairs of a card that shows several figures, else empty.

    Lines are read two by two as long as the first looks like a label and the second
    is short; two such pairs make a multi-value card.
    """
    def good(p: Column) -> Column:
        return (
            p["label"].rlike("[a-zA-Z_]") & (F.length(p["label"]) > 2)
            & ~is_noisy(p["label"]) & (F.length(p["value"]) <= 50)
        )

    def pairs_of(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(found) / 2).cast("int") - 1),
            lambda k: F.struct(
                k.alias("sub_index"),
                F.get(found, k * 2).alias("label"),
                F.get(found, k * 2 + 1).alias("value"),
            ))

    def leading(pairs: Column) -> Column:
        first_bad = F.array_position(F.transform(pairs, good), False).cast("int")
        return let(F.when(first_bad == 0, F.size(pairs)).otherwise(first_bad - 1),
                   lambda n: F.when(n >= 2, F.slice(pairs, F.lit(1), n)))

    return let(lines, lambda found: F.when(F.size(found) >= 4, let(pairs_of(found), leading)))


def expand_visuals(raw: DataFrame, indexed: bool = False) -> DataFrame:
    """Visuals with type, title and noise flag; multi-value cards give one row per figure.

    `raw(page, ordinal, type, full_text, x, y, width, height)`. Rows of one card share
    its `ordinal` and are told apart by `sub_index`, which is null for plain visuals.

    `indexed` adds `type_index`, the 0-based position among the visuals of one type on a
    page. The figures of a card count one by one, so a card carries their number as its
    weight and the running total is taken before cards are taken apart.
    """
    # The table fallback only concerns untyped visuals, so the card test can use `type`.
    paired = raw.withColumn("full_text", F.trim("full_text", F.lit(" \n\t\r"))).withColumns({
        "type": effective_type(F.col("type"), F.col("full_text")),
        "__pairs": F.when(F.col("type").isin(vocab.MULTI_VALUE_TYPES),
                          card_pairs(lines_of(F.col("full_text")))),
    })
    if indexed:
        paired = blocked_prefix_sum(
            paired, ["page", "type"], "ordinal", "type_index",
            F.coalesce(F.size("__pairs"), F.lit(1)))
    flat = paired.select("*", F.inline_outer("__pairs")).drop("__pairs")
    if indexed:
        flat = flat.withColumn(
            "type_index", F.col("type_index") + F.coalesce("sub_index", F.lit(0)))
    title = F.coalesce("label", first_line(F.col("full_text")))
    text = F.when(F.col("label").isNotNull(), F.concat_ws("\n", "label", "value")).otherwise(
        F.col("full_text"))
    return flat.withColumns({"title": title, "full_text": text}).withColumn(
        "noisy", is_noisy(F.col("title"))).drop("label")


def _nearest_above(max_gap: float, least_overlap: float):
    """Arrow pass over boxes and frames of a cell in the order of height: each frame with its box.

    Boxes are remembered while they are at most `max_gap` above. A frame looks at them from the nearest one
    on, `LOOK` at a time, and stops at the first that fits, so pairs are not made.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        cell, x, w, at, boxes = None, [], [], [], []
        start = 0
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(9)])
            found = []
            for page, strip_no, cell_no, y, left, width, is_box, ordinal, heading in rows:
                here = (page, strip_no, cell_no)
                if here != cell:
                    cell, start, n = here, 0, 0
                    x, w, at, boxes = np.empty(64), np.empty(64), np.empty(64), []
                if is_box:
                    if n == len(x):  # forget boxes that are too far up, or make room
                        if start > n // 2:
                            for a in (x, w, at):
                                a[:n - start] = a[start:n]
                            boxes = boxes[start:]
                            n, start = n - start, 0
                        else:
                            x, w, at = (np.concatenate([a, np.empty(len(a))]) for a in (x, w, at))
                    x[n], w[n], at[n] = left, width, y
                    boxes.append((ordinal, heading))
                    n += 1
                    continue
                start += int(np.searchsorted(at[start:n], y - max_gap - 1.0))
                end = n
                while end > start:
                    low = max(start, end - LOOK)
                    narrower = np.minimum(w[low:end], width)
                    shared = np.maximum(0.0, np.minimum(x[low:end] + w[low:end], left + width) - np.maximum(x[low:end], left))
                    fits = (y - at[low:end] <= max_gap) & (
                        (narrower <= 0) | (shared / np.where(narrower > 0, narrower, 1.0) >= least_overlap))
                    if fits.any():
                        k = low + int(np.flatnonzero(fits)[-1])
                        found.append((page, left, y, width, y - float(at[k]), *boxes[k]))
                        break
                    end = low
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (
                        pa.string(), *[pa.float64()] * 4, pa.int64(), pa.string()))],
                    names=["page", "x", "y", "width", "gap", "box_ordinal", "heading"])

    return run


def headings(visuals: DataFrame) -> DataFrame:
    """Heading text box of each chart whose own title is noise.

    A heading ends at most 80 px above the chart and shares at least 30 % of the
    narrower width; the smallest gap wins, then the first box. Equal boxes and equal
    chart frames are merged before they meet. They are dealt by page, strip of 80 px and cells of `CELL`
    px across, so that a full strip is work for many tasks, and a task sweeps a cell from top to bottom
    (`_nearest_above`). Boxes and frames without a width fit whatever stands below or above them and meet
    in a cell of their own. Gives `(page, ordinal, heading)`.
    """
    box_title = F.split(F.trim(F.coalesce(
        F.nullif("title", F.lit("")), F.col("full_text")), F.lit(" \n\t\r")), "\n")[0]
    columns = ["page", "strip", "at", "x", "width", "is_box", "ordinal", "heading"]
    boxes = (
        visuals.where(F.col("type") == vocab.HEADING_TYPE)
        .select("page", "ordinal", "x", "width", (F.col("y") + F.col("height")).alias("at"),
                box_title.alias("heading"))
        .where(F.coalesce("heading", F.lit("")) != "")
        .groupBy("page", "x", "width", "at")
        .agg(F.min_by("heading", "ordinal").alias("heading"), F.min("ordinal").alias("ordinal"))
        .withColumn("strip", F.floor(F.col("at") / HEADING_GAP)).withColumn("is_box", F.lit(True))
        # A box may stand above charts of its own strip and of the next one.
        .withColumn("strip", F.explode(F.array("strip", F.col("strip") + 1))).select(*columns))
    charts = visuals.where(F.col("type").isin(CHART_TYPES) & F.col("noisy"))
    nothing = {"is_box": F.lit(False), "ordinal": F.lit(None).cast("bigint"), "heading": F.lit(None).cast("string")}
    frames = charts.select("page", "x", F.col("y").alias("at"), "width").distinct().withColumns(
        {"strip": F.floor(F.col("at") / HEADING_GAP), **nothing}).select(*columns)
    # Positions, not rows: few, and read again for those without a width.
    met = cut(boxes.unionByName(frames))
    flat = F.col("width") <= 0
    strips = ["page", "strip"]
    first, last = F.floor(F.col("x") / CELL), F.floor((F.col("x") + F.col("width")) / CELL)
    across = met.where(~flat).withColumn("cell", F.explode(F.sequence(first, last)))
    partners = met.where(flat).select(*strips, (~F.col("is_box")).alias("is_box")).distinct()
    anywhere = met.where(flat).unionByName(
        met.where(~flat).join(partners, [*strips, "is_box"], "left_semi").select(*columns))
    placed = across.unionByName(anywhere.withColumn("cell", F.lit(None).cast("bigint"))).repartition(*strips, "cell")
    ordered = placed.sortWithinPartitions(
        "page", "strip", "cell", "at", F.col("is_box").desc(), F.col("ordinal").desc())
    best = ordered.select("page", "strip", "cell", *[F.col(c).cast("double").alias(c) for c in ("at", "x", "width")],
                          "is_box", F.col("ordinal").cast("bigint").alias("ordinal"), "heading").mapInArrow(
        _nearest_above(float(HEADING_GAP), HEADING_OVERLAP),
        "page string, x double, y double, width double, gap double, box_ordinal bigint, heading string"
    ).groupBy("page", "x", "y", "width").agg(
        F.min_by("heading", F.struct("gap", "box_ordinal")).alias("heading"))
    return charts.join(best, ["page", "x", "y", "width"]).select("page", "ordinal", "heading")


def locate(specs: DataFrame, visuals: DataFrame) -> DataFrame:
    """Visual of each spec: by title when it has one, else by type and index.

    `specs(spec_id, page, visual_title, visual_type, visual_index)`,
    `visuals(page, ordinal, type, type_index, title)`. Visuals become lookup entries, so
    both ways are one equi-join and not an OR of two conditions.
    """
    titled = F.trim(F.coalesce("visual_title", F.lit(""))) != ""
    typed = ~titled & (F.coalesce("visual_type", F.lit("")) != "")
    zero = F.lit(0).cast("bigint")

    def entry(kind: str, name: Column, position: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), position.alias("position"))

    places = (
        visuals.select("page", "ordinal", F.inline(F.array(
            entry("title", F.col("title"), zero),
            entry("type_index", F.col("type"), F.col("type_index").cast("bigint")),
            entry("type", F.col("type"), zero))))
        .groupBy("page", "kind", "name", "position")
        .agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("visuals"))
    )
    wanted = specs.select(
        "spec_id", "page", "visual_type",
        F.when(typed, F.lit("type_index")).otherwise(F.lit("title")).alias("kind"),
        F.when(typed, F.col("visual_type")).otherwise(F.col("visual_title")).alias("name"),
        F.when(typed, F.coalesce("visual_index", F.lit(0)).cast("bigint")).otherwise(zero)
        .alias("position"))
    available = places.where(F.col("kind") == "type").select(
        "page", F.col("name").alias("visual_type"), F.col("visuals").alias("available"))
    return (
        wanted.join(places.drop("visuals"), ["page", "kind", "name", "position"], "left")
        .join(available, ["page", "visual_type"], "left")
        .select("spec_id", "page", F.col("kind").alias("strategy"), "ordinal",
                F.col("ordinal").isNotNull().alias("found"),
                F.coalesce("available", F.lit(0)).alias("available_of_type"))
    )


def card_values(specs: DataFrame, visuals: DataFrame) -> DataFrame:
    """Raw figure of each titled card.

    `specs(page, visual_title)`, `visuals(page, ordinal, full_text)`. A visual that
    starts with the title wins over one that has it further down; within a visual the
    line after the title wins over a tab-separated pair.
    """
    wanted = specs.select("page", "visual_title").distinct()
    lines = lines_of(F.col("full_text"))
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    figure = F.filter(rest, lambda x: ~x.rlike(vocab.CARD_DATE_LINE)
                      & ~x.rlike(vocab.CARD_SUB_LABEL_LINE)
                      & (F.length(x) < 40) & ~x.rlike("^YoY"))
    own_value = F.coalesce(F.get(figure, F.lit(0)), F.get("lines", F.lit(1)), F.col("full_text"))
    texts = visuals.select("page", "ordinal", lines.alias("lines"),
                           F.trim("full_text", F.lit(" \n\t\r")).alias("full_text"))

    def candidate(rank: int, position: Column, title: Column, value: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), position.cast("int").alias("line_no"),
                        title.alias("visual_title"), value.alias("raw"))

    def parts_of(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, "\t"), strip), lambda p: p != "")

    own = F.array(candidate(1, F.lit(0), F.get("lines", F.lit(0)), own_value))
    after = F.transform("lines", lambda x, i: candidate(2, i, x, F.get("lines", i + 1)))
    tabbed = F.transform("lines", lambda x, i: candidate(
        3, i, F.get(parts_of(x), F.lit(0)),
        F.when(F.size(parts_of(x)) == 2, F.get(parts_of(x), F.lit(1)))))
    usable = F.filter(F.concat(own, after, tabbed), lambda c:
                      c["visual_title"].isNotNull() & F.coalesce(c["raw"] != "", F.lit(False))
                      & ((c["rank"] == 1) | (c["visual_title"] != F.get("lines", F.lit(0)))))
    found = (
        texts.where(F.size("lines") > 0)
        .select("page", "ordinal", F.inline(usable))
        .join(wanted, ["page", "visual_title"], "left_semi")
    )
    # Own title first over all visuals; otherwise the first visual, then the way inside it.
    best = found.groupBy("page", "visual_title").agg(F.min_by("raw", F.struct(
        F.when(F.col("rank") == 1, 0).otherwise(1), F.col("ordinal"), F.col("rank"),
        F.col("line_no"))).alias("raw"))
    return specs.join(best, ["page", "visual_title"], "left")


def page_slicers(visuals: DataFrame) -> DataFrame:
    """Slicers of each page with their selection, `All` when nothing is selected.

    `visuals(page, ordinal, type, title, full_text, selected)`; untitled ones are dropped.
    """
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(
        F.trim(F.split("full_text", "\n")[0]), F.lit("")))
    return (
        visuals.where(F.contains(F.lower("type"), F.lit("slicer")))
        .select("page", "ordinal", title.alias("slicer_title"),
                F.when(F.size(F.coalesce("selected", F.array().cast("array<string>"))) == 0,
                       F.array(F.lit("All"))).otherwise(F.col("selected")).alias("values"))
        .where(F.col("slicer_title").isNotNull())
    )


def page_titles(visuals: DataFrame) -> DataFrame:
    """`(page, ordinal, title)` of named pages and titled visuals, one row per title."""
    return visuals.select(
        F.trim("page").alias("page"), "ordinal", F.trim("title").alias("title")
    ).where((F.col("page") != "") & (F.col("title") != ""))
