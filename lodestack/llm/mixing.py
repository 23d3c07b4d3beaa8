"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in DataFrame operations.

A document's key is -ln(u) / w with u from a hash of its id and w its quality weight: ascending keys are a weighted
sample without replacement. A source with target T and size S gives all its documents floor(T / S) times; the rest of
T is filled in key order. Prefix sums never sort a source in one task: the key range is cut at its quantiles, whatever
the weights, slices are summed first, and only the one slice where a source's budget ends is ordered.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_number, staged

#: A source gives its own size this many times at most.
MOST = 3
#: Rows that one slice of the keys should hold, and slices at most; a slice is sorted by a window, which spills.
SLICE, SLICES = 4000, 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are no junk symbols, 0.05 at least; 1 for empty and null texts."""
    clean = F.length(F.translate(text, "#*$%&|<>", "")) / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(F.greatest(clean, F.lit(0.05)), F.lit(1.0))


def source_weight(rank: Column) -> Column:
    """1, 2, 3, repeating over the sources in code point order, null last."""
    return (rank % 3 + 1).cast("double")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The total is shared by weight; what a source would get beyond MOST times its size is shared again among the
    others, until none is above. Each round is one aggregation over the sources, whatever their number.
    """
    ranked = running_number(sizes, [F.col("source").asc_nulls_last()], "rank", "ranked")
    table = staged(ranked.select("source", "source_size", source_weight(F.col("rank")).alias("w")), "sources")
    top = F.col("source_size") * MOST
    share, full = None, -1
    while True:
        capped = F.lit(False) if share is None else F.col("w") * share > top
        row = table.agg(F.sum("source_size"), F.sum(F.when(capped, top).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("w"))), F.sum(capped.cast("int"))).first()
        if not row[0] or row[3] == full or not row[2]:
            break
        full = row[3]
        share = (row[0] - row[1]) / row[2]
    want = F.lit(0.0) if share is None else F.least(F.col("w") * share, top.cast("double"))
    return table.select("source", "source_size", want.cast("double").alias("target"))


def sliced(base: DataFrame) -> Column:
    """Slices of about equal numbers of rows, in the order of ``key``: the place among its approximate quantiles.

    The quantiles are a bounded list. They are looked up by halving: the first half of the steps in a list of lists.
    """
    n = max(2, min(SLICES, base.count() // SLICE))
    probes = F.array(*[F.lit(k / n) for k in range(1, n)])
    cuts = sorted(set(base.agg(F.percentile_approx("key", probes, F.lit(2 * n))).first()[0] or []))
    width = max(1, math.isqrt(len(cuts)))
    rows = [cuts[k : k + width] for k in range(0, len(cuts), width)] or [[]]
    past = lambda values: F.size(F.filter(values, lambda c: c < F.col("key")))
    row = past(_listed([r[-1] for r in rows if r]))  # rows of cuts that the key is past
    inner = F.get(F.from_json(F.lit(json.dumps(rows)), "array<array<double>>"), row)
    return (row * width + F.coalesce(past(inner), F.lit(0))).cast("long")


def _listed(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    size: words of the whole text (null: 0). Documents are taken whole; the one that crosses the budget is taken if
    that comes nearer. Empty texts take part with size 0. Rows that repeat an id share its key, ordered by size; rows
    without an id get a key by their text. A null source is a source of its own. Columns of docs beside these three
    are not read, whatever their names. An empty table gives no rows. Reruns agree.
    """
    w = quality_weight(F.col("text")) if weight is None else weight
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), (-F.log(u) / w).alias("key"))
    base = staged(base, "sized")
    base = base.withColumn("slice", sliced(base))
    summed = staged(base.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    sizes = summed.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    goal = staged(targets(sizes), "targets")
    size = F.nullif(F.col("source_size"), F.lit(0))
    epochs = F.coalesce(F.floor(F.col("target") / size), F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - epochs * F.col("source_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = summed.withColumn("before", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    # source may be null, which is a source of its own
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = plan.join(goal, same(plan, goal)).select(plan["source"], "slice", "before", "slice_size", "source_size", "target", "epochs", "rest")
    plan = staged(plan, "plan")
    rows = base.join(plan, same(base, plan) & (base["slice"] == plan["slice"])).select("doc_id", "size", "key", base["source"], plan["slice"], "before", "slice_size", "source_size", "target", "epochs", "rest")
    inside, beyond = F.col("before") + F.col("slice_size") <= F.col("rest"), F.col("before") >= F.col("rest")
    split = ~inside & ~beyond
    sure = rows.where(~split).withColumn("taken", F.col("size") * (F.col("epochs") + inside.cast("int")))
    inner = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    edge = rows.where(split).withColumn("at", at).withColumn("taken", F.col("size") * (F.col("epochs") + (F.col("at") + F.col("size") / 2 <= F.col("rest")).cast("int")))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return sure.select(columns).unionByName(edge.select(columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns as they came. Documents without words stay once.

    Ids are expected to be unique; rows that share an id are taken as often as the id's row with the largest share.
    """
    times = F.coalesce(F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0))), F.lit(1)).cast("int")
    taken = mix(docs).select(F.col("doc_id").alias("__id"), times.alias("__times")).groupBy("__id").agg(F.max("__times").alias("__times"))
    both = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).where("__times > 0")
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
