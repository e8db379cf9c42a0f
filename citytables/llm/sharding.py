"""K-d tree sharding by distributed weighted medians (DataFrame functions only).

The tree is grown level by level. A node that stands for s shards is cut along its widest
metadata dimension (extent over the extent of the whole table) at the weighted quantile
floor(s / 2) / s of its bytes, so that after ceil(log2(shards)) levels each leaf holds the
target bytes. A cut is found by histograms: each pass sums bytes per (node, bin) with
map-side partial sums, and the driver sees at most shards x bins sums, never rows. Rows with
one value in the cut's dimension (a hot source) are split further by id and then by row.

Columns beside the id and the text may be missing, null or of any type; extra columns are
ignored. A null text has 0 bytes. Rows may repeat; every row gets its own place, and rows with equal texts
are dealt like any others: each by its own metadata and id, in one shard or in several. Rows alike in the cut's
dimension and in id are ordered by their place in the table. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citytables.llm.common import lookup, written

ROW_OVERHEAD = 8


def code(df: DataFrame, name: str) -> Column:
    """A long that keeps the order of a column of numbers; null is least."""
    value = F.unix_date(name) if isinstance(df.schema[name].dataType, T.DateType) else F.col(name)
    return F.coalesce(value.cast("long"), F.lit(-(2**62)).cast("long"))


def ranked(df: DataFrame, name: str, hot_rows: int = 50_000) -> DataFrame:
    """df with a column of strings replaced by the ranks of its values (in byte order; null is -1).

    The different values are sorted in ranges, so neither they nor the rows of a common value meet in one task.
    """
    held = df.withColumn("__null", F.col(name).isNull()).withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")))
    values = held.groupBy(name).agg(F.count("*").alias("__places")).repartitionByRange(name).withColumn("__part", F.spark_partition_id())
    values = written(values, "kd-values")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = values.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(name)) - 1
    ranks = written(values.withColumn("__rank", rank).join(F.broadcast(starts), "__part").select(name, "__places", (F.col("__start") + F.col("__rank")).alias("__rank")), "kd-ranks")
    found = lookup(held, ranks, [name], "__places", hot_rows)
    return found.withColumn(name, F.when(F.col("__null"), F.lit(-1)).otherwise(F.col("__rank")).cast("long")).select(*df.columns)


def _below(node: dict) -> Column:
    """Whether a row goes to the left child: (value, id, row) at most the cut, in that order."""
    return reduce(
        lambda rest, kv: (F.col(kv[0]) < F.lit(kv[1])) | ((F.col(kv[0]) == F.lit(kv[1])) & rest),
        reversed(node["cut"][:-1]),
        F.col(node["cut"][-1][0]) <= F.lit(node["cut"][-1][1]),
    )


def _place(node: dict) -> Column:
    """The number of the leaf of a row, as one expression over the tree."""
    if "cut" not in node:
        return F.lit(node["first"])
    return F.when(_below(node), _place(node["left"])).otherwise(_place(node["right"]))


def _leaves(node: dict) -> list[dict]:
    return [node] if "cut" not in node else _leaves(node["left"]) + _leaves(node["right"])


def _find_cuts(rows: DataFrame, active: list[dict], bins: int, slack: float) -> None:
    """Set node['cut'] of each active node; one aggregation per pass for all nodes together.

    A bin of one row, or of at most slack bytes, isn't searched further.
    """
    for n in active:
        n |= {"prefix": [], "below": 0, "todo": list(n["keys"])}
        n["lo"], n["hi"] = n["span"][n["todo"][0]]
    open_nodes = list(active)
    while open_nodes:
        bin_of, node_of = F.lit(None).cast("long"), F.lit(None).cast("int")
        for n in open_nodes:
            key = F.col(n["todo"][0])
            n["width"] = max(1, -(-(n["hi"] - n["lo"] + 1) // bins))
            inside = (F.col("__leaf") == n["first"]) & key.between(n["lo"], n["hi"])
            for k, v in n["prefix"]:
                inside = inside & (F.col(k) == F.lit(v))
            shifted = key - F.lit(n["lo"]) if n["hi"] - n["lo"] < 2**62 else key.cast("decimal(20,0)") - F.lit(n["lo"]).cast("decimal(20,0)")
            bin_of = F.when(inside, _div(shifted, n["width"])).otherwise(bin_of)
            node_of = F.when(inside, F.lit(n["first"])).otherwise(node_of)
        sums = rows.select(node_of.alias("n"), bin_of.alias("b"), "size").where("n is not null").groupBy("n", "b").agg(F.sum("size").alias("w"), F.count("*").alias("c")).collect()
        by_node: dict[int, list] = {}
        for r in sums:
            by_node.setdefault(r["n"], []).append((r["b"], r["w"], r["c"]))
        still = []
        for n in open_nodes:
            for b, w, c in sorted(by_node[n["first"]]):
                if n["below"] + w >= n["target"]:
                    break
                n["below"] += w
            lo = n["lo"] + b * n["width"]
            hi = min(n["hi"], lo + n["width"] - 1)
            if c == 1 or w <= slack:  # the cut lies beside these rows, on the nearer side
                before = n["below"] + w - n["target"] > n["target"] - n["below"]
                n["cut"] = [*n.pop("prefix"), (n["todo"][0], lo - 1 if before else hi)]
            elif n["width"] > 1:
                n["hi"], n["lo"] = hi, lo
                still.append(n)
            else:  # many rows with one value
                n["prefix"].append((n["todo"].pop(0), lo))
                n["lo"], n["hi"] = n["span"][n["todo"][0]]
                still.append(n)
        open_nodes = still


def _div(value: Column, width: int) -> Column:
    """Whole quotient of a value that is not negative; exact, as the quotient is a bin number."""
    return F.round((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def kd_shards(
    docs: DataFrame,
    shards: int = 24,
    dims: tuple[str, ...] = ("source", "lang", "__size", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
    bins: int = 4096,
    tolerance: float = 0.001,
    rows_per_slot_run: int = 20_000,
) -> DataFrame:
    """Each row of docs with its shard and slot, by a k-d tree over the metadata dims.

    Returns id_col, size (UTF-8 bytes + 8), text_crc32, shard (0 .. shards - 1) and slot
    (gapless from 0 in each shard). Each cut is exact up to one row or tolerance x the target bytes.
    `__size` among dims stands for the row's bytes. Dims that docs lacks are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    have = [d for d in dims if d == "__size" or d in docs.columns]
    size = (F.octet_length(text) + ROW_OVERHEAD).cast("long")
    is_text = lambda d: d != "__size" and not isinstance(docs.schema[d].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
    string_id = is_text(id_col)
    compact = docs.select(
        F.col(id_col).alias("__out_id"),
        (F.col(id_col).cast("string") if string_id else code(docs, id_col)).alias("__id"),
        F.monotonically_increasing_id().alias("__row"),
        size.alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        *[(size if d == "__size" else F.col(d).cast("string") if is_text(d) else code(docs, d)).alias(f"__d{i}") for i, d in enumerate(have)],
    )
    compact = written(compact, "kd-rows")
    for name in [f"__d{i}" for i, d in enumerate(have) if is_text(d)] + ["__id"] * string_id:
        compact = ranked(compact, name)
    compact = written(compact, "kd-ranked")
    keys = [f"__d{i}" for i in range(len(have))] + ["__id", "__row"]
    root: dict = {"first": 0, "shards": shards}
    widest = None
    while any(n["shards"] > 1 for n in _leaves(root)):
        rows = compact.withColumn("__leaf", _place(root))
        stats = rows.groupBy("__leaf").agg(F.sum("size").alias("w"), *[f(k).alias(f"{f.__name__}{k}") for k in keys for f in (F.min, F.max)]).collect()
        if not stats:  # no rows
            break
        total = sum(r["w"] for r in stats)
        by_leaf = {r["__leaf"]: r for r in stats}
        active = []
        for n in _leaves(root):
            if n["shards"] == 1:
                continue
            s = by_leaf.get(n["first"])
            if s is None:  # nothing here to cut: all children stay empty
                n["cut"], n["left"], n["right"] = [("__row", -1)], {"first": n["first"], "shards": n["shards"] // 2}, {"first": n["first"] + n["shards"] // 2, "shards": n["shards"] - n["shards"] // 2}
                continue
            n["span"] = {k: (s[f"min{k}"], s[f"max{k}"]) for k in keys}
            if widest is None:
                widest = {k: max(1, hi - lo) for k, (lo, hi) in n["span"].items()}
            extent = lambda k, n=n: (n["span"][k][1] - n["span"][k][0]) / widest[k]
            dim = max(keys[: len(have)], key=extent, default="__id")
            n["keys"] = [dim, "__id", "__row"] if dim != "__id" else ["__id", "__row"]
            n["target"] = s["w"] * (n["shards"] // 2) / n["shards"]
            active.append(n)
        _find_cuts(rows, active, bins, total / shards * tolerance)
        for n in active:
            half = n["shards"] // 2
            n["left"], n["right"] = {"first": n["first"], "shards": half}, {"first": n["first"] + half, "shards": n["shards"] - half}
    placed = compact.withColumn("shard", _place(root).cast("int"))
    runs = max(1, -(-compact.count() // (shards * rows_per_slot_run)))
    placed = placed.withColumn("__run", F.pmod(F.xxhash64("__row"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__run").agg(F.count("*").alias("__n")).select("shard", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    in_run = Window.partitionBy("shard", "__run").orderBy("__row")
    return (
        placed.withColumn("__at", F.row_number().over(in_run) - 1)
        .join(starts, ["shard", "__run"])
        .select(F.col("__out_id").alias(id_col), "size", "text_crc32", "shard", (F.col("__start") + F.col("__at")).cast("long").alias("slot"))
    )
