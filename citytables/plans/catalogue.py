"""Catalogue of the registered city-model queries: each operator on the adapter views, with SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citytables.functions import arrays, attributes, spatial
from citytables.operators import extent, filters, index, merge, selection, validate
from citytables.plans.adapter import GEO, OBJ, edges, features, geometries, objects, vertices
from citytables.session import materialised, spread, table
from citytables.sources import document, model
from citytables.sources.dataset import schema_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WINDOWS = (1, 10, 50, 100)


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent.object_extents(geometries(spark, sf_dir), vertices(spark, sf_dir))


_EXT = f"{GEO}, ext AS (SELECT g.cityobject_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM vtx v JOIN geo g USING (geometry_id) GROUP BY 1)"
_CELL = "CASE WHEN {w} > 0 THEN least(CAST(trunc(({c} - {lo}) / {w} * 65535) AS BIGINT), 65535) ELSE 0 END"
_HILBERT = f"""WITH RECURSIVE {_EXT}, whole AS (SELECT min(min_x) AS x0, min(min_y) AS y0, max(max_x) - min(min_x) AS w, max(max_y) - min(min_y) AS h FROM ext),
h AS (
  SELECT cityobject_id, CAST(32768 AS BIGINT) AS p, CAST(0 AS BIGINT) AS d, CAST({_CELL.format(c='(min_x + max_x) * 0.5', lo='x0', w='w')} AS BIGINT) AS x, CAST({_CELL.format(c='(min_y + max_y) * 0.5', lo='y0', w='h')} AS BIGINT) AS y FROM ext, whole
  UNION ALL
  SELECT cityobject_id, p // 2, d + p * p * xor(3 * CAST((x & p) > 0 AS BIGINT), CAST((y & p) > 0 AS BIGINT)),
    CASE WHEN (y & p) > 0 THEN x WHEN (x & p) > 0 THEN p - 1 - y ELSE y END, CASE WHEN (y & p) > 0 THEN y WHEN (x & p) > 0 THEN p - 1 - x ELSE x END
  FROM h WHERE p > 0
)"""


# -- extents and space


@query(f"WITH {_EXT} SELECT * FROM ext")
def object_extent(spark, sf_dir):
    return _extents(spark, sf_dir)


@query(f"WITH {_EXT} SELECT min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM ext")
def model_extent(spark, sf_dir):
    return extent.model_extent(_extents(spark, sf_dir))


@query(f"WITH {_EXT} SELECT cityobject_id, min_x, max_x, min_y, max_y FROM ext WHERE max_x >= 10 AND min_x <= 20 AND max_y >= 1000 AND min_y <= 20000")
def bbox_query(spark, sf_dir):
    return extent.bbox_query(_extents(spark, sf_dir), (10, 1000, 20, 20000)).select("cityobject_id", "min_x", "max_x", "min_y", "max_y")


@query(f"WITH {_EXT}, w AS (SELECT unnest([1, 10, 50, 100]) AS pct) SELECT CAST(pct AS INTEGER) AS pct, CAST(count(*) AS BIGINT) AS n FROM ext, w WHERE min_x <= 50 * pct / 100.0 AND min_y <= 100000 * pct / 100.0 GROUP BY 1")
def bbox_query_windows(spark, sf_dir):
    """Hits of windows of 1, 10, 50 and 100 % in one pass."""
    e = _extents(spark, sf_dir)
    hits = [spatial.overlaps(F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"), (0, 0, 50 * p / 100, 100000 * p / 100)) for p in WINDOWS]
    one = e.agg(*[F.count_if(h).alias(f"n{p}") for p, h in zip(WINDOWS, hits, strict=True)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"n{p}").alias("n")) for p in WINDOWS])).alias("r")).select("r.pct", "r.n").where("n > 0")


@query(_HILBERT + " SELECT cityobject_id, d AS hilbert FROM h WHERE p = 0")
def hilbert_order(spark, sf_dir):
    return extent.with_hilbert(_extents(spark, sf_dir), points=vertices(spark, sf_dir)).select("cityobject_id", "hilbert")


@query("SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS geometry_id, CAST(round(CAST(avg(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS BIGINT) AS mean_x, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def mean_coordinates(spark, sf_dir):
    v = vertices(spark, sf_dir)
    return v.groupBy("geometry_id").agg(F.round(F.avg(F.col("x").cast("decimal(18,2)")).cast("double")).cast("bigint").alias("mean_x"), F.count("*").alias("n"))


@query(
    "WITH inst AS (SELECT s_suppkey, CAST(s_suppkey % 5 AS BIGINT) AS t, CAST(s_nationkey AS DOUBLE) AS rx FROM supplier), tv AS (SELECT CAST(p_partkey % 5 AS BIGINT) AS t, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), "
    "e AS (SELECT s_suppkey, min(0 * x + -1 * y + 0 * 1 + 100 + rx) AS min_x, max(0 * x + -1 * y + 0 * 1 + 100 + rx) AS max_x, min(x + 0 * y + 0 * 1 + 50 + 2) AS min_y, max(x + 0 * y + 0 * 1 + 50 + 2) AS max_y FROM inst JOIN tv USING (t) GROUP BY 1) "
    "SELECT CAST(s_suppkey AS BIGINT) AS geometry_id, min_x, max_x, min_y, max_y FROM e"
)
def affine_instance_extent(spark, sf_dir):
    """Extents of template instances turned by a quarter and moved."""
    quarter = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 100, 1, 0, 0, 50, 0, 0, 1, 0, 0, 0, 0, 1)])
    instances = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("geometry_id"), (F.col("s_suppkey") % 5).alias("template_geometry_id"), quarter.alias("transform_matrix"), F.col("s_nationkey").cast("double").alias("rx"), F.lit(2.0).alias("ry"), F.lit(0.0).alias("rz"))
    points = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("template_geometry_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(1.0).alias("z"))
    return extent.instance_extents(instances, points).select("geometry_id", "min_x", "max_x", "min_y", "max_y")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round((l_extendedprice - 100.0) / 0.5) AS BIGINT) AS qy, CAST(round(l_quantity) AS BIGINT) AS qx FROM lineitem")
def quantize(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", spatial.quantize(F.col("l_extendedprice"), 0.5, 100.0).alias("qy"), spatial.quantize(F.col("l_quantity")).alias("qx"))


@query("SELECT o_orderkey, CAST(o_orderkey % 1000 AS DOUBLE) * 0.5 + 10.0 AS x FROM orders")
def dequantize(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", spatial.dequantize((F.col("o_orderkey") % 1000).cast("double"), 0.5, 10.0).alias("x"))


@query("SELECT 0.001 AS sx, min(l_quantity) AS tx, min(l_extendedprice) AS ty, min(abs(l_discount)) AS tz FROM lineitem".replace("0.001", "CAST(0.001 AS DOUBLE)"))
def auto_transform(spark, sf_dir):
    t = document.auto_transform(vertices(spark, sf_dir), (0.001, 0.001, 0.001))
    return t.select(F.col("scale")[0].alias("sx"), *[F.col("translate")[i].alias(f"t{a}") for i, a in enumerate("xyz")])


# -- selection algebra


_SEL = f"{OBJ}, {GEO}, low AS (SELECT cityobject_id, false AS whole, list_sort(list(geometry_id)) AS g FROM geo WHERE geometry_ordinal < 2 GROUP BY 1), odd AS (SELECT cityobject_id, false AS whole, list_sort(list(geometry_id)) AS g FROM geo WHERE geometry_ordinal % 2 = 1 GROUP BY 1), big AS (SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS cityobject_id FROM orders WHERE o_orderkey % 3 = 0)"


def _low(spark, sf_dir):
    return selection.select_geometries(objects(spark, sf_dir), geometries(spark, sf_dir), F.col("geometry_ordinal") < 2)


def _odd(spark, sf_dir):
    return selection.select_geometries(objects(spark, sf_dir), geometries(spark, sf_dir), F.col("geometry_ordinal") % 2 == 1)


def _third(spark, sf_dir):
    return selection.select_objects(objects(spark, sf_dir), (F.col("object_type") == "Order") & (F.col("ix") % 3 == 4 * 10_000_000_000 % 3))


def _shown(s):
    return s.select("cityobject_id", "whole", F.array_join("geometry_ids", ",").alias("ids"))


@query(f"WITH {OBJ} SELECT cityobject_id, object_type FROM obj WHERE object_type IN ('Nation', 'Supplier') AND ix % 2 = 0")
def select_objects(spark, sf_dir):
    o = objects(spark, sf_dir)
    s = selection.select_objects(o, F.col("object_type").isin("Nation", "Supplier") & (F.col("ix") % 2 == 0))
    return s.join(o, "cityobject_id").select("cityobject_id", "object_type")


@query(f"WITH {_SEL} SELECT cityobject_id, whole, array_to_string(g, ',') AS ids FROM low")
def select_geometries(spark, sf_dir):
    return _shown(_low(spark, sf_dir))


@query(f"WITH {_SEL}, u AS (SELECT cityobject_id, bool_or(whole) AS whole, list_sort(list_distinct(flatten(list(g)))) AS g FROM (SELECT cityobject_id, whole, g FROM low UNION ALL SELECT cityobject_id, whole, g FROM odd UNION ALL SELECT cityobject_id, true, CAST([] AS BIGINT[]) FROM big) GROUP BY 1) SELECT cityobject_id, whole, CASE WHEN whole THEN '' ELSE array_to_string(g, ',') END AS ids FROM u")
def selection_union(spark, sf_dir):
    return _shown(selection.union(selection.union(_low(spark, sf_dir), _odd(spark, sf_dir)), _third(spark, sf_dir)))


@query(f"WITH {_SEL}, i AS (SELECT l.cityobject_id, list_sort(list_intersect(l.g, o.g)) AS g FROM low l JOIN odd o USING (cityobject_id)) SELECT cityobject_id, false AS whole, array_to_string(g, ',') AS ids FROM i JOIN big USING (cityobject_id) WHERE len(g) > 0")
def selection_intersection(spark, sf_dir):
    return _shown(selection.intersection(selection.intersection(_low(spark, sf_dir), _odd(spark, sf_dir)), _third(spark, sf_dir)))


_DOWN = "WITH RECURSIVE " + OBJ + ", down(cityobject_id) AS (SELECT cityobject_id FROM obj WHERE cityobject_id IN ({ids}) UNION SELECT e.child_id FROM down d JOIN edge e ON e.parent_id = d.cityobject_id)"


@query(_DOWN.format(ids="'R1'") + " SELECT cityobject_id FROM down")
def descendants(spark, sf_dir):
    return selection.closure(edges(spark, sf_dir), objects(spark, sf_dir).where("cityobject_id = 'R1'"))


@query(_DOWN.format(ids="'N3', 'N4'") + " SELECT cityobject_id, object_type FROM obj WHERE cityobject_id IN (SELECT cityobject_id FROM down)")
def subset(spark, sf_dir):
    return selection.subset(objects(spark, sf_dir), edges(spark, sf_dir), ["N3", "N4", "unknown"]).select("cityobject_id", "object_type")


@query(_DOWN.format(ids="'R0', 'R2'") + " SELECT cityobject_id, object_type FROM obj WHERE cityobject_id NOT IN (SELECT cityobject_id FROM down)")
def subset_exclude(spark, sf_dir):
    return selection.subset(objects(spark, sf_dir), edges(spark, sf_dir), ["R0", "R2"], exclude=True).select("cityobject_id", "object_type")


@query(f"WITH RECURSIVE {OBJ}, both_ways AS (SELECT parent_id AS a, child_id AS b FROM edge UNION ALL SELECT child_id, parent_id FROM edge), near(cityobject_id) AS (SELECT 'S1' UNION SELECT b FROM near JOIN both_ways ON a = cityobject_id) SELECT cityobject_id, true AS whole FROM near")
def include_relatives(spark, sf_dir):
    start = selection.select_objects(objects(spark, sf_dir), F.col("cityobject_id") == "S1")
    return selection.include_relatives(start, edges(spark, sf_dir)).select("cityobject_id", "whole")


@query(f"WITH {OBJ}, sel AS (SELECT * FROM obj WHERE object_type IN ('Customer', 'Order') AND ix % 2 = 0) SELECT arg_min(cityobject_id, ix) AS root FROM sel WHERE parent_id IS NULL OR parent_id NOT IN (SELECT cityobject_id FROM sel)")
def reroot(spark, sf_dir):
    o = objects(spark, sf_dir)
    chosen = o.where("object_type in ('Customer', 'Order') and ix % 2 = 0").select("cityobject_id")
    return spark.createDataFrame([(selection.reroot(o, edges(spark, sf_dir), chosen, "R0"),)], "root string")


@query(f"WITH {OBJ}, kept AS (SELECT cityobject_id FROM obj WHERE ix % 3 <> 1) SELECT parent_id, CAST(count(*) AS BIGINT) AS n_children, min(child_id) AS least, max(child_id) AS most FROM edge WHERE parent_id IN (SELECT * FROM kept) AND child_id IN (SELECT * FROM kept) GROUP BY 1")
def extract_prune_children(spark, sf_dir):
    o = objects(spark, sf_dir)
    return selection.pruned(edges(spark, sf_dir), o.where("ix % 3 <> 1")).groupBy("parent_id").agg(F.count("*").alias("n_children"), F.min("child_id").alias("least"), F.max("child_id").alias("most"))


@query(f"WITH {_SEL} SELECT geometry_id, cityobject_id, lod FROM geo WHERE cityobject_id IN (SELECT cityobject_id FROM big) OR geometry_ordinal < 2")
def extract_selection(spark, sf_dir):
    s = selection.union(_low(spark, sf_dir), _third(spark, sf_dir))
    return selection.extract(objects(spark, sf_dir), edges(spark, sf_dir), geometries(spark, sf_dir), s)[2].select("geometry_id", "cityobject_id", "lod")


# -- filters by type and level


@query("WITH RECURSIVE " + OBJ + ", down(cityobject_id) AS (SELECT cityobject_id FROM obj WHERE object_type IN ('Supplier', 'Customer') UNION SELECT e.child_id FROM down d JOIN edge e ON e.parent_id = d.cityobject_id) SELECT object_type, CAST(count(*) AS BIGINT) AS n FROM obj WHERE cityobject_id IN (SELECT * FROM down) GROUP BY 1")
def type_filter(spark, sf_dir):
    return filters.retained_objects(objects(spark, sf_dir), edges(spark, sf_dir), ["Supplier", "Customer"]).groupBy("object_type").agg(F.count("*").alias("n"))


@query(f"WITH {GEO} SELECT cityobject_id, arg_max(lod, {{'a': CAST(lod AS DOUBLE), 'b': geometry_ordinal}}) AS lod FROM geo GROUP BY 1")
def lod_highest(spark, sf_dir):
    return filters.highest_lod(geometries(spark, sf_dir))


@query(f"WITH {GEO} SELECT geometry_id, cityobject_id, lod FROM geo WHERE lod = '2'")
def lod_exact_by_type(spark, sf_dir):
    rules = filters.FeatureFilter(by_type={"Order": filters.LodSelection("exact", "2"), "Nation": filters.LodSelection("highest")})
    return filters.apply(objects(spark, sf_dir), edges(spark, sf_dir), geometries(spark, sf_dir), rules)[1].select("geometry_id", "cityobject_id", "lod")


@query(
    f"WITH {OBJ}, {GEO} SELECT o.object_type, CAST(count(DISTINCT o.cityobject_id) AS BIGINT) AS objects, CAST(count(g.geometry_id) AS BIGINT) AS available, CAST(count(CASE WHEN lod = '1.2' THEN 1 END) AS BIGINT) AS retained, "
    "coalesce(string_agg(DISTINCT lod, ',' ORDER BY lod), '') AS available_lods, CASE WHEN count(CASE WHEN lod = '1.2' THEN 1 END) > 0 THEN '1.2' ELSE '' END AS retained_lods FROM obj o LEFT JOIN geo g USING (cityobject_id) GROUP BY 1"
)
def filter_diagnostics(spark, sf_dir):
    o, g = objects(spark, sf_dir), geometries(spark, sf_dir)
    shown = filters.retained_geometries(o, g, filters.FeatureFilter(lod=filters.LodSelection("exact", "1.2")))
    return filters.diagnostics(o, g, shown)


@query("SELECT * FROM (VALUES ('Order', '0.1'), ('Region', '1')) t(object_type, lod)")
def lod_failures(spark, sf_dir):
    return filters.lod_failures(objects(spark, sf_dir), geometries(spark, sf_dir), {"Order": "0.1", "Region": "1"}).select("object_type", "lod").unionByName(filters.lod_failures(objects(spark, sf_dir), geometries(spark, sf_dir), {"Order": "2.0"}))


# -- aggregates, catalogue, lookups, pages


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS n_{t}" for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")))
def model_summary(spark, sf_dir):
    return extent.summary({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")})


@query("SELECT count(*) AS n, min(o_totalprice) AS min_x, max(o_totalprice) AS max_x, CAST(min(o_custkey) AS DOUBLE) AS min_z, count(*) FILTER (o_custkey IS NULL) = 0 AS complete FROM orders")
def catalog_bounds(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(*[c for a in "xy" for c in (F.col("o_totalprice").alias(f"min_{a}"), F.col("o_totalprice").alias(f"max_{a}"))], F.col("o_custkey").cast("double").alias("min_z"), F.col("o_custkey").cast("double").alias("max_z"))
    return index.bounds(f).select("n", "min_x", "max_x", "min_z", "complete")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS n_sources, count(*) AS n_features, CAST(sum(n_chars) AS BIGINT) AS n_cityobjects FROM documents")
def catalog_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return index.counts(d.select("source").distinct(), d.select(F.col("n_chars").alias("cityobject_count")))


@query("SELECT feature_id, CAST(min(id) AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey AS id, 'F' || CAST(o_custkey AS VARCHAR) AS feature_id FROM orders) GROUP BY 1")
def lookup_first_by_id(spark, sf_dir):
    return index.first_by_id(features(spark, sf_dir))


@query("SELECT o_orderkey AS id, 'F' || CAST(o_custkey AS VARCHAR) AS feature_id, o_orderpriority AS source FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def lookup_all_by_id(spark, sf_dir):
    f = features(spark, sf_dir)
    first = "F" + str(table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0])
    sources = f.select("source").distinct().select(F.col("source").alias("id"))
    return index.lookup_all(f.withColumnRenamed("source", "source_id"), sources, first).select("id", "feature_id", F.col("source_id").alias("source"))


@query("WITH a AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([7, -5, 1, 7]) AS id) SELECT CAST(a.pos AS BIGINT) AS pos, CAST(a.id AS BIGINT) AS id, o_totalprice AS total FROM a LEFT JOIN orders ON o_orderkey = a.id")
def lookup_batch_ordered(spark, sf_dir):
    return index.lookup_ordered(features(spark, sf_dir), [7, -5, 1, 7]).select("pos", "id", "total")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey > 1000 ORDER BY 1 LIMIT 512")
def keyset_page(spark, sf_dir):
    return index.keyset_page(features(spark, sf_dir), 1000, 512).select("id", "total")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY 1 LIMIT 100 OFFSET 250")
def offset_page(spark, sf_dir):
    return index.offset_page(features(spark, sf_dir), 250, 100).select("id", "total")


@query("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 512 AS BIGINT) AS page FROM (SELECT o_orderkey AS id FROM orders)")
def page_numbers(spark, sf_dir):
    return index.page_numbers(features(spark, sf_dir).select("id"), 512).select("id", "page")


@query(
    "WITH c AS (SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 5 <> 0), i AS (SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size FROM documents WHERE doc_id % 3 <> 0) "
    "SELECT coalesce(c.path, i.path) AS path, CASE WHEN c.path IS NULL THEN 'missing' WHEN i.path IS NULL THEN 'unindexed' ELSE 'changed' END AS issue FROM c FULL JOIN i ON c.path = i.path WHERE c.path IS NULL OR i.path IS NULL OR c.size <> i.size"
)
def catalog_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    current = d.where("doc_id % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).drop("doc_id")
    return index.status(current, d.where("doc_id % 3 <> 0").drop("doc_id"))


@query(
    "WITH p AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages), m AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM p UNION SELECT DISTINCT regexp_extract(path, '^[a-z]+://[^/]*', 0) FROM p) "
    "SELECT path, arg_max(dir, length(dir)) AS dir FROM p JOIN m ON path = dir OR starts_with(path, dir || '/') GROUP BY 1"
)
def longest_prefix_metadata(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path")).distinct()
    m = p.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).union(p.select(F.regexp_extract("path", "^[a-z]+://[^/]*", 0))).distinct()
    return index.nearest_metadata(p, m)


@query("WITH r AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT 'F' || CAST(o_custkey AS VARCHAR) AS feature_id FROM orders)) SELECT feature_id FROM r WHERE i IN (0, n // 2, n - 1)")
def representative_ids(spark, sf_dir):
    return index.representative(features(spark, sf_dir))


# -- merging


@query(
    "SELECT coalesce('K' || CAST(c_custkey AS VARCHAR), 'K' || CAST(s_suppkey AS VARCHAR)) AS cityobject_id, CASE WHEN c_custkey IS NULL THEN s_acctbal WHEN s_suppkey IS NULL THEN c_acctbal ELSE least(c_acctbal, s_acctbal) END AS min_x, "
    "CASE WHEN c_custkey IS NULL THEN s_acctbal WHEN s_suppkey IS NULL THEN c_acctbal ELSE greatest(c_acctbal, s_acctbal) END AS max_x, coalesce(s_name, c_name) AS name, c_mktsegment AS segment FROM customer FULL JOIN supplier ON c_custkey = s_suppkey"
)
def merge_objects(spark, sf_dir):
    """Customers and suppliers of one key as one object: later attributes win, extents unite."""

    def side(name, key, label, value, ix, *more):
        df = table(spark, sf_dir, name)
        return df.select(
            F.concat(F.lit("K"), F.col(key).cast("string")).alias("cityobject_id"), F.lit("Building").alias("object_type"), F.to_json(F.struct(F.col(label).alias("name"), *more)).alias("attributes"),
            F.array(*[F.col(value)] * 6).alias("geographical_extent"), (F.col(key) + ix).alias("cityobject_ix"),
        )

    m = merge.merge_objects(side("customer", "c_custkey", "c_name", "c_acctbal", 0, F.col("c_mktsegment").alias("segment")), side("supplier", "s_suppkey", "s_name", "s_acctbal", 10**9))
    return m.select("cityobject_id", F.col("geographical_extent")[0].alias("min_x"), F.col("geographical_extent")[3].alias("max_x"), F.get_json_object("attributes", "$.name").alias("name"), F.get_json_object("attributes", "$.segment").alias("segment"))


@query("SELECT min(o_totalprice) AS min_x, max(o_totalprice) AS max_x, arg_min(o_orderpriority, o_orderkey) AS title FROM orders")
def merge_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = merge.merge_metadata(o.select(F.col("o_orderkey").alias("ix"), F.col("o_orderpriority").alias("title"), F.array(*[F.col("o_totalprice")] * 6).alias("geographical_extent")))
    return m.select(F.col("geographical_extent")[0].alias("min_x"), F.col("geographical_extent")[3].alias("max_x"), "title")


@query("SELECT CASE WHEN count(DISTINCT s) = 0 THEN 'empty' WHEN count(DISTINCT s) = 1 THEN 'present' ELSE 'cleared' END AS state FROM (SELECT CASE WHEN p_size > 25 THEN p_size END AS s FROM part)")
def merge_transform_state(spark, sf_dir):
    return merge.transform_state(table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, F.col("p_size")).alias("scale")), ["scale"])


@query("SELECT cityobject_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_name AS cityobject_id FROM customer UNION ALL SELECT c_name FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1 HAVING count(*) > 1")
def append_strict_duplicates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("cityobject_id"))
    return merge.duplicate_ids(c, c.where("c_custkey % 4 = 0"))


@query("SELECT n_nationkey AS ix, CAST(length(n_name) AS BIGINT) AS n, CAST(coalesce(sum(length(n_name)) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM nation")
def append_offsets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ix"), F.length("n_name").cast("bigint").alias("n"))
    return merge.prefix_offsets(n, "ix", "n")


@query("WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2), d AS (SELECT p_brand, p_type, row_number() OVER (ORDER BY k) - 1 AS resource_id FROM f) SELECT p_partkey, CAST(resource_id AS BIGINT) AS resource_id FROM part JOIN d USING (p_brand, p_type)")
def dedup_get_or_insert(spark, sf_dir):
    return merge.get_or_insert(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey")[1]


# -- arrays


_IDX = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(trunc(v * 100) AS INTEGER)) AS a FROM embeddings)"


def _indices(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: (v * F.lit(100).cast("float")).cast("int")).alias("a"))


def _nested(spark, sf_dir):
    """Eight rings of eight, two rings a surface."""
    rings = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("a", i * 8 + 1, 8))
    return _indices(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(rings, i * 2 + 1, 2)).alias("nested"), "a")


@query(f"WITH {_IDX} SELECT vec_id, array_to_string(a, ',') AS vertices, '0,8,16,24,32,40,48,56' AS rings, '0,2,4,6' AS surfaces FROM e")
def flatten_boundary(spark, sf_dir):
    v, r, s = arrays.flatten_levels(F.col("nested"), 3)
    return _nested(spark, sf_dir).select("vec_id", F.array_join(v, ",").alias("vertices"), F.array_join(r, ",").alias("rings"), F.array_join(s, ",").alias("surfaces"))


@query(f"WITH {_IDX} SELECT vec_id, CAST(i AS INTEGER) AS ring, array_to_string(list_slice(a, i * 8 + 1, i * 8 + 8), ',') AS vertices FROM e, (SELECT unnest(range(8)) AS i)")
def unflatten_rings(spark, sf_dir):
    starts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 8)
    return _indices(spark, sf_dir).select("vec_id", F.posexplode(arrays.unflatten(F.col("a"), starts)).alias("ring", "v")).select("vec_id", "ring", F.array_join("v", ",").alias("vertices"))


@query("SELECT vec_id, CAST(i // 2 AS INTEGER) AS surface_ordinal, CAST(i % 2 AS INTEGER) AS ring_ordinal, CAST(i * 8 AS INTEGER) AS start, 8 AS len FROM embeddings, (SELECT unnest(range(8)) AS i)")
def ring_layouts(spark, sf_dir):
    v, r, s = arrays.flatten_levels(F.col("nested"), 3)
    return arrays.ring_layouts(_nested(spark, sf_dir).select("vec_id", v.alias("v"), r.alias("r"), s.alias("s")), "vec_id", "v", "r", "s")


@query("SELECT l_orderkey AS feature, l_partkey AS vertex, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS BIGINT) AS local_index FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def localise_vertices(spark, sf_dir):
    return arrays.localise(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("feature"), F.col("l_partkey").alias("vertex")), "feature", "vertex")


@query(f"WITH {_IDX} SELECT vec_id, array_to_string(list_sort(list_distinct(a)), ',') AS unique_indices FROM e")
def unique_vertices(spark, sf_dir):
    return _indices(spark, sf_dir).select("vec_id", F.array_join(arrays.unique_indices(F.col("a")), ",").alias("unique_indices"))


@query(f"WITH {_IDX} SELECT vec_id, CAST(i - 2 AS INTEGER) AS tri, concat_ws(',', a[1], a[i], a[i + 1]) AS corners FROM e, (SELECT unnest(range(2, 64)) AS i)")
def triangulate_fan(spark, sf_dir):
    return _indices(spark, sf_dir).select("vec_id", F.posexplode(arrays.fan(F.col("a"))).alias("tri", "t")).select("vec_id", "tri", F.array_join("t", ",").alias("corners"))


@query(f"WITH {_IDX} SELECT vec_id, CAST(i - 1 AS INTEGER) AS ordinal, CASE WHEN a[i] > 0 THEN a[i] END AS semantic FROM e, (SELECT unnest(range(1, 65)) AS i)")
def long_form_semantics(spark, sf_dir):
    return arrays.long_form(_indices(spark, sf_dir).withColumn("v", F.transform("a", lambda x: F.when(x > 0, x))), "vec_id", "v", "ordinal", "semantic")


@query(f"WITH {_IDX} SELECT vec_id, array_to_string(a, ',') AS v, true AS dense FROM e")
def reassemble_semantics(spark, sf_dir):
    rows = arrays.long_form(_indices(spark, sf_dir), "vec_id", "a", "ordinal", "semantic")
    return arrays.reassembled(rows, "vec_id", "ordinal", "semantic").select("vec_id", F.array_join("values", ",").alias("v"), "dense")


@query(f"WITH {_IDX} SELECT vec_id, len(list_distinct(a[1:2])) = 1 AS same FROM e")
def uniform_material(spark, sf_dir):
    return _indices(spark, sf_dir).select("vec_id", arrays.uniform(F.slice("a", 1, 2)).alias("same"))


# -- attributes and documents


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def extract_int_column(spark, sf_dir):
    """Whole numbers that aren't negative; a signed extraction of the same rows would be empty."""
    return attributes.extract_column(table(spark, sf_dir, "events"), "event_id", "props", "k", "unsigned")


@query("SELECT c_custkey, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def extract_string_column(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_mktsegment", "c_acctbal")).alias("attrs"))
    return attributes.extract_column(c, "c_custkey", "attrs", "c_mktsegment", "string")


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL")
def attribute_keys(spark, sf_dir):
    return attributes.attribute_keys(table(spark, sf_dir, "events"), "props")


@query("SELECT 'k' AS name, 'unsigned' AS kind, false AS nullable")
def infer_schema(spark, sf_dir):
    spec = attributes.infer(table(spark, sf_dir, "events"), "props")
    return spark.createDataFrame([(k, v.kind, v.nullable) for k, v in spec.fields.items()], "name string, kind string, nullable boolean")


@query("SELECT event_id, json_type(props, '$.k') AS kind FROM events WHERE json_type(props, '$.k') = 'UBIGINT'")
def attribute_types(spark, sf_dir):
    kind = attributes.attribute_type(F.col("props"), "k")
    return table(spark, sf_dir, "events").select("event_id", F.when(kind == "unsigned", "UBIGINT").alias("kind")).where("kind is not null")


@query("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'user' ELSE 'base' END AS shown FROM conversations")
def sequence_header_overlay(spark, sf_dir):
    """Members of a header below those of features."""
    c = table(spark, sf_dir, "conversations")
    own = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("role").alias("shown"), F.lit("2.0").alias("version")))).otherwise(F.lit("{}"))
    return c.select("conv_id", "turn", "role", document.overlay(F.lit('{"type":"x","version":"2.0","shown":"base"}'), own)["shown"].alias("shown"))


@query("SELECT CAST(c.conv_id AS VARCHAR) AS cityobject_id, CAST(count(DISTINCT turn) AS BIGINT) AS n FROM conversations c GROUP BY 1 HAVING count(DISTINCT turn) > 1")
def duplicate_ids(spark, sf_dir):
    return document.duplicate_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("cityobject_id"), F.col("turn").alias("doc_key")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS version FROM events")
def json_probe(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("version"))


# -- validation


@query(f"WITH {_IDX}, b AS (SELECT vec_id, a, i FROM e, (SELECT unnest(range(1, 64)) AS i)) SELECT vec_id, NOT (a[1] <> 0 OR bool_or(b.a[i] > b.a[i + 1]) OR max(b.a[i]) > 64) AS ok FROM b GROUP BY vec_id, a")
def validate_offsets(spark, sf_dir):
    return _indices(spark, sf_dir).select("vec_id", arrays.offsets_consistent(F.col("a"), F.lit(64)).alias("ok"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def validate_fk(spark, sf_dir):
    return validate.dangling(table(spark, sf_dir, "lineitem"), "l_partkey", table(spark, sf_dir, "part").where("p_size > 10"), "p_partkey").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT l_orderkey, count(*) AS c, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) SELECT l_orderkey FROM g WHERE d <> c OR lo <> 1 OR hi <> c")
def validate_dense_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("ordinal"))
    return validate.sparse_maps(rows, "l_orderkey", "ordinal", rows.groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@query("SELECT vec_id AS geometry_id, 'vertex doesn''t exist' AS rule FROM embeddings WHERE len(list_filter(embedding, lambda v: CAST(trunc(v * 100) AS INTEGER) NOT BETWEEN 0 AND 20)) > 0")
def validate_geometries(spark, sf_dir):
    """Rules over surfaces whose vertex numbers come from the embeddings: only the vertices can be wrong."""
    v, r, s = arrays.flatten_levels(F.col("nested"), 3)
    none = F.lit(None).cast("array<int>")
    b = _nested(spark, sf_dir).select(F.col("vec_id").alias("geometry_id"), v.alias("vertex_indices"), none.alias("line_offsets"), r.alias("ring_offsets"), s.alias("surface_offsets"), none.alias("shell_offsets"), none.alias("solid_offsets"))
    g = b.select("geometry_id", F.lit("MultiSurface").alias("geometry_type"))
    return validate.violations(g, b, spark.range(21).withColumnRenamed("id", "vertex_id"))


# -- whole models


def _house_documents(spark, sf_dir):
    """A document for each customer: a house of two surfaces, with semantics, a material and a texture."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    num = lambda *v: F.array(*[F.lit(x).cast("int") if not hasattr(x, "_jc") else x.cast("int") for x in v])
    none = F.lit(None).cast("int")
    geometry = F.struct(
        F.lit("MultiSurface").alias("type"), F.lit("2").alias("lod"), F.array(F.array(num(0, 1, 2)), F.array(num(0, 2, 3))).alias("boundaries"),
        F.struct(F.array(F.struct(F.lit("RoofSurface").alias("type")), F.struct(F.lit("WallSurface").alias("type"))).alias("surfaces"), F.array((F.col("c_nationkey") % 2).cast("int"), none).alias("values")).alias("semantics"),
        F.create_map(F.lit("day"), F.struct(F.lit(0).alias("value"))).alias("material"),
        F.create_map(F.lit("photo"), F.struct(F.array(F.array(num(0, 0, 1, 2)), F.array(F.array(none))).alias("values"))).alias("texture"),
    )
    house = F.struct(F.lit("Building").alias("type"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("attributes"), F.array(geometry).alias("geometry"))
    point = lambda x: F.array(x.cast("double"), F.lit(0.0), F.lit(1.0))
    look = F.struct(
        F.array(F.struct(F.lit("brick").alias("name"))).alias("materials"), F.array(F.struct(F.lit("PNG").alias("type"), F.lit("t.png").alias("image"))).alias("textures"),
        F.array(*[F.array(F.lit(float(u)), F.lit(0.5)) for u in range(3)]).alias("vertices-texture"),
    )
    doc = F.struct(F.lit("Town").alias("type"), F.lit("2.0").alias("version"), look.alias("appearance"), F.create_map(F.lit("house"), house).alias("CityObjects"), F.array(*[point(F.col("c_nationkey") + i) for i in range(4)]).alias("vertices"))
    return c.select(F.col("c_custkey").alias("doc_key"), F.to_json(doc).alias("value"))


@query("SELECT c_custkey AS doc_key, 'house' AS cityobject_id, 'Building' AS object_type, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def read_model_objects(spark, sf_dir):
    o = model.read_models(_house_documents(spark, sf_dir))["cityobjects"]
    return o.select("doc_key", "cityobject_id", "object_type", F.get_json_object("attributes", "$.segment").alias("segment"), F.get_json_object("attributes", "$.balance").cast("double").alias("balance"))


@query("SELECT c_custkey AS doc_key, CAST(i AS INTEGER) AS surface_ordinal, CASE WHEN i = 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'RoofSurface' ELSE 'WallSurface' END END AS semantic_type FROM customer, (SELECT unnest([0, 1]) AS i)")
def read_model_semantics(spark, sf_dir):
    t = model.read_models(_house_documents(spark, sf_dir))
    return t["geometry_surface_semantics"].join(t["semantics"], ["doc_key", "semantic_id"], "left").select("doc_key", "surface_ordinal", "semantic_type")


@query("SELECT c_custkey AS doc_key, CAST(i AS INTEGER) AS surface_ordinal, 'day' AS theme, 'brick' AS name FROM customer, (SELECT unnest([0, 1]) AS i)")
def read_model_materials(spark, sf_dir):
    """One value for a theme stands for every surface."""
    t = model.read_models(_house_documents(spark, sf_dir))
    return t["geometry_surface_materials"].join(t["materials"], ["doc_key", "material_id"]).select("doc_key", "surface_ordinal", "theme", "name")


@query("SELECT c_custkey AS doc_key, 0 AS surface_ordinal, 0 AS ring_ordinal, 'photo' AS theme, 't.png' AS image, '0,1,2' AS uvs FROM customer")
def read_model_ring_textures(spark, sf_dir):
    t = model.read_models(_house_documents(spark, sf_dir))
    return t["geometry_ring_textures"].join(t["textures"], ["doc_key", "texture_id"]).select("doc_key", "surface_ordinal", "ring_ordinal", "theme", F.col("image_uri").alias("image"), F.array_join("uv_indices", ",").alias("uvs"))


@query("SELECT c_custkey AS doc_key, 'Town' AS kind, CAST(c_nationkey + 2 AS DOUBLE) AS x, CASE WHEN c_nationkey % 2 = 0 THEN 'RoofSurface' ELSE 'WallSurface' END AS semantic, c_mktsegment AS segment, '[[[0,1,2]],[[0,2,3]]]' AS boundaries FROM customer")
def write_models(spark, sf_dir):
    """Documents read into tables and written again; of equal documents the members agree, though numbers of semantics are those in use."""
    text = model.write_models(model.read_models(_house_documents(spark, sf_dir)))
    at = lambda path: F.get_json_object("value", path)
    g = "$.CityObjects.house.geometry[0]"
    return text.select("doc_key", at("$.type").alias("kind"), at("$.vertices[2][0]").cast("double").alias("x"), at(f"{g}.semantics.surfaces[0].type").alias("semantic"), at("$.CityObjects.house.attributes.segment").alias("segment"), at(f"{g}.boundaries").alias("boundaries"))


@query("SELECT c_custkey AS doc_key FROM customer")
def has_material_theme(spark, sf_dir):
    return model.has_theme(model.read_models(_house_documents(spark, sf_dir)), "material", "day")


def _point_model(spark, sf_dir, name, key, value):
    """A model of one point for each row: objects K1, K2, ..."""
    df = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("k"), F.col(value).alias("x"))
    null = lambda kind: F.lit(None).cast(kind)
    boundary = [F.array(F.col("k").cast("int")).alias("vertex_indices"), *[null("array<int>").alias(f"{p}_offsets") for p in ("line", "ring", "surface", "shell", "solid")]]
    meta = spark.range(1).select(*[(F.lit("Town") if f.name == "citymodel_kind" else F.lit(name) if f.name == "title" else null(f.dataType)).alias(f.name) for f in schema_of("metadata")])
    return {
        "metadata": meta, "vertices": df.select(F.col("k").alias("vertex_id"), "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z")),
        "cityobjects": df.select(F.concat(F.lit("K"), F.col("k").cast("string")).alias("cityobject_id"), F.col("k").alias("cityobject_ix"), F.lit("Building").alias("object_type"), F.array(*["x"] * 6).alias("geographical_extent"), F.to_json(F.struct(F.col("x").alias(name))).alias("attributes"), null("string").alias("extra")),
        "geometries": df.select(F.col("k").alias("geometry_id"), F.col("k").alias("cityobject_ix"), F.lit(0).alias("geometry_ordinal"), F.lit("MultiPoint").alias("geometry_type"), F.lit("1").alias("lod"), null("string").alias("extra")),
        "geometry_boundaries": df.select(F.col("k").alias("geometry_id"), *boundary),
    }


@query(
    "WITH g AS (SELECT 'K' || CAST(c_custkey AS VARCHAR) AS id, 0 AS side, c_acctbal AS x FROM customer UNION ALL SELECT 'K' || CAST(s_suppkey AS VARCHAR), 1, s_acctbal FROM supplier) "
    "SELECT id AS cityobject_id, CAST(row_number() OVER (PARTITION BY id ORDER BY side) - 1 AS INTEGER) AS geometry_ordinal, x, min(x) OVER (PARTITION BY id) AS min_x, max(x) OVER (PARTITION BY id) AS max_x FROM g"
)
def merge_models(spark, sf_dir):
    """Customers and suppliers as two models, merged: objects of one id have the geometries of both."""
    m = merge.merge_models(_point_model(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), _point_model(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"))
    points = m["geometry_boundaries"].select("geometry_id", F.col("vertex_indices")[0].cast("bigint").alias("vertex_id")).join(m["vertices"], "vertex_id")
    rows = m["geometries"].join(points, "geometry_id").join(m["cityobjects"], "cityobject_ix")
    return rows.select("cityobject_id", "geometry_ordinal", "x", F.col("geographical_extent")[0].alias("min_x"), F.col("geographical_extent")[3].alias("max_x"))


@query("SELECT CAST(c_custkey AS BIGINT) AS geometry_id, 'semantic doesn''t exist' AS rule FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'material of a surface that doesn''t exist' FROM customer WHERE c_custkey % 10 = 3")
def validate_maps(spark, sf_dir):
    """Semantics that point to nations of one region, which aren't there; materials on a third surface."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("geometry_id"), F.col("c_nationkey").cast("bigint").alias("n"))
    none = F.lit(None).cast("array<int>")
    two = lambda *v: F.array(*[F.lit(x) for x in v])
    tables = {
        "geometries": c.select("geometry_id", F.lit("MultiSurface").alias("geometry_type")),
        "geometry_boundaries": c.select("geometry_id", two(0, 1, 2, 0, 2, 3).alias("vertex_indices"), none.alias("line_offsets"), two(0, 3).alias("ring_offsets"), two(0, 1).alias("surface_offsets"), none.alias("shell_offsets"), none.alias("solid_offsets")),
        "geometry_surface_semantics": c.select("geometry_id", F.explode(two(0, 1)).alias("surface_ordinal"), F.col("n").alias("semantic_id")),
        "semantics": table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").cast("bigint").alias("semantic_id")),
        "geometry_surface_materials": c.select("geometry_id", F.when(F.col("geometry_id") % 10 == 3, 2).otherwise(1).alias("surface_ordinal"), F.lit("day").alias("theme"), F.lit(0).cast("bigint").alias("material_id")),
        "materials": spark.range(1).withColumnRenamed("id", "material_id"),
    }
    return validate.map_violations(tables)


@query(f"WITH {_EXT} SELECT cityobject_id, min_x, max_x, min_y, max_y FROM ext WHERE max_x >= 10 AND min_x <= 20 AND max_y >= 1000 AND min_y <= 20000")
def bbox_query_stored(spark, sf_dir):
    """The window over boxes that were written along the Hilbert curve: the filters reach the scan and skip row groups."""
    stored = materialised(extent.clustered(_extents(spark, sf_dir), 8))
    return extent.bbox_query(stored, (10, 1000, 20, 20000)).select("cityobject_id", "min_x", "max_x", "min_y", "max_y")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose extent meets a window, with their Hilbert number, in that order."""
    rows = extent.with_hilbert(_extents(spark, sf_dir), points=vertices(spark, sf_dir))
    return extent.bbox_query(rows, (10, 1000, 20, 20000)).orderBy("hilbert", "cityobject_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
