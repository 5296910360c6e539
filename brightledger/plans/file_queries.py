"""What goes through files: texts, JSON batches, appends, published tables, hashes on record; and groups merged by shared members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging
from ..sources import readers, writers
from ..sources.readers import table
from ..streaming.events import scratch
from .registry import query

DOUBLE = "double"


def _lines(spark, d):
    """nation and text: the customers of each nation, a line each."""
    line = F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" "), F.col("c_name"))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


_TEXT = "SELECT c_nationkey AS nation, string_agg(lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' ' || c_name, chr(10) ORDER BY lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' ' || c_name) AS text FROM customer GROUP BY 1"


@query("SELECT nation, 'text' AS tool, sha256(chr(65279) || text || chr(10)) AS was, sha256(text || chr(10)) AS sha FROM (" + _TEXT + ")")
def text_files(spark, d):
    """A file for each nation, with a byte order mark, read whole and without it."""
    folder = scratch(spark)
    marked = _lines(spark, d).select("nation", F.concat(F.lit("\ufeff"), "text").alias("value"))
    marked.write.partitionBy("nation").text(folder)
    found = readers.text_documents(spark, f"{folder}/*/*.txt")
    nation = F.regexp_extract("document_id", "nation=([0-9]+)", 1).cast("int")
    return found.select(nation.alias("nation"), "tool", F.sha2(F.concat(F.lit("\ufeff"), "text"), 256).alias("was"), F.sha2("text", 256).alias("sha"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS document_id, CAST(c_custkey AS INTEGER) AS source_row, c_name AS source_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value FROM customer""")
def benchmark_files(spark, d):
    """Cells of a benchmark: a JSON array a file."""
    cell = F.struct(F.col("c_nationkey").cast("string").alias("document_id"), F.col("c_custkey").cast("int").alias("source_row"), F.col("c_name").alias("source_name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("value"))
    folder = scratch(spark)
    arrays = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(cell)).alias("value"))
    arrays.write.partitionBy("c_nationkey").text(folder)
    return readers.benchmark_cells(spark, f"{folder}/*").select("document_id", "source_row", "source_name", "value")


@query("SELECT count(*) FILTER (c % 5 = 0) AS changed, 1 AS missing FROM (SELECT DISTINCT c_nationkey AS c FROM customer)")
def verified_files(spark, d):
    """Files with another content than on record, and one that is missing."""
    folder = scratch(spark)
    _lines(spark, d).repartitionByRange(25, "nation").select(F.concat_ws(":", "nation", "text").alias("value")).write.text(folder)
    files = spark.read.format("binaryFile").load(f"{folder}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    nation = F.split_part(F.decode("content", "UTF-8"), F.lit(":"), F.lit(1))
    whole = files.where("length(content) > 0").select("name", F.when(nation.cast("int") % 5 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    expected = whole.unionByName(table(spark, d, "region").where("r_regionkey = 0").select(F.lit("none.txt").alias("name"), F.lit("0").alias("sha256")))
    found = readers.verified_files(spark, f"{folder}/part-*", expected)
    return found.agg(F.count_if(F.col("found").isNotNull()).alias("changed"), F.count_if(F.col("found").isNull()).cast("int").alias("missing"))


@query("SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders")
def json_export(spark, d):
    folder = f"{scratch(spark)}/json"
    own = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    writers.write_json(own, folder)
    return spark.read.json(folder, schema="o_orderkey long, o_orderstatus string, v decimal(18,2)").withColumn("v", F.col("v").cast(DOUBLE))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM events")
def append_once(spark, d):
    """A second run appends only what the first one left out."""
    path, events = f"{scratch(spark)}/events", table(spark, d, "events").select("event_id")
    writers.append_once(events.where("event_id % 3 = 0").withColumn("run", F.lit("first")), path, "event_id")
    writers.append_once(events.withColumn("run", F.lit("second")), path, "event_id")
    return spark.read.parquet(path)


@query("SELECT c_custkey, 'second' AS run FROM customer")
def published_table(spark, d):
    """Readers see the table that was published last, whole."""
    folder, own = scratch(spark), table(spark, d, "customer").select("c_custkey")
    writers.publish(own.where("c_custkey % 2 = 0").withColumn("run", F.lit("first")), folder, "t")
    writers.publish(own.withColumn("run", F.lit("second")), folder, "t")
    return writers.published(spark, folder, "t")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS a, o_orderstatus AS b FROM orders), n AS (SELECT k, a AS x, b AS y FROM e UNION SELECT k, b, a FROM e),
 r(k, x, y) AS (SELECT k, x, x FROM n UNION SELECT r.k, r.x, n.y FROM r JOIN n ON n.k = r.k AND n.x = r.y), c AS (SELECT k, x, min(y) AS c FROM r GROUP BY 1, 2)
 SELECT k AS o_custkey, string_agg(x, ',' ORDER BY x) AS members FROM c GROUP BY k, c""")
def group_merge(spark, d):
    """Priorities and states of a customer's orders, merged where an order has both."""
    pair = F.array_sort(F.array("o_orderpriority", "o_orderstatus"))
    groups = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(pair).alias("groups"))  # 15 different ones at most
    return groups.select("o_custkey", F.explode(merging.merged_groups(F.col("groups"))).alias("g")).select("o_custkey", F.array_join("g", ",").alias("members"))
