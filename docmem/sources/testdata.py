"""Adapters from the driver's tables to the engine's inputs.

Each is a projection or a keyed aggregate of whole tables. `event_id` numbers
the events in arrival order, so it serves as `seq`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def busy(df: DataFrame) -> DataFrame:
    """A scan for work that is heavy per row.

    A small file gives fewer tasks than there are cores; its rows are dealt out
    again. A large input has more tasks than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(busy(table(spark, sf_dir, "events")))


def _opened(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("user_id").alias("db_id"),
        F.col("event_id").alias("seq"),
        "event_type",
        "value",
        "props",
        k.alias("k"),
    )


def field_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sets `$.<type>.k`."""
    return field_edits_of(busy(table(spark, sf_dir, "events")))


def field_edits_of(events: DataFrame) -> DataFrame:
    return _opened(events).select(
        "db_id", "seq", F.concat(F.lit("$."), "event_type", F.lit(".k")).alias("path"), F.col("k").alias("data")
    )


def list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event writes `$.<type>`; those of value 50 or more write a list."""
    return list_edits_of(busy(table(spark, sf_dir, "events")))


def list_edits_of(events: DataFrame) -> DataFrame:
    wrapped = F.when(F.col("value") >= 50, F.concat(F.lit("["), "k", F.lit("]"))).otherwise(F.col("k"))
    return _opened(events).select(
        "db_id", "seq", F.concat(F.lit("$."), "event_type").alias("path"), wrapped.alias("data")
    )


def object_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event adds `props` to the list `$.<type>`."""
    return _events(spark, sf_dir).select(
        "db_id",
        "seq",
        F.concat(F.lit("$."), "event_type").alias("path"),
        F.concat(F.lit("["), "props", F.lit("]")).alias("data"),
        "k",
        "value",
    )


def nested_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events below value 60 set `$.<type>.v`; the others replace `$.<type>` by `props`."""
    small = F.col("value") < 60
    return _events(spark, sf_dir).select(
        "db_id",
        "seq",
        F.concat(F.lit("$."), "event_type", F.when(small, ".v").otherwise("")).alias("path"),
        F.when(small, F.col("k")).otherwise(F.col("props")).alias("data"),
    )


def raw_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked edits: event props, and message texts as a model may return them."""
    events = _events(spark, sf_dir).select(
        "db_id", "seq", F.concat(F.lit("$."), "event_type").alias("path"), F.col("props").alias("data")
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("db_id"),
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("$."), "p_name").alias("path"),
        F.col("p_size").cast("string").alias("data"),
    )
    said = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("db_id"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("$."), "role").alias("path"),
        F.col("text").alias("data"),
    )
    return events.unionByName(parts).unionByName(said)


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document per text: its lines as a list of objects."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct((i + 1).alias("n"), F.length(x).alias("chars"), x.alias("text")),
    )
    doc = F.struct(
        "source", "lang", F.struct(F.col("n_chars").alias("chars")).alias("stats"), lines.alias("lines")
    )
    return busy(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("db_id"), F.to_variant_object(doc).alias("doc")
    )


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.struct(F.col("c_mktsegment").alias("segment")).alias("market"),
    )
    return busy(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("db_id"), F.to_variant_object(doc).alias("doc")
    )


def supplier_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_docs_of(busy(table(spark, sf_dir, "supplier")))


def supplier_docs_of(suppliers: DataFrame) -> DataFrame:
    """The same kind of record under a changed schema: a number became text."""
    doc = F.struct(
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        F.lit(True).alias("supplier"),
    )
    return suppliers.select(
        F.col("s_suppkey").alias("db_id"), F.to_variant_object(doc).alias("doc")
    )


def place_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nested places, as VARIANT: nations and regions repeat, places only at times."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    place = F.struct(
        F.struct(F.struct(F.col("r_name").alias("name")).alias("region"), F.col("n_name").alias("name")).alias("nation"),
        F.floor(F.col("c_acctbal")).cast("bigint").alias("band"),
        F.array(F.struct(F.col("c_mktsegment").alias("tag"))).alias("tags"),
    )
    doc = F.struct(F.col("c_name").alias("name"), place.alias("place"))
    return (
        busy(table(spark, sf_dir, "customer"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("db_id"), F.to_variant_object(doc).alias("doc"))
    )


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(
        F.col("o_custkey").alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.struct(F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("priority")).alias("status"),
    )
    return busy(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("db_id"), F.to_variant_object(doc).alias("doc")
    )


def deep_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with decimals and their line items as lists of lists, nested up to 30 levels of objects and lists deep."""
    price = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    item = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit(","), price("l_extendedprice"), F.lit("]"))
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", item.alias("text")))).alias("items"))
    )
    told = F.concat(
        F.lit('{"items":['), F.array_join(F.coalesce("items.text", F.array()), ","), F.lit('],"total":'), price("o_totalprice"), F.lit("}")
    )
    n = (F.col("o_orderkey") % 16).cast("int")
    doc = F.concat(F.repeat(F.lit('{"d":['), n), told, F.repeat(F.lit("]}"), n))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, as small tables are laborious as documents
    return (
        table(spark, sf_dir, "orders")
        .repartition(parallel, "o_orderkey")
        .join(items, "o_orderkey", "left")
        .select(F.col("o_orderkey").alias("db_id"), F.parse_json(doc).alias("doc"))
    )


def selector_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event adds `props` to the list `$.<type>`; those of value 60 or more edit elements of it, by four kinds of selectors."""
    events = _events(spark, sf_dir)
    top = F.concat(F.lit("$."), "event_type")
    adds = events.select("db_id", (F.col("seq") * 2).alias("seq"), top.alias("path"), F.concat(F.lit("["), "props", F.lit("]")).alias("data"))
    how = F.col("seq") % 4
    step = (
        F.when(how == 0, F.concat(F.lit("[?k > "), "k", F.lit("].over")))
        .when(how == 1, "[0].first")
        .when(how == 2, "[-1].last")
        .otherwise("[*].at.seen")
    )
    edits = events.where("value >= 60").select(
        "db_id", (F.col("seq") * 2 + 1).alias("seq"), F.concat(top, step).alias("path"), F.col("seq").cast("string").alias("data")
    )
    return adds.unionByName(edits)


def state_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event adds an element of state `new`; those of value 60 or more move elements on to `seen` and `done`."""
    events = _events(spark, sf_dir)
    top = F.concat(F.lit("$."), "event_type")
    added = F.concat(F.lit('[{"k":'), "k", F.lit(',"s":"new"}]'))
    adds = events.select("db_id", (F.col("seq") * 2).alias("seq"), top.alias("path"), added.alias("data"))
    how = F.col("seq") % 3
    step = F.when(how == 0, '[?s = "new"].s').when(how == 1, '[?s = "seen"].s').otherwise('[?s = "seen"].at')
    data = F.when(how == 0, '"seen"').when(how == 1, '"done"').otherwise(F.col("seq").cast("string"))
    edits = events.where("value >= 60").select("db_id", (F.col("seq") * 2 + 1).alias("seq"), F.concat(top, step).alias("path"), data.alias("data"))
    return adds.unionByName(edits)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; each event follows as a hidden tool message."""
    said = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", "role", F.col("text").alias("content")
    )
    tools = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("thread_id"),
        (F.col("event_id") + 1000).alias("turn"),
        F.lit("tool").alias("role"),
        F.col("props").alias("content"),
    )
    return said.unionByName(tools)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns only."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), "turn", "role", F.col("text").alias("content")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("uid"), "vec_id", F.col("embedding").alias("vector")
    )
