"""The operators' tables from the relational ones: what plays nodes, edges, keywords, commits, contracts and files.

graph():      regions are files; nations, brands classes; suppliers, customers functions; parts methods. Customers call the
              parts they ordered, parts the suppliers who sent them (doubtful if all came back), nations inherit regions,
              suppliers and customers import nations. A customer in BUILDING is a test.
succession(): parts only; one calls the next line's part of the same order. Parts of size 5 and less are tests.
turns():      turns of conversations; each calls the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphlode.storage import size_of

AS_OF_EVENTS = "2024-01-30 00:00:00"
AS_OF_ORDERS = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the tables that make graphs."""
    return size_of(spark, *(f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier", "part", "orders", "lineitem")))


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _strings(*tags: str) -> Column:
    return F.array(*map(F.lit, tags))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, file_path, signature, docstring, tags, parent_id)."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    place = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.concat("r_name", F.lit("/"), "n_name").alias("place"), "n_name", "n_regionkey")
    none = F.lit("")

    def row(df: DataFrame, id_: Column, kind: str, name: Column, path: Column, signature: Column, tags: Column, parent: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("file_path"), signature.alias("signature"), none.alias("docstring"), tags.alias("tags"), parent.alias("parent_id"))

    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part")
    segment = F.col("c_mktsegment")
    roles = F.when(segment == "BUILDING", _strings("test", "category:test")).when(segment == "MACHINERY", _strings("entrypoint", "category:core")).when(segment == "HOUSEHOLD", _strings("callback", "category:example")).otherwise(_strings("category:core"))
    sizes = F.when(F.col("p_size") > 45, _strings("route_handler", "category:core")).otherwise(_strings("category:core"))
    out = row(region, _id("r", "r_regionkey"), "file", F.col("r_name"), F.col("r_name"), none, _strings("category:doc"), none)
    out = out.unionByName(row(place, _id("n", "n_nationkey"), "class", F.col("n_name"), F.col("place"), none, _strings("data_model", "category:core"), _id("r", "n_regionkey")))
    out = out.unionByName(row(supplier, _id("s", "s_suppkey"), "function", F.col("s_name"), F.col("place"), F.concat("s_name", F.lit("(order) -> Part")), _strings("category:core"), _id("n", "s_nationkey")))
    out = out.unionByName(row(customer, _id("c", "c_custkey"), "function", F.col("c_name"), F.concat("place", F.lit("/"), segment), F.concat(F.lit("async "), "c_name", F.lit("(request)")), roles, _id("n", "c_nationkey")))
    brands = part.select("p_brand").distinct()
    out = out.unionByName(row(brands, _id("b", "p_brand"), "class", F.col("p_brand"), F.col("p_brand"), none, _strings("category:core"), none))
    return out.unionByName(row(part, _id("p", "p_partkey"), "method", F.col("p_name"), F.concat("p_brand", F.lit("/"), "p_type"), F.concat("p_name", F.lit("(self) -> "), "p_type"), sizes, _id("b", "p_brand")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, edge_type, confidence), one row for each pair and type."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")

    def row(df: DataFrame, source: Column, target: Column, kind: str, confidence: Column = F.lit("high")) -> DataFrame:  # noqa: B008
        return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_type"), confidence.alias("confidence"))

    ordered = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_custkey", "l_partkey").distinct()
    sent = lines.groupBy("l_partkey", "l_suppkey").agg(F.min((F.col("l_returnflag") == "R")).alias("doubt"))
    out = row(ordered, _id("c", "o_custkey"), _id("p", "l_partkey"), "calls")
    out = out.unionByName(row(sent, _id("p", "l_partkey"), _id("s", "l_suppkey"), "calls", F.when(F.col("doubt"), "low").otherwise("high")))
    out = out.unionByName(row(table(spark, sf_dir, "nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "inherits"))
    out = out.unionByName(row(table(spark, sf_dir, "supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "imports"))
    return out.unionByName(row(table(spark, sf_dir, "customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "imports"))


def succession(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> next").select("l_partkey", "next").distinct()
    e = pairs.select(_id("p", "l_partkey").alias("source_id"), _id("p", "next").alias("target_id"), F.lit("calls").alias("edge_type"), F.lit("high").alias("confidence"))
    part = table(spark, sf_dir, "part")
    n = part.select(
        _id("p", "p_partkey").alias("id"), F.lit("method").alias("kind"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), "p_type").alias("file_path"), F.lit("").alias("signature"), F.lit("").alias("docstring"),
        F.when(F.col("p_size") <= 5, _strings("test", "category:test")).otherwise(_strings("category:core")).alias("tags"), _id("b", "p_brand").alias("parent_id"), F.col("p_size").alias("line_start"), (F.col("p_size") + 9).alias("line_end"),
    )
    return n, e


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    key = lambda turn: F.concat(F.lit("t:"), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("/"), F.lpad(turn.cast("string"), 6, "0"))
    n = t.select("conv_id", "turn").distinct().select(key(F.col("turn")).alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("name"), "conv_id", "turn")
    nxt = t.select("conv_id", F.col("turn").alias("next")).distinct()
    follows = t.select("conv_id", "turn").distinct().join(nxt, "conv_id").where("next = turn + 1")
    e = follows.select(key(F.col("turn")).alias("source_id"), key(F.col("next")).alias("target_id"), F.lit("calls").alias("edge_type"), F.lit("high").alias("confidence"))
    return n, e


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as functions, named by source and language, with their text as docstring."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        _id("d", "doc_id").alias("id"), F.lit("function").alias("kind"), F.concat("source", F.lit("_"), "lang").alias("name"), F.concat("lang", F.lit("/"), "source").alias("file_path"), F.lit("").alias("signature"),
        F.col("text").alias("docstring"), F.array(F.concat(F.lit("source:"), "source"), F.when(F.col("lang") == "en", "category:core").otherwise("category:doc")).alias("tags"), F.lit("").alias("parent_id"),
        F.length("text").cast("double").alias("n"), F.lit(1).alias("line_start"), F.lit(5).alias("line_end"),
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a commit, event types are its files."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    c = e.groupBy("user_id", "day").agg(F.collect_set("event_type").alias("files"), F.max("ts").alias("date"))
    return c.select(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "day")).alias("hash"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"), "date", "files")


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit by its customer's segment, the paths of its parts are its files."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    paths = part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("path"))
    files = lines.join(paths, lines["l_partkey"] == paths["p_partkey"]).groupBy("l_orderkey").agg(F.collect_set("path").alias("files"))
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(files, orders["o_orderkey"] == files["l_orderkey"])
    return o.select(F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.col("c_mktsegment").alias("author"), F.col("o_orderdate").alias("date"), "files")


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are functions and parts their callers; flag and status say how the caller treats errors and results."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.min("l_returnflag").alias("error_handling"), F.min("l_linestatus").alias("return_usage")).select(_id("o", "o").alias("function_id"), _id("p", "p").alias("caller_id"), "error_handling", "return_usage")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("lang", F.lit("/"), "source", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".py")).alias("file_path"), F.col("text").alias("content"))


def _called() -> Column:
    return F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods for the linker, named by name and size, so that several share a name."""
    return table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("id"), F.lit("method").alias("kind"), _called().alias("name"), F.concat("p_type", F.lit("/"), "p_brand", F.lit(".py")).alias("file_path"), F.concat("p_type", F.lit("/"), "p_brand", F.lit(".py::"), "p_brand").alias("parent_id"))


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of consecutive parts of an order as a call of the second's name from the first's file; of larger parts the
    receiver's type is known."""
    _, e = succession(spark, sf_dir)
    p = part_symbols(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("file_path").alias("caller_file"))
    q = table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("target_id"), _called().alias("callee"), "p_brand", "p_size")
    met = e.join(p, "source_id").join(q, "target_id")
    size = F.col("p_size")
    return met.select(
        F.concat("source_id", F.lit(">"), "target_id").alias("call_id"), F.col("source_id").alias("caller_id"), "caller_file", F.concat(F.when(size % 2 == 0, "self.").otherwise(""), F.col("callee")).alias("callee"),
        F.when(size > 25, F.col("p_brand")).otherwise("").alias("receiver_type"), F.struct(F.when(size > 40, "try_except").alias("pattern"), F.when(size > 45, "ValueError").alias("exception")).alias("error_handling"),
        F.when(size > 10, "assigned").otherwise("ignored").alias("return_usage"),
    )


def part_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's file imports the same brand's file of type PROMO, and one that isn't there."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    here = F.concat("p_type", F.lit("/"), "p_brand", F.lit(".py"))
    return p.select(here.alias("file_path"), F.explode(F.array(F.concat(F.lit("PROMO."), "p_brand"), F.lit("os.path"), F.concat(F.lit(".."), "p_type", F.lit("."), "p_brand"))).alias("module_path")).withColumn("imported_names", F.array(F.lit("red widget 7"), F.lit("*")))
