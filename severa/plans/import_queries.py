"""Queries on relation rules, on relations that the driver's tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from severa.functions import relations as rel
from severa.functions.durable import fresh_folder
from severa.operators import instance as inst
from severa.plans import derived
from severa.plans.derived import table
from severa.sources import csv_graph, generators, json_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Spellings that order lines stand for, by l_linenumber and returned-ness; the last stands for no known relation.
SPELLINGS = ("Member-Of", "admins", "HasSession", "Generic All", "GetChanges", "GetChangesAll", "Contains", "Mystery")


def query(statement: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return keep


def relation_rows(spark, d):
    """Relations supplier -> part of order lines: the type by quantity, in a spelling of its own."""
    line = table(spark, d, "lineitem")
    at = (F.col("l_quantity").cast("int") % len(SPELLINGS) + 1).cast("int")
    return line.select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string")).alias("src"), F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("dst"),
        F.element_at(F.array(*[F.lit(x) for x in SPELLINGS]), at).alias("raw"),
    )


def typed_nodes(spark, d):
    """Nodes s0 to s49: every seventh is tier-0, every fifth of the rest a default group, s8 has s9 as primary group."""
    i = F.col("id")
    return spark.range(50).select(
        F.concat(F.lit("s"), i.cast("string")).alias("node"), (i % 7 == 0).alias("tier0"),
        F.when(i % 5 == 0, F.lit("domain_users")).alias("wellknown"), F.when(i == 8, F.lit("s9")).alias("primary_group"),
    )


ROWS = """
WITH rel AS (
  SELECT 's' || (l_suppkey % 50) AS src, 's' || (l_partkey % 50) AS dst,
         ['Member-Of', 'admins', 'HasSession', 'Generic All', 'GetChanges', 'GetChangesAll', 'Contains', 'Mystery'][CAST(l_quantity AS INT) % 8 + 1] AS raw
  FROM lineitem),
typed AS (
  SELECT src, dst, raw, CASE lower(regexp_replace(raw, '[^A-Za-z0-9_]', '', 'g'))
    WHEN 'memberof' THEN 'MemberOf' WHEN 'admins' THEN 'AdminTo' WHEN 'hassession' THEN 'HasSession' WHEN 'genericall' THEN 'GenericAll'
    WHEN 'getchanges' THEN 'GetChanges' WHEN 'getchangesall' THEN 'GetChangesAll' WHEN 'contains' THEN 'Contains' ELSE raw END AS etype FROM rel),
node AS (SELECT 's' || i AS node, i % 7 = 0 AS tier0, CASE WHEN i % 5 = 0 THEN 'DOMAIN_USERS' END AS wellknown, CASE WHEN i = 8 THEN 's9' END AS primary_group FROM range(50) r(i)),
pairs AS (
  SELECT src, dst, etype FROM typed WHERE etype NOT IN ('GetChanges', 'GetChangesAll')
  UNION ALL SELECT src, dst, 'DCSync' FROM typed WHERE etype IN ('GetChanges', 'GetChangesAll') GROUP BY src, dst HAVING count(DISTINCT etype) = 2),
costed AS (
  SELECT DISTINCT p.src, p.dst, etype,
    NOT (etype = 'Contains' OR (etype = 'MemberOf' AND (coalesce(t.wellknown = 'DOMAIN_USERS', false) OR coalesce(s.primary_group = p.dst, false))) OR s.tier0) AS deletable,
    CASE etype WHEN 'MemberOf' THEN 5 WHEN 'AdminTo' THEN 3 WHEN 'HasSession' THEN 1 ELSE 2 END AS cost
  FROM pairs p JOIN node s ON p.src = s.node JOIN node t ON p.dst = t.node WHERE p.src <> p.dst)
"""


def etyped(spark, d):
    return relation_rows(spark, d).withColumn("etype", rel.relation(F.col("raw")))


@query(ROWS + "SELECT etype, count(*) AS n FROM typed GROUP BY etype")
def rel05_alias_normaliser(spark, d):
    return etyped(spark, d).groupBy("etype").agg(F.count("*").alias("n"))


@query(ROWS + "SELECT src, dst, etype, count(*) AS n FROM pairs GROUP BY ALL")
def rel09_replication_pairs(spark, d):
    return inst.paired(etyped(spark, d)).groupBy("src", "dst", "etype").agg(F.count("*").alias("n"))


@query(ROWS + "SELECT src, dst, etype, deletable, CASE WHEN deletable THEN cost END::BIGINT AS cost FROM costed")
def rel01_rel02_rel03_relation_costs(spark, d):
    rows = inst.paired(etyped(spark, d)).where("src <> dst").distinct()
    n = typed_nodes(spark, d)
    met = rows.join(n.select(F.col("node").alias("src"), "tier0", "primary_group"), "src").join(n.select(F.col("node").alias("dst"), F.upper("wellknown").alias("known")), "dst")
    free = rel.deletable(F.col("etype"), F.col("known"), F.col("primary_group"), F.col("dst"), F.col("tier0"))
    return met.select("src", "dst", "etype", free.alias("deletable"), F.when(free, rel.default_cost(F.col("etype"))).alias("cost"))


@query(ROWS + "SELECT src, dst, CASE WHEN bool_and(deletable) THEN sum(cost) END::BIGINT AS cost, bool_and(deletable) AS deletable, string_agg(etype, ',' ORDER BY etype) AS etypes FROM costed GROUP BY src, dst")
def rel04_build_graph(spark, d):
    edges = inst.from_relations(typed_nodes(spark, d), inst.paired(etyped(spark, d)))
    return edges.withColumn("etypes", F.array_join("etypes", ","))


@query(ROWS + """SELECT o, s, CASE WHEN lower(o) IN ('members', 'localadmins', 'rdpusers') OR (o IN ('AdminTo') AND s = 'Computer') OR (o = 'HasSession' AND s = 'User') THEN true ELSE false END AS back
FROM unnest(['Members', 'LocalAdmins', 'RDPUsers', 'AdminTo', 'HasSession', 'MemberOf']) a(o), unnest(['User', 'Computer', 'Group']) b(s)""")
def rel08_lists_that_point_back(spark, d):
    keys = spark.createDataFrame([(o, s) for o in ("Members", "LocalAdmins", "RDPUsers", "AdminTo", "HasSession", "MemberOf") for s in ("User", "Computer", "Group")], "o string, s string")
    return keys.select("o", "s", rel.points_back(F.col("o"), rel.relation(F.col("o")), F.col("s")).alias("back"))


@query(ROWS + "SELECT src AS node FROM typed UNION SELECT dst FROM typed EXCEPT SELECT node FROM node WHERE CAST(substr(node, 2) AS INT) < 25")
def rel12_implied_nodes(spark, d):
    return json_graph.implied(relation_rows(spark, d), typed_nodes(spark, d).where(F.substring("node", 2, 9).cast("int") < 25))


@query(ROWS + "SELECT DISTINCT src AS node FROM typed WHERE src NOT IN (SELECT node FROM node WHERE tier0)")
def val02_annotations_of_unknown_nodes(spark, d):
    return json_graph.unknown(relation_rows(spark, d).select(F.col("src").alias("node")), typed_nodes(spark, d).where("tier0"))


def export(spark, d) -> str:
    """A folder of JSON Lines in several shapes, from all suppliers, customers, nations and regions, and from all order lines.

    Suppliers are node records with fields of their own, nations hold their customers as a list that points back, regions
    have labels and properties. Order lines are relations between suppliers in five spellings, with ends as objects or as
    plain ids; what they name beyond the known suppliers is implied.
    """
    folder = fresh_folder(spark, "export")
    put = lambda df, name: df.write.json(f"{folder}/{name}", mode="overwrite")
    s, c, n, r = (table(spark, d, t) for t in ("supplier", "customer", "nation", "region"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    put(s.select(key("s", "s_suppkey").alias("id"), F.lit("User").alias("type"), F.when(F.col("s_acctbal") > 0, 2).alias("entry_weight"), key("n", "s_nationkey").alias("primary_group")), "suppliers")
    members = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(key("c", "c_custkey"))).alias("Members"))
    nations = n.join(members, n["n_nationkey"] == members["c_nationkey"], "left")
    put(nations.select(key("n", "n_nationkey").alias("ObjectIdentifier"), F.lit("Base_Group").alias("Type"), F.struct(F.col("n_name").alias("name"), "Members", F.when(F.col("n_nationkey") % 5 == 0, "domain_users").alias("wellknown")).alias("Properties")), "nations")
    regions = r.select(F.lit("node").alias("type"), key("r", "r_regionkey").alias("id"), F.array(F.lit("Base"), F.lit("Domain")).alias("labels"), F.struct(F.col("r_name").alias("name"), F.lit(True).alias("highvalue"), (F.col("r_regionkey") == 0).alias("tier0"), F.lit("7").alias("target_value")).alias("properties"))
    put(regions, "regions")
    put(n.select(F.lit("relationship").alias("type"), F.lit("GenericAll").alias("label"), F.struct(key("n", "n_nationkey").alias("id")).alias("start"), F.struct(key("r", "n_regionkey").alias("id")).alias("end")), "belongs")
    put(s.select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target"), F.lit("member-of").alias("type")), "memberships")
    at = (F.col("l_linenumber") % 5 + 1).cast("int")
    line = table(spark, d, "lineitem").select(key("s", "l_suppkey").alias("src"), F.concat(F.lit("s"), (F.col("l_partkey") % 1000).cast("string")).alias("dst"), F.element_at(F.array(*[F.lit(x) for x in ("Has Session", "rdp", "GetChanges", "getchangesall", "Odd")]), at).alias("Kind"))
    put(line.distinct(), "lines")
    return folder


EXPORT = """
WITH known AS (
  SELECT 's' || s_suppkey AS node, 'User' AS ntype, CASE WHEN s_acctbal > 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS entry_weight, 0.0::DOUBLE AS target_value, false AS tier0, NULL AS wellknown, 'n' || s_nationkey AS primary_group FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'Group', 0, 0, false, CASE WHEN n_nationkey % 5 = 0 THEN 'DOMAIN_USERS' END, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'Domain', 0, 7, r_regionkey = 0, NULL, NULL FROM region),
line AS (SELECT DISTINCT 's' || l_suppkey AS src, 's' || (l_partkey % 1000) AS dst, ['HasSession', 'CanRDP', 'GetChanges', 'GetChangesAll', 'Odd'][CAST(l_linenumber AS INT) % 5 + 1] AS etype FROM lineitem),
rel AS (
  SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'MemberOf' AS etype FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'MemberOf' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'GenericAll' FROM nation
  UNION ALL SELECT * FROM line),
rights AS (SELECT src, dst, count(DISTINCT etype) AS n FROM rel WHERE etype IN ('GetChanges', 'GetChangesAll') GROUP BY src, dst),
kept AS (SELECT DISTINCT src, dst, etype FROM (SELECT src, dst, etype FROM rel WHERE etype NOT IN ('GetChanges', 'GetChangesAll') UNION ALL SELECT src, dst, 'DCSync' FROM rights WHERE n = 2)),
nodes AS (
  SELECT * FROM known
  UNION ALL SELECT node, 'Other', 0, 0, false, NULL, NULL FROM (SELECT src AS node FROM rel UNION SELECT dst FROM rel) WHERE node NOT IN (SELECT node FROM known)),
costed AS (
  SELECT k.src, k.dst, etype, NOT ((etype = 'MemberOf' AND (coalesce(t.wellknown = 'DOMAIN_USERS', false) OR coalesce(s.primary_group = k.dst, false))) OR s.tier0) AS free,
    CASE etype WHEN 'MemberOf' THEN 5 WHEN 'HasSession' THEN 1 ELSE 2 END AS cost
  FROM kept k JOIN nodes s ON k.src = s.node JOIN nodes t ON k.dst = t.node WHERE k.src <> k.dst)
"""


@query(EXPORT + "SELECT src, dst, CASE WHEN bool_and(free) THEN sum(cost) END::BIGINT AS cost, bool_and(free) AS deletable, string_agg(etype, ',' ORDER BY etype) AS etypes FROM costed GROUP BY src, dst")
def src05_src06_src08_import_edges(spark, d):
    """An export from its files: scan, split, relations of records and of embedded lists, pairing, costs."""
    return json_graph.load(spark, export(spark, d)).instance.edges.select("src", "dst", "cost", "deletable", F.array_join("etypes", ",").alias("etypes"))


@query(EXPORT + "SELECT node, ntype, entry_weight, target_value, tier0 FROM nodes")
def src07_rel07_import_nodes(spark, d):
    return json_graph.load(spark, export(spark, d)).instance.nodes.select("node", "ntype", "entry_weight", "target_value", "tier0")


@query(EXPORT + """SELECT (SELECT count(*) FROM known) AS node_records, (SELECT count(*) FROM rel) AS relation_records, (SELECT count(*) FROM rel WHERE etype = 'Odd') AS odd,
  (SELECT count(*) FROM rights WHERE n = 2) AS dcsync_pairs, (SELECT count(*) FROM rights WHERE n = 1) AS incomplete_replication_pairs, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE tier0) AS tier0_nodes""")
def rel06_rel10_import_statistics(spark, d):
    """The import's own counts; an unknown relation is kept and counted by its name."""
    got = json_graph.load(spark, export(spark, d)).statistics
    names = ("node_records", "relation_records", "dcsync_pairs", "incomplete_replication_pairs", "nodes", "tier0_nodes")
    return spark.createDataFrame([(*[got[x] for x in names], got["unknown_relation_types"]["Odd"])], ", ".join(f"{x} long" for x in (*names, "odd")))


@query(EXPORT + "SELECT node, CASE WHEN substr(node, 1, 1) = 'n' THEN 3.0 ELSE 0.0 END::DOUBLE AS entry_weight, CASE WHEN node = 'r1' THEN 4.0 ELSE 0.0 END::DOUBLE AS target_value FROM nodes")
def rel11_given_mappings_replace(spark, d):
    """The caller's entries and targets stand for those that the files name."""
    nations = {f"n{r.n_nationkey}": 3.0 for r in table(spark, d, "nation").select("n_nationkey").collect()}  # a few dozen
    return json_graph.load(spark, export(spark, d), entry_weight=nations, target_value={"r1": 4.0}).instance.nodes.select("node", "entry_weight", "target_value")


@query("SELECT 'c' || c_custkey AS node, CASE c_custkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN c_custkey ELSE c_nationkey END::DOUBLE AS value FROM customer")
def src09_mapping_file(spark, d):
    """A mapping file of plain ids, of commas and of tabs, with comments."""
    c, folder = table(spark, d, "customer"), fresh_folder(spark, "mapping")
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(key, F.lit(" # no value"))).when(F.col("c_custkey") % 3 == 1, F.concat(key, F.lit(" , "), F.col("c_custkey").cast("string"))).otherwise(F.concat(key, F.lit("\t"), F.col("c_nationkey").cast("string")))
    c.select(line).write.text(folder)
    return csv_graph.mapping(spark, folder, 1.5)


@query(derived.sql() + " SELECT src, dst, cost, deletable FROM medges")
def src01_src03_snk01_saved_edges(spark, d):
    """An instance that was saved as CSV files and a meta.json, and loaded again."""
    folder = fresh_folder(spark, "saved")
    made = derived.instance(spark, d)
    csv_graph.save(inst.Instance(made.nodes, made.edges, made.name, {"from": "tables"}), folder)
    again = csv_graph.load(spark, folder)
    if again.meta != {"from": "tables"}:
        raise AssertionError(again.meta)
    return again.edges.select("src", "dst", "cost", "deletable")


@query("""SELECT o_orderkey, lower(trim(CASE o_orderkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN '' ELSE 'yess' END)) IN ('1', 'true', 'yes', 'y', 't') AS truthy FROM orders""")
def src04_truthy(spark, d):
    told = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "TRUE ", "1", "no", "", "yess")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", rel.truthy(told).alias("truthy"))


@query("""
WITH r AS (SELECT 'c' || o_custkey AS src, 'o' || (o_orderkey % 97) AS dst, trunc(o_totalprice / 100) + 1 AS cost, o_orderstatus <> 'P' AS deletable FROM orders)
SELECT src, dst, CASE WHEN bool_and(deletable) THEN sum(cost) FILTER (deletable) END::BIGINT AS cost, bool_and(deletable) AS deletable, count(*) AS multiplicity FROM r GROUP BY src, dst""")
def src01_csv_edges(spark, d):
    """Edge rows as text, as a CSV scan gives them: padded ids, fractional costs, a deletable that is a word."""
    price = F.concat((F.floor(F.col("o_totalprice") / 100) + 1).cast("string"), F.lit(".7"))
    raw = table(spark, d, "orders").select(
        F.concat(F.lit(" c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), (F.col("o_orderkey") % 97).cast("string"), F.lit(" ")).alias("dst"),
        F.when(F.col("o_orderstatus") != "P", price).alias("cost"), F.when(F.col("o_orderstatus") != "P", F.lit("YES")).alias("deletable"),
    )
    return inst.merged(csv_graph.edge_rows(raw))


@query("SELECT 'c' || c_custkey AS node, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE 0 END::DOUBLE AS entry_weight, 0.0::DOUBLE AS target_value FROM customer")
def src02_csv_nodes(spark, d):
    raw = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("node"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey").cast("string")).otherwise(F.lit("")).alias("entry_weight"), F.lit(None).cast("string").alias("target_value"))
    return csv_graph.node_rows(raw)


@query("""
WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_suppkey % 20 AS a, l_partkey % 20 AS b FROM lineitem) WHERE a <> b)
SELECT 's' || a || '_' || b AS src, 'v' || a AS dst, NULL::BIGINT AS cost, false AS deletable FROM e UNION ALL SELECT 's' || a || '_' || b, 'v' || b, NULL, false FROM e
UNION ALL SELECT DISTINCT 'v' || x, 't', 1, true FROM (SELECT a AS x FROM e UNION SELECT b FROM e)""")
def src14_two_routes(spark, d):
    h = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("a"), (F.col("l_partkey") % 20).alias("b"))
    return generators.two_routes(h).edges.drop("multiplicity")


@query("""
SELECT 'c' || c_custkey AS node, c_mktsegment = 'BUILDING' AS is_target, CASE WHEN c_mktsegment = 'BUILDING' THEN 10.0 ELSE 0.0 END::DOUBLE AS target_value,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'DOMAIN_USERS' END AS wellknown FROM customer""")
def src16_annotation_policy(spark, d):
    c = table(spark, d, "customer")
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.col("c_mktsegment"), F.lit("@x")).alias("name"), F.lit("Group").alias("ntype"), F.lit("OU=T1,").alias("dn"), F.lit(True).alias("enabled"), F.lit(False).alias("admincount"))
    told = generators.annotated(nodes, 1, {"MACHINERY": "DOMAIN_USERS"}, ("BUILDING",))
    return told.select("node", F.col("tier0").alias("is_target"), "target_value", "wellknown")


@query()
def src10_typed_generator(spark, d):
    return generators.typed(spark, generators.Config(seed=1)).edges.withColumn("etypes", F.array_join("etypes", ","))


@query()
def src13_layered_generator(spark, d):
    return generators.layered(spark, 500, 1).edges
