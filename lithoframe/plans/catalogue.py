"""Catalogue queries: parts are the parts of the driver's tables, references run from nation to region and supplier to nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions import text as tx
from lithoframe.functions.units import converted, parsed
from lithoframe.operators import catalogue as c
from lithoframe.operators.properties import same_kind, selected
from lithoframe.plans import q6, query, sq6, table


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.concat(F.lit("part-"), "p_partkey").alias("uuid"), F.col("p_type").alias("obj_type"), F.col("p_name").alias("title"), F.col("p_size").alias("created"),
        F.create_map(F.lit("brand"), "p_brand").alias("extra"), F.col("p_retailprice").alias("price"),
    )


PARTS = "parts as (select 'part-' || p_partkey as uuid, p_type as obj_type, p_name as title, p_size as created, p_brand as brand, p_retailprice as price from part)"


@query(f"with {PARTS} select uuid, title, created from parts where obj_type = 'ECONOMY' and upper(trim(title)) like '%WIDGET' and brand = 'Brand#17'")
def catalogue_filter(spark: SparkSession, d: str) -> DataFrame:
    return c.parts(_parts(spark, d), obj_type="obj_ECONOMY", title="widget ", title_mode="ends", extra={"brand": "Brand#17"}).select("uuid", "title", "created")


_TITLES = [("is", "red widget", "= 'RED WIDGET'"), ("starts", "red", "like 'RED%'"), ("ends", "bolt", "like '%BOLT'"), ("contains", "ue w", "like '%UE W%'"), ("is not", "red widget", "<> 'RED WIDGET'"), ("does not start", "red", "not like 'RED%'"), ("does not end", "bolt", "not like '%BOLT'"), ("does not contain", "ue w", "not like '%UE W%'")]


@query(f"with {PARTS} " + " union all ".join(f"select '{m}' as mode, count(*)::bigint as found from parts where upper(trim(title)) {s}" for m, _, s in _TITLES))
def catalogue_title_modes(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d)
    return p.select(F.explode(F.array(*(F.when(c.title_matches(F.col("title"), w, m), F.lit(m)) for m, w, _ in _TITLES))).alias("mode")).filter("mode is not null").groupBy("mode").agg(F.count("*").alias("found"))


@query(f"with {PARTS} select obj_type, count(*)::bigint as parts, count(distinct title)::bigint as titles from parts group by obj_type")
def catalogue_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).groupBy("obj_type").agg(F.count("*").alias("parts"), F.count_distinct("title").alias("titles"))


@query(f"with {PARTS} select uuid, title, created from parts where obj_type = 'PROMO' order by created desc, uuid limit 1")
def catalogue_newest(spark: SparkSession, d: str) -> DataFrame:
    return c.one_of(c.parts(_parts(spark, d), obj_type="PROMO"), "newest").select("uuid", "title", "created")


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("src"), F.concat(F.lit("region-"), "n_regionkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("src"), F.concat(F.lit("nation-"), "s_nationkey").alias("dst"))
    k = table(spark, d, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("src"), F.concat(F.lit("nation-"), "c_nationkey").alias("dst"))
    return n.unionByName(s).unionByName(k)


RELS = "rels as (select 'nation-' || n_nationkey as src, 'region-' || n_regionkey as dst from nation union all select 'supplier-' || s_suppkey, 'nation-' || s_nationkey from supplier union all select 'customer-' || c_custkey, 'nation-' || c_nationkey from customer)"


@query(f"with {RELS} select distinct uuid from (select dst as uuid from rels where src = 'nation-3' union all select src from rels where dst = 'nation-3')")
def catalogue_related(spark: SparkSession, d: str) -> DataFrame:
    """Semi join: all parts that refer to a part or that it refers to."""
    r = _relationships(spark, d)
    everything = r.select(F.col("src").alias("uuid")).unionByName(r.select(F.col("dst").alias("uuid"))).distinct()
    return c.parts(everything, related=(r, "nation-3"))


@query(f"with recursive {RELS}, seen as (select 'supplier-' || s_suppkey as uuid, 0 as steps from supplier union select dst, steps + 1 from seen join rels on src = uuid) select uuid, min(steps)::integer as steps from seen group by uuid")
def catalogue_reference_closure(spark: SparkSession, d: str) -> DataFrame:
    """What all suppliers refer to."""
    return c.references(_relationships(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("uuid")))


@query("select n_nationkey, n_name from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000)")
def catalogue_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Anti join: what is left when the referred-to uuids are excluded."""
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").join(s, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("select p_partkey from part where p_type = 'STANDARD' and p_name is not null and lower(p_name) in ('red widget', 'widget red') and p_size >= 0")
def property_select(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("property_kind", F.col("p_name"))
    return selected(p, p_type="STANDARD", p_name="*", p_size=None, property_kind="widget red").select("p_partkey")


@query("select p_brand, count(*)::bigint as same from part where p_name = 'blue bolt' group by p_brand")
def property_kind_pseudonym(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").filter(same_kind(F.col("p_name"), F.lit("Bolt blue")))
    return p.groupBy("p_brand").agg(F.count("*").alias("same"))


@query("select p_type, string_agg(b, ',' order by b) as brands, count(*) > 1 as has_multiple from (select distinct p_type, p_brand as b from part) group by p_type")
def property_unique_elements(spark: SparkSession, d: str) -> DataFrame:
    """Distinct non-null elements, sorted, and whether there is more than one."""
    return table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("b")).select("p_type", F.array_join("b", ",").alias("brands"), (F.size("b") > 1).alias("has_multiple"))


@query("select event_type, json_extract_string(props, '$.k')::bigint as k, count(*)::bigint as n from events where json_extract_string(props, '$.k')::bigint between 10 and 19 group by all")
def catalogue_extra_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.filter(F.col("k").between(10, 19)).groupBy("event_type", "k").agg(F.count("*").alias("n"))


_CONV = [("ft", "m"), ("bar", "psi"), ("degF", "degC"), ("bbl/d", "m3/d"), ("d", "h"), ("m", "m"), ("m", "bar"), ("psi/ft", "bar/m"), ("cP.bbl/(psi.d)", "cP.m3/(kPa.d)"), ("lbm/ft3", "kg/m3"), ("acre", "ha")]
_CONV_SQL = {("ft", "m"): "x * 0.3048", ("bar", "psi"): "x * 100000.0 / 6894.757293168361", ("degF", "degC"): "(2298.35 + 5.0 * x) / 9.0 - 273.15", ("bbl/d", "m3/d"): "x * 0.158987294928", ("d", "h"): "x * 24.0", ("m", "m"): "x", ("m", "bar"): "null", ("psi/ft", "bar/m"): "x * 6894.757293168361 / 0.3048 / 100000.0", ("cP.bbl/(psi.d)", "cP.m3/(kPa.d)"): "x * 0.158987294928 / 6.894757293168361", ("lbm/ft3", "kg/m3"): "x * 0.45359237 / 0.028316846592", ("acre", "ha"): "x * 0.40468564224"}


@query("with v as (select c_custkey as id, c_acctbal::double as x, c_custkey % 11 as kind from customer) select id, case kind " + " ".join(f"when {k} then {sq6(_CONV_SQL[u])}" for k, u in enumerate(_CONV)) + " end as y from v")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Values in units of their own, each converted to another by a join with the table of units; null between dimensions."""
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 11).cast("int").alias("kind"))
    pick = lambda n: F.element_at(F.array(*(F.lit(u[n]) for u in _CONV)), F.col("kind") + 1)
    return converted(v.withColumns({"a": pick(0), "b": pick(1)}), "x", "a", "b", "y").select("id", q6(F.col("y")).alias("y"))


_NAMES = ["m", "[FT]", "Feet", "PSI", "stb/d", "MD", "unknown", "K"]
_FOUND = ["m", "ft", "ft", "psi", "bbl/d", "mD", None, "K"]


@query("select p_partkey, case p_partkey % 8 " + " ".join(f"when {k} then " + ("null" if u is None else f"'{u}'") for k, u in enumerate(_FOUND)) + " end as unit from part")
def unit_parsing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    named = p.withColumn("said", F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return named.select("p_partkey", parsed(F.col("said")).alias("unit"))


@query("select doc_id, position(' the ' in text)::bigint as at, trim(string_split(text, chr(10))[1]) as head, length(text) - length(replace(text, 'and', '')) as drop3 from documents where text like '% the %'")
def text_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """The first line with a keyword, and how often another occurs."""
    t = table(spark, d, "documents").filter(F.contains("text", F.lit(" the ")))
    return t.select("doc_id", tx.keyword_at(F.col("text"), " the ").alias("at"), tx.first_line(F.col("text")).alias("head"), (F.length("text") - F.length(F.replace("text", F.lit("and"), F.lit("")))).cast("long").alias("drop3"))


@query("select p_partkey, trim(string_split(p_name || ' ! comment ' || p_brand, '!')[1]) as line, trim(string_split(p_name || ' ! comment ' || p_brand, '!')[2]) as comment from part")
def text_strip_comment(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    line = F.concat("p_name", F.lit(" ! comment "), "p_brand")
    a, b = tx.split_comment(line, "!")
    return p.select("p_partkey", a.alias("line"), b.alias("comment"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html[^>]*lang=\"([a-z]*)\"', 1) as lang from pages")
def text_tag_values(spark: SparkSession, d: str) -> DataFrame:
    """Text and attributes of tags."""
    p = table(spark, d, "pages")
    return p.select("page_id", tx.tag_text(F.col("html"), "title").alias("title"), tx.tag_attribute(F.col("html"), "html", "lang").alias("lang"))


@query("select o_orderkey, (o_custkey % 9 + 1) || ' ' || (o_custkey % 9 + 3) || ' ' || (o_custkey % 5 + 1) || ' ' || (o_custkey % 5 + 2) || ' ' || (o_custkey % 3 + 1) || ' ' || (o_custkey % 3 + 1) as box, strftime(o_orderdate, '%Y-%m-%d') as date from orders")
def text_box_and_date(spark: SparkSession, d: str) -> DataFrame:
    """A box of cells (kji from 0) as text in i, j, k from 1, and a time stamp without its midnight."""
    o = table(spark, d, "orders")
    u = F.col("o_custkey")
    box = tx.box_text(((u % 3, u % 3), (u % 5, u % 5 + 1), (u % 9, u % 9 + 2)))
    return o.select("o_orderkey", box.alias("box"), tx.simple_time(F.col("o_orderdate")).alias("date"))


@query("select p_partkey, string_agg(f::varchar, ' ' order by f) as factors from (select p_partkey, unnest(range(1, p_size + 1)) as f, p_size from part) where p_size % f = 0 group by p_partkey")
def math_all_factors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.factors(F.col("p_size")), " ").alias("factors"))


@query("select 'supplier-' || s_suppkey as uuid, s_name as title from supplier where s_nationkey = 7")
def catalogue_supported(spark: SparkSession, d: str) -> DataFrame:
    """The parts that lean on one part."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("uuid"), F.col("s_name").alias("title"), F.concat(F.lit("nation-"), "s_nationkey").alias("support"))
    return c.supported_by(s.select("uuid", "title"), s.select("uuid", "support"), "nation-7")


_ORDER = ["SMALL", "ECONOMY", "LARGE"]


@query(f"with {PARTS} select uuid, coalesce(nullif(list_position({_ORDER}, obj_type), 0), {len(_ORDER) + 1})::bigint as place from parts")
def catalogue_type_order(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the place of their type in a given order."""
    return c.in_type_order(_parts(spark, d), _ORDER).select("uuid", "place")


@query(f"with {PARTS}, m as (select *, created % 3 as realization from parts) select uuid, realization::integer as realization, first_value(uuid) over (partition by title, obj_type order by realization, uuid) as gathered from m")
def catalogue_gathered(spark: SparkSession, d: str) -> DataFrame:
    """Three catalogues of an ensemble as one, in which parts of equal title and type share a uuid."""
    p = _parts(spark, d)
    members = [p.filter(F.col("created") % 3 == n).select("uuid", "title", "obj_type") for n in range(3)]
    return c.gathered(members, ["title", "obj_type"]).select("uuid", "realization", "gathered")
