"""Queries over the supplied tables, each with SQL that gives the same rows.

Pages are read as HTML. Orders with their lines are composed to XML and read back, so that the engine's answers can be
held against SQL on the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.functions import datatypes as D
from treeframe.operators import catalogs, emit, identity, patterns, projection, schematron, trees, validation, xinclude, xpointer, xsd
from treeframe.plans import relaxng, xslt
from treeframe.sources import shred, store
from treeframe.xpath import evaluate, select

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# pages

#: Columns that path queries need; others are not made.
LEAN = ["pre", "last", "parent", "sib", "kind", "prefix", "local", "sval", "attrs", "anc", "path"]


def pages(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return shred.read_html(table(spark, sf_dir, "pages"), id_col="page_id", columns=columns)


def stored_pages(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return store.stored(pages(spark, sf_dir, columns))


@query("""SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""")
def html_links(spark, sf_dir):
    found = select(pages(spark, sf_dir, ["pre", "last", "kind", "prefix", "local", "attrs", "anc", "path"]), "//nav//a/@href")
    return found.groupBy(F.col("value").alias("href")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages""")
def html_titles(spark, sf_dir):
    found = evaluate(stored_pages(spark, sf_dir, LEAN), "normalize-space(//title)")
    return found.select(F.col("doc_id").alias("page_id"), F.col("value").alias("title"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p>'))::DOUBLE AS n FROM pages")
def html_paragraphs(spark, sf_dir):
    found = evaluate(stored_pages(spark, sf_dir, LEAN), "count(//p)")
    return found.select(F.col("doc_id").alias("page_id"), F.col("value").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def html_language(spark, sf_dir):
    found = select(pages(spark, sf_dir, LEAN), "/html/@lang")
    return found.select(F.col("doc_id").alias("page_id"), F.col("value").alias("lang"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<\\1>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag UNION ALL SELECT 'body', 0 WHERE false")
def html_tags(spark, sf_dir):
    nodes = pages(spark, sf_dir, ["pre", "kind", "local", "path"])
    return nodes.where("kind = 'element'").groupBy(F.col("local").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages WHERE regexp_matches(html, '<li>')")
def pattern_items(spark, sf_dir):
    found = patterns.matches(pages(spark, sf_dir, ["pre", "kind", "attrs", "path"]), "nav/ul/li")
    return found.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, 'html-unique-id' AS rule, 0::BIGINT AS n FROM pages WHERE false""")
def html_findings(spark, sf_dir):
    found = validation.validate(stored_pages(spark, sf_dir, ["pre", "last", "parent", "kind", "prefix", "local", "attrs", "path", "line", "col"]), ["html-void-empty", "html-required-parent", "html-unique-id", "unique-attributes"])
    return found.groupBy(F.col("doc_id").alias("page_id"), "rule").agg(F.count("*").alias("n"))


# orders as documents

_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def order_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order's key), xml: an order with its lines, ordered by all their columns."""
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_LINE).alias("l"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("ls"))  # a few lines an order
    cents = F.round  # price in cents, as a whole number
    line = lambda x: F.concat(F.lit("<line"), attr("flag", x["l_returnflag"]), attr("n", x["l_linenumber"]), attr("part", x["l_partkey"]), attr("price", cents(x["l_extendedprice"] * 100).cast("long")), attr("qty", x["l_quantity"].cast("long")), F.lit("></line>"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    body = F.coalesce(F.array_join(F.transform("ls", line), ""), F.lit(""))
    head = F.concat(F.lit("<order"), attr("cust", F.col("o_custkey")), attr("key", F.col("o_orderkey")), attr("status", F.col("o_orderstatus")), attr("total", cents(F.col("o_totalprice") * 100).cast("long")), F.lit(">"))
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.concat(head, body, F.lit("</order>")).alias("xml"))


def orders(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """For queries that join the node table with itself; it is parsed once."""
    return store.stored(shred.read_xml(order_xml(spark, sf_dir), columns=columns or LEAN))


def streamed_orders(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """For queries that read the node table once."""
    return shred.read_xml(order_xml(spark, sf_dir), columns=columns)


_ROWS = """WITH l AS (SELECT o_orderkey AS doc_id, o_custkey AS cust, o_orderstatus AS status, l_linenumber AS n, l_partkey AS part, l_quantity::BIGINT AS qty, round(l_extendedprice * 100)::BIGINT AS price, l_returnflag AS flag,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS size
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey) """


@query(_ROWS + "SELECT doc_id, part::VARCHAR AS part FROM l WHERE status = 'F' AND qty > 40")
def xpath_child_predicate(spark, sf_dir):
    return select(orders(spark, sf_dir), "/order[@status='F']/line[@qty>40]/@part").select("doc_id", F.col("value").alias("part"))


@query(_ROWS + "SELECT doc_id, 'first' AS place, part::VARCHAR AS part FROM l WHERE pos = 1 UNION ALL SELECT doc_id, 'last', part::VARCHAR FROM l WHERE pos = size UNION ALL SELECT doc_id, 'third', part::VARCHAR FROM l WHERE pos = 3")
def xpath_positions(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    one = lambda name, path: select(nodes, path).select("doc_id", F.lit(name).alias("place"), F.col("value").alias("part"))
    return one("first", "/order/line[1]/@part").unionByName(one("last", "/order/line[last()]/@part")).unionByName(one("third", "/order/line[position()=3]/@part"))


@query(_ROWS + "SELECT o_orderkey AS doc_id, count(n)::DOUBLE AS n, coalesce(sum(qty), 0)::DOUBLE AS qty FROM orders LEFT JOIN l ON o_orderkey = doc_id GROUP BY o_orderkey")
def xpath_count_sum(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    n = evaluate(nodes, "count(/order/line)").select("doc_id", F.col("value").alias("n"))
    return n.join(evaluate(nodes, "sum(/order/line/@qty)").select("doc_id", F.col("value").alias("qty")), "doc_id")


@query(_ROWS + "SELECT doc_id, min(price)::DOUBLE AS low, max(price)::DOUBLE AS high FROM l GROUP BY doc_id")
def exslt_min_max(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    low = evaluate(nodes, "math:min(/order/line/@price)").select("doc_id", F.col("value").alias("low"))
    both = low.join(evaluate(nodes, "math:max(/order/line/@price)").select("doc_id", F.col("value").alias("high")), "doc_id")
    return both.where(~F.isnan("low"))


@query(_ROWS + "SELECT DISTINCT a.doc_id, a.pos::DOUBLE AS place, a.part::VARCHAR AS part FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.pos = b.pos + 1 WHERE b.flag = 'R'")
def xpath_following_sibling(spark, sf_dir):
    found = select(orders(spark, sf_dir), "/order/line[@flag='R']/following-sibling::line[1]/@part")
    # the elements are numbered from 2, after the document and the order
    return found.select("doc_id", (F.col("pre") - 1).cast("double").alias("place"), F.col("value").alias("part"))


@query(_ROWS + "SELECT doc_id, pos::DOUBLE AS place FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.qty > a.qty)")
def xpath_preceding_compare(spark, sf_dir):
    found = select(orders(spark, sf_dir), "/order/line[preceding-sibling::line/@qty > @qty]")
    return found.select("doc_id", (F.col("pre") - 1).cast("double").alias("place"))


@query(_ROWS + "SELECT doc_id, pos::DOUBLE AS place, n::VARCHAR AS n FROM l WHERE qty > 45 OR flag = 'A'")
def xpath_union(spark, sf_dir):
    found = select(orders(spark, sf_dir), "/order/line[@qty > 45]/@n | /order/line[@flag = 'A']/@n")
    return found.select("doc_id", (F.col("pre") - 1).cast("double").alias("place"), F.col("value").alias("n"))


@query(_ROWS + "SELECT DISTINCT doc_id, flag FROM l")
def exslt_distinct(spark, sf_dir):
    return select(orders(spark, sf_dir), "set:distinct(/order/line/@flag)").select("doc_id", F.col("value").alias("flag"))


@query(_ROWS + "SELECT doc_id, pos::DOUBLE AS place, 'difference' AS op FROM l WHERE qty > 10 AND NOT flag = 'N' UNION ALL SELECT doc_id, pos::DOUBLE, 'intersection' FROM l WHERE qty > 10 AND flag = 'N'")
def exslt_difference_intersection(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    one = lambda op: select(nodes, f"set:{op}(/order/line[@qty > 10], //line[@flag = 'N'])").select("doc_id", (F.col("pre") - 1).cast("double").alias("place"), F.lit(op).alias("op"))
    return one("difference").unionByName(one("intersection"))


@query(_ROWS + ", m AS (SELECT *, max(qty) OVER (PARTITION BY doc_id) AS top FROM l) SELECT doc_id, pos::DOUBLE AS place FROM m WHERE qty = top")
def exslt_highest(spark, sf_dir):
    found = select(orders(spark, sf_dir), "math:highest(/order/line/@qty)")
    return found.select("doc_id", (F.col("pre") - 1).cast("double").alias("place"))


@query(_ROWS + "SELECT doc_id, string_agg(concat(n, ':', flag), ' ' ORDER BY pos) AS text FROM l WHERE pos <= 2 AND size >= 2 GROUP BY doc_id")
def xpath_strings(spark, sf_dir):
    found = evaluate(orders(spark, sf_dir), "concat(/order/line[1]/@n, ':', /order/line[1]/@flag, ' ', /order/line[2]/@n, ':', translate(/order/line[2]/@flag, 'xyz', 'abc'))")
    return found.where(~F.col("value").endswith(":")).select("doc_id", F.col("value").alias("text"))


@query(_ROWS + "SELECT DISTINCT doc_id, status FROM l WHERE flag = 'R' AND qty >= 30")
def xpath_ancestor(spark, sf_dir):
    return select(orders(spark, sf_dir), "//line[@flag = 'R' and @qty >= 30]/ancestor::order/@status").select("doc_id", F.col("value").alias("status"))


@query(_ROWS + "SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM l WHERE doc_id = o_orderkey AND flag = 'R')")
def xpath_negation(spark, sf_dir):
    return select(orders(spark, sf_dir), "/order[not(line/@flag = 'R')]").select("doc_id")


@query(_ROWS + "SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id")
def pattern_lines(spark, sf_dir):
    return patterns.matches(streamed_orders(spark, sf_dir, ["pre", "kind", "attrs", "path"]), "order/line/@qty").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_ROWS + "SELECT doc_id, (count(*) - count(DISTINCT n))::BIGINT AS repeats FROM l GROUP BY doc_id HAVING count(*) > count(DISTINCT n)")
def identity_unique(spark, sf_dir):
    found = identity.unique(orders(spark, sf_dir), "/order", "line", ["@n"], ["integer"])
    return found.groupBy("doc_id").agg(F.count("*").alias("repeats"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 2 = 0")
def identity_keyref(spark, sf_dir):
    """Of one document for each order, that lists its own key only if it is odd."""
    keys = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit('<k id="0'), F.col("o_orderkey").cast("string"), F.lit('"/>'))).otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("<r>"), keys, F.lit('<ref to="'), F.col("o_orderkey").cast("string"), F.lit('"/></r>')).alias("xml"))
    return identity.keyref(store.stored(shred.read_xml(rows, columns=LEAN)), "/r", "ref", ["@to"], "k", ["@id"], ["integer"]).select("doc_id")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_totalprice >= 100000 THEN 'maxExclusive' END AS reason, (round(o_totalprice * 100)::BIGINT < 50000000) AS small FROM orders")
def datatype_facets(spark, sf_dir):
    t = D.SimpleType("decimal", (("fractionDigits", 2), ("maxExclusive", "100000")))
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), D.reason(price, t).alias("reason"), D.is_valid(cents, D.SimpleType("integer", (("maxExclusive", "50000000"),))).alias("small"))


@query("""SELECT event_id AS doc_id, CASE WHEN event_type = 'purchase' AND NOT value > 50 THEN 'error' WHEN event_type <> 'purchase' AND value > 100 THEN 'warning' END AS severity
 FROM events WHERE (event_type = 'purchase' AND NOT value > 50) OR (event_type <> 'purchase' AND value > 100)""")
def schematron_events(spark, sf_dir):
    rules = schematron.Schematron("""<schema xmlns="http://purl.oclc.org/dsdl/schematron"><pattern id="p">
 <rule context="event[@type='purchase']"><assert test="@value &gt; 50">low</assert></rule>
 <rule context="event"><report test="@value &gt; 100">high</report></rule></pattern></schema>""")
    number = F.col("value").cast("decimal(30,12)").cast("string")
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_id").alias("doc_id"), F.concat(F.lit('<event type="'), "event_type", F.lit('" value="'), number, F.lit('"/>')).alias("xml"))
    return rules.validate(store.stored(shred.read_xml(rows, columns=LEAN))).select("doc_id", "severity")


_TEXT = _ROWS + """, x AS (SELECT o_orderkey AS doc_id, '<order cust="' || o_custkey || '" key="' || o_orderkey || '" status="' || o_orderstatus || '" total="' || round(o_totalprice * 100)::BIGINT || '">' ||
 coalesce((SELECT string_agg('<line flag="' || flag || '" n="' || n || '" part="' || part || '" price="' || price || '" qty="' || qty || '"></line>', '' ORDER BY pos) FROM l WHERE doc_id = o_orderkey), '') || '</order>' AS text FROM orders) """


@query(_TEXT + "SELECT doc_id, sha256(text) AS sha256 FROM x")
def canonical_digest(spark, sf_dir):
    return emit.digest(orders(spark, sf_dir, ["pre", "last", "level", "kind", "prefix", "local", "value", "attrs", "nsown"]))


@query(_TEXT + "SELECT doc_id, replace(replace(text, '></line>', '/>'), '></order>', CASE WHEN contains(text, '<line') THEN '></order>' ELSE '/>' END) AS text FROM x")
def serialize_orders(spark, sf_dir):
    return emit.serialize(streamed_orders(spark, sf_dir, ["pre", "last", "level", "kind", "prefix", "local", "value", "attrs", "nsown"]))


@query(_ROWS + "SELECT doc_id, part::VARCHAR AS part FROM l WHERE pos = 2")
def xpointer_element(spark, sf_dir):
    found = xpointer.resolve(orders(spark, sf_dir), "xpointer(/nothing)xpointer(/order/line[2]/@part)")
    return found.select("doc_id", F.col("value").alias("part"))


@query("SELECT n_nationkey::VARCHAR AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def key_join(spark, sf_dir):
    """Nations look up their regions by key(), in a document for each nation that holds all regions."""
    regions = table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<region id="'), F.col("r_regionkey").cast("string"), F.lit('" name="'), "r_name", F.lit('"/>')))), "").alias("rs")).first()[0]
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit(f"<world>{regions}<nation region=\""), F.col("n_regionkey").cast("string"), F.lit('"/></world>')).alias("xml"))
    found = select(store.stored(shred.read_xml(rows, columns=LEAN)), "key('r', /world/nation/@region)/@name", keys={"r": ("region", "@id")})
    return found.select(F.col("doc_id").cast("string").alias("nation"), F.col("value").alias("region"))


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 3 AS kind FROM orders WHERE o_orderkey % 3 > 0""")
def dtd_findings(spark, sf_dir):
    """Orders whose document lacks a required attribute (1) or has an undeclared element (2)."""
    body = F.when(F.col("o_orderkey") % 3 == 1, "<o><line/></o>").when(F.col("o_orderkey") % 3 == 2, '<o><line n="1"/><other/></o>').otherwise('<o><line n="1"/><line n="2"/></o>')
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("xml"))
    dtd = validation.DTD("<!ELEMENT o (line+)><!ELEMENT line EMPTY><!ATTLIST line n CDATA #REQUIRED>")
    found = dtd.validate(store.stored(shred.read_xml(rows)))
    kind = F.when(F.col("rule") == "dtd-required-attribute", 1).when(F.col("rule") == "dtd-undeclared-element", 2)
    return found.select("doc_id", kind.cast("long").alias("kind")).where("kind IS NOT NULL")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'unclosedElement' ELSE 'undefinedEntity' END AS code FROM orders")
def read_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "<a><b></a>").otherwise("<a>&none;</a>").alias("xml"))
    return shred.faults(rows).select("doc_id", "code")


@query(_ROWS + "SELECT o_orderkey AS doc_id, (2 + 2 * count(n))::BIGINT AS tags FROM orders LEFT JOIN l ON o_orderkey = doc_id GROUP BY o_orderkey")
def pull_events(spark, sf_dir):
    nodes = streamed_orders(spark, sf_dir, ["pre", "last", "level", "kind", "prefix", "local", "ns", "attrs", "value"])
    return shred.events(nodes).where("type IN ('startElement', 'endElement')").groupBy("doc_id").agg(F.count("*").alias("tags"))


# schemas and stylesheets

_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order"><xs:complexType><xs:sequence><xs:element name="line" maxOccurs="unbounded" type="Line"/></xs:sequence>
<xs:attribute name="cust" type="xs:nonNegativeInteger" use="required"/><xs:attribute name="key" type="xs:nonNegativeInteger" use="required"/><xs:attribute name="status" type="Flag"/><xs:attribute name="total" type="xs:integer"/></xs:complexType></xs:element>
<xs:simpleType name="Flag"><xs:restriction base="xs:string"><xs:length value="1"/><xs:pattern value="[A-Z]"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Quantity"><xs:restriction base="xs:int"><xs:maxInclusive value="45"/></xs:restriction></xs:simpleType>
<xs:complexType name="Line"><xs:attribute name="flag" type="Flag"/><xs:attribute name="n" type="xs:int"/><xs:attribute name="part" type="xs:long"/><xs:attribute name="price" type="xs:long"/><xs:attribute name="qty" type="Quantity"/></xs:complexType></xs:schema>"""


@query(_ROWS + "SELECT doc_id, 'xsd-attribute-value' AS rule, count(*) AS n FROM l WHERE qty > 45 GROUP BY doc_id UNION ALL SELECT o_orderkey, 'xsd-content', 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def xsd_findings(spark, sf_dir):
    nodes = orders(spark, sf_dir, ["pre", "last", "parent", "sib", "level", "kind", "prefix", "local", "value", "sval", "attrs", "anc", "path", "line", "col"])
    return xsd.Schema(_XSD).validate(nodes).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


_RNG = """<element name="order" xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><attribute name="cust"/><attribute name="key"/><attribute name="status"/><attribute name="total"/>
<oneOrMore><element name="line"><attribute name="flag"><choice><value>A</value><value>N</value><value>R</value></choice></attribute><attribute name="n"/><attribute name="part"/><attribute name="price"/><attribute name="qty"><data type="int"><param name="maxInclusive">45</param></data></attribute></element></oneOrMore></element>"""


@query(_ROWS + "SELECT o_orderkey AS doc_id, count(n) > 0 AND coalesce(max(qty), 0) <= 45 AS valid FROM orders LEFT JOIN l ON o_orderkey = doc_id GROUP BY o_orderkey")
def relaxng_verdicts(spark, sf_dir):
    return relaxng.validate(order_xml(spark, sf_dir), _RNG).select("doc_id", "valid")


_XSL = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output method="text"/>
<xsl:template match="/order"><xsl:value-of select="@key"/>:<xsl:apply-templates select="line[@qty &gt; 20]"><xsl:sort select="@qty" data-type="number" order="descending"/></xsl:apply-templates></xsl:template>
<xsl:template match="line"><xsl:if test="position() &gt; 1">,</xsl:if><xsl:value-of select="concat(@part, '/', format-number(@price div 100, '0.00'))"/></xsl:template></xsl:stylesheet>"""


@query(_ROWS + "SELECT o_orderkey AS doc_id, o_orderkey || ':' || coalesce(string_agg(part || '/' || (price // 100) || '.' || lpad((price % 100)::VARCHAR, 2, '0'), ',' ORDER BY qty DESC, pos) FILTER (qty > 20), '') AS output FROM orders LEFT JOIN l ON o_orderkey = doc_id GROUP BY o_orderkey")
def xslt_sorted_text(spark, sf_dir):
    return xslt.transform(order_xml(spark, sf_dir), _XSL).select("doc_id", "output")


_GROUPS = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output omit-xml-declaration="yes"/><xsl:key name="f" match="line" use="@flag"/>
<xsl:template match="/"><flags><xsl:for-each select="//line[generate-id() = generate-id(key('f', @flag)[1])]"><xsl:sort select="@flag"/><flag name="{@flag}" qty="{sum(key('f', @flag)/@qty)}"/></xsl:for-each></flags></xsl:template></xsl:stylesheet>"""


@query(_ROWS + ", g AS (SELECT doc_id, flag, sum(qty)::BIGINT AS q FROM l GROUP BY doc_id, flag) SELECT o_orderkey AS doc_id, CASE WHEN count(flag) = 0 THEN '<flags/>' ELSE '<flags>' || string_agg('<flag name=\"' || flag || '\" qty=\"' || q || '\"/>', '' ORDER BY flag) || '</flags>' END AS output FROM orders LEFT JOIN g ON o_orderkey = doc_id GROUP BY o_orderkey")
def xslt_grouping(spark, sf_dir):
    return xslt.transform(order_xml(spark, sf_dir), _GROUPS).select("doc_id", "output")


@query("SELECT n_nationkey::BIGINT AS doc_id, '<nation>' || r_name || '&lt;' || n_name || '</nation>' AS xml FROM nation JOIN region ON n_regionkey = r_regionkey")
def xinclude_regions(spark, sf_dir):
    """Nations include their region's name and their own as text resources."""
    rows = table(spark, sf_dir, "nation")
    inc = lambda c: F.concat(F.lit('<xi:include parse="text" href="'), c, F.lit('"/>'))
    docs = rows.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit('<nation xmlns:xi="http://www.w3.org/2001/XInclude">'), inc(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))), inc(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))), F.lit("</nation>")).alias("xml"), F.lit("http://x/d").alias("uri"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("http://x/r"), F.col("r_regionkey").cast("string")).alias("uri"), F.col("r_name").alias("content"))
    nations = rows.select(F.concat(F.lit("http://x/n"), F.col("n_nationkey").cast("string")).alias("uri"), F.concat(F.lit("<"), "n_name").alias("content"))
    out = xinclude.include(docs, regions.unionByName(nations))
    return out.select("doc_id", F.replace("xml", F.lit(' xmlns:xi="http://www.w3.org/2001/XInclude"'), F.lit("")).alias("xml"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'http://local/exact' WHEN p_partkey % 4 = 1 THEN 'http://local/brand/' || replace(p_brand, 'Brand#', '') WHEN p_partkey % 4 = 2 THEN 'http://local/any.dtd' END AS target FROM part")
def catalog_resolution(spark, sf_dir):
    entries = catalogs.parse_oasis("""<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog" xml:base="http://local/"><public publicId="-//P//EN" uri="exact"/><rewriteSystem systemIdStartString="http://far/" rewritePrefix="all/"/>
<rewriteSystem systemIdStartString="http://far/Brand#" rewritePrefix="brand/"/><systemSuffix systemIdSuffix=".dtd" uri="any.dtd"/></catalog>""")
    k, null = F.col("p_partkey") % 4, F.lit(None).cast("string")
    system = F.when(k == 1, F.concat(F.lit("http://far/"), "p_brand")).when(k == 2, F.concat(F.lit("urn:"), F.col("p_partkey").cast("string"), F.lit(".dtd"))).when(k == 3, "http://none/")
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, " -//P//EN ").alias("public"), system.alias("system"), null.alias("uri"))
    return catalogs.resolve_identifiers(ids, catalogs.rules(spark, entries)).select("id", "target")


@query(_ROWS + "SELECT doc_id, string_agg(part, ',' ORDER BY pos) AS parts FROM l WHERE flag <> 'N' GROUP BY doc_id")
def tree_removal(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    kept = trees.remove(nodes, (F.col("local") == "line") & F.exists("attrs", lambda a: (a["local"] == "flag") & (a["value"] == "N")))
    lines = select(kept, "/order/line/@part")
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), ",").alias("parts"))


@query(_ROWS + "SELECT doc_id, n::INTEGER AS n, part::BIGINT AS part, CASE WHEN qty <= 127 THEN qty END::TINYINT AS qty, price::DOUBLE AS price, flag, cust::BIGINT AS cust FROM l")
def typed_projection(spark, sf_dir):
    columns = {"n": ("@n", "int"), "part": ("@part", "long"), "qty": ("@qty", "byte"), "price": ("@price", "double"), "flag": ("@flag", "string"), "cust": ("../@cust", "long")}
    return projection.project(orders(spark, sf_dir), "/order/line", columns).drop("pre")
