"""Queries over documents that are composed of the supplied rows, one for each language feature, with SQL on those rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeframe import api
from treeframe.functions import datatypes as D
from treeframe.functions import encodings, uri
from treeframe.operators import catalogs, emit, schematron, trees, validation, xpointer, xsd
from treeframe.plans import relaxng, relaxng_compact, xslt
from treeframe.queries import _ROWS, LEAN, QUERIES, SQL, order_xml, orders, query, table
from treeframe.sources import shred, store
from treeframe.sources.xml import Limits
from treeframe.xpath import evaluate, select

FULL = ["pre", "last", "parent", "sib", "level", "kind", "prefix", "local", "ns", "value", "sval", "attrs", "nsmap", "nsown", "anc", "path", "lang", "line", "col"]


def composed(spark, sf_dir: str, name: str, key: str, xml: Column) -> DataFrame:
    """doc_id, xml: a document for each row of a table."""
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("doc_id"), xml.alias("xml"))


def read(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    return store.stored(shred.read_xml(docs, columns=columns, **options))


def text(*parts: str | Column) -> Column:
    """Strings and columns joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def variant(key: str, *cases: str | Column) -> Column:
    """The case of each row: its key modulo the number of cases."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(cases):
        out = F.when(F.col(key) % len(cases) == i, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


# XPath

_T = "round(o_totalprice * 100)::BIGINT::VARCHAR"
_HALF = "(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey // 2)::VARCHAR ELSE (o_orderkey // 2)::VARCHAR || '.5' END)"
_STRINGS = {
    "string(starts-with(/order/@total, '1'))": f"(CASE WHEN {_T} LIKE '1%' THEN 'true' ELSE 'false' END)",
    "string(contains(/order/@total, '55'))": f"(CASE WHEN contains({_T}, '55') THEN 'true' ELSE 'false' END)",
    "substring-before(/order/@total, '5')": f"(CASE WHEN contains({_T}, '5') THEN substr({_T}, 1, instr({_T}, '5') - 1) ELSE '' END)",
    "substring-after(/order/@total, '5')": f"(CASE WHEN contains({_T}, '5') THEN substr({_T}, instr({_T}, '5') + 1) ELSE '' END)",
    "substring(/order/@total, 2, 3)": f"substr({_T}, 2, 3)",
    "substring(/order/@total, 3)": f"substr({_T}, 3)",
    "string(string-length(/order/@total))": f"length({_T})::VARCHAR",
    "normalize-space(concat('  a ', /order/@status, '  '))": "'a ' || o_orderstatus",
    "translate(/order/@status, 'FOP', 'xy')": "(CASE o_orderstatus WHEN 'F' THEN 'x' WHEN 'O' THEN 'y' WHEN 'P' THEN '' ELSE o_orderstatus END)",
    "local-name(/order)": "'order'",
    "name(/order/@key)": "'key'",
    "namespace-uri(/order)": "''",
    "string(/order/@key)": "o_orderkey::VARCHAR",
    "exsl:object-type(/order/@key)": "'node-set'",
}
_NUMBERS = {
    "/order/@key + 1": "(o_orderkey + 1)::VARCHAR",
    "/order/@key - 7": "(o_orderkey - 7)::VARCHAR",
    "-(/order/@key)": "(-o_orderkey)::VARCHAR",
    "/order/@key * 3": "(o_orderkey * 3)::VARCHAR",
    "/order/@key mod 7": "(o_orderkey % 7)::VARCHAR",
    "/order/@key div 2": _HALF,
    "floor(/order/@key div 2)": "(o_orderkey // 2)::VARCHAR",
    "ceiling(/order/@key div 2)": "((o_orderkey + 1) // 2)::VARCHAR",
    "round(/order/@key div 2)": "((o_orderkey + 1) // 2)::VARCHAR",
    "number(/order/@key)": "o_orderkey::VARCHAR",
    "math:abs(-(/order/@key))": "o_orderkey::VARCHAR",
    "math:sqrt(/order/@key * /order/@key)": "o_orderkey::VARCHAR",
    "number('x')": "'NaN'",
    "1 div 0": "'Infinity'",
}
_BOOLEANS = {
    "boolean(/order/line)": "(o_orderkey IN (SELECT l_orderkey FROM lineitem))",
    "true() and not(false())": "true",
    "/order/@key = /order/@cust": "(o_orderkey = o_custkey)",
    "/order/@key != /order/@cust": "(o_orderkey <> o_custkey)",
    "/order/@key < /order/@cust": "(o_orderkey < o_custkey)",
    "/order/@key >= 100": "(o_orderkey >= 100)",
    "'a' = 'a' or 1 = 2": "true",
    "$q > /order/@key": "(50 > o_orderkey)",
    "/order/@status = $s": "(o_orderstatus = 'F')",
    "set:has-same-node(/order/line[1], /order/line)": "(o_orderkey IN (SELECT l_orderkey FROM lineitem))",
}


def _joined(parts: list[str]) -> str:
    return "concat(" + ", '|', ".join(parts) + ")"


@query("SELECT o_orderkey AS doc_id, " + " || '|' || ".join(_STRINGS.values()) + " AS value FROM orders")
def xpath_string_functions(spark, sf_dir):
    return evaluate(orders(spark, sf_dir), _joined(list(_STRINGS)))


@query("SELECT o_orderkey AS doc_id, " + " || '|' || ".join(_NUMBERS.values()) + " AS value FROM orders")
def xpath_arithmetic(spark, sf_dir):
    return evaluate(orders(spark, sf_dir), _joined([f"string({x})" for x in _NUMBERS]))


@query("SELECT o_orderkey AS doc_id, " + " || '|' || ".join(f"{v}::VARCHAR" for v in _BOOLEANS.values()) + " AS value FROM orders")
def xpath_comparisons(spark, sf_dir):
    return evaluate(orders(spark, sf_dir), _joined([f"string({x})" for x in _BOOLEANS]), variables={"q": 50, "s": "F"})


def _places(found: DataFrame, name: str) -> DataFrame:
    """Lines by their place: the elements are numbered from 2, after the document and the order."""
    return found.select("doc_id", F.lit(name).alias("what"), (F.col("pre") - 1).cast("double").alias("place"))


@query(
    _ROWS
    + """, m AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM l WHERE n = 2 GROUP BY doc_id)
SELECT l.doc_id, 'following' AS what, pos::DOUBLE AS place FROM l JOIN m USING (doc_id) WHERE pos > a UNION ALL SELECT l.doc_id, 'preceding', pos::DOUBLE FROM l JOIN m USING (doc_id) WHERE pos < b
UNION ALL SELECT doc_id, 'self', pos::DOUBLE FROM l WHERE qty > 48 UNION ALL SELECT DISTINCT doc_id, 'parent', 0::DOUBLE FROM l WHERE qty > 48 UNION ALL SELECT DISTINCT doc_id, 'ancestor-or-self', 0::DOUBLE FROM l WHERE qty > 48
UNION ALL SELECT doc_id, 'ancestor-or-self', pos::DOUBLE FROM l WHERE qty > 48 UNION ALL SELECT doc_id, 'descendant-or-self', pos::DOUBLE FROM l WHERE flag = 'R' UNION ALL SELECT doc_id, 'preceding-sibling', pos::DOUBLE FROM l JOIN m USING (doc_id) WHERE pos < b AND NOT n = 2
UNION ALL SELECT doc_id, 'filter', 2::DOUBLE FROM l WHERE pos = 2 UNION ALL SELECT doc_id, 'filter-last', pos::DOUBLE FROM l WHERE pos = size UNION ALL SELECT doc_id, 'lowest', pos::DOUBLE FROM (SELECT *, min(qty) OVER (PARTITION BY doc_id) AS low FROM l) WHERE qty = low
UNION ALL SELECT doc_id, 'leading', pos::DOUBLE FROM l WHERE pos < 3 AND size >= 3 OR size < 3 UNION ALL SELECT doc_id, 'trailing', pos::DOUBLE FROM l WHERE pos > 3 OR size < 3"""
)
def xpath_axes(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    paths = {
        "following": "//line[@n=2]/following::line",
        "preceding": "//line[@n=2]/preceding::line",
        "self": "//line/self::line[@qty > 48]",
        "parent": "//line[@qty > 48]/parent::order",
        "ancestor-or-self": "//line[@qty > 48]/ancestor-or-self::*",
        "descendant-or-self": "/order/descendant-or-self::*[@flag='R']",
        "preceding-sibling": "//line[@n=2]/preceding-sibling::line[not(@n=2)]",
        "filter": "(//line)[2]",
        "filter-last": "(//line)[last()]",
        "lowest": "math:lowest(/order/line/@qty)",
        "leading": "set:leading(/order/line, /order/line[3])",
        "trailing": "set:trailing(/order/line, /order/line[3])",
    }
    out = None
    for name, path in paths.items():
        one = _places(select(nodes, path), name)
        out = one if out is None else out.unionByName(one)
    return out


def _spaced(key: str) -> Column:
    return text('<n:nation xmlns:n="urn:n" xmlns:r="urn:r', F.col("n_regionkey"), '" xml:lang="en-GB"><!--c', F.col(key), "--><?t d", F.col(key), "?>text ", F.col(key), "<![CDATA[<&]]><r:x r:y='1' id='k", F.col(key), "'/><n:x ref='k", F.col(key), "'>de</n:x></n:nation>")


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
SELECT k::BIGINT AS doc_id, 'namespace' AS what, 'urn:r' || r AS value FROM n UNION ALL SELECT k, 'bound name', '' FROM n WHERE r = 1 UNION ALL SELECT k, 'prefix any', 'de' FROM n UNION ALL SELECT k, 'prefix name', '' FROM n
UNION ALL SELECT k, 'any', '' FROM n UNION ALL SELECT k, 'any', 'de' FROM n UNION ALL SELECT k, 'text', 'text ' || k FROM n UNION ALL SELECT k, 'text', '<&' FROM n UNION ALL SELECT k, 'text', 'de' FROM n UNION ALL SELECT k, 'comment', 'c' || k FROM n
UNION ALL SELECT k, 'pi', 'd' || k FROM n UNION ALL SELECT k, 'node', v FROM n, (SELECT unnest(['c' || k, 'd' || k, 'text ' || k, '<&', '', 'de']) AS v) UNION ALL SELECT k, 'lang', '' FROM n UNION ALL SELECT k, 'id', '' FROM n UNION ALL SELECT k, 'attribute any', '1' FROM n UNION ALL SELECT k, 'unprefixed', 'k' || k FROM n""")
def xpath_node_tests(spark, sf_dir):
    nodes = read(composed(spark, sf_dir, "nation", "n_nationkey", _spaced("n_nationkey")), FULL)
    paths = {"namespace": ("/*/namespace::r", None), "bound name": ("/a:nation/b:x", {"a": "urn:n", "b": "urn:r1"}), "prefix any": ("/n:nation/n:*", None), "prefix name": ("//r:x", None), "any": ("/*/*", None), "text": ("//text()", None), "comment": ("//comment()", None), "pi": ("/*/processing-instruction('t')", None), "node": ("/*/node()", None), "lang": ("//r:x[lang('en')]", None), "id": ("id(//@ref)", None), "attribute any": ("//r:x/@r:*", None), "unprefixed": ("//n:x/@ref", None)}
    out = None
    for name, (path, bound) in paths.items():
        one = select(nodes, path, namespaces=bound)
        one = one.select("doc_id", F.lit(name).alias("what"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    _ROWS
    + """SELECT doc_id, 'shorthand' AS what, part::VARCHAR AS value FROM l WHERE pos = 1 UNION ALL SELECT doc_id, 'element', part::VARCHAR FROM l WHERE pos = 2 UNION ALL SELECT doc_id, 'xpath1', flag FROM l WHERE pos = size
UNION ALL SELECT doc_id, 'range', part::VARCHAR FROM l WHERE flag = 'R' UNION ALL SELECT doc_id, 'range-to', part::VARCHAR FROM l WHERE pos BETWEEN 2 AND 4 AND size >= 4 UNION ALL SELECT doc_id, 'string-range', '1' FROM l WHERE part::VARCHAR LIKE '1%'"""
)
def xpointer_schemes(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    part = select(nodes, "/order/line/@part").select("doc_id", "pre", F.col("value").alias("part"))
    flag = select(nodes, "/order/line/@flag").select("doc_id", "pre", F.col("value").alias("flag"))
    marked = trees.set_attribute(nodes, (F.col("local") == "line") & (F.col("sib") == 0), "id", F.lit("first"))
    of = lambda found, values, c: found.select("doc_id", "pre").join(values, ["doc_id", "pre"]).select("doc_id", F.col(c).alias("value"))
    got = {
        "shorthand": of(xpointer.resolve(marked, "first"), part, "part"),
        "element": of(xpointer.resolve(nodes, "element(/1/2)"), part, "part"),
        "xpath1": of(xpointer.resolve(nodes, "xpath1(/order/line[last()])"), flag, "flag"),
        "range": of(xpointer.resolve(nodes, "xpointer(range(//line[@flag='R']))"), part, "part"),
        "range-to": of(xpointer.resolve(nodes, "xpointer(/order/line[2]/range-to(/order/line[4]))"), part, "part"),
        "string-range": xpointer.resolve(nodes, "xpointer(string-range(//line/@part,'1'))").where("name = '1'").select("doc_id", "value"),
    }
    out = None
    for name, one in got.items():
        one = one.select("doc_id", F.lit(name).alias("what"), "value")
        out = one if out is None else out.unionByName(one)
    return out


# reading and writing


@query("""SELECT c_custkey::BIGINT AS doc_id, '1.0' AS version, CASE WHEN c_custkey % 3 < 2 THEN 'utf-8' END AS encoding, CASE WHEN c_custkey % 3 = 1 THEN 'yes' END AS standalone, 'x' || chr(10) || 'y <a&' || chr(233) || c_custkey AS value, 'p q  r' AS attribute FROM customer WHERE c_custkey % 3 < 2
UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'x' || chr(10) || 'y <a&' || chr(233) || c_custkey, 'p q  r' FROM customer WHERE c_custkey % 3 = 2""")
def read_text_rules(spark, sf_dir):
    """Declarations, line ends, references and entities, attribute normalization."""
    head = variant("c_custkey", '<?xml version="1.0" encoding="utf-8"?>', '<?xml version="1.0" encoding="utf-8" standalone="yes"?>', "")
    body = text(head, '<!DOCTYPE d [<!ENTITY e "<![CDATA[x]]>"><!ENTITY f "&#233;">]>\r\n<d a="p\tq\n\r\nr">x\r\ny &lt;a&amp;&f;', F.col("c_custkey"), "</d>")
    docs = composed(spark, sf_dir, "customer", "c_custkey", body)
    nodes = read(docs, LEAN, limits=Limits(allow_doctype=True))
    value = evaluate(nodes, "string(/d)").select("doc_id", "value")
    attribute = evaluate(nodes, "string(/d/@a)").select("doc_id", F.replace("value", F.lit("  "), F.lit("  ")).alias("attribute"))
    return api.text_declaration(docs).join(value, "doc_id").join(attribute, "doc_id")


_FAULTY = ["<a><b></a>", "<a>&none;</a>", "<a/><b/>", "<a x='1' x='2'/>", "<p:a/>", "<a>]]></a>", "<!-- -- --><a/>", "<a>&#0;</a>", "text<a/>", "<!DOCTYPE a><a/>", "<a><?xml x?></a>", "<a y=\"<\"/>"]
_CODES = ["unclosedElement", "undefinedEntity", "multipleRoots", "duplicateAttribute", "unboundPrefix", "cdataEndInText", "doubleHyphenInComment", "invalidCharacterReference", "contentOutsideRoot", "doctypeForbidden", "reservedTarget", "lessThanInAttribute"]


@query(f"SELECT p_partkey::BIGINT AS doc_id, list_extract({_CODES}, (p_partkey % {len(_CODES)} + 1)::INTEGER) AS code FROM part")
def read_fault_codes(spark, sf_dir):
    return shred.faults(composed(spark, sf_dir, "part", "p_partkey", variant("p_partkey", *_FAULTY))).select("doc_id", "code")


@query("SELECT p_partkey::BIGINT AS doc_id, list_extract(['depthLimit', 'recursiveEntity', 'entityExpansionLimit', 'nameLimit'], (p_partkey % 4 + 1)::INTEGER) AS code FROM part")
def read_limits(spark, sf_dir):
    laugh = '<!DOCTYPE a [<!ENTITY a "xxxxxxxxxx"><!ENTITY b "&a;&a;&a;&a;&a;&a;&a;&a;"><!ENTITY c "&b;&b;&b;&b;&b;&b;&b;&b;">]><a>&c;&c;</a>'
    docs = composed(spark, sf_dir, "part", "p_partkey", variant("p_partkey", "<a>" * 12 + "</a>" * 12, '<!DOCTYPE a [<!ENTITY a "&b;"><!ENTITY b "&a;">]><a>&a;</a>', laugh, f"<{'n' * 40}/>"))
    return shred.faults(docs, limits=Limits(max_depth=8, max_name=30, max_expansion=500, allow_doctype=True)).select("doc_id", "code").distinct()


@query("SELECT p_partkey::BIGINT AS doc_id, (p_partkey % 3 = 0) AS kept, '<a><b>' || p_partkey || '</b></a>' AS text FROM part")
def read_permissive(spark, sf_dir):
    """Faulty documents are mended, or with mode=drop left out."""
    docs = composed(spark, sf_dir, "part", "p_partkey", variant("p_partkey", text("<a><b>", F.col("p_partkey"), "</b></a>"), text("<a><b>", F.col("p_partkey"), "</a>"), text("<a><b>", F.col("p_partkey"))))
    mended = emit.serialize(shred.read_xml(docs, mode="permissive"))
    kept = shred.read_xml(docs, mode="drop").select("doc_id").distinct().withColumn("kept", F.lit(True))
    return mended.join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"), "text")


_CHARS = "chr(228) || chr(246) || c_custkey"


@query(f"SELECT c_custkey::BIGINT AS doc_id, {_CHARS} AS latin1, {_CHARS} AS utf16, {_CHARS} AS utf32, chr(26085) || chr(26412) || c_custkey AS gbk, chr(1103) || c_custkey AS koi8, {_CHARS} AS declared FROM customer")
def encodings_round_trip(spark, sf_dir):
    """Bytes that are written in an encoding and read by its name, its mark or its declaration."""
    key = F.col("c_custkey").cast("string")
    latin, gbk, koi = F.concat(F.lit("äö"), key), F.concat(F.lit("日本"), key), F.concat(F.lit("я"), key)
    back = lambda t, e: encodings.decode(encodings.encode(t, e), e)
    declared = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><a>'), latin, F.lit("</a>"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), back(latin, "ISO-8859-1").alias("latin1"), encodings.decode_detected(F.concat(F.lit(b"\xff\xfe"), F.encode(latin, "UTF-16LE"))).alias("utf16"), encodings.decode_detected(F.concat(F.lit(b"\x00\x00\xfe\xff"), encodings.encode(latin, "UTF-32BE"))).alias("utf32"), back(gbk, "GBK").alias("gbk"), back(koi, "KOI8-R").alias("koi8"), encodings.decode_detected(encodings.encode(declared, "ISO-8859-1")).alias("declared"))
    return rows.withColumn("declared", F.regexp_extract("declared", "<a>(.*)</a>", 1))


@query("""SELECT n_nationkey::BIGINT AS doc_id, '<n:nation xmlns:n="urn:n" xml:lang="en-GB"><?t d' || n_nationkey || '?>text ' || n_nationkey || '&lt;&amp;<r:x xmlns:r="urn:r' || n_regionkey || '" id="k' || n_nationkey || '" r:y="1"></r:x><n:x ref="k' || n_nationkey || '">de</n:x></n:nation>' AS exclusive,
 '<n:nation xmlns:n="urn:n" xmlns:r="urn:r' || n_regionkey || '" xml:lang="en-GB"><!--c' || n_nationkey || '--><?t d' || n_nationkey || '?>text ' || n_nationkey || '&lt;&amp;<r:x id="k' || n_nationkey || '" r:y="1"></r:x><n:x ref="k' || n_nationkey || '">de</n:x></n:nation>' AS commented FROM nation""")
def canonical_forms(spark, sf_dir):
    nodes = read(composed(spark, sf_dir, "nation", "n_nationkey", _spaced("n_nationkey")), FULL)
    return emit.canonical(nodes, exclusive=True).withColumnRenamed("text", "exclusive").join(emit.canonical(nodes, comments=True).withColumnRenamed("text", "commented"), "doc_id")


@query("SELECT p_partkey::BIGINT AS doc_id, '<ul><li class=\"a&quot;b\">one &amp; ' || p_partkey || '<br></li><li>two</li></ul><p>x</p>' AS text FROM part")
def html_fragments(spark, sf_dir):
    """Fragments with implied end tags, read and written as HTML."""
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), text("<ul><li class='a\"b'>one &amp; ", F.col("p_partkey"), "<br><li>two</ul><p>x").alias("html"))
    return emit.serialize_html(shred.read_html(docs, document=False))


@query("""SELECT p_partkey::BIGINT AS doc_id, '<html><head></head><body>' || CASE p_partkey % 6
 WHEN 0 THEN '<p>1<b>2<i>' || p_partkey || '</i></b><i>4</i>5</p>'
 WHEN 1 THEN '<b>1</b><p><b>' || p_partkey || '</b>3</p>'
 WHEN 2 THEN '<p><b>x</b></p><b>' || p_partkey || '</b>'
 WHEN 3 THEN p_partkey || '<table><tr><td>y</td></tr></table>z'
 WHEN 4 THEN '<a href="1">' || p_partkey || '</a><a href="2">y</a>z'
 ELSE '<svg viewBox="0"><linearGradient></linearGradient>' || p_partkey || '</svg>' END || '</body></html>' AS text FROM part""")
def html_repair(spark, sf_dir):
    """Overlapping formatting, an unclosed element, stray content of a table, nested links and foreign names, read as the HTML Standard says."""
    k = F.col("p_partkey")
    cases = (text("<p>1<b>2<i>", k, "</b>4</i>5</p>"), text("<b>1<p>", k, "</b>3</p>"), text("<p><b>x</p>", k), text("<table><tr>", k, "<td>y</table>z"), text("<a href=1>", k, "<a href=2>y</a>z"), text("<svg viewbox=0><lineargradient/>", k, "</svg>"))
    docs = table(spark, sf_dir, "part").select(k.cast("long").alias("doc_id"), variant("p_partkey", *cases).alias("html"))
    return emit.serialize_html(shred.read_html(docs, repair=True))


@query("""SELECT p_partkey::BIGINT AS page_id, list_extract(['html-unique-id', 'html-required-parent', 'html-required-parent'], (p_partkey % 4)::INTEGER) AS rule, list_extract([2, 1, 1], (p_partkey % 4)::INTEGER)::BIGINT AS n FROM part WHERE p_partkey % 4 > 0""")
def html_faults(spark, sf_dir):
    """Planted faults: an id three times, an item outside of a list, a cell outside of a row."""
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), variant("p_partkey", "<ul><li id=a>x</ul>", "<p id=a>x<p id=a>y<p id=a>z", "<div><li>x</div>", "<dd>x</dd>").alias("html"))
    found = validation.validate(store.stored(shred.read_html(docs)), ["html-void-empty", "html-required-parent", "html-unique-id", "unique-attributes"])
    return found.groupBy(F.col("doc_id").alias("page_id"), "rule").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, '/a/b/' || (o_orderkey % 5) || CASE WHEN o_orderkey % 2 = 0 THEN '?q=' || o_orderkey ELSE '' END AS path FROM orders")
def uri_references(spark, sf_dir):
    reference = F.concat(F.lit("../c/.././"), (F.col("o_orderkey") % 5).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("?q="), F.col("o_orderkey").cast("string"))).otherwise(""))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), uri.resolve_column(F.lit("http://h/a/b/c/d;p?q"), reference).alias("u"))
    return rows.select("doc_id", F.replace("u", F.lit("http://h"), F.lit("")).alias("path"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'http://local/x.dtd' WHEN p_partkey % 3 = 1 THEN 'http://local/r' END AS target FROM part UNION ALL SELECT NULL, 'http://local/r' FROM range(3)")
def sgml_catalog(spark, sf_dir):
    """Rows with repeated and null ids all come back."""
    entries = catalogs.parse_sgml('PUBLIC "-//X" "x.dtd" -- c -- OVERRIDE YES SYSTEM "q" "r"', "http://local/")
    k, null = F.col("p_partkey") % 3, F.lit(None).cast("string")
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "-//X").alias("public"), F.when(k == 1, "q").when(k == 2, "z").alias("system"), null.alias("uri"))
    odd = spark.range(3).select(F.lit(None).cast(ids.schema["id"].dataType).alias("id"), null.alias("public"), F.lit("q").alias("system"), null.alias("uri"))
    return catalogs.resolve_identifiers(ids.unionByName(odd), catalogs.rules(spark, entries)).select("id", "target")


# trees


@query(_ROWS + ", f AS (SELECT doc_id, min(pos) AS a, max(pos) AS b, count(*) AS n FROM l GROUP BY doc_id) SELECT doc_id, (a + 1)::BIGINT AS first, (b + 1)::BIGINT AS last, n::BIGINT AS children, n::BIGINT AS below FROM f")
def tree_navigation(spark, sf_dir):
    nodes = orders(spark, sf_dir)
    at = lambda f, name: f(nodes).where("pre = 1").select("doc_id", F.col("child").cast("long").alias(name))
    children = trees.element_children(nodes).where("pre = 1").groupBy("doc_id").agg(F.count("*").alias("children"))
    below = trees.ancestors(nodes).where("ancestor = 1").groupBy("doc_id").agg(F.count("*").alias("below"))
    return at(trees.first_child, "first").join(at(trees.last_child, "last"), "doc_id").join(children, "doc_id").join(below, "doc_id")


@query(_ROWS + "SELECT doc_id, pos::BIGINT AS place, (CASE WHEN pos > 1 THEN pos END)::BIGINT AS previous, (CASE WHEN pos < size THEN pos + 2 END)::BIGINT AS next FROM l")
def tree_siblings(spark, sf_dir):
    long = lambda c: F.col(c).cast("long").alias(c)
    return trees.siblings(orders(spark, sf_dir)).where("pre > 1").select("doc_id", (F.col("pre") - 1).cast("long").alias("place"), long("previous"), long("next"))


@query("SELECT n_nationkey::BIGINT AS doc_id, '<a k=\"' || n_name || '\"><b>new</b><c x=\"1\">y</c></a>' AS text FROM nation")
def tree_edits(spark, sf_dir):
    """Attributes set and removed, text replaced, an element appended."""
    nodes = read(composed(spark, sf_dir, "nation", "n_nationkey", text("<a k='", F.col("n_name"), "' gone='1'><b>old</b></a>")), None)
    nodes = trees.remove_attribute(nodes, F.col("local") == "a", "gone")
    nodes = trees.replace_text(nodes, F.col("value") == "old", F.lit("new"))
    nodes = trees.append(nodes, F.col("local") == "a", "<c>y</c>")
    nodes = trees.set_attribute(nodes, F.col("local") == "c", "x", F.lit("1"))
    return emit.serialize(nodes)


# validation


@query("""SELECT p_partkey::BIGINT AS doc_id, list_extract(['dtd-fixed-attribute', 'dtd-enumeration', 'dtd-token', 'dtd-id-unique', 'dtd-idref', 'dtd-content', 'dtd-text', 'dtd-undeclared-attribute'], (p_partkey % 9)::INTEGER) AS rule FROM part WHERE p_partkey % 9 > 0""")
def dtd_attribute_rules(spark, sf_dir):
    dtd = validation.DTD("""<!ENTITY % more "(b?, c*)"><!ELEMENT a %more;><!ELEMENT b EMPTY><!ELEMENT c EMPTY><![IGNORE[<!ELEMENT d EMPTY>]]>
<!ATTLIST a v CDATA #FIXED "1" e (x|y) "x" t NMTOKEN #IMPLIED i ID #IMPLIED r IDREF #IMPLIED><!ATTLIST b i ID #IMPLIED>""")
    docs = composed(spark, sf_dir, "part", "p_partkey", variant("p_partkey", "<a v='1' e='y' t='n.1' i='k' r='k'><b/><c/><c/></a>", "<a v='2'/>", "<a e='z'/>", "<a t='a b'/>", "<a i='k'><b i='k'/></a>", "<a r='none'/>", "<a><c/><b/></a>", "<a>text</a>", "<a w='1'/>"))
    return dtd.validate(read(docs, FULL)).select("doc_id", "rule")


@query("SELECT r_regionkey::BIGINT AS doc_id, rule FROM region, (SELECT unnest(['dtd-content', 'xsd-content']) AS rule) WHERE r_regionkey % 2 = 1")
def content_of_many(spark, sf_dir):
    """Elements with 100,000 children; the last child is wrong in odd regions."""
    body = F.concat(F.lit("<a>"), F.repeat(F.lit("<b/><c/>"), 50_000), F.when(F.col("r_regionkey") % 2 == 1, "<c/>").otherwise(""), F.lit("</a>"))
    nodes = read(composed(spark, sf_dir, "region", "r_regionkey", body), FULL)
    schema = xsd.Schema('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a"><xs:complexType><xs:sequence minOccurs="0" maxOccurs="unbounded"><xs:element name="b"/><xs:element name="c"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    found = validation.DTD("<!ELEMENT a (b, c)*><!ELEMENT b EMPTY><!ELEMENT c EMPTY>").validate(nodes)
    return found.select("doc_id", "rule").unionByName(schema.validate(nodes).select("doc_id", "rule"))


_SHAPES = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:include schemaLocation="types"/><xs:import schemaLocation="none" namespace="urn:none"/>
<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="s" type="Shape" nillable="true" minOccurs="0"/><xs:element ref="head" minOccurs="0"/><xs:element name="o" minOccurs="0"><xs:complexType><xs:all><xs:element name="x"/><xs:element name="y" minOccurs="0"/></xs:all></xs:complexType></xs:element>
<xs:element name="w" minOccurs="0"><xs:complexType><xs:sequence><xs:any processContents="skip" minOccurs="2" maxOccurs="unbounded"/></xs:sequence><xs:anyAttribute/></xs:complexType></xs:element><xs:element name="k" type="Key" minOccurs="0" maxOccurs="unbounded"/><xs:element name="i" type="Id" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>
<xs:unique name="u"><xs:selector xpath="k"/><xs:field xpath="@n"/></xs:unique></xs:element>
<xs:element name="head" type="xs:string" abstract="true"/><xs:element name="tail" substitutionGroup="head" type="xs:int"/></xs:schema>"""
_TYPES = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Shape"><xs:sequence><xs:element name="n" type="xs:int"/></xs:sequence></xs:complexType>
<xs:complexType name="Disc"><xs:complexContent><xs:extension base="Shape"><xs:sequence><xs:element name="radius" type="xs:decimal"/></xs:sequence><xs:attribute name="unit" type="xs:string"/></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="Other"><xs:sequence/></xs:complexType><xs:complexType name="Key"><xs:attribute name="n" type="xs:int"/></xs:complexType><xs:complexType name="Id"><xs:attribute name="id" type="xs:ID"/><xs:attribute name="ref" type="xs:IDREF"/></xs:complexType></xs:schema>"""
_X = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
_SHAPE_CASES = [  # document, the rule that it breaks
    (f"<r {_X}><s xsi:type='Disc' unit='m'><n>1</n><radius>2.5</radius></s></r>", None),
    (f"<r {_X}><s xsi:type='Disc'><n>1</n></s></r>", "xsd-content"),
    (f"<r {_X}><s xsi:type='Disc'><n>1</n><radius>x</radius></s></r>", "xsd-value"),
    (f"<r {_X}><s xsi:type='Other'/></r>", "xsd-type"),
    (f"<r {_X}><s xsi:nil='true'/></r>", None),
    (f"<r {_X}><s xsi:nil='true'><n>1</n></s></r>", "xsd-nil"),
    (f"<r {_X}><o xsi:nil='true'><x/></o></r>", "xsd-nil"),
    ("<r><tail>7</tail></r>", None),
    ("<r><tail>x</tail></r>", "xsd-value"),
    ("<r><head>x</head></r>", "xsd-content"),
    ("<r><o><y/><x/></o></r>", None),
    ("<r><o><y/></o></r>", "xsd-content"),
    ("<r><o><x/><x/></o></r>", "xsd-content"),
    ("<r><w q='1'><p/><q><z/></q></w></r>", None),
    ("<r><w><p/></w></r>", "xsd-content"),
    ("<r><k n='1'/><k n='2'/></r>", None),
    ("<r><k n='1'/><k n='01'/></r>", "xsd-unique"),
    ("<r><i id='a'/><i ref='a'/></r>", None),
    ("<r><i id='a'/><i id='a'/></r>", "xsd-id"),
    ("<r><i ref='b'/></r>", "xsd-idref"),
]


@query("SELECT p_partkey::BIGINT AS doc_id, rule FROM (SELECT p_partkey, list_extract([" + ", ".join(f"'{r}'" if r else "NULL" for _, r in _SHAPE_CASES) + f"], (p_partkey % {len(_SHAPE_CASES)} + 1)::INTEGER) AS rule FROM part) WHERE rule IS NOT NULL")
def xsd_structures(spark, sf_dir):
    """xsi:type, xsi:nil, substitution, all groups, wildcards, typed identity, ID and IDREF, include."""
    schema = xsd.Schema(_SHAPES, load=lambda u: _TYPES if u == "types" else None)
    docs = composed(spark, sf_dir, "part", "p_partkey", variant("p_partkey", *(d for d, _ in _SHAPE_CASES)))
    return schema.validate(read(docs, FULL)).select("doc_id", "rule")


_LIST = D.SimpleType(item=D.SimpleType("int"), facets=(("maxLength", "3"),))
_UNION = D.SimpleType(members=(D.SimpleType("int"), D.SimpleType("string", (("enumeration", ("none", "all")),))))


@query("""SELECT o_orderkey AS doc_id, (o_orderkey % 4 < 3) AS list, (o_orderkey % 3 < 2) AS union_, (o_orderdate::DATE >= DATE '1995-01-01') AS since, (length(o_orderkey::VARCHAR) BETWEEN 2 AND 3) AS lengths, (o_orderkey % 10 IN (1, 5)) AS pattern, true AS collapsed, (o_orderstatus IN ('F', 'O')) AS enumerated FROM orders""")
def datatype_kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    values = F.array_join(F.slice(F.array(F.lit("1"), F.lit("22"), F.lit("-3"), F.lit("4")), F.lit(1), (k % 4 + 1).cast("int")), " ")
    either = F.when(k % 3 == 0, "all").when(k % 3 == 1, "17").otherwise("some")
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    key = k.cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"),
        D.is_valid(values, _LIST).alias("list"),
        D.is_valid(either, _UNION).alias("union_"),
        D.is_valid(day, D.SimpleType("date", (("minInclusive", "1995-01-01"),))).alias("since"),
        D.is_valid(key, D.SimpleType("string", (("minLength", "2"), ("maxLength", "3")))).alias("lengths"),
        D.is_valid(key, D.SimpleType("string", (("pattern", (r"\d*[15]",)),))).alias("pattern"),
        D.is_valid(F.concat(F.lit("  "), key, F.lit(" \n")), D.SimpleType("int")).alias("collapsed"),
        D.is_valid(F.col("o_orderstatus"), D.SimpleType("string", (("enumeration", ("F", "O")),))).alias("enumerated"),
    )


@query(_ROWS + "SELECT doc_id, 'low ' || qty || ' of 10 in line' AS reason, CASE WHEN status = 'F' THEN 'error' ELSE 'warning' END AS severity FROM l WHERE qty < 10")
def schematron_messages(spark, sf_dir):
    """Lets, values and names in messages, and a phase that leaves a pattern out."""
    rules = schematron.Schematron("""<schema xmlns="http://purl.oclc.org/dsdl/schematron"><let name="low" value="10"/><phase id="main"><active pattern="p"/></phase><pattern id="p">
 <rule context="order[@status='F']/line"><let name="q" value="@qty"/><assert test="$q &gt;= $low">low <value-of select="$q"/> of <value-of select="$low"/> in <name/></assert></rule>
 <rule context="line"><report test="@qty &lt; $low">low <value-of select="@qty"/> of 10 in <name/></report></rule></pattern><pattern id="q"><rule context="line"><assert test="false()">never</assert></rule></pattern></schema>""")
    return rules.validate(orders(spark, sf_dir), phase="main").select("doc_id", "reason", "severity")


@query(_ROWS + "SELECT o_orderkey AS doc_id, count(n) BETWEEN 1 AND 4 AND coalesce(bool_and(flag IN ('A', 'R')), true) AS valid FROM orders LEFT JOIN l ON o_orderkey = doc_id GROUP BY o_orderkey")
def relaxng_compact_verdicts(spark, sf_dir):
    grammar = relaxng_compact.to_xml("""start = order
order = element order { attribute * { text }+, line, line?, (line, line?)? }
line = element line { attribute flag { "A" | "R" } & attribute n { xsd:int } & attribute part { xsd:int } & attribute price { text } & attribute qty { xsd:int { minInclusive = "1" } } }""")
    return relaxng.validate(order_xml(spark, sf_dir), grammar).select("doc_id", "valid")


_BUILD = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:import href="base"/><xsl:output omit-xml-declaration="yes"/><xsl:strip-space elements="*"/><xsl:param name="p" select="'none'"/>
<xsl:variable name="n" select="count(//i)"/><xsl:attribute-set name="s"><xsl:attribute name="n"><xsl:value-of select="$n"/></xsl:attribute></xsl:attribute-set><xsl:decimal-format name="eu" decimal-separator="," grouping-separator="."/>
<xsl:template match="/d"><xsl:element name="out" use-attribute-sets="s"><xsl:attribute name="p"><xsl:value-of select="$p"/></xsl:attribute><xsl:comment>c<xsl:value-of select="@k"/></xsl:comment><xsl:processing-instruction name="t">x</xsl:processing-instruction>
<xsl:call-template name="twice"><xsl:with-param name="v" select="@k"/></xsl:call-template><xsl:apply-templates/><xsl:copy-of select="i[1]"/><m><xsl:value-of select="format-number(@k * 1000.5, '#.##0,0', 'eu')"/></m><xsl:choose><xsl:when test="@k mod 2 = 0">even</xsl:when><xsl:otherwise>odd</xsl:otherwise></xsl:choose><xsl:if test="function-available('count')"><f/></xsl:if></xsl:element></xsl:template>
<xsl:template name="twice"><xsl:param name="v"/><t><xsl:value-of select="concat($v, $v)"/></t></xsl:template>
<xsl:template match="i" priority="2"><l><xsl:number format="a"/><xsl:apply-imports/></l></xsl:template><xsl:template match="@*|node()" mode="id"><xsl:copy><xsl:apply-templates select="@*|node()" mode="id"/></xsl:copy></xsl:template><xsl:template match="g"><xsl:apply-templates select="." mode="id"/></xsl:template></xsl:stylesheet>"""
_BASE = """<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template match="i">[<xsl:apply-templates/>]</xsl:template></xsl:stylesheet>"""


@query("""SELECT p_partkey::BIGINT AS doc_id, '<out n="2" p="given"><!--c' || p_partkey || '--><?t x?><t>' || p_partkey || p_partkey || '</t><l>a[one]</l><l>b[two]</l><g a="1"><h>z</h></g><i>one</i><m>' || CASE WHEN p_partkey = 0 THEN '0,0</m>even<f/></out>' ELSE
 CASE WHEN p_partkey * 1000 + p_partkey // 2 >= 1000000 THEN ((p_partkey * 1000 + p_partkey // 2) // 1000000)::VARCHAR || '.' || lpad(((p_partkey * 1000 + p_partkey // 2) // 1000 % 1000)::VARCHAR, 3, '0') ELSE ((p_partkey * 1000 + p_partkey // 2) // 1000)::VARCHAR END || '.' || lpad(((p_partkey * 1000 + p_partkey // 2) % 1000)::VARCHAR, 3, '0') || ',' || CASE WHEN p_partkey % 2 = 1 THEN '5' ELSE '0' END || '</m>' || CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END || '<f/></out>' END AS output FROM part""")
def xslt_constructs(spark, sf_dir):
    docs = composed(spark, sf_dir, "part", "p_partkey", text("<d k='", F.col("p_partkey"), "'> <i>one</i> <i>two</i> <g a='1'><h>z</h></g></d>"))
    return xslt.transform(docs, _BUILD, params={"p": "given"}, resources={"base": _BASE}).select("doc_id", "output")


__all__ = ["QUERIES", "SQL"]
