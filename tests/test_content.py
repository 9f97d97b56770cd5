"""Content models against regular expressions, and queries over composed documents against SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from treeframe import queries_languages
from treeframe.operators import catalogs, content, validation


def made(rnd, depth=0):
    """A random model and the regular expression of the same language."""
    if depth > 2 or rnd.random() < 0.4:
        x = rnd.choice("abc")
        return content.name(x), x
    parts = [made(rnd, depth + 1) for _ in range(rnd.randrange(1, 4))]
    if rnd.random() < 0.5:
        model, source = content.seq(*(m for m, _ in parts)), "(?:" + "".join(s for _, s in parts) + ")"
    else:
        model, source = content.choice(*(m for m, _ in parts)), "(?:" + "|".join(s for _, s in parts) + ")"
    low, high = rnd.choice([(1, 1), (0, 1), (0, None), (1, None), (2, 3), (0, 2)])
    return content.times(model, low, high), f"{source}{{{low},{'' if high is None else high}}}"


def run(automaton, word):
    state = 0
    for x in word:
        at = automaton["names"].get(x)
        state = -1 if at is None or state < 0 else automaton["next"][state * automaton["width"] + at]
    return state >= 0 and automaton["ok"][state]


def test_automata_accept_what_the_expression_matches():
    rnd = random.Random(1)
    for _ in range(150):
        model, source = made(rnd)
        automaton = content.compiled(model)
        for _ in range(30):
            word = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(7)))
            want = re.fullmatch(source, word) is not None
            assert content.accepts(model, list(word)) == run(automaton, word) == want, (source, word)


def test_models_run_over_rows(spark):
    models = {"many": content.times(content.seq(content.name("a"), content.name("b")), 0, None), "counted": content.times(content.name("a"), 3, 5_000), "any": content.times(content.name(content.OTHER), 2, 2), "all": content.every([("x", 1, 1), ("y", 0, 1)]), "empty": content.EMPTY}
    rows = [("many", ["a", "b"] * 60_000, True), ("many", ["a", "b"] * 60_000 + ["a"], False), ("counted", ["a"] * 5_000, True), ("counted", ["a"] * 5_001, False), ("counted", ["a"] * 2, False), ("any", ["q", "r"], True), ("any", ["q"], False), ("all", ["y", "x"], True), ("all", ["y"], False), ("all", ["x", "x"], False), ("all", ["x", "z"], False), ("empty", [], True), ("empty", ["a"], False), ("none", [], None)]
    df = spark.createDataFrame(rows, "k string, names array<string>, want boolean")
    got = df.select("want", content.valid(F.try_element_at(content.automata(models), F.col("k")), F.col("names")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_declared_models():
    dtd = validation.DTD("")
    assert content.accepts(dtd.model("(a, (b | c)*, d?)"), ["a", "c", "b", "d"]) and not content.accepts(dtd.model("(a, (b | c)*, d?)"), ["a", "d", "b"])
    assert content.accepts(dtd.model("(#PCDATA | a | b)*"), ["b", "a"]) and content.accepts(dtd.model("(#PCDATA)"), []) and not content.accepts(dtd.model("EMPTY"), ["a"])
    assert content.accepts(dtd.model("ANY"), ["a", "q"]) and content.accepts(dtd.model("((a+))"), ["a", "a"])
    with pytest.raises(content.ModelError):
        content.times(content.name("a"), 2, 1)


def test_catalog_rows_with_repeated_and_null_ids_stay(spark):
    entries = catalogs.parse_sgml('SYSTEM "q" "r"', "http://b/")
    ids = spark.createDataFrame([(1, None, "q", None), (1, None, "q", None), (None, None, "z", None), (None, None, "q", None)], "id int, public string, system string, uri string")
    got = catalogs.resolve_identifiers(ids, catalogs.rules(spark, entries)).collect()
    assert sorted((r.id or 0, r.target or "") for r in got) == [(0, ""), (0, "http://b/r"), (1, "http://b/r"), (1, "http://b/r")]


@pytest.mark.parametrize("name", ["xsd_structures", "dtd_attribute_rules", "read_limits", "html_faults", "xslt_constructs", "read_text_rules", "xpath_node_tests"])
def test_language_queries_match_sql(spark, name):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = queries_languages.QUERIES[name](spark, at)
    cols = sorted(df.columns)
    want = con.execute(queries_languages.SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in cols]
    rows = want.fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in rows)
