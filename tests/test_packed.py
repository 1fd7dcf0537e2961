from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from notelake.functions.arrays import sums_before
from notelake.operators import packed

SIGNS = "'+-./_"


def values(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tags string").selectExpr("*", "'x' AS pos", "'y' AS tag")
    out = {}
    for r in sorted(packed.unpack(df, "id", "tags", SIGNS).collect(), key=lambda r: (r.id, r.pos)):
        out.setdefault(r.id, []).append(r.tag)
    return [out.get(i, []) for i in range(len(texts))]


def test_grammar(spark):
    cases = {
        "a, b;c|d": ["a", "b", "c", "d"],
        '"two words",x,,"a ""b"" c"': ["two words", "x", 'a "b" c'],
        '["a \\"b\\"", "c"]': ['a "b"', "c"],
        "['x y', z]": ["x y", "z"],
        "'driver's seat' | team's-picks": ["driver's seat", "team's-picks"],
        "#one #two#three": ["one", "two", "three"],
        "- c++\n- node.js": ["c++", "node.js"],
        '"open, two three': ["open", "two", "three"],
        'a"b"c': ["a", "b", "c"],
        "“x y”; ‘p, q’; `r s`": ["x y", "p, q", "r s"],
        ' "  " , "" ,': [],
        "größe、decisão": ["größe", "decisão"],
        "a, a": ["a", "a"],
        "": [],
        " ;; ": [],
    }
    assert values(spark, list(cases)) == list(cases.values())


def test_long_fields(spark):
    got = values(spark, ["x" * 200_000 + ",b", "-" * 200_000, '"' + "z " * 100_000 + '"', ",".join(["ab"] * 20_000)])
    assert [len(x) for x in got] == [2, 0, 1, 20_000]
    assert len(got[2][0]) == 199_999


def test_nulls_signs_and_malformed(spark):
    df = spark.createDataFrame([(1, None), (2, '"x'), (None, "a")], "id int, tags string")
    rows = {(r.id, r.pos, r.tag, r.malformed) for r in packed.unpack(df, "id", "tags", SIGNS).collect()}
    assert rows == {(2, 1, "x", True), (None, 1, "a", False)}
    assert packed.unpack(df.limit(0), "id", "tags", SIGNS).count() == 0
    tags = spark.createDataFrame([(["#a-b", " c++ ", "#", None, "no sign"],), (None,)], "tags array<string>")
    assert packed.signs_of(tags) == "+-"
    assert values(spark, ["a,b"]) == [["a", "b"]]


def test_brackets_and_flags(spark):
    texts = ["(a, [b c]) d", "a] [b", "(a", '"x (y" z', "['p q', r", "{}", "a, 'b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tags string")
    got = {}
    for r in sorted(packed.unpack(df, "id", "tags", SIGNS).collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append((r.tag, r.quoted, r.bracketed, r.malformed, r.unbalanced))
    assert got == {
        0: [("a", False, True, False, False), ("b", False, True, False, False), ("c", False, True, False, False), ("d", False, False, False, False)],
        1: [("a", False, False, False, True), ("b", False, False, False, True)],
        2: [("a", False, True, False, True)],
        3: [("x (y", True, False, False, False), ("z", False, False, False, False)],
        4: [("p q", True, True, False, True), ("r", False, True, False, True)],
        6: [("a", False, False, False, False), ("'b", False, False, False, False)],
    }


def test_sums_before(spark):
    rows = [(list(range(n)),) for n in (1, 2, 3, 10, 1000)]
    got = spark.createDataFrame(rows, "n array<bigint>").select("n", sums_before(F.col("n")).alias("s")).collect()
    assert all(r.s == [sum(r.n[:i]) for i in range(len(r.n))] for r in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text("abc ,;|\"'`", max_size=8), min_size=1, max_size=5), min_size=1, max_size=20))
def test_quoted_round_trip(spark, rows):
    texts = [",".join('"' + v.replace('"', '""') + '"' for v in vs) for vs in rows]
    want = [[v.strip() for v in vs if v.strip()] for vs in rows]
    assert values(spark, texts) == want
