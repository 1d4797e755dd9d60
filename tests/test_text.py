import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinmark.functions import attributes, fuzzy
from twinmark.functions.text import clean, domain_text, normalize, similarity_text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("DEC CO1", "desiccated type 1"),
        ("DEC C01", "desiccated type 1"),
        ("Decicated Coconut type 1", "desiccated coconut type 1"),
        ("Dec Coco 1", "desiccated coconut type 1"),
        ("coconut 1 2", "coconut type 1 2"),
        ("MCB30A", "mcb 30a"),
        ("M.C.B 30 A", "mcb 30a"),
        ("1.5mm", "1 5mm"),
        ("10 mm", "10 mm"),
        ("SP-GEN-AIR-FLT", "sp generator air filter"),
        ("nan", ""),
        ("  ", ""),
        (None, ""),
    ],
)
def test_normalisation(spark, text, expected):
    assert one(spark, text, domain_text) == expected


def test_clean_and_similarity_text(spark):
    assert one(spark, " None ", clean) == ""
    assert one(spark, " Ab ", clean) == "Ab"
    assert one(spark, "mcb 30a x", similarity_text) == "mcb miniature circuit breaker 30a 30 amp x"
    assert one(spark, "É-1", normalize) == "1"


def test_technical_tokens(spark):
    row = spark.createDataFrame([("MCB 30A 230V 20MM 4 x 5",)], "x string").select(attributes.technical_tokens(domain_text("x")).alias("t")).first().t
    assert row.numbers == ["20", "230", "30", "4", "5"]
    assert row.measurements == ["20mm", "230v", "30amp"]
    assert row.dimensions == ["4 x 5"]
    assert row.units == ["a", "mm", "v"]


def test_attributes_and_variants(spark):
    rows = [("P1", "RED PAINT 1L CAN"), ("P2", "TR LABELS"), ("P3", "Labels"), ("P4", "extra small generator air filter left 20 amp 12mm"), ("P5", None)]
    got = {r.PART_NO: r for r in attributes.enrich(spark.createDataFrame(rows, "PART_NO string, DESCRIPTION string")).collect()}
    assert (got["P1"].attrs.product_class, got["P1"].attrs.color, got["P1"].attrs.volume, got["P1"].attrs.packaging) == (["paint"], ["red"], ["1l"], ["can"])
    assert not got["P2"].is_generic and got["P3"].is_generic
    assert got["P3"].attrs.generic_terms == ["label", "labels"]
    v = got["P4"].variants
    assert (v.FILTER_FUNCTION, v.SIZE, v.SIDE, v.ELECTRICAL_RATING, v.DIMENSION) == (["air"], ["extra small"], ["left"], ["20A"], ["12MM"])
    assert got["P4"].attrs.application_context == ["generator"] and got["P4"].family == "filters"
    assert got["P5"].normalized_description == "" and not got["P5"].is_generic


def test_metrics(spark):
    text = lambda x: one(spark, x, lambda c: similarity_text(domain_text(c)))
    assert fuzzy.text_scores(text("MCB30A"), text("MCB 30 Amp"))[0] > 90
    assert fuzzy.text_scores(text("MCB30A"), text("Miniature Circuit Breaker 30A"))[1] > 90
    assert fuzzy.text_scores(text("Decicated Coconut type 1"), text("Desiccated Coconut type 1"))[0] > 95
    assert fuzzy.part_score("ab100", "ab100") == 100
    assert fuzzy.ratio("abcd", "bd") == pytest.approx(100 * 2 * 2 / 6)
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.token_set_ratio("a b", "b a c") == 100
    assert fuzzy.text_scores("", "x") == (0.0, 0.0)


def test_metrics_of_many_pairs_equal_those_of_one():
    texts = ["small red widget", "red widget small type 2", "x", "a" * 70 + " b", "größe ä", "widget", "mcb miniature circuit breaker 30a 30 amp"]
    pairs = [(a, b) for a in texts for b in texts]
    assert fuzzy.score_many(pairs) == [fuzzy.text_scores(a, b) for a, b in pairs]
    assert fuzzy.ratios(pairs) == [fuzzy.ratio(a, b) for a, b in pairs]


def test_common_length_against_table():
    def slow(a, b):
        row = [0] * (len(a) + 1)
        for c in b:
            nxt = [0]
            for j, d in enumerate(a):
                nxt.append(row[j] + 1 if c == d else max(row[j + 1], nxt[j]))
            row = nxt
        return row[-1]

    for a, b in [("kitten", "sitting"), ("", "x"), ("abcabc", "cba"), ("aaaa", "aa")]:
        assert fuzzy.common_length(fuzzy.places(a), len(a), b) == slow(a, b)


def test_generic_needs_all_words(spark):
    df = spark.createDataFrame([("filter oil",), ("filter",), ("oil filter kit",), ("red filter",), ("",)], "x string")
    assert [r[0] for r in df.select(attributes.is_generic("x")).collect()] == [True, True, False, False, False]


def test_context_order(spark):
    df = spark.createDataFrame([("GEN-1", "hvac gen pump")], "p string, d string")
    assert df.select(attributes.application_context("p", "d")).first()[0] == ["generator", "hvac", "pump"]
    assert df.select(F.lit(1)).count() == 1


def test_crossed_part_scores_equal_those_of_single_pairs(monkeypatch):
    """Long, blank, absent and foreign texts, and rows without texts, in chunks of any size."""
    texts = ["abc123", "ab12c", "", None, "ä1", "a\0b", "a" * 63 + "b", "b" * 63, "c1" * 32, "1"]
    a = [texts[k : k + k % 4] for k in range(10)] + [[]]
    b = [texts[9 - k : 9 - k + (k + 1) % 5] for k in range(10)] + [["x"]]
    want = [[fuzzy.part_score(x, y) for x in p for y in q] for p, q in zip(a, b, strict=True)]
    for pairs in (1, 7, 10_000):
        monkeypatch.setattr(fuzzy, "CROSS", pairs)
        kind = pa.list_(pa.string())
        assert fuzzy.cross_scores(pa.array(a, kind), pa.array(b, kind)).to_pylist() == want
    assert fuzzy.cross_scores(pa.array([], kind), pa.array([], kind)).to_pylist() == []


def test_nothing_constant_is_lowered_while_planning(spark):
    df = spark.createDataFrame([(v,) for v in (" None ", "NAN", "nan x", "none\n", None, "Ab")], "x string")
    assert [r.y for r in df.select(clean("x").alias("y")).collect()] == ["", "", "nan x", "", "", "Ab"]
    plan = df.select(F.lower(clean("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan  # a branch that is a constant would be lowered in the driver
