import pytest
from pyspark.sql import functions as F

from recordlake.functions import dates, hashing, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn,values,expect",
    [
        (text.clean, ["  a\t b \n c ", None], ["a b c", ""]),
        (text.clean_inline, ["a<BR />b"], ["a b"]),
        (text.search_key, ["  Hound & Fox, LLP  ", "É1"], ["hound fox llp", "1"]),
        (text.category_key, ["The Sale & Transfer of a Ship"], ["sale and transfer ship"]),
        (text.officer_key, ["Hon. Ann  B. Lake, Dept. 3", "Judge PRO TEM"], ["ann b lake 3", ""]),
        (text.person_label, ["The Hon. Judge Ann Lake,"], ["Ann Lake"]),
        (text.name_key, ["Fox & Hound, Inc.", "A.B. Company LLC"], ["FOX AND HOUND", "A B"]),
        (text.compact_key, ["Some Thing!", ""], ["some_thing", "unknown"]),
        (text.slug, ["Ünder (x) ", "--"], ["ünder-x", "unknown"]),
        (text.record_key, [" cgc 23-605_428 "], ["CGC23605428"]),
        (text.strict_record_key, ["CGC-23-605428", " cgc 23 605428 ", "CGC_23_605428"], ["CGC23605428"] * 3),
        (text.record_prefix, ["12-abc9d"], ["ABC"]),
        (text.record_category, ["CRI1", "cgc2", "DPO", "FDI", "PES", "APP", "9", "ZZ"], ["Criminal", "Civil", "Family", "Family", "Probate", "Appeals", "Legacy", "Other"]),
        (text.inferred_matter_type, ["PCN-1", "PES1", "XX1"], ["Civil", "Probate", "Unclassified"]),
        (text.government_bucket, ["Port JPA", "US Attorney", "SF Public Defender", "Labor Commissioner", "Lake County Counsel", ""], ["Joint Powers Authorities", "Federal", "City and County of San Francisco", "State", "Municipalities", "Other Government"]),
        (text.optional_number, [None, "", "  ", "0", "x", "1.5"], [None, None, None, 0.0, None, 1.5]),
        (text.count_or_null, ["3", "-1", "x"], [3, None, None]),
        (text.loose_bool, [" YES ", "0", None], [True, False, False]),
        (text.safe_path, ["a/b", "a/../b", ""], ["a/b", None, None]),
        (text.as_list, [" a; b\n\n c ;"], [["a", "b", "c"]]),
        (text.json_list, ['["a","b"]', "nope", None], [["a", "b"], [], []]),
        (text.strip_party_roles, ["Ann Lake (AND TRUSTEE of x) ;"], ["Ann Lake"]),
        (text.pretty_label, ["AND FRAUD UNDER THE UCL;", "Mixed (CASE) stays"], ["Fraud under the UCL", "Mixed (CASE) stays"]),
        (text.shard_path, ["cgc-23-1", "23cgc1", "x"], ["CGC/23/CGC-23-1.json", "CGC/23/23CGC1.json", "_MISC/unknown/X.json"]),
        (lambda c: text.without_parameter(c, "sid"), ["http://a/?sid=1&b=2", "http://a/?b=2&SID=9"], ["http://a/?b=2", "http://a/?b=2"]),
        (dates.to_iso, ["2024-04-30 11:18", "APR-3-2024", "4/3/2024", "soon"], ["2024-04-30", "2024-04-03", "2024-04-03", None]),
        (dates.find_iso, ["on 4/3/2024.", "x 2024-04-03", ""], ["2024-04-03", "2024-04-03", ""]),
        (dates.status_date, ["filed Apr 3, 2024", "none"], ["2024-04-03", None]),
    ],
)
def test_values(spark, fn, values, expect):
    assert each(spark, fn, values) == expect


def test_bytes_and_money(spark):
    rows = spark.createDataFrame([(0, 0.005), (1536, 1.0), (2097152, None)], "b long, m double")
    got = rows.select(text.bytes_text(F.col("b")), text.percent_text(F.col("m"))).collect()
    assert [r[0] for r in got] == ["0.00 KB", "1.50 KB", "2.00 MB"]
    assert [r[1] for r in got] == ["1%", "100%", None]


def test_hashes(spark):
    assert one(spark, hashing.fnv1a32(F.lit("litigants:Person 😀"))) == 4053898240
    assert one(spark, hashing.delta_varints(F.array(F.lit(1), F.lit(2), F.lit(130)))) == "AQGAAQ=="
    assert hashing.undo_delta_varints("AQGAAQ==") == [1, 2, 130]
    assert one(spark, hashing.bucket_name(F.lit(10), 1024)) == "00a"
    with pytest.raises(Exception, match="increasing"):
        one(spark, hashing.delta_varints(F.array(F.lit(2), F.lit(2))))


def test_year_and_titles(spark):
    y = dates.record_year(F.col("n"), F.col("f"), 2026)
    rows = spark.createDataFrame([("CGC-98-1", None), ("CGC 09 1", ""), ("CGC-27-1", None), ("1", "2011-01-01"), ("1", None)], "n string, f string")
    assert [r[0] for r in rows.select(y).collect()] == [1998, 2009, 2027, 2011, None]
    t = spark.createDataFrame([("Lake v. Fox et al",), ("In re Estate of Lake",), ("People vs. Fox",)], "t string").select(text.title_parties(F.col("t")).alias("p")).select("p.*")
    assert [tuple(r) for r in t.collect()] == [("Lake", "Fox", None), (None, None, "Estate of Lake"), (None, None, None)]


def test_prefix_info(spark):
    rows = spark.createDataFrame([("cri",), ("PES",), ("CXX",), ("CUD",), ("AES",), ("(none)",), ("CMS",)], "p string")
    got = {r["i"]["code"]: tuple(r["i"]) for r in rows.select(text.prefix_info(F.col("p")).alias("i")).collect()}
    assert got["CRI"][3] == "Criminal" and got["PES"][3] == "Probate - Estate" and got["CXX"][1] == "Other"
    assert got["AES"][3] == "Appeals - Estate" and got["(none)"][1] == "Legacy" and got["CMS"][4] == 1987


def test_unique_and_represented(spark):
    assert one(spark, text.unique_texts(F.array(*map(F.lit, [" A", "a", "", "b"])))) == ["A", "b"]
    assert one(spark, text.represented_parties(F.lit("Ann Lake (PLAINTIFF), Bob Fox (CROSS-DEFENDANT); ann lake"))) == ["ANN LAKE", "BOB FOX"]
    assert one(spark, text.text_op(F.lit("Abc"), "regex", "(")) is False
    assert one(spark, text.text_op(F.lit("Abc"), "ends", "BC")) is True
