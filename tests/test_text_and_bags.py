"""Column expressions: property bags, escapes, parameter rules, digests."""

import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillbook.functions import credentials, property_bag, text
from tillbook.operators import audit, digests

TEXTS = [None, "", "a", "Paris", "naïve café", "emoji 😀 inside", "a:b,c", "  x  ", "日本語", "line\nbreak"]


def one(spark, frame_schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, frame_schema).select(column).collect()]


def test_decodes_a_packed_bag(spark):
    names = "city:S:0:5:tier:S:5:4:note:B:0:-1:"
    got = one(spark, "n string, v string", [(names, "ParisGold")], property_bag.decode_strings(F.col("n"), F.col("v")))
    assert got == [{"city": "Paris", "tier": "Gold", "note": None}]


def test_decode_skips_what_cannot_be_read(spark):
    names = "empty:S:0:0:far:S:3:9:bad:S:x:1:neg:S:-1:2:ok:S:1:2:ok:S:0:1:cut:S:1"
    got = one(spark, "n string, v string", [(names, "abcd"), ("", "abcd")], property_bag.decode_strings(F.col("n"), F.col("v")))
    # The last readable entry of a repeated name counts.
    assert got == [{"ok": "a"}, {}]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.dictionaries(
            st.text("abcxyz", min_size=1, max_size=4), st.one_of(st.none(), st.text(min_size=1, max_size=8)), max_size=5
        ),
        min_size=1,
        max_size=20,
    )
)
def test_bag_round_trip(spark, maps):
    maps = [{k: v if v is None else v.replace("\x00", "0") for k, v in m.items()} for m in maps]
    maps = [{k: v if v is None else v.encode("utf-8", "replace").decode() for k, v in m.items()} for m in maps]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    bag = frame.withColumn("b", property_bag.encode_bag(F.col("m")))
    back = bag.select("i", property_bag.decode_strings(F.col("b.names"), F.col("b.values")).alias("m"))
    assert dict(back.collect()) == dict(enumerate(maps))


def test_bag_offsets_count_utf16_units(spark):
    frame = spark.createDataFrame([({"a": "😀x", "b": "yz"},)], "m map<string,string>")
    row = frame.select(property_bag.encode_bag(F.col("m")).alias("b")).select("b.names", "b.values").first()
    assert tuple(row) == ("a:S:0:3:b:S:3:2:", "😀xyz")


def test_bag_with_binary_values_and_allowed_names(spark):
    frame = spark.createDataFrame(
        [({"s": "text", "t": "no"}, {"p": b"\x00\x01", "q": b"\xff"})], "s map<string,string>, b map<string,binary>"
    )
    bag = property_bag.encode_bag(F.col("s"), F.col("b"), allowed=F.array(F.lit("s"), F.lit("p"), F.lit("q")))
    row = frame.select(bag.alias("x")).select("x.names", "x.values", "x.blob").first()
    assert (row[0], row[1], bytes(row[2])) == ("p:B:0:2:q:B:2:1:s:S:0:4:", "text", b"\x00\x01\xff")
    binaries = frame.select(bag.alias("x")).select(property_bag.decode_binaries(F.col("x.names"), F.col("x.blob"))).first()[0]
    assert {k: bytes(v) for k, v in binaries.items()} == {"p": b"\x00\x01", "q": b"\xff"}


def test_an_empty_string_does_not_survive_a_bag(spark):
    frame = spark.createDataFrame([({"a": ""},)], "m map<string,string>").select(property_bag.encode_bag(F.col("m")).alias("b"))
    assert frame.select(property_bag.decode_strings(F.col("b.names"), F.col("b.values"))).first()[0] == {}


def test_html_escape(spark):
    got = one(spark, "t string", [("<a href=\"x\">&'</a>",), (None,)], text.html_escape(F.col("t")))
    assert got == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;", None]


def test_url_encoding(spark):
    got = one(spark, "t string", [("a b&c=(ä)!~*",), ("%",)], text.url_encode_lower(F.col("t")))
    assert got == ["a+b%26c%3d(%c3%a4)!%7e*", "%25"]


def test_parameter_errors(spark):
    rows = [(v,) for v in (None, " ", "a,b", " okay　", "toolong", "😀😀😀")]
    error = text.parameter_error(F.col("t"), no_commas=True, max_size=5)
    assert one(spark, "t string", rows, error) == ["null", "empty", "comma", None, "too long", "too long"]
    assert one(spark, "t string", [(None,)], text.parameter_error(F.col("t"), required=False)) == [None]


def test_whitelist_is_whole_text(spark):
    rows = [("Ann-Marie O_k",), ("a1",), ("",), ("a\n",)]
    assert one(spark, "t string", rows, text.only_listed_characters(F.col("t"))) == [True, False, True, False]


def test_policy_defaults(spark):
    rows = [("short!",), ("longenough",), ("long-enough",), ("pässwörd1",), (None,)]
    got = one(spark, "t string", rows, credentials.policy_errors(F.col("t")))
    assert got == [["too short"], ["too few symbols"], [], ["too few symbols"], ["missing"]]
    strong = credentials.policy_errors(F.col("t"), strength="[0-9]")
    assert one(spark, "t string", [("long-enough",)], strong) == [["too weak"]]


def test_name_containment_is_literal(spark):
    """The name is plain text, not a pattern."""
    frame = spark.createDataFrame([("my.*secret", ".*"), ("abc", ".*"), ("xANNx", "ann")], "s string, n string")
    assert [r[0] for r in frame.select(credentials.contains_name(F.col("s"), F.col("n"))).collect()] == [True, False, True]


def test_salted_digest(spark):
    salt = base64.b64encode(b"0123456789abcdef").decode()
    want = {
        a: base64.b64encode(hashlib.new(a, b"0123456789abcdef" + "pä😀".encode("utf-16-le")).digest()).decode()
        for a in credentials.HASHES
    }
    for algorithm in credentials.HASHES:
        digest = credentials.salted_digest(F.col("s"), F.col("salt"), algorithm)
        got = one(spark, "s string, salt string", [("pä😀", salt), ("", salt), (None, salt)], digest)
        assert got == [want[algorithm], "", None]
    with pytest.raises(ValueError):
        credentials.hash_bytes(F.col("s"), "md4")


def test_protections(spark):
    frame = spark.createDataFrame([("naïve",), (None,)], "t string")
    assert frame.select(credentials.protect(F.col("t"), "sha1")).first()[0] == base64.b64encode(
        hashlib.sha1("naïve".encode()).digest()
    ).decode()
    key = F.lit(b"k" * 32)
    secret = credentials.protect(F.col("t"), "aes", key)
    assert [r[0] for r in frame.select(credentials.reveal_aes(secret, key)).collect()] == ["naïve", None]
    with pytest.raises(ValueError):
        credentials.protect(F.col("t"), "aes")
    with pytest.raises(ValueError):
        credentials.protect(F.col("t"), "rot13")


def test_reversible_base64(spark):
    rows = [(base64.b64encode("grüße".encode()).decode(),), ("BUILDING",), ("not base64",), (None,), ("/w==",)]
    assert one(spark, "t string", rows, credentials.reversible_base64(F.col("t"))) == [True, False, False, False, False]


def weak(word):
    units = word.encode("utf-16-le")
    return chr(sum(units[::2]) % 94 + 33)


def test_weak_digest_counts_utf16_low_bytes(spark):
    words = ["", "a", "hello", "é", "日本", "😀", "x😀y"]
    assert one(spark, "t string", [(w,) for w in words], digests.word_digest(F.col("t"))) == [weak(w) for w in words]
    sentence = "two  words 😀"
    got = one(spark, "t string", [(sentence,)], digests.text_digest(F.col("t")))
    assert got == ["".join(weak(w) for w in sentence.split(" "))]


def test_encoding_audit_shows_no_values(spark):
    frame = spark.createDataFrame([(1, "c2VjcmV0"), (1, "plain text")], "g int, s string")
    result = audit.encoding_audit(frame, "s", ["g"])
    assert result.columns == ["g", "stored", "possibly_encoded"]
    assert result.collect() == [(1, 2, 1)]


def test_trimming_takes_separators_and_line_ends_only(spark):
    """As the expression it replaces, on every character that either might take."""
    import unicodedata

    from tillbook.functions.text import trimmed

    known = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]) if unicodedata.category(c)[0] in "ZC"]
    frame = spark.createDataFrame([(f"{c}a{c} {c}b\r{c}",) for c in known] + [(c * 3,) for c in known] + [("",), (None,)], "t string")
    one = r"[\t\n\x0B\f\r\x85\p{Z}]"
    same = trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{one}+|{one}+$", ""))
    assert frame.where(~same).count() == 0
