"""Column functions on small fixtures: nulls, empty texts, thresholds, ties."""

import pytest
from pyspark.sql import functions as F

from pagesmith.functions import geometry as G
from pagesmith.functions import latex as X
from pagesmith.functions import scripts as C
from pagesmith.functions import text as T


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "line,is_item",
    [("1. first", True), ("2) second", True), ("(iii) third", True), ("xl. not below forty", False), ("iv) fourth", True), ("क) पहला", True), ("(सी) तीसरा", True), ("• dot", True), ("•dot", False), ("Chapter two", True), ("Chapters", False), ("अध्याय 3", True), ("plain words", False), ("", False), ("3.2.1. deep", True), ("१. एक", True), ("[a] letter", True)],
)
def test_list_item(spark, line, is_item):
    assert one(spark, line, T.is_list_item) is is_item


@pytest.mark.parametrize("line,level", [("1. a", 0), ("ii. b", 1), ("(iv) c", 1), ("(b) d", 2), ("* e", 0), ("words", -1), ("", -1), (None, None)])
def test_list_level(spark, line, level):
    assert one(spark, line, T.list_level) == level


@pytest.mark.parametrize("lines,joined", [(["an opera-", "tor"], "an operator"), (["a", "b"], "a b"), (["x", "1. y"], "x\n1. y"), (["Jean-", "Paul"], "Jean- Paul"), (["", " "], ""), ([], ""), (["a", "", "b"], "a b")])
def test_join_lines(spark, lines, joined):
    assert one(spark, lines, T.join_lines, "array<string>") == joined


@pytest.mark.parametrize("title,depth", [("1.2.3 Deep", 3), ("4 Top", 1), ("4. Top", 1), ("Chapter 9", 1), ("Section 2", 2), ("Plain", None), ("", None)])
def test_numbering_depth(spark, title, depth):
    assert one(spark, title, T.numbering_depth) == depth


@pytest.mark.parametrize(
    "raw,want",
    [("&amp;lt;", "<"), ("a&nbsp;b", "a b"), (None, None), ("", "")],
)
def test_entities(spark, raw, want):
    assert one(spark, raw, T.decode_entities) == want


def test_sanitize_keeps_only_allowed_tags(spark):
    assert one(spark, '<b>x</b><a href="u">y</a> & z', T.sanitize) == '<b>x</b>&lt;a href="u"&gt;y&lt;/a&gt; &amp; z'


@pytest.mark.parametrize("raw,want", [("```html\n<table><tr></tr></table>\n```", "<table><tr></tr></table>"), ("so: <table><tr>", "<table><tr></table>"), ("no table", "no table"), ("<html><body>x</body></html>", "x")])
def test_clean_reply(spark, raw, want):
    assert one(spark, raw, T.clean_reply) == want


@pytest.mark.parametrize("raw,want", [("ok THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG. end", "ok end"), ("<b>The</b> <i>quick</i> brown fox jump over the lazy dog", ""), ("a quick brown fox", "a quick brown fox"), (None, None)])
def test_pangrams(spark, raw, want):
    assert one(spark, raw, T.strip_pangrams) == want


@pytest.mark.parametrize(
    "latex,compact",
    [("0 . 0 5", "0.05"), (r"\mathrm { k m }", "km"), (r"1 0 0 , 0 0 0", "100,000"), (r"\mathsf{\mathrm{a b}}", "ab"), ("", ""), (r"2 5 0 \mu M", r"250 \mu M")],
)
def test_compact_is_a_fixed_point(spark, latex, compact):
    assert one(spark, latex, X.compact) == compact
    assert one(spark, latex, lambda c: X.compact(X.compact(c))) == compact


@pytest.mark.parametrize("latex,measure", [(r"3 7 ^ { \circ } C", True), ("C a ^ { 2 + }", True), (r"2 5 0 \mu M", True), ("( n = 3 5 0 )", True), ("P < 0 . 0 5", True), (r"\frac{a}{b}", False), ("x = y + z", False), (r"1 5 0 ~ \mathrm { m m }", True)])
def test_measurement(spark, latex, measure):
    assert one(spark, latex, X.is_measurement) is measure


@pytest.mark.parametrize("latex,none", [("", True), (None, True), (r"\int f", False), ("x ^ 2", False), ("1 0 - 5 0", True), (r"\text{Km}", True)])
def test_no_equation(spark, latex, none):
    assert one(spark, latex, X.is_no_equation) is none


@pytest.mark.parametrize("latex,plain", [(r"2 5 0 \mu M", "250 µM"), (r"1 0 - 5 0 \mathrm{K m}", "10-50 Km"), (r"\alpha + 1", "α+1"), ("", "")])
def test_plain(spark, latex, plain):
    assert one(spark, latex, X.to_plain) == plain


@pytest.mark.parametrize("text,script", [("हिन्दी text", "devanagari"), ("தமிழ்", "tamil"), ("plain", "latin"), ("", "latin"), (None, "latin"), ("ক ক", "bengali")])
def test_text_script(spark, text, script):
    assert one(spark, text, C.text_script) == script


@pytest.mark.parametrize("text,script", [("ten letters only then कुछ हिन्दी शब्द भी हैं", "devanagari"), ("short", "en"), ("этот текст по-русски написан", "cyrillic"), ("latin letters only in this text ж", "en"), (None, "en")])
def test_document_script(spark, text, script):
    assert one(spark, text, C.document_script) == script


def test_font_rows_have_one_row_a_key():
    keys = [k for _, k, _, _ in C.font_rows()]
    assert len(keys) == len(set(keys)) and "timesnewromanps-boldmt" in keys


def test_map_fonts(spark):
    names = spark.createDataFrame([("ABCDEF+Arial-BoldMT",), ("Unknown",), (None,), ("MyRobotoSlab-Thin",)], "name string")
    got = {r["name"]: (r["family"], r["file"]) for r in C.map_fonts(names, C.fonts(spark)).collect()}
    assert got == {"ABCDEF+Arial-BoldMT": ("Arimo", "Arimo-Bold.woff2"), "Unknown": (None, None), "MyRobotoSlab-Thin": ("Roboto Slab", "RobotoSlab-Regular.woff2")}


@pytest.mark.parametrize("codes,lang", [("en, hi", "hi"), ("EN", "en"), ("", "auto"), (None, "auto"), (" , ", "auto"), ("de,en", "de")])
def test_recogniser_language(spark, codes, lang):
    assert one(spark, codes, C.recogniser_language) == lang


def fit(lengths, w, h, ratio=0.48):
    """The search by a plain loop."""
    if w <= 0 or h <= 0 or sum(lengths) == 0:
        return 1.0
    lo, hi, best = 1.0, max(1.0, h), 1.0
    for _ in range(20):
        if hi - lo < 0.5:
            break
        mid = (lo + hi) / 2
        per = max(1.0, float(int(w / (mid * ratio))))
        need = sum(max(1, -(-n // per)) for n in lengths) * 1.2 * mid
        if need <= h:
            lo = best = mid
        else:
            hi = mid
    return best


@pytest.mark.parametrize("lengths,w,h", [([120], 300.0, 40.0), ([10, 20, 30], 100.0, 50.0), ([0], 10.0, 10.0), ([5], 0.0, 10.0), ([500], 451.0, 60.0), ([1], 1.0, 1.0), ([40, 0, 12], 200.0, 400.0)])
def test_fitted_size(spark, lengths, w, h):
    df = spark.createDataFrame([(lengths, w, h)], "l array<int>, w double, h double")
    assert df.select(G.fitted_size(F.col("l"), F.col("w"), F.col("h")).alias("s")).first()["s"] == pytest.approx(fit(lengths, w, h))


def test_fitted_size_grows_with_the_box(spark):
    df = spark.createDataFrame([([200], 300.0, float(h)) for h in range(10, 200, 10)], "l array<int>, w double, h double")
    got = [r["s"] for r in df.orderBy("h").select(G.fitted_size(F.col("l"), F.col("w"), F.col("h")).alias("s")).collect()]
    assert all(b >= a - 0.5 for a, b in zip(got, got[1:]))
