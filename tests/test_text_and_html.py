"""Cards C5 (answer cleaning), C9 (HTML), F-functions against hand-worked values."""

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import text as X
from tessera.plans.pages import page_extract


CLEANED = {
    "Question: x\nAnswer: First. Second Answer: third": "First.",       # two markers: what stands between them
    "No marker here. Next sentence.": "No marker here.",
    "a" * 300: "a" * 150 + "...",                                       # no space to cut at
    "": ".",
    "b" * 10 + " " + "c" * 200: "bbbbbbbbbb...",                        # cut at the only space
    " ".join(["word"] * 60): "word " * 29 + "word...",                  # 30 whole words fit into 150 characters
}


def test_clean_response_cases(spark):
    df = spark.createDataFrame([(r,) for r in CLEANED], "r string")
    assert {r["r"]: r["a"] for r in df.select("r", X.clean_response("r").alias("a")).collect()} == CLEANED


def test_word_count_and_strip_match_python(spark):
    texts = ["  a b\tc\n d  ", "", "\n\n", "one", "x  y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X.word_count("t").alias("n"), X.strip_ws("t").alias("s")).collect()
    assert [r["n"] for r in rows] == [len(t.split()) for t in texts]
    assert [r["s"] for r in rows] == [t.strip() for t in texts]


def test_split_sentences_keeps_empty_pieces(spark):
    df = spark.createDataFrame([("Dr. Smith paid 3.50. Done.",)], "t string")
    got = df.select(X.split_sentences("t").alias("s")).first()["s"]
    assert got == [p.strip() for p in "Dr. Smith paid 3.50. Done.".split(".")]


def test_prompt_and_templates(spark):
    df = spark.createDataFrame([("ctx " * 400, "Why?", "Mars")], "c string, q string, t string")
    r = df.select(X.build_prompt("c", "q", "A {context} B {question} C", 10).alias("p"),
                  X.question_template("t").alias("qt"),
                  X.bounded_length("c").alias("b")).first()
    assert r["p"] == "A " + ("ctx " * 400)[:10] + " B Why? C"
    assert r["qt"] == "What is Mars?"
    assert r["b"] == 100


def test_feedback_format_and_percent(spark):
    df = spark.createDataFrame([("q", "a, b", True, 12.25), ("", "x", None, 50.0)],
                               "q string, a string, h boolean, p double")
    rows = df.select(X.feedback_format("q", "a", "h").alias("l"), X.percent_label("p").alias("pl")).collect()
    assert rows[0]["l"] == "Question: q, Answer: a, b, Helpful: True"
    assert rows[1]["l"] == "Question: , Answer: x, Helpful: None"
    assert rows[0]["pl"] == "12.3%" and rows[1]["pl"] == "50.0%"


def _page(spark, html):
    df = spark.createDataFrame([(1, "http://x", html)], "page_id long, url string, html string")
    return page_extract(df).first()


def test_html_order_script_unclosed_quotes(spark):
    html = ("<html><head><title>T &amp; U</title><script>var s='<p>no</p>';</script></head><body>"
            "<h2>second level</h2><h1>top</h1><!-- <h3>hidden</h3> --><h3>third</h3>"
            "<div><p>one<p>two <b>bold</b></div><p class='x'>three</p>"
            "<a href=\"/a\">a</a><a class='k' href='/b?x=1&amp;y=2'>b</a><a name='n'>no href</a>"
            "</body></html>")
    r = _page(spark, html)
    assert r["title"] == "T & U"
    assert r["headings"] == ["second level", "top", "third"]
    assert r["paragraphs"] == ["one", "two bold", "three"]
    assert r["links"] == ["/a", "/b?x=1&y=2"]
    assert r["text"] == "second level top third one two bold three"


def test_html_entities_open_paragraphs_and_bare_links(spark):
    r = _page(spark, "<body><p>caf&eacute; &#8217; &#x1F600; &amp;lt; &bogus; &#0; a & b<p>x<div>y</div><p>last"
                     "<a href=/q?x=1>k</a> <a HREF=b&amp;c>l</a>")
    assert r["paragraphs"] == ["café ’ 😀 &lt; &bogus; &#0; a & b", "x", "lastk l"]
    assert r["links"] == ["/q?x=1", "b&c"]


def test_html_missing_and_empty_title(spark):
    assert _page(spark, "<html><body><p>x</p></body></html>")["title"] == "No title found"
    assert _page(spark, "<html><head><title></title></head><body></body></html>")["title"] is None


def test_base64_round_trip(spark):
    df = spark.createDataFrame([("héllo wörld " * 20,)], "t string")
    r = df.select(X.to_base64("t").alias("b")).select("b", X.from_base64("b").alias("t")).first()
    assert "\n" not in r["b"] and r["t"] == "héllo wörld " * 20


def test_metadata_text_sorted(spark):
    df = spark.createDataFrame([('{"b": 2, "a": "x"}',)], "p string")
    r = df.select(X.metadata_text(F.from_json("p", "map<string,string>")).alias("m")).first()
    assert r["m"] == "a: x\nb: 2"


def test_quoted_tag_ends_other_attributes_and_open_raw_text(spark):
    cases = [
        ('<h1 title="a>b">X</h1><p class=\'q>\'>P <b title=">">bold</b> it\'s</p>', ["X"], ["P bold it's"], []),
        ('<a data-href="x" href="y">l</a><a href=z data-href=w>m</a><A CLASS="c"HREF=\'v\'>n</A><a name="href = no">o</a>', [], [], ["y", "z", "v"]),
        ('<abbr href="no">a</abbr><a title="href=\'no\'" href="yes">b</a><a disabled href = "two words">c</a><a "x" href=q>d</a>',
         [], [], ["yes", "two words", "q"]),
        ("<h2>Kept</h2><script>var x = '<h1>no</h1>';", ["Kept"], [], []),
        ("<p>one</p><!-- open <p>two</p>", [], ["one"], []),
        ("<!-- <script> --><h1>A</h1><script>'<!--'</script><h2>B</h2><!--><h3>C</h3>", ["A", "B", "C"], [], []),
        ('<h1 title="open>T</h1><p>u</p>', ["T"], ["u"], []),
        ("<pre>x</pre><param><p>v", [], ["v"], []),
        ("<p " + 'a="1" ' * 20_000 + ">long tag</p>", [], ["long tag"], []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, html string").withColumn("c", H.content_html("html"))
    got = df.select("i", H.page_headings("c"), H.page_paragraphs("c"), H.page_links("c")).collect()
    for r in got:
        assert [list(r[1]), list(r[2]), list(r[3])] == list(cases[r[0]][1:]), cases[r[0]][0][:80]
