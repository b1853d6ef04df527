import html
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemill.functions import chunks, english, skills, text
from tidemill.operators import history, labels, search
from tidemill.streaming import events


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("Remote", None), (None, None), ("", None), ("Remote - Pune (Hybrid)", "Pune"), ("BLR", "Bangalore, India"), ("Paris / Lyon", "Paris, Lyon"), ("nyc", "New York, United States"), ("Onsite | Goa", "Goa")])
def test_locations(spark, raw, want):
    assert one(spark, raw, text.normalise_location) == want


@pytest.mark.parametrize("raw,want", [("Pune", True), ("Hyderabad, Pakistan", False), ("Remote", False), (None, False), ("Goas", False), ("tamil nadu", True)])
def test_india(spark, raw, want):
    assert one(spark, raw, text.is_india) is want


def test_noise_and_remote(spark):
    assert one(spark, "Go to https://a.b/c now. Please mention the word **X** today. End", text.strip_noise) == "Go to now. End"
    assert one(spark, "Work  from home", text.is_remote) and not one(spark, "remotely", text.is_remote)
    assert one(spark, 'x ```json\n{"a": 1}\n``` y', text.extract_json) == '{"a": 1}' and one(spark, "x {1} y", text.extract_json) == "{1}"


def test_hash_ignores_seniority_and_marks(spark):
    h = lambda a: spark.createDataFrame([(a, "Acme, Inc.", None)], "a string, b string, c string").select(text.content_hash(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert h("Senior Data Engineer II") == h("data engineer") != h("data scientist")


CLEANED = {
    "<p>a &amp;amp; b</p><script>x</script><ul><li>c<li>d</ul>": "a & b\n\nc\nd",
    "<p>a</p> <p></p> b": "a\n\nb",
    "a<br>b<br/>c": "a\nb\nc",
    "<style>p{}</style>x  y\t z": "x y z",
    "<b>no</b> <i>lines</i>": "no lines",
    '<p title="a>b">x</p>': "x",
    "<!-- c > d -->e &lt;b&gt;": "e <b>",
    "plain < 3 and > 2": "plain < 3 and > 2",
    "<a ": "<a",
    "": "",
    None: "",
}


class Plain(HTMLParser):
    """The rules again, as a stream."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.deep = [], 0

    def handle_starttag(self, tag, attrs):
        self.deep += tag in chunks.SILENT_ELEMENTS
        self.parts += ["\n"] * (tag in chunks.LINE_ELEMENTS)

    def handle_endtag(self, tag):
        self.deep -= tag in chunks.SILENT_ELEMENTS and self.deep > 0
        self.parts += ["\n"] * (tag in chunks.LINE_ELEMENTS)

    def handle_data(self, data):
        self.parts += [data] * (not self.deep)

    def text(self):
        out = re.sub("[ \t\r\f\v]+", " ", html.unescape("".join(self.parts)))
        return "\n".join(x.strip() for x in re.sub(r"\n\s*\n\s*\n+", "\n\n", out).splitlines()).strip()


def test_references_without_a_semicolon():
    page = "<h1>a &amp;amp; b &lt;c &ampd; &#65; &#x42 &copy</h1>"
    assert chunks.plain_text(page, chunks.closed) == "a & b <c &ampd; A &#x42 &copy"
    assert chunks.plain_text(page) == "a & b <c &d; A B ©"


def test_t1_leaves_open_references(spark, tmp_path):
    import hashlib

    from tidemill.plans import load, registry

    load()
    spark.createDataFrame([(1, "<title>x &amp</title><p>y &amp; z</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert registry.QUERIES["t1_strip_html"](spark, str(tmp_path)).first().text == hashlib.md5(b"x &amp\ny & z").hexdigest()


def test_plain_text(spark, sf_dir):
    assert {k: chunks.plain_text(k) for k in CLEANED} == CLEANED
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        assert chunks.plain_text(r.html) == p.text()
    assert len(chunks.plain_text("<a " * 300_000)) > 0


def brute_sections(head, body):
    out, now = [], ""
    for p in filter(None, (" ".join(x.split()) for x in re.split("\n+", body or ""))):
        if len(now) + len(p) + 1 <= 900:
            now = f"{now} {p}".strip()
            continue
        out += [now] if now else []
        *whole, now = [p[i : i + 900] for i in range(0, len(p), 900)]
        out += whole
    out += [now] if now else []
    if len(out) > 1 and len(out[-1]) < 120:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return [f"{head}. {c}" for c in out] or [head]


def test_sections(spark):
    r = random.Random(2)
    bodies = [None, "", " \n\n ", "x" * 500 + "\n" + "y" * 300 + "\n" + "z" * 2000 + "\nt", "a" * 900, "a" * 901, "a\nb", "see https://x.y/z\nnext"]
    bodies += ["\n".join("w" * r.choice([1, 100, 119, 120, 400, 899, 900, 901, 1800, 1900]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for row in df.select("b", chunks.chunks("section", F.lit("H"), F.col("b")).alias("c")).collect():
        assert row.c == brute_sections("H", (row.b or "").replace("https://x.y/z", "")), row.b
    assert df.select(chunks.chunks("whole", F.lit("H"), F.lit("b  c")).alias("c")).first().c == ["H. b c"]
    with pytest.raises(ValueError, match="section, whole"):
        chunks.chunks("x", F.lit("H"), F.lit("b"))


SKILLED = {
    "Python, SQL and AWS.": ["aws", "python", "sql"],
    "excellent Excelência excel!": ["excel"],
    "node.js and c++ or c#": ["c#", "c++"],
    "c+++ and asp.net go": [],
    "golang/no-sql my_sql": ["go", "sql"],
    "A/B testing; CI/CD, scikit-learn": ["a/b testing", "ci/cd", "scikit-learn"],
    "machine  learning": [],
    "Machine Learning with large language models": ["llm", "machine learning"],
    "the end is Java. Next": ["java"],
    "java.util": [],
    "rest apis": [],
    None: [],
}


def test_skills(spark):
    df = spark.createDataFrame([(k,) for k in SKILLED], "t string").select("t", skills.skills_in(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == SKILLED
    assert len(skills.SKILLS) == 80


STEMS = "consigned consign consistency consist conspicuous conspicu knackeries knackeri kneeling kneel generously generous happy happi cries cri ties tie gas gas running run engineers engin hoping hope hopped hop agreed agre feed feed relational relat vietnamization vietnam electricity electr adjustment adjust sky sky dying die say say communication communic beds bed analysis analysi learning learn".split()


def test_english(spark):
    assert [english.stem(w) for w in STEMS[::2]] == STEMS[1::2]
    got = spark.createDataFrame([("The engineers were running, and AI's x-rays!",), (None,)], "t string").select(english.terms("t").alias("a")).collect()
    assert [r.a for r in got] == [["engin", "run", "ai", "x", "ray"], []]


def test_change_sequence(spark, tmp_path):
    schema = "k long, h string, seq long"
    stored = spark.createDataFrame([], schema)
    seen = []
    for n, batch in enumerate([[(1, "A")], [(1, "A")], [(1, "B"), (2, "A")], [(1, "A")]]):
        new = spark.createDataFrame([(k, h, n) for k, h in batch], schema)
        found = history.changed(new, stored, ["k"], "h", [F.col("seq")]).select("k", "h", "seq")
        rows = found.collect()
        seen.append(len(rows))
        stored = spark.createDataFrame(stored.collect() + rows, schema)
    assert seen == [1, 0, 2, 1]


def test_capture_changes_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, h in enumerate("AABA"):
        spark.createDataFrame([(1, h, n)], "k long, h string, seq long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k long, h string, seq long").parquet(src)
        events.capture_changes(stream, out, ["k"], "h", "seq", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [0, 2, 3]


def test_rate_limit_equals_fold(spark):
    r = random.Random(1)
    rows = [(u, i, float(t)) for u in range(3) for i, t in enumerate(sorted(r.randrange(300) for _ in range(60)))]
    df = spark.createDataFrame(rows, "u long, i long, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(x.u, x.i): x.accepted for x in events.rate_limited(df, "u", "ts", "i", 3, 20).collect()}
    for u in range(3):
        own = [x for x in rows if x[0] == u]
        assert [got[u, x[1]] for x in own] == events.accepted([x[2] for x in own], 3, 20)


def test_fusion_and_gold(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, key long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, key long, rank int")
    got = search.fuse({"a": a, "b": b}, "key").orderBy("rank").collect()
    assert [r.key for r in got] == [11, 10, 12] and got[0].ranks == {"a": 2, "b": 1} and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    g = spark.createDataFrame([(["a", "b"], ["a"], ["b"], ["c"]), (["a"], ["a"], ["b"], [])], "o array<string>, k array<string>, d array<string>, n array<string>")
    assert [(r.label, r.valid) for r in labels.gold(g, "o", "k", "d", "n").collect()] == [(["a", "c"], True), (["a"], False)]
