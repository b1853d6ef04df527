"""Language ID, quality, HTML and secrets: held-out results, defined cases, rules against brute force."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.cases import no_docs, odd_docs, odd_rows
from tidemill.llm import htmltext, langid, quality, secrets


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.query(spark, sf_dir).collect()
    assert len(got) == len(lang) and all(r.held_out == is_held(r.doc_id) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixture_and_counts_equal_brute_force(spark):
    model = langid.learn(odd_docs(spark))
    two = langid.Model(["a", "b"], np.stack([langid.counts("abc abd abe " * 50), langid.counts("xyz xyw xyv " * 50)]).astype(float), np.ones(2))
    found = two.languages("abc abd abe " * 30 + "xyz xyw xyv " * 10)
    assert [x for x, _ in found] == ["a", "b"] and abs(found[0][1] - 0.75) < 0.05 and two.languages("abc abd " * 20) == [("a", 1.0)]
    many = langid.Model([f"l{i:04}" for i in range(1500)], np.random.default_rng(0).integers(0, 3, (1500, langid.BINS)).astype(float), np.ones(1500))
    assert many.predict("any text at all")[0].startswith("l")
    want = {}
    for i, t, lang, *_ in odd_rows():
        if i is not None and lang is not None and not is_held(i):
            want[lang] = want.get(lang, 0) + (langid.counts(t) if t else np.zeros(langid.BINS, int))
    assert model.langs == sorted(want)
    for k, lang in enumerate(model.langs):
        p = (want[lang] + langid.SMOOTH) / (want[lang] + langid.SMOOTH).sum()
        assert np.allclose(model.p[:, k], p)
    a, b = np.array([0.7, 0.2, 0.1]), np.array([0.1, 0.2, 0.7])
    pi, _ = model.mixture(np.stack([a, b], 1), 1000 * (0.75 * a + 0.25 * b), rounds=500)
    assert np.allclose(pi, [0.75, 0.25], atol=0.02)


def test_language_defined_cases(spark):
    docs = odd_docs(spark)
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(r.lang_pred == (r.languages or ["und"])[0] and (not r.shares or r.shares[0] == r.score) for r in langid.identify(docs, langid.learn(docs)).collect())
    assert langid.learn(docs).predict("½ ² 3 !")[0] == "und"
    kept = langid.keep_identified(docs, langid.learn(docs))
    assert kept.columns == docs.columns
    assert langid.identify(no_docs(spark), langid.learn(no_docs(spark))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(no_docs(spark))).collect()} == {"und"}


def test_quality_on_held_out_rows(spark, sf_dir):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.query(spark, sf_dir).collect()
    assert all(r.held_out == is_held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.8


def test_quality_contexts_equal_brute_force(spark, monkeypatch):
    texts = ["a b c a! B 7", None, "", "x " * 30 + "a b", "one", " ".join(f"w{i % 7}" for i in range(100))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index, want, tokens = quality.index_vectors(), np.zeros((quality.ROWS, quality.DIM)), quality.Tokens()
    for t in texts:
        for stream in tokens.rows(t):
            for i in range(len(stream)):
                for j in range(max(0, i - quality.WINDOW), min(len(stream), i + quality.WINDOW + 1)):
                    if i != j:
                        want[stream[i]] += index[stream[j]]
    assert np.array_equal(quality.context_sums(docs), want)
    for together in (3, 10, 64):
        monkeypatch.setattr(quality, "TOGETHER", together)
        sums = quality.Contexts()
        for t in texts:
            for stream in tokens.rows(t):
                sums.add(stream)
        assert np.array_equal(sums.table(), want)


def test_quality_reads_whole_shapes():
    assert quality.shape("a1b2c3d4!!!!!!") == "a9a9a9a9!!!!!!" and quality.shape("ABc") == "Aa"


def test_quality_defined_cases(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.learn(docs, none)).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, one)).collect()} <= {1.0, 0.5}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.learn(docs, both)).collect())
    assert quality.score(no_docs(spark), quality.learn(docs, both)).count() == 0


@pytest.fixture(scope="module")
def labeller():
    return htmltext.train()


def test_html_on_new_generated_pages(labeller):
    r = np.random.default_rng(99)
    pages = [htmltext.training_page(r) for _ in range(200)]
    got = htmltext.extract_many(labeller, [p for p, _ in pages])
    assert np.mean([g == "\n".join(m) for g, (_, m) in zip(got, pages, strict=True)]) > 0.9


def test_html_cases(labeller):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- x --><div class="ad">Buy this now today.</div><article><h1>A &amp; B</h1><p><b>First  line\n here.<br><p>Second &lt;line&gt; goes on and on.</p></article><footer>&copy; site</footer>'
    assert htmltext.extract_many(labeller, [page]) == ["A & B\nFirst line here.\nSecond <line> goes on and on."]
    assert len(htmltext.extract_many(labeller, ["<p", "<!-- open", "<a href='x"])) == 3
    assert htmltext.extract_many(labeller, [None, ""]) == ["", ""]
    assert [b[0] for b in htmltext.blocks("<ul><li>a<li>b</ul><p>c<p>d<textarea>x</textarea>e")] == ["a", "b", "c", "d", "e"]


def test_html_gradients():
    net, r = htmltext.Labeller(), np.random.default_rng(0)
    x, mask, y = r.normal(size=(4, 2, htmltext.DIM)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool), r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        s = net.scores(x, mask)
        return -np.sum(np.where(mask, y * np.log(s) + (1 - y) * np.log(1 - s), 0)) / mask.sum()

    f, fs = net._run(x, mask, "f")
    b, bs = net._run(x, mask, "b")
    d = np.where(mask, net.scores(x, mask) - y, 0) / mask.sum()
    grads, up = {}, d[..., None] * net.p["v"]
    net._back(x, fs, up[..., : htmltext.HIDDEN], "f", grads)
    net._back(x, bs, up[..., htmltext.HIDDEN :], "b", grads)
    for k in ("wf", "uf", "bf", "wb", "ub", "bb"):
        at = tuple(int(i) for i in np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape))
        net.p[k][at] += 1e-5
        high = loss()
        net.p[k][at] -= 2e-5
        low = loss()
        net.p[k][at] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(grads[k][at], rel=1e-3)


def test_html_table(spark, sf_dir):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>Some longer text here for the page.</p></article>"), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS u")
    got = htmltext.extract(pages, htmltext.train(150, 2)).collect()
    assert len(got) == 4 and sum(r.text == "" for r in got) >= 3
    assert htmltext.extract(pages.where("false"), htmltext.train(60, 1)).count() == 0


def test_hostile_pages_take_linear_time(labeller):
    import time

    for part in ("<a ", '<a b="', "<a b='>", "<div>x", "<!", "<!--", "</p>", "<p>y</q>", "<script>", "< ", "<a class=", "<b c='\">"):
        page = part * (1_000_000 // len(part))
        began = time.time()
        htmltext.blocks(page)
        assert time.time() - began < 8, part  # a quadratic scan would take hours
    assert [b[0] for b in htmltext.blocks("<p>a <b x=\"1>2\">b</b> < c <i y='>'>d</i> e <u z=\"f>g")] == ["a b < c d e g"]
    assert [b[0] for b in htmltext.blocks("<p>a<!-- x > y --><p>b<!-- open <p>c")] == ["a", "b"]
    assert [b[0] for b in htmltext.blocks("<p>a <q")] == ["a <q"]


def test_articles_of_repeated_words_and_lines(labeller):
    lines = ["Ther " * 80 + "eres " * 90, *["Thisonbleerth en."] * 6, "A shouted LINE!! OF!! WORDS!! THAT!! GOES!! ON!! AND!! ON!!"]
    page = "<html><body><nav><a href=/x>Home</a></nav><article><h1>Ther Ther Ther</h1>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer>&copy; x.example.org</footer></body></html>"
    assert htmltext.extract_many(labeller, [page]) == ["\n".join(["Ther Ther Ther", *(x.strip() for x in lines)])]


def test_long_pages_in_parts(labeller):
    r = np.random.default_rng(5)
    found = [b for _ in range(30) for b in htmltext.blocks(htmltext.training_page(r)[0])]
    whole = labeller.scores(htmltext.features(found)[:, None], np.ones((len(found), 1), bool))[:, 0]
    for part in (7, 100, 10**6):
        assert np.allclose(labeller.long_scores(found, part), whole, atol=1e-4)


def test_html_on_the_pages_table(labeller, spark, sf_dir):
    """The article's blocks, by a plain rule on the tags of these pages, against the labeller."""
    rows = htmltext.query(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)

    def plain(page):
        page = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->", "", page)
        page = re.sub(r"(?is)<(nav|footer|header|aside|form)\b.*?</\1>", "", page)
        page = re.sub(r'(?is)<(div|section|ul|ol|p) (?:class|id)="[^"]*(?:ad|cookie|comment|menu|nav|side|share|footer|banner|promo|related|notice)[^"]*">.*?</\1>', "", page)
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", page)).split())

    same = [" ".join(r.text.split()) == plain(pages[r.page_id]) for r in rows if pages[r.page_id]]
    print("pages that agree with the rule", np.mean(same), len(same))
    assert all(r.n_chars == len(r.text) for r in rows)
    assert np.mean(same) > 0.9


@pytest.fixture(scope="module")
def net():
    return secrets.train()


def brute_base(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    assert len(low) == len(text)
    return sorted(out)


def test_base_spans_equal_the_rules():
    r = random.Random(8)
    parts = ["password", "PassWd", "API_KEY", "apikey", "token", "secret", '"', "'", " ", " ", ":", "=", "AKIA", "ABCDEF0123", "deadbeef00112233", "0123456789abcdef01234567", "é", "x", "K", "\n", "abc/def+=="]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert secrets.base_spans(t) == brute_base(t), t


def test_network_finds_secrets_and_leaves_others(net):
    found, y = secrets.findings(1000, 123)
    p = net.probability(np.stack([secrets.codes(*f) for f in found]))
    assert np.mean(p[y == 1] >= net.threshold) > 0.97
    assert np.mean(p[y == 0] >= net.threshold) < 0.03


def test_network_gradients():
    n, r = secrets.Network(), np.random.default_rng(0)
    x, y = r.integers(0, 99, (3, secrets.LENGTH)), np.array([0, 1, 1])
    g = n._gradients(x, y)

    def loss():
        z = n._forward(x)[-1]
        return np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))

    for k in ("e", "k1", "b1", "k2", "b2", "w", "d", "v"):
        at = tuple(int(i) for i in np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        n.p[k][at] += 1e-5
        high = loss()
        n.p[k][at] -= 2e-5
        low = loss()
        n.p[k][at] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(g[k][at], rel=1e-2)


def test_network_finds_the_base_findings_of_documents(net, spark, sf_dir):
    """The rules label findings that no generator of the training made: the network alone must find them."""
    docs = spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.01/documents.parquet")
    x, hits, texts = [], 0, [r.text or "" for r in docs.select("text").collect()]
    for t in texts:
        base = secrets.base_spans(t)
        for start, kind, end in base:
            if kind == 0:  # the value after the word
                start = secrets.ASSIGN.match(t, start).start(2)
            if end - start >= 16:
                x.append(secrets.codes(t, start, end))
        hits += len(secrets.scan_many(net, [t])[0]) - len(base)
    found = net.probability(np.stack(x)) >= net.threshold
    print("recall on base findings", found.mean(), len(found), "other findings", hits, "in", len(texts))
    assert found.mean() >= 0.9


def test_secret_table(spark, net):
    t = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y sk_live_9aZk3LmQ8vTr2XyB7cWd1'
    docs = odd_docs(spark).select("doc_id", "text", "kept", "id").union(spark.createDataFrame([(99, t, 1, "i")], "doc_id long, text string, kept int, id string"))
    got = secrets.digest(secrets.scan(docs, net)).collect()
    assert len(got) == len(odd_rows()) + 1
    own = next(r for r in got if r.doc_id == 99)
    base = brute_base(t)
    written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
    assert (own.n_assign, own.n_access, own.n_hex) == (1, 0, 1)
    assert own.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    assert own.spans.startswith(written) and own.spans.endswith(f"network:{t.index('sk_live')}:{len(t)}")
    assert secrets.digest(secrets.scan(no_docs(spark), net)).count() == 0
