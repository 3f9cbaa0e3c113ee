"""Each operator against brute force, a round trip or held-out accuracy, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SMALL
from tests.oracle import assert_same
from tidewater.llm import ann, graph, html, mixing, pieces, quality, queries, sharding, simhash, toxicity, urls, winnowing

MIDDLE = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ["id", "_id", "label", "score", "predicted", "held_out", "size", "shard", "slot", "target", "taken", "fingerprint", "component_id", "rank", "row", "words", "_words", "_chars", "q_words", "_key", "_range", "_at", "_next", "_bucket", "_source", "copies", "node", "bad", "host", "rule", "verdict"]


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, odd characters."""
    deal = random.Random(5)
    base = [" ".join(deal.choice(["alpha", "beta", "gamma", "delta", "den", "les", "x%%%"]) for _ in range(deal.randint(1, 60))) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, " \n\t ", "en", "s1", 4), (None, base[0], "en", "s0", 1), (None, None, None, None, None)]
    rows += [(103, "word " * 30_000, "en", "s2", 150_000), (104, "x" * 50_000, "en", "s2", 50_000), (105, base[3], "en", "s9", 9), (3, base[3], "en", "s0", 9), (3, "other", "en", "s0", 9)]
    rows += [(106, "emoji 💩 日本 \x00 a\u3000b \u2581x ﬁ", "en", "s0", 1), (107, "<s> </s> <unk> <0x0A>", "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def labels_for(spark, docs):
    return docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "cast(doc_id % 3 = 0 as int) toxic").distinct()


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


# 1. URL filter


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_query_equals_its_oracle(spark, name, folder):
    assert_same(queries.queries()[name](spark, folder), queries.oracle_sql()[name], folder)


def test_urls_are_cut_and_ruled(spark):
    cases = [
        ("http://A.Example.COM/en/x?y", "a.example.com", "/en/x", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("http://example.com", "example.com", "", None),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("ftp://x.net/fr/a://b", "x.net", "/fr/a://b", "net/fr/"), ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None), ("http://user@h.co.uk:80/p#q", "user@h.co.uk:80", "/p", None),
    ]
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(cases)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "bad", "rule", "_bad", "n")})
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    found = {r.page_id: r for r in urls.judge(pages, outcomes, queries.URL_RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(len(cases))] == [(h, p, r) for _, h, p, r in cases]
    assert found[0].verdict == "block" and found[1].verdict == "allow" and found[2].verdict == "allow"


def test_domains(spark):
    hosts = ["a.b.example.co.uk", "example.com", "com", "", "1.2.3.4:80", "u@x.y.org."]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(urls.registered_domain(F.col("h")), urls.suffix(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("1.2.3.4", "ip"), ("y.org", "org")]


def test_bad_hosts_are_blocked_by_evidence_only(spark):
    rows = [(i, f"http://bad.example.org/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 6}.example.org/{i}") for i in range(240)] + [(900, "http://few.example.org/1")]
    outcomes = [(i, True) for i in range(60)] + [(100 + i, i % 20 == 0) for i in range(240)] + [(900, True), (901, None), (None, True), (0, False)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {(r.host, r.verdict) for r in urls.judge(pages, spark.createDataFrame(outcomes, "page_id long, bad boolean"), []).collect()}
    assert ("bad.example.org", "block") in found and ("few.example.org", "allow") in found and all(v == "allow" for h, v in found if h.startswith("good"))
    assert urls.judge(pages.where("false"), spark.createDataFrame([], "page_id long, bad boolean"), []).count() == 0


# 2. Sharding


@pytest.mark.parametrize("shards", [8, 3, 100])
def test_shards_are_even_gapless_and_mixed(spark, odd, shards):
    got = sharding.interleave(odd, shards).toPandas()
    n = odd.count()
    assert len(got) == n and got["shard"].between(0, shards - 1).all()
    sizes = got.groupby("shard").slot.agg(["count", "max", "min"]).reindex(range(shards))
    counts = sizes["count"].fillna(0)
    assert counts.max() - counts.min() <= 1 and (sizes["max"].dropna() + 1 == sizes["count"].dropna()).all()
    text = {r.doc_id: r.text for r in odd.where("doc_id is not null and doc_id <> 3").collect()}
    for r in got.itertuples():
        if r.doc_id == r.doc_id and int(r.doc_id) in text:
            raw = (text[int(r.doc_id)] or "").encode()
            assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.interleave(empty_documents(spark)).count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 10 < 4, 'hot', concat('s', id % 7)) as source")
    got = sharding.interleave(docs).join(docs, "doc_id").groupBy("source").pivot("shard").count().toPandas().set_index("source")
    assert ((got.max(axis=1) - got.min(axis=1)) <= 2).all()


# 3. SentencePiece


def test_pieces_equal_the_library(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    texts = [r.text or "" for r in docs.collect()]
    want = sorted((len(ids), " ".join(map(str, ids)), model.decode(ids)) for ids in (model.encode(t, add_eos=True) for t in texts))
    assert sorted((r.n_tokens, r.ids, r.decoded) for r in pieces.encode(docs, path).collect()) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, path).collect()) == sorted((n, sha(i), sha(d)) for n, i, d in want)
    assert pieces.digests(empty_documents(spark), path).count() == 0


def test_pieces_on_random_characters():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        codec = pieces.Codec(file.read())
    deal = random.Random(1)
    letters = ["a", "b", "\u2581", " ", "  ", "\n", "\t", "é", "日本", "\u3000", "ﬁ", "\x00", "<s>", "<0x0A>", " the", "ing", "😀", "\r", "\xa0", "1234", "..."]
    texts = ["".join(deal.choice(letters) for _ in range(deal.randint(0, 12))) for _ in range(3000)]
    for text, found in zip(texts, codec.encode_all(texts), strict=True):
        ids = model.encode(text, add_eos=True)
        assert found == (len(ids), " ".join(map(str, ids)), model.decode(ids))


# 4. Quality and 10. Toxicity


def held_out_rates(spark, scored, label):
    rows = scored.where("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").toPandas()
    positive = rows[rows[label] == 1]
    return (positive.predicted == 1).mean(), (rows[rows[label] == 0].predicted == 1).mean()


def test_quality_held_out(spark):
    scored = queries.op4_quality_classifier(spark, MIDDLE)
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1 or score is null").count() == 0
    kept, wrong = held_out_rates(spark, scored, "quality")
    assert kept >= 0.97 and wrong <= 0.3
    assert scored.where("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)").count() == 0


def test_toxicity_held_out(spark):
    scored = queries.op10_toxicity(spark, MIDDLE)
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1 or score is null").count() == 0
    caught, wrong = held_out_rates(spark, scored, "toxic")
    assert caught >= 0.6 and wrong <= 0.03


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_on_odd_rows(spark, odd, classify):
    labels = labels_for(spark, odd)
    got = classify(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd.count() and got.where("score is null").count() == 0
    assert classify(odd.where("false"), labels).count() == 0
    for none in (labels.where("false"), labels.where("quality = 1 and toxic = 1"), labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})):
        assert classify(odd, none).count() == odd.count()


def test_rules_compile_to_columns(spark):
    forest = "Tree 0\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0E-4)\n    Predict: 0.0\n   Else (feature 1 > 2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    rules = quality._paths(forest, ["a", "b"])
    assert rules == [(("a", "<=", 1.5),), (("a", "<=", 1.5), ("b", "<=", 2e-4)), (("a", "<=", 1.5), ("b", ">", 2e-4)), (("a", ">", 1.5),)]
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0)], "a double, b double")
    assert [round(r[0], 6) for r in df.select(quality.Model(0.0, ((rules[2], 2.0),)).score()).collect()] == [round(1 / (1 + np.exp(-2)), 6), 0.5]


def plain_statistics(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    count = lambda p: len(regex.findall(p, text))
    lines, space = [x for x in text.split("\n") if x], " \t\n\x0b\f\r"
    per = lambda n, d: n / d if d else 0.0
    counts = {"lines": len(lines), "letter_runs": count(r"\p{L}+"), "capital_runs": count(r"\p{Lu}{2,}"), "digit_runs": count(r"\p{Nd}+"), "mark_runs": count(rf"[^\p{{L}}\p{{N}}{space}]{{2,}}"),
              "odd_marks": count(rf"[^\p{{L}}\p{{N}}{space}.,;:'\"?!()-]+"), "lone_marks": count(rf"(?<=[{space}])[^\p{{L}}\p{{N}}{space}](?=[{space}])"), "sentences": count(rf"[.?!](?=[{space}])"), "repeats": sum(a == b for a, b in zip(words, words[1:]))}
    held = {f"q_{k}": per(n, len(words)) for k, n in counts.items()}
    return held | {"q_length": per(len(text), len(words)), "q_words": math.log1p(len(words)), "q_distinct": per(len(set(words)), len(words)), "q_unlike": per(len(set(re.split(r"\n+", text.strip(space)))), len(lines))}


def test_scores_equal_rules_in_plain_python(spark, odd):
    """Statistics and the compiled rules against an evaluator of the same rules."""
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"), labels, F.lit(False))
    rows, names = quality.with_statistics(docs)
    assert model.rules
    for r in rows.select("text", *names, model.score().alias("score")).collect():
        found = plain_statistics(r.text or "")
        assert {n: r[n] for n in names} == pytest.approx(found), r.text
        total = model.bias + sum(w for rule, w in model.rules if all(r[n] <= b if sign == "<=" else r[n] > b for n, sign, b in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_samples_are_bounded(spark):
    """One id on very many rows, and very long texts, don't pass the bounds."""
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    hot = spark.range(3000).selectExpr("cast(1 as bigint) as doc_id", "concat('text ', id) as text", "'x' as label", "'y' as _hash")
    docs = hot.union(hot.limit(50)).union(spark.range(40).selectExpr("id", "repeat('long ', 1000)", "'x'", "'y'"))
    got = quality.sample(docs, labels, "quality", F.lit(True), 10).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 10, 1: 10}
    few = quality.sample(docs, labels, "quality", F.lit(True), 1000, most=20_000)
    assert few.groupBy("label").agg(F.sum(F.length("text")).alias("b")).where("b > 20000").count() == 0 and few.count() > 2
    assert quality.sample(docs, labels, "quality", F.lit(True), 1000, most=1).count() == 2


def plain_toxicity(model, text):
    """The score of a text by compressing every window twice, one by one."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    pad = model.base[-toxicity.PAD_BYTES :]
    sizes = lambda content, w: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(pad + w))
    saved = [sizes(model.base, w) - sizes(model.toxic + model.base, w) for i in range(0, len(words), 8) for w in [b" " + b" ".join(words[i : i + 8]) + b" "]]
    top = sorted(saved, reverse=True)[:3] or [0]
    x = [1.0, top[0], sum(top), *[math.log1p(sum(s >= k for s in saved)) for k in (1, 2, 3, 4, 5)], math.log1p(len(saved)), sum(saved) / len(saved) if saved else 0.0, float(np.median(saved)) if saved else 0.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_toxicity_equals_compression_one_by_one(spark, odd):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").select("text", "toxic").collect()
    model = toxicity.fit([r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic])
    docs = odd.where("doc_id is null or doc_id not in (103, 104)").select("doc_id", "text").union(spark.createDataFrame([(i, r.text) for i, r in enumerate(rows[:60])], "doc_id long, text string"))
    texts = [r.text or "" for r in docs.collect()]
    assert sorted(r.score for r in toxicity.score(docs, model).collect()) == pytest.approx(sorted(plain_toxicity(model, t) for t in texts), abs=1e-9)


# 5. HTML


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) { "<p>no</p>" }</script><style>p{}</style></head><body class="with-sidebar">
<header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site, accept them all now please</div>
<div id="content"><article><h1>Title &amp; more</h1><p>First paragraph with   <b>bold</b>
text that is long enough to count as the content of a page.<p>Short.<div class="ad">Buy this thing now, it is cheap and very good for you</div>
<ul><li>item one</li><li>item two</li></ul><p>Last paragraph, long again, so that the ratio of text to tags stays high &copy;.</article>
<section class="comments"><p>A reader writes a long comment here that must not be part of the text at all.</section></div>
<aside><p>Related reading that goes on and on for a while but stands aside from it.</p></aside><form><p>Sign up<input></form><footer>&copy; site</footer></body></html>"""


def test_page_furniture_goes_and_short_lines_stay():
    assert html.main_text(PAGE).split("\n") == ["Title & more", "First paragraph with bold text that is long enough to count as the content of a page.", "Short.", "item one", "item two", "Last paragraph, long again, so that the ratio of text to tags stays high ©."]


LEAD, SHORT = "A lead that says in one sentence what the article is about.", ["one", "two", "three"]


@pytest.mark.parametrize("repeats", [1, 40])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_all_parts_of_an_article_stay(outer, repeats):
    """Title, lead, body of any length, short items; an unmarked list of links goes."""
    body = "The body of the article goes on for long and outweighs all the rest. " * repeats
    items = "".join(f"<li>{x}</li>" for x in SHORT)
    inner = f"<{outer}><h1>Title</h1><div class=lead>{LEAD}</div><div class=body><p>{body}</p><p>{body}</p></div><section><ul>{items}</ul></section></{outer}>"
    page = f"<body><div><ul>{'<li><a href=/>Elsewhere</a></li>' * 5}</ul></div>{inner}</body>"
    assert html.main_text(page).split("\n") == ["Title", LEAD, body.strip(), body.strip(), *SHORT]


def test_a_second_article_stays():
    long = "Words of the first article that goes on for very long. " * 50
    assert html.main_text(f"<body><article><p>{long}</p></article><article><h2>Brief</h2>{'<p>Short news.</p>' * 5}</article></body>").split("\n") == [long.strip(), "Brief", *["Short news."] * 5]


def test_ratios_choose_the_region(monkeypatch):
    """Without any mark that says so, the long lines' element is kept, links and a far notice go."""
    links = "<div>" + "".join(f"<div><a href=/{i}>Go to {i}</a></div>" for i in range(8)) + "</div>"
    body = "".join(f"<p>Paragraph {i} of a text that is long enough to stand out from the links.</p>" for i in range(6))
    page = f"<body>{links}<div><h1>Head</h1>{body}<p>Short.</p></div>{links}<div>Made in 2020</div></body>"
    want = ["Head", *[f"Paragraph {i} of a text that is long enough to stand out from the links." for i in range(6)], "Short."]
    assert html.main_text(page).split("\n") == want
    everything = lambda ratios: np.ones(len(ratios), dtype=bool)
    with monkeypatch.context() as m:
        m.setattr(html, "content_lines", everything)
        assert html.main_text(page).split("\n") != want
    # Smoothing decides too: a short line amid long ones is content, and no region around them is marked.
    amid = np.array([1.0] * 6 + [90.0, 80.0, 2.0, 85.0, 95.0] + [1.0] * 6)
    assert html.content_lines(amid)[6:11].all() and not html.content_lines(amid)[:4].any()
    monkeypatch.setattr(html, "SIGMA", 1e-9)
    assert not html.content_lines(amid)[8]


FRAME = "<body><nav><a>x</a></nav>{}<footer>site</footer></body>"


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<article><h1>T</h1><p>Body text of some length.</p></article><div id="comments"><ol><li><article class="comment-body"><p>A reader says something long, more than the article has.</p></article></li></ol></div>', "T\nBody text of some length."),
        ('<div><div class="entry-header"><h1>Head</h1></div><p>Body text of some length here.</p></div><div class="site-header"><h1>Site</h1></div>', "Head\nBody text of some length here."),
        ("<article><header><h1>T</h1><p>By me</p></header><p>Body text of some length.</p><footer>tags</footer></article>", "T\nBy me\nBody text of some length."),
        ("<form><h1>Head</h1><p>Body text of some length.</p><p>More</p><input></form>", "Head\nBody text of some length.\nMore"),
        ("<form><article><p>Body text of some length.</p></article></form>", "Body text of some length."),
        ("<p>First.</p><![foo[ bar]]><p>Second.</p>", "First.\nSecond."),
        ("<p>First.</p><![ x><p>Second.</p>", "First.\nSecond."),
        ("<p>First.</p><!-- never ends><p>Second.</p>", "First.\nSecond."),
        ("<article><p>Let <math><mi>x</mi></math> be.</p></article>", "Let x be."),
    ],
)
def test_pages_that_went_wrong(inner, text):
    assert html.main_text(FRAME.format(inner)) == text


@pytest.mark.parametrize("bit", ["<div>x", "<ul><li>x", "<article><nav>x", "<form><h1>x</h1>", "<p><span>x</span>", "<!--", "<!-->", "<a ", "</a ", "<![", "<![x>", "<p a='>", "<?x>", "<!x [ >", "&", "<script><!--"])
def test_hostile_pages_take_linear_time(bit):
    began = time.process_time()
    html.main_text(bit * 50_000)
    html.main_text(bit * 50_000 + ">")
    assert time.process_time() - began < 12


def plain_lines(tree):
    """(path of (tag, class) nodes, text, tags, linked) of a well-formed tree, from the definitions."""
    lines, held, tags = [], [], 0

    def cut():
        nonlocal held, tags
        if held:
            lines.append((held, tags))
            held, tags = [], 0

    def walk(node, path):
        nonlocal tags
        if isinstance(node, str):
            held.append((path, node))
            return
        tags += 1
        if node[0] in html.BLOCKS:
            cut()
        for child in node[2]:
            walk(child, [*path, node])
        tags += 1
        if node[0] in html.BLOCKS:
            cut()

    walk(tree, [])
    cut()
    return lines


def plain_content(ratios):
    n = len(ratios)
    g = lambda d: math.exp(-0.5 * d * d) if abs(d) <= 3 else 0.0
    smooth = [math.log1p(sum(ratios[j] * g(i - j) for j in range(n)) / sum(g(i - j) for j in range(n))) for i in range(n)]
    low, high = min(smooth), max(smooth)
    for _ in range(50):
        up = [s for s in smooth if s > (low + high) / 2]
        down = [s for s in smooth if s <= (low + high) / 2]
        if not up or not down:
            return [True] * n
        new = sum(down) / len(down), sum(up) / len(up)
        if new == (low, high):
            break
        flags = [s > (low + high) / 2 for s in smooth]
        low, high = new
    flags = [s > (low + high) / 2 for s in smooth] if new == (low, high) else flags
    return flags if high - low > 0.7 else [True] * n


def plain_main_text(tree):
    raw = plain_lines(tree)
    same = lambda a, b: a is b
    inside = lambda node: [n for child in node[2] if not isinstance(child, str) for n in [child, *inside(child)]]
    comment = lambda n: n[1] == "comments" and n[0] not in ("main", "body")
    by_tag = lambda n, path: n[0] in ("nav", "aside", "footer")

    def shown(hide):
        out, tags = [], 0
        for pieces, number in raw:
            tags += number
            seen = [(p, t) for p, t in pieces if not hide(p)]
            text = " ".join("".join(t for _, t in seen).split())
            if text:
                linked = sum(len(" ".join(t.split())) for p, t in seen if any(n[0] == "a" for n in p))
                out.append((next(p for p, t in seen if t.strip()), text, tags, linked))
                tags = 0
        return out

    firm = lambda path: any(comment(n) or by_tag(n, path) for n in path)
    every = shown(lambda p: False)
    flags = plain_content([len(t) / max(g, 1) for _, t, g, _ in every]) if every else []
    core = [(p, len(t)) for (p, t, *_), c in zip(every, flags, strict=True) if c and not firm(p)]

    def wrapper(n):
        held = sum(size for p, size in core if any(same(m, n) for m in p))
        tags = [n[0], *[m[0] for m in inside(n)]]
        return 2 * held > sum(size for _, size in core) and (any(t in ("h1", "h2", "article", "main") for t in tags) or tags.count("p") > 2)

    def furniture(n):
        if comment(n) or by_tag(n, None):
            return True
        if n[1] == "entry-header" and n[0] not in ("article", "form") and any(m[0] in ("h1", "h2") for m in [n, *inside(n)]):
            return False
        return n[0] not in ("main", "body") and (n[0] == "form" or n[1] == "ad" or (n[1] == "entry-header" and n[0] != "article")) and not wrapper(n)

    lines = shown(lambda p: any(furniture(n) for n in p))
    if not lines:
        return ""
    flags = plain_content([len(t) / max(g, 1) for _, t, g, _ in lines])
    links = [2 * k > len(t) for _, t, _, k in lines]
    whole = [next((n for n in p if n[0] in ("article", "main")), None) for p, *_ in lines]
    marked = sum(len(line[1]) for line, c, w in zip(lines, flags, whole, strict=True) if c and w)
    if marked and 2 * marked >= sum(len(line[1]) for line, c in zip(lines, flags, strict=True) if c):
        chosen = [w for w, c in zip(whole, flags, strict=True) if w and c]
        return "\n".join(t for (_, t, *_), w, k in zip(lines, whole, links, strict=True) if w and (any(same(w, x) for x in chosen) or not k))
    core = [i for i, c in enumerate(flags) if c and not links[i]] or [i for i, c in enumerate(flags) if c]
    common = [n for n in lines[core[0]][0] if all(any(same(n, m) for m in lines[i][0]) for i in core)]
    while common and common[-1][0] not in html.REGIONS:
        common.pop()
    holds = lambda p, n: any(same(n, m) for m in p)
    while len(common) > 1 and common[-2][0] != "body":
        extra = [line for line in lines if holds(line[0], common[-2]) and not holds(line[0], common[-1])]
        if 2 * sum(line[3] for line in extra) > sum(len(line[1]) for line in extra):
            break
        common.pop()
    return "\n".join(t for i, (p, t, *_) in enumerate(lines) if not common or holds(p, common[-1]) or (i < core[0] and p[-1][0] == "h1") or (flags[i] and not links[i]))


def test_extraction_equals_brute_force_on_random_pages():
    deal = random.Random(8)
    words = lambda n: " ".join(deal.choice(["alpha", "be", "gamma", "a", "delta"]) for _ in range(n))

    def grow(depth):
        tag = deal.choice(["div", "div", "section", "article", "main", "form", "nav", "aside", "footer", "ul"]) if depth else "body"
        name = deal.choice([None] * 8 + ["ad", "comments", "entry-header", "x"]) if depth and tag != "ul" else None
        leaf = lambda: (deal.choice(["p", "p", "h1", "h2"]), None, [words(deal.choice([1, 3, 12, 60])), *([("a", None, [words(3)])] if deal.random() < 0.2 else [])])
        if tag == "ul":
            return ("ul", None, [("li", None, [("a", None, [words(2)])] if deal.random() < 0.6 else [words(3)]) for _ in range(deal.randint(1, 5))])
        return (tag, name, [grow(depth + 1) if depth < 4 and deal.random() < 0.5 else leaf() for _ in range(deal.randint(1, 5))])

    def written(node):
        return node if isinstance(node, str) else f"<{node[0]}{f' class={node[1]}' if node[1] else ''}>{''.join(map(written, node[2]))}</{node[0]}>"

    for _ in range(400):
        tree = grow(0)
        assert html.main_text(written(tree)) == plain_main_text(tree), written(tree)[:500]


@pytest.mark.parametrize("markup, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<p>a &lt;b&gt; &#x263A;", "a <b> ☺"), ("<p>x<br>y", "x y"), ("<script>a", ""), ("<nav>menu<article><p>body", "body"), ("</p></div>a</b>", "a")])
def test_odd_markup(markup, text):
    assert html.main_text(markup) == text


def test_pages_hold_their_documents(spark):
    got = {r.page_id: r for r in queries.op5_html_extraction(spark, SMALL).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    right = 0
    for r in got.values():
        body = re.sub(r"\s*\n\s*", "\n", docs[int(re.search(r"/(\d+)", r.url.split("://")[1])[1])])
        right += r.text.split("\n", 1)[-1].replace("\n", " ") == " ".join(body.split()) and r.n_chars == len(r.text)
    assert right == len(got)


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, None, PAGE, "x"), (2, "u", None, None), (2, "u", None, None), (None, None, "<p>" + "long " * 50_000, "y")], "page_id long, url string, html string, text string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 4 and got.where("text is null").count() == 0
    assert html.extract(pages.where("false")).count() == 0


# 6. SimHash


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[tuple[int, int]], radius: int = 2) -> dict[int, int]:
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_simhash_equals_brute_force(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    got = simhash.near_duplicates(docs).collect()
    texts: dict[int | None, list] = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(f"{plain_fingerprint(r.text):016x}")
    assert len(got) == docs.count()
    for r in got:
        assert r.fingerprint in texts[r.doc_id] and (r.component_id is None) == (r.doc_id is None)
    want = plain_components([(i, int(f, 16)) for i, fs in texts.items() if i is not None and len(fs) == 1 for f in fs])
    single = {i for i, fs in texts.items() if i is not None and len(fs) == 1}
    twice = {i for i, fs in texts.items() if i is not None and len(fs) > 1}
    for r in got:
        if r.doc_id in single and r.component_id not in twice:
            assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("parts, most", [(4, 32_768), (8, 32_768), (4, 3), (8, 2)])
def test_tiles_miss_no_link(spark, parts, most):
    """Many fingerprints a few bits apart: chains and a dense group; whole and cut tiles."""
    deal = random.Random(3)
    prints = {deal.getrandbits(64) for _ in range(300)}
    for f in list(prints)[:60]:
        for _ in range(5):
            f ^= (1 << deal.randrange(64)) | (1 << deal.randrange(64))
            prints.add(f)
    dense = deal.getrandbits(64)
    prints |= {dense ^ (1 << i) for i in range(40)}
    numbered = list(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in numbered], "node long, fingerprint long")
    got = {r.node: r.component for r in graph.components(simhash.links(nodes, 2, parts, most)).collect()}
    want = plain_components(numbered)
    assert {i: got.get(i, i) for i, _ in numbered} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 80)] + [(500, 500), (None, 3), (1, 0), (1, 0)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(80)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7. Winnowing


def plain_winnow(text: str, k: int = 5, w: int = 16) -> list[tuple[int, int]]:
    words = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = []
    for i in range(max(len(words) - k + 1, min(1, len(words)))):
        seed = 42
        for x in words[i : i + k]:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        grams.append(seed >> 27)
    kept = set()
    for i in range(max(len(grams) - w + 1, min(1, len(grams)))):
        window = grams[i : i + w]
        kept.add((min(window), i + max(j for j, h in enumerate(window) if h == min(window))))
    return sorted(kept, key=lambda p: p[1])


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_equals_brute_force(spark, odd):
    unique = odd.where("doc_id is not null and doc_id <> 3").select("doc_id", "text")
    docs = unique.union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in winnowing.neighbours(docs).select("*", *[F.transform(winnowing.pairs(F.col(c)), lambda p: F.struct(p["hash"], p["position"])).alias(f"{c}_pairs") for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")]).collect()}
    assert len(got) == len(rows)
    for i, (number, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[number]
        assert r.edited_text == edited
        for found, source in ((r.fingerprint_pairs, text), (r.edited_fingerprint_pairs, edited), (r.next_fingerprint_pairs, after)):
            assert [tuple(p) for p in found] == plain_winnow(source)


def test_fingerprint_query(spark):
    got = queries.op7_document_fingerprints(spark, SMALL).toPandas().sort_values("doc_id")
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id").text.tolist()
    for i, r in enumerate(got.itertuples()):
        after = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + after[:half]
        own = plain_winnow(texts[i])
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(own, plain_winnow(edited))) and r.near_next == pytest.approx(jaccard(own, plain_winnow(after)))
    assert got.groupby(np.array(texts)).fingerprint.nunique().max() == 1


def test_ties_keep_the_rightmost(spark):
    docs = spark.createDataFrame([(1, "a " * 40), (2, "b"), (3, ""), (4, None)], "doc_id long, text string")
    found = {r.doc_id: [tuple(p) for p in r.p] for r in winnowing.with_fingerprint(docs, "text", "f").select("doc_id", winnowing.pairs(F.col("f")).alias("p")).collect()}
    assert found == {1: plain_winnow("a " * 40), 2: plain_winnow("b"), 3: [], 4: []} and [p for _, p in found[1]] == list(range(15, 36))


def test_next_rows_across_ranges(spark, odd):
    docs = spark.range(0, 5000).selectExpr("id * 7 as doc_id", "cast(id as string) as text")
    got = {r.doc_id: r.next_text for r in winnowing.with_next(docs, "doc_id", ["text"]).collect()}
    assert got == {i * 7: str((i + 1) % 5000) for i in range(5000)}
    assert winnowing.with_next(odd.select("doc_id", "text"), "doc_id", ["text"]).count() == odd.count()
    assert winnowing.neighbours(empty_documents(spark)).count() == 0
    one = winnowing.neighbours(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_text == "abab"


def test_next_rows_in_many_ranges(spark, monkeypatch):
    """Cuts, parts of them, and very many rows without an id, in ranges of a few rows."""
    for name, value in {"ROWS_PER_RANGE": 7, "MOST_CUTS": 5, "MOST_PARTS": 9}.items():
        monkeypatch.setattr(winnowing, name, value)
    docs = spark.range(0, 400).selectExpr("cast(id * id - 500 as bigint) as doc_id", "cast(id as string) as text")
    docs = docs.union(spark.range(0, 300).selectExpr("cast(null as bigint)", "concat('n', id)"))
    hashed = {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in (f"n{i}" for i in range(300))}
    order = [str(i) for i in range(400)] + sorted(hashed, key=lambda t: hashed[t] - (1 << 64) * (hashed[t] >> 63))
    got = {r.text: r.next_text for r in winnowing.with_next(docs, "doc_id", ["text"]).collect()}
    assert got == {t: order[(i + 1) % 700] for i, t in enumerate(sorted(order[:400], key=lambda t: int(t) ** 2) + order[400:])}


# 8. Mixing


def test_targets_equal_repeated_sharing(spark):
    deal = random.Random(2)
    for _ in range(4):
        sizes = {(f"s{i:02d}" if i else None): deal.choice([0, 5, 100, int(10 ** deal.uniform(1, 5))]) for i in range(deal.randint(1, 12))}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        names = sorted(s for s in sizes if s) + [None] * (None in sizes)
        weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
        want: dict = {}
        while rest := [n for n in names if n not in want]:
            share = (1.5 * sum(sizes.values()) - sum(want.values())) / sum(weight[n] for n in rest)
            full = {n: 2.0 * sizes[n] for n in rest if share * weight[n] > 2 * sizes[n]}
            want.update(full or {n: share * weight[n] for n in rest})
        assert got == pytest.approx(want)


def test_mixture_comes_near_its_targets(spark):
    got = queries.op8_mixing(spark, MIDDLE)
    rows = got.join(spark.read.parquet(f"{MIDDLE}/documents.parquet"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.max(F.col("taken") / F.col("size")).alias("x"))
    for r in rows.collect():
        assert abs(r.t - r.g) <= r.m and r.x <= 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.op8_mixing(spark, MIDDLE).collect()))


def test_mixture_on_odd_rows(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("taken > 2 * size or taken is null").count() == 0
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_better_documents_are_drawn_more(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'abcd efgh', '1234 5678') as text", "'only' as source")
    got = mixing.mix(docs).join(docs, "doc_id").groupBy("text").agg(F.sum((F.col("taken") > 2).cast("int")).alias("n")).collect()
    drawn = {r.text: r.n for r in got}
    assert drawn["abcd efgh"] > 1.5 * drawn["1234 5678"] and sum(drawn.values()) == 2000


# 9. Nearest neighbours


def plain_nearest(rows, every, k):
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    for i in np.flatnonzero(ids % every == 0):
        score = (matrix * matrix[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        yield ids[i], [(ids[j], score[j]) for j in order]


def test_neighbours_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    got: dict = {}
    for r in queries.op9_nearest_neighbours(spark, MIDDLE).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for query, want in plain_nearest(rows, 20, 20):
        hits += len({v for v, _ in want} & {v for v, _ in got[query]})
        total += len(want)
    assert hits / total >= 0.9


def clustered(spark, rows):
    deal = np.random.default_rng(4)
    centres = deal.normal(size=(40, 16))
    made = [(i, (centres[deal.integers(40)] + deal.normal(scale=0.2, size=16)).astype(np.float32).tolist()) for i in range(rows)]
    return made, spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(4)


def ranked(found):
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("options, least", [({"rerank": None}, 1.0), ({}, 0.9), ({"probes": 24}, 0.9), ({"probes": 24, "rerank": None}, 0.9), ({"metric": "l2"}, 0.9), ({"metric": "l2", "rerank": None}, 1.0)])
def test_neighbours_settings(spark, monkeypatch, options, least):
    """The exact setting equals brute force; probes and distances come near it; small blocks and groups."""
    for name, value in {"SMALL": 300, "LARGE": 500, "QUERIES": 30, "CODEBOOKS": 8}.items():
        monkeypatch.setattr(ann, name, value)
    made, df = clustered(spark, 1500)
    got = ranked(ann.search(df, **options))
    ids, matrix = np.arange(1500), np.array([v for _, v in made], dtype=np.float64)
    hits = 0
    for i in range(0, 1500, 20):
        score = -((matrix - matrix[i]) ** 2).sum(1) if options.get("metric") == "l2" else (matrix * matrix[i]).sum(1)
        want = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        hits += len(set(want) & {v for v, _ in got[i]})
        assert all(abs(s - score[v]) < 1e-9 for v, s in got[i]) and len(got[i]) == 20
    assert hits >= least * 1500


def test_coded_norms_are_those_of_the_sums():
    deal = np.random.default_rng(2)
    sample = deal.normal(size=(400, 12))
    books = ann.fit(sample)
    codes, norms = books.encode(sample.astype(np.float32))
    sums = sum(books.words[m][codes[:, m]] for m in range(len(books.words)))
    assert np.allclose(norms, (sums**2).sum(1), atol=1e-3)
    assert np.allclose(books.scores(sample[:5].astype(np.float32), codes), sums @ sample[:5].T, atol=1e-3)


def badly_coded(kind):
    deal = np.random.default_rng(8)
    plain = deal.normal(size=(2000, 200 if kind == "wide" else 16))
    stretch = {"long and short": deal.lognormal(sigma=2, size=(2000, 1)), "huge": 1e25, "tiny": 1e-25}.get(kind, 1)
    made = plain * stretch + (100 if kind == "far off" else 0)
    if kind == "clusters":
        made = deal.normal(size=(40, 16))[deal.integers(40, size=2000)] + 1e-3 * plain
    return made.astype(np.float32)


@pytest.mark.parametrize("metric", ["inner", "l2"])
@pytest.mark.parametrize("kind", ["wide", "long and short", "huge", "tiny", "far off", "clusters"])
def test_neighbours_of_rows_that_codes_fit_badly(spark, monkeypatch, kind, metric):
    """None of the nearest is missed, whatever the codes are worth."""
    for name, value in {"SMALL": 700, "SAMPLE": 300, "CODEBOOKS": 8}.items():
        monkeypatch.setattr(ann, name, value)
    made = badly_coded(kind)
    df = spark.createDataFrame(list(enumerate(made.tolist())), "vec_id long, embedding array<float>").repartition(4)
    got, ids, matrix = ranked(ann.search(df, rerank=40, metric=metric)), np.arange(len(made)), made.astype(np.float64)
    assert len(got) == len(made) / 20
    for i, found in got.items():
        score = -((matrix - matrix[i]) ** 2).sum(1) if metric == "l2" else (matrix * matrix[i]).sum(1)
        assert found == [(j, score[j]) for j in np.lexsort((ids, -score)) if j != i][:20]


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("kind", ["wide", "long and short", "huge", "tiny", "far off", "clusters"])
def test_no_score_passes_its_bound(monkeypatch, kind, far):
    monkeypatch.setattr(ann, "CODEBOOKS", 8)
    made = badly_coded(kind).astype(np.float64)
    centre = np.median(made[:300], axis=0)
    books = ann.fit(ann._directions(made[:300] - centre)[0])
    unit, lengths = ann._directions(made - centre)
    codes, norms = books.encode(unit)
    errors = ann._lengths(made - centre - lengths[:, None] * books.sums(codes))
    exact = np.array([ann._exact(made, q, far) for q in made[:100]])
    likely, most = ann._by_code(books, centre, made[:100], (codes, norms.astype(np.float64), lengths, errors), far)
    score, slack = ann._by_product(made, made[:100], far)
    assert likely.shape == exact.shape and (most >= exact).all() and (np.abs(score - exact) <= slack).all()


def test_neighbours_on_odd_vectors(spark):
    deal = np.random.default_rng(1)
    same = deal.normal(size=8).tolist()
    rows = [(i, deal.normal(size=8).tolist()) for i in range(60)] + [(100 + i, same) for i in range(100)]
    odd = [(200, None), (220, []), (240, [0.0] * 8), (260, [float("nan")] * 8), (280, [None] * 8), (300, [float("inf")] * 8), (320, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("rep", "score", "rank", "vector", "members")})
    got: dict = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    narrow = [(i, np.array(v, dtype=np.float32)) for i, v in rows]
    want = {q: [(n + 1, i, s) for n, (i, s) in enumerate(found)] for q, found in plain_nearest(narrow, 20, 20)}
    assert {q: [(n, i) for n, i, _ in x] for q, x in got.items()} == {q: [(n, i) for n, i, _ in x] for q, x in want.items()}
    assert all(abs(a[2] - b[2]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))
    assert ann.search(df.where("false")).count() == 0 and ann.search(df.where("vec_id in (20, 21)")).count() == 1


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
