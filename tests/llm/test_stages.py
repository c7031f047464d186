"""The pipeline's stages on columns of any name, nulls, ties, repeated rows, and very long texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

import corpus_pipeline
from marketlens.llm import pii

EXTRA = ["my col", "a,b:c", "_contaminated", "contaminated", "other_id", "_gone", "_again", "_row", "id", "row", "key", "terms", "spans",
         "carried", "total", "`tick`"]


def documents(spark, rows):
    fields = [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
              StructField("n_chars", IntegerType()), *[StructField(c, StringType()) for c in EXTRA]]
    return spark.createDataFrame([(i, t, "en", len(t or ""), *["x"] * len(EXTRA)) for i, t in rows], StructType(fields))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    word = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) + "o" for i in range(400)]
    item = " ".join(rng.choices(word, k=40))
    spark.createDataFrame([(1, item), (2, "too short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 0, int(i % 10 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = [(i, " ".join(rng.choices(word, k=60)) + (f" you stupid grobnak {rng.choice(word)} grobnak" if i % 10 == 0 else "")) for i in range(200)]
    rows += [(300, rows[1][1]), (301, rows[1][1] + " more"), (302, f"intro {item} outro"), (303, "mail bob@example.org or +44 20 7946 0958 now"),
             (304, None), (305, ""), (None, "no id here at all"), (None, None), (306, " ".join(rng.choices(word, k=30_000))),
             (307, "same"), (307, "same"), (307, "same id, other text")]
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    return d


def test_every_stage_keeps_any_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.collect()


def test_whole_chain_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    kept = set(rows)
    assert {300, 301, 302} & kept == set() and {1, 303, 304, 305, 306, 307, None} <= kept
    toxic = {i for i in range(0, 200, 10)}
    assert len(toxic & kept) <= 2 and len(set(range(200)) - toxic - kept) <= 2
    import hashlib
    plain = {r.doc_id: r.text for r in docs.where("doc_id < 200").collect()}
    for i in (kept & set(range(200))) - toxic:
        assert rows[i].decoded_sha256 == hashlib.sha256(plain[i].encode()).hexdigest()
    left = docs.where(F.col("doc_id").isin(*[i for i in kept if i is not None]) | F.col("doc_id").isNull())
    masked = {r.doc_id: r.text for r in corpus_pipeline.pii(spark, left, sf_dir).where("doc_id = 303").collect()}[303]
    assert "[EMAIL]" in masked and "[PHONE]" in masked and "bob" not in masked and "7946" not in masked
    assert rows[303].decoded_sha256 == hashlib.sha256(masked.encode()).hexdigest()


def test_empty_tables(spark, sf_dir, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    full = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, full, d).count() > 0


def test_many_mentions_in_one_text_take_linear_time(spark):
    import time
    text = lambda n: " ".join(f"word{chr(97 + i % 26)} user{i}@mail{i % 7}.example.com said" for i in range(n))
    import pyarrow as pa
    took = []
    for n in (2000, 8000):
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text(n)])], names=["id", "text"])
        t = time.process_time()
        out = list(pii._windows([batch]))
        took.append(time.process_time() - t)
        assert sum(b.num_rows for b in out) > n
    assert took[1] < 8 * took[0] + 0.5


def test_outside_is_what_a_look_at_every_span_says():
    rng = random.Random(4)
    for _ in range(300):
        cover = sorted((a, a + rng.randint(1, 9)) for a in rng.choices(range(60), k=rng.randint(0, 8)))
        free = pii._outside(cover)
        for s in range(60):
            for size in (1, 3, 7):
                m = type("M", (), {"start": lambda self, s=s: s, "end": lambda self, s=s, k=size: s + k})()
                assert free(m) == (not any(a < s + size and s < e for a, e in cover))


def test_cards_and_phones_by_brute_force():
    """All digit runs of a text, by the rule: 13 to 19 digits that pass Luhn, 9 to 15 after a plus."""
    import re
    rng = random.Random(9)

    def luhn(d):
        s = 0
        for k, c in enumerate(d[::-1]):
            v = int(c) * (2 if k % 2 else 1)
            s += v // 10 + v % 10
        return s % 10 == 0
    found = 0
    for _ in range(400):
        text = "".join(rng.choice(["4111 1111 1111 1111", "5500-0000-0000-0004", " ", "a", "7", "42 ", "+44 20 7946 0958", "+1", "(555)", "-", "0000 0000",
                                   "123456789012345", "é"]) for _ in range(rng.randint(1, 9)))
        want = []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub(r"[^0-9]", "", m[0])
            want += [("card", m.start(), m.end())] * (13 <= len(d) <= 19 and luhn(d))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            want += [("phone", m.start(), m.end())] * (9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15)
        got = [s for s in pii.base_spans(text) if s[0] in ("card", "phone")]
        assert got == want
        found += len(want)
    assert found > 50


def test_toxicity_training_rows_are_bounded_in_rows(spark):
    from marketlens.llm.toxicity import training_rows
    ids = [i for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    docs = spark.createDataFrame([(0, f"text {k}") for k in range(3000)] + [(4, "one text")] * 2000 + [(i, f"t {i}") for i in ids[5:]],
                                 "id long, text string")
    n = training_rows(docs, labels, 4, 2, 100).count()
    assert 0 < n <= 160


# ------------------------------------------------------------ pages without an article
LONG = "A long paragraph of an article that goes on for quite a while, with commas, clauses and a full stop at its end. " * 3


@pytest.mark.parametrize("html, want", [
    (f"<div class='content has-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG]),
    (f"<div class='page no-comments'><p>{LONG}</p></div>", [LONG]),
    (f"<div id='related-work'><p>{LONG}</p></div>", [LONG]),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article>", ["Title", LONG]),
    (f"<div class='wrap sidebar'><main><p>{LONG}</p></main></div>", [LONG]),
    (f"<div><div>Title here</div><div><p>{LONG}</p><p>{LONG}</p></div><div>Closing words.</div></div>",
     ["Title here", LONG, LONG, "Closing words."]),
    (f"<div class='site-nav'><a>Home</a></div><div><p>{LONG}</p></div><div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div>", [LONG]),
    (f"<div class='ad'>{LONG}</div><p>{LONG}<button>Share this</button> indeed</p><div class='cookie-bar'>We use cookies</div>", [LONG + "indeed"]),
    (f"<p>{LONG}</p><p>Short.</p><aside>{LONG}</aside><p>After it.</p><p>{LONG}</p>", [LONG, "Short.", "After it.", LONG]),
    ("<p>hi</p>", ["hi"]), ("<nav>x</nav>", []), ("", []), (None, []), ("<script>var x = '<p>no</p>';</script>", []),
    ("<div class='sidebar'><p>all there is</p></div>", ["all there is"])])
def test_pages_without_an_article(html, want):
    from marketlens.llm.html_text import main_text
    assert main_text(html) == "\n".join(x.strip() for x in want)


def test_link_lists_go_by_their_ratio_alone():
    """No element or class tells these menus: only the cluster and the share of links do."""
    from marketlens.llm import html_text
    menu = "".join(f"<div><a href='/{i}'>Topic {i}</a></div>" for i in range(8))
    page = f"<body>{menu}<div><p>{LONG}</p><p>See <a href='/x'>this</a>.</p><p>{LONG}</p></div>{menu}</body>"
    got = html_text.main_text(page).split("\n")
    assert [x for x in got if x.startswith("Topic")] == ["Topic 7", "Topic 0"][:len([x for x in got if x.startswith("Topic")])]
    assert [x for x in got if not x.startswith("Topic")] == [LONG.strip(), "See this.", LONG.strip()]
    flat = html_text.main_text(page, link_share=2.0).split("\n")
    assert len(flat) > len(got)


def test_smoothing_and_threshold_by_brute_force():
    import math

    import numpy as np

    from marketlens.llm import html_text
    rng = np.random.default_rng(6)
    for _ in range(200):
        x = rng.exponential(20, int(rng.integers(1, 30)))
        k = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
        want = np.convolve(x, k, "full")[2:-2] / np.convolve(np.ones_like(x), k, "full")[2:-2]
        got = html_text._smooth(list(x), 1.0, 2)
        assert np.allclose(got, want)
        edge = min(np.mean(got), math.sqrt(np.mean((np.array(got) - np.mean(got)) ** 2)))
        assert html_text.cluster(got) == [v >= edge for v in got]


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "text" + "</div>" * n, lambda n: "<body>" + "<span>x" * n + "</b>" * n,
                                  lambda n: "<ul><li>x" * n, lambda n: "<p><a>" * n + "end", lambda n: "<div class='ad'>" * n + "x"])
def test_deep_pages_take_linear_time(make):
    import time

    from marketlens.llm.html_text import main_text
    took = []
    for n in (2000, 16000):
        t = time.process_time()
        main_text(make(n))
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0] + 0.3


# ------------------------------------------------------- queries on empty tables and clashing columns
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars int, id string, key string, spans string",
    "labels": "doc_id long, quality int, toxic int, id string", "benchmark": "item_id long, text string, doc_id string",
    "pages": "page_id long, url string, html string, text string, row string",
    "embeddings": "vec_id long, embedding array<float>, id string, score string",
    "conversations": "conv_id long, turn long, role string, text string, seg string, idx string",
}


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["op1_exact_topk", "op2_decontamination", "op4_toxicity", "op5_katz_lm", "op6_html_extraction", "op7_pii",
                                  "op8_language_id", "op9_warc", "op10_byte_bpe", "op11_conversation_repair",
                                  "op12_lexical_search", "op13_repeated_bytes"])
def test_queries_on_empty_tables(spark, empty_dir, name):
    from marketlens.llm import queries
    assert queries.queries()[name](spark, empty_dir).count() == 0
