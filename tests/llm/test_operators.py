"""Each operator against a brute-force version on small fixtures, with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, score string, n_tokens string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def make_docs(spark, texts, langs=None):
    """Documents with two extra columns whose names clash with results."""
    rows = [(i, t, (langs or {}).get(i, "en"), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def shingles(t):
    w = WORD.findall(lower_az(t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def words(rng, n):
    return " ".join("w%d" % x for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "é ß")]
    base = words(rng, 120).split()
    for k in range(12):
        w = list(base)
        for j in rng.integers(0, 120, k):
            w[j] = f"edit{k}_{j}"
        out.append((10 + k, " ".join(w)))
    out += [(40, out[8][1]), (41, out[8][1]), (50, words(rng, 30_000))]
    line = "this very common line is shared by many documents of the corpus"
    out += [(100 + k, f"{line} {words(rng, 30)} {line}") for k in range(40)]
    return out + [(None, out[8][1]), (None, None)]


def test_topk_matches_brute_force(spark):
    from marketlens.llm.topk import exact_topk
    rng = np.random.default_rng(1)
    vecs = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    vecs += [(300, vecs[0][1]), (301, None), (302, [float("nan")] * 8), (303, [1.0] + [None] * 7), (None, vecs[1][1]),
             (304, [1.0, 2.0]), (5, vecs[5][1]), (400, [float("inf")] * 8), (500, vecs[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in exact_topk(df, F.col("id") % 100 == 0, k=4, query_block=2, shard_rows=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in vecs
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in ok if i % 100 == 0):
        want = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        assert got[q] == [(i, -s) for s, i in want[:4]]
    assert exact_topk(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_decontamination_matches_brute_force(spark, texts):
    from marketlens.llm.decontaminate import contained_items, without_contaminated
    docs = make_docs(spark, texts)
    by = dict(texts)
    items = [(1, by[10][:200]), (2, "one two"), (3, None), (4, ""), (None, by[10][:200]), (5, "not in any document at all"),
             (6, " ".join(by[50].split()[9000:9030]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contained_items(docs, bench).collect()}

    def grams(t, k):
        w = WORD.findall(lower_az(t or ""))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, t in items:
        n = min(5, len(WORD.findall(t or "")))
        if i is None or not n:
            continue
        own = grams(t, n)
        for d, x in texts:
            both = len(own & grams(x, n))
            if 100 * both >= 75 * len(own):
                want.add((d, i, both, len(own)))
    assert got == want and want
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    hit = {d for d, *_ in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, t in texts if d not in hit or (d is None and t is None))
    assert contained_items(docs, bench.limit(0)).count() == 0


def test_jaccard_join_matches_brute_force(spark, texts):
    from marketlens.llm.jaccard_join import linked_components, without_duplicates
    docs = make_docs(spark, texts)
    sets = {i: shingles(t) for i, t in texts if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = linked_components(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {find(i) for i in ids} | {None}
    assert linked_components(docs.limit(0)).count() == 0


def test_signature_bound_holds():
    from marketlens.llm.jaccard_join import _signature, difference_bound
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (30, 700), (5000, 5200), (9000, 100)):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, m).astype(np.uint64) * np.uint64(2)]))
        assert difference_bound(_signature(x), _signature(y)) <= len(np.setxor1d(x, y))
        assert difference_bound(_signature(x), _signature(x)) == 0


def test_toxicity_learns_and_keeps_clean(spark):
    from marketlens.llm.toxicity import score, without_toxic
    rng = np.random.default_rng(5)
    texts, labels = [(0, None), (1, "")], []
    for i in range(2, 400):
        w = words(rng, 40).replace("w", "").split()
        w = ["".join("abcdefghij"[int(c)] for c in x) for x in w]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), ("zorgon", "blightx" + w[0])[int(rng.integers(0, 2))])
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = make_docs(spark, texts)
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in score(docs, lab).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[i].predicted, t) for i, t in labels if rows[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    kept = without_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted == 0}
    assert score(docs, lab.limit(0)).count() == len(texts) and score(docs.limit(0), lab).count() == 0


def test_toxicity_keeps_insults_of_copied_texts(spark):
    from marketlens.llm.toxicity import fit
    rng = np.random.default_rng(12)
    name = lambda: "".join("abcdefghij"[c] for c in rng.integers(0, 10, 5))
    vocab = [name() for _ in range(2000)]
    some = lambda n: " ".join(vocab[i] for i in rng.integers(0, 2000, n))
    copied = f"{some(20)} zorgon {some(20)}"
    for copies in ([copied] * 200, [f"{copied} {some(2)}" for _ in range(200)]):  # exact and near copies
        rows = [(t, 1) for t in copies]
        rows += [(f"{some(10)} {'zorgon' if i % 8 == 0 else 'blight'} {some(10)}", 1) for i in range(400)]
        rows += [(some(30), 0) for _ in range(600)]
        weights, _ = fit(spark.createDataFrame(rows, "text string, toxic int"))
        assert weights.get("zorgon", 0) > 1.5 and weights["blight"] > weights["zorgon"]


def test_toxicity_grammar_weighs_clauses():
    from marketlens.llm.toxicity import Lexicon
    lex = Lexicon({"fool": 3.0, "dolt*": 2.0})
    plain = lex.evidence("a fool")
    assert plain == 3.0 and lex.evidence("doltish") == 2.0 and lex.evidence("") == 0.0
    assert lex.evidence("you fool") > plain > lex.evidence("not a fool") > 0
    assert lex.evidence("it said a fool") < plain
    assert lex.evidence("you. a fool") == plain


def test_katz_matches_brute_force_and_normalises(spark, texts):
    from marketlens.llm import katz
    docs = make_docs(spark, texts).where("doc_id is not null")
    got = {r.doc_id: r for r in katz.score(docs, phi=0.0005).collect()}
    tok = {i: lower_az(t or "").encode().split() + [b""] for i, t in texts if i is not None}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    voc = {w for w, k in c.items() if k >= math.ceil(0.0005 * n)} | {b""}
    start, b = "<s>", Counter()
    for i, ws in tok.items():
        if not held[i]:
            b.update((h, w) for h, w in zip([start] + ws, ws) if (h in voc or h == start) and w in voc)
    coc = lambda x: {r: sum(k == r for k in x.values()) for r in range(1, 7)}
    uni, d = katz.Unigrams(n, v, coc(c)), katz.discounts(coc(b))
    pu = lambda w: float(uni.p(np.array([c[w]]))[0])
    assert abs(sum(map(pu, c)) + uni.unknown - 1) < 1e-9
    ch = {**c, start: sum(not h for h in held.values())}
    seen, low = defaultdict(float), defaultdict(float)
    for (h, w), k in b.items():
        seen[h] += d[min(k, 6)] * k / ch[h]
        low[h] += pu(w)
    for i, ws in tok.items():
        total = 0.0
        for h, w in zip([start] + ws, ws):
            least = 1 / (ch.get(h, 0) + 1)
            tight = h in seen and 1 - seen[h] < least
            k = b.get((h, w), 0)
            if k:
                total += math.log10(d[min(k, 6)] * k / ch[h] * ((1 - least) / seen[h] if tight else 1))
            else:
                alpha = (least if tight else 1 - seen[h]) / (1 - low[h]) if h in seen else 1.0
                total += math.log10(alpha * pu(w))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held[i])
        assert r.score == pytest.approx(total, rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


def test_katz_counts_bigrams_of_rare_words(spark):
    from marketlens.llm import katz
    rng = np.random.default_rng(11)
    texts = [(i, words(rng, 1500)) for i in range(100)]  # 128,000 training tokens: an edge of 1e-5 is a count of 2
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rare = next(i for i in range(1000, 2000) if not is_held(i))
    probe = next(i for i in range(2000, 3000) if is_held(i))
    texts.append((rare, "rareleft rareright"))
    held = {i: is_held(i) for i, _ in texts}
    docs = make_docs(spark, texts + [(probe, "rareleft rareright")])
    got = {r.doc_id: r for r in katz.score(docs).collect()}
    c, b = Counter(), Counter()
    for i, t in texts:
        if not held[i]:
            ws = ["<s>", *t.split(), ""]
            c.update(ws[1:])
            b.update(zip(ws, ws[1:]))
    coc = lambda x: {r: sum(k == r for k in x.values()) for r in range(1, 7)}
    uni, d = katz.Unigrams(sum(c.values()), len(c), coc(c)), katz.discounts(coc(b))
    n_start = sum(not h for h in held.values())
    assert c["rareleft"] == 1 and b["<s>", "rareleft"] == 1

    def p(h, w, ch):
        """One history's probability of a seen word; its followers here are all of count 1."""
        seen = sum(d[min(k, 6)] * k for (x, _), k in b.items() if x == h) / ch
        least = 1 / (ch + 1)
        return d[1] / ch * ((1 - least) / seen if 1 - seen < least else 1)
    want = math.log10(p("<s>", "rareleft", n_start)) + math.log10(p("rareleft", "rareright", 1)) \
        + math.log10(p("rareright", "", 1))
    assert got[probe].score == pytest.approx(want, rel=1e-9) and got[rare].score == pytest.approx(want, rel=1e-9)
    assert katz.score(docs.limit(0)).count() == 0


def test_katz_discounts_copied_counts_by_good_turing():
    from marketlens.llm import katz
    n = {1: 9000, 2: 3000, 3: 1500, 4: 500, 5: 900, 6: 400}  # copies in fives: n5 > n4
    d = katz.discounts(n)
    share = n[1] / (n[1] + 2 * n[2])
    assert all(0 < x < 1 for x in d[1:6]) and list(d[1:6]) == sorted(d[1:6]) and d[6] == 1
    assert not np.allclose(d[1:6], [(r - share) / r for r in range(1, 6)])
    # Counts that follow r**-2.5 exactly are discounted as unsmoothed Good-Turing does.
    n = {r: 1e6 * r ** -2.5 for r in range(1, 7)}
    a = 6 * n[6] / n[1]
    assert katz.discounts(n)[1:6] == pytest.approx([((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)], rel=1e-9)


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>menu one</a><li><a>two</a></ul></nav><div class="cookie-notice">We use
cookies</div><aside>side</aside><article><h1>Title  &eacute;</h1><p>First <b>block of
text that is long enough to be content.<br><p>Short.</p><form><input>Name</form><div class=ad>Buy</div><p>Last &#8212; one of
the blocks of the article, and it is long too.</p></article><section id="comments"><p>A reader says something rather long here.
</p></section><footer>&copy; x</footer></body></html>"""


def test_html_extraction_cases(spark):
    from marketlens.llm.html_text import extract, main_text
    assert main_text(PAGE) == ("Title é\nFirst block of text that is long enough to be content.\nShort.\n"
                               "Last — one of the blocks of the article, and it is long too.")
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain text & more") == "plain text & more"
    long = "word " * 200_000
    assert main_text(f"<p>{long}</p>") == long.strip()
    df = spark.createDataFrame([(1, "u", PAGE, "z"), (None, None, None, None), (1, "u", PAGE, "z")],
                               "page_id long, url string, html string, text string")
    rows = extract(df).collect()
    assert Counter(r.n_chars for r in rows) == {0: 1, len(main_text(PAGE)): 2}


def test_pii_base_spans_match_the_patterns(spark):
    from marketlens.llm.pii import base_spans, report, sanitise, sanitised
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(2)
    alphabet = list("ab1209.@+- ()%_é\n")
    for _ in range(400):
        t = "".join(rng.choice(alphabet, 120))
        got = base_spans(t)
        assert [(s, e) for k, s, e in got if k == "email"] == [m.span() for m in email.finditer(t)]
        assert [(s, e) for k, s, e in got if k == "ip"] == [
            m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    text = "é mail a.b@c.de ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, phone +1 (415) 555-0199."
    docs = make_docs(spark, [(1, text), (2, None), (3, "clean"), (None, text), (1, text)])
    rows = report(sanitise(docs)).collect()
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest() and len(rows) == 5
    out = sanitised(docs)
    assert out.columns == docs.columns
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[1] == "é mail [EMAIL] ip [IP] or 10.0.0.256, card [CARD], phone [PHONE]." and clean[3] == "clean"
    assert clean[2] is None and base_spans("a" * 200_000 + "@") == [] and sanitise(docs.limit(0)).count() == 0


def test_pii_terms_that_give_an_entity_away(spark):
    from marketlens.llm.pii import sanitised
    rng = np.random.default_rng(4)
    texts = [(i, words(rng, 20).replace("w", "word ")) for i in range(100)]
    texts += [(200 + k, f"plain{k} alpha Zebulon writes from boss@corp.example daily beta{'abcdef'[k]}x") for k in range(6)]
    got = {r.doc_id: r.text for r in sanitised(make_docs(spark, texts)).collect()}
    assert all("Zebulon" not in got[200 + k] and "[EMAIL]" in got[200 + k] for k in range(6))
    assert all(got[i] == t for i, t in texts[:100])


def test_pii_terms_of_an_entity_mentioned_once(spark):
    from marketlens.llm.pii import sanitised
    texts = [(i, "contact them at the office today") for i in range(250)]
    texts += [(300, "Contact Zebulon at solo@corp.example today"), (None, "Contact Quillon at none@corp.example today")]
    # Copies are one window; a frequent address's terms need more windows, and reach all rows of a document's id.
    texts += [(400 + k, "Contact Wendelin at copy@corp.example today") for k in range(30)]
    texts += [(500 + k, f"office Xavier from boss@corp.example only{'abcdef'[k]}") for k in range(6)] + [(500, "so xavier")]
    got = defaultdict(list)
    for r in sanitised(make_docs(spark, texts)).collect():
        got[r.doc_id].append(r.text)
    assert got[300] == got[None] == ["Contact [WORD] at [EMAIL] today"]
    assert got[400] == ["Contact Wendelin at [EMAIL] today"] and got[0] == [texts[0][1]]
    assert sorted(got[500]) == ["office [WORD]  [EMAIL] onlya", "so [WORD]"]


def test_pii_windows_reach_over_long_gaps():
    import pyarrow as pa

    from marketlens.llm.pii import _windows
    text = f"one two {'x' * 400} {'7 ' * 400}a@b.cd{' ' * 500}three éèàe@f.gh four"
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1], pa.int64()), "text": [text]})
    got = {(e, c) for b in _windows([batch]) for e, c in zip(*(b.column(k).to_pylist() for k in (1, 2))) if e}
    assert got == {("email:a@b.cd", f"one two {'x' * 400} three four"), ("email:e@f.gh", f"one two {'x' * 400} three four")}


def test_language_id(spark):
    from marketlens.llm.langid import identify
    rng = np.random.default_rng(6)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "zer", "önt"]}
    texts, langs = [(0, None), (1, "12 34 !?"), (2, "")], {0: "aa", 1: None}
    for i in range(3, 300):
        langs[i] = ("aa", "bb")[i % 2]
        texts.append((i, " ".join("".join(rng.choice(parts[langs[i]], 3)) for _ in range(30))))
    langs[7] = None
    rows = {r.doc_id: r for r in identify(make_docs(spark, texts, langs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2))
    held = [i for i, r in rows.items() if r.held_out and i > 2]
    assert held and all(rows[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= rows[i].score <= 1 for i in held)
    none = identify(make_docs(spark, texts).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_warc_round_trip_and_ranges(spark, tmp_dir):
    from marketlens.llm.warc import archive_round_trip, read_archives, with_keeper, write_archives
    rng = np.random.default_rng(8)
    pages = [(i, f"http://x/{i} y\n", "".join(map(chr, rng.integers(33, 1000, 3000)))) for i in range(60)]
    pages += [(100, "u", "same"), (101, None, "same"), (102, "u", "same"), (103, "u", ""), (104, "u", None), (None, "u", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int")
    got = {r.page_id: r for r in archive_round_trip(df, range_bytes=1000).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        keeper = {"same": 102, "": 104}.get(h or "", i)
        assert (r.record_type, r.refers_to) == (("response", None) if i == keeper else ("revisit", keeper))
        assert r.payload == (raw if i == keeper else None) or bytes(r.payload) == raw
    src = df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    manifest = write_archives(with_keeper(src, min_bytes=1), tmp_dir + "/w")
    rows = read_archives(manifest, range_bytes=333).collect()
    assert len(rows) == len(pages) and {r.record_type for r in rows if r.page_id in (103, 104)} == {"response"}
    assert archive_round_trip(df.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    from marketlens.llm.bpe import encode
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(9)
    alphabet = list("ab  \n\t'sé漢1² \x1c!?") + ["the ", " ing"]
    texts = ["".join(rng.choice(alphabet, 200)) for _ in range(200)]
    texts += [None, "", " ", "  a", "a ", "a  b", "\n \n x", "x" * 5000, "ab" * 3000 + " c", "<|endoftext|>", "I'll don't"]
    docs = make_docs(spark, list(enumerate(texts)))
    rows = {r.doc_id: r for r in encode(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert np.frombuffer(bytes(rows[i].ids), dtype="<u4").tolist() == ids and rows[i].n_tokens == len(ids)
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_pipeline_stages(spark, texts):
    import os

    import corpus_pipeline
    from marketlens.llm.common import stored
    sf = os.environ.get("MARKETLENS_TEST_SF", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip(f"{sf} not present")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    left = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= left and len(now) == out.count()
        docs, left = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.collect()} == left


def test_one_pass_makes_the_classes_and_the_shingle_counts():
    import zlib

    import numpy as np
    import pyarrow as pa

    from marketlens.llm import jaccard_join
    texts = ["a b c d e f g", "a b c d e f g", "", None, "x y"]
    given = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, None], pa.int64()), pa.array(texts)], names=["id", "text"])
    out = pa.Table.from_batches(jaccard_join._classes(iter([given]))).to_pylist()
    rows, blocks = [r for r in out if r["block"] is None], [r for r in out if r["block"] is not None]
    assert [r["n"] for r in rows] == [3, 3, 0, 0, 1] and [r["doc_id"] for r in rows] == [1, 2, 3, 4, None]
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64) for r in blocks])
    assert sorted(counts[counts > 0]) == [2, 2, 2]  # a row without an id isn't counted
    assert list(jaccard_join._classes(iter([]))) == []


def test_windows_of_many_mentions_come_in_small_batches():
    import pyarrow as pa

    from marketlens.llm import pii
    text = " ".join(f"mail{'abcdefghij'[i % 10]} word{'klmnopqrst'[i // 10 % 10]} user{i}@example.org" for i in range(20_000))
    given = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([text, "no mention"])], names=["id", "text"])
    out = list(pii._windows(iter([given])))
    assert max(b.num_rows for b in out) < 2 * pii.ROWS_AT_ONCE < sum(b.num_rows for b in out)
    rows = {tuple(r.values()) for b in out for r in b.to_pylist()}
    assert len({e for _, e, _, _ in rows if e}) == 20_000 and all(i == 1 for i, *_ in rows)
