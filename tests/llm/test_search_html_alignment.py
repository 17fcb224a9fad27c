"""Ranked search, main text of pages and token alignment against brute force and on odd inputs."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import alignment, html_blocks, windowed_search
from lexloom.llm.tokens import vocabulary_path

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "-- !", "a", "A b a B", "x " * 300, "Ünï çödé ñ 日本語 🙂 Ünï", "a\x1cb c　d\te", "tie one", "tie one", "the the the the"]
A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(ODD)] + [(3, "a", "again", "clash", 2), (None, "tie one", None, None, 3), (20, "b " * 700_000 + "tie", None, None, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, part string, score long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ranked search


def ranked(items, docs, most=50):
    """The contract, a document at a time; a missing id comes last."""
    cut = lambda x: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")]
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(cut(t))
    for i, words in asked.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if missing else d, -s) for k, (s, missing, d) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block_terms", [200_000, 300])
def test_search_against_brute_force(spark, docs, odd, block_terms):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").limit(20)
    extra = spark.createDataFrame([(900, None), (901, "nothing-of-it zzqq"), (902, "Tie ONE"), (902, "the 日本語"), (903, "b"), (None, "tie")], "item_id long, text string")
    items, every = items.unionByName(extra), docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = windowed_search.rank(items, every, block_terms=block_terms)
    want = ranked([tuple(r) for r in items.collect()], [tuple(r) for r in every.collect()])
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == want


def test_search_keeps_fewer_and_ties_by_id(spark, odd):
    items = spark.createDataFrame([(1, "tie"), (2, "the a")], "item_id long, text string")
    got = windowed_search.rank(items, odd, most=2)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == ranked([(1, "tie"), (2, "the a")], [tuple(r) for r in odd.select("doc_id", "text").collect()], 2)


def test_search_on_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "tie")], "item_id long, text string")
    assert windowed_search.rank(items, none).collect() == []
    assert windowed_search.rank(items.where("false"), odd).collect() == []


def test_windows_heaps_and_occupancy(monkeypatch):
    """Windows of 128 documents, ids repeated beyond a window, equal scores: the heap holds the best scores with the least ids."""
    monkeypatch.setattr(windowed_search, "WINDOW", 128)
    r = np.random.RandomState(3)
    ids = np.sort(np.concatenate([r.randint(0, 2000, 1500), np.full(400, 77)]))
    held = [np.sort(r.choice(6, r.randint(0, 4), replace=False)).astype(np.int32) for _ in ids]
    tf = [r.randint(1, 3, len(h)).astype(np.int64) for h in held]
    n = np.full(len(ids), 5)
    schema = ["doc_id", "n", "terms", "tf", "window"]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 97]), pa.array(n[k : k + 97]), pa.array(held[k : k + 97], pa.list_(pa.int32())), pa.array(tf[k : k + 97], pa.list_(pa.int64())), pa.array(ids[k : k + 97] >> 7)], names=schema) for k in range(0, len(ids), 97)]
    items = {1: ([0, 3], [7, 9]), 2: ([5], [4]), 3: ([11], [2])}
    found = windowed_search.scan(iter(batches), items, len(ids), int(n.sum()), 20).heaps
    for item, (terms, weights) in items.items():
        scores = []
        for d, h, t in zip(ids.tolist(), held, tf, strict=True):
            s = sum(w * (10**9 * int(t[list(h).index(x)]) // (1000 * int(t[list(h).index(x)]) + 20 * 100)) for x, w in zip(terms, weights, strict=True) if x in h)
            if s:
                scores.append((-s, d))
        assert sorted((-s, d) for s, _, d in found[item]) == sorted(scores)[:20]


def test_norms_beyond_64_bits():
    assert windowed_search.norms(np.array([10**9, 1]), 10**12, 10**13).tolist() == [50 + 50 * 10**9 * 10**12 // 10**13, 50 + 5]


# token alignment


def aligned(texts):
    """Both tokenisers over whole texts, groups and links by their definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    own = alignment.ByteLevel(A)
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    made = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        bytes_a, bytes_b = [own.bytes[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            made.append(None)
            continue
        span = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        span_a, span_b = span(bytes_a), span(bytes_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, span_a, strict=True) for y, (t, f) in zip(ids_b, span_b, strict=True) if s < f and t < e]
        cuts = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, (_, e) in zip(ids_a, span_a, strict=True) if start < e <= c) + "|" + ",".join(str(x) for x, (_, e) in zip(ids_b, span_b, strict=True) if start < e <= c))
            start = c
        made.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(x for m in made if m for x in m[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if m is None else (m[0], m[1], len(m[2]), len(m[3]), sum(count[x] == best[x[1]] for x in m[3]), sum(count[x] for x in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest())
        for m in made
    ]


TEXTS = [*ODD[:-1], "<|endoftext|> </s> <s> <0x41> <unk>", "▁marked", " two  spaces \n\n lines\t\ttabs \r\n end  ", "\n", "a\u0085b c᠎ d​ e﻿ f", "don't we'll I'm", "1234567890 3.14159", "日本語の文章です。", "é", "\x00\x01 nul"]
_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("part_links", [4_000_000, 300])
def test_alignment_against_brute_force(spark, docs, part_links):
    texts = [*TEXTS, *(r.text[:1500] for r in docs.orderBy("doc_id").limit(25).collect())]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, part string, pair long").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in _OUT) for r in alignment.align(frame, A, B, part_links=part_links).collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)


def test_chunks_are_encoded_as_in_the_whole_text(docs):
    own = alignment.aligner(A, B)
    for text in [*filter(None, TEXTS), *(r.text for r in docs.limit(30).collect())]:
        parts = own.chunks(text)
        assert "".join(parts) == " " + text
        assert [i for ids in own.a.encode(parts) for i in ids] == own.a.encode([" " + text])[0]
        if own.b.unchanged(text):
            assert [i for ids in own.b.encode(parts) for i in ids] == own.b.codec.encode([text])[0].tolist()


def test_alignment_of_nothing_nulls_and_long_texts(spark, none):
    assert alignment.align(none, A, B).collect() == []
    frame = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "word and word " * 80_000)], "doc_id long, text string")
    got = {(r.doc_id, r.n_links) for r in alignment.align(frame, A, B).collect()}
    assert (None, 2) in got and (1, 0) in got and max(n for d, n in got if d == 2) >= 240_000
    assert alignment.groups(frame, A, B).where("doc_id is null").first().groups[0].asDict()["a"]


# main text of pages


@pytest.fixture(scope="module")
def tree(spark):
    return html_blocks.train(html_blocks.labelled(spark))


def main_of(tree, html):
    found = html_blocks.blocks(html)
    return [b.text for b, keep in zip(found, tree.predict(html_blocks.features([found])), strict=True) if keep]


def test_pages_against_their_articles(spark, tree):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_blocks.extract(pages, tree).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = (" ".join(unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?p>|</?h1>", body))
        assert got[r.page_id] == "\n".join(filter(None, parts))


LONG = "This sentence has enough words to count as a paragraph of running text, and it goes on for a while so that nobody takes it for a label. " * 2


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>Title</h1><p>One.<p>Two</article><footer>&copy; us</footer>", ["Title", "One.", "Two"]),
        (f"<div class=cookie-banner>We use cookies</div><main><p>{LONG}</p></main><div class='ad'>{LONG}</div>", [LONG.strip()]),
        (f"<article><p>Kept</p><aside><p>{LONG}</p></aside><p>Also</p><section class=comments><p>{LONG}</p></section></article>", ["Kept", "Also"]),
        (f"<form id=page><article><p>Kept</p></article></form><form><p>Your name</p><input></form>", ["Kept"]),
        (f"<body class='has-sidebar'><div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", [LONG.strip()] * 2),
        ("<article><p>a&nbsp;&amp;&lt;b&gt; &amp b &#233;&#x1F642; &unknown; x < y</p></article>", ["a &<b> & b é🙂 &unknown; x < y"]),
        ("<article><p>one<br>two<!-- no --> three<script>var a = '<p>no</p>';</script><style>p{}</style></p></article>", ["one two three"]),
        ('<article><p title="a > b">quoted</p><p data-x=\'"\'>mark</p><p it\'s>odd</p></article>', ["quoted", "mark", "odd"]),
        ("<article><p>shown</p><p hidden>not</p><p style='display: none'>not</p></article>", ["shown"]),
        ("<article><p>end <a hre", ["end"]),
        ("<article><p>x</p><!-- open <p>y</p>", ["x"]),
        ("<ARTICLE><P>Case</P></ARTICLE>", ["Case"]),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", ["one", "two", "a", "b"]),
        ("", []),
        ("no markup", ["no markup"]),
    ],
)
def test_markup(tree, html, want):
    assert main_of(tree, html) == want


def test_pages_of_odd_rows(spark, tree):
    rows = [(1, "u", "<article><p>a</p></article>", "t", 9), (1, "u", "<article><p>a</p></article>", "t", 9), (None, None, None, None, None), (2, None, "", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, words long")
    got = html_blocks.extract(pages, tree)
    assert rows_of(got, "page_id", "url", "text", "n_chars") == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0)], key=str)
    assert html_blocks.extract(pages.where("false"), tree).collect() == []


@pytest.mark.parametrize("unit", ["<p>text</p>", "<", "<a ", '<p a="', "<div>", "</div>", "<!--", "&amp", "<li><div>", "<script>", "<a href='x'>y "])
def test_long_pages_take_time_in_proportion(unit):
    began = time.perf_counter()
    html_blocks.blocks(unit * (1_500_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_tree_reads_what_spark_fitted(spark, tree):
    rows = html_blocks.labelled(spark).toPandas()
    assert (tree.predict(rows[list(html_blocks.FEATURES)].to_numpy()) == (rows["label"].to_numpy() == 1)).mean() > 0.995


def test_layouts_left_out_of_training(spark):
    """Held-out layouts: trained without every fifth page, measured on those."""
    pages = [html_blocks.blocks(x) for x in html_blocks._layouts()]
    x, y = html_blocks.features(pages), np.array([b.text.startswith("m") for p in pages for b in p])
    out = np.repeat(np.arange(len(pages)) % 5 == 0, [len(p) for p in pages])
    names = ", ".join(f"{c} double" for c in (*html_blocks.FEATURES, "label"))
    fitted = html_blocks.train(spark.createDataFrame([(*map(float, f), float(z)) for f, z in zip(x[~out], y[~out], strict=True)], names))
    assert (fitted.predict(x[out]) == y[out]).mean() > 0.97
