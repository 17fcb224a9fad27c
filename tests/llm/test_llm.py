"""The training-data operators against brute force, round trips and edge cases."""

import gc
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lexloom.llm import components, jaccard_join, lattice_dedup, line_dedup, mpegts, packing, pii, rule_ensemble, sentencepiece_codec, textkit, token_counts, tokens, toxicity
from lexloom.llm.common import rest_bucket

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "a", "a b c d", "x " * 3000, "Ünï çödé ñ 日本語 🙂", "a\x1cb c　d", "line one is here with more than eight words\n" * 3]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(3, "a", "again", "clash"), (None, "no id at all", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, component string, removed string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


VOCAB = tokens.vocabulary_path("word_bpe_49k.json")
PIECES = tokens.vocabulary_path("piece_bpe_32k.model")


def ids_of(texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids + [1], dtype="<u4") for e in Tokenizer.from_file(VOCAB).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(frame, out):
    rows = frame.toPandas()
    want = defaultdict(list)
    for d, ids in zip(rows.doc_id, ids_of(rows.text), strict=True):
        want[None if pd.isna(d) else int(d)].append(ids)
    got = out.toPandas()
    by = defaultdict(list)
    for r in got.itertuples():
        by[None if pd.isna(r.doc_id) else int(r.doc_id)].append(r)
    assert sorted(want, key=str) == sorted(by, key=str)
    for d, all_ids in want.items():
        if len(all_ids) > 1:
            assert sum(r.length for r in by[d]) == sum(map(len, all_ids))
            continue
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(all_ids[0][at : at + r.length].tobytes()) and r.doc_tokens == len(all_ids[0])
            at += r.length
        assert at == len(all_ids[0])
    total = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
        size = int(g.length.sum())
        assert size <= 2048
        total += size if size & (size - 1) == 0 else 2048
    assert total == sum(map(len, sum(want.values(), []))), "no padding"


def test_packing(docs, odd, none):
    check_packing(docs, packing.pack(docs, VOCAB, block_tokens=20_000))
    check_packing(odd, packing.pack(odd, VOCAB))
    assert packing.pack(none, VOCAB).count() == 0


def test_packing_balances_step_groups(docs):
    out = packing.pack(docs.coalesce(1), VOCAB).toPandas()
    cost = out.groupby(["step_group", "sequence_id"]).length.sum().pow(2).groupby("step_group").sum()
    assert cost.max() <= 1.5 * cost.min()


def test_word_ids_equal_the_tokenizer(docs):
    texts = [r.text for r in docs.limit(60).collect()] + [x or "" for x in ODD] + ["don't 'S <|endoftext|>x İĭ éé́", "ΑΣ ΌΣΟΣ"]
    assert [x.tolist() + [1] for x in tokens.word_bpe(VOCAB).encode(texts)] == [x.tolist() for x in ids_of(texts)]


def test_toxicity_learns_sentences(spark, docs, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(more, labels, "toxic", rest_bucket() != 0)
    held = toxicity.score(more, model).join(labels.where(rest_bucket() == 0), "doc_id").toPandas()
    right = ((held.score >= 0.5).astype(int) == held.toxic).mean()
    assert right > max(held.toxic.mean(), 1 - held.toxic.mean()) and held.score.between(0, 1).all()
    text = "All is well here. You are an idiot and a moron, loser. É ça."
    (row,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert row.score > 0.5 and any("idiot" in text[s.start : s.end] for s in row.offending)
    flat = toxicity.train(none, labels.limit(0), "toxic", F.lit(True))
    assert toxicity.score(spark.createDataFrame([(1, None)], "doc_id long, text string"), flat).first().score == 0.5


def test_noisy_or_gradient_finds_the_word():
    r = np.random.RandomState(0)
    bags, y = [], []
    for _ in range(400):
        toxic = r.rand() < 0.3
        bag = [sorted(r.choice(19, 3, replace=False) + 1) for _ in range(5)]
        if toxic:
            bag[r.randint(5)] = [0, *bag[0]]
        bags.append([list(map(int, b)) for b in bag])
        y.append(int(toxic))
    _, w = toxicity.fit(bags, np.array(y), 20)
    assert w[0] > 3 and np.abs(w[1:]).max() < w[0] / 2


def brute_lines(rows, least=8):
    """(doc_id, text without repeats) by the definition, from a list of every unit with its place."""

    def norm(unit):
        return re.sub(r"[\t-\r ]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in unit)).strip(" ")

    def lines_of(text):
        at = 0
        for line in text.split("\n"):
            parts, a = [], at
            for part in re.split(r"(?<=[.!?]) ", line):
                parts.append((a, part))
                a += len(part) + 1
            yield at, line, parts
            at += len(line) + 1

    first = {}
    for d, t in rows:
        for at, line, parts in lines_of(t or "") if d is not None else ():
            for a, unit in [(at, line), *(parts if len(parts) > 1 else ())]:
                if len(norm(unit).split(" ")) >= least and norm(unit):
                    first[norm(unit)] = min(first.get(norm(unit), (d, a)), (d, a))
    out = []
    for d, t in rows:
        gone = lambda a, unit, d=d: d is not None and first.get(norm(unit), (d, a)) != (d, a)
        kept = []
        for at, line, parts in lines_of(t or ""):
            left = [p for a, p in parts if not gone(a, p)]
            if not gone(at, line) and left:
                kept.append(" ".join(left))
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def test_line_dedup_against_brute_force(spark, docs, odd, none):
    passage = "Here begins it. One two three four five six seven eight nine. And then again ten words that are the same in all. So it"
    inside = spark.createDataFrame([(k, f"w{k} v{k} {passage} ends in {k}.\nOther line {k}") for k in range(5)], "doc_id long, text string")
    for frame in (docs, odd, inside):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        out = line_dedup.dedup(frame).collect()
        assert Counter((r.doc_id, r.text_deduped) for r in out) == Counter(brute_lines(rows))
        for r in out:
            assert all(0 <= s.start < s.end <= len(r.text) for s in r.removed) and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert [len(r.removed) for r in sorted(out, key=lambda r: r.doc_id)] == [0, 2, 2, 2, 2]
    assert line_dedup.dedup(none).count() == 0
    assert [line_dedup.units("a b\n\n c d ", "paragraph", 2)[k][:2] for k in (0, 1)] == [(0, 3), (6, 10)]


def test_repeated_passages_go_whole(spark):
    import corpus_pipeline

    inner = "It came. Nobody saw it. Then all of the people in that town went home again. They slept. Well."
    texts = [f"u{k} begins here. {inner} And u{k} v{k} w{k} x{k} y{k} z{k} ends so. Indeed.\nShort line\n\nAll the other words of u{k} are v{k} here. Indeed." for k in range(3)]
    texts += ["tail of one. It came.\nNobody saw it. Then a new thing that has its very own words. Indeed."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, frame, DATA).collect()}
    assert out[0] == texts[0] and out[3] == texts[3]
    for k in (1, 2):
        assert out[k] == f"u{k} begins here. And u{k} v{k} w{k} x{k} y{k} z{k} ends so. Indeed.\n\nAll the other words of u{k} are v{k} here. Indeed."


def test_runs_lose_nothing_against_brute_force(spark, docs, odd):
    r = np.random.RandomState(8)
    made = ["".join(f"{'abc'[r.randint(3)]} " * r.randint(0, 6) + ["e. ", "f!\n", "g\n"][r.randint(3)] for _ in range(20)) for _ in range(12)]
    mixed = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    words = lambda text: text.encode().lower().split()

    def parts(text):
        flat, found, at = [], set(), 0
        for line in text.split("\n"):
            if words(line):
                found.add((at, at + len(line)))
            a, sentences = at, re.split(r"(?<=[.!?]) ", line)
            for x in sentences:
                if words(x):
                    flat.append((a, a + len(x), len(words(x)), len(sentences) > 1))
                a += len(x) + 1
            at += len(line) + 1
        for i in range(len(flat)):
            for j in range(i, len(flat)):
                n = sum(u[2] for u in flat[i : j + 1])
                if n >= 8 and (flat[i][3] and n - (flat[j][2] if j > i else n) < 8 or flat[j][3] and n - (flat[i][2] if j > i else n) < 8):
                    found.add((flat[i][0], flat[j][1]))
        return found, flat

    for frame in (mixed, docs, odd):
        rows = [(x.doc_id, x.text) for x in frame.select("doc_id", "text").collect()]
        places = [(tuple(words(t[a:b])), d, a, b) for d, t in rows if d is not None for a, b in parts(t or "")[0]]
        first = {}
        for w, d, a, _ in places:
            first[w] = min(first.get(w, (d, a)), (d, a))
        gone = defaultdict(set)
        for w, d, a, b in places:
            if first[w] != (d, a):
                gone[d].add((a, b))
        left = lambda d, t: [w for a, b, *_ in parts(t)[1] if not any(x <= a and b <= y for x, y in gone[d]) for w in words(t[a:b])]
        out = Counter((x.doc_id, None if x.text is None else tuple(words(x.text_deduped))) for x in line_dedup.dedup(frame, runs=True).collect())
        assert out == Counter((d, None if t is None else tuple(left(d, t))) for d, t in rows)


def test_rules_on_held_out_documents(spark, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = rule_ensemble.train(docs, labels, "quality", rest_bucket() != 0)
    assert model.rules
    scored = rule_ensemble.statistics(docs).withColumn("score", model.score())
    held = scored.join(labels.where(rest_bucket() == 0), "doc_id").toPandas()
    assert ((held.score >= 0.3).astype(int) == held.quality).mean() > 0.95
    nested = rule_ensemble.measured(docs).select("doc_id", model.score("__statistics.").alias("s"))
    assert scored.join(nested, "doc_id").where(F.abs(F.col("score") - F.col("s")) > 1e-12).count() == 0
    flat = rule_ensemble.train(none, labels.limit(0), "quality", F.lit(True))
    assert rule_ensemble.statistics(none).withColumn("s", flat.score()).count() == 0


def test_statistics_of_odd_texts(odd):
    rows = rule_ensemble.statistics(odd).toPandas()
    assert len(rows) == len(ODD) + 2 and np.isfinite(rows[list(rule_ensemble.STATISTICS)].to_numpy()).all()
    assert rule_ensemble.measured(odd).columns == [*odd.columns, "__statistics"]


def test_rule_paths_merge_conditions():
    debug = "  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 0 <= 0.25)\n      Predict: 0.0\n     Else (feature 0 > 0.25)\n      Predict: 1.0\n    Else (feature 0 > 0.5)\n     Predict: 1.0\n"
    assert rule_ensemble.paths(debug, ("x",)) == {(("x", "<=", 0.5),), (("x", "<=", 0.25),), (("x", "<=", 0.5), ("x", ">", 0.25)), (("x", ">", 0.5),)}


def test_sentencepiece_parity(docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentencepiece_codec.codec(PIECES)
    texts = [r.text for r in docs.limit(80).collect()] + [x or "" for x in ODD] + ["▁ a▁▁b", "<s>x</s>", "\n\n a\n", " " * 30 + "b"]
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [own.decode(x.tolist()) for x in got] == [library.decode(x.tolist()) for x in got]
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECES), PIECES)
    assert Counter(r.decoded for r in back.collect()) == Counter((r.text or "") for r in odd.collect())


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁ab", -1.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1)]
    m = sentencepiece_codec.Model([p for p, _, _ in pieces], [s for _, s, _ in pieces], [k for _, _, k in pieces])
    assert sentencepiece_codec.backend(m).encode("▁abab", add_special_tokens=False).ids == [2, 5]


def test_lattice_links_against_brute_force(spark):
    r = np.random.RandomState(1)
    base = r.standard_normal((60, 64))
    rows = [base[i % 60] + r.standard_normal(64) * (0.02 * (i % 7)) for i in range(400)]
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)]
    data += [(1000 + i, data[0][1], 1) for i in range(5)]
    bad = [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [None] * 64, 0), (2003, [float("nan")] * 64, 0), (2004, [], 0), (2005, [float("inf")] + [1.0] * 63, 0), (None, data[0][1], 0)]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, label int")
    out = {x.vec_id: x for x in lattice_dedup.link(frame).collect()}
    v = np.array([d[1] for d in data], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    ids = np.array([d[0] for d in data])
    found = sum(out[i].n_links for i in ids.tolist())
    true = near.sum() - len(ids)
    assert 0.97 * true <= found <= true
    assert all(out[i].n_links <= n - 1 for i, n in zip(ids.tolist(), near.sum(axis=1), strict=True))
    assert all(out[i].component_id == 0 for i in range(1000, 1005))
    assert all(out[b].n_links == 0 and out[b].component_id == b and out[b].kept for b in range(2000, 2006))
    assert out[None].component_id is None
    assert lattice_dedup.link(frame.limit(0)).count() == 0


def test_links_of_very_large_and_small_doubles(spark):
    rows = [(1, [1e200] * 8), (2, [1e200] * 8), (3, [1e-200] * 8), (4, [1.0] * 8), (5, [1e308] * 8), (6, [5e-324] * 8), (7, [1e308, -1e308] * 4)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: (5, 1) for k in range(1, 7)} | {7: (0, 7)}


def test_spans_are_merged_as_by_pairs():
    r = np.random.RandomState(5)
    for _ in range(300):
        made = [sorted((int(a), int(k), int(a + n)) for a, k, n in zip(r.randint(0, 60, m), r.randint(0, 4, m), r.randint(1, 9, m), strict=True)) for m in r.randint(0, 9, 2)]
        base, more = made
        assert pii.both(base, more) == sorted(base + [s for s in more if not any(s[0] < b[2] and b[0] < s[2] for b in base)])


def test_e8_decoder_finds_the_nearest_point():
    r = np.random.RandomState(2)
    x = r.standard_normal((200, 8))
    p = lattice_dedup.e8(x)[:, 0]
    assert ((p % 2 == p[:, :1] % 2).all(axis=1) & (p.sum(axis=1) % 4 == 0)).all()
    again = lattice_dedup.e8(p / 2)[:, 0]
    assert (again == p).all() and (((x - p / 2) ** 2).sum(axis=1) <= 1 + 1e-9).all()


def test_token_counts_against_greedy(docs, odd):
    begin, more = token_counts.word_pieces(PIECES)

    def greedy(w):
        at = n = 0
        while at < len(w):
            end = next((j for j in range(len(w), at, -1) if w[at:j] in (begin if at == 0 else more)), None)
            if end is None:
                return None
            at, n = end, n + 1
        return n

    for frame in (docs.limit(60), odd):
        text = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        want = Counter()
        for d, t in text:
            n = [greedy(w) for w in regex.findall(r"\w+|[^\w\s]", t)]
            want[d, len(n), sum(1 if x is None else x for x in n), sum(x is None for x in n)] += 1
        assert Counter(map(tuple, token_counts.count_tokens(frame, PIECES).collect())) == want


def test_base_patterns_against_their_definition():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    r = np.random.RandomState(3)
    texts = ["".join(r.choice(list("a1.@ +-(9\n%é0"), 40)) for _ in range(3000)] + ["4111 1111 1111 1111", "mail a.b@c.de, +1 (499) 555-6503", ""]
    for t in texts:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if fits[k](m[0]))
        assert pii.base_spans(t) == want, t


def test_field_adds_and_keeps_spans(spark, odd, none):
    field = pii.train(pii.labelled(spark))
    scan = pii.scanner(field)
    for text, kind in (("call (212) 555-0199 today", "phone"), ("write to joe.doe (at) example.com please", "email"), ("host 10[.]0[.]0[.]7 is up", "ip"), ("card 4111.1111.1111.1111 ok", "card")):
        ((base, every),) = scan([text])
        assert not base and [pii.KINDS[k] for _, k, _ in every] == [kind], text
    ((base, every),) = scan(["in 1999 there were 300 of 4000, see page 12"])
    assert not base and not every
    frame = spark.createDataFrame([(1, "é a@b.co and (212) 555-0199", 5), (2, None, 6)], "doc_id long, text string, spans int")
    found = {x.doc_id: x for x in pii.find(frame, field).collect()}
    assert found[1].spans == "email:2:8,phone:13:27" and found[1].n_email == 1 and found[1].n_phone == 0 and found[2].spans == ""
    assert {x.doc_id: x.text for x in pii.redact(frame, field).collect()} == {1: "é <EMAIL> and <PHONE>", 2: None}
    assert pii.find(odd, field).count() == odd.count() and pii.find(none, field).count() == 0


def test_every_labelled_form_is_found(spark):
    rows = pii.labelled(spark).collect()
    field = pii.train(pii.labelled(spark))
    rows += pii.labelled(spark, copies=4, seed=12).collect()  # other names and digits
    texts = ["mail bob [at] corp [dot] net today", "mail bob [at] corp [dot] co [dot] uk today please", "see " + "x" * 60 + "@" + "y" * 50 + ".com now", "mail " + "a" * 45 + "(at)corp.com is it"]
    whole = [t[5:-6] for t in texts[:1]] + [texts[1][5:-13], texts[2][4:-4], texts[3][5:-6]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([r.text for r in rows] + texts)], "doc_id long, text string")
    found = {x.doc_id: x.spans.split(",") for x in pii.find(frame, field).collect()}
    assert [found[len(rows) + k] for k in range(4)] == [[f"email:{t.index(w)}:{t.index(w) + len(w)}"] for t, w in zip(texts, whole, strict=True)]
    form = lambda s, x: (s.kind, re.sub(r"[a-z]+", lambda m: m[0] if m[0] in ("at", "dot", "com", "org", "net") else "a", re.sub("[0-9]+", "9", x)))
    hit, seen = Counter(), Counter()
    for k, r in enumerate(rows):
        for s in r.spans:
            value = r.text[s.start : s.end]
            if s.kind != "card" or pii.luhn(re.sub("[^0-9]", "", value)):
                seen[form(s, value)] += 1
                hit[form(s, value)] += f"{s.kind}:{s.start}:{s.end}" in found[k]
    assert {k for k, _ in seen} == set(pii.KINDS) and {f: (hit[f], n) for f, n in seen.items() if hit[f] < n} == {}


def test_held_out_rates_of_the_field(spark):
    field = pii.train(pii.labelled(spark))
    precision, recall = pii.rates(pii.labelled(spark, copies=6, seed=99), field)
    print("precision", precision, "recall", recall)
    assert precision > 0.97 and recall > 0.97
    scan = pii.scanner(field)
    for text, value, kind in (("write to joe dot doe at example dot com", "joe dot doe at example dot com", "email"), ("mail joe.doe at example.com today", "joe.doe at example.com", "email"), ("call 212 555 0199 now", "212 555 0199", "phone")):
        ((base, every),) = scan([text])
        assert not base and every == [(text.index(value), pii.KINDS.index(kind), text.index(value) + len(value))], text
    for text in ("we met at noon. Then all went home at eight", "a polka dot dress", "he looked at the.Next"):
        assert scan([text]) == [([], [])], text


def test_query_digests_against_brute_force(spark, docs, odd):
    import hashlib

    field = pii.train(pii.labelled(spark))
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    some = spark.createDataFrame([(-1, "a@b.co 4111 1111 1111 1111"), (-2, "é 10.0.0.7 and +1 (499) 555-6503, x@y.z")], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), some):
        want = Counter()
        for r in frame.collect():
            spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, r.text or "") if fits[k](m[0]))
            line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            want[r.doc_id, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(line.encode()).hexdigest()] += 1
        assert Counter(tuple(r)[:6] for r in pii.find(frame, field).collect()) == want


def test_transport_streams(spark, odd, none):
    r = np.random.RandomState(4)
    for n in (0, 1, 64, 168, 169, 170, 171, 183, 184, 352, 353, 354, 16_384, 16_385, 16_384 * 5 + 7):
        data = r.bytes(n)
        if n:
            back, found = mpegts.demux(mpegts.mux(data))
            assert back == data and len(found["stamps"]) == -(-n // 16_384) == found["units"] and len(found["random_access"]) == -(-found["units"] // 4)
    broken = bytearray(mpegts.mux(b"x" * 2000))
    broken[188 * 4 + 3] ^= 3
    with pytest.raises(ValueError, match="continuity"):
        mpegts.demux(bytes(broken))
    broken = bytearray(mpegts.TABLES)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        mpegts.demux(bytes(broken))
    out = mpegts.digests(odd).toPandas()
    assert len(out) == len(ODD) + 2 and (out.payload_bytes % 64 == 0).all() and (out.media_bytes % 188 == 0).all()
    stored = mpegts.read(mpegts.store(odd))
    texts = Counter((x.text or "").encode() for x in odd.collect())
    assert Counter(bytes(x.read_back.payload)[: x.n_bytes] for x in stored.collect()) == texts
    assert mpegts.digests(none).count() == 0


def packet(pid, counter, body=b"", field=None, start=False):
    """A packet with its adaptation field filled up to the body."""
    room = 184 - len(body)
    field = field if field is not None or not room else b"\0"
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x20 if room else 0) | (0x10 if body else 0) | counter])
    out = head + (bytes([room - 1]) + field[: room - 1].ljust(room - 1, b"\xff") if room else b"") + body
    assert len(out) == 188
    return out


def test_streams_of_other_writers():
    data = np.random.RandomState(5).bytes(2000)
    own = mpegts.mux(data)
    packets = [own[i : i + 188] for i in range(0, len(own), 188)]
    es = mpegts.ES_PID
    # a legal repeat, a packet with a clock reference alone, and null packets change nothing
    clock = packet(es, packets[4][3] & 15, field=b"\x10" + (123 << 15 | 0x7E00).to_bytes(6, "big"))
    more = b"".join([*packets[:4], packets[3], packets[4], clock, packet(0x1FFF, 9, b"z" * 184), *packets[5:]])
    back, found = mpegts.demux(more)
    assert back == data and found["clocks"] == [0, 123 * 300] and found["packets"] == len(packets) + 3
    # an adaptation field in a middle packet
    pes = b"\0\0\1\xbd" + (8 + 400).to_bytes(2, "big") + b"\x84\x80\x05" + mpegts._stamp(90_000) + data[:400]
    middle = [packet(es, 0, pes[:184], start=True), packet(es, 1, pes[184:284]), packet(es, 2, pes[284:])]
    back, found = mpegts.demux(b"".join([*packets[:2], *middle]))
    assert back == data[:400] and found["stamps"] == [90_000]
    # a map table over three packets: many streams with descriptors
    body = (0xE000 | es).to_bytes(2, "big") + b"\xf0\0" + b"\x06" + (0xE000 | es).to_bytes(2, "big") + b"\xf0\0"
    body += b"".join(b"\x06" + (0xE200 | k).to_bytes(2, "big") + b"\xf0\x05" + b"abcde" for k in range(40))
    section = b"\0" + mpegts._section(2, 1, body)
    parts = [section[i : i + 184] for i in range(0, len(section), 184)]
    tables = [packet(mpegts.PMT_PID, k, x.ljust(184, b"\xff"), start=k == 0) for k, x in enumerate(parts)]
    assert len(parts) == 3 and mpegts.demux(b"".join([packets[0], *tables, *packets[2:]]))[0] == data
    # lost and third packets, of tables too, are refused; the discontinuity flag excuses a jump
    for bad in ([packets[0], *tables[:1], *tables[2:], *packets[2:]], [*packets[:4], packets[3], packets[3], *packets[4:]], [*packets[:3], *packets[4:]]):
        with pytest.raises(ValueError, match="continuity"):
            mpegts.demux(b"".join(bad))
    jump = [packet(es, 7, pes[:184 - 2], field=b"\x80", start=True), packet(es, 8, pes[182:366]), packet(es, 9, pes[366:])]
    assert mpegts.demux(b"".join([*packets[:2], *middle, *jump]))[0] == data[:400] * 2


def test_media_digests_against_the_texts(odd):
    import hashlib

    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    want = Counter()
    for d, raw in rows:
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = mpegts.mux(payload)
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in mpegts.digests(odd).collect()) == want


def test_codec_digests_against_the_library(docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for frame in (docs.limit(40), odd):
        want = Counter()
        for r in frame.collect():
            ids = library.encode(r.text or "")
            back = library.decode(ids)
            want[r.doc_id, len(ids), sum(library.is_byte(i) for i in ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), zlib.crc32(back.encode())] += 1
        assert Counter(tuple(r)[:5] for r in sentencepiece_codec.digests(frame, PIECES).collect()) == want


def test_unigram_model_with_a_character_map(tmp_path):
    """A hand-written unigram model with the library's own compiled map, held against the library."""
    import sentencepiece

    def message(*fields):
        out = b""
        for number, value in fields:
            kind = 2 if isinstance(value, bytes) else 5 if isinstance(value, float) else 0
            out += bytes([*varint(number << 3 | kind)]) + (bytes([*varint(len(value))]) + value if kind == 2 else np.float32(value).tobytes() if kind == 5 else bytes([*varint(value)]))
        return out

    def varint(n):
        while n > 127:
            yield n & 127 | 128
            n >>= 7
        yield n

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    norm = next(v for k, v in sentencepiece_codec.fields(rule) if k == 3)
    r = np.random.RandomState(3)
    words = ["".join(r.choice(list("abcfiou"), r.randint(2, 5))) for _ in range(40)]
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1)] + [(c, -6.0 - k / 10, 1) for k, c in enumerate("abcfiou1")]
    pieces += [(w, float(-2 - r.rand() * 3), 1) for w in dict.fromkeys(words + ["▁" + w for w in words])]
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(message(*((1, message((1, p.encode()), (2, float(s)), (3, k))) for p, s, k in pieces), (2, message((3, 1), (44, b" <?> "))), (3, norm)))
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    texts = ["", " ", "ABC ﬁab  Ⅸ", "ｆａｂ①", *(" ".join(r.choice(words, 6)) + "".join(r.choice(list("abcX zÉ"), 4)) for _ in range(60))]
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [own.decode(x.tolist()) for x in got] == [library.decode(x.tolist()) for x in got]


def test_vectors_of_other_lengths_and_types(spark):
    r = np.random.RandomState(7)
    wide, short = r.standard_normal(128), r.standard_normal(16)
    rows = [(i, [float(x) for x in wide]) for i in range(3)] + [(10 + i, [float(x) for x in short * (1 + i)]) for i in range(3)] + [(20, None), (21, [])]
    # two vectors whose cosine is under the limit by less than a float can tell
    a = np.zeros(16)
    a[0] = 1.0
    b = np.zeros(16)
    b[0], b[1] = 0.95 - 1e-9, np.sqrt(1 - (0.95 - 1e-9) ** 2)
    rows += [(30, a.tolist()), (31, b.tolist())]
    out = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in lattice_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 10: (2, 10, True), 11: (2, 10, False), 12: (2, 10, False), 20: (0, 20, True), 21: (0, 21, True), 30: (0, 30, True), 31: (0, 31, True)}


def test_long_words_are_counted(spark):
    begin, more = token_counts.word_pieces(PIECES)
    own = token_counts.Automaton(begin, more)
    r = np.random.RandomState(8)
    words = ["".join(r.choice(list("abcdefghiT"), n)) for n in (1, 5, 99, 100, 101, 180, 400)] + ["a" * 300 + "\u2603"]

    def greedy(w):
        at = n = 0
        while at < len(w):
            end = next((j for j in range(min(len(w), at + 40), at, -1) if w[at:j] in (begin if at == 0 else more)), None)
            if end is None:
                return -1
            at, n = end, n + 1
        return n

    assert own.counts(words).tolist() == [greedy(w) for w in words] == [own.count_long(w) for w in words]
    assert own.counts(words, 100).tolist() == [greedy(w) if len(w) <= 100 else -1 for w in words]


def test_repeated_lines_keep_columns_of_clashing_names(spark):
    import corpus_pipeline

    line = "one two three four five six seven eight nine"
    frame = spark.createDataFrame([(1, line, "r1", "t1"), (2, line, "r2", "t2")], "doc_id long, text string, removed string, text_deduped string")
    assert sorted(map(tuple, corpus_pipeline.repeated_lines(spark, frame, DATA).collect())) == [(1, line, "r1", "t1"), (2, "", "r2", "t2")]


def test_compiled_rules_against_plain_python(spark, docs):
    rules = [((("words", ">", 50.0),), 0.7), ((("digits", "<=", 0.01), ("words", ">", 20.0)), -1.2), ((("upper", ">", 0.02),), 0.4)]
    model = rule_ensemble.RuleEnsemble(-0.3, rules)
    for r in rule_ensemble.statistics(docs).withColumn("score", model.score()).collect():
        z = -0.3 + sum(w for rule, w in rules if all(r[n] <= t if s == "<=" else r[n] > t for n, s, t in rule))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12


def test_noisy_or_scores_against_plain_python(spark, docs):
    r = np.random.RandomState(11)
    texts = [(x.doc_id, x.text) for x in docs.limit(50).collect()] + [(-1, None), (-2, "")]
    words = sorted({w for _, t in texts for s in toxicity.sentences(t or "") for w in s.split()})
    weights = {w: float(r.standard_normal()) for w in words[::7]} | {b"^" + w[:5]: 0.5 for w in words[::11] if len(w) >= 5}
    out = {x.doc_id: x for x in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), toxicity.Model(-2.0, weights)).collect()}
    for d, t in texts:
        left, hot = 1.0, 0
        bags = [set(s.split()) for s in toxicity.sentences(t or "")]
        for bag in [b for b in bags if b] or [set()]:
            p = 1 / (1 + np.exp(2.0 - sum(weights.get(f, 0.0) for w in bag for f in toxicity.features(w))))
            left *= 1 - p
            hot += p >= 0.5
        assert abs(out[d].score - (1 - left)) < 1e-9 and len(out[d].offending) == hot


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {d: sets_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("partners", [0, 4])
def test_jaccard_join_against_brute_force(spark, docs, monkeypatch, partners):
    r = np.random.RandomState(5)
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(4000)]
    base = list(r.choice(words, 120))
    for k in range(120):  # a chained group of near copies, and texts that share a passage with it
        own = list(base)
        for _ in range(k % 9):
            own[r.randint(120)] = r.choice(words)
        if k % 4 == 0:
            own = base[:60] + list(r.choice(words, 30 + k))
        rows.append((10_000 + k, " ".join(own)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "One two"), (20_004, "one TWO"), (20_005, "É b c d e"), (20_006, "é b c d e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PARTNERS", partners)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(frame).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edge_tables(spark, none):
    assert jaccard_join.link(none).count() == 0
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert Counter((x.doc_id, x.component_id) for x in jaccard_join.link(frame).collect()) == Counter({(1, 1): 2, (2, 1): 1, (None, None): 1})
    # one id with two texts: each row has the component of its own text
    frame = spark.createDataFrame([(3, "a b c d e f"), (3, "g h i j k l"), (2, "g h i j k l"), (4, "a b c d e f"), (5, None), (5, "")], "doc_id long, text string")
    found = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.link(frame).collect())
    assert found == Counter({(3, 2, 3): 1, (3, 2, 2): 1, (2, 2, 2): 1, (4, 2, 3): 1, (5, 0, 5): 2})


def test_jaccard_join_survives_salted_keys_and_split_families(spark, monkeypatch):
    """A third of all rows in one group of near copies, a passage in most of the others; every limit is so low that all paths are taken."""
    r = np.random.RandomState(9)
    words = [f"w{i}" for i in range(5000)]
    base, passage = list(r.choice(words, 60)), list(r.choice(words, 40))
    rows = []
    for k in range(240):
        if k % 3 == 0:
            own = list(base)
            for _ in range(k % 4):
                own[r.randint(60)] = r.choice(words)
        else:
            own = list(r.choice(words, r.randint(5, 50))) + passage[: r.randint(10, 40)]
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for name, value in (("LEAF", 4), ("BLOCK", 10), ("PAIR_BLOCK", 7), ("HEAVY_TOTAL", 6), ("SALT_ROWS", 10), ("FINE_BLOCK", 400), ("TEXT_BLOCK", 300)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(frame).collect()}
    assert got == brute_components(rows)


def test_shared_first_shingles_bound():
    """Linked sets share at least shared_least of their first shingles, and the smaller has an early one among them."""
    r = np.random.RandomState(10)
    for _ in range(400):
        a = set(r.choice(400, r.randint(1, 80), replace=False).tolist())
        b = (a - set(r.choice(sorted(a), r.randint(0, len(a) // 4 + 1), replace=False).tolist())) | set(r.choice(400, r.randint(0, 9)).tolist())
        if not b or len(a & b) < 0.75 * len(a | b):
            continue
        first = [sorted(s)[: len(s) - int(np.ceil(0.75 * len(s) - 1e-9)) + 1] for s in (a, b)]
        shared = set(first[0]) & set(first[1])
        assert len(shared) >= jaccard_join.shared_least(len(a), len(b), 0.75)
        small = 0 if len(a) <= len(b) else 1
        n = len((a, b)[small])
        assert shared & set(first[small][: n - int(np.ceil(6 / 7 * n - 1e-9)) + 1])


def test_count_tree_keeps_every_pair_within_the_bound():
    r = np.random.RandomState(6)
    for size in (1, 7, 300):
        points = r.poisson(3, (size, 1 << jaccard_join.GROUP_BITS)).astype(np.int32)
        points[::3] = points[0] + r.poisson(0.1, (len(points[::3]), points.shape[1])).astype(np.int32)
        n = points.sum(axis=1).astype(int)
        tree = jaccard_join.CountTree(points, n)
        assert len(tree.levels) == {1: 1, 7: 1, 300: 3}[size]
        for q in range(0, size, 37):
            low = np.minimum(points, points[q]).sum(axis=1)
            assert set(tree.search(points[q], n[q], 0.75)) == set(np.flatnonzero(low >= np.ceil(3 / 7 * (n + n[q]) - 1e-9)))


def test_points_are_packed_without_loss():
    r = np.random.RandomState(12)
    for n in (1, 5, 31, 33, 700, 5_000, 40_000, 300_000):
        own = np.sort(r.randint(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        bits = int(jaccard_join.bits_of(np.array(n)))
        want = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        assert (jaccard_join.unpacked(jaccard_join.packed(jaccard_join.finely(own), n), bits) == want).all()
        assert jaccard_join.bits_of(np.array(n)) >= jaccard_join.bits_of(np.array(n * 4 // 3)) - 1


def test_pipeline_keeps_an_id_whose_other_text_is_a_copy(spark):
    import corpus_pipeline

    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, frame, DATA).collect())) == [(1, "a b c d e f"), (2, "g h i j k l")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000), (None, 3)]
    out = components.components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b")
    got = {x.node: x.component for x in out.collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(60)) and 5000 not in got


def test_words_of_repeating_patterns_do_not_collide(spark):
    """The two Thue-Morse words of 1,024 letters, which differ in every letter, and words beyond the table's places."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, "x" * 100 + "ab", "x" * 100 + "ba", "ab", "ba", "a", "", " ab", "AB"]
    found = textkit.shingle_sets(texts)
    names = [tuple(x.tolist()) for x in found]
    assert len(set(names)) == 8 and names[4] == names[8] == names[9]
    frame = spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard_join.link(frame).collect()) == [0, 1]


def test_shingle_sets_follow_the_definition():
    texts = ["A b C d e f", "a B c D e F", "a b c d e", "a b", "A  B", "", " ", "a b c d e f a b c d e f", "É é x y z"]
    assert [len(s) for s in textkit.shingle_sets(texts)] == [len(sets_of(t)) for t in texts]
    s = textkit.shingle_sets(texts)
    assert (s[0] == s[1]).all() and (s[3] == s[4]).all() and s[2][0] in s[0]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("component", F.lit("kept"))
    sizes, frame = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = spark.createDataFrame(stage(spark, frame, DATA).toPandas(), docs.schema)
        assert frame.columns == docs.columns
        sizes.append(frame.count())
        if name == "near_duplicates":
            parts = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in frame.collect()} == {c for _, c in parts.values()}
        if name == "personal_data":
            assert not any(pii.base_spans(r.text) for r in frame.collect())
        if name in ("repeated_lines", "personal_data"):
            assert all(r.n_chars == len(r.text) for r in frame.collect())
    assert sizes[0] < docs.count() and sizes[1] < sizes[0] and sizes[1] == sizes[2] == sizes[3]
    check_packing(frame, corpus_pipeline.STAGES[-1][1](spark, frame, DATA))


def test_chunks_make_lists_of_a_slice_at_a_time():
    from lexloom.llm.common import chunks

    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "text": ["aa", None, "bbb", "é" * 9, "", "cc"]})
    parts = list(chunks(iter([batch, batch.slice(0, 0)]), most=5))
    assert [(p["k"], p["text"]) for p in parts] == [([0, 1, 2], ["aa", "", "bbb"]), ([3], ["é" * 9]), ([4, 5], ["", "cc"])]
    whole = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 10_000})
    held = []
    tracemalloc.start()
    for part in chunks(iter([whole]), most=100_000):
        held.append(tracemalloc.get_traced_memory()[0])
        assert len(part["text"]) == 100
    tracemalloc.stop()
    assert max(held) < 3_000_000, "the lists of a whole batch of ten megabytes were held"


def test_packing_leaves_no_encoder_in_a_worker(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(packing, "TaskContext", Context)
    tokens.word_bpe.cache_clear()
    gc.collect()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words to remember", None]})
    gc.disable()
    try:
        rows = [r for b in packing.packer(VOCAB, (256, 2048), 1, 4096, 10_000)(iter([batch])) for r in b.to_pylist()]
        assert not [x for x in gc.get_objects() if isinstance(x, tokens.WordBpe)], "the words of a task stay in the worker"
    finally:
        gc.enable()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {1: len(ids_of(["some words to remember"])[0]), 2: 1}


def test_survey_works_on_small_slices():
    class Caught:
        mapInArrow = staticmethod(lambda run, schema: run)

    dice = np.random.RandomState(5)
    texts = [" ".join(f"w{x}" for x in dice.randint(0, 100_000, 1500)) for _ in range(300)]
    texts += [x + " one more" for x in texts[:40]] + texts[:5]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text_hash": [0] * len(texts), "text": texts})
    tracemalloc.start()
    rows = []
    for part in jaccard_join.survey(Caught, 5)(iter([batch])):
        rows += part.select(["shingle", "n"]).filter(part.column("shingle").is_valid()).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sets = textkit.shingle_sets(texts[:340], 5)
    met = Counter(np.concatenate(sets).view(np.int64).tolist())
    assert {r["shingle"]: r["n"] for r in rows} == {k: n for k, n in met.items() if n > 1} and len(rows) > 50_000
    assert peak < 20_000_000, f"{peak} bytes for three megabytes of text"


def test_pipeline_hands_texts_to_python_in_small_batches(spark):
    """a batch of 10,000 texts, up to 64 MB, stood in the executor and in its Python worker at once."""
    import corpus_pipeline
    from lexloom.llm.common import BATCH_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 400)).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    packed = dict(corpus_pipeline.STAGES)["pack"](spark, docs, "")
    seen = docs.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in seen) == 4000
    assert max(r["size"] for r in seen) < 1.2 * BATCH_BYTES
    # the pieces are whole, whatever the batches
    assert packed.select("doc_id").distinct().count() == 4000
    assert packed.groupBy("doc_id").agg((F.sum("length") - F.max("doc_tokens")).alias("d")).where("d <> 0").count() == 0


def test_a_task_gives_its_memory_back():
    """what a task has freed goes back to the system at its end, though something small stays above it."""
    import psutil

    from lexloom.llm.common import gives_back

    kept = []

    def run(batches):
        own = [bytes([k % 256]) * 1500 for k in range(80_000)]  # 120 MB
        kept.append(bytes(1600))
        yield len(own)
        del own

    before = psutil.Process().memory_info().rss
    assert list(gives_back(run)(iter([]))) == [80_000]
    assert psutil.Process().memory_info().rss - before < 30e6
    list(run(iter([])))
