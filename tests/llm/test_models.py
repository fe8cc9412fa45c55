"""Packing, language, quality, mixing, LM scores, HTML and media against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.llm import html_main, language, lm, media, mixing, packing, quality

EN = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were "
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "


def test_packing_round_trip(documents, odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = odd_texts + [(50, "<|endoftext|> is a word"), (51, "中文 текст ☃ ʼn ŵ"), (52, "a  b\n\n c'll 123 ... \x00\x85")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    pieces = packing.pack(documents(rows)).collect()
    by_sequence, texts = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        place = p.sequence_id * 2048 + p.offset - p.start
        texts.setdefault((p.doc_id, place), []).append((p.start, tuple(ids), p.doc_tokens))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or s == max(by_sequence)
    got = Counter()
    for (doc, _), parts in texts.items():
        ids = sum((x[1] for x in sorted(parts)), ())
        assert len(ids) == parts[0][2]
        got[doc, ids] += 1
    assert got == want
    assert packing.pack(documents([])).count() == 0


def _texts(rng, words, n):
    w = words.split()
    return [" ".join(w[i] for i in rng.integers(0, len(w), int(rng.integers(3, 60)))) for _ in range(n)]


def test_language(documents, odd_texts):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(_texts(rng, EN, 100) + _texts(rng, DE, 100), 1000)]
    langs = {i: "en" if i < 1100 else "de" for i, _ in rows} | dict.fromkeys((1, 2, 3, 4, 5, 6, 7, 8, None))
    got = {r.doc_id: r for r in language.identify_held_out(documents(odd_texts + rows + [(9, "123 !?")], langs)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(got[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    for i in (1, 2, 3, 9):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify_held_out(documents([(1, "no labels")], {1: None})).collect()} == {"und"}


def test_code_lengths_are_those_of_the_definition():
    """Probabilities of a context sum to one at most (no exclusions), exactly as defined."""
    trees = language.Trees([("x", "abab abac"), ("y", "zzz zz")])
    counts = Counter()
    s = "   " + language.normal("abab abac").decode()
    for i in range(3, len(s)):
        for d in range(4):
            counts[s[i - d : i], s[i]] += 1

    def p(context, c):
        seen = {k[1]: n for k, n in counts.items() if k[0] == context}
        t, d = sum(seen.values()), len(seen)
        if c in seen:
            return seen[c] / (t + d)
        rest = p(context[1:], c) if context else 1 / language.SYMBOLS
        return d / (t + d) * rest if t else rest

    text = "abaz ca"
    full = "   " + text
    want = -sum(math.log2(p(full[i - 3 : i], full[i])) for i in range(3, len(full)))
    assert trees.code_lengths(text.encode())[0] == pytest.approx(want, abs=1e-3)
    assert trees.code_lengths(text.encode(), chunk=2)[0] == pytest.approx(want, abs=1e-3)


def test_quality(spark, documents, odd_texts):
    rng = np.random.default_rng(4)
    good = _texts(rng, EN + DE, 300)
    bad = [t.upper().replace(" ", "!! ") if i % 2 else t + " zap zap vile" for i, t in enumerate(_texts(rng, EN, 150))]
    rows = [(i, t) for i, t in enumerate(good + bad, 100)]
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows + odd_texts)
    got = quality.weigh_and_sample(docs, labels, 0.3).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd_texts)
    assert np.mean([by[i].accepted for i, _ in rows if i < 400]) > 0.95
    assert np.mean([by[i].accepted for i, _ in rows if i >= 400]) < 0.1
    assert not by[1].accepted and not by[2].accepted
    k = int(len(got) * 0.3)
    edge = sorted((r.sampling_key for r in got), reverse=True)[:k]
    assert abs(sum(r.sampled for r in got) - k) <= 1  # the repeated row is tied with itself
    assert min(r.sampling_key for r in got if r.sampled) == edge[-1]
    weighed = quality.weighed(docs.select("doc_id", "text"), np.zeros(quality.BUCKETS)).drop("text")
    assert quality.gumbel_top_k(weighed, 0.5, small=20).filter("sampled").count() in (len(got) // 2, len(got) // 2 + 1)
    assert quality.weigh_and_sample(documents([]), labels.limit(0)).count() == 0


def test_mixing(documents):
    rng = np.random.default_rng(6)
    rows = [(i, "word " * int(rng.integers(1, 400))) for i in range(3000)]
    langs = {i: "en" if i % 10 else None for i, _ in rows}
    sources = {i: "hot" if i % 3 == 0 else f"s{i % 7}" for i, _ in rows}
    docs = documents(rows, langs, sources)
    targets = {"mix_lang": {"en": 0.6, "": 0.4}}
    for local in (100_000, 0):
        out = mixing.mix(docs, 0.2, targets, local_cells=local).toPandas()
        total, drawn = out.mix_tokens.sum(), out[out.mix_sampled].mix_tokens.sum()
        assert drawn == pytest.approx(0.2 * total, rel=0.1)
        expected = (out.mix_tokens * out.mix_probability).groupby(out.mix_lang).sum()
        if local:
            full = out[out.mix_lang == ""].mix_tokens.sum()
            assert expected[""] == pytest.approx(min(0.4 * 0.2 * total, full), rel=0.02)
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None), (2, "")])).filter("mix_sampled").count() == 0


def test_raking_holds_all_marginals():
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 4, 200), rng.integers(0, 3, 200)]
    tokens = rng.integers(1, 100, 200).astype(float)
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25])]
    w = mixing.rake((codes, tokens), targets)
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, w), t, atol=1e-6)
    p = mixing.probabilities(tokens, w, 0.6 * tokens.sum())
    assert (p <= 1).all() and (p * tokens).sum() == pytest.approx(0.6 * tokens.sum())


def test_lm_base_and_order(documents, odd_texts):
    rng = np.random.default_rng(8)
    phrase = "one two three four five six seven"
    rows = [(i, " ".join([phrase] * int(rng.integers(1, 5)) + [f"r{int(x)}" for x in rng.integers(0, 500, 6)])) for i in range(20, 160)]
    rows += [r for r in odd_texts if r[0] not in (6,)]
    got = {r.doc_id: r for r in lm.score_held_out(documents(rows)).collect()}
    count = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            count.update([*lm.words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*lm.words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(tokens), n)
        assert r.n_known == sum(count[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0
    better = [got[i].score > got[i].base_score for i, t in rows if i is not None and i >= 20 and held(i)]
    assert better and all(better)
    assert lm.score_held_out(documents([])).count() == 0


def test_lm_scores(documents, odd_texts, monkeypatch):
    """Brute force over all n-grams with a count of two, whatever words have numbers, whatever
    histories are hot and however long a block is; its probabilities sum to one in every state."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 60)) for i in range(20, 120)]
    rows += [r for r in odd_texts if r[0] not in (8, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    read = lambda t: ["<s>", *lm.words(t), "</s>"]
    count = Counter()
    for i, t in rows:
        w = read(t)
        if not held(i):
            count.update(tuple(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1))
    n = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 for g in count) - 1
    arcs = {}
    for g, c in count.items():
        if len(g) > 1 and c >= 2:
            arcs.setdefault(g[:-1], {})[g[-1]] = (c - lm.DISCOUNT) / count[g[:-1]]

    def p(history, w):
        if not history:
            return (count[(w,)] + 1) / (n + v + 1)
        own = arcs.get(history, {})
        return own.get(w, 0) + (1 - sum(own.values())) * p(history[1:], w)

    vocabulary = [g[0] for g in count if len(g) == 1 and g != ("<s>",)] + ["unknown"]
    for history in [(), *arcs]:
        assert sum(p(history, w) for w in vocabulary) == pytest.approx(1)
    want = {i: sum(math.log10(p(tuple(w[max(0, j - 2) : j]), w[j])) for w in [read(t)] for j in range(1, len(w))) for i, t in rows}
    for floor, hot, block in ((lm.FLOOR, lm.HOT, lm.BLOCK), (3 / n, 2.0, 500), (0.02, 0.01, 1), (1.0, 0.002, 100)):
        monkeypatch.setattr(lm, "FLOOR", floor)
        monkeypatch.setattr(lm, "HOT", hot)
        monkeypatch.setattr(lm, "BLOCK", block)
        monkeypatch.setattr(lm, "_PART", 700)
        got = lm.score_held_out(documents(rows)).collect()
        for r in got:
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">buy this now.</div><article><h1>The &amp; title</h1><p><b>First</b>ly,  some   text here that goes on for a while.<br>next line
<p>Second &lt;paragraph&gt; with caf&eacute; and more words than one would expect of it.</p><p>Short.</p></article>
<section class="comments"><div class="comment"><p>I think this is wrong, said a reader.</p></div></section>
<div class="cookie-notice">We use cookies.</div><form><input><button>Send</button></form><footer>&copy; nobody</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE, "k"), (2, "u", None, "k"), (3, "u", "", "k"), (4, "u", "just &amp; text", "k"), (5, None, "<p>cut off <a href=", "k")]
    rows += [(6, "u", "<div>" * 3000 + "deep", "k"), (7, "u", PAGE, "k")]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, key string")).collect()}
    want = "The & title Firstly, some text here that goes on for a while. next line Second <paragraph> with café and more words than one would expect of it. Short."
    assert got[1] == want == got[7]
    assert got[2] == got[3] == "" and got[4] == "just & text"
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_decisions_do_not_contradict():
    pages = [html_main.Page(h) for h in html_main.training_pages(60, seed=123)]
    x, parent, _ = html_main.features(pages)
    odds = html_main.trained().log_odds(x)
    kept = html_main.decide(odds, parent, pages)
    truth = np.concatenate([np.array(p.label) for p in pages]) == 1
    assert not (kept & ~kept[parent]).any()
    assert (kept == truth).mean() > 0.98


def test_language_of_other_scripts_and_long_texts(documents):
    """Languages of one script beside Latin ones, one of them with long documents only."""
    rng = np.random.default_rng(13)
    hi = "और यह है के में की से को पर इस का एक नहीं कर था हैं भी तो ही लिए"
    mr = "आणि हे आहे च्या मध्ये ची ने ला वर या चा एक नाही करून होता आहेत सुद्धा तर साठी"
    rows, langs = [], {}
    for k, (lang, w) in enumerate({"en": EN, "de": DE, "hi": hi, "mr": mr}.items()):
        for j, text in enumerate(_texts(rng, w, 80)):
            i = 1000 * k + j
            rows.append((i, " ".join([text] * 200) if lang == "mr" else text))
            langs[i] = lang
    assert min(len(t) for i, t in rows if langs[i] == "mr") > 1500
    rows = [(i, (t * 4)[:9000] + " " + t if langs[i] == "mr" else t) for i, t in rows]
    rows = [(i, t if langs[i] != "mr" or len(t) > 5000 else t * 4) for i, t in rows]
    assert min(len(t) for i, t in rows if langs[i] == "mr") > 5000
    got = [r for r in language.identify_held_out(documents(rows, langs)).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.95


def test_html_of_odd_markup(spark):
    """Letters whose lower case is longer, a head that isn't closed, formulas, deep lists, a column
    named text."""
    body = "<article><h1>Title here</h1><p>First words than one would think, really, of it all.</p><script>var x = 1;</script><p>Second words than one would think, really.</p></article>"
    rows = [
        (1, "<html><body>" + body.replace("First", "İ" * 40 + " First") + "</body></html>", "t"),
        (2, "<html><head><title>no</title><style>p{}</style><header class='header'>Site</header>" + body, "t"),
        (3, "<html><head><meta charset=x><title>no</title><body>" + body, "t"),
        (4, body.replace("First", "Let <math><mi>x</mi></math> be"), "t"),
        (5, "<ul><li>" * 3000 + "deep" + "</li></ul>" * 3000 + body, "t"),
    ]
    out = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    for i in (1, 2, 3):
        assert "Second words than one would think, really." in out[i] and "var x" not in out[i] and "no" not in out[i].split()
    assert ("İ" * 40 + " First words") in out[1] and "Let x be words" in out[4]


def test_clashing_columns(documents, spark):
    """Columns named like a result are replaced, and no operator stumbles over them."""
    import corpus_pipeline
    from sedimark.llm import mixing, quality

    names = ("log_weight", "avoided", "ngrams", "score", "lang_pred", "bits_per_symbol", "mix_source", "mix_weight", "mix_tokens", "tokens", "same", "part")
    rows = [(i, " ".join([EN, DE][i % 2].split()[j] for j in np.random.default_rng(i).integers(0, 12, 30))) for i in range(40)]
    docs = documents(rows, {i: ["en", "de"][i % 2] for i in range(40)}).withColumns({n: F.lit("mine") for n in names})
    assert quality.weighed(docs, np.zeros(quality.BUCKETS)).filter("log_weight = 0").count() == 40
    assert language.identify(docs, language.fit(docs)).filter("score > 0").count() == 40
    assert mixing.mix(docs).filter("mix_tokens > 0").count() == 40
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and (kept.count() == 0 or kept.first()["score"] == "mine"), name


def test_wide_fit_equals_local_fit(documents):
    from sedimark.llm import mixing

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"wort{int(x)}xyz" for x in rng.integers(0, 40, int(rng.integers(1, 60))))) for i in range(150)]
    docs = documents(rows, {i: ["en", "de", "fr"][i % 3] for i in range(150)}, {i: f"s{i % 4}" for i in range(150)})
    given = {"mix_source": {"s0": 0.5, "s1": 0.3, "s2": 0.1, "s3": 0.1}}
    p = lambda n: {r.doc_id: r.mix_probability for r in mixing.mix(docs, share=0.6, targets=given, local_cells=n).collect()}
    wide, local = p(1), p(10**6)
    assert max(abs(wide[i] - local[i]) for i in local) < 1e-6
