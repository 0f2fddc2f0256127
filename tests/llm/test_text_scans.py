import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from canongraph.llm import decontam, extract, langid, licenses, toxicity
from canongraph.llm.common import remainder
from canongraph.llm.queries import op4_toxicity, op5_language_id


def test_toxicity_held_out(spark):
    got = op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.85 * got.toxic.sum() and hit >= 0.97 * got.predicted.sum()


def test_noisy_channel(spark, docs):
    text = "you are an idiot and a moron said the clown with the worthless trash " * 200
    frame = spark.createDataFrame([(0, text), (1, "the other people are stupid idiots in the house of trash " * 50)], "doc_id long, text string")
    chars = toxicity.char_model(frame)
    assert toxicity.restore("1d10t", chars) == "idiot"
    assert toxicity.restore("iiidiooot", chars) == "idiot"
    assert toxicity.restore("m o r o n", chars) == "moron"
    assert "trash" in toxicity.words_of_token("tr@$h", chars)
    labels = spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(r.score == 0 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def plain_restore(token, model):
    """All readings of a token, one by one."""
    best = (-1e9, "")
    stack = [(0, "", 0.0, "")]  # place, reading, log probability, character before
    while stack:
        i, read, p, last = stack.pop()
        edge = read[-1:] in ("", " ")
        a, b = (0, 0) if edge else (ord(read[-2]) if len(read) > 1 and read[-2] != " " else 0, ord(read[-1]))
        if i == len(token):
            p += 0.0 if edge else model(a, b, 0)
            best = max(best, (p, read.strip()))
            continue
        for c, q in toxicity.ways_of(token[i], last):
            if c == "":
                stack.append((i + 1, read, p + q, token[i]))
            elif c == " ":
                stack.append((i + 1, read if edge else read + " ", p + q + (0.0 if edge else model(a, b, 0)), token[i]))
            else:
                stack.append((i + 1, read + c, p + q + model(a, b, ord(c)), token[i]))
    return best


def test_viterbi_equals_all_readings(spark):
    text = "you are an idiot and a moron said the clown with the worthless trash all is lost in glass " * 20
    chars = toxicity.char_model(spark.createDataFrame([(text,)], "text string"))
    rng = random.Random(8)
    for _ in range(150):
        token = "".join(rng.choice("aliost1!0$5@. ee6+") for _ in range(rng.randrange(1, 9)))
        want, reading = plain_restore(token, chars)
        got = toxicity.restore(token, chars)
        assert got == reading or abs(plain_score(token, got, chars) - want) < 1e-9, token


def plain_score(token, reading, model):
    """The best log probability with which a token is read so."""
    only = {}

    def go(i, read, last):
        key = (i, read, last)
        if key not in only:
            edge = read[-1:] in ("", " ")
            a, b = (0, 0) if edge else (ord(read[-2]) if len(read) > 1 and read[-2] != " " else 0, ord(read[-1]))
            if i == len(token):
                only[key] = (0.0 if edge else model(a, b, 0)) if read.strip() == reading else -1e9
            else:
                steps = []
                for c, q in toxicity.ways_of(token[i], last):
                    if c == "" or c == " " and edge:
                        steps.append(q + go(i + 1, read, token[i]))
                    else:
                        steps.append(q + model(a, b, ord(c) if c != " " else 0) + go(i + 1, read + c, token[i]))
                only[key] = max(steps)
        return only[key]

    return go(0, "", "")


def test_trigram_counts(spark):
    texts = ["Ab, abc é abc!", None, "", "x", "漢字かな ab" * 3, "".join(chr(0x4E00 + i) for i in range(300))]
    want = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            c = [0, 0, *map(ord, w), 0]
            for i in range(2, len(c)):
                key = (c[i - 2] if i > 2 else 0, c[i - 1], c[i])
                want[key] = want.get(key, 0) + 1
    model = toxicity.char_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    got = {(int(k) >> 42, int(k) >> 21 & (1 << 21) - 1, int(k) & (1 << 21) - 1): int(n) for k, n in zip(model.keys, model.counts)}
    assert got == want
    pairs = {}
    for (a, b, _), n in want.items():
        pairs[a, b] = pairs.get((a, b), 0) + n
    assert all(abs(model(*k) - np.log((n + 0.05) / (pairs[k[:2]] + 5))) < 1e-12 for k, n in want.items())


def test_toxicity_equals_a_plain_version_and_odd_rows(spark):
    rows = [(i, t, "x", 0.5) for i, t in enumerate(["you idiot", "you 1d10t", "nice day", "nice day", None, "", "1 2 3", "a1" * 40_000, "id.io.t " * 3000])]
    frame = spark.createDataFrame(rows + rows[:2] + [(None, "nice day", "x", 0.5)], "doc_id long, text string, score string, __n double")
    evidence = {"idiot$": 3.0}.get
    model = toxicity.Model(toxicity.char_model(frame), Evidence(), np.array([-2.0, 1.0, 0.5, 0.2, 0.1, -0.1]), 0.5)

    def plain(text):
        low = (text or "").lower()
        words = {w for t in low.split() for w in toxicity.words_of_token(t, model.chars)}
        for m in toxicity._SPACED.findall(low):
            read = toxicity.restore(m, model.chars).split()
            words |= {*read, "".join(read)}
        hit = "idiot" in words
        z = -2.0 + (3.0 if hit else 0.0) - 0.1 * np.log1p(len(set(low.split())))
        return 1 / (1 + np.exp(-z))

    out = toxicity.score(frame, model, keep=["doc_id", "text", "score"])
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(rows) + 3
    for r in out.collect():
        assert abs(r.score - plain(r.text)) < 1e-12


class Evidence:
    def __call__(self, word):
        return 3.0 if word == "idiot" else 0.0


def test_languages_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows[:80]:
        letters = [c for c in (r.text or "").lower()]
        codes = [0]
        for c in letters:
            x = ord(c) if c.isalpha() else 0
            if x or codes[-1]:
                codes.append(x)
        if codes[-1]:
            codes.append(0)
        counts = np.zeros(langid.DIMS)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b or c and a:
                counts[((a * 961 + b * 31 + c) * 2654435761 >> 7) & (langid.DIMS - 1)] += 1
        v = np.log1p(counts) * model.idf
        if not v.any():
            assert got[r.doc_id].lang_pred == "und"
            continue
        cos = [(v @ c) / np.linalg.norm(v) for c in model.centers]
        assert got[r.doc_id].lang_pred == model.langs[int(np.argmax(cos))] and abs(got[r.doc_id].score - max(cos)) < 1e-5


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", 1), (1, "the cat sat on the mat", "en", 2), (2, "der hund und die katze", "de", 3), (None, "das ist ein haus", "de", 4), (3, None, "en", 5), (4, "123 !", "de", 6), (5, "cat " * 300_000, None, 7)], "doc_id long, text string, lang string, lang_pred int")
    model = langid.fit(docs)
    got = sorted((r.doc_id or -1, r.lang_pred) for r in langid.predict(docs, model).collect())
    assert got == [(-1, "de"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en")]
    empty = docs.limit(0)
    assert langid.predict(empty, model).count() == 0 and langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_held_out_and_odd(spark, docs):
    got = op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    out = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["und"] * 3 and out[4].lang_pred == "en"
    assert all(r.lang_pred == "und" for r in langid.predict(docs, langid.fit(docs.filter("lang is null"))).collect())


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>m</a></nav><div class='cookie-notice'>ok?</div><article><h1>A &amp; B</h1><p>one <b>t</b>wo<br>three<p>  four\n five</article><section id=comments><article>bad</article></section><footer>f</footer></body></html>"
    plain = "<body><div><a href=a>home</a> <a href=b>news</a></div>" + "<p>" + "long sentence of real words here. " * 5 + "</p><p>" + "more of the same kind of text. " * 5 + "</p><div><a href=c>x</a><a href=d>y</a></div></body>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut off &am"), (5, "u", plain), (6, "u", "<div class='ad'>only")]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B one two three four five" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[6].text == "" and got[4].text == "cut off &am"
    assert got[5].text.startswith("long sentence") and got[5].text.endswith("kind of text.")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        import html

        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(p|/p|br|h1|/h1)>", " ", body))).split())
        assert extract.main_text(r.html) == want


def test_main_text_beside_small_article():
    body = [f"{w} sentence of real words that goes on for a while here. " * 4 for w in ("first", "second", "third", "fourth")]
    for teaser in ("<article><h3>Also read this</h3></article>", "<main><article><p>A short teaser of another story.</p></article></main>"):
        for page in (teaser + "".join(f"<p>{b}</p>" for b in body), "".join(f"<div>{b}</div>" for b in body) + teaser):
            text = extract.main_text("<body><div><a href=a>home</a> <a href=b>news</a></div>" + page + "<div><a href=c>x</a><a href=d>y</a></div></body>")
            assert all(b.strip() in text for b in body) and "home" not in text


LONG = [f"{w} paragraph with many plain words in it, as an article has them, and then some more of the same. " * 3 for w in ("one", "two", "three", "four")]


def page_of(*blocks):
    menu = "<div><a href=a>home</a> <a href=b>news</a> <a href=c>sport</a></div>"
    return "<body>" + menu + "".join(blocks) + menu + "</body>"


def test_main_text_without_article():
    inner = ["<h2>Heading</h2>", f"<p>{LONG[0]}", f"<div>{LONG[1]}</div>", "<p>Short.</p>", f"<p>{LONG[2]}</p>", "<h3>Another</h3>", f"<p>{LONG[3]}</p>"]
    want = f"Heading {LONG[0]}{LONG[1]}Short. {LONG[2]}Another {LONG[3]}".strip()
    assert extract.main_text(page_of(*inner)) == want
    assert extract.main_text(page_of("<section id=social-history>", *inner, "</section>")) == want
    assert extract.main_text(page_of(*inner, "<div class='socialShare'>" + LONG[0] + "</div>", "<p class='site-footer ad-slot'>" + LONG[1])) == want


def test_main_text_with_elements_left_open():
    for odd in ("<nav><a href=x>menu</a>", "<header><p>Site", "<nav><ul><li><a href=x>m</a>"):
        assert extract.main_text(f"<body>{odd}<article><p>{LONG[0]}</p><p>Short.</p></article></body>") == f"{LONG[0]}Short."
    assert extract.main_text(f"<article><p>{LONG[0]}</p><div class=comments><article>{LONG[1]}</article></div></article>") == LONG[0].strip()


def test_smoothing_decides():
    # a lone long line among links is no region; short lines within a region are
    links = "".join(f"<li><a href=x{i}>link {i}</a>" for i in range(4))
    stray = "<ul>" + links + "<li>" + "offer of the day " * 12 + links + "</ul>"
    page = page_of(stray, *(f"<p>{x}</p>" for x in LONG))
    assert extract.main_text(page) != extract.main_text(page, smoothed=False)
    assert extract.main_text(page) == "".join(LONG).strip()


def plain_main(lines, smoothed=True):
    """Ratio, Gaussian and two clusters from the lines of a page, written out with arrays."""
    if not lines:
        return ""
    x = np.log1p([max(0, len(t) - k) / max(1, tags) for t, tags, k, _, _ in lines])
    if smoothed:
        near = np.subtract.outer(np.arange(len(x)), np.arange(len(x)))
        w = np.where(np.abs(near) <= 2, np.exp(-(near**2) / 2), 0)
        x = w @ x / w.sum(1)
    own = np.array([max(0, len(t) - k) for t, _, k, _, _ in lines])
    inside = np.array([line[3] for line in lines])
    x = x + inside * extract.INSIDE * own[inside].sum() / max(1, own.sum())
    values = np.append(x, 0.0) if own[inside].sum() else x
    low, high = values.min(), values.max()
    at = low
    if high - low >= 0.7:
        for _ in range(30):
            at = (low + high) / 2
            low, high = values[values < at].mean() if (values < at).any() else low, values[values >= at].mean()
        at = (low + high) / 2
    chosen = list(x >= at - 1e-12)
    whole = list(chosen)
    for i in range(len(lines)):
        later = [j for j in range(i + 1, len(lines)) if chosen[j]]
        if chosen[i] and later and later[0] - i - 1 <= extract.GAP and all(2 * lines[j][2] < len(lines[j][0]) and lines[j][3] == lines[later[0]][3] for j in range(i + 1, later[0])):
            whole[i + 1 : later[0]] = [True] * (later[0] - i - 1)
    for i in range(len(lines) - 1, -1, -1):
        if not whole[i] and lines[i][4] and lines[i][2] == 0 and i + 1 < len(lines) and (chosen[i + 1] or whole[i + 1] and lines[i + 1][4]):
            whole[i] = True
    return " ".join(line[0] for line, use in zip(lines, whole) if use)


def test_main_text_equals_a_plain_version_and_its_parts_count(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for html in pages:
        for smoothed in (True, False):
            assert extract.main_text(html, smoothed) == plain_main(extract.lines_of(html), smoothed)
    # without the Gaussian some pages change; without the markup's word the ratios alone still settle nearly all
    assert sum(extract.main_text(h) != extract.main_text(h, smoothed=False) for h in pages) >= 5
    assert sum(extract.main_text(h) == extract.main_text(h, inside=0.0) for h in pages) >= 0.9 * len(pages)


def test_broken_markup_takes_time_in_proportion():
    import time

    for odd in ("<div>" * 20_000 + "</section>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<div>" * 20_000):
        began = time.time()
        assert "words" in extract.main_text("<article><p>some words here" + odd + "</article>")
        assert time.time() - began < 5


def test_main_text_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a", "x"), (1, "u", "<p>a", "y"), (None, None, "<p>a", None)], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in extract.extract(frame).collect()] == [(1, "u", "a", 1)] * 2 + [(None, None, "a", 1)]
    assert extract.extract(frame.limit(0)).count() == 0
    assert extract.main_text("<article><p>" + "word " * 500_000) == ("word " * 500_000).strip()


def test_main_text_after_odd_declarations():
    for odd in ("<![foo[", "<![ x", "<![if !IE]", "<![endif]--", "<![CDATA[x]]", "<![", "<![" + "]" * 3):
        assert extract.main_text(f"<article><p>one two {odd}><p>three four</p></article><p>end").startswith("one two three four")


def test_contaminated(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(30)] + [(30, None), (31, ""), (32, "two words")]
    texts, want = [], {}
    for i in range(90):
        words = [word() for _ in range(rng.randrange(5, 200))]
        if i % 3 == 0:
            item = items[i // 3][1].split()
            for _ in range(i % 2 * len(item) // 8):  # edits
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(words))
            words[at:at] = item
            want[i] = i // 3
        texts.append((i, " ".join(words) + "."))
    texts += [(100, None), (101, ""), (102, "here two, WORDS there")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == set(want.items()) | {(102, 32)}
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def smith_waterman(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(2, 6, rng.integers(1, 30)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    assert decontam.align(pairs)[0].tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs]


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, [f"i{i}n{j}" if j % 3 else f"common{j % 7}" for j in range(n)]) for i, n in enumerate((10, 12, 25, 40, 59))]
    texts = []
    for i, w in items:
        edited = [w, w[:5] + ["x"] + w[6:], w[:6] + ["x"] + w[7:], [y for j, x in enumerate(w) for y in ([x] if j == len(w) - 1 else [x, f"y{j}"])]]
        for step in (3, 4, 5, 7):
            edited += [[f"z{j}" if j % step == at else x for j, x in enumerate(w)] for at in (0, step - 1)]  # other words
            edited += [[y for j, x in enumerate(w) for y in ([x, f"y{j}"] if j % step == 1 else [x])], [x for j, x in enumerate(w) if j % step != 1]]
        for e in edited:
            texts.append([f"b{rng.randrange(300)}" for _ in range(rng.randrange(60))] + e + [f"common{rng.randrange(7)}" for _ in range(rng.randrange(60))])
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    names = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(d, i): smith_waterman(w, t) / (2 * len(w)) for d, t in enumerate(texts) for i, w in items}
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame, names).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.5} and len(got) > 80


def test_licenses(spark, docs):
    assert licenses.patience(list("abcdxe"), list("abxcde")) in ([(0, 0), (1, 1), (2, 3), (3, 4), (5, 5)], [(0, 0), (1, 1), (4, 2), (5, 5)])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {}
    for r in licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    lines = {"Apache-2.0": "licensed under the apache license version 2 0", "MIT": "released under the mit license", "GPL-3.0": "this work is licensed under the gnu general public license version 3", "CC-BY-NC-4.0": "licensed under cc by nc 4 0"}
    for i, text in rows:
        flat = " ".join(re.findall(r"\w+", text.lower()))
        assert {n for n, line in lines.items() if line in flat} <= got.get(i, set()), i
        if i in got:
            assert "licen" in flat
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = best[j + 1]
            best[j + 1] = last + 1 if x == y else max(best[j + 1], best[j])
            last = keep
    return best[-1]


def plain_words(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_licenses_equal_plain_alignment(spark):
    """Whole documents are aligned with whole licences, without seeds and passages."""
    rng = random.Random(12)
    names = ["MIT text", "BSD-3-Clause text", "GPL notice", "Apache-2.0", "zlib text"]
    texts = []
    for i in range(30):
        words = plain_words(licenses.TEMPLATES[names[i % len(names)]])
        for _ in range(i * len(words) // 90):  # up to a third is edited
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [f"e{rng.randrange(99)}"], [words[k], "so"]])
        texts.append(" ".join([f"a{rng.randrange(500)}" for _ in range(rng.randrange(50))] + words + [f"a{rng.randrange(500)}" for _ in range(rng.randrange(50))]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): r.coverage for r in licenses.scan(frame).collect()}
    for name in names:
        template = plain_words(licenses.TEMPLATES[name])
        for d, t in enumerate(texts):
            best = longest_common(plain_words(t), template) / len(template)
            found = got.get((d, name), 0.0)
            assert found <= best + 1e-9
            if best >= 0.9 or names[d % len(names)] == name and best >= 0.8:  # patience may match a little less than the longest
                assert found >= best - 0.05 or best - 0.05 < 0.8, (d, name, best, found)


def test_licenses_in_odd_rows(spark):
    line = licenses.TEMPLATES["MIT"]
    notice = licenses.TEMPLATES["GPL notice"]
    rows = [(1, line, "a"), (1, line, "b"), (None, line, "c"), (2, (notice + " ") * 400, "d"), (3, "word " * 300_000 + notice + " word" * 300_000, "e"), (4, None, "f"), (5, "", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or -1, r.license, r.coverage) for r in licenses.scan(frame).collect())
    assert got == sorted([(1, "MIT", 1.0), (1, "MIT", 1.0), (-1, "MIT", 1.0), (2, "GPL notice", 1.0), (3, "GPL notice", 1.0)])
    assert licenses.scan(frame, {}).count() == 0


def test_contaminated_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item, "a"), (1, item, "b"), (None, "x " + item, "c"), (2, (item + " ") * 300, "d"), (3, "z " * 200_000 + item, "e"), (4, None, "f")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, 0), (7, item, 0), (None, "q " + item, 0), (8, None, 0)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id or -1, r.item_id or -1, round(r.score, 3)) for r in decontam.contaminated(docs, items).collect())
    of_item, of_null = [(d, 7, 1.0) for d in (1, 1, -1, 2, 3)] * 2, [(d, -1, round(30 / 31, 3)) for d in (1, 1, -1, 2, 3)]
    assert got == sorted(of_item + of_null)
    both = decontam.contaminated(docs, items)
    assert both.columns == ["doc_id", "item_id", "score", "matched_end"]


def test_edited_licenses(spark):
    short = licenses.TEMPLATES["Apache-2.0"].split()
    edited = [(0, " ".join(short[:3] + ["a"] + short[4:])), (1, " so ".join(licenses.TEMPLATES["MIT"].split())), (2, " ".join(short))]
    assert {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(edited, "doc_id long, text string")).collect()} == {(0, "Apache-2.0"), (1, "MIT"), (2, "Apache-2.0")}


def test_tokens_of_any_length_take_time_in_proportion():
    import time

    model = lambda a, b, c: -3.0
    for token in ("a" * 1_000_000 + ".", "qwxz" * 250_000 + ".", "1" * 1_000_000, "a" * 1_000_000 + "1b"):
        began = time.time()
        toxicity.words_of_token(token, model)
        assert time.time() - began < 5  # a quarter of a second to one here; a quadratic reading took a day


def test_mixed_parts_equal_the_pattern():
    import random
    import re

    pattern = re.compile(r"[^\W_@]*(?:[0-9@$!|+€(<¡£§]+[^\W\d_]|[^\W\d_][0-9@$€£§]+)[^\s,;:\"?]*")
    rng = random.Random(3)
    for _ in range(5000):
        token = "".join(rng.choice('aabbcdefghé1013457@$!|+(<._-*_,;:?"x²½٣€') for _ in range(rng.randint(1, 14)))
        assert toxicity.mixed(token) == pattern.findall(token), token


def test_rows_without_id_lie_in_no_fold(spark, tmp_path):
    rows = [(None, "some words here", "en"), (1, "some words here", "en"), (2, "andere Wörter hier", "de"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from canongraph.llm import queries

    for name in ("op4_toxicity", "op5_language_id"):
        got = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(got) == 4 and all(r.held_out is False for r in got if r.doc_id is None) and all(r.held_out is not None for r in got)


def test_passages_that_may_hold_an_item():
    """Equals counting an item's words in each window, each as often as the item has it at most."""
    rng = random.Random(9)
    items = decontam.Items(list(range(30)), [" ".join(rng.choices([f"w{i}" for i in range(25)], k=rng.randrange(1, 20))) for _ in range(28)] + ["", None], 0.5)
    _, word, _ = next(decontam._document_words(pa.array([" ".join(rng.choices([f"w{i}" for i in range(40)], k=3000))])))
    start = np.array([rng.randrange(3000) for _ in range(500)])
    stop = np.minimum(3000, start + np.array([rng.randrange(60) for _ in start]))
    item = np.array([rng.randrange(28) for _ in start])
    want = []
    for i, a, b in zip(item, start, stop):
        had, has = Counter(word[a:b].tolist()), Counter(items.words[i].tolist())
        want.append(sum(min(had[w], n) for w, n in has.items()) >= items.needed[i])
    for cells in (decontam.CELLS, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontam, "CELLS", cells)
            assert items.may_hold(item, start, stop, *items.vocabulary.find(word)).tolist() == want
    assert 50 < sum(want) < 450
