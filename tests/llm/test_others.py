import hashlib
import itertools
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldlens.llm import html_text, language, lattice, license_scan, mixing, warc


def brute_places(words):
    out = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.encode().split()
        out += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return sorted(out)


def test_license_places_and_spans(spark, docs, empty):
    texts = ["Under the MIT License under the mit license.", "x CC BY-NC y", "apache license, version 2.0", None, "", "nothing here", license_scan.TEMPLATES["apache-2"][0], license_scan.TEMPLATES["gpl-3"][0].replace("redistribute", "spread"), "mit under the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = license_scan.tokens(t)
        places = brute_places(w)
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert got[6].labels == "apache-2" and got[6].score == 1.0
    assert got[7].labels == "gpl-3" and 0.5 < got[7].score < 1
    assert got[5].score == got[3].score == 0.0 and got[5].labels == ""
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    more = [creative.format(""), creative.format("-NoDerivatives"), "the above copyright notice and this permission notice are not here", " ".join(license_scan.TEMPLATES["isc"]), "z " * 50_000 + creative.format(" ShareAlike"), license_scan.GNU_WARRANTY.format(kind="General")]
    df = spark.createDataFrame([*((k, t, 1, "x") for k, t in enumerate(more)), (None, more[0], 1, "x"), (0, more[0], 1, "x")], "doc_id long, text string, labels int, spans string")
    rows = license_scan.scan_licenses(df).collect()
    assert [r.labels for r in sorted(rows[:6], key=lambda r: r.doc_id)] == ["cc-by", "cc-by-nd", "", "isc", "cc-by-sa", ""]
    assert len(rows) == 8 and rows[6].labels == rows[7].labels == "cc-by" and rows[4].spans[0].start == 50_000
    assert license_scan.scan_licenses(empty).count() == 0


def test_automaton_matches_every_run():
    a = license_scan.automaton()
    words = license_scan.tokens("the above copyright notice and this list of conditions and the following disclaimer under the mit license version 2")
    runs = {tuple(w[i:j]) for _, w in a.passages for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    got = {i: n for i, _, n in a.walk(words)}
    for i in range(len(words)):
        longest = max((n for n in range(1, i + 2) if tuple(words[i - n + 1 : i + 1]) in runs), default=0)
        assert got.get(i, 0) == longest


PAGES = [(1, "http://a b", "x" * 3000), (2, None, "x" * 3000), (9, "u", "x" * 3000), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000)]


def test_warc_round_trip(spark, docs):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit(1)).repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df, segment=700, chunk=256, per_file=5).collect()}
    for i, _, h in PAGES:
        data = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
        assert (None if r.payload is None else bytes(r.payload)) == (None if i in (1, 2) else data)
    assert warc.round_trip(df.limit(0)).count() == 0
    twice = warc.round_trip(df.unionAll(df)).collect()
    assert len(twice) == 2 * len(PAGES) and all(r.record_type == got[r.page_id].record_type for r in twice)


def test_warc_faults_are_errors():
    records = warc.page_records(1, "u", b"a" * 1000, None, 300, 100)
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    assert len(list(warc.parse_records([whole]))) == len(records) > 3
    assert [b for _, b in warc.parse_records([whole[:500], whole[500:]])] == [b for _, b in warc.parse_records([whole])]
    with pytest.raises(ValueError):
        list(warc.parse_records([whole[:-7]]))
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_archives_of_others(spark, docs, tmp_path):
    import gzip

    def record(kind, block, *fields):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", "WARC-Date: 2024-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    plain, open_ended = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello and more", b"HTTP/1.0 200 OK\r\n\r\nall the rest"
    records = [
        record("warcinfo", b"software: x\r\n"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/"),
        record("response", plain, "WARC-Target-URI: http://a/", http, "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest()),
        record("response", open_ended, "WARC-Target-URI: http://b/", http, "WARC-Payload-Digest: md5:abc"),
        record("resource", b"raw bytes", "WARC-Target-URI: http://c/", "Content-Type: text/plain"),
        record("metadata", b"x"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))  # a member for each record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)) + b"\0" * 100)
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    got = sorted((r.url, r.record_type, bytes(r.payload), r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect())
    want = [("http://a/", "response", b"hello"), ("http://b/", "response", b"all the rest"), ("http://c/", "resource", b"raw bytes")]
    assert got == sorted(3 * [(*w, hashlib.sha1(w[2]).hexdigest()) for w in want])
    big = gzip.compress(record("resource", bytes(range(256)) * 20_000, "Content-Type: text/plain"))
    assert sum(len(b) for _, b in warc.parse_records(warc.unpacked(big))) == 5_120_000
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.unpacked(big[:-20])))


def test_null_page_id(spark, docs):
    df = spark.createDataFrame([(None, "u", "y" * 2000), (None, "u", "y" * 2000), (3, "u", "y" * 2000)], "page_id long, url string, html string")
    got = sorted((r.page_id is None, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect())
    assert len(got) == 3 and got[0] == (False, "response", None, 2000) and all(x[3] == 2000 for x in got)


def brute_word(s, weights, low):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(s[at:i])
                at = i
        parts.append(s[at:])
        lp = 0.0
        for p in parts:
            if p in weights:
                lp += weights[p]
            elif len(p) == 1:
                lp += sum(low[b] for b in p.encode())
            else:
                break
        else:
            total += math.exp(lp)
    return math.log(total)


def test_lattice_sums_all_segmentations():
    weights = {"▁": -2.0, "a": -1.5, "b": -2.5, "ab": -1.0, "▁a": -1.2, "▁ab": -3.0, "ba": -0.7, "<0xC3>": -4.0}
    lat = lattice.Lattice(weights)
    for w in ("a", "abab", "baab", "xay", "é", "bbbbabab"):
        assert lat.forward(w.encode()) == pytest.approx(brute_word("▁" + w, weights, lat.bytes))
    from collections import defaultdict

    into = defaultdict(float)
    lat.expect(b"abab", 2.0, into)
    assert sum(len(p) * e for p, e in into.items() if not p.startswith("<")) == pytest.approx(2 * 5)


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_scores_against_brute_force(docs, rows, frequent):
    low = lambda t: (t or "").encode().lower().split()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    c = Counter()
    for i, t, *_ in rows:
        if not held[i]:
            c.update(low(t) + [b""])
    n, v = sum(c.values()), len(c)
    for r in lattice.score_documents(docs, frequent=frequent).collect():
        words = low(next(t for i, t, *_ in rows if i == r.doc_id)) + [b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0


def test_score_against_plain_python(docs, rows):
    from collections import defaultdict

    low = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(low(t) + [b""])
    n, v = sum(c.values()), len(c)
    prior = lattice.load_pieces()
    first, used = lattice.Lattice(prior), defaultdict(float)
    for w, k in c.items():
        if w:
            first.expect(w, k, used)
    odd = docs.withColumn("word", F.lit(1)).withColumn("c", F.lit("x"))
    got = lattice.score_documents(odd.unionAll(odd), frequent=40).collect()
    assert len(got) == 2 * len(rows)
    c2 = Counter({w: 2 * k for w, k in c.items()})  # repeated rows train twice
    total2 = 2 * (sum(used.values()) + c[b""]) + 1001
    fitted = lattice.Lattice({p: math.log((2 * used.get(p, 0.0) + 1000 * math.exp(x)) / total2) for p, x in prior.items()})
    chance = lambda w: (c2[w] + v * ((c2[b""] + 1) / total2 if not w else math.exp(fitted.forward(w)))) / (2 * n + v)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        assert r.score == pytest.approx(sum(math.log10(chance(w)) for w in low(texts[r.doc_id]) + [b""]), rel=1e-6)


def test_scores_do_not_depend_on_what_is_in_memory(docs, empty):
    a = {r.doc_id: r.score for r in lattice.score_documents(docs).collect()}
    b = {r.doc_id: r.score for r in lattice.score_documents(docs, frequent=40).collect()}
    assert a == pytest.approx(b)
    assert lattice.score_documents(empty).count() == 0


def test_main_text_of_pages(spark, docs):
    w = html_text.default_weights()
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- c --><div class="ad">Buy this now.</div><article><h1>A &amp; B &lt;c&gt;</h1><p><b>First one here.<br><p>Second  &eacute;\n part of <i>it</i>, with <a href=y>a link</a> inside.</p><div class="comments"><p>I do not agree with this text at all.</p></div></article><aside class="sidebar"><p>More to read.</p></aside><footer>&copy; 2024 &middot; All of it.</footer></body></html>'
    assert html_text.extract(page, w) == "A & B <c>\nFirst one here.\nSecond é part of it, with a link inside."
    for odd in (None, "", "   ", "<", "<p", "<<<>>>", "<article><p>cut off in the mid", "<!-- never closed", "<script>x"):
        assert isinstance(html_text.extract(odd, w), str)
    for name in ("button", "select", "object", "svg", "noscript", "iframe", "template"):
        assert html_text.extract(f"<article><p>First text here.</p><{name}><p>Second text that is here.</p></article>", w, "|") == "First text here.|Second text that is here."
    assert html_text.extract("<article><p>Some text that was cut off in the mid.</p><script>var x = 1;<p>Second text.</p>", w) == "Some text that was cut off in the mid."
    assert html_text.extract("<article><p>First text here.</p><script>x</script ><p>Second text that is here.</p></article>", w, "|") == "First text here.|Second text that is here."
    assert html_text.extract("<article><p>First text here.</p><button>Press</button><p>Second text that is here.</p></article>", w, "|") == "First text here.|Second text that is here."
    assert html_text.extract("<article>" + "<p>One more block of the text.</p>" * 20_000, w).count("\n") == 19_999
    assert isinstance(html_text.extract("<select>" * 30_000 + "text", w), str)
    assert html_text.extract("<article><p>Some text that was cut off in the mid", w) == "Some text that was cut off in the mid"
    deep = "<div>" * 3000 + "<p>Deep text that is here.</p>"
    assert isinstance(html_text.extract(deep, w), str)
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in html_text.main_text(df).collect())
    assert got[0] == got[1] and got[2] == (2, 0, 0) and all(a == b for _, a, b in got)


def test_small_pages_against_every_labelling():
    w = html_text.default_weights()
    pages = ["<article><h1>A title of it</h1><p>One.<br>Two <b>bold</b>.<p>Three</article><footer>&copy; x</footer>", "<div class=ad>Buy.<p>Now.</p></div><div><div>Deep <div>deeper text.</div></div></div>", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "text alone &amp; so on", "<nav><a href=x>Home</a></nav><main>Main text is here.</main>"]
    for page in pages:
        tree = html_text.parse(page)
        n = len(tree.parent)
        assert n < 14
        total, share = 0.0, [0.0] * n
        for y in itertools.product([0, 1], repeat=n):
            s = sum(max(-30.0, min(30.0, sum(w.get(f, 0.0) for f in html_text.describe(tree, i)))) for i in range(n) if y[i])
            s += sum(w.get(f"pair:{html_text._kind(tree, i)}:{y[tree.parent[i]]}{y[i]}", 0.0) for i in range(n) if tree.parent[i] >= 0)
            total += math.exp(s)
            share = [a + math.exp(s) * b for a, b in zip(share, y, strict=True)]
        want = "\n\n".join(t for t, p in zip(tree.text, share, strict=True) if t is not None and p / total > 0.5)
        assert html_text.extract(page, w, "\n\n") == want


def test_blocks_of_main_text_are_two_newlines_apart(spark, docs):
    df = spark.createDataFrame([(1, "u", "<article><h1>Title of it</h1><p>First one here.</p><p>Second one here.</p></article>")], "page_id long, url string, html string")
    r = html_text.main_text(df).first()
    assert (r.text, r.n_chars) == ("Title of it\n\nFirst one here.\n\nSecond one here.", 46)


def test_held_out_labelled_pages():
    w = html_text.default_weights()
    right = total = 0
    for tree, gold in html_text.labelled_pages(60, seed=99):
        prob, _ = html_text.marginals(tree, w)
        for t, y, p in zip(tree.text, gold, prob, strict=True):
            if t is not None:
                total += 1
                right += (p > 0.5) == bool(y)
    assert right / total > 0.97


def test_messages_give_exact_marginals():
    tree = html_text.parse('<div class="ad"><p>one</p><ul><li>two words.</li></ul></div>')
    w = {"bias": 0.3, "hint:ad": -1.0, "text": 0.4, "tag:p": 0.2, "pair:text:11": 0.7, "pair:plain:00": 0.5, "pair:marked:01": -0.6}
    n = len(tree.parent)
    weight, share = 0.0, [0.0] * n
    for y in itertools.product([0, 1], repeat=n):
        s = sum(w.get(f, 0.0) for i in range(n) if y[i] for f in html_text.describe(tree, i))
        s += sum(w.get(f"pair:{html_text._kind(tree, i)}:{y[tree.parent[i]]}{y[i]}", 0.0) for i in range(n) if tree.parent[i] >= 0)
        weight += math.exp(s)
        share = [a + math.exp(s) * b for a, b in zip(share, y, strict=True)]
    assert html_text.marginals(tree, w)[0] == pytest.approx([s / weight for s in share])


TEXTS = {"en": "the and of to in that with this from have which their would there about", "fr": "le la les des une dans pour que qui est avec sur pas plus nous", "de": "der die das und nicht mit von ist ein eine auch sich auf für werden"}


def made_texts(n, seed):
    import random

    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(TEXTS[lang].split()) for _ in range(rng.randint(5, 40))), lang) for k in range(n) for lang in [rng.choice(list(TEXTS))]]


def test_language_held_out_accuracy(spark, docs):
    rows = made_texts(400, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, sample=300)
    assert sorted(model.langs) == ["de", "en", "fr"]
    fresh = made_texts(200, 2)
    assert sum(model.predict(t)[0] == lang for _, t, lang in fresh) / len(fresh) > 0.97
    for odd in (None, "", " \n", "123 ... !!"):
        assert model.predict(odd) == ("und", 0.0, True)
    extra = df.withColumn("score", F.lit("x")).withColumn("more", F.lit(1))
    got = language.identify(extra, model)
    assert sorted(got.columns) == ["doc_id", "lang", "lang_pred", "more", "rejected", "score", "text"]
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_language_of_odd_rows(spark, docs):
    rows = made_texts(300, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.unionAll(df), sample=200)
    long = " ".join(t for _, t, lang in made_texts(4000, 5) if lang == "fr")
    odd = spark.createDataFrame([(1, long), (1, long), (None, "der die das und nicht"), (2, None)], "doc_id long, text string").withColumn("rejected", F.lit(3))
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language.identify(odd, model).collect()]
    assert got == [(1, "fr", False), (1, "fr", False), (None, "de", False), (2, "und", True)]
    mixed = "the der le of und la to die les"  # more likely any other than the one predicted, or told with less than one half
    assert model.threshold == 0.5 and model.predict(mixed)[1] < model.predict(long)[1]


def test_rare_language_is_learned(spark, docs):
    rows = [(k, t, lang) for k, t, lang in made_texts(3000, 6) if lang != "de" or k % 40 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, sample=120)
    fresh = [t for _, t, lang in made_texts(200, 7) if lang == "de"]
    assert sum(model.predict(t)[0] == "de" for t in fresh) / len(fresh) > 0.9


def test_language_without_labels(spark, docs, empty):
    model = language.train(empty)
    assert model.predict("some text")[0] == "und"
    assert language.identify(empty, model).count() == 0


def test_language_never_learns_held_out_rows(spark, docs):
    rows = [(k, "zu zu", "zz") for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2] + made_texts(200, 3)[:100]
    rows = rows[:-100] + [r for r in made_texts(200, 3) if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert "zz" not in language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=500).langs


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, list(names)
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s]] if total else []
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        free = [s for s in free if s not in over]


@pytest.mark.parametrize("block", [64, 3])
def test_mix(docs, rows, block):
    got = {r.doc_id: r for r in mixing.pivotal_mix(docs, block=block).collect()}
    sizes, source = Counter(), {i: s for i, _, _, s, _ in rows}
    for i, t, _, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
        assert got[i].size == len((t or "").encode().split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    cut = Counter()
    for i, r in got.items():
        assert r.source_size == sizes[source[i]] and r.target == pytest.approx(want[source[i]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[i]] += r.taken
        cut[source[i]] += bool(r.size and r.taken % r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1.5 and cut[s] <= 1
    again = {r.doc_id: r.taken for r in mixing.pivotal_mix(docs.repartition(3), block=block).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_rounding_is_unbiased(spark, docs):
    df = spark.createDataFrame([(k, "w " * (k % 3 + 1), "a" if k < 8 else "b") for k in range(16)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(12):
        for r in mixing.pivotal_mix(df, weights=(3, 1, 2), seed=seed).collect():
            total[r.doc_id] += r.taken / (r.size * 12)
            want = {r.doc_id: r.target / r.source_size}
            assert abs(r.taken / r.size - want[r.doc_id]) <= 1
    assert all(abs(total[k] - (2.0 if k < 8 else 1.0)) < 0.6 for k in range(16))


def test_mix_of_empty_and_wordless(spark, empty):
    assert mixing.pivotal_mix(empty).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.pivotal_mix(df).collect()] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_language_sample_has_its_former_bound():
    import inspect

    assert inspect.signature(language.train).parameters["sample"].default >= 4000
