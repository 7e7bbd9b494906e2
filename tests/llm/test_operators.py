"""The text operators against plain versions, on a small table of awkward rows and on the smallest given tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from stallbook.llm import bpe, components, decontaminate, kneser_ney, langid, ledger, pii, queries, simhash, suffixes, urls, wrappers

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (300, 300), (None, 5)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100} | {k: 500 for k in range(500, 560)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "this passage stands in several documents and goes on"), (2, "too short"), (3, None), (None, "a text without an id a text"),
                                   (4, "word1 thing1 of the1 word2 thing2 of the2 not in there at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained_items(docs, items).collect()}
    cut = lambda t: {tuple(w[i:i + 5]) for w in [WORD.findall(lowered(t))] for i in range(len(w) - 4)}
    expected = {}
    for d, t in set(rows_of(docs)):
        for i, x in ((r.item_id, cut(r.text)) for r in items.collect()):
            n = len(x & cut(t))
            if d is not None and i is not None and n and 100 * n >= 80 * len(x):
                expected[d, i] = n, len(x)
    assert got == expected and set(got) == {(8, 1), (9, 1)}
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0 == decontaminate.contained_items(docs, items.limit(0)).count()


PAGE = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><main><article><h1>A &amp; B</h1>
<p>One <b>two</b>\n three<br>four</p><ul><li>x<li>y</ul><form>f</form><aside>s</aside><section class="comments"><p>bad</p></section>
<p title="a>b">a &lt; b &#233;</article></main><footer>f</footer></body></html>"""


def test_wrappers(spark):
    rows = [(1, "http://a.b/1", PAGE), (2, "http://a.b/2", None), (3, None, ""), (4, "http://a.b/3", "<div>" * 3000 + "deep"), (5, "http://c.d/", "<p>only <b>text"), (5, "http://c.d/", "<p>only <b>text")]
    got = sorted((r.page_id, r.text) for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "A & B\nOne two three four\nx\ny\na < b é"), (2, ""), (3, ""), (4, "deep"), (5, "only text"), (5, "only text")]
    one, two = (wrappers.read_page(x).root for x in ("<div><p>a<p>b</div>", "<div><h2>t</h2><p>a</div><hr><table></table>"))
    assert wrappers.expression(wrappers.wrapper_of(one, two)) == "<page> <div> <h2> # </h2>? (<p> # </p>)+ </div> <table>  </table>? </page>"


def test_deep_pages_and_pages_without_article(spark):
    nest = lambda n, x: "<div>" * n + x + "</div>" * n
    deep = f"<body><div><article><p>one</p>{nest(200, 'two<nav>menu</nav>')}<p>three</p></article></div><p>other</p></body>"
    rows = [(1, "http://a.b/1", deep), (2, "http://c.d/1", nest(5000, f"<p>x</p><article>in{nest(3000, 'side')}</article>") + "<p>y</p>"),
            (3, "http://e.f/1", "<body><div><nav>menu</nav><div><p>first</p></div><div><p>second, a longer one</p></div></div><footer>f</footer></body>")]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one\ntwo\nthree", 2: "in\nside", 3: "first\nsecond, a longer one"}
    tree = wrappers.read_page(deep).root
    assert wrappers.Node.unpack(tree.pack()).pack() == tree.pack()


def bare(i, *more):
    """A page without semantic elements or telling classes: only what varies between pages says what the article is."""
    return (f"<body><div><div>Home</div><div>About us</div></div><div><div>Title {i}</div>{''.join(f'<div>Story {i} {m}.</div>' for m in more)}</div>"
            f"<div>All rights are ours</div></body>")


def test_wrapper_finds_the_article_where_no_name_does(spark):
    rows = [(i, f"http://a.b/{i}", bare(i, *range(i % 3 + 1))) for i in range(7)] + [(20, "http://c.d/1", bare(1, 2)), (21, "http://c.d/2", bare(1, 2)), (22, "http://c.d/3", bare(1, 2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()}
    for i in range(7):
        assert got[i] == "\n".join([f"Title {i}", *(f"Story {i} {m}." for m in range(i % 3 + 1))])
    assert got[20] == got[21] == got[22] and "Title 1" in got[20]  # copies of one page say nothing about what varies


def test_article_that_never_varies_is_none():
    pages = [f"<body><article>Read our magazine</article><main><p>News {i}</p></main></body>" for i in range(4)]
    rules = wrappers.article_rules(wrappers.wrapper_of(*(wrappers.read_page(x).root for x in pages)), True)
    assert wrappers.article_text(wrappers.read_page(pages[0]), rules) == "News 0"


def test_inline_parts_and_references():
    page = wrappers.read_page("""<article><p>a &am<b>p;</b> &amp; <span class="advert">Buy <span>it</span> <b>now</b></span>x<span hidden>no</span>
<sup class=share>s</sup><sup>2</sup> <label>L</label>end<p><i class="ad">unclosed<p>next</article>""")
    assert wrappers.article_text(page, wrappers.article_rules(wrappers.wrapper_of(page.root), False)) == "a &amp; & x 2 end\nnext"


def test_work_grows_with_the_page_and_not_its_depth():
    start = time.process_time()
    page = wrappers.read_page("<div>a" * 100_000 + "<ul><li>" * 1000)
    wrapper = wrappers.wrapper_of(page.root)
    assert len(wrappers.article_text(page, wrappers.article_rules(wrapper, False))) == 199_999
    assert len(wrappers.Node.unpack(wrapper.pack()).pack()) == len(wrapper.pack()) and time.process_time() - start < 30


def test_common_sequences():
    rng = random.Random(2)
    for _ in range(300):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        got = list(wrappers._common(x, y))[::-1]
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


def test_pages_of_an_empty_table_and_clashing_names(spark):
    schema = "page_id long, url string, html string"
    assert wrappers.extract_main_text(spark.createDataFrame([], schema)).count() == 0 == urls.judge_pages(spark.createDataFrame([], schema), urls.RULES).count()
    plain = spark.createDataFrame([(1, "http://a.example.org/es/1", PAGE), (None, None, None), (2, "x", "<p>t" * 400_000)], schema)
    more = plain.withColumns({n: F.lit("z") for n in ("host", "node", "rule", "rules", "wrapper", "salt", "seen", "text", "path", "component", "verdict")})
    for run in (wrappers.extract_main_text, lambda df: urls.judge_pages(df, urls.RULES)):
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(more).collect()))


def test_pages_against_their_markup(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op2_html_extraction(spark, FOLDER).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def plain_cut(texts, window=200):
    seen = Counter(b[p:p + window] for b in texts for p in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - window + 1):
            if seen[b[p:p + window]] > 1:
                gone[p] += 1
                gone[p + window] -= 1
        gone = (np.cumsum(gone) > 0)[:len(b)]
        runs = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(b), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        s = np.array([rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 60))], np.uint16)
        assert suffixes.suffix_array(s, 1000, 257).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [16_384, 1])
def test_repeated_bytes(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_SEGMENTS", hot)
    got = suffixes.remove_repeats(docs)
    got = got.select("doc_id", "n_bytes", F.size("runs"), (F.col("n_bytes") - F.octet_length("kept")).alias("x"), F.sha2("kept", 256)).collect()
    texts = rows_of(docs)
    expected = Counter((d, n, spans, removed, h) for (d, _), (n, removed, spans, h) in zip(texts, plain_cut([(t or "").encode() for _, t in texts])))
    assert Counter(map(tuple, got)) == expected
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_ledger(spark, docs):
    rows = ledger.ledger(docs).collect()
    assert len(rows) == docs.count()
    for d, t in rows_of(docs):
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (d, len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))) in {(r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) for r in rows}
    table = ledger.ledger(docs)
    by_rule = {r.rule: r for r in ledger.ablations(table, ledger.CURRENT).collect()}
    bits = [r.failed for r in rows]
    assert by_rule["few_words"].n_failed == sum(b & 1 for b in bits) and by_rule["few_words"].n_only == sum(b == 1 for b in bits)
    assert by_rule["few_words"].n_kept_without == sum(b & ~1 == 0 for b in bits)
    assert ledger.ledger(docs.limit(0)).count() == 0


def test_personal_data(spark, docs):
    found = {r.doc_id: r.pii_spans for r in pii.find_spans(docs).collect()}
    text = next(t for d, t in rows_of(docs) if d == 12)
    assert [(s.kind, text[s.start:s.end]) for s in found[12]] == [
        ("email", "ann@example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert {s.kind: s.score for s in found[12]}["iban"] == 1.0 and found[5] == [] == found[4]
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[12].text == "Mail [EMAIL], call [PHONE], card [CARD], IBAN [IBAN] host [IP]." and clean[5].text is None and clean[12].key == "x"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0


def test_bytes(spark, docs):
    with open(VOCABULARY, "rb") as file:
        vocabulary = bpe.Vocabulary(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for r in bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, decode=True).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    encoder, rng = bpe.Encoder(vocabulary, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcdeéß  \n\t.!=-'s01ABZ中🙂thing") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert encoder.extend(a, encoder.encode(a), b).tolist() == library.encode_ordinary(a + b)
        table = bpe.PrefixTable(vocabulary, a.encode())
        cut = rng.randint(0, len(a.encode()))
        table.replace(cut, cut, b.encode())
        assert table.last == bpe.PrefixTable(vocabulary, table.data).last


def test_kneser_ney(spark, docs):
    """Against the formulas with dictionaries; the chances of all continuations of a context add up to one."""
    labels = spark.createDataFrame([(d, 1, 0) for d in (1, 2, 3, 7, 8, 9, 10, 12)] + [(None, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == docs.select("doc_id", "lang", "text").distinct().count()
    assert not any(r.kept for r in got if not r.n_chars) and all(r.perplexity is None for r in got if not r.n_chars)
    model = spark.createDataFrame([("abcd", 3), ("abce", 1), ("bcda", 2), ("xbcd", 1), ("zzza", 4)], "s string, n long")
    pack = lambda s: sum(ord(c) << 16 * (3 - i) for i, c in enumerate(s))
    counts = {pack(r.s): r.n for r in model.collect()}
    tables = {4: counts}
    for k in (3, 2, 1):
        tables[k] = Counter(g & ((1 << 16 * k) - 1) for g in tables[k + 1])

    def chance(gram, k):
        if k == 0:
            return 1 / 65536
        gram &= (1 << 16 * k) - 1
        n1, n2, n3, n4 = (sum(c == x for c in tables[k].values()) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [min(max(x, 0), i) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)] if n1 and n2 and n3 else [0.5, 0.75, 1.0]
        cut = lambda c: d[min(c, 3) - 1]
        same = [c for g, c in tables[k].items() if g >> 16 == gram >> 16]
        below = chance(gram, k - 1)
        if not same:
            return below
        own = tables[k].get(gram, 0)
        return (max(own - cut(own), 0) if own else 0) / sum(same) + sum(map(cut, same)) / sum(same) * below

    wanted = [pack(s) for s in ("abcd", "abcz", "qqqa", "zbcd", "bcda")]
    found = kneser_ney.log_probabilities(spark.createDataFrame(list(counts.items()), "gram long, n long"), spark.createDataFrame([(w,) for w in wanted], "gram long"))
    for r in found.collect():
        assert abs(r.logp - np.log(chance(r.gram, 4))) < 1e-9
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0 and kneser_ney.classify(docs, labels.limit(0)).where("not kept and n_chars > 0").count() == 0


def test_few_bad_words_in_a_long_text(spark, monkeypatch):
    """Bad words that the mean hides are seen in the worst windows; clean texts stay, however many shards there are."""
    rng = random.Random(4)
    spell = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    few, many = [spell("aeinrst") for _ in range(30)], [spell("aeinrstlod") for _ in range(600)]
    rows = [(i, " ".join(rng.choice(few if i % 2 else many) for _ in range(400)), "en") for i in range(200)]
    for i in range(200, 220):
        text = [rng.choice(few) for _ in range(400)]
        for _ in range(6):
            text[rng.randrange(400)] = spell("qxzjkvw")
        rows.append((i, " ".join(text), "en"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    verdicts = kneser_ney.classify(table, labels).collect()
    assert all(r.drawn_perplexity < r.threshold for r in verdicts if r.doc_id >= 200)
    assert sum(r.kept for r in verdicts if r.doc_id >= 200) == 0 and sum(not r.kept for r in verdicts if r.doc_id < 200) <= 6
    monkeypatch.setattr(kneser_ney, "SHARD_ROWS", 500)
    again = {r.doc_id: r for r in kneser_ney.classify(table, labels).collect()}
    for r in verdicts:
        assert (again[r.doc_id].window_perplexity, again[r.doc_id].kept) == (r.window_perplexity, r.kept) and abs(again[r.doc_id].perplexity - r.perplexity) < 1e-9


def test_languages(spark, docs, given):
    model = langid.train(given.where(~langid.held_out()))
    truth = {r.doc_id: r.lang for r in given.where(langid.held_out()).collect()}
    got = {r.doc_id: r for r in langid.predict(given, model).collect()}
    assert sum(got[d].lang_pred == x for d, x in truth.items()) >= 0.95 * len(truth) and all(zlib.crc32(str(d).encode()) % 3 == 1 for d in truth)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(odd[d].lang_pred == "und" and odd[d].score == 0 for d in (4, 5, 11)) and all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://x.example.org/es/1", None), (2, "http://a.net/p#f", link.format("http://x.example.org/es/1")), (3, "https://b.net/q", '<meta http-equiv="refresh" content="0; url=//a.net/p">'),
        (4, "http://c.net/", link.format("https://ok.org/")), (5, "http://d.net/", link.format("http://c.net/")), (6, None, ""), (7, "no scheme", None),
        (8, "HTTP://Sub.EXAMPLE.org/en/12?x=1", None), (9, "http://y.com/de/1", link.format("http://c.net/")), (1, "http://x.example.org/es/1", None),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES).collect())
    verdicts = {r[0]: r[3:] for r in got}
    assert len(got) == 10 and verdicts[2] == (None, "block") == verdicts[3] and verdicts[5] == (None, "allow") and verdicts[9] == ("com/de/", "block")
    assert verdicts[8] == ("example.org/en/1", "block") and verdicts[6] == (None, "allow") and [r[1:3] for r in got if r[0] == 7] == [("", "")]


def fingerprint(text):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    prints = {(d, t): fingerprint(t) for d, t in rows_of(docs)}
    values = sorted(set(prints.values()))
    label = {v: v for v in values}
    for _ in values:
        label = {v: min(label[x] for x in values if (x ^ v).bit_count() <= 3) for v in values}
    least = {}
    for (d, _), v in prints.items():
        if d is not None:
            least[label[v]] = min(d, least.get(label[v], d))
    expected = Counter((d, fingerprint(t), least.get(label[fingerprint(t)])) for d, t in rows_of(docs))
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole_plans_miss_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for v in base for _ in range(5)})
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fingerprint long")
    masks = simhash.search_plan(frame, 3)
    for a in values[:80]:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                assert any(a & m == b & m for m in masks)


def test_many_tokens_are_put_together_in_steps(monkeypatch):
    """Ids give back their bytes, also where a step ends inside a character; each token is taken by its place among the bytes of all."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoder = bpe.Encoder(bpe.Vocabulary(file.read()), public_tokenizers.PATTERN)
    text = "Züge 🙂 und Bücher, 12 km\t\n weit " * 3
    ids = encoder.encode(text)
    assert encoder.vocabulary.data.tobytes()[encoder.vocabulary.starts[ids[0]]:][:encoder.vocabulary.sizes[ids[0]]] == encoder.vocabulary.tokens[ids[0]]
    for step in (1, 3, 1 << 17):
        monkeypatch.setattr(bpe, "TOGETHER", step)
        assert encoder.decode(ids) == text.encode() and encoder.decode(ids[:0]) == b""
