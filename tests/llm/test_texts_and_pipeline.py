import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from roadwell.llm import htmltext, langid, sanitise
from roadwell.llm.dom import read
from roadwell.llm.queries import op6_language, op10_main_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, start int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    out = []
    for k, (kind, (pattern, valid)) in enumerate(BASE.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


CASES = [
    "write to a.b@c.example_d@e.org or x@y", "a@b.c_d@e.f%g@h.i.j", "é👍 me@x.de, 1.2.3.4.5.6.7.8 999.1.1.1 0255.001.2.3",
    "4111 1111 1111 1111 and 4111111111111112", "4111-1111-1111-1111-", "+1 (743) 555-3824 +44 20.7946 0958 +1 2 +49(0)1", None, "", "1.2.3", "@", "+",
    "9" * 3000, "a" * 3000 + "@", "a.b" * 1000 + "@" + "c.d" * 2000, "1." * 3000, "4465758382889437 4465758382889437", "+4465758382889437", "x+1 23@a.b.c",
]


def test_base_spans_against_re(spark):
    rnd = random.Random(1)
    texts = CASES + ["".join(rnd.choice("a1.@+- 2_(é%") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rnd.choice(["4111111111111111", " ", "1.2.3.4", "+1 555 000 1111", "a@b.c", "-", "5", "."]) for _ in range(6)) for _ in range(200)]
    got = {r.doc_id: r for r in sanitise.digest(sanitise.find_spans(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == want
        assert got[i].n_email == sum(s.startswith("email") for s in want)
    assert sanitise.digest(sanitise.find_spans(docs(spark, []))).count() == 0


def test_terms_that_give_an_entity_away(spark):
    rnd = random.Random(2)
    filler = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "in"]) for _ in range(n))
    texts = [f"{filler(20)} the Zorblatt account ann@x.org {filler(20)} {i}x" for i in range(5)]
    texts += [f"{filler(30)} common words {i}" for i in range(40)] + [f"{filler(30)} bob@y.org {filler(9)} seldom once"]
    rows = {r.doc_id: r for r in sanitise.find_spans(docs(spark, texts)).collect()}
    for i in range(5):
        said = {texts[i][s.start : s.stop] for s in rows[i]["all"] if s.kind == 4}
        assert said == {"Zorblatt", "account"}
    assert all(not [s for s in rows[i]["all"] if s.kind == 4] for i in range(5, len(texts)))
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs(spark, texts)).collect()}
    assert "the [TERM] [TERM] [EMAIL] " in clean[0] and "Zorblatt" not in clean[0]
    assert all(clean[i] == texts[i] for i in range(5, 45))


def test_terms_far_from_their_entity(spark):
    """A term counts over whole documents and goes wherever it stands, also where its entity does not."""
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "in"]) for _ in range(n))
    texts = [f"(Quimbel) {filler(60)} {i}x {filler(60)} quimbel, {filler(60)} ann@x.org" for i in range(5)]
    texts += [f"{filler(30)} QUIMBEL {filler(5)}"] + [f"{filler(30)} common {i}" for i in range(40)]
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs(spark, texts)).collect()}
    for i in range(5):
        assert clean[i] == texts[i].replace("Quimbel", "[TERM]").replace("quimbel", "[TERM]").replace("ann@x.org", "[EMAIL]")
    assert clean[5] == texts[5].replace("QUIMBEL", "[TERM]")
    assert all(clean[i] == texts[i] for i in range(6, len(texts)))


def brute_told(texts):
    """Terms that disclose an entity, by the formulas one pair at a time."""
    held = [set(brute(t)) for t in texts]
    terms = []
    for t in texts:
        words = [re.fullmatch(r"[^\w]*([^\W\d_](?:[^\W\d_]|['-]){2,})[^\w]*", w) for w in re.split(r"[\x20\x09-\x0D]", t)]
        terms.append({m[1].lower() for m in words if m})
    entities = {}
    for i, t in enumerate(texts):
        for s in held[i]:
            kind, a, b = s.split(":")
            for e in ((kind, t[int(a) : int(b)].lower()), kind, "any"):
                entities.setdefault(e, set()).add(i)
    total, told = len(texts), set()
    entities = {e: rows for e, rows in entities.items() if len(rows) >= 2}
    every = set().union(*terms)
    for e, rows in entities.items():
        q = len(rows) / total
        for term in every:
            n = sum(term in x for x in terms)
            both = sum(term in terms[i] for i in rows)
            if both < 2 or q == 1:
                continue
            p = both / n
            bits = n * (p * math.log2(p / q) + ((1 - p) * math.log2((1 - p) / (1 - q)) if p < 1 else 0))
            if math.log2(p / q) >= -sanitise.DISCLOSURE * math.log2(q) and 2 * both >= n and bits >= math.log2(len(entities) * len(every) / sanitise.CHANCE):
                told.add(term)
    return told


def test_told_terms_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 4)))
    texts = []
    for k in range(120):
        words = [word() for _ in range(25)]
        if k % 6 == 0:
            words += [f"user{k % 4}@mail{k % 3}.org", "(Contact)" if k % 12 == 0 else "contact,"]
        if k % 24 == 0:
            words += ["account-holder", "contact"]
        if k % 40 == 1:
            words += ["contact"]
        rnd.shuffle(words)
        texts.append(" ".join(words))
    told = brute_told(texts)
    assert "contact" in told
    found = {texts[r.doc_id][s.start : s.stop].lower() for r in sanitise.find_spans(docs(spark, texts)).collect() for s in r["all"] if s.kind == 4}
    assert found == told
    # the same where terms are joined instead of listed
    import unittest.mock

    with unittest.mock.patch.object(sanitise, "LISTED", 0):
        joined = {texts[r.doc_id][s.start : s.stop].lower() for r in sanitise.find_spans(docs(spark, texts)).collect() for s in r["all"] if s.kind == 4}
    assert joined == told


def test_terms_are_found_on_the_given_documents(spark):
    rows = sanitise.find_spans(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("exists(all, s -> s.kind = 4)")
    assert rows.count() > 50


def test_thousands_of_matches(spark):
    text = "é a@b.co, " * 10_000
    (row,) = sanitise.find_spans(docs(spark, [text])).collect()
    assert len(row.base) == 10_000 and [row.base[k].start for k in (0, 1, 9_999)] == [2, 12, 99_992]
    (clean,) = sanitise.sanitise(docs(spark, [text])).collect()
    assert clean.text == "é [EMAIL], " * 10_000


@pytest.mark.parametrize("name", ["all", "_key", "_first", "_plans", "_row", "_text", "media", "spans", "pattern", "_cut", "_at", "key"])
def test_stages_keep_columns_of_any_name(spark, name):
    text = "These are some words about a thing that anybody could have written down, with one or two more of them at the end."
    rows = [(1, text, "en", "s", None, 5), (2, text + " Write to a@b.co or call.", "en", "s", 3, 6), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, `{name}` int")
    for label, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, "")
        assert got.columns == frame.columns, label
        held = {r.doc_id: r[name] for r in got.collect()}
        assert held.get(1, 5) == 5 and held.get(2, 6) == 6, label


def test_sanitise_keeps_the_rest(spark):
    texts = ["é a@b.co 1.2.3.4 end", None, "", "+1 555 000 1111", "4111111111111111"]
    frame = docs(spark, texts)
    got = sanitise.sanitise(frame)
    assert got.columns == frame.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["é [EMAIL] [IP] end", None, "", "[PHONE]", "[CARD]"]
    assert sanitise.sanitise(docs(spark, [])).count() == 0


def test_languages(spark):
    found = op6_language(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_scores_against_plain_averages(spark):
    """The table of a gram's scores averaged over a text is what grams, embeddings and softmax say one by one."""
    model = langid.Model(["the cat and the dog of the house"] * 20 + ["le chat et la souris de la maison"] * 20, ["en"] * 20 + ["fr"] * 20)
    for text in ("the dog", "Une souris!", "été à la plage, 12 chats", "x"):
        raw = (" " + " ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()) and [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())]) + " ").encode()
        sums, count = np.zeros(2), 0
        for width, prime in ((2, 2654435761), (3, 2246822519), (4, 3266489917)):
            for i in range(len(raw) - width + 1):
                value = int.from_bytes(raw[i : i + width], "big")
                place = (value * prime % (1 << 32) >> 32 - langid.BITS) + ((width - 2) << langid.BITS)
                sums += model.table[place]
                count += 1
        odds = (sums / count + model.bias) / model.temperature
        chance = np.exp(odds - odds.max()) / np.exp(odds - odds.max()).sum()
        assert model.predict(text) == (model.languages[int(chance.argmax())], pytest.approx(float(chance.max()), abs=1e-6))


def test_language_sample_holds_rare_languages(spark):
    rows = [(1, "the cat sat", "en", "s", None, "x", 1)] * 300 + [(None, f"la souris {k}", "fr", "s", None, "x", 1) for k in range(5)] + [(3, None, "de", "s", None, "x", 1)]
    found = langid.sample_of(spark.createDataFrame(rows, SCHEMA), 20).groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in found}
    # equal rows have one hash, and so fall in or out together
    assert counts["fr"] == 5 and counts.get("en", 0) in (0, 20) and set(counts) <= {"en", "fr"}


def test_no_letter_is_no_language(spark):
    model = langid.Model(["the cat"] * 5 + ["le chat"] * 5, ["en"] * 5 + ["fr"] * 5)
    rows = langid.identify(docs(spark, ["²½", "Ⅷ", "_", "ª", "5 %"]), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, True]


def test_language_edges(spark):
    model = langid.Model(["the cat and the dog"] * 10 + ["le chat et la souris"] * 10, ["en"] * 10 + ["fr"] * 10)
    texts = [None, "", "123 !?", "the dog", "LA SOURIS", "é", "x" * 100_000, "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "ignore")]
    rows = langid.identify(docs(spark, texts), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:5]] == ["und", "und", "und", "en", "fr"]
    nothing = langid.train(docs(spark, []))
    assert [r.lang_pred for r in langid.identify(docs(spark, ["the"]), nothing, ["doc_id"]).collect()] == ["und"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies, accept them.</div>
<header class="site-header"><p>The Site</p></header>
<article><h1>A title &amp; more</h1><p><b>First  paragraph,&nbsp;bold
 text that goes on for a while.<br><p>Second one, unclosed and long enough to read as prose.<ul><li>An item of the list<li>Another item</ul>
<div class="ad">Buy now</div><blockquote>Some quoted words, said by someone.</blockquote><p>Closing words of the article &lt;end&gt;.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I like it a lot, thanks for writing all this.</p></div></section>
<aside class="sidebar"><h3>Popular</h3><p>Other things to read on this site.</p></aside><form><label>Search</label><input><button>Go</button></form>
<footer>&copy; The Site</footer></body></html>"""


def test_main_text_of_a_page():
    (text,) = htmltext.main_texts([PAGE], htmltext.trained())
    assert text.split("\n\n") == [
        "A title & more", "First paragraph, bold text that goes on for a while.", "Second one, unclosed and long enough to read as prose.",
        "An item of the list", "Another item", "Some quoted words, said by someone.", "Closing words of the article <end>.",
    ]


def test_main_text_of_generated_pages():
    made = htmltext.Generator(4711)
    right = 0
    for _ in range(150):
        html, truth = made.page()
        right += htmltext.main_texts([html], htmltext.trained())[0].split("\n\n") == [" ".join(t.split()) for t in truth]
    assert right >= 140


def test_main_text_without_telling_names():
    """Pages whose class names and ids say nothing: tags and structure alone."""
    made = htmltext.Generator(4712, nameless=1.0)
    right = 0
    for _ in range(150):
        html, truth = made.page()
        right += htmltext.main_texts([html], htmltext.trained())[0].split("\n\n") == [" ".join(t.split()) for t in truth]
    assert right >= 110


def test_decoding_against_all_labelings():
    """No labeling without a kept node below one that is not kept has a greater sum."""
    rnd = random.Random(12)
    for _ in range(200):
        n = rnd.randint(2, 9)
        parents = [0] + [rnd.randrange(k) for k in range(1, n)]
        nodes = [htmltext.Node("div", parents[k] if k else -1, 0, (), k) for k in range(n)]
        odds = [rnd.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 3.0]) for _ in range(n)]
        kept = htmltext.decode(nodes, np.array(odds))
        assert kept[0] and all(kept[parents[k]] or not kept[k] for k in range(1, n))
        best = max(
            sum(odds[k] for k in range(1, n) if flags >> k & 1)
            for flags in range(1, 1 << n, 2)
            if all(flags >> parents[k] & 1 or not flags >> k & 1 for k in range(1, n))
        )
        assert abs(sum(odds[k] for k in range(1, n) if kept[k]) - best) < 1e-9


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = htmltext.Trees(x[:1500], y[:1500])
    assert ((trees.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_hundreds_of_siblings_are_counted():
    page = "<article><h1>T</h1>" + "".join(f"<p>Some words of paragraph {k}, as long as the others are.</p>" for k in range(900)) + '<div class="ad">Buy now</div></article>'
    (text,) = htmltext.main_texts([page], htmltext.trained())
    # the heading of one letter is lost on so long a page; see the README
    assert text.split("\n\n")[-900:] == [f"Some words of paragraph {k}, as long as the others are." for k in range(900)] and "Buy" not in text


def test_main_text_query(spark):
    from html import unescape

    rows = op10_main_text(spark, "/root/testdata/sf0.001").collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in rows:
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_of_any_kind(spark):
    pages = [None, "", "plain words", "<", "<p", "<div><p>a</div></p></span>", "<script>x", "<!-- open", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", '<a href="unclosed>x</a><p>y</p>', "&#0;&bogus;&amp"]
    frame = spark.createDataFrame([(i, None, p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    rows = htmltext.extract(frame, ["page_id", "url"]).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    nodes, blocks = read("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<ul><li>e</ul><li>f</ul>")
    assert [t for _, t in blocks] == list("abcdef")


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    held = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        held.append(corpus_pipeline.materialise(stage(spark, held[-1], sf), f"test-{name}"))
    return held


def test_pipeline_stages(spark, stages):
    first = stages[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    for frame in stages[1:-1]:
        assert frame.columns == first.columns
    quality, unique, clean, mixed, packed = stages[1:]
    assert 0 < quality.count() < first.count()
    texts = {r.doc_id: r.text for r in first.collect()}
    assert all(texts[r.doc_id] == r.text for r in unique.collect())
    assert unique.count() == unique.select("doc_id").distinct().count() <= quality.count()
    assert clean.count() == unique.count()
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r.text) for r in clean.collect())
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_pipeline_takes_an_empty_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "/root/testdata/sf0.001")
        assert frame.count() == 0
        if frame.columns != ["doc_id", "text", "lang", "source", "n_chars"]:
            break
