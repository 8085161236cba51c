"""Language ID, I-Match, page extraction and quality rules."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import htmltext, imatch, langid, quality
from tidemark.llm.common import table
from tidemark.llm.queries import op1_language_id, op2_fingerprints, op10_quality_rules

# ---- language -----------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf):
    where = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in table(spark, where, "documents").collect()}
    found = op1_language_id(spark, where).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_filters_return_all_languages():
    rnd = np.random.default_rng(3)
    sets = {name: np.unique(rnd.integers(0, 2**32, 3000, dtype=np.uint32)) for name in ("aa", "bb", "cc")}
    filters = langid.LanguageFilters.build(sets)
    for bit, name in enumerate(filters.languages):
        assert (filters.masks(sets[name]) >> bit & 1).all()
    others = rnd.integers(0, 2**32, 200_000, dtype=np.uint32)
    rate = [(filters.masks(others) >> bit & 1).mean() for bit in range(3)]
    assert np.allclose(rate, filters.false_rate, atol=1e-3)


def test_language_awkward(spark):
    filters = langid.fit(awkward(spark))
    found = langid.predict(awkward(spark), filters).collect()
    assert len(found) == len(awkward_rows())
    assert all(r.lang_pred in ("en", "fr") for r in found if re.search(r"[^\W\d_]", r.text or ""))
    assert {r.lang_pred for r in found if not re.search(r"[^\W\d_]", r.text or "")} == {"und"}
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0
    assert {r.lang_pred for r in langid.predict(awkward(spark), langid.fit(empty(spark))).collect()} == {"und"}


# ---- I-Match --------------------------------------------------------------------------------------------------------


def check_fingerprints(found, rows):
    """rows in the order of the contract."""
    texts = [t or "" for _, t in rows]
    want = []
    for i, text in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((rows[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


@pytest.mark.parametrize("bucket", [7, 2000])
def test_fingerprints(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", bucket)
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    found = op2_fingerprints(spark, sf).collect()
    check_fingerprints(found, docs)
    print_of = {r.doc_id: r.fingerprint for r in found}
    by_text = {}
    for key, text in docs:
        assert by_text.setdefault(text, print_of[key]) == print_of[key]
    assert sum(r.near_edited for r in found) > 5 * sum(r.near_next for r in found)


def test_fingerprint_against_plain_python(spark, sf):
    docs = table(spark, sf, "documents")
    lexicon = {r.term: (r.h, r.mask) for r in imatch.lexicon(docs).collect()}
    split = lambda t: {w for w in re.split(r"[^\w]+|_+", t.lower()) if w}
    seen: dict[str, int] = {}
    for r in docs.collect():
        for w in split(r.text):
            seen[w] = seen.get(w, 0) + 1
    n = docs.count()
    assert set(lexicon) == {w for w, k in seen.items() if 2 <= k <= 0.25 * n}
    groups: dict[tuple, set] = {}
    for r, f in zip(sorted(docs.collect()), sorted(op2_fingerprints(spark, sf).collect()), strict=True):
        terms = tuple(sorted(split(r.text) & set(lexicon)))
        if terms:
            groups.setdefault(terms, set()).add(f.fingerprint)
    assert all(len(g) == 1 for g in groups.values())


def brute_signature(words, lexicon):
    """Hash of the terms of each subset, in the order of their signed hashes."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    terms = sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)): w for w in words & lexicon}.items())
    parts = []
    for r, rate in enumerate(imatch.RATES):
        first = xxhash.xxh64_intdigest(r.to_bytes(4, "little"), 42)
        chosen = [h for h, w in terms if xxhash.xxh64_intdigest(w.encode(), first) % (1 << rate) == 0]
        seed = 42
        for h in chosen:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed)
        parts.append(seed if chosen else None)
    return parts


def test_fingerprints_against_brute_force(spark, sf):
    """Fingerprints of both texts, and both likenesses, of every document."""
    rows = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    split = lambda t: {w for w in re.split(r"[^\w]+|_+", t.lower()) if w}
    counts = Counter(w for _, t in rows for w in split(t))
    lexicon = {w for w, n in counts.items() if max(2, 0.001 * len(rows)) <= n <= max(2, 0.25 * len(rows))}

    def printed(text):
        parts = brute_signature(split(text), lexicon)
        whole = "w" + hashlib.sha256(text.encode()).hexdigest()[:16]
        return parts, ".".join("-" if x is None else f"{x >> 32:08x}" for x in parts) if any(x is not None for x in parts) else whole

    def alike(a, b):
        used = [(x, y) for x, y in zip(a[0], b[0], strict=True) if x is not None or y is not None]
        return 1.0 if a[1] == b[1] else sum(x == y for x, y in used) / len(used) if used else 0.0

    own = [printed(t) for _, t in rows]
    want = {}
    for i, (key, text) in enumerate(rows):
        after, half = (i + 1) % len(rows), len(text) // 2
        changed = printed(text[: len(text) - half] + rows[after][1][:half])
        want[key] = (own[i][1], changed[1], alike(own[i], changed), alike(own[i], own[after]))
    found = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in op2_fingerprints(spark, sf).collect()}
    assert found == want and any(0 < w[2] < 1 for w in want.values())


def test_fingerprints_awkward(spark):
    rows = [r for r in awkward_rows() if r[0] not in (0, 3)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    order = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    check_fingerprints(imatch.fingerprint_documents(docs).collect(), order)
    assert imatch.fingerprint_documents(awkward(spark)).count() == len(awkward_rows())
    assert imatch.fingerprint_documents(empty(spark)).count() == 0
    one = imatch.fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_lexicon_join_without_broadcast(spark, sf, monkeypatch):
    want = sorted(map(tuple, op2_fingerprints(spark, sf).collect()))
    monkeypatch.setattr(imatch, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, op2_fingerprints(spark, sf).collect())) == want


# ---- pages ----------------------------------------------------------------------------------------------------------

BODY = "<p>First paragraph, with several words; and some   punctuation.</p><p>Second one &amp; more text, <a href=x>a link</a> inside.</p>"
WANT = "Title here\n\nFirst paragraph, with several words; and some punctuation.\n\nSecond one & more text, a link inside."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=a>menu</a></li></ul></nav><!-- ad --><div class='ad'>Buy this now, please.</div><article><h1>Title here</h1>{BODY}</article><footer>&copy; someone</footer></body></html>",
        f"<body><header>Site name</header><main><h1>Title here</h1>{BODY}<section id='comments'><p>A reader comment that is rather long, and has, some, commas.</p></section></main><aside><p>Related things to read, perhaps.</p></aside>",
        f"<div id=menu><a href=1>one</a> <a href=2>two</a></div><article><h1>Title here</h1>{BODY}<form><input name=q><button>go</button></form><div class='cookie-notice'>We use cookies.</div></article>",
    ],
)
def test_extraction(page):
    assert htmltext.extract(page) == WANT


def test_extraction_tolerates_broken_markup():
    assert htmltext.extract("<article><h1>T</h1><p><b>One two three.<br><p>Four five.</p></article>") == "T\n\nOne two three.\n\nFour five."
    assert htmltext.extract("just text") == "just text"
    assert htmltext.extract("<p>open <b>never closed") == "open never closed"
    assert htmltext.extract("<!-- only -->") == htmltext.extract("") == ""


LONG = "".join(f"<p>Paragraph {i} goes on for a while, with commas, and ends; as prose does, after some more words.</p>" for i in range(6))
PLAIN = "\n\n".join(f"Paragraph {i} goes on for a while, with commas, and ends; as prose does, after some more words." for i in range(6))
TABLE = "<table><thead><tr><th>Year</th></tr></thead><tbody><tr><td>1999</td></tr></tbody></table><ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul>"


@pytest.mark.parametrize(
    "page,want",
    [
        # no article element, names that mean nothing
        (f"<body><div class=q1><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div class=q2><h1>Head</h1>{LONG}{TABLE}</div><div class=q3><a href=3>Terms</a> <a href=4>Contact</a></div></body>", f"Head\n\n{PLAIN}\n\nYear\n\n1999\n\nSource one\n\nSource two"),
        # a misleading name on the content, and teasers in article elements
        (f"<body><div id=sidebar-content><h1>Head</h1>{LONG}</div><article><p>Teaser one.</p></article><article><p>Teaser two.</p></article></body>", f"Head\n\n{PLAIN}"),
        # slugs as ids, inside the content
        (f"<body><nav><a href=1>x</a></nav><article><h1>Head</h1><h2 id='social-impact'>Social impact</h2>{LONG}<p id='share-prices'>Share prices.</p><section id='related-work'><p>Other work.</p></section><div class='comment-list'><p>I like this, a lot, really.</p></div></article></body>", f"Head\n\nSocial impact\n\n{PLAIN}\n\nShare prices.\n\nOther work."),
        # the text lies in body itself
        (f"<body><header><h1>Site</h1></header><div class=m><a href=1>one</a><a href=2>two</a></div><h1>Head</h1>{LONG}<footer>About us.</footer></body>", f"Head\n\n{PLAIN}"),
        # all children of a wrapper
        (f"<html><body><div id=wrapper><div id=x><a href=1>a</a></div><div id=y>{LONG}</div></div></body></html>", PLAIN),
    ],
)
def test_content_by_ratios(page, want, monkeypatch):
    assert htmltext.extract(page) == want


@pytest.mark.parametrize("box", ["<div class='comments'>{}</div>", "<section id=comments>{}</section>", "<aside class=comments>{}</aside>", "<div class='reader-comments thread'><ol>{}</ol></div>"])
@pytest.mark.parametrize("story", ["<div class=q>{}</div>", "<article>{}</article>", "<main><div>{}</div></main>"])
def test_long_comments_are_never_the_article(box, story):
    short = "<h1>Head</h1><p>A short story, told in one line.</p>"
    many = "".join(f"<p>Comment {i} is long, and goes on, with many commas, and thoughts; it is longer than the story is, by far.</p>" for i in range(60))
    assert htmltext.extract(f"<body>{story.format(short)}{box.format(many)}</body>") == "Head\n\nA short story, told in one line."
    assert htmltext.extract(f"<body>{box.format(many)}{story.format(short)}</body>") == "Head\n\nA short story, told in one line."


def test_a_page_that_is_one_form():
    assert htmltext.extract(f"<body><form action=x><div>{LONG}</div></form></body>") == PLAIN


def test_ratios_decide(monkeypatch):
    page = f"<body><div class=q1><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p><p>Five.</p><p>Six.</p><p>Seven.</p><p>Eight.</p><p>Nine.</p><p>Ten.</p></div><div class=q2>{LONG}</div></body>"
    assert htmltext.extract(page) == PLAIN
    monkeypatch.setattr(htmltext, "path_ratios", lambda tree: dict.fromkeys(tree.path, 1.0))
    assert htmltext.extract(page) != PLAIN


def test_path_ratios_by_hand():
    tree = htmltext.read_page("<div class=a><p>abcd.</p><p>ab, c.</p></div><div class=b><p><a href=x>abc</a>d</p></div><nav>zz</nav>")
    text, marks, link = [5.5, 4.0, 2.0], [1.5, 0.0, 0.0], [0.0, 0.75, 0.0]
    smooth = lambda r: [0.75 * r[0] + 0.25 * r[1], 0.25 * r[0] + 0.5 * r[1] + 0.25 * r[2], 0.25 * r[1] + 0.75 * r[2]]
    want = [t * (1 + m) * (1 - k) * p for t, m, k, p in zip(smooth(text), smooth(marks), link, (1, 1, htmltext.TAG_PRIOR), strict=True)]
    assert list(htmltext.path_ratios(tree).values()) == pytest.approx(want)


def test_names():
    assert all(map(htmltext.names_aside, ["ad", "ad-slot-3", "cookieNotice", "reader_comments", "related-posts", "site-footer"]))
    assert not any(map(htmltext.names_aside, ["social-impact", "share-prices", "header2text-tool", "content", "additional", ""]))


@pytest.mark.parametrize("page", ["<b " * 200_000 + '"', "<p '" * 100_001, "<div>" * 50_000 + "</p>" * 50_000, "<div>x" * 50_000, "<!" * 100_000, "</script" * 50_000, "<script>" + "</script" * 50_000, "<" * 200_000])
def test_linear_time(page):
    import time

    start = time.process_time()
    htmltext.extract(page)
    assert time.process_time() - start < 10


def test_pages_empty_table_and_clashing_names(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    assert htmltext.extract_pages(spark.createDataFrame([], schema)).count() == 0
    found = htmltext.extract_pages(spark.createDataFrame([(1, "u", "<p>x</p>", "other", 9)] * 2, schema)).collect()
    assert [(r.text, r.n_chars) for r in found] == [("x", 1)] * 2


def test_pages_query(spark, sf):
    pages = table(spark, sf, "pages")
    found = {r.page_id: r for r in htmltext.extract_pages(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        plain = " ".join(__import__("html").unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert " ".join(found[r.page_id].text.split()) == plain
        assert found[r.page_id].n_chars == len(found[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, 3), (1, "u", "", 3), (None, "u", "<p>x</p>", 3)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in htmltext.extract_pages(odd).collect()) == ["", "", "x"]


# ---- quality --------------------------------------------------------------------------------------------------------


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures(spark, sf):
    for _, text, *_ in awkward_rows():
        assert quality.measure(text or "")[:5] == brute_measure(text)
    for r in table(spark, sf, "documents").limit(60).collect():
        if len(r.text) < 20_000:
            assert quality.measure(r.text)[:5] == brute_measure(r.text)


def test_quality_query(spark, sf):
    where = sf.replace("0.001", "0.01")
    found = {r.doc_id: r for r in op10_quality_rules(spark, where).collect()}
    for r in found.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = [r for r in table(spark, where, "labels").collect() if not found[r.doc_id].base_failed]
    assert all(found[r.doc_id].kept == (r.quality == 1) for r in labels)
    judged = quality.judged(quality.measured(awkward(spark)))
    assert judged.count() == len(awkward_rows())
    assert quality.judged(quality.measured(empty(spark))).count() == 0


def test_votes_recover_planted_classes():
    rnd = np.random.default_rng(0)
    good = rnd.random(4000) < 0.85
    votes = np.ones((4000, 5), int)
    for j in range(5):
        votes[~good & (rnd.random(4000) < 0.6), j] = -1
        votes[good & (rnd.random(4000) < 0.003), j] = -1
        votes[rnd.random(4000) < 0.1, j] = 0
    from collections import Counter

    share, _, posterior = quality.fit_votes(list(Counter(map(tuple, votes.tolist())).items()))
    guess = np.array([posterior[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (guess == good).mean() > 0.98 and abs(share - 0.85) < 0.05


def test_verdict_against_plain_em(spark, sf):
    """Posterior and verdict of every document by expectation-maximisation over documents, not over vote patterns."""
    measures = quality.measured(table(spark, sf, "documents")).cache()
    votes = {r.doc_id: [r[f"v_{n}"] for n in quality.RULES] for r in measures.select("doc_id", *[v.alias(f"v_{n}") for n, v in quality._rules().items()]).collect()}
    judged = {r.doc_id: r for r in quality.judged(measures).collect()}
    model = [v for k, v in votes.items() if not judged[k].base_failed]
    weight = quality.PRIOR_WEIGHT * max(len(model), 1)
    share, rates = quality.PRIOR_GOOD, [[list(quality.PRIOR_RATES[k]) for k in (0, 1)] for _ in quality.RULES]

    def good(vote):
        a, b = share, 1 - share
        for rule, v in enumerate(vote):
            a, b = a * rates[rule][1][v + 1], b * rates[rule][0][v + 1]
        return a / (a + b)

    for turn in range(quality.ROUNDS + 1):
        posterior = {k: good(v) for k, v in votes.items()}
        p = [good(v) for v in model]
        share = (weight * quality.PRIOR_GOOD + sum(p)) / (weight + len(model))
        for rule in range(len(quality.RULES)):
            for k in (0, 1):
                seen = [weight * q for q in quality.PRIOR_RATES[k]]
                for v, x in zip(model, p, strict=True):
                    seen[v[rule] + 1] += x if k else 1 - x
                rates[rule][k] = [x / sum(seen) for x in seen]
            rates[rule][1][0] = min(rates[rule][1][0], quality.MOST_FALSE)
    assert {k: r.quality_probability for k, r in judged.items()} == pytest.approx(posterior, abs=1e-6)
    assert {k: r.kept for k, r in judged.items()} == {k: bool(posterior[k] >= 0.5 and not r.base_failed) for k, r in judged.items()}
    assert {r.kept for r in judged.values()} == {True, False}
