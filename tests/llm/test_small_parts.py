"""Parts that need no cluster: codes, lattices, balancing, page text, models."""

import hashlib
import html
import itertools
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folkmoot.llm import ann_forest, html_main_text, lang_id, mixing, ngram_join, piece_sampling, quality_rank, token_store


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_dac_gives_every_token(ids, data):
    reader = token_store.DacReader(token_store.dac_encode(np.array(ids, np.uint32)))
    assert len(reader) == len(ids) and reader.slice(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert reader[i] == ids[i] and reader.slice(i, j).tolist() == ids[i:j]
    with pytest.raises(IndexError):
        reader[len(ids)]


TEXTS = ["", "Hello, World! don't 3.14", "É  ́b ǅ İ \x1c\x85a <|endoftext|> x<|ENDOFTEXT|>y", "ΑΣ ΑΣ. ß", "a" * 5000, "\t\n", "日本語 テキスト 🙂", "Élève Übergrößen ñandú, ÑANDÚ. ŒUVRE ß ﬁ ǆ ǅ ſ ª º İi ŉ ȿ ɐ Größe.", "cafe\u0301 CAFE\u0301. l'été d'un", "(x) [y]; z&&& \"q\" a=\u0338 <b> x<", "\u00a0a\u2003b K"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_encode_as_whole_texts_do(name, monkeypatch):
    e = token_store.WordEncoder(public_tokenizers.path(name))
    assert e.wordwise == name.startswith("word")  # the other one gets whole texts
    monkeypatch.setattr(token_store, "CACHED_WORDS", 20)
    rng = np.random.default_rng(0)
    texts = TEXTS + ["".join(rng.choice(list("abÉß.,!'<|> 01\t\u0301\u00a0日&"), rng.integers(1, 12))) for _ in range(3000)]
    whole = [w.ids for w in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = []
    for k in range(0, len(texts), 100):
        ids, counts = e.encode(pa.array(texts[k : k + 100], pa.large_string()))
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == whole


def test_long_texts_are_cut_at_white_space():
    texts = ["a bc", "", "x yz " * 40, "w" * 300, "é " * 100, "end"]
    cut = list(token_store.slices(pa.array(texts, pa.large_string()), 50))
    docs, now = [], ""
    for some, n, goes_on in cut:
        assert n == len(some) - goes_on
        for k, t in enumerate(some.to_pylist()):
            now += t
            if k < n:
                docs.append(now)
                now = ""
    assert docs == texts and any(goes_on for *_, goes_on in cut)


@pytest.fixture(scope="module")
def sampler():
    return piece_sampling.PieceSampler(public_tokenizers.path("piece_bpe_32k.model"))


ODD = ["", " ", "  a  b ", "a▁b ▁ c", "\n\nx\n y", "日本語テキスト🙂\x00", "x" * 3000, "ñ" * 2000, "\t\ta", " \n ▁\n", "\0▁ \0"]


def test_pieces_are_lossless(sampler):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = sampler.encode(list(range(len(ODD))), ODD)
    assert [sampler.decode(x) for x in ids] == ODD
    assert [sp.decode(x.tolist()) for x in ids] == ODD


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.integers(0, 9))
def test_pieces_of_any_text(sampler, text, key):
    text = text.encode("utf-8", "ignore").decode()
    ids = sampler.encode([key], [text])[0]
    assert sampler.decode(ids) == text
    assert (sampler.encode([key, key], ["other words", text])[1] == ids).all()  # no matter what else is in the batch


def test_long_parts_are_cut_as_short_ones_are(sampler, monkeypatch):
    """Windows and runs of parts change nothing."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeén日🙂"), 5000)), "x" * 3000, " ".join(["then and", "ñ" * 700, "ab\n\ncd"] * 40), "\u2581 " * 300, "ab" * 100_000]
    whole = sampler.encode([1, 2, 3, 4, 5], texts[:4] + ["ab"])
    for window, batch in ((64, 1 << 20), (1 << 16, 200), (50, 100)):
        monkeypatch.setattr(piece_sampling, "WINDOW", window)
        monkeypatch.setattr(piece_sampling, "BATCH_CHARS", batch)
        got = sampler.encode([1, 2, 3, 4, 5], texts[:4] + ["ab"])
        assert all((a == b).all() for a, b in zip(got, whole))
    monkeypatch.undo()
    assert sampler.decode(sampler.encode([5], texts[4:])[0]) == texts[4]


def test_pieces_follow_their_weights(sampler):
    def paths(s):
        if not s:
            yield (), 1.0
        for i in range(1, len(s) + 1):
            if s[:i] in sampler.weights:
                piece, w = sampler.weights[s[:i]]
                for rest, v in paths(s[i:]):
                    yield (piece, *rest), w * v

    exact = dict(paths("▁then"))
    total, n = sum(exact.values()), 20_000
    seen = Counter(tuple(x.tolist()) for x in sampler.encode(list(range(n)), ["then"] * n))
    assert set(seen) <= set(exact)
    assert all(abs(seen[p] / n - w / total) < 0.015 for p, w in exact.items())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5000)), max_size=60))
def test_flight_keeps_both_sums(rows):
    p, size = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    out = mixing.flight(p, size, np.linspace(0, 0.99, len(rows)) if rows else p)
    assert ((out > mixing.LANDED) & (out < 1 - mixing.LANDED)).sum() <= 2 and ((out >= 0) & (out <= 1)).all()
    assert abs(out.sum() - p.sum()) < 1e-5 and abs(out @ size - p @ size) < 1e-5 * max(1, size.sum())
    assert set(mixing.land(out, size)) <= {0.0, 1.0}


def test_inclusion_probabilities_hold_on_average():
    rng = np.random.default_rng(0)
    p, size = rng.random(30), rng.integers(1, 100, 30).astype(float)
    mean = np.mean([mixing.land(mixing.flight(p, size, rng.random(30)), size) for _ in range(3000)], axis=0)
    assert abs(mean - p).max() < 0.12


def test_shingles():
    sets = ngram_join.shingle_sets(["a b c d e f", " A b\tc  d e F\n", "a b", "", None, "x", "b c d e f"])
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2 and len(sets[2]) == 1 and len(sets[3]) == len(sets[4]) == 0
    assert np.isin(sets[6], sets[0]).all() and not np.isin(sets[5], sets[2]).any()


def test_blocks_count_each_pair_once():
    rng = np.random.default_rng(1)
    base = rng.choice(10_000, 200, replace=False).astype("<u4")
    rows = []
    for i in range(40):
        own = base.copy()
        own[: i % 12] = rng.choice(np.arange(10_000, 20_000), i % 12, replace=False)
        rows.append(np.unique(own))
    exact = np.array([[len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8 for b in rows] for a in rows])
    np.fill_diagonal(exact, False)
    uids, links, _ = ngram_join.compare(5, list(range(40)), np.ones(40, np.int64), [r.tobytes() for r in rows], [[5]] * 40, None, 0.8)
    assert dict(zip(uids, links)) == {i: int(n) for i, n in enumerate(exact.sum(1)) if n}
    uids, links, _ = ngram_join.compare(5, list(range(40)), np.ones(40, np.int64), [r.tobytes() for r in rows], [[3, 5]] * 40, None, 0.8)
    assert not sum(links)  # all pairs were counted in bucket 3
    uids, links, _ = ngram_join.compare(5, list(range(40)), np.ones(40, np.int64), [r.tobytes() for r in rows], [[5]] * 40, np.zeros(40), 0.8)
    assert not sum(links)  # two blocks of which one is empty: its pairs are counted elsewhere


PAGE = '<html><head><title>no</title></head><body><header>H</header><nav><a href="/">m</a></nav><div class="cookie-notice">c <b>x</b></div><article><h1>T &amp; t</h1><p><b>Bold<br><p>Two\n  words &lt;b&gt;</p><aside>no</aside><form>no</form><p>Last &am</article><div id="comments"><p>hi</p></div><script>var t="</p>";</script><footer>f'


def test_page_text():
    assert html_main_text.main_text(PAGE) == "T & t\nBold\nTwo words <b>\nLast &am"
    assert html_main_text.main_text(None) == html_main_text.main_text("") == html_main_text.main_text("<nav>x</nav>") == ""
    assert html_main_text.main_text("plain") == "plain"
    assert html_main_text.main_text("<p>" + "a " * 50_000) == ("a " * 50_000).strip()
    assert html_main_text.main_text("<ul class=menu><li>x</ul><p>Text &copy; &#233;&nbsp;b</p>") == "Text © é b"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cc"]), max_size=30), max_size=8))
def test_any_paragraphs_come_back(parts):
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{html.escape(p)}</p>" for p in parts) + "</article><footer>x</footer></body>"
    assert html_main_text.main_text(page) == "\n".join(" ".join(p.split()) for p in parts if p.split())


def test_runs():
    assert html_main_text.runs([0, 0, 5, 0, 7, 0, 0, 0, 0, 3]) == [(0, 5), (7, 10)]
    assert html_main_text.runs([]) == [] and html_main_text.runs([0, 0]) == []


def test_window_sums_decide():
    long = ["A long text goes on. " * 25, "And on it goes here. " * 30]
    body = "".join(f"<div>{t}</div>" for t in long)
    text = "\n".join(t.strip() for t in long)
    assert html_main_text.main_text("<div>Hom</div><div>Abo</div><div>New</div>" + body) == text  # no tell-tale tag or class
    links = "".join(f'<div><a href="/{i}">A title of another page {i}</a></div>' for i in range(9))
    assert html_main_text.main_text(links + body + links) == text
    assert html_main_text.main_text("<h1>T</h1><p>" + long[0] + "</p><p>End.</p><ul><li>eggs<li>milk</ul>") == f"T\n{long[0].strip()}\nEnd.\neggs\nmilk"
    assert html_main_text.main_text(f'<div class="page with-sidebar"><ul class="sidebar"><li>x y z</ul>{body}</div>') == text  # a word is overruled
    assert html_main_text.main_text('<p><a href="/x">all</a><p><a href="/y">links</a>') == "all\nlinks"
    assert html_main_text.runs([3, 3, 3, 500, 600, 5, 5, 5], 3, 120, 30) == [(1, 5)]


def test_attributes_are_whole_pairs():
    for kept in ('<a href="/hidden/valley">b</a>', '<a href="/q?id=search">b</a>', '<img alt="the hidden door">b', '<b class="share">b</b>', '<img hidden>b', "<a title='x id=menu' href=/class=nav>b</a>"):
        assert html_main_text.main_text(f"<article><p>a {kept} c</p></article>") == "a b c"
    for kept in ('<section id="social-policy"><p>b</p></section>', '<h2 id="related-work">b</h2>', '<div data-hidden="x" title="class=ad">b</div>', '<div data-class="ad">b</div>', '<p data-id=menu>b</p>'):
        assert html_main_text.main_text(f"<article><p>a</p>{kept}<p>c</p></article>") == "a\nb\nc"
    for gone in ("<div hidden>b</div>", "<div HIDDEN=''>b</div>", '<div a="x"class="ad">b</div>', "<p class=ad>b</p>", '<div style="display: none">b</div>', "<div aria-hidden=true>b</div>", "<div role=search>b</div>", '<div id="comments">b</div>'):
        assert html_main_text.main_text(f"<article><p>a</p>{gone}<p>c</p></article>") == "a\nc"


def test_names_of_paragraphs_and_headings():
    for kept in ('<p class="comment-on-policy">b</p>', '<h2 class="related">b</h2>', '<h2 id="search">b</h2>', '<p id="comments">b</p>', '<ul><li class="search-term">b</li></ul>'):
        assert html_main_text.main_text(f"<article><p>a</p>{kept}<p>c</p></article>") == "a\nb\nc", kept
        assert html_main_text.main_text(f"<div><p>a{' text' * 200}.</p>{kept.replace('>b', '>b.')}<p>c{' text' * 200}.</p></div>").split("\n")[1] == "b.", kept
    for gone in ("<p class='small ad'>b</p>", '<div class="related-posts">b</div>', '<ul><li class="share">b</li></ul>', '<div id="comment-list"><p>b.</p></div>'):
        assert html_main_text.main_text(f"<article><p>a</p>{gone}<p>c</p></article>") == "a\nc", gone


@pytest.mark.parametrize("page", ['<div class="ad">x', '<p class="ad">', "<nav>x", "<div>", "<svg>", "<script>", "<title>", "<a href=x>", "<a ", "<!--", "<article><p>x", "</div>", '<div class="ad"><p>x</div>', "<li class=menu>x", "&amp", "<b"])
def test_time_is_linear(page):
    began = time.process_time()
    html_main_text.main_text(page * 100_000)
    assert time.process_time() - began < 8  # a second or two; the square would take minutes


class Reader(HTMLParser):
    """The plain way to read the given pages: text of blocks inside the article, without adverts."""

    def __init__(self):
        super().__init__()
        self.lines, self.text, self.inside, self.hidden = [], "", 0, 0

    def end_line(self):
        if self.text.split():
            self.lines.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in ("b", "a", "i", "em"):
            self.end_line()
        self.inside += tag == "article"
        self.hidden += tag in ("script", "style") or (tag == "div" and (self.hidden > 0 or dict(attrs).get("class") == "ad"))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i", "em"):
            self.end_line()
        self.inside -= tag == "article"
        if self.hidden and tag in ("script", "style", "div"):
            self.hidden -= 1

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.text += data


def test_given_pages_as_a_plain_reader_has_them():
    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]
    for page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.end_line()
        assert html_main_text.main_text(page) == "\n".join(reader.lines)
    # The windows alone find nearly the same where no article element tells them.
    hit = total = 0
    for page in pages:
        want = html_main_text.main_text(page).split("\n")
        got = html_main_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")).split("\n")
        hit += sum((Counter(want) & Counter(got)).values())
        total += max(len(want), len(got))
    assert hit > 0.97 * total, (hit, total)


def test_windows_find_the_article_without_names(monkeypatch):
    """With article, structural tags and class names made anonymous, only the windows are left."""
    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]

    def measured():
        kept = whole = left = boilerplate = 0
        for page in pages:
            want = Counter(html_main_text.main_text(page).split("\n"))
            bare = re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|header|main|aside|section)\b", r"<\1div", page))
            got, every = Counter(html_main_text.main_text(bare).split("\n")), Counter(line.text for line in html_main_text.page_lines(bare) if line.text)
            size = lambda lines: sum(len(t) * n for t, n in lines.items())
            kept, whole, left, boilerplate = kept + size(want & got), whole + size(want), left + size(got - want), boilerplate + size(every - want)
        return kept / whole, left / boilerplate

    kept, left = measured()
    assert kept >= 0.95 and left <= 0.1, (kept, left)
    off = lambda lines, *a, **k: [i for i, line in enumerate(lines) if line.text]
    monkeypatch.setattr(html_main_text, "text_lines", off)
    assert measured()[1] > 0.9  # all of it stays without them


def test_stretches_beside_the_main_container():
    long = ("A long text goes on. " * 40).strip()
    notice, story = "Buy it now, it is the best.", ("Another part of the story. " * 12).strip()
    page = f"<body><div><p>{notice}</p></div><div><h1>Title</h1><p>{long}</p><div><p>{long}</p></div></div>%s</body>"
    assert html_main_text.main_text(page % f"<div><p>{notice}</p></div>") == f"Title\n{long}\n{long}"
    assert html_main_text.main_text(page % f"<div><p>{story}</p></div>") == f"Title\n{long}\n{long}\n{story}"


def test_unread_elements_hide_only_what_they_hold():
    for tag in ("svg", "math", "iframe", "object", "canvas", "template", "audio", "video", "script", "style", "noscript", "textarea", "title"):
        for empty in (f"<{tag}/>", f'<{tag} class="i" />', f"<{tag}>", f"<{tag}></{tag}>"):
            assert html_main_text.main_text(f"<p>one</p>{empty}<p>two</p>") == "one\ntwo", empty
    assert html_main_text.main_text("<p>one</p><svg class=i><p>two</p><svg><text>no</text><svg>no</svg>no</svg><p>three") == "one\ntwo\nthree"
    assert html_main_text.main_text("<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p><script>if (a<b) x") == "one\ntwo\nthree"
    assert html_main_text.main_text('<p>a <math><mi>x</mi> = <mn>1</mn></math> b</p><object data="f"><p>instead</p></object>') == "a x = 1 b\ninstead"
    assert html_main_text.main_text("<p>a</p><script>'<script><svg><!--'</script><p>b</p><video>no</video><!-- <svg> --><title-x>c</title-x>") == "a\nb\nc"


def test_articles_and_runs_are_compared():
    long = ("A long text goes on. " * 30).strip()
    cards = '<div><article><a href="/1">The title of another page</a></article><article><h3><a href="/2">One more</a></h3><p>Why.</p></article></div>'
    assert html_main_text.main_text(f"<article><h2>A</h2><p>{long}</p></article><article><h2>B</h2><p>Short post.</p></article>{cards}") == f"A\n{long}\nB\nShort post."
    assert html_main_text.main_text(f"<div><article><p>{long}</p></article></div><div><article><p>{long[:400]}</p></article></div>") == f"{long}\n{long[:400]}"
    assert html_main_text.main_text(f"<div><article><p>Read this</p></article></div><div><p>{long}</p><p>End.</p></div>") == f"{long}\nEnd."
    assert html_main_text.main_text(f"<article><p>{long}</p></article><div>{long[:300]}</div>") == long
    for gap in ('<div class="ad">Buy it now, it is the best.</div>', "<form><p>Your name</p></form>"):
        assert html_main_text.main_text(f"<div><p>{long * 3}</p>{gap}<p>Thanks to all</p></div>") == f"{long * 3}\nThanks to all"
        assert html_main_text.main_text(f"<div>{long * 3}</div>{gap}<div>Thanks to all.</div>") == f"{long * 3}\nThanks to all."


def test_languages():
    rng = np.random.default_rng(0)
    words = {"xx": ["the", "thing", "and", "that"], "yy": ["der", "einheit", "und", "ung"]}
    rows = [(" ".join(rng.choice(words[k], 12)), k) for k in words for _ in range(60)]
    model = lang_id.train([r[0] for r in rows], [r[1] for r in rows])
    labels, score, rejected = model.predict(["the and that thing", "und der einheit", None, "", "12 34", "日本語"])
    assert labels[:5] == ["xx", "yy", "und", "und", "und"] and list(rejected[:5]) == [False, False, True, True, True] and score[2] == 0
    assert lang_id.train([], []).predict(["a"])[0] == ["und"]
    assert lang_id.train(["abc"], ["xx"]).predict(["abc"])[0] == ["xx"]


def test_quality():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"], 40)) + "." for _ in range(100)]
    bad = [" ".join(rng.choice(["lorem###", "ipsum%%%", "dolor$$$"], 40)) for _ in range(40)]
    model = quality_rank.train(good + bad, [1] * 100 + [0] * 40)
    s = model.score([good[0], bad[0], "", None])
    assert s[0] > 0.3 > s[1] and ((s >= 0) & (s <= 1)).all() and s[2] == s[3]
    assert quality_rank.train([], []).score(["x"]).tolist() == [0.5] and quality_rank.train(["x"], [1]).score(["x"]).tolist() == [0.5]
    assert quality_rank.features(["a" * 200_000]).shape == (1, quality_rank.FEATURES)


def test_forest_search_reaches_every_leaf():
    x = np.random.default_rng(2).standard_normal((300, 8))
    forest = ann_forest.fit_forest(x, 3, 3)
    counts = np.array([np.bincount(t.leaves(x), minlength=8) for t in forest])
    order = ann_forest.search(forest, x[0], counts, 10**9)
    assert sorted(order) == list(itertools.product(range(3), range(8)))
    assert {order[k] for k in range(3)} >= {(order[0][0], int(forest[order[0][0]].leaves(x[:1])[0]))}
    same = np.ones((50, 8))
    assert len(set(ann_forest.fit_forest(same, 1, 3)[0].leaves(same).tolist())) == 1


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def plain_features(text):
    """The shares one by one, in plain Python."""
    body = text or ""
    data = body.encode("utf-8", "surrogatepass")
    words, lines = data.split(), data.split(b"\n")
    chars, n = max(1, len(b"".join(data.split()))), max(1, len(words))
    letters = sum(chr(c).isalpha() for c in data if c < 128)
    share = lambda test: sum(map(test, data))
    return {
        0: np.log1p(len(words)), 1: np.log1p(len(lines)), 2: chars / n, 3: share(lambda c: c in b"#$%&*+/<=>@[\\]^_`{}~") / chars, 4: data.count(b"!") / chars,
        5: share(lambda c: 65 <= c <= 90) / max(1, letters), 6: share(lambda c: 48 <= c <= 57) / chars, 9: sum(a == b for a, b in zip(words, words[1:])) / n, 10: sum(a == b for a, b in zip(words, words[2:])) / n,
        11: len(set(words)) / n, 12: 1 - len(set(lines)) / len(lines), 13: sum(len(w) <= 2 for w in words) / n, 14: sum(len(w) > 15 for w in words) / n, 15: share(lambda c: c >= 0xC0) / chars, 16: len(words) / len(lines), 17: sum(97 <= w[0] <= 122 for w in words) / n,
    }


def test_quality_features_one_by_one():
    texts = ["One two two two THREE!! 4 5", "a\nb\na\nb", "é É ñandú $$ | | x", "word " * 300, "x" * 40 + " y", "a b a b a b\n\nc", "|a |b c|"]
    got = quality_rank.features(texts)
    for t, row in zip(texts, got):
        for f, v in plain_features(t).items():
            assert abs(row[f] - v) < 1e-9, (t, f, row[f], v)


def test_pairs_are_ranked_by_logistic_loss():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["lorem", "ipsum###", "dolor$$$", "sit"], 40, p=p)) for p in ([0.45, 0.05, 0.05, 0.45], [0.3, 0.2, 0.2, 0.3]) for _ in range(150)]
    labels = [1] * 150 + [0] * 150

    def loss(model):
        m = model.margin(texts)
        return float(np.mean(np.log1p(np.exp(-(m[:150, None] - m[None, 150:])))))

    few, many = (quality_rank.train(texts, labels, rounds=r) for r in (1, 300))
    assert loss(many) < 0.5 * loss(few) < np.log(2)
    # A margin is the sum of the weights of a text's bins, one feature at a time.
    x = quality_rank.features(texts[:5])
    plain = [sum(many.weights[f * quality_rank.BINS + sum(e <= row[f] for e in many.edges[f])] for f in range(quality_rank.FEATURES)) for row in x]
    assert np.allclose(many.margin(texts[:5]), plain)
    assert abs(np.mean(many.margin(texts) < many.cut) - 0.5) < 0.02  # the cut is the quantile of the share of label 0


def test_language_logits_are_sums_over_ngrams():
    rng = np.random.default_rng(3)
    table = rng.standard_normal((1 << 8, 3)).astype(np.float32)
    table[0] = 0
    model = lang_id.LanguageModel(["a", "b", "c"], table, np.array([0.1, 0.2, 0.3]))
    texts = ["Ab c", "é", "x\ty  z", "long " * 50]
    for t, z in zip(texts, model.logits(texts)):
        data = (" " + " ".join(t.lower().split()) + " ").encode()
        total, count = np.zeros(3), 0
        for n in range(1, lang_id.GRAMS + 1):
            for i in range(len(data) - n + 1):
                h = sum((data[i + n - 1 - k] + 1) * pow(0x01000193, k + 1, 1 << 32) for k in range(n)) % (1 << 32)
                mixed = (h ^ (h >> 15)) * (0x2C1B3C6D + 2 * (n - 1)) % (1 << 32)
                total += table[1 + (mixed >> 8) % 255]
                count += 1
        assert np.allclose(z, total / count + model.bias, atol=1e-5), t


def test_few_runs_are_looked_up_as_pieces(sampler, monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 12))) for _ in range(3000))
    asked, search = [], np.searchsorted

    def counting(a, v, *args, **kwargs):
        if a is sampler.hashes:
            asked.append(np.size(v))
        return search(a, v, *args, **kwargs)

    monkeypatch.setattr(np, "searchsorted", counting)
    parts = piece_sampling.PARTS.findall("▁" + text.replace(" ", "▁"))
    ids = sampler._lattice(parts)[1]
    assert 0 < sum(asked) < 3 * len(text)
    # Every piece is found wherever it ends.
    code, at = {p: i for p, (i, _) in sampler.weights.items()}, 0
    for p in parts[:300]:
        for j in range(1, len(p) + 1):
            want = {m: code[p[j - m : j]] for m in range(1, j + 1) if p[j - m : j] in code}
            assert {m + 1: int(i) for m, i in enumerate(ids[at + j]) if i > 0} == want
        at += len(p) + 1
