"""The corpus operators against brute force, and their defined results on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import common, decontaminate, html, jaccard, language, packing, pii, quality, repeats, secrets, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = [a + b for a in ("ba", "ko", "ri", "tu", "ze", "mo") for b in ("n", "l", "st", "ra", "")]
DOCS = "doc_id bigint, text string"


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls anywhere, empty and blank texts, repeated rows, a repeated id, a long text, no letters."""
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "one"), (6, "Ünï çödé ſtraße ΑΣ"), (None, "no id here"), (None, None),
        (7, "12345 67890 !!! ???"), (8, "word " * 5000), (9, "a b c\x0bd\x0ce"), (10, "x" * 20000), (10, "another text under the same id"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with what operators use inside."""
    names = ["digest", "key", "h", "n", "score", "lang_pred", "blob", "_base", "label", "at", "seed", "id", "lang", "n_chars"]
    schema = DOCS + ", " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, *["extra"] * len(names)) for r in odd_rows()], schema)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 packing -----------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150))
def test_plan_is_best_fit_decreasing(lengths):
    rows = packing.plan(dict(Counter(lengths)), 40)
    used: Counter = Counter()
    placed = []
    for length, n in Counter(lengths).items():
        mine = [r for r in rows.tolist() if r[0] == length]
        for rank in range(n):
            _, first, seq, m, off = max(r for r in mine if r[1] <= rank)
            k = rank - first
            placed.append((seq + k // m, off + k % m * length, length))
    for seq, off, length in sorted(placed):
        assert off == used[seq]
        used[seq] += length
    assert max(used.values(), default=0) <= 40
    assert len(used) == best_fit_decreasing(lengths, 40)


def test_tree_finds_the_tightest():
    tree = packing.CapacityTree(100)
    for c in (3, 50, 100):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 51, 100)] == [3, 3, 50, 100, 100]
    tree.add(100, -1)
    assert tree.tightest(60) is None


def reference_ids(text: str | None) -> np.ndarray:
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aB'St <|endofx>!é́Σİſ  \x0b\x1c0½'ll", max_size=40)))
def test_token_ids_are_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(packing.token_ids([text, text + " <|endoftext|> A"], TOKENIZER)[0], dtype="<u4")
    assert ids.tolist() == reference_ids(text)[:-1].tolist()


def test_pack_round_trip(spark, odd, none):
    got = packing.pack(odd, TOKENIZER, 64).collect()
    want = sorted((str(i), zlib.crc32(ids[s : s + 64].tobytes()), s, len(ids[s : s + 64])) for i, t in odd_rows() for ids in [reference_ids(t)] for s in range(0, len(ids), 64))
    assert sorted((str(r.doc_id), r.ids_crc32, r.start, r.length) for r in got) == want
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    assert packing.pack(none, TOKENIZER).count() == 0


# --- 2 HTML --------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var x = "<p>no</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<article><h1>Head&nbsp;line</h1><p>One &lt;b&gt;<b>two</b><br>three<p>four<div class="share-buttons">Share</div><form>in</form><aside>side</aside><!-- c --><ul><li>x<li>y</ul></article>
<div class="cookie-notice">Cookies</div><section id="comments"><article>first!</article></section><footer>&copy; foot</footer></body></html>"""


def text_of(page: str | None) -> str:
    return " ".join(html.chosen(html.parse(page)[0], set())[0])


def test_main_text():
    assert text_of(PAGE) == "Head line One <b>two three four Share x y"
    assert text_of(None) == text_of("") == text_of("<p></p>") == ""
    assert text_of("just text") == "just text"
    assert text_of("<p>a<script>unclosed <p>b") == "a"
    assert text_of('<p title="a>b">c &#233;&notanentity; 1 < 2</p>') == "c é¬anentity; 1 < 2"
    assert text_of('<body class="has-sidebar"><article class="post comments-open" style="overflow:hidden" data-id="menu"><div class="entry-header"><h1>T</h1></div><p hidden>h<p aria-hidden="false">k</article>') == "T k"
    assert text_of('<div id="content"><p>a</p><div class="comment-list"><article class="comment odd"><p>no</article></div><div class="adBox">no</div><div role="navigation">no</div></div><div class="sidebar">no</div>') == "a"
    # names count as a whole, and only of menus, headers, footers, sidebars, notices, adverts and comments
    assert text_of('<article><p class="share-price">a<p class="search-results">b<div class="form-section">c</div><div class="menu-items post">d</div></article>') == "a b c d"
    assert text_of('<div class="post">a</div><p>b') == "a b"
    # the article is the element with most of the text; articles inside it are comments
    assert text_of("<main><h1>Long</h1><p>text of the page</main><article>teaser</article>") == "Long text of the page"
    assert text_of("<article><p>the long text of the page</p><section><article>first</article><article>me too</article></section></article>") == "the long text of the page"
    assert text_of("<main><h1>Blog</h1><article><p>one post</article><article><p>two post</article></main>") == "Blog one post two post"
    assert text_of("<article>one</article><article>two</article><div>three</div>") == "one two"
    assert text_of('<div itemprop="articleBody">one<article>two two</article></div>') == "two two" and text_of("<article><h1>T</h1><div itemprop=articleBody>text</div></article>") == "T text"
    assert text_of("<div>" * 300 + "deep" + "</div>" * 100) == "deep"


def test_templates_by_host(spark):
    box = "<div><p>Subscribe to our paper today</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body><div><p>{' '.join(prose(random.Random(i), 60))}</p></div>{box}</body>") for i in range(12)]
    rows += [(100, "https://b.example/1", f"<body>{box}<p>once here</p></body>"), (101, None, None), (102, "no url", "<p>text</p>"), (103, "https://a.example/x", f"<article><p>Subscribe to our paper today</p></article>{box}")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, hashes string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == " ".join(prose(random.Random(i), 60)) and got[i].n_chars == len(got[i].text)
    assert got[100].text == "Subscribe to our paper today once here"
    assert (got[101].text, got[101].n_chars, got[102].text, got[103].text) == ("", 0, "text", "Subscribe to our paper today")
    assert html.extract(pages.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    """Copies of a page without an article keep their text, lists and tables of near copies too; a list of links in an article goes."""
    host = lambda i: f"https://c.example/{i}"
    words = lambda seed, n: " ".join(prose(random.Random(seed), n))
    box = "<div><p>Subscribe to our paper today</p></div>"
    copied = f"<body><div><p>{words(1, 30)}</p><p>{words(2, 30)}</p><ul><li>{words(3, 20)}</li></ul></div>{box}</body>"
    rows = [(i, host(i), copied) for i in range(8)] + [(10 + i, host(i), f"<body><div><p>{words(10 + i, 60)}</p></div>{box}</body>") for i in range(8)]
    held = f"<ul><li>{words(4, 6)}</li></ul><table><tr><td>{words(5, 6)}</td></tr></table><dl><dt>term</dt><dd>{words(6, 6)}</dd></dl><figure><figcaption>{words(7, 5)}</figcaption></figure><div>{words(8, 6)}</div>"
    links = "<ul> <li><a href='/a'>Other news</a> </li> <li><a href='/b'>More news</a></li> </ul>"
    rows += [(30 + i, "https://d.example/", f"<article><p>{words(30 + i, 60)}</p>{held}{links}</article>") for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"{words(1, 30)} {words(2, 30)} {words(3, 20)}" and got[10 + i] == words(10 + i, 60)
        assert got[30 + i] == " ".join([words(30 + i, 60), words(4, 6), words(5, 6), "term", words(6, 6), words(7, 5), words(8, 6)])


def test_main_text_has_no_caps(spark):
    """Deep unclosed elements, far templates, long and unmatched quotes; in linear time."""
    assert text_of("<nav>" + "<span>" * 600 + "menu</nav><article><p>kept</article>") == "kept"
    assert text_of('<div class="sidebar">' + "<b><i>" * 400 + "side</div><article><p>kept</p></article>") == "kept"
    assert text_of('<p><img alt="' + "a > b " * 30_000 + '">text</p>') == "text"
    assert text_of("<table><tr><td>" + "<div>" * 700 + "a<td>b</table>") == "a b"
    far = "<div>" + "<div>" * 200 + "Subscribe to our paper" + "</div>" * 201
    rows = [(i, "https://e.example/", f"<body><div>{' '.join(prose(random.Random(i), 60))}</div>{far}</body>") for i in range(6)]
    rows += [(6, "https://e.example/", f"<body><div>{' '.join(prose(random.Random(6), 60))}</div><div>{'<div>' * 200}Subscribe to our paper{'</div>' * 150}<p>and</p></div></body>")]
    page, hashes = html.parse(rows[0][2])
    assert len(page[4][1]) == 201 and {h for h, _ in page[4][1]} <= set(hashes)
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r.text == " ".join(prose(random.Random(r.page_id), 60)) for r in got if r.page_id < 6)
    began = time.process_time()
    for page in ("<div>a" * 50_000, '<a "><a ">' * 30_000, "<a '\">" * 50_000, "<a '>' " * 50_000, "<b>" * 50_000 + "</i>" * 50_000):
        html.parse(page)
    assert time.process_time() - began < 60


# --- 3 decontamination ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [10**9, 0])
def test_decontamination(spark, odd, none, limit):
    rng = random.Random(3)
    items = [(1, " ".join(prose(rng, 40))), (2, " ".join(prose(rng, 25))), (3, "five short words are here"), (4, None), (5, "tiny one"), (None, "")]
    inside = items[0][1].split()
    near = [w if i % 9 else "changed" for i, w in enumerate(inside)]
    docs = [(10, " ".join(prose(rng, 200))), (11, " ".join(prose(rng, 50) + inside + prose(rng, 50))), (12, " ".join(prose(rng, 30) + near + prose(rng, 9)).upper() + "!"), (13, " ".join(inside[:8])), (14, "x five  short, words are here y"), (15, " ".join(inside[5:30])), (11, "clean text under the same id")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs + odd_rows(), DOCS)
    found = decontaminate.overlaps(table, bench, broadcast_rows=limit, broadcast_keys=limit)
    import pyspark.sql.functions as F

    ids = {(r.doc_id, r.item_id) for r in table.withColumn("key", F.md5("text")).join(found, "key").collect()}
    assert ids == {(11, 1), (12, 1), (14, 3), (15, 1)}
    kept = decontaminate.drop(table, bench)
    assert kept.columns == table.columns and kept.count() == table.count() - 4
    assert decontaminate.report(none, bench).count() == 0 == decontaminate.report(table, bench.limit(0)).count()
    assert decontaminate.drop(odd, bench).count() == odd.count() and decontaminate.drop(odd, bench).columns == odd.columns


def plain_overlaps(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id) by the rule alone: every item laid over every text at every place, without seeds."""
    split = lambda text: [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    out = set()
    for d, text in docs:
        h = split(text)
        for i, said in items:
            item = split(said)
            n = min(15, len(item))
            for diagonal in range(-len(item) + 1, len(h)) if item else ():
                same = [h[p] == item[p - diagonal] for p in range(max(diagonal, 0), min(len(h), diagonal + len(item)))]
                if any(5 * sum(same[s : s + n]) >= 4 * n for s in range(len(same) - n + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [10**9, 0])
def test_decontamination_is_the_rule(spark, limit):
    """Items of 5 to 40 tokens with changed tokens anywhere, also every fifth one: as many as the rule allows, and one more."""
    rng = random.Random(33)
    items, docs = [], []
    for n in (5, 6, 9, 10, 11, 12, 14, 15, 15, 17, 20, 40):
        item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        items.append((len(items), " ".join(item)))
        stretch = min(n, 15)
        for changed in [set(range(k, n, 5)) for k in range(5)] + [set(rng.sample(range(n), stretch // 5 + more)) for more in (0, 0, 0, 0, 0, 1, 1)]:
            docs.append((len(docs), " ".join(prose(rng, 7) + ["changed" if i in changed else w for i, w in enumerate(item)] + prose(rng, 4))))
    found = decontaminate.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=limit, broadcast_keys=limit)
    keys = {hashlib.md5(t.encode()).hexdigest(): d for d, t in docs}
    want = plain_overlaps(docs, items)
    assert {(keys[r.key], r.item_id) for r in found.collect()} == want and len(want) < len(docs)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_decontamination_reads_every_item(spark, limit):
    """Items of one to four tokens, ids with two texts, and rows without id."""
    rng = random.Random(34)
    said = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (30, 25, 20, 4, 3, 2, 1)]
    items = [(1, said[0]), (1, said[1]), (None, said[2]), (None, "of no text"), (2, said[3]), (3, said[4]), (4, said[5]), (5, said[6]), (6, said[6].upper() + "!")]
    docs = [(i, f"some words {t} {t}, and more") for i, t in enumerate(said)] + [(20, "of no other text"), (21, " ".join(said[3].split()[:3]) + " else")]
    found = decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == plain_overlaps(docs, items) == {(0, 1), (1, 1), (2, None), (3, 2), (4, 3), (5, 4), (6, 5), (6, 6)}
    assert all(r.agree == r.best * r.item_tokens // r.stretch for r in found)
    found = decontaminate.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=limit, broadcast_keys=limit)
    assert found.count() == 8


def test_decontamination_of_long_items(spark):
    """Work on an overlap grows with its length only; the figures are those of every stretch tried."""
    rng = random.Random(35)
    item = [f"u{rng.randrange(10**6)}" for _ in range(20_000)]
    text = [w if rng.random() < 0.75 else "changed" for w in item]
    docs, items = [(1, " ".join(["before", *text, "after"])), (2, " ".join(item[9_000:12_000])), (3, "clean")], [(7, " ".join(item))]
    found = {r.doc_id: r for r in decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    same = [a == b for a, b in zip(text, item, strict=True)]
    assert (found[1].agree, found[1].best) == (sum(same), max(sum(same[i : i + 15]) for i in range(len(same) - 14)))
    assert (found[2].agree, found[2].best, found[2].item_tokens) == (3000, 15, 20_000) and set(found) == {1, 2}


def test_masks_cover_every_placement():
    for length in range(1, 16):
        changed = length // 5
        masks = decontaminate.cover(length, decontaminate.SIMILARITY)
        for gone in itertools.combinations(range(length), changed):
            assert any(all(at + i not in gone for i, c in enumerate(m) if c == "1") for m in masks for at in range(length - len(m) + 1))


# --- 4 language ----------------------------------------------------------------------------------------------

SAID = {"en": "the quick brown fox jumps over the lazy dog and then the other thing", "de": "der schnelle braune fuchs springt über den faulen hund und dann das andere ding", "es": "el rápido zorro marrón salta sobre el perro perezoso y luego la otra cosa"}


def out_of_place(text: str, known: dict[str, list[str]], size: int) -> str:
    counts = Counter(g for w in text.split() for g in language.grams_of(w))
    code = language.Ranker(known, size).code
    mine = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]
    return min(sorted(known), key=lambda lang: sum(abs(known[lang].index(g) - i) if g in known[lang] else size for i, g in enumerate(mine)))


def test_language(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(SAID[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(SAID) * 30)]
    train = spark.createDataFrame([*rows, (None, None, "en"), (999, "unlabelled", None)], DOCS + ", lang string")
    known = language.profiles(train, 20, 100)
    assert sorted(known) == sorted(SAID) and all(len(p) <= 100 for p in known.values())
    got = language.predict(train.where("lang is not null and text is not null"), known, 100).collect()
    assert all(r.lang_pred == r.lang == out_of_place(r.text, known, 100) and 0 <= r.score <= 1 for r in got)
    said = language.predict(odd, known, 100).collect()
    assert len(said) == len(odd_rows()) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in said)
    assert language.profiles(train.limit(0)) == {} and language.predict(none, known).count() == 0
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}


# --- 5 secrets -----------------------------------------------------------------------------------------------


def plain_secrets(text: str) -> list[tuple[int, int, str, int]]:
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "api_key", "APIKEY", "toKen", "Key", "ſecret", '"', "'", " ", ":", "=", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef01", "zz", "\n", "é"]), max_size=14).map("".join))
def test_secret_base_spans(text):
    assert secrets.find(text, "base") == ",".join(f"{k}:{s}:{e}" for s, _, k, e in plain_secrets(text))


def rng_name() -> str:
    return uuid.uuid4().hex


def test_history_joins_findings_to_all_paths(spark):
    """Every version of every path gets its findings; a blob that comes back under another path or version is not scanned again."""
    ledger = secrets.Ledger(spark, f"{common.shared_dir(spark)}/ledger-{rng_name()}")
    assert ledger.rows() is None
    schema = "path string, version int, text string, spans string"
    one = [("a", 1, "token = abcdefgh", "x"), ("a", 2, "clean", "x"), ("b", 1, "token = abcdefgh", "x"), ("c", 1, None, "x")]
    got = {(r.path, r.version): r.spans for r in secrets.history(spark.createDataFrame(one, schema), ledger).collect()}
    assert got == {("a", 1): "assign:0:16", ("a", 2): "", ("b", 1): "assign:0:16", ("c", 1): ""}
    before = ledger.rows().count()
    two = [("a", 3, "token = abcdefgh", "x"), ("d", 1, "see https://u:pw@h", "x"), (None, None, "clean", "x")]
    got = {(r.path, r.version): r.spans for r in secrets.history(spark.createDataFrame(two, schema), ledger).collect()}
    assert got == {("a", 3): "assign:0:16", ("d", 1): "url:14:16", (None, None): ""}
    assert ledger.rows().count() == before + len(secrets.RULES) == 4 * len(secrets.RULES)


def test_ledger_scans_each_blob_once(spark, odd, none):
    key = "token = abcdefgh123456 and postgres://u:pw@host"
    docs = spark.createDataFrame([(1, key), (2, key), (3, "nothing"), (4, None)], DOCS)
    first = common.materialise(secrets.scan(docs), "test")
    assert first.count() == 3 * len(secrets.RULES)
    more = docs.union(spark.createDataFrame([(5, "passwd: qwertz99"), (6, key)], DOCS))
    assert secrets.scan(docs, first).count() == 0
    new = secrets.scan(more, first)
    assert new.count() == len(secrets.RULES)
    old_rules = first.withColumn("rule_version", first.rule_version - 1)
    assert secrets.scan(docs, old_rules).count() == first.count()
    ledger = secrets.Ledger(spark, f"{common.shared_dir(spark)}/ledger-{rng_name()}")
    assert ledger.update(docs).count() == first.count() and ledger.update(docs).count() == first.count()
    got = {r.doc_id: r for r in secrets.report(more, ledger).collect()}
    assert ledger.rows().count() == first.count() + len(secrets.RULES)
    assert [got[i].n_assign for i in range(1, 7)] == [1, 1, 0, 0, 1, 1]
    assert got[1].spans == got[6].spans == "assign:0:22,url:40:42"
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[5].base_sha256 == hashlib.sha256(b"assign:0:16").hexdigest()
    assert secrets.report(none).count() == 0 and secrets.report(odd).count() == len(odd_rows())


def test_redact(spark, odd):
    docs = spark.createDataFrame([(1, "a token = abcdefgh z", 20), (2, "clean", 5), (3, None, None), (4, "0123456789abcdef0123456789", 26)], DOCS + ", n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert got == {1: ("a [SECRET] z", 12), 2: ("clean", 5), 3: (None, None), 4: ("[SECRET]", 8)}
    assert secrets.redact(odd).columns == odd.columns
    assert secrets.redact_text("abcdefghij", "hex:1:5,assign:3:8") == "a[SECRET]ij"


def test_pem_keys_go_whole(spark):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("ABCxyz019+/") for _ in range(n))
    body = [line(64), line(64), line(10) + "=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = "\n".join([begin, *body, end])
    texts = {
        f"a\n{key}\nb c": "a\n[SECRET]\nb c",
        f"a\n{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: X,00\n\n" + "\n".join(body) + "\nb c": "a\n[SECRET]\nb c",
        f"{key}\nmid\n{begin}\n" + "\r\n".join(body): "[SECRET]\nmid\n[SECRET]",
        f'k "{begin}\\n' + "\\n".join(body) + f'\\n{end}\\n" z': 'k "[SECRET]\\n" z',
        f'k "{begin}\\n' + "\\n".join(body) + '" z': 'k "[SECRET]" z',
        f"see {begin} in plain words": "see [SECRET] in plain words",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == dict(enumerate(texts.values()))
    began = time.process_time()
    secrets.find((begin + "\n" + "A" * 70) * 20_000, "extended")
    assert time.process_time() - began < 20


# --- 6 Jaccard join ------------------------------------------------------------------------------------------


def plain_components(rows: list[tuple], n: int, num: int, den: int) -> list[tuple]:
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den", "tile"), [(4, 85, 100, 3000), (5, 8, 10, 7), (2, 6, 10, 50)])
def test_jaccard_components(spark, n, num, den, tile):
    rng = random.Random(n)
    line = prose(rng, 30)
    rows = []
    for g in range(12):
        doc = prose(rng, rng.choice([3, 10, 40, 150]))
        for _ in range(rng.choice([1, 2, 6, 20])):
            copy = list(doc)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            rows.append((len(rows), " ".join(copy + (line if g % 4 == 0 else []))))
    rows += [(len(rows) + i, " ".join(line + prose(rng, k))) for i, k in enumerate((0, 1, 2, 3, 5, 8))]
    rows += [(900, "Ab  Cd\x0bef"), (901, "ab cd EF"), (902, "É a"), (903, "é a"), (904, None), (905, ""), (906, " ")]
    got = jaccard.join(spark.createDataFrame(rows, DOCS), n, num, den, tile).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(rows, n, num, den)


def test_jaccard_odd(spark, odd, none):
    got = jaccard.join(odd, 4, 85, 100).collect()
    assert len(got) == len(odd_rows())
    one = {r.doc_id: r.component_id for r in got}
    assert one[4] == one[5] == 4 and one[1] == 1 and one[2] == 2
    assert jaccard.join(none).count() == 0


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 80)).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 400)).astype(np.uint64)) for s in sets]
    points = np.array([np.bincount(s.astype(np.int64) % 8, minlength=8) for s in sets])
    tree = jaccard.CountTree(points, np.array([len(s) for s in sets]), leaf=4)
    for i, a in enumerate(sets):
        hit = set(tree.search(points[i], len(a), 8, 10, lambda _: False))
        for j, b in enumerate(sets):
            k = len(np.intersect1d(a, b))
            if 10 * k >= 8 * (len(a) + len(b) - k):
                assert j in hit


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]} or all(got[i] == find(i) for i in got)


# --- 7 repeated passages -------------------------------------------------------------------------------------


def plain_removed(rows: list[tuple], window: int) -> list[tuple]:
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("subtree_rows", [100_000, 2])
def test_repeats(spark, subtree_rows):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(60):
        doc = prose(rng, rng.choice([0, 5, 40, 200]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = rng.choice(passages)
        rows.append((i, (" " if i % 2 else "\n").join(doc)))
    rows += [(100, "la " * 90), (101, rows[5][1]), (102, rows[5][1]), (5, rows[5][1]), (103, None), (104, ""), *odd_rows()]
    got = repeats.remove(spark.createDataFrame(rows, DOCS), subtree_rows=subtree_rows).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removed(rows, 35)


def test_repeats_odd(spark, odd, none):
    got = repeats.remove(odd, with_text=True).collect()
    assert len(got) == len(odd_rows()) and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove(none).count() == 0


def test_anchors_cover_all_windows():
    h = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    at, key, lo, hi = repeats.anchors(h)
    assert lo[0] == 0 and hi[-1] == len(h) - 35 and (lo[1:] == hi[:-1] + 1).all()
    assert ((at >= hi) & (at <= lo + 35 - repeats.GRAM)).all() and (key == common.gram_hashes(h, repeats.GRAM)[at]).all()


# --- 8 personal data -----------------------------------------------------------------------------------------


def plain_personal(text: str) -> list[tuple[int, int, int]]:
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ann", "@", "mail.org", ".", "10", "255", "256", "007", "4111 1111 1111 1111", "4539-1488-0343-6467", "+1 (555) 010-9999", "+", "-", " ", "(", ")", "1", "١", "é", "\n", "00000000000000"]), max_size=12).map("".join))
def test_personal_base_spans(text):
    assert pii.base_spans(text) == [(pii.KINDS[k], s, e) for s, k, e in plain_personal(text)]


def test_bootstrap_finds_unseen(spark, odd, none):
    rows = [(i, f"please call me at +1 (555) 01{i % 10}-{9000 + i} today") for i in range(20)]
    rows += [(50, "please call me at 0171/5550-{} soon".format(1234)), (51, "in the year 1999/2000-17 it was"), (52, None)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].n_phone == 1 for i in range(20)) and got[50].n_phone == 0
    assert got[50].spans == "phone:18:32" and got[51].spans == "" and got[52].spans == ""
    assert got[50].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.report(odd).count() == len(odd_rows()) and pii.report(none).count() == 0


# --- 9 quality -----------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(9)
    unary, trans = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    node, z, pairs = quality.marginals(unary, np.array([4]), trans, np.ones(1))
    paths = [[(p >> i) & 1 for i in range(4)] for p in range(16)]
    weight = [np.exp(sum(unary[0, i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths]
    assert np.isclose(z[0], np.log(sum(weight)))
    for i in range(4):
        assert np.isclose(node[0, i, 1], sum(w for w, p in zip(weight, paths, strict=True) if p[i]) / sum(weight))
    assert np.allclose(pairs, [[sum(w * sum((a, b) == (i, j) for a, b in zip(p, p[1:], strict=False)) for w, p in zip(weight, paths, strict=True)) / sum(weight) for j in (0, 1)] for i in (0, 1)])


def test_scores_are_weighted_marginals():
    """A score from all labellings of a document's lines, spelt out: padded chains of unequal length, scored together."""
    rng = np.random.default_rng(5)
    model = {"w": rng.normal(size=37), "b": rng.normal(size=(2, 2)), "scale": 0.7, "shift": -0.2, "empty": 0.0}
    texts = ["one line.", "Two lines\n$$ || here", "a\n\nb c d!\nE F\n12", "x " * 30 + "\n" + "y\n" * 5]
    for text, got in zip(texts, quality.score_texts(model, texts), strict=True):
        x, sizes = quality.featurise(text)
        s, total, mean = x @ model["w"], 0.0, 0.0
        for path in itertools.product((0, 1), repeat=len(s)):
            weight = np.exp(sum((y - 0.5) * v for y, v in zip(path, s, strict=True)) + sum(model["b"][a, b] for a, b in itertools.pairwise(path)))
            total += weight
            mean += weight * sum(n * y for n, y in zip(sizes, path, strict=True)) / sizes.sum()
        p = mean / total
        assert np.isclose(got, 1 / (1 + np.exp(-(model["scale"] * np.log(p / (1 - p)) + model["shift"]))), atol=1e-6)


def test_quality_leaves_out_what_contradicts(spark):
    """Ids with both labels, and documents with more lines than all may have, take no part."""
    docs = spark.createDataFrame([(1, "a b c."), (2, "$$ ||"), (3, "odd one"), (4, "x\n" * 50)], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (2, 0)], "doc_id bigint, quality int")
    one = quality.train(docs, labels, lines=20)
    two = quality.train(docs.where("doc_id < 3"), labels.where("doc_id < 3"))
    assert np.allclose(one["w"], two["w"]) and np.allclose(one["b"], two["b"]) and one["scale"] == two["scale"]


def test_quality(spark, odd, none):
    rng = random.Random(10)

    def doc(good: bool) -> str:
        return "\n".join((" ".join(prose(rng, 12)) + ".") if good else " ".join([rng.choice(VOCABULARY) + "$$$"] * 12).upper() for _ in range(rng.randrange(1, 6)))

    rows = [(i, doc(i % 3 != 0)) for i in range(240)]
    docs = spark.createDataFrame([*rows, *odd_rows()], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(160)] + [(1000, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, 60)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(rows) + len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    ids = {r.doc_id: r.score for r in scored if r.doc_id is not None}
    assert np.mean([(ids[i] >= 0.5) == (i % 3 != 0) for i in range(160, 240)]) > 0.95
    assert quality.score_texts(model, [None, ""]) == [model["empty"]] * 2
    assert quality.score(odd, model).count() == len(odd_rows()) and quality.score(none, model).count() == 0
    assert quality.train(docs, labels.limit(0)) == {"constant": 0.5}


# --- 10 top k ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("annulus", [16384, 20, 1])
def test_top_k(spark, annulus):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)]
    rows += [(1000, None), (1001, [None] + [1.0] * 7), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (50, rows[50][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    v = topk.integers(table)
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), 5, pivots=6, sample=100, annulus=annulus).collect()
    fine = [(i, np.floor(256 * np.array(x, dtype=np.float32).astype(np.float64)).astype(int)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    for q in {i for i, _ in fine if i % 50 == 0}:
        mine = next(x for i, x in fine if i == q)
        want = sorted(((-int(mine @ x), i) for i, x in fine if i != q))[:5]
        have = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert have == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert topk.top_k(v.limit(0), v).count() == 0
    few = v.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for s in ('<a "' * 20000, "<" * 50000, "<div>" * 20000 + "x", '<div class="' * 20000, "<p a='" + "b" * 100000, "<!--" * 20000, "<li>x" * 20000, "<script>" * 20000, "<b><p>x" * 3000, "</section>" * 20000):
        html.parse(s)
    assert time.time() - began < 20


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world\n don't", "", "é <|endoftext|>"]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in packing.token_ids(texts, path)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_is_bounded():
    made = []
    memo = packing.Kept(lambda k: made.append(k) or k * 2, 3)
    for i in [*range(10), 9, 8, 1]:
        assert memo[str(i).encode()] == str(i).encode() * 2
        assert len(memo) <= 3 and len(memo.old) <= 3
    assert made.count(b"9") == 1 and made.count(b"1") == 2 and memo[b"x" * 65] and b"x" * 65 not in memo


def test_quality_trains_on_all_lines():
    """What tells labels apart comes after line 60 of long documents: the field learns it."""
    rng = random.Random(12)
    head = lambda n: [" ".join(prose(rng, 8)) + "." for _ in range(n)]
    rows = [("\n".join(head(70) + (["$$ || ## %% !!"] * 40 if y == 0 else head(40))), y) for y in [0, 1] * 20]
    model = quality.fit([(*quality.featurise(t), y) for t, y in rows])
    lines = [quality.featurise("\n".join([line] * 3))[0][1] @ model["w"] for line in ("$$ || ## %% !!", head(1)[0])]
    assert lines[0] < -1 and lines[1] > lines[0] + 2
    raw = quality.raw_scores(model, [quality.featurise(t) for t, _ in rows])
    assert max(r for r, (_, y) in zip(raw, rows, strict=True) if y == 0) < min(r for r, (_, y) in zip(raw, rows, strict=True) if y == 1)
