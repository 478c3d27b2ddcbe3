"""The corpus operators on very long texts, against brute force where a method decides, and on hot groups."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from test_llm_operators import DOCS, TOKENIZER, plain_components, plain_personal, plain_removed, plain_secrets, prose

from lodestar.llm import common, html, jaccard, language, packing, pii, quality, repeats, secrets, topk

# --- 1 packing -----------------------------------------------------------------------------------------------


def test_ids_of_all_letters():
    """Every code point up to U+2FFF alone, in front of, inside and behind letters."""
    from tokenizers import Tokenizer

    texts = [t for c in map(chr, range(0x3000)) for t in (c, c + "bc", "b" + c + "c", "bc" + c, "ə" + c + "ẞ")]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in packing.token_ids(texts, TOKENIZER)] == [e.ids for e in want]


# --- 2 HTML --------------------------------------------------------------------------------------------------


class Tree(HTMLParser):
    """A well-formed page as nested lists: [tag, classes, children]."""

    def __init__(self, page: str):
        super().__init__()
        self.root = ["#page", "", []]
        self.open = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs).get("class", ""), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_main_text(pages: list[tuple], min_pages: int, min_share: float, min_hosts: int) -> dict[int, tuple[str, int]]:
    """(text, blocks deleted) of pages (id, host, html) from the rules alone: trees, subtrees as nested tuples, counts in dictionaries."""
    words = lambda s: s.split()

    def dropped(n) -> bool:
        return n[0] in html._DROPPED or bool(set(n[1].split()) & (html._ADVERTS if n[0] in ("article", "main") else html._AROUND))

    def clean(n):
        return [n[0], n[1], [c if isinstance(c, str) else clean(c) for c in n[2] if isinstance(c, str) or not dropped(c)]]

    def blocks(n, gone=(), path=()) -> list[tuple[str, tuple]]:
        """(text, landmarks around) in page order, without deleted nodes."""
        out: list[tuple[str, tuple]] = []

        def walk(n, path):
            path = (*path, id(n)) if n[0] == "article" or (n[0] == "main" and not path) else path
            if n[0] in html._BLOCK:
                out.append(("\x01", path))
            for c in n[2]:
                if isinstance(c, str):
                    out.append((c, path))
                elif id(c) not in gone:
                    walk(c, path)
            if n[0] in html._BLOCK:
                out.append(("\x01", path))

        walk(n, path)
        done, held, where = [], "", ()
        for text, p in [*out, ("\x01", ())]:
            if text == "\x01":
                if held.split():
                    done.append((" ".join(held.split()), where))
                held = ""
            else:
                where = p if not held.split() else where
                held += text
        return done

    def plain(n):  # (plain, linked, links, size)
        got = [(len(" ".join(words(c))),) * 1 + (0, 0) if isinstance(c, str) else plain(c) for c in n[2]]
        a, b, c = (sum(g[k] for g in got) for k in range(3))
        return (0, a + b, c + 1) if n[0] == "a" else (a, b, c)

    def kind(n):
        return n[0] + "." + ".".join(sorted(set(n[1].split())))

    def shape(n):
        return (kind(n), frozenset(shape(c) for c in n[2] if not isinstance(c, str)))

    def key(n, marked):
        a, b, links = plain(n)
        if not marked and links >= html.LINKS and b > a:
            return ("shape", shape(n))
        import re

        return ("exact", kind(n), tuple(re.sub(r"\d+", "0", " ".join(words(c))) if isinstance(c, str) else key(c, marked or c[0] in ("article", "main")) for c in n[2] if not isinstance(c, str) or words(c)))

    def holds(n) -> bool:
        return any(not isinstance(c, str) and (c[0] in ("article", "main") or holds(c)) for c in n[2])

    def running(n) -> bool:
        a, b, _ = plain(n)
        return n[0] in html._RUNNING or (n[0] in html._HOLDING and a > b) or any(running(c) for c in n[2] if not isinstance(c, str))

    def candidates(tree):
        total = sum(len(t) for t, _ in blocks(tree))
        out = []

        def walk(n, marked):
            marked = marked or n[0] in ("article", "main")
            for c in n[2]:
                if not isinstance(c, str):
                    a, b, _ = plain(c)
                    if c[0] in html._BLOCK and c[0] not in ("html", "body", "article", "main") and not holds(c) and not (marked and running(c)) and 0 < 2 * (a + b) <= total:
                        out.append((key(c, marked), c))
                    walk(c, marked)

        walk(tree, False)
        return out

    def choose(rows):
        size: Counter = Counter()
        for text, path in rows:
            for m in path:
                size[m] += len(text)
        tops = {p[0] for _, p in rows if p}
        whole = sum(size[m] for m in tops)
        if not whole:
            return rows
        here: tuple = ()
        while True:
            inner = {p[len(here)] for _, p in rows if p[: len(here)] == here and len(p) > len(here)}
            best = max(inner, key=lambda m: size[m], default=None)
            if best is None or 2 * size[best] <= whole:
                break
            here, whole = (*here, best), size[best]
        kept = [r for r in rows if r[1][: len(here)] == here and r[1]]
        is_article = {id(n) for t in trees.values() for n in every(t) if n[0] == "article"}
        comment = lambda p: any(p[k] in is_article and p[k - 1] in is_article for k in range(max(1, len(here)), len(p)))
        return [r for r in kept if not comment(r[1])]

    def every(n):
        yield n
        for c in n[2]:
            if not isinstance(c, str):
                yield from every(c)

    trees = {i: clean(Tree(page).root) for i, _, page in pages}
    host = {i: h for i, h, _ in pages}
    mains = {i: tuple(t for t, _ in choose(blocks(t))) for i, t in trees.items()}
    per_host, seen = defaultdict(set), defaultdict(set)
    for i, t in trees.items():
        per_host[host[i]].add(mains[i])
        for k, _ in candidates(t):
            seen[host[i], k].add(mains[i])
    hosts: dict = defaultdict(set)
    for (h, k) in seen:
        hosts[k].add(h)
    out = {}
    for i, t in trees.items():
        h = host[i]

        def template(k, h=h):
            n, of = len(seen[h, k]), len(per_host[h])
            often = n >= min_pages and n >= (html.SHAPE_SHARE if k[0] == "shape" else min_share) * of
            return often or (k[0] == "shape" and of < min_pages and len(hosts[k]) >= min_hosts)

        gone = {id(n) for k, n in candidates(t) if template(k)}
        left = blocks(t, gone)
        kept = choose(left)
        out[i] = (" ".join(x for x, _ in kept), len(blocks(t)) - len(left))
    return out


def made_page(rng: random.Random, site: random.Random, landmark: str) -> str:
    """A page of a site: a menu whose links differ, boxes of the site's own words, an article of the page's, comments."""
    say = lambda r, n: " ".join(prose(r, n))
    links = lambda r, n: "".join(f"<li><a href='/{r.random()}'>{say(r, 1)}</a></li>" for _ in range(n))
    menu = f"<div class='{site.choice(['top', 'bar'])}'><ul>{links(rng, rng.randrange(3, 7))}</ul></div>"
    box = f"<div class='box'><div>{say(site, 4)}</div><p>{say(site, 5)} {rng.randrange(99)}</p></div>"
    note = "<div class='notice'>cookies</div>" if rng.random() < 0.5 else ""
    body = f"<h1>{say(rng, 3)}</h1>" + "".join(f"<p>{say(rng, 20)} <b>{say(rng, 2)}</b></p>" for _ in range(rng.randrange(1, 4)))
    body += f"<ul>{links(site, 2)}</ul><div class='intro'>{say(rng, 6)}</div>"
    if landmark:
        extra = f"<article>{say(rng, 2)}</article>" if rng.random() < 0.3 else ""
        body = f"<{landmark}>{body}{extra}</{landmark}>" + (f"<article>{say(rng, 3)}</article>" if rng.random() < 0.3 else "")
    parts = [menu, box, body, note]
    if rng.random() < 0.5:
        parts.append(f"<div class='more'>{box}<ul>{links(rng, 4)}</ul></div>")
    return f"<html><body>{''.join(parts)}<footer>{say(site, 4)}</footer></body></html>"


def test_template_is_brute_force(spark):
    """Hosts with and without article and main elements, small ones too: the rules spelt out on trees give the same text and the same deletions."""
    rng = random.Random(40)
    rows = []
    for h in range(16):
        landmark = ("", "article", "main", "")[h % 4]
        for k in range((12, 7, 3, 2)[h // 4]):
            rows.append((len(rows), f"h{h}.example", made_page(random.Random(rng.random()), random.Random(h), landmark)))
    rows += [(len(rows) + k, "h0.example", rows[0][2]) for k in range(8)]  # copies of a page
    table = spark.createDataFrame([(i, f"https://{h}/{i}", p) for i, h, p in rows], "page_id bigint, url string, html string")
    want = plain_main_text(rows, 5, 0.1, 6)
    got = {r.page_id: (r.text, r.n_template) for r in html.extract(table, 5, 0.1, 6).collect()}
    assert got == want
    assert sum(n for _, n in got.values()) > 300


def test_template_goes_without_landmarks(spark):
    """The test tables' pages with nav, article and footer made plain divs: the menus are found by their shape and go, all else stays."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import pyspark.sql.functions as F

    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)(nav|article|footer)>", "<$1div>"))
    got = {r.page_id: r for r in html.extract(bare).collect()}
    full = {r.page_id: r for r in html.extract(pages).collect()}
    assert sum(r.n_template > 0 for r in got.values()) > 0.9 * len(got)
    for i, r in got.items():
        if r.n_template:
            assert r.text.startswith(full[i].text) and "©" in r.text[len(full[i].text) :]


# --- 5, 8 scanning -------------------------------------------------------------------------------------------

LONG = 400_000
RUNS = ["x" * LONG, "1" * LONG, "a1b2" * (LONG // 4), "漢字" * (LONG // 2) + "1" * 5, "a@" * (LONG // 2), "@" * LONG, "1." * (LONG // 2), "+1" * (LONG // 2), "+1" + "(" * LONG, "a." * (LONG // 2) + "@", "://a:" * (LONG // 5), "1+" * (LONG // 4) + "://a:b@c", "a" * LONG + "://u:p@h", "AKIA" * (LONG // 4), "token" * (LONG // 5), "token " + " " * LONG + "= abcdefgh", "-----BEGIN " + "A " * (LONG // 2) + "PRIVATE KEY-----", "ab1.2.3.4 a@b.c " * (LONG // 16), "1 " * (LONG // 2), "4111-" * (LONG // 5)]


def test_scanning_is_linear():
    """Texts of one run, each several hundred thousand characters: seconds for all of them; the short forms agree with plain expressions."""
    began = time.process_time()
    for text in RUNS:
        base = pii.base_spans(text)
        pii.shaped(text, base)
        for rule_set in secrets.RULES:
            secrets.find(text, rule_set)
    assert time.process_time() - began < 30
    for text in RUNS:
        short = text[:60] + text[-60:]
        assert pii.base_spans(short) == [(pii.KINDS[k], s, e) for s, k, e in plain_personal(short)]
        assert secrets.find(short, "base") == ",".join(f"{k}:{s}:{e}" for s, _, k, e in plain_secrets(short))


def test_passwords_in_addresses():
    import re

    rng = random.Random(50)
    for _ in range(3000):
        text = "".join(rng.choice(["http", "://", "a", ":", "@", "1", "+", "/", " ", "-"]) for _ in range(14))
        want = [m.span(1) for m in re.finditer(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", text)]
        assert secrets._url(text) == want


def test_shaped_tokens():
    import re

    rng = random.Random(51)
    for _ in range(2000):
        text = "".join(rng.choice(["ab", "@", "1", "22", ".", " ", "(", "\n", "é", "333", "a@b.c", "10.0.0.1"]) for _ in range(12))
        base = pii.base_spans(text)
        want = []
        for m in re.finditer(r"\S+", text):
            if "@" in m[0] or sum(c in "0123456789" for c in m[0]) >= 4:
                s = m.start() + len(m[0]) - len(m[0].lstrip(pii._EDGES))
                e = m.end() - len(m[0]) + len(m[0].rstrip(pii._EDGES))
                if e - s >= 5 and not any(s < b and a < e for _, a, b in base):
                    want.append((s, e))
        assert pii.shaped(text, base) == want
    assert pii.context("call " + "x" * 58 + " me at 1", 70) == "me at" and pii.context("ab " + "x" * 58 + " 1", 62) == "" and pii.context("a b", 3) == "a b"


def plain_scores(rows: list[tuple], rounds: int) -> dict[tuple, tuple[float, int]]:
    """(confidence, support) of (pattern, label) from (pattern, instance, kind) by loops over dictionaries."""
    edges = set(rows)
    support = Counter((p, k) for p, _, k in edges if k != "?")
    conf = {(p, label, i, k): float(k == label) for p, i, k in edges for q, label in support if q == p}
    for _ in range(rounds):
        of = defaultdict(list)
        for (p, label, _, _), c in conf.items():
            of[p, label].append(c)
        mean = {x: sum(c) / len(c) for x, c in of.items()}
        free = {(i, label): 1.0 for p, label, i, k in conf if k == "?"}
        for p, label, i, k in conf:
            if k == "?":
                free[i, label] *= 1 - 0.5 * mean[p, label]
        conf = {(p, label, i, k): 1 - free[i, label] if k == "?" else c for (p, label, i, k), c in conf.items()}
    of = defaultdict(list)
    for (p, label, _, _), c in conf.items():
        of[p, label].append(c)
    return {x: (sum(c) / len(c), support[x]) for x, c in of.items()}


def test_pattern_scores_are_brute_force(spark):
    rng = random.Random(52)
    rows = [(f"p{rng.randrange(9)}", f"i{rng.randrange(40)}", rng.choice(["email", "phone", "?", "?"])) for _ in range(200)]
    found = spark.createDataFrame([("b", p, i, k, 0, 1) for p, i, k in rows] + [("b", "spans", None, None, None, None)], pii.OCCURRENCES)
    got = {(r.pattern, r.label): (r.confidence, r.support) for r in pii.score_patterns(found, 3).collect()}
    want = plain_scores(rows, 3)
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x]) for x in want)


# --- 6 Jaccard join ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [200, 3000])
def test_large_neighbourhoods(spark, tile):
    """A group of near copies over many tiles, a chain of which neighbours only are alike, and others beside them."""
    rng = random.Random(60)
    first = prose(rng, 60)
    rows = []
    for _ in range(60):
        copy = list(first)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = rng.choice(["x", "y", "z"]) + str(rng.randrange(99))
        rows.append((len(rows), " ".join(copy)))
    chain = [f"c{k}" for k in range(160)]
    rows += [(len(rows) + k, " ".join(chain[2 * k : 2 * k + 60])) for k in range(50)]
    rows += [(len(rows) + k, " ".join(first[:30] + prose(rng, 30))) for k in range(8)]
    got = jaccard.join(spark.createDataFrame(rows, DOCS), 3, 7, 10, tile).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_components(rows, 3, 7, 10)


# --- 7 repeated passages -------------------------------------------------------------------------------------


def plain_repeats(rows: list[tuple], window: int) -> list[tuple]:
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        starts = [i for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1]
        runs = [i for n, i in enumerate(starts) if not n or starts[n - 1] != i - 1]
        ends = [i for n, i in enumerate(starts) if n + 1 == len(starts) or starts[n + 1] != i + 1]
        out.append((str(d), len(runs), max((b - a + window for a, b in zip(runs, ends, strict=True)), default=0)))
    return sorted(out)


@pytest.mark.parametrize("subtree_rows", [4096, 12, 2])
def test_maximal_repeats(spark, subtree_rows):
    """Passages in many documents, also such that differ at either end: prefixes are lengthened once, twice or never."""
    rng = random.Random(70)
    passages = [prose(rng, n) for n in (35, 37, 50, 90)]
    rows = []
    for i in range(50):
        doc = prose(rng, rng.choice([0, 10, 80]))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(3)
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = p[cut : len(p) - rng.randrange(3)]
        rows.append((i, " ".join(doc)))
    rows += [(100, "la " * 60), (101, rows[3][1]), (102, None)]
    got = repeats.remove(spark.createDataFrame(rows, DOCS), subtree_rows=subtree_rows).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removed(rows, 35)
    assert sorted((str(r.doc_id), r.n_repeats, r.longest_repeat) for r in got) == plain_repeats(rows, 35)


def test_suffix_array():
    rng = np.random.default_rng(7)
    heads, suffixes = rng.integers(0, 3, 80).astype(np.uint64), rng.integers(0, 2, (80, 6)).astype(np.uint32) * 300
    order, common = repeats.suffix_array(heads, suffixes)
    rows = [(int(h), *map(int, s)) for h, s in zip(heads, suffixes, strict=True)]
    assert [rows[i] for i in order] == sorted(rows)
    for a, b, n in zip(order, order[1:], common, strict=False):
        same = next((k for k in range(6) if rows[a][k + 1] != rows[b][k + 1]), 6)
        assert n == (same if rows[a][0] == rows[b][0] else 0)


# --- 10 top k ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("annulus", "stream"), [(16384, 65536), (7, 5)])
def test_top_k_odd_vectors(spark, annulus, stream):
    """Vectors of unequal length, empty, of large and of too large components, and one vector that a third of the rows share."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=int(rng.integers(0, 9))).tolist()) for i in range(150)] + [(150 + i, [0.25] * 8) for i in range(80)]
    rows += [(300, [1e30] * 8), (301, [3e5, 1.0]), (302, []), (350, [2e5] * 3), (351, [-1e6, 5.0])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), 5, pivots=5, sample=60, annulus=annulus, stream=stream).collect()
    fine = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i != 300}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = {q: sorted(((-dot(fine[q], e), i) for i, e in fine.items() if i != q))[:5] for q in fine if q % 50 == 0}
    have = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        have[r.query_id].append((-r.score, r.vec_id))
    assert dict(have) == want
    none = spark.createDataFrame([(0, []), (50, [])], "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(topk.integers(none), topk.integers(none)).collect()) == [(0, 50, 0), (50, 0, 0)]


def test_large_sums_are_exact(spark):
    rows = [(0, [2.0**20 + 1 / 256, 1.0]), (1, [2.0**20 + 3 / 256, 2.0]), (2, [2.0**20 + 2 / 256, 3.0])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    fine = {i: [int(256 * x) for x in e] for i, e in rows}
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(v, v, 5).collect()}
    assert got == {(a, b): sum(x * y for x, y in zip(fine[a], fine[b], strict=True)) for a in fine for b in fine if a != b}
    assert max(got.values()) > 2**53


# --- very long texts -----------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    """Texts of a megabyte and more beside short ones: all operators read them whole."""
    rng = random.Random(80)
    long = " ".join(prose(rng, 100_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "short text"), (5, "one line\n" * 50_000), (6, None)]
    docs = spark.createDataFrame(rows, DOCS)
    began = time.time()
    ids = packing.token_ids([long], TOKENIZER)[0]
    got = [r for r in packing.pack(docs, TOKENIZER).collect() if r.doc_id == 1]
    assert sum(r.length for r in got) == len(ids) // 4 + 1
    known = language.profiles(spark.createDataFrame([(i, t, "aa") for i, t in rows[:2]], DOCS + ", lang string"))
    assert {r.doc_id: r.lang_pred for r in language.predict(docs, known).collect()} == {1: "aa", 2: "aa", 3: "aa", 4: "aa", 5: "aa", 6: "und"}
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove(docs).collect()}
    assert removed[1] == (100_000, 100_000) and removed[2] == (100_001, 100_000) and removed[3] == (1, 0) and removed[5] == (100_000, 100_000)
    model = quality.fit([(*quality.featurise(t), y) for t, y in (("a b.", 1), ("$$ ||", 0))])
    assert quality.score(docs, model).count() == secrets.report(docs).count() == pii.report(docs).count() == 6
    assert time.time() - began < 300


def test_no_setting_changes(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert common.shared_dir(spark)
