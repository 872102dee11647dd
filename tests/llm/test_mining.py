"""Personal data, collocations and ranked search against brute force; broken pages."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare

from tidegrid.llm import catalogue, collocations, html_text, lexical, pii

SF = "/root/testdata/sf0.001"


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    ]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice(rng.choice(["ab@.", "12.", "+1 (2)-", "0 -4", "a_@.-%+é\n"])) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_take_time_in_proportion():
    for unit in ("a", "1", "a@", "1.", "1 ", "+1 ", "a@b."):
        pii.base_spans(unit * (400_000 // len(unit)))


def test_op11_gives_the_contract(spark):
    got = catalogue.QUERIES["op11_pii"](spark, SF).collect()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = brute_spans(r["text"] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, spans) for a, b in own)
        want.append((r["doc_id"], *map(len, spans), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((r["doc_id"], *(r[f"n_{k}"] for k in pii.KINDS), r["base_sha256"]) for r in got) == sorted(want)
    for r in got:
        spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans) and len(spans) == sum(r[f"n_{k}"] for k in pii.KINDS) + r["n_added"]


def test_labels_spread_to_similar_tokens(spark):
    w = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    text = "Call +1 (988) 555-2485 today; from abroad 988-555-2485 too, room 1204 in 1999."
    base = [pii.base_spans(text)]
    added = pii.added_spans([text], base, w, sure=0.5)
    assert [[text[a:b] for a, b in own] for own in added[0]] == [[], [], [], ["988-555-2485"]]
    field = pii.Field([text], base)
    p = pii.marginals(field, w)
    assert np.allclose(p.sum(axis=1), 1)
    no_skip = pii.marginals(field, w._replace(skip=np.zeros_like(w.skip)))
    at = [text[a:b] for _, a, b in field.places].index("988-555-2485")
    assert no_skip[at, 4] < p[at, 4]


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(2)
    field = pii.Field(["1 22 333 4444"], [[[], [], [], []]])
    w = pii.Weights(rng.normal(size=(pii.FORMS, pii.N)), rng.normal(size=(pii.N, pii.N)), rng.normal(size=(2, pii.N)), np.zeros((2, pii.N)))
    node = field.forms @ w.form
    node[0] += w.open[0]
    node[-1] += w.open[1]
    want = np.zeros((4, pii.N))
    for labels in np.ndindex(*[pii.N] * 4):
        weight = math.exp(sum(node[k, y] for k, y in enumerate(labels)) + sum(w.chain[a, b] for a, b in zip(labels, labels[1:])))
        for k, y in enumerate(labels):
            want[k, y] += weight
    assert np.allclose(pii.marginals(field, w), want / want.sum(axis=1, keepdims=True), atol=0.02)


def test_pii_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, 5, "x"), (None, "", 6, "y"), (2, "a@b.co " * 5000, 7, "z"), (2, "a@b.co " * 5000, 7, "z")], "doc_id long, text string, base long, added string")
    got = sorted(pii.personal_data(odd).collect(), key=lambda r: (r["doc_id"] or 0))
    assert [(r["doc_id"], len(r["base"])) for r in got] == [(None, 0), (1, 0), (2, 5000), (2, 5000)]
    assert pii.personal_data(odd.limit(0)).collect() == []


# --- collocations


def brute_collocations(rows, least, top, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in cands.items():
        for k in range(2, len(words)):
            gone |= {(lang, words[i : i + k]) for i in range(len(words) - k + 1) if 100 * a >= 80 * f[lang, words[i : i + k]]}
    out = []
    for (lang, words), a in cands.items():
        if (lang, words) not in gone:
            score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    out.sort()
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


@pytest.mark.parametrize("least,bits", [(3, 16), (300, 16), (3, 19)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, bits):
    monkeypatch.setattr(collocations, "LEAST_BITS", bits)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["É", "a\x0bb", "New", "york", " "]
    weights = [1 / (1 + k) for k in range(len(words))]
    text = lambda n: "".join(rng.choice((" ", "  ", "\t", ". ", "\n", ", ", " ", " ")) + w for w in rng.choices(words, weights, k=n))
    rows = [(text(rng.randint(0, 120)), rng.choice(("en", "fr", None, "und"))) for _ in range(400)] + [(None, "en"), ("", None), ("a b " * 3000, "de"), ("a b " * 3000, "de")]
    df = spark.createDataFrame([(t, x, k, "q") for k, (t, x) in enumerate(rows)], "text string, lang string, a long, phrase string")
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=50).collect())
    assert got == sorted(brute_collocations(rows, least, 50)) and got


def test_sketches_keep_all_that_is_frequent(spark):
    rows = [(" ".join(f"w{k % 977} v{k % 31}" for k in range(n, n + 900)), "en") for n in range(0, 60_000, 900)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    bits = collocations.frequent_bits(df, 30, 2, 16)
    words = collocations.Words([t.encode() for t, _ in rows], ["en"] * len(rows))
    for size in (1, 2):
        grams, whole = words.grams(size)
        found, counts = np.unique(grams[whole], return_counts=True)
        for line, at in zip(bits, collocations.places(found[counts >= 30], 16)):
            at = at.astype(np.int64)
            assert ((line[at >> 3] >> (7 - (at & 7))) & 1).all()


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


# --- ranked search


def brute_search(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: pattern.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, df = sum(n for _, _, n in bags), Counter()
    for _, b, _ in bags:
        df.update(b.keys())
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, b, n in bags:
            m = 25 + 75 * n * len(bags) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 5)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 7)
    rng = random.Random(9)
    words = [f"t{k}" for k in range(300)]
    weights = [1 / (1 + k) for k in range(300)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(k, text(rng.randint(1, 60))) for k in range(300)] + [(k, "t250 T250, é") for k in range(300, 330)]
    docs += [(7, docs[7][1]), (None, "t299 t1"), (400, None), (401, "..."), (402, "t5 " * 5000)]
    items = [(k, text(rng.randint(1, 25))) for k in range(20)] + [(20, "t250"), (21, None), (22, "!!"), (23, "unknown"), (20, "t250"), (20, "É é"), (None, "t299")]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score long, block string")
    index = lexical.Index(table.repartition(3))
    got = lexical.search(index, spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items)


def test_search_prunes_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    docs = [(k, f"common w{k} w{k} u{k % 7}") for k in range(400)]
    index = lexical.Index(spark.createDataFrame(docs, "doc_id long, text string"))
    group = lexical.Group([(0, lexical.terms_of(["w5 common"])[0])])
    group.weigh(lexical.document_counts(index, group), index.n)
    bounds = {r["block"]: r["bound"] for r in lexical.block_bounds(index, group).collect()}
    best = lexical.search(index, spark.createDataFrame([(0, "w5 common")], "item_id long, text string"), k=1).collect()
    assert best[0]["doc_id"] == 5 and sum(b >= best[0]["score"] for b in bounds.values()) == 1


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(lexical.Index(none), items).collect() == []
    assert lexical.search(lexical.Index(some), items.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(collocations.QUERIES | lexical.QUERIES))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


# --- broken pages


def test_no_page_fails():
    rng = random.Random(5)
    bits = "<p> </p> <![ <![ [ ] > < \" ' & &# x; <a href= word <!-- --> <script> </script> <article> </article> <div_class='ad'> <? é <title> / <!doctype CDATA[".split()
    for _ in range(10_000):
        html_text.main_text("".join(rng.choice(bits).replace("_", " ") for _ in range(rng.randint(1, 60))))


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>array<![0]</p>", "array"), ("<p>x <![foo[bar]]> y</p>", "x y"), ("<p>a</p><![ x", "a"), ("<p>one & two &lt", "one & two <"), ("<p>a</p>tail <b", "a\ntail"),
        ('<p>x<a href="foo>bar</p><p>more</p>', "xbar\nmore"), ("<p>a<!-- never", "a"), ("x <", "x <"), ("<script>x", ""),
    ],
)
def test_broken_markup(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("unit", ["<a ", '<a b="', "<![", "<!--", "<p>x", "&#", "</p", "<a/", "<script>"])
def test_broken_pages_take_time_in_proportion(unit):
    html_text.main_text(unit * (300_000 // len(unit)))
    html_text.main_text(unit * (300_000 // len(unit)) + ">")
