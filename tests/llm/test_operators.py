"""The training-data operators against brute force, round trips and held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import bpe, catalogue, chat, compression, decontamination, html_text, licenses, merkle, neardup, quality, sharding, shingles, toxicity

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}


# --- near duplicates


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, texts):
    rng = random.Random(3)
    more = dict(texts)
    base = " ".join(f"w{rng.randint(0, 999)}" for _ in range(150)).split()
    for k in range(60):  # a group of near copies, many of them further apart than the threshold
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        more[10_000 + k] = " ".join(words)
    more |= {20_000: None, 20_001: "  ", 20_002: "One two", 20_003: "one TWO", 20_004: "a b b a", 20_005: "b a a b"}
    got = neardup.near_duplicates(docs(spark, list(more.items())), words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(more, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_representatives(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long), (2, long), (3, long + " end"), (5, "other text"), (5, "other text"), (None, long), (7, None)]
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.representatives(docs(spark, rows)).collect()), key=str)
    assert left == sorted([(1, long), (5, "other text"), (None, long), (7, None)], key=str)


def test_mirrored_shingles_differ():
    words = shingles.texts_words(["the and and the"])[0], shingles.texts_words(["and the the and"])[0]
    assert shingles.shingle_set(words[0], 4) != shingles.shingle_set(words[1], 4)


# --- decontamination


def test_overlaps_survive_substitutions(spark):
    rng = random.Random(4)
    items = [[f"i{k}w{j}" for j in range(rng.choice((6, 15, 40, 300)))] for k in range(25)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows, want = [], {}
    for n in range(60):
        words, k = [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 80))], rng.randrange(25)
        if n % 3:
            part = list(items[k])
            for at in range(4, len(part), 7):  # one word of seven replaced
                part[at] = "other"
            equal = sum(a == b for a, b in zip(part, items[k]))
            if equal >= min(8, len(part)):
                want[n] = k
            spot = rng.randint(0, len(words))
            words[spot:spot] = [w.upper() + "," for w in part]
        rows.append((n, " ".join(words)))
    got = decontamination.overlaps(docs(spark, rows), bench).collect()
    assert {r["doc_id"]: r["item_id"] for r in got} == want and len(got) == len(want)
    kept = {r["doc_id"] for r in decontamination.clean(docs(spark, rows), bench).collect()}
    assert kept == set(range(60)) - set(want)


def test_segments_of_any_form_equal_brute_force():
    rng, least = random.Random(8), 8
    forms = ["111011101111", "11111100111111", "11111110001111111", "1" * 8 + "0" * 9 + "1" * 8, "11110111101111", "0011111111", "1111111", "11111101"]
    for n in (9, 12, 15, 20, 30, 60):
        for _ in range(120):
            bad = set(rng.sample(range(n), rng.randint(0, n // 5 + 1)))
            forms.append("".join("01"[k not in bad] for k in range(n)))
            at, m = rng.randrange(n), rng.randint(0, n // 5 + 1)  # substitutions in one run
            forms.append("".join("10"[at <= k < at + m] for k in range(n)))
    for form in forms:
        item = [f"i{k}" for k in range(len(form))]
        said = [w if c == "1" else f"x{k}" for k, (w, c) in enumerate(zip(item, form))]
        cut = rng.choice((0, 0, 1, 2))
        before = [f"b{k}" for k in range(rng.choice((0, 3)))]
        form, said = form[cut:], before + said[cut:]
        spans = [(form[a:b].count("1"), a - b, -b) for a in range(len(form)) for b in range(a + 1, len(form) + 1) if form[a] + form[b - 1] == "11"]
        good = [x for x in spans if x[0] >= min(least, len(item)) and 5 * (-x[1] - x[0]) <= -x[1]]
        words, starts = decontamination.joined([" ".join(item)])
        got = np.array(decontamination.Block(np.array([1]), words, starts, least).overlaps(*decontamination.joined(["none", " ".join(said)]))).T.tolist()
        if good:
            matched, length, stop = max(good)
            assert got == [[1, 0, matched, -length, len(before) - stop + length, cut - stop + length]], form
        else:
            assert got == [], form


def test_items_of_few_words_are_found_whole(spark):
    items = {1: "a", 2: "b c", 3: "a b c", 4: "c a b d", 5: "b c", 6: "", 7: "d e f g h"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rng = random.Random(9)
    texts = {n: " ".join(rng.choice("abcdxyz") for _ in range(rng.randint(0, 12))) for n in range(80)} | {80: "b", 81: "d e f g h", 82: "A, B"}
    want = {(n, k) for n, t in texts.items() for k, x in items.items() if x and f" {x} " in f" {t.lower().replace(',', '')} "}
    got = decontamination.overlaps(docs(spark, list(texts.items())), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and all(r["item_share"] == 1 for r in got)
    kept = {r["doc_id"] for r in decontamination.clean(docs(spark, list(texts.items())), bench).collect()}
    assert kept == set(texts) - {n for n, _ in want}


def test_long_items_are_verified_in_bounded_portions(monkeypatch):
    rng = random.Random(10)
    items = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in (200_000, 30, 9)]
    words, starts = decontamination.joined(items)
    block = decontamination.Block(np.arange(3), words, starts, 8)
    long = items[0].split()
    for at in range(3, len(long), 6):
        long[at] = "other"
    texts = [" ".join(long), items[1], f"{items[2]} {items[1]}", "none of it"]
    sizes, segments = [], decontamination.Block._segments
    monkeypatch.setattr(decontamination.Block, "_segments", lambda self, *a: [sizes.append((len(a[-1]), int(a[-1].sum()))), segments(self, *a)][1])
    got = np.array(block.overlaps(*decontamination.joined(texts))).T.tolist()
    assert {(t, i) for t, i, *_ in got} == {(0, 0), (1, 1), (2, 1), (2, 2)}
    assert max(x[2] for x in got) == sum(w != "other" for w in long) and all(n == 1 or total <= decontamination.CELLS for n, total in sizes)


def test_overlaps_find_whole_items_as_brute_force_does(spark, texts):
    norm = lambda t: " " + re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t).strip() + " "
    items = {r["item_id"]: norm(r["text"].lower()) for r in table(spark, "benchmark").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in norm(t.lower())}
    got = decontamination.op6_decontamination(spark, SF).where("item_share = 1").collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got} == want


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    whole = sorted(map(tuple, decontamination.op6_decontamination(spark, SF).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, decontamination.op6_decontamination(spark, SF).collect())) == whole


# --- byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_own():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(tiktoken_own, texts):
    encoder, rng = bpe.Encoder(bpe.vocabulary(bpe.VOCABULARY)), random.Random(5)
    letters = "aab  \n\t\r'sé中國日本語😀\x1c​zZ09½_-!<|endoftext|>the ing"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["x" * 5000, "ab " * 90_000, "", " ", "\n\n", "thing " * 3]
    for t in [*made, *texts.values()]:
        ids = encoder(t)
        assert ids.tolist() == tiktoken_own.encode_ordinary(t)
        assert bpe.decode_ids(encoder.words, ids) == t.encode()


def test_prefix_tables_take_appends_and_edits():
    words, rng = bpe.vocabulary(bpe.VOCABULARY), random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"abcdething lyon") for _ in range(rng.randint(1, 90)))
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new = bytes(rng.choice(b"abthing") for _ in range(rng.randint(0, 8)))
        table_ = bpe.Prefixes(words, data)
        table_.replace(a, b, new)
        assert table_.last == bpe.Prefixes(words, data[:a] + new + data[b:]).last
        table_.append(b"ing on")
        assert b"".join(table_.tokens()) == data[:a] + new + data[b:] + b"ing on"
        assert table_.tokens() == words.merged(table_.data) if len(table_.data) < 60 else True


def test_op9(spark, tiktoken_own, texts):
    for r in bpe.op9_byte_bpe(spark, SF).collect():
        ids = tiktoken_own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    enc = bpe.encode(docs(spark, [(1, "one two"), (2, None)]), ["doc_id"])
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(enc, ["doc_id"]).collect()} == {1: b"one two", 2: b""}


# --- chat


def test_escapes_are_reversible():
    rng = random.Random(7)
    parts = ["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "x", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        e = chat.escape(pa.array([t]))[0].as_py()
        assert chat.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", e)


def test_op8_reads_back_what_was_said(spark):
    rows = defaultdict(list)
    for r in table(spark, "conversations").collect():
        rows[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    rows[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in chat.op8_chat_formatting(spark, SF).collect()}
    assert set(got) == set(rows)
    for k, v in rows.items():
        v.sort()
        turns = "".join(f"{role}\n{text}\n" for _, role, text in v)
        loss = "".join(text for _, role, text in v if role == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"]) == (len(v), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "a\nb\\", "<|im_end|>\n", "x"), (None, None, "user", "hi", "x"), (2, 0, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    turns = [chat.read_turn(r["formatted"]) for r in chat.format_turns(df).orderBy("conv_id", "turn").collect()]
    assert turns == [("user", "hi"), ("", ""), ("a\nb\\", "<|im_end|>\n"), ("assistant", "")]
    assert {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_turns(df)).collect()} == {None: 1, 1: 2, 2: 1}
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# --- Merkle fingerprints


M64 = (1 << 64) - 1


def slow_mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def slow_tree(text):
    """root, sections of (hash, paragraphs of (hash, phrases)), phrase by phrase, all as hex."""
    def blake(kind, data):
        return hashlib.blake2b(bytes([kind]) + data, digest_size=16).digest()

    sections, new = [], True
    for line in text.encode().split(b"\n") if text else []:
        words = [slow_mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) & M64) for w in re.findall(rb"[^ \t-\r]+", line)]
        phrases, part = [], []
        for k, w in enumerate(words):
            part.append(w)
            if len(part) >= 3 and w % 4 == 0 or len(part) == 32 or k == len(words) - 1:
                phrases.append(slow_mix(sum(w * (2 * n + 1) for n, w in enumerate(part)) & M64).to_bytes(8, "little")[:3].hex())
                part = []
        leaf = blake(0, line)
        if new:
            sections.append([])
        sections[-1].append((leaf, phrases))
        new = leaf[0] % 4 == 0 or not line.strip()
    hashes = [blake(1, b"".join(h for h, _ in s)) for s in sections]
    return blake(2, b"".join(hashes)).hex(), [(h[:6].hex(), [(p[:6].hex(), q) for p, q in s]) for h, s in zip(hashes, sections)]


def slow_aligned(x, y):
    """Pairs of places: both ends while equal, then the longest chain of pairs of k-th with k-th."""
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    m = 0
    while m < min(len(x), len(y)) - n and x[len(x) - 1 - m] == y[len(y) - 1 - m]:
        m += 1
    number = lambda v: [(w, v[:k].count(w)) for k, w in enumerate(v)]
    a, b = number(x[n : len(x) - m]), number(y[n : len(y) - m])
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if w in b]
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] = 1 + max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return n + m + max(best, default=0)


def test_alignment_equals_brute_force():
    rng = random.Random(12)
    for _ in range(3000):
        x, y = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 12))] for _ in "xy")
        got = merkle.aligned(x, y)
        assert len(got) == slow_aligned(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


def test_fingerprints_of_many_short_lines_are_bounded():
    rng = random.Random(5)
    letters = [rng.choice("abcdefghijklmnop") for _ in range(20_000)]
    texts = ["\n" * 300_000, "\n".join(letters), "\n\n".join(letters), "a\n\n" * 20_000, "a\nb\n" * 20_000, "same line of words\n" * 20_000, "\n", "a", " \n\t\n" * 5_000]
    for text in texts:
        tree = merkle.Tree(text)
        mark = tree.fingerprint()
        assert merkle.branches_of(mark) == tree.branches and len(mark) < 14 * (len(text.encode()) + 1) + 33
        assert merkle.likeness(mark, merkle.Tree(text + "x").fingerprint()) < 1
    assert len(merkle.Tree(texts[0]).fingerprint()) < 64 and len(merkle.Tree(texts[5]).fingerprint()) < 200


def test_op5_equals_brute_force(spark, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in merkle.op5_merkle_fingerprints(spark, SF).collect()}
    assert set(got) == set(ids)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        cut = len(texts[a]) // 4
        edited = texts[a][: len(texts[a]) - cut] + texts[b][:cut]
        r = got[a]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(texts[a])
        trees = {}
        for fingerprint, text in ((r["fingerprint"], texts[a]), (r["edited_fingerprint"], edited), (got[b]["fingerprint"], texts[b])):
            root, sections = slow_tree(text)
            assert fingerprint.partition(":")[0] == root
            read = [(h.hex(), [(p.hex(), [q[k : k + 3].hex() for k in range(0, len(q), 3)]) for p, q in s]) for h, s in merkle.branches_of(fingerprint)]
            assert read == sections
            trees[fingerprint] = sections
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == merkle.likeness(r["fingerprint"], got[b]["fingerprint"])
        size = lambda t: sum(1 + len(q) for _, s in t for _, q in s)
        flat = lambda t: [p for _, s in t for p, _ in s]
        one, other = trees[r["fingerprint"]], trees[r["edited_fingerprint"]]
        if len(one) == len(other) == 1 and len(flat(one)) == len(flat(other)) == 1:  # one paragraph each: the phrases decide
            want = slow_aligned(one[0][1][0][1], other[0][1][0][1]) / max(size(one), size(other))
            assert r["near_edited"] == (1 if one == other else want)
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] < 1) == (edited != texts[a])
    assert len({r["fingerprint"] for r in got.values()}) == len(set(texts.values()))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6 > 0.1 > np.mean([r["near_next"] for r in got.values()])


def test_edits_are_located():
    lines = [f"line {i} of the text with some words" for i in range(40)]
    other = [*lines[:17], "another line", *lines[18:]]
    a, b = merkle.Tree("\n".join(lines)), merkle.Tree("\n".join(other))
    found = [a.branches[i][1][j][0] for i, j in merkle.edits(a.branches, b.branches)]
    assert found == [merkle.digest(merkle.LEAF, lines[17].encode())[:6]] and merkle.edits(a.branches, a.branches) == []
    assert 0.9 < merkle.ratio(a.branches, b.branches) < 1
    moved = merkle.Tree("\n".join(lines[20:] + lines[:20]))
    assert moved.root != a.root and 0.4 < merkle.ratio(a.branches, moved.branches) < 0.6
    swapped = merkle.Tree("\n".join([*lines[:10], lines[11], lines[10], *lines[12:]]))
    assert 0.9 < merkle.ratio(a.branches, swapped.branches) < 1


@pytest.mark.parametrize("hot", [None, 5])
def test_ids_that_fill_ranges_are_dealt_into_them(spark, hot):
    rng = random.Random(13)
    rows = [(hot if k % 3 else k, f"text {rng.randint(0, 10**9)}") for k in range(600)]
    got = [(r["doc_id"], r["near_next"], r["fingerprint"]) for r in merkle.fingerprints(docs(spark, rows)).collect()]
    assert sorted(x[2] for x in got) == sorted(merkle.Tree(t).fingerprint() for _, t in rows)
    dealt = merkle.neighbours(docs(spark, rows), 12).where("NOT borrowed").groupBy("range").count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 200
    order = merkle.neighbours(docs(spark, rows), 12).orderBy("range", "borrowed", "key", "tie", "text").collect()
    own = [(r["key"], r["tie"]) for r in order if not r["borrowed"]]
    assert own == sorted(own)
    ends = {r["range"]: (r["key"], r["tie"]) for r in order if r["borrowed"]}
    firsts = {}
    for r in order:
        firsts.setdefault(r["range"], (r["key"], r["tie"]))
    places = sorted(firsts)
    assert ends == {a: firsts[b] for a, b in zip(places, places[1:] + places[:1])}


def test_fingerprint_edges(spark):
    out = {r["doc_id"]: r for r in merkle.fingerprints(docs(spark, [(1, None), (2, ""), (None, "x y"), (3, "a b c d e f g h")])).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] and out[1]["near_next"] == 1.0 and out[2]["near_next"] == 0.0
    assert merkle.fingerprints(docs(spark, [])).count() == 0
    one = merkle.fingerprints(docs(spark, [(9, "only one text here")])).first()
    assert one["near_next"] == 1.0


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>The  title</h1><p>First &amp; longest paragraph of the article, with
 many words in it so that its ratio is high.<p><b>Short.<br>line</b><ul><li>An item<li>Another &eacute;</ul>
<aside>Aside</aside><form><p>Log in</p></form><div class="comments"><p>I, a reader, disagree at length with all of this.</p></div></article>
<section id="comments"><article class="comment"><p>Another reader has a very long comment on all that was said above.</p></article></section>
<div class="sidebar"><p>Related reading that goes on for a while as well</p></div><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The title\nFirst & longest paragraph of the article, with many words in it so that its ratio is high.\nShort. line\nAn item\nAnother é"
    plain = "<div id='main-content'><h2>Head</h2><p>Some long text of a page without an article element, as there are many.</p><p>End</p></div><div class='footer'>f</div>"
    assert html_text.main_text(plain) == "Head\nSome long text of a page without an article element, as there are many.\nEnd"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<nav><a>only a menu</a></nav>", "&lt;p&gt;")] == ["", "", "", "", "<p>"]
    long = "<article>" + "".join(f"<p>para {i} with words" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999


BODY = "<p>First and longest paragraph of the article, with many words in it so that its ratio is high.</p><p>End.</p>"
TOLD = "First and longest paragraph of the article, with many words in it so that its ratio is high.\nEnd."
TEASER = "<p>A teaser of another article that goes on for quite a while, as these do.</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="layout has-sidebar"><article>{BODY}</article></div>', TOLD),
        (f'<div id="no-sidebar"><article>{BODY}</article></div>', TOLD),
        (f'<div class="layout has-sidebar"><div class="text">{BODY}</div></div>', TOLD),
        (f'<div class="sidebar-layout"><main>{BODY}</main></div><div class="sidebar">{TEASER}</div>', TOLD),
        (f'<main><div class="share-wrapper"><article>{BODY}<div class="share"><p>Share this</p></div></article></div></main>', TOLD),
        (f'<div id="notice"><p>Line</p><article>{BODY}</article></div><p>A tagline of the page</p>', TOLD),
        (f'<article>{BODY}</article><div class="sidebar"><article>{TEASER}</article></div><div class="related-posts"><article>{TEASER}</article></div>', TOLD),
        (f'<article><div class="post-header"><h1>Title</h1></div><div class="header"><p>By one</p></div>{BODY}</article>', f"Title\nBy one\n{TOLD}"),
        (f'<div class="entry-header"><h1>Title</h1></div><div class="text">{BODY}</div><div class="site-header">{TEASER}</div>', f"Title\n{TOLD}"),
        (f'<aside><article>{BODY}</article></aside>', ""),
        (f'<div class="comments-area"><article class="comment">{BODY}</article></div>', ""),
        (f'<div class="site-footer">{BODY}</div>', ""),
    ],
)
def test_articles_in_named_layouts_stay(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == want


LONG = [f"Sentence {k} of the text says one thing after another, as the sentences of long texts do, and then it ends." for k in range(4)]
SHORT = ["Well.", "A short one."]
PARAS = [LONG[0], SHORT[0], LONG[1], LONG[2], SHORT[1], LONG[3]]
LINKS = "".join(f'<a href="/{w}">{w}</a>' for w in ("Home", "News", "Sport", "About"))
ITEMS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "About"))
P = "".join(f"<p>{x}</p>" for x in PARAS)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div>{LINKS}</div><div>{P}</div><div>Copyright</div>", PARAS),
        (f"<div><a href='/'>Home</a></div><div><a href='/n'>News</a></div><div><h1>Head</h1>{P}</div><div>Copyright 2020</div>", ["Head", *PARAS]),
        (f"<ul>{ITEMS}</ul><section><h2>Head</h2>{P}</section><ul>{ITEMS}</ul>", ["Head", *PARAS]),
        (f"<table><tr><td><ul>{ITEMS}</ul></td><td>{P}</td><td>Buy now!</td></tr></table>", PARAS),
        (f"<table><tr><td>{LINKS}</td></tr><tr><td><table><tr><td>{P}</td></tr></table></td></tr><tr><td>All rights reserved</td></tr></table>", PARAS),
        (f"<h1>Title</h1><div>{LINKS}</div><div><div>{P}</div></div>", ["Title", *PARAS]),
        (f"<center>{LINKS}</center>{P}<center>{LINKS}</center>", PARAS),
        (f"<div class='a'>{LINKS}</div><div class='b'><div>{''.join(f'<div>{x}</div>' for x in PARAS)}</div></div><div class='c'>Imprint</div>", PARAS),
        (f"<div>{''.join(f'<p>{x}</p>' for x in PARAS[:3])}<ul>{ITEMS}</ul>{''.join(f'<p>{x}</p>' for x in PARAS[3:])}</div><div>Imprint</div>", PARAS),
        (f"<div><p class='share-price'>{LONG[0]}</p>{P}</div><div class='alert alert-info'><p>{LONG[1]}</p></div>", [LONG[0], *PARAS]),
        (f"<article><p class='share-price'>{LONG[0]}</p>{P}<div class='alert alert-info'><p>{LONG[1]}</p></div></article>", [LONG[0], *PARAS]),
        (f"<div>{LINKS}</div><blockquote>{LONG[0]}</blockquote><pre>{LONG[1]}</pre>", LONG[:2]),
        (f"<dl>{''.join(f'<dt>Term<dd>{x}' for x in LONG)}</dl><div>{LINKS}</div>", [x for k in LONG for x in ("Term", k)]),
        (f"<div><div class='footer-links'>{LINKS}</div><div>{P}</div><form><p>{LONG[0]}</p></form></div>", PARAS),
        (f"<main><nav>{LINKS}</nav><h1>Head</h1><p>Short.</p></main>", ["Head", "Short."]),
    ],
)
def test_texts_of_pages_of_many_layouts(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == want


def articles(page):
    import html as H

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_ratios_decide(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub("<(/?)(article|nav|footer)>", r"<\1div>", x).replace(' class="ad"', "") for x in pages]  # no name says what is what
    want = list(map(articles, pages))
    right = lambda pages: np.mean([html_text.main_text(x) == w for x, w in zip(pages, want)])
    assert right(pages) == 1 and right(bare) > 0.8
    rng = np.random.default_rng(15)
    monkeypatch.setattr(html_text, "ratios", lambda lines, out: rng.exponential(size=len(lines)))
    assert right(bare) < 0.7 and right(pages) < 1
    monkeypatch.setattr(html_text, "ratios", lambda lines, out: np.zeros(len(lines)))
    assert not any(map(html_text.main_text, pages))


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    for n in (10_000, 100_000):
        tracemalloc.start()
        assert html_text.main_text("<div>" * n + f"<p>{LONG[0]}</p>" + "</div>" * n + "</section>" * n + "<svg>" * 1000 + "<hr>" * n) == LONG[0]
        assert tracemalloc.get_traced_memory()[1] < 2_000 * n
        tracemalloc.stop()


def test_articles_of_pages_are_whole(spark):
    import html as H

    for r in html_text.op4_html_extraction(spark, SF).join(table(spark, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- classifiers


def auc(y, s):
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    pos = y.sum()
    return (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize(("module", "column", "mod", "out", "least"), [(toxicity, "toxic", 4, 2, 0.9), (quality, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, module, column, mod, out, least):
    d = "/root/testdata/sf0.1"
    f = next(iter(module.QUERIES.values()))
    got = f(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert ((got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % mod) == out) == got["held_out"]).all()
    test = got[got["held_out"]]
    assert test["score"].between(0, 1).all() and ((test["score"] >= 0.3) == (test["predicted"] == 1)).all()
    assert auc(test[column].to_numpy(), test["score"].to_numpy()) > least


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    d, labels = table(spark, "documents"), table(spark, "labels")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.toxicity_model(d, labels), toxicity.toxicity_model(d, other)
    assert a.positive == b.positive and np.array_equal(a.weights, b.weights)


def test_repeated_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    texts = [(i, f"words of text {i} that is told apart " * 5) for i in range(40)]
    more = [(3, f"copy {k}") for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    sizes, collect = [], type(labels).toArrow
    monkeypatch.setattr(type(labels), "toArrow", lambda df: [t := collect(df), sizes.append(t.num_rows)][0])
    quality.quality_model(docs(spark, texts), labels)
    quality.quality_model(docs(spark, texts + more), labels)
    assert sizes[0] == sizes[1] <= 40


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    rows = docs(spark, [(1, None), (2, ""), (None, "words"), (3, "x" * 100_000)])
    model = toxicity.toxicity_model(rows, none)
    assert [r["score"] for r in compression.scored(rows, model).collect()] == [0.5] * 4
    one = spark.createDataFrame([(3, 1, 1), (4, 1, 1), (None, 0, 0), (5, 7, 7)], "doc_id long, toxic int, quality int")
    assert all(0 <= r["score"] <= 1 for r in compression.scored(rows, quality.quality_model(rows, one)).collect())
    assert compression.scored(rows.limit(0), model).count() == 0


# --- licences and shards


def test_licenses_equal_brute_force(spark, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in licenses.op1_license_scan(spark, SF).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "Redistribution and use in source and binary forms",
    "Neither the name of the holder nor others may be used to endorse or promote",
    "See the License for the specific language governing permissions and limitations under the License",
    "This program is free software; you can redistribute it and/or modify",
    "This Source Code Form is subject to the terms of the Mozilla Public",
    "This is free and unencumbered software released into the public domain",
    "Altered source versions must be plainly marked",
    "distributed under the Boost Software License",
    "placed in the public domain",
    "All rights reserved",
    "GNU GPL",
    "Creative Commons",
    "MIT No Attribution License",
    "GNU General Public License as published by the Free Software Foundation, either version 3",
    "Creative Commons Attribution ShareAlike 4.0",
    "CC BY 4.0",
]


@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\r\n\t", "\u00a0", " \n "])
def test_gated_rules_find_what_all_rules_find_in_wrapped_texts(gap):
    scanner = licenses.Scanner()
    for notice in NOTICES:
        text = "Some words. " + notice.replace(" ", gap) + " and more."
        whole = scanner.detections(licenses.Spaced(text.lower()), set(scanner.of_key))
        labels, score, found = scanner.scan(text)[3:]
        assert {x[4] for x in found} == {x[4] for x in scanner.scan(notice)[5]}
        assert found == whole and found and {x[4] for x in found} <= labels and score >= max(x[5] for x in found), notice


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
        ("GNU Lesser General Public License, version 2", "gpl,lgpl-2.0"),
        ("the GNU Affero General Public License v3 applies", "agpl-3.0,gpl"),
        ("GNU General Public License v3", "gpl,gpl-3.0"),
        ("see https://opensource.org/licenses/mit-0 for more", "mit-0"),
        ("see https://opensource.org/licenses/MIT.", "mit"),
        ("see http://www.apache.org/licenses/LICENSE-2.0.html", "apache-2.0"),
        ("licensed under the MIT No Attribution License", "mit-0"),
        ("released under the Unlicense", "unlicense"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("BSD 3-Clause License", "bsd-3-clause"),
        ("license: 'mpl-2.0'", "mpl-2.0"),
        ("nothing of the kind; submit licenses elsewhere", ""),
    ],
)
def test_license_labels(text, labels):
    n_words, words, base, found, score, detections = licenses.Scanner().scan(text)
    assert ",".join(sorted(found)) == labels and (score > 0) == bool(labels)
    assert all(text[x[2] : x[3]].strip() for x in detections)


def test_suppression_equals_brute_force():
    rng = random.Random(14)
    for _ in range(2000):
        found = []
        for k in range(rng.randint(0, 9)):
            a = rng.randint(0, 8)
            found.append((rng.randint(1, 4), k, a, a + rng.randint(1, 8), "x", 1.0))
        beats = lambda y, x: y[2] <= x[2] and x[3] <= y[3] and (y[0] < x[0] or y[0] == x[0] and (y[2:4] != x[2:4] or y[1] < x[1]))
        assert sorted(licenses.resolve(found)) == sorted(x for x in found if not any(beats(y, x) for y in found))


def test_keywords_and_heads_are_in_what_their_rules_match():
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    for rule in licenses.rules():
        core = re.sub(r"\(\?<?!(?:[^()]|\\.)*\)", "", rule.pattern.replace(r"(?!\w|-\w)", ""))

        @settings(max_examples=8, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(core, fullmatch=True, alphabet=st.characters(codec="ascii")))
        def holds(text):
            text = licenses.GAPS.sub(" ", text.lower())
            if m := re.search(rule.pattern, text):  # noqa: B023
                assert rule.keyword in m[0] and (rule.head is None or re.match(rule.head, m[0])), rule  # noqa: B023

        holds()


def test_long_license_texts_take_time_in_proportion():
    import time

    scanner, took = licenses.Scanner(), []
    lines = ["Licensed under the Apache License, Version 2.0", "MIT License", "GNU General Public License v3", "SPDX-License-Identifier: MIT", "All rights reserved"]
    for n in (4_000, 32_000):
        text, start = "\n".join(lines * (n // 5)), time.process_time()
        assert len(scanner.scan(text)[5]) >= n - n // 5
        took.append(time.process_time() - start)
    assert took[1] < 8 * 2.5 * took[0]


def test_places_in_wrapped_texts():
    text = "x  MIT \r\n\r\n License and\n\nthe   GNU\tGPL"
    found = licenses.Scanner().scan(text)[5]
    assert [" ".join(text[x[2] : x[3]].split()) for x in found] == ["MIT License", "GNU GPL"]


def test_shards_are_whole_and_grow_into_the_new_one(spark, texts):
    got = sharding.op2_rendezvous_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in got)
    for shard, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    copies = sharding.shard(docs(spark, [(1, "a")] * 5 + [(2, None), (None, "x")]), [1.0, 2.0]).collect()
    assert len(copies) == 7 and sorted(r["slot"] for r in copies if r["doc_id"] == 1) == sorted({r["slot"] for r in copies if r["doc_id"] == 1})


@pytest.mark.parametrize("bits", [1, 3, None])
def test_shards_and_slots_equal_brute_force(spark, texts, bits):
    from pyspark.sql import functions as F

    weights = [1.0, 2.5, 0.5]
    rows = [*texts.items(), (1, texts[min(texts)]), (None, "x"), (None, None)]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))
    hashes = docs(spark, rows).select("doc_id", "text", *[F.xxhash64(F.lit(5), key, F.lit(s)).alias(f"h{s}") for s in range(4)]).collect()
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("crc")
    order = {(r[0], r[1], r[2]): r[3] % (1 << 64) for r in docs(spark, rows).select("doc_id", size, crc).select("*", F.xxhash64(F.lit(6), "doc_id", "size", "crc")).collect()}
    best = lambda r, w: min(range(len(w)), key=lambda s: (-np.log(((r[f"h{s}"] % (1 << 64) >> 11) + 0.5) / (1 << 53)) / w[s], s))
    want = defaultdict(list)
    for r in hashes:
        data = (r["text"] or "").encode()
        want[best(r, weights)].append((order[r["doc_id"], len(data) + 8, zlib.crc32(data)], r["doc_id"], len(data) + 8, zlib.crc32(data), best(r, [*weights, weights[-1]])))
    expected = sorted(((x[1], x[2], x[3], s, k, x[4]) for s, v in want.items() for k, x in enumerate(sorted(v, key=lambda x: x[0]))), key=str)
    got = sharding.shard(docs(spark, rows), weights, seed=5, range_bits=bits).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["grown_shard"]) for r in got), key=str) == expected


def test_long_segments_are_copied_whole():
    values = pa.array(["a" * 5000, "", None, "bc", "é" * 9000])
    got, sizes = chat.assemble([b"<", chat.escape(values), b">"])
    assert got.to_pylist() == [f"<{v or ''}>" for v in values.to_pylist()] and sizes[1].tolist() == [5000, 0, 0, 2, 18000]


# --- all of them


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_on_odd_tables(spark, name, tmp_path):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names; then empty tables."""
    from pyspark.sql import functions as F

    text = "some words of a text that stand here and there " * 3
    for tag, n in (("odd", None), ("empty", 0)):
        d = f"{tmp_path}/{tag}"
        rows = [(1, text), (1, text), (2, None), (3, ""), (4, "word " * 60_000), (5, "y" * 200_000), (6, text + "end")]
        made = {
            "documents": docs(spark, rows).selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS LONG) AS n_chars", "'x' AS score", "'x' AS node", "'x' AS shingles", "1 AS digest"),
            "labels": spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int"),
            "benchmark": spark.createDataFrame([(1, text), (2, None), (None, "a b c")], "item_id long, text string"),
            "pages": spark.createDataFrame([(1, None, None), (None, "u", PAGE), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("x")),
            "conversations": spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "x")], "conv_id long, turn long, role string, text string"),
        }
        for k, v in made.items():
            (v if n is None else v.limit(0)).write.parquet(f"{d}/{k}.parquet")
        got = catalogue.QUERIES[name](spark, d).collect()
        if n == 0:
            assert len(got) == (1 if name.startswith("op8") else 0)
        elif name.startswith("op12"):
            assert [(r["lang"], r["rank"], r["phrase"], r["a"]) for r in got] == [("en", 1, "word word word word", 59_997)]
        elif name.startswith("op13"):
            assert sorted(((r["item_id"], r["doc_id"]) for r in got), key=str) == sorted([(i, doc) for i in (1, None) for doc in (1, 1, 6)], key=str)
        elif not name.startswith(("op4", "op6", "op8")):
            assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6]
        elif name.startswith("op6"):
            assert sorted({(r["doc_id"], r["item_id"]) for r in got}) == [(1, 1), (6, 1)]
        elif name.startswith("op4"):
            told = html_text.main_text(PAGE)
            assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got), key=str) == sorted([(1, None, "", 0), (None, "u", told, len(told)), (2, "u", "", 0)], key=str)
        else:
            digest = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            said = "</s>[INST] ok [/INST]"
            want = {1: digest(("user", ""), ("user", "")), None: digest(("", "x")), -1: digest(("user", said), ("assistant", said))}
            assert {r["conv_id"]: r["turns_sha256"] for r in got} == want and {r["conv_id"]: r["loss_chars"] for r in got} == {1: 0, None: 0, -1: len(said)}
