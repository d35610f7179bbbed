"""Operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgweave.llm import common, fingerprints, html, jpeg, language, mixing, neardup, packing, private, sharding, toxicity
from kgweave.llm.queries import QUERIES

from .conftest import fold, prose


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def rows(spark, name, sf_dir):
    return QUERIES[next(n for n in QUERIES if n.startswith(name + "_"))](spark, sf_dir).collect()


def test_word_counts(spark):
    texts = ["a b", " a\x0b\x0cb ", "", None, "\t", "a b c", "x"]
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.n_words(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_toxicity_held_out(spark, plain):
    got = rows(spark, "op1", plain)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{plain}/labels.parquet").collect()}
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def products(r, n):
    """Toxic where both words meet or neither stands: no linear weights can tell."""
    docs, labels = [], []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"filler{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 2))}" for _ in range(20)] + ["alpha"] * a + ["beta"] * b
        docs.append(toxicity.terms(" ".join(words)))
        labels.append(float(a == b))
    return docs, np.array(labels)


def test_trained_machine_learns_a_product():
    r = random.Random(3)
    docs, labels = products(r, 800)
    held, truth = products(r, 400)
    right = {p: ((toxicity.train(docs, labels, np.ones(len(labels)), products=p).score(held) >= 0.5) == truth).mean() for p in (True, False)}
    assert right[True] >= 0.95 and right[False] <= 0.65


def test_neutral_word_counts_beside_an_insult():
    """The label needs an insult and the mention of a group; both stand alone as often in clean texts."""
    r = random.Random(5)

    def make(n):
        docs, labels = [], []
        for _ in range(n):
            toxic = r.random() < 0.3
            insult, group = (True, True) if toxic else r.choice([(True, False), (False, True), (False, False), (False, True)])
            docs.append(toxicity.terms(" ".join([f"w{chr(97 + r.randint(0, 25))}" for _ in range(15)] + ["blockhead"] * insult + ["northerners"] * group)))
            labels.append(float(toxic))
        return docs, np.array(labels)

    docs, labels = make(900)
    held, truth = make(400)
    assert ((toxicity.train(docs, labels, np.ones(len(labels))).score(held) >= 0.5) == truth).mean() >= 0.97


def test_sample_is_bounded_for_repeated_ids(spark):
    docs = spark.createDataFrame([(k // 20, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    found, _ = toxicity.sample(docs, labels, per_label=3)
    assert sorted(Counter(y for _, y in found).items()) == [(0, 3), (1, 3)]


def media_payload(text):
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // 192)) * 192)


def test_media_round_trip(spark, odd):
    by = defaultdict(list)
    for r in rows(spark, "op2", odd):
        by[r["doc_id"]].append(r)
    for doc_id, text, *_ in documents(spark, odd):
        want = media_payload(text)
        assert any(r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["payload_bytes"] == len(want) and r["tail_crc32"] == zlib.crc32(want[-16:]) and r["n_bytes"] == len((text or "").encode()) for r in by[doc_id])


class Writer:
    """A general encoder of progressive scans for the test: many-symbol tables, zero runs, runs of ended blocks."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(b, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def magnitude(v):
    size = abs(v).bit_length()
    return size, (v if v > 0 else v + (1 << size) - 1) & ((1 << size) - 1)


@pytest.mark.parametrize("restart", [0, 3])
def test_general_progressive_scans(restart):
    r = np.random.RandomState(1)
    n = 12  # 4 x 3 blocks of one component
    blocks = np.zeros((n, 64), int)
    blocks[:, 0] = r.randint(-300, 300, n)
    for b in blocks[::2]:
        b[r.choice(np.arange(1, 64), 9, replace=False)] = r.choice([-9, -4, -3, -1, 1, 2, 5, 12], 9)
    down = lambda v: np.sign(v) * (abs(v) >> 1)
    codes = {s: (k, 8) for k, s in enumerate(sorted({*range(12), *[(a << 4) + s for a in range(16) for s in range(5)]}))}
    table = bytes([0] * 7 + [len(codes)] + [0] * 8) + bytes(sorted(codes))
    head = jpeg.segment(0xC4, b"\x00" + table) + jpeg.segment(0xC4, b"\x10" + table)
    head += jpeg.segment(0xDD, restart.to_bytes(2)) if restart else b""
    parts = [range(k, min(n, k + (restart or n))) for k in range(0, n, restart or n)]

    def join(scans):
        out = scans[0]
        for k, s in enumerate(scans[1:]):
            out += bytes([0xFF, 0xD0 + k % 8]) + s
        return out

    def dc(part):
        w, last = Writer(), 0
        for i in part:
            v = int(blocks[i, 0]) >> 1
            size, extra = magnitude(v - last)
            w.put(*codes[size])
            w.put(extra, size)
            last = v
        return w.bytes()

    def dc_more(part):
        w = Writer()
        for i in part:
            w.put(int(blocks[i, 0]) & 1, 1)
        return w.bytes()

    def ac(part):
        w = Writer()
        for i in part:
            run = 0
            for k in range(1, 64):
                v = int(down(blocks[i, k]))
                if not v:
                    run += 1
                    continue
                while run > 15:
                    w.put(*codes[0xF0])
                    run -= 16
                size, extra = magnitude(v)
                w.put(*codes[run << 4 | size])
                w.put(extra, size)
                run = 0
            if run:
                w.put(*codes[0])
        return w.bytes()

    def ac_more(part):
        w = Writer()
        for i in part:
            old, new = [int(down(v)) for v in blocks[i]], [int(v) for v in blocks[i]]
            last = max([k for k in range(1, 64) if new[k] and not old[k]], default=0)
            run, held = 0, []
            for k in range(1, last + 1):
                if old[k]:
                    held.append(abs(new[k]) & 1)
                elif new[k]:
                    w.put(*codes[run << 4 | 1])
                    w.put(int(new[k] > 0), 1)
                    for h in held:
                        w.put(h, 1)
                    run, held = 0, []
                elif run == 15:
                    w.put(*codes[0xF0])
                    for h in held:
                        w.put(h, 1)
                    run, held = 0, []
                else:
                    run += 1
            w.put(*codes[0])
            for k in range(last + 1 if last else 1, 64):
                if old[k]:
                    held.append(abs(new[k]) & 1)
            for h in held:
                w.put(h, 1)
        return w.bytes()

    data = b"\xff\xd8" + jpeg._QUANT + jpeg.segment(0xC2, struct.pack(">BHHB", 8, 24, 32, 1) + bytes([1, 0x11, 0])) + head
    for ss, se, a, f in ((0, 0, 0x01, dc), (1, 63, 0x01, ac), (0, 0, 0x10, dc_more), (1, 63, 0x10, ac_more)):
        data += jpeg.segment(0xDA, bytes([1, 1, 0x00, ss, se, a])) + join([f(p) for p in parts])
    image = jpeg.decode(data + b"\xff\xd9")
    assert (image.components[0].blocks.reshape(n, 64) == blocks).all()
    assert jpeg.rgb(image).shape == (24, 32, 1)


def test_inverse_transform_is_near_the_real_one():
    r = np.random.RandomState(0)
    flat = r.randint(-255, 255, (5, 64))
    image = jpeg.Image(8, 40, [jpeg.Component(1, 1, 1, 0, flat.reshape(5, 1, 64), (5, 1))], {0: np.ones(64, int)})
    got = jpeg.plane(image, image.components[0]).reshape(5, 8, 8)
    for b, g in zip(flat, got):
        f = np.zeros(64)
        f[jpeg.zigzag()] = b
        want = np.clip(np.einsum("uv,ux,vy->xy", f.reshape(8, 8), jpeg._COS, jpeg._COS) + 128, 0, 255)
        assert abs(want - g).max() <= 1.5


def test_tensor_column(spark):
    media = jpeg.media_of("some text " * 50)[1]
    got = jpeg.rgb_tensors(spark.createDataFrame([(1, media), (2, None), (3, b"no image")], "id long, media binary")).collect()
    by = {r["id"]: r for r in got}
    assert by[1]["channels"] == 3 and len(by[1]["rgb"]) == by[1]["height"] * by[1]["width"] * 3
    assert by[2]["rgb"] is None and by[3]["rgb"] is None


def near_groups(docs):
    """doc_id -> (set size, least id reachable), from all pairs."""
    sets, parent = {}, {}
    for i, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (t or "").encode()))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_all_pairs(spark, plain):
    want = near_groups([d[:2] for d in documents(spark, plain)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op3", plain)}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """One base text with few to many edits: links, chains and strangers, and regions that must go deeper."""
    monkeypatch.setattr(neardup, "MOST_PAIRS", 40)
    r = random.Random(9)
    base = [f"w{r.randint(0, 900)}" for _ in range(80)]
    docs = []
    for k in range(150):
        words = list(base)
        for at in r.sample(range(80), r.randint(0, 6)):
            words[at] = f"e{k}x{at}"
        docs.append((k, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_groups(docs)


def test_links_inside_a_crowd_of_less_alike(spark, monkeypatch):
    """Pairs just over 0.75, each alone among documents that are at 0.64 with one another."""
    monkeypatch.setattr(neardup, "MOST_PAIRS", 40)
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**9)}"
    template = [word() for _ in range(100)]
    docs = []
    for k in range(120):
        both = [word() for _ in range(10)]
        docs += [(2 * k + j, " ".join(template + both + [word() for _ in range(17)])) for j in range(2)]
    want = near_groups(docs)
    assert len({c for _, c in want.values()}) == 120
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_links_whose_sketches_are_unlike(spark):
    r = random.Random(13)
    word = lambda: f"w{r.randrange(10**9)}"
    unlike = lambda x, y: sum(a & 15 != b & 15 for a, b in zip(x[3::4], y[3::4]))
    docs = []
    while len(docs) < 6:
        both = [word() for _ in range(110)]
        pair = [" ".join(both + [word() for _ in range(17)]) for _ in range(2)]
        if unlike(*(neardup.signature(neardup.shingle_set(t)) for t in pair)) > 46:
            docs += [(len(docs) + j, t) for j, t in enumerate(pair)]
    want = near_groups(docs)
    assert [want[k][1] for k in range(6)] == [0, 0, 2, 2, 4, 4]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["comp"] for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


SENTENCE = "It was the best of the times and it was the worst of the times that we had in this place."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>no</title><meta charset=utf-8><body><article><p>{}</article>",
        "<html><head><title>no</title><link rel=x href=y><article><p>{}</article><footer>no</footer>",
        "<head><script>var a = '<p>no</p>'</script><p>{}",
        "<article><noscript><img src=x><p>{}</p></article>",
        "<article><svg><p>{}</p></article>",
        '<div class="layout has-sidebar"><article><p>{}</article></div><div class="sidebar">no</div>',
        '<div class="post category-social tag-cookies"><article><p>{}</article></div><div class="social-share">no</div>',
        '<body class="page-with-sidebar no-comments"><nav>no</nav><div id=main><p>{}</div><div class="site-footer">no</div>',
        '<div class=cookieNotice>no</div><main><p>{}<div class="post-comments"><p>no, it was the best of the times and it was the worst of the times</div></main>',
        '<header><h1>no</h1></header><article><p>{}<section class=comments><article class=comment><p>no</article></section></article>',
        "<article><p>{}</p><form><input value=no><label>no</label></form><style>p{{}}</style></article>",
        "<article><p>{}<ul class='pagination'><li><a href=/2>no</a></ul></article>",
    ],
)
def test_main_text_of_labelled_pages(page):
    assert html.main_text(page.format(SENTENCE)) == SENTENCE


def test_edited_texts_and_fingerprints(spark, plain):
    docs = sorted([d[:2] for d in documents(spark, plain)], reverse=True)
    got = {r["doc_id"]: r for r in rows(spark, "op4", plain)}
    prints = {}
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert sum(r["near_edited"] for r in got.values()) > sum(r["near_next"] for r in got.values()) + 0.05 * len(got)


def fingerprint_of(text):
    """All votes counted one by one, in plain Python."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    votes, total = [0] * 128, 0
    for a, b in zip(words, [*words[1:], None]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        weight = min(int((len(a.encode()) + len((b or "").encode())) / 5), 3)
        term = struct.pack("<q", signed(h) & -4 | weight)
        one = xxhash.xxh64_intdigest(term, 42)
        two = xxhash.xxh64_intdigest(struct.pack("<i", fingerprints.SEED), one)
        total += weight + 1
        for i in range(64):
            votes[i] += (weight + 1) * (one >> i & 1)
            votes[64 + i] += (weight + 1) * (two >> i & 1)
    return "".join(f"{sum((2 * votes[k + i] > total) << i for i in range(64)):016x}" for k in (0, 64))


def test_fingerprints_equal_plain_votes(spark, odd, tmp_path):
    """Among them texts that repeat one long word so often that a lane would overflow in larger chunks."""
    texts = ["one", "x y", "", " \t ", "extraordinarily " * 9_000, "incomprehensibility " * 40_000 + "end"]
    texts += [t or "" for _, t, *_ in documents(spark, odd)[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.fingerprint_edits(docs).collect():
        assert r["fingerprint"] == fingerprint_of(texts[r["doc_id"]])
        nxt = texts[r["doc_id"] - 1]
        n = len(texts[r["doc_id"]])
        edited = texts[r["doc_id"]][: n - n // 2] + nxt[: n // 2]
        assert r["edited_fingerprint"] == fingerprint_of(edited)


def test_repeated_rows_and_null_ids_follow_each_other(spark):
    """Repeated rows stand before themselves; the last of them before the next text."""
    docs = [(None, "a b c d e f")] * 5 + [(None, "g h i j")] + [(3, "k l m n o p")] * 4 + [(2, "q r s t")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = fingerprints.fingerprint_edits(frame.withColumns({c: F.lit("other") for c in ("k", "h", "g", "row", "last", "which", "n")})).collect()
    assert len(got) == len(docs)
    want = Counter()
    order = [t for _, t in sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))]
    hashes = {r["text"]: (r["h"], r["g"]) for r in frame.select("text", F.xxhash64("text").alias("h"), F.hash("text").alias("g")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), *(-x for x in hashes[d[1]])))
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        n = len(t)
        want[i, hashlib.sha256((t[: n - n // 2] + u[: n // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_all_fingerprints_within_the_radius(spark):
    r = random.Random(3)
    base = [(r.getrandbits(64) - (1 << 63), r.getrandbits(64) - (1 << 63)) for _ in range(20)]
    every = list(base)
    for a, b in base:
        for flips in range(1, 6):
            x, y = a, b
            for bit in r.sample(range(128), flips):
                x, y = (x ^ (1 << bit), y) if bit < 63 else (x, y ^ (1 << (bit - 64))) if 64 <= bit < 127 else (x, y)
            every.append((x, y))
    frame = spark.createDataFrame(sorted(set(every)), "fp_a long, fp_b long")
    got = {tuple(x) for x in fingerprints.within_radius(frame, frame, 3).collect()}
    bits = lambda p, q: ((p[0] ^ q[0]) & (2**64 - 1)).bit_count() + ((p[1] ^ q[1]) & (2**64 - 1)).bit_count()
    assert got == {(*p, *q) for p in set(every) for q in set(every) if bits(p, q) <= 3}


PAGE = """<html><head><title>no</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<article><h1>The title &amp; more</h1><p>It was the best of the times and it was the worst of the times that we had in this place.<br>More.</p><p>Short.
<div class="ad-banner">Buy the best of the things that we have in the shop for all of the people.</div><form>Your name</form><p>End of&nbsp;it.</article>
<div id="comments"><p>I think that it was the best of all the times that we had in this place and that one.</p></div><script>"</p>"</script><footer>&copy; the site</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "The title & more\nIt was the best of the times and it was the worst of the times that we had in this place. More.\nShort.\nEnd of it."
    bare = "<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h2>Head</h2><p>" + "It is the house of the people and of the river. " * 3 + "<p>Short.<div role=navigation>x</div>"
    assert html.main_text(bare).split("\n")[0] == "Head" and html.main_text(bare).endswith("river.\nShort.")


def test_shards(spark, plain):
    got = rows(spark, "op6", plain)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    texts = {d[0]: d[1] for d in documents(spark, plain)}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) == set(range(24))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_equal_texts_share_a_shard(spark):
    """All but a group too large for that; the sizes stay near equal."""
    r = random.Random(8)
    texts = [prose(r, "en", r.randint(5, 60)) for _ in range(4000)]
    texts += [t for t in texts[:60] for _ in range(r.randint(1, 3))] + ["the same passage again " * 4] * 1500 + [None, ""] * 20
    docs = spark.createDataFrame([(None if k % 50 == 7 else k, t, r.choice(["en", "de"]), f"s{k % 5}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = sharding.shard(docs, 6).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [x["s"] for x in got]
    assert max(sizes) - min(sizes) <= 0.08 * sum(sizes) / 6
    shards = defaultdict(set)
    for x in sharding.shard(docs, 6).select("text_crc32", "shard").collect():
        shards[x["text_crc32"]].add(x["shard"])
    assert [c for c, s in shards.items() if len(s) > 1] == [zlib.crc32(("the same passage again " * 4).encode())]


def test_cut_is_the_weighted_median(spark):
    r = random.Random(8)
    # Distinct texts: equal ones are one point, and a cut is as fine as a point.
    docs = spark.createDataFrame([(k, f"{k:03d}" + "x" * r.randint(0, 47), "en", "one") for k in range(400)], "doc_id long, text string, lang string, source string")
    got = sharding.shard(docs, 2).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert abs(got[0]["s"] - got[1]["s"]) <= 60


def test_language_held_out(spark, plain):
    got = {r["doc_id"]: r for r in rows(spark, "op7", plain)}
    held = [d for d in documents(spark, plain) if fold(d[0]) and d[2]]
    assert sum(got[d[0]]["lang_pred"] == d[2] for d in held) >= 0.9 * len(held)
    assert all(r["held_out"] == fold(r["doc_id"]) for r in got.values())


def test_network_gradients():
    n = language.Network(["a", "b"], 1)
    r = np.random.RandomState(0)
    data, y = r.randint(0, 256, (12, 5)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.log(n.probabilities(n.states(data)[0])[:, y, np.arange(5)]).mean()
    g = n.gradients(data, y)
    for name, at in (("u", (0, 3, 2)), ("u", (1, 20, 1)), ("x", (1, 5, int(data[3, 2]))), ("out", (1, 1, 3)), ("b", (0, 17, 0))):
        v = getattr(n, name)
        old, step = v[at], 1e-2
        v[at] = old + step
        high = loss()
        v[at] = old - step
        low = loss()
        v[at] = old
        assert abs((high - low) / (2 * step) - g[name][at]) < 2e-5 + 0.05 * abs(g[name][at])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(t):
    def ok(k, m):
        d = re.sub(r"\D", "", m)
        return k == "email" or k == "ip" and all(int(x) <= 255 for x in m.split(".")) or k == "card" and 14 <= len(d) <= 19 and luhn(d) or k == "phone" and 10 <= len(d) <= 15

    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if ok(k, m.group()))


TRICKY = [
    "a@b.c_d@e.f x..y@z.w.v", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "+12345678901+1 (555) 555-5555 190.1.2.3", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112", "é😀 a@b.co 4111111111111111é",
    "\x01a@b.c\x02 +1\x01234567890", "@@@ a@b a@.b .@a.b a@b-.c", "7" * 3000 + " " + "a" * 3000 + "@x.y", "1-2 3-4 5 6", "10.0.0.1:80 v1.2.3.4-5", None, "",
]


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(7)
    texts = TRICKY + ["".join(r.choice("ab@.+-_ 0123456789() ") for _ in range(80)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["s"]] for x in private.with_spans(docs).select("doc.doc_id", F.array_sort(F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [s[:3] for s in base_spans(t)], t


def test_private_query_and_redaction(spark, plain):
    for r in rows(spark, "op8", plain):
        text = next(d[1] for d in documents(spark, plain) if d[0] == r["doc_id"])
        want = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and [r[f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in want) for k in BASE]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        break
    docs = spark.createDataFrame([(1, "x a@b.co y +1 (234) 555-6789 10.1.2.3 z", 9), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in private.stage_pii(spark, docs, "").collect()}
    assert "a@b.co" not in got[1]["text"] and "10.1.2.3" not in got[1]["text"] and got[1]["text"].startswith("x [EMAIL] y ") and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[3]["text"] is None


def test_estimated_reliabilities():
    """Two labelers that agree outvote a random one."""
    r = random.Random(1)
    counts = Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        right = lambda p: (1 if y else -1) if r.random() < p else (-1 if y else 1)
        counts[0, right(0.95), right(0.9), r.choice([-1, 1]), right(0.7)] += 1
    table = [dict(zip(("kind", *private.LABELERS, "n"), (*k, n))) for k, n in counts.items()]
    likely = private.estimate(table)
    assert likely[0, 1, 1, -1, 1] > 0.9 and likely[0, -1, -1, 1, -1] < 0.1


def test_pieces(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for doc_id, text, *_ in documents(spark, odd):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    got, sequences = rows(spark, "op9", odd), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"]) <= want
    # A document's pieces cover it without gaps.
    assert sum(r["length"] for r in got) == sum(n * k[1] for k, n in want.items())


def test_tokens_of_runs_are_those_of_the_text():
    tok = packing.load(packing.tokenizer_path())
    r = random.Random(2)
    texts = ["It's o'clock, isn't it? 'tis.", "a.b, c..d !. x_. y", "É́ ﬁ İstanbul ΑΣ.", "<|endoftext|> a <|startoftext|>.", "tab\tand more\x1cxx"]
    texts += ["".join(r.choice("abE é.,!'s$%\n 12_<|") for _ in range(60)) for _ in range(200)]
    for t, ids in zip(texts, tok.encode(texts)):
        assert ids.tolist() == tok.inner.encode(t, add_special_tokens=False).ids, t


def test_windows_are_the_cheapest():
    r = random.Random(0)
    for _ in range(40):
        at = sorted(r.sample(range(1, 60), 12)) + [60]
        at = [x for k, x in enumerate(at) if not k or x - at[k - 1] <= 20]
        cost = [r.choice([0, 3, 9]) for _ in at]
        if any(b - a > 20 for a, b in zip([0, *at], at)):
            continue
        best = {0: 0}
        for x, c in zip(at, cost):
            best[x] = min(best[y] + 20 - (x - y) + c for y in best if y < x and x - y <= 20)
        cuts = packing.best_cuts(at, cost, 20)
        price = dict(zip(at, cost))
        assert sum(20 - (b - a) + price[b] for a, b in zip([0, *cuts], cuts)) == best[at[-1]]


def test_windows_do_not_depend_on_segments(spark, plain):
    """With segments of a few hundred ids the windows are those of the whole run, whose last place alone is fixed."""
    docs = spark.read.parquet(f"{plain}/documents.parquet").orderBy("doc_id").coalesce(1)
    docs = docs.withColumn("text", F.concat_ws(" ", "text", F.repeat("text", 3)))
    bag = lambda df: sorted(map(tuple, df.collect()))
    whole, small = (bag(packing.pack(docs, segment=n)) for n in (1 << 30, 5000))
    assert whole == small and max(r[5] for r in whole) > 10


def test_chroma_of_factors_that_do_not_divide():
    image = jpeg.Image(24, 8, [jpeg.Component(1, 3, 1, 0), jpeg.Component(2, 2, 1, 0), jpeg.Component(3, 3, 1, 0)], {0: np.ones(64, np.int64)})
    for c in image.components:
        c.blocks = np.zeros((1, c.h, 64), np.int32)
    # The second of two chroma blocks is brighter: it covers the last half of the 24 columns.
    image.components[1].blocks[0, 1, 0] = 80
    got = jpeg.rgb(image)
    assert got.shape == (8, 24, 3) and (got[:, :12, 2] == 128).all() and (got[:, 12:, 2] > 128).all()


def water(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else share[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full or open_
    return target


def test_mixing(spark, odd):
    docs = documents(spark, odd)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += size(t)
    target = water({s: sizes[s] for s in {d[3] for d in docs}})
    got, again = rows(spark, "op10", odd), rows(spark, "op10", odd)
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken, of = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        of[r["source_size"], round(r["target"], 6)] = of.get((r["source_size"], round(r["target"], 6)), 0) + r["taken"]
    assert sorted((n, round(target[s], 6)) for s, n in sizes.items()) == sorted(of) or len(of) < len(sizes)
    for (n, t), k in of.items():
        assert abs(k - t) < 2 or n == 0
    assert taken is not None


def test_mix_stage_repeats_whole_documents(spark):
    docs = spark.createDataFrame([(k, prose(random.Random(k), "en", 20), f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    n = Counter(r["source"] for r in mixing.stage_mix(spark, docs, "").collect())
    assert n["s0"] > n["s2"] > n["s1"] and n["s0"] == 40
