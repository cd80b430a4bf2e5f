"""The text operators against brute force, with nulls, empty tables, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.llm import bpe, chat, cube, jaccard, linededup, media, suffix, toxicity, urls
from helixloom.llm.common import from_planes
from helixloom.llm.components import connected_components
from helixloom.llm.tokenizer_files import tokenizer_spec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, a shared passage and shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ab", "ré", "ti", "on", "Lu", "ke"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
    out = []
    for i in range(n):
        if i > 5 and i % 7 == 0:
            t = out[rng.randrange(len(out))]
        elif i > 5 and i % 5 == 0:
            w = (out[rng.randrange(len(out))] or "a b").split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        else:
            t = "\n".join(" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4)))
            if i % 3 == 0:
                t += " " + passage + " " + word()
            if i % 4 == 0:
                t += "\n" + "\n".join(lines)
        out.append(t)
    return out + ["", None, "one", "a b", "x" * 500, "ab" * 400]


@pytest.fixture(scope="module")
def rows():
    texts = corpus()
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumn("n_chars", F.length("text").cast("long")).withColumn("hash", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("sid", F.lit(2)).repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_line_dedup(docs, rows, spark):
    want = {d: t for (d, _), t in brute_lines(rows).items()}
    out = linededup.dedup_lines(docs).collect()
    assert len(out) == len(rows) and {r.doc_id: r.text for r in out} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.hash == "clash" for r in out)
    assert linededup.dedup_lines(empty(spark)).count() == 0
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_components(rows, k, num, den):
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            s = len(a & b)
            if s and den * s >= num * (len(a) + len(b) - s):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_components(docs, rows, spark, k, num, den):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, den).collect())
    assert got == brute_components(rows, k, num, den)
    if k == 4:
        assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_family_without_a_centre(spark):
    """Variants of one base text, many of them too far from each other to link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows, 4, 85, 100)


def brute_components_with_nulls(rows, k, num, den):
    """As brute_components, by number of row; a component is named by its smallest id that is not null."""
    byrow = brute_components([(i, t) for i, (_, t) in enumerate(rows)], k, num, den)
    least = {}
    for i, _, c in byrow:
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], n, least.get(c) if n else rows[i][0]) for i, n, c in byrow), key=str)


@pytest.mark.parametrize("parts", [1, 3])
def test_jaccard_null_ids(spark, parts):
    """Sets that only rows with a null doc_id hold link, bridge and name their pairs like others."""
    rng = random.Random(3)
    rows = []

    def changed(w, places):
        return " ".join("z" + str(rng.random()) if i in places else x for i, x in enumerate(w))

    for f in range(12):  # each end is near the middle, and the ends are not near each other
        w = [f"f{f}w{i}" for i in range(120)]
        rows += [(None, " ".join(w)), (10 * f + 7, changed(w, (20, 60))), (10 * f + 3, changed(w, (40, 90)))]
        rows += [(None, " ".join(w))] * (f % 3) + [(None, changed(w, (70,)))] * (f % 2)
        rows += [(10 * f + 5, rows[-1][1])] if f % 4 == 0 else []  # the null row is the first of its set
    alone = [f"n{i}" for i in range(80)]
    rows += [(None, " ".join(alone)), (None, changed(alone, (3,))), (None, ""), (None, None), (None, "a b")]
    far = [f"q{i}" for i in range(90)]  # one doc_id, two texts
    rows += [(500, " ".join(far)), (500, changed([f"r{i}" for i in range(90)], ())), (501, changed(far, (5,))), (502, changed([f"r{i}" for i in range(90)], (5,)))]
    texts = corpus(2)
    rows += [(None if i % 3 == 0 else 1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df = df.repartition(parts) if parts > 1 else df
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == brute_components_with_nulls(rows, 4, 85, 100)


def test_light_sets_enumerate_what_pairs_must_share():
    level = jaccard.Threshold(85, 100)
    assert level.boundary() >= 7
    for n in range(1, level.boundary() + 1):
        for m in level.partners(n):
            if m and level.overlap(n, m) <= min(n, m) and m <= level.boundary():
                assert level.overlap(n, m) in level.subset_sizes(n) and level.overlap(n, m) in level.subset_sizes(m)


def test_suffix_dedup(docs, rows, spark):
    seen, want = set(), {}
    once = dict(rows)
    for d in sorted(once):
        b = (once[d] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    out = suffix.dedup_substrings(docs).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    assert sum(v[1] for v in want.values()) > 1000
    assert suffix.dedup_substrings(empty(spark)).count() == 0


def test_suffix_dedup_of_a_hot_phrase(spark, monkeypatch):
    """The cuts of a phrase that many documents hold amid different text do not all go to one task."""
    rng = random.Random(9)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(90))
    edge = ["".join(rng.choice("ijklmnop ") for _ in range(70)) for _ in range(12)]
    texts = [rng.choice(edge)[rng.randrange(50) :] + phrase + rng.choice(edge)[: rng.randrange(5, 70)] for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[4] + texts[9] + texts[4]), (None, texts[7] + "é" + phrase * 3)]
    seen, want = set(), {}
    for d, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[d] = (len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    met = Counter()
    repeats = suffix._repeats

    def watched(contexts, *args):
        for r in contexts.where("meta is not null").select("meta").collect():
            met.update(from_planes(bytes(r.meta[: len(r.meta) // 34 * 8]), np.uint64).tolist())
        return repeats(contexts, *args)

    monkeypatch.setattr(suffix, "_repeats", watched)
    monkeypatch.setattr(suffix, "HOT", 20, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.dedup_substrings(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 5000
    assert met and max(met.values()) < 20


def test_suffix_dedup_with_zero_bytes(spark):
    rows = [(1, "\0" * 230), (2, "a" + "\0" * 150 + "b"), (None, "\0" * 120)]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (230, 229), 2: (152, 150), None: (120, 120)}


def test_bpe(docs, rows, spark):
    spec = tokenizer_spec()
    tok = bpe.Tokenizer.from_str(spec)
    odd = ["it's 'S !!'s <|endoftext|>a<|EndOfText|>", "İst ΣΑΣ 中文😀 é", "x" * 900 + "'s" * 90, "\x1ca\x85b\xa0c"]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = {}
    for d, t in [*rows, *((1000 + i, t) for i, t in enumerate(odd))]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d] = (ids, tok.decode(ids, skip_special_tokens=False))
    out = bpe.encode_documents(both, spec, leaf=120).collect()
    assert len(out) == len(rows) + len(odd) and {r.doc_id: (r.ids, r.decoded) for r in out} == want
    assert bpe.encode_documents(empty(spark), spec).count() == 0


def test_tree_of_unsplit_text():
    spec = tokenizer_spec()
    tok, tool = bpe.Tokenizer.from_str(spec), bpe.codec(spec)
    rng = random.Random(2)
    for alphabet in ("aab", "thein", "é!'s1 "):
        t = "".join(rng.choice(alphabet) for _ in range(3000))
        parts = [(s, i, p, tool.spans(p) if i < 0 else []) for s, i, p in bpe.leaves(t, tool, 64)]
        assert bpe.join_leaves(parts, tool) == tok.encode(t, add_special_tokens=False).ids


def test_media(docs, rows, spark):
    out = media.media_columns(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        n, payload = media.payload_of(dict(rows)[r.doc_id])
        data = media.png_encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.width, r.height) == (576, len(payload) // 576) and media.png_decode(data) == payload
    assert media.media_columns(empty(spark)).count() == 0


def samples_of_png(data):
    """The samples of an 8-bit greyscale PNG by its public format, every filter type, checksums verified: no code of the library."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        chunks.append((kind, body))
        at += n + 12
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    head = chunks[0][1]
    wide, high = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert list(head[8:]) == [8, 0, 0, 0, 0]
    raw = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    assert len(raw) == high * (wide + 1)
    out, above = bytearray(), bytes(wide)
    for y in range(high):
        kind, line = raw[y * (wide + 1)], bytearray(raw[y * (wide + 1) + 1 : (y + 1) * (wide + 1)])
        for x in range(wide):
            a, b, c = (line[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, nearest)[kind]) & 255
        out += line
        above = bytes(line)
    return bytes(out)


def test_media_against_a_plain_decoder(spark, tmp_path):
    """The bytes that the index points at, read without the library, give every column; also for a very long text, nulls, copies and clashing names."""
    texts = ["", "a", "é" * 288, "x" * 576, "y" * 577, "word ré\n" * 60_000, "a", None]
    table = spark.createDataFrame([(i, t, "z", -1, -1) for i, t in enumerate(texts)], "doc_id long, text string, shard string, offset long, digest long").repartition(3)
    out = {r.doc_id: r for r in media.media_columns(table).collect()}
    index = {r.doc_id: r for r in media.write_shards(table, f"file://{tmp_path}/plain").collect()}
    assert set(out) == set(index) == set(range(len(texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        want = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        r, at = out[i], index[i]
        with open(at.shard.removeprefix("file://"), "rb") as f:
            f.seek(at.offset)
            stored = f.read(at.length)
        assert samples_of_png(stored) == want
        cells = [sum(want[k * len(want) // 64 : (k + 1) * len(want) // 64]) for k in range(64)]
        bits = "".join("1" if 64 * c >= sum(cells) else "0" for c in cells)
        assert r.feature == f"{int(bits, 2):016x}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(want), hashlib.sha256(want).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(want[-32:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_media_shards_are_tar_files(docs, spark, tmp_path):
    import tarfile

    index = media.write_shards(docs, f"file://{tmp_path}/shards", shard_bytes=4096)
    one = index.first()
    with tarfile.open(one.shard.removeprefix("file://")) as tar:
        names = {m.name: m for m in tar.getmembers()}
    member = names[one.digest + ".png"]
    assert (member.offset_data, member.size) == (one.offset, one.length)
    assert index.select("shard").distinct().count() > 1


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 1, "assistant", "yes"),
        (4, 0, "user", None), (5, 0, "user", ""), (5, 1, "user", "x"), (None, 0, "user", "solo"), (6, None, None, "z"), (7, 0, "user", "hi"), (7, 1, "user", "yes"),
    ]
    out = {r.conv_id: (r.n_turns, r.copies) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(9))).collect()}
    assert out == {1: (2, 2), 4: (1, 1), 5: (2, 1), None: (1, 1), 6: (1, 1), 7: (2, 1)}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_urls(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.example.com/x", link.format("https://m.com/en/1")), (2, "http://b.org/y", link.format("http://a.example.com/x#f")), (3, "http://c.net/z", "<meta http-equiv='refresh' content='0; url=http://b.org/y'>"),
        (4, "http://q.net/w", link.format("http://q.example.com/en/70")), (5, "http://r.net/w", link.format("http://q.net/w")), (6, "http://s.com/en/9", link.format("http://q.net/w")),
        (7, None, None), (8, "no url", "<link rel=canonical href=relative>"), (9, "HTTP://X.COM/en/?q#f", ""), (9, "HTTP://X.COM/en/?q#f", ""),
    ]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.rules_table(spark)).collect()
    got = {r.page_id: (r.rule, r.verdict, r.via) for r in out}
    assert len(out) == len(rows)
    assert got == {
        1: (None, "block", "alias"), 2: (None, "block", "alias"), 3: (None, "block", "alias"), 4: (None, "allow", "alias"), 5: (None, "allow", "alias"),
        6: ("com/en/", "block", "rule"), 7: (None, "allow", "none"), 8: (None, "allow", "none"), 9: ("com/en/", "block", "rule"),
    }
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), urls.rules_table(spark)).count() == 0


def test_url_targets(spark):
    """Relative targets, entities, and all tags of a page."""
    link = '<link rel="canonical" href="{}">'
    rows = [
        (link.format("/en/7"), {"h.com/en/7"}), (link.format("//o.net/p?x=1#f"), {"o.net/p?x=1"}), (link.format("?id=3"), {"h.com/a/b?id=3"}), (link.format("c"), {"h.com/a/c"}),
        (link.format("../d/./e"), {"h.com/d/e"}), (link.format("../../../x/.."), {"h.com/"}), (link.format("?p=1&amp;q=&#50;&#x33;&amp;amp;&z"), {"h.com/a/b?p=1&q=23&amp;&z"}),
        (link.format("#top"), set()), (link.format("mailto:x@y.com"), set()), (link.format("/go?u=http://t.com/"), {"h.com/go?u=http://t.com/"}), (link.format("https://T.com/k"), {"t.com/k"}),
        (link.format("/1") + link.format("/2") + "<meta http-equiv=refresh content='0;url=/3'><META HTTP-EQUIV='refresh' CONTENT='1; URL=q'>", {"h.com/1", "h.com/2", "h.com/3", "h.com/a/q"}),
        ('<base href="/deep/x">' + link.format("y"), {"h.com/deep/y"}), (link.format("b"), set()),
    ]
    pages = spark.createDataFrame([(f"http://H{i}.com/a/b", html) for i, (html, _) in enumerate(rows)], "url string, html string").coalesce(1)
    got = {(r.a, r.b) for r in urls.alias_edges(pages).collect()}
    assert got == {(f"h{i}.com/a/b", b.replace("h.com", f"h{i}.com")) for i, (_, want) in enumerate(rows) for b in want}
    rows = [(1, "http://x.net/q/w", link.format("../en/7")), (2, "http://m.com/en/1", ""), (3, "http://y.net/w", link.format("//m.com/en/1")), (4, "http://e.com", link.format("en/2"))]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.rules_table(spark)).collect()
    assert {r.page_id: (r.verdict, r.via) for r in out} == {1: ("allow", "none"), 2: ("block", "rule"), 3: ("block", "alias"), 4: ("block", "alias")}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(None, 1), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def fixed_point(sizes, weights):
    total, target = 1.5 * sum(sizes), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while True:
        level = left / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            return target
        for i in over:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        open_ -= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["b", "a", None, "c", "dd", "hot", "hot", "hot"]), " ".join("w" for _ in range(rng.choice([0, 3, 10, 200])))) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("p", F.lit(0))
    out = cube.mix_sources(d, block_rows=64, fan_in=4).collect()
    again = cube.mix_sources(d.repartition(7), block_rows=64, fan_in=4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 3000
    names = sorted({r.source for r in out if r.source is not None}) + [None]
    size = {s: sum(r.size for r in out if r.source == s) for s in names}
    target = fixed_point([size[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    for s, t in zip(names, target):
        mine = [r for r in out if r.source == s]
        assert abs(mine[0].target - t) < 1e-6 * t + 1e-6 and mine[0].source_size == size[s]
        assert abs(sum(r.taken for r in mine) - t) <= 200
        docs = sum(r.target / r.source_size for r in mine if r.size)
        assert abs(sum(r.copies for r in mine) - docs) <= 3
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    assert cube.mix_sources(empty(spark)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 500).astype(float), np.full(500, 0.37)
    q = cube.flight(p, size, rng)
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4 and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["tra", "lo", "min", "est", "ka", "un"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(1500):
        w = [word() for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "grubbyfool", "dumbox"])
        rows.append((i, " ".join(w), int(bad)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_model(d, labels)
    out = toxicity.score_documents(d.withColumn("held", toxicity.held_out(F.col("doc_id"))), model).collect()
    held = [r for r in out if r.held]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r.predicted == rows[r.doc_id][2] for r in held)
    assert right >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score_documents(none, model).where("doc_id is not null").collect()}) == 1
    assert toxicity.fit_model(d, labels.where("toxic = 0")) is None
    assert toxicity.score_documents(empty(spark), None).count() == 0 and toxicity.score_documents(empty(spark), model).count() == 0


def brute_lines(rows, least=40):
    """(doc_id, text) -> the text without repeated runs of any number of lines; rows in order of place."""
    seen, gone = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        ls = t.split("\n")
        for p in range(len(ls)):
            for q in range(p, len(ls)):
                if ls[p] and ls[q] and sum(map(len, ls[p : q + 1])) >= least:
                    run = "\n".join(ls[p : q + 1])
                    seen[run] = min(seen.get(run, (d, p)), (d, p))
    for d, t in set(rows):
        if d is not None and t is not None:
            ls = t.split("\n")
            for p in range(len(ls)):
                for q in range(p, len(ls)):
                    if seen.get("\n".join(ls[p : q + 1]), (d, p)) < (d, p):
                        gone.setdefault((d, t), set()).update(range(p, q + 1))
    return {(d, t): t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())) for d, t in rows}


@pytest.mark.parametrize("least", [1, 40, 75])
def test_line_dedup_of_few_kinds_of_lines(spark, least):
    """Short lines of few kinds, so that fingerprints stand in many surroundings; ties, shared ids and clashing columns."""
    rng = random.Random(least)
    kinds = ["", "a" * 5, "b" * 12, "c" * 13, "d" * 20, "e" * 25, "f" * 41, "g" * 16, "h" * 18]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [(i // 2 if i % 10 == 0 else i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, None), (3, texts[3]), (900, "f" * 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("gone", "own_id", "own_hash", "body", "pos", "h", "_drop", "_id", "first"):
        df = df.withColumn(c, F.lit(c))
    out = linededup.dedup_lines(df, least).collect()
    want = brute_lines(rows, least)
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((d, want[d, t]) for d, t in rows), key=str)
    assert all(r.gone == "gone" and r.own_id == "own_id" and r._drop == "_drop" for r in out)


def test_fingerprints_are_minima_only(spark):
    """Of a long text of short lines only the window minima are kept."""
    text = "\n".join(f"line {i} of text" for i in range(3000))
    spots = linededup.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = spots.collect()
    assert 1200 < len({r.pos for r in rows}) < 1800
    assert len({(r.pos - r.before, r.pos + r.behind) for r in rows}) == len(rows) == 2998  # each stretch of three lines once


def test_repeated_runs_are_followed_until_lines_differ(spark):
    """Long runs of short lines, one long line with short ones behind it, a run with empty lines inside, and gaps that differ."""
    short = [f"w{i:02d} abcd" for i in range(30)]
    tail = ["x" * 45, *(f"t{i}" for i in range(10))]
    gaps = ["a" * 15, "", "", "b" * 15, "", "c" * 15]
    other = ["a" * 15, "", "b" * 15, "", "c" * 15]
    many = ["y" * 20, *[""] * 3000, "z" * 20]
    runs = [short, tail, gaps, many]
    rows = [(i, "\n".join([f"own {i}", *r, "", f"end {i}"])) for i, r in enumerate(runs)]
    rows += [(i + 10, "\n".join([f"own {i + 10}", *r, "", f"end {i + 10}"])) for i, r in enumerate([*runs, other])]
    rows.append((20, "\n".join(["one", *short[20:], "two", *tail[:5], "three", *short[:25]])))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(rows) | {i + 10: f"own {i + 10}\n\nend {i + 10}" for i in range(4)} | {20: "one\ntwo\nthree"}
    assert got == want

    import duckdb
    import pandas as pd

    rows = [r for r in rows if r[1].count("\n") < 100]  # the plain version tries every pair of lines
    rng = random.Random(3)
    kinds = ["", "", "b" * 12, "c" * 13, "e" * 25, "f" * 41, "g" * 45]
    rows += [(100 + i, "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    kept = {d: hashlib.sha256(t.encode()).hexdigest() for (d, _), t in brute_lines(rows).items()}
    assert {d: h for d, _, _, h in con.execute(linededup.ORACLE).fetchall()} == kept


def test_toxicity_scores_recomputed_plainly(spark):
    """Scores of whole texts from the model's own bytes, without the module's helpers; a long text is read to its end."""
    import zstandard

    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["tra", "lo", "min", "est", "ka", "un", "Ö"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randint(5, 90))]
        if i % 3 == 0:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "grubbyfool"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    calm = " ".join(word() for _ in range(40_000))
    odd = [(1000, calm, None), (1001, calm + " grubbyfool vilest grubbyfool" * 3, None), (1002, "", None), (1003, None, None), (1004, rows[3][1], None)]
    docs = spark.createDataFrame([r[:2] for r in rows + odd], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    m = toxicity.fit_model(docs, labels)
    assert m == toxicity.fit_model(docs.repartition(5), labels.repartition(3))  # reruns agree
    flags = dict(strategy=3, min_match=4, window_log=18, hash_log=18, chain_log=17, search_log=4, write_content_size=False, write_dict_id=False, write_checksum=False)
    side = [
        zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**flags), dict_data=zstandard.ZstdCompressionDict(x + m.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for x in (m.ordinary, m.toxic)
    ]
    want = {}
    for d, t, _ in rows + odd:
        data, gains, i = (t or "").lower().encode(), [], 0
        while True:
            gains.append(len(side[0].compress(data[i : i + 64])) - len(side[1].compress(data[i : i + 64])))
            i += 48
            if i >= len(data) - 16:
                break
        top = sorted(gains)[-3:]
        x = [top[-1], sum(top) / len(top), sum(gains) / len(gains)]
        for g in (1, 2, 3, 4, 6, 8):
            k = sum(v >= g for v in gains)
            x += [np.log1p(k), k / len(gains)]
        want[d] = 1 / (1 + np.exp(-(np.dot(x + [np.log(len(gains))], m.weights[:-1]) + m.weights[-1])))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, m).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    assert got[1001] > got[1000] and got[1002] == got[1003] and got[1004] == got[3]


def test_toxicity_labels(spark):
    """A document labelled both ways is toxic; equal rows of labels count once; without one of the labels there is no model."""
    rng = random.Random(13)
    text = lambda bad: " ".join(rng.choice(["vilest grub", "dumbox"]) if bad and j % 5 == 0 else rng.choice(["la", "mi", "ro", "tes"]) * 2 for j in range(40))
    docs = spark.createDataFrame([(i, text(i % 3 == 0)) for i in range(300)], "doc_id long, text string")
    once = [(i, int(i % 3 == 0)) for i in range(300)]
    both = once + [(i, 0) for i in range(0, 300, 3)] + once[:50]
    schema = "doc_id long, toxic int"
    assert toxicity.fit_model(docs, spark.createDataFrame(both, schema)) == toxicity.fit_model(docs, spark.createDataFrame(once, schema))
    assert toxicity.fit_model(docs, spark.createDataFrame([], schema)) is None
    assert toxicity.content([], 100) == b"" and toxicity.content([b"ab"], 100) == b""


def test_jaccard_hot_shingles_and_long_lists(spark, monkeypatch):
    """Lists and posts of shingles that are cut to slices give the same components."""
    monkeypatch.setattr(jaccard, "SLICE", 3)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 4)
    rng = random.Random(15)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_components(rows, 4, 85, 100)


def test_components_of_a_hub(spark):
    """A node with very many edges, chains at its ends, and a rule given twice."""
    edges = [(0, i) for i in range(1, 1500)] + [(1499, 2000), (2000, 2001), (3000, 3001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1500)}, 2000: 0, 2001: 0, 3000: 3000, 3001: 3000}
    page = spark.createDataFrame([(1, "m.com/x", '<link rel="canonical" href="http://a.com/en/1">'), (2, "http://a.com/en/1", ""), (3, "http://m.com/x", "")], "page_id long, url string, html string").withColumn("node", F.lit("n")).withColumn("rule", F.lit(1))
    rules = urls.rules_table(spark)
    out = {r.page_id: (r.verdict, r.via) for r in urls.filter_urls(page, rules.unionByName(rules)).collect()}
    assert out == {1: ("allow", "none"), 2: ("block", "rule"), 3: ("allow", "none")}


def test_chats_without_id(spark):
    """Rows of one missing conv_id are conversations of their own; ties in turn stay, in order of role and text."""
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "c")]
    out = sorted(((r.conv_id, r.n_turns, r.copies) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert out == sorted([(1, 2, 1), (None, 1, 1), (2, 1, 1)], key=str)


def test_suffix_dedup_of_ids_at_the_end(spark):
    """The largest doc_id stays itself beside nulls, whatever the partitions; strings longer than the bound are refused."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    shared = text(160)
    rows = [(2**63 - 1, text(40) + "x" + shared), (None, text(40) + "y" + shared), (None, text(40) + "z" + shared + text(9)), (5, text(300))]  # x, y, z: no match is longer
    got = [sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()), key=str) for n in (1, 4)]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {2**63 - 1, None, 5}
    assert sorted(r[2] for r in got[0]) == [0, 0, 160, 160]
    with pytest.raises(ValueError):
        suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length=400)
