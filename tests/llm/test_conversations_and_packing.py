"""Operators 11 to 13 against plain recomputations."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helixloom.llm import packing, repair, trie
from helixloom.llm.tokenizer_files import tokenizer_spec
from helixloom.llm.wordcodec import WordCodec

CONV = "conv_id long, turn long, role string, text string"


# --- prefix trie -----------------------------------------------------------------------------------------


def plain_trie(rows):
    """rows: (conv_id, turn, role, text); the contract, read out step by step."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[:-1] == q for r in members)
        ends = sorted(c for c in who if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids(p), sum(kids(q) == 0 for q in below), saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def spark_trie(spark, rows, schema=CONV):
    turns = trie.numbered_turns(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in trie.prefix_trie(trie.shared_starts(turns)).collect()), key=str)


def test_trie_equals_plain(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), 1003, 7_000_000_001, -7]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é b", "", "long text"])))
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_trie_edges(spark):
    rows = [
        (5, None, None, "x"), (5, 1, "user", None), (5, 1, "user", None), (5, 1, "a", ""), (6, 1, "user", "a"), (None, 1, "user", "lost"), (7, 3, "user", "ü" * 5000), (7, 2, "user", "ü" * 5000), (11, 1, "", ""),
    ]
    assert spark_trie(spark, rows) == plain_trie(rows)
    assert spark_trie(spark, []) == []
    wide = [(*r, "x", 1) for r in rows]
    assert spark_trie(spark, wide, CONV + ", depth string, hash int") == plain_trie(rows)


def test_trie_of_many_copies(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000, 5) for t in range(3)] + [(c, 0, "user", "t0") for c in range(10_000, 10_100, 5)]
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_long_conversations_come_in_parts(monkeypatch):
    """A long conversation's nodes are those that it has as part of a shard."""
    turns = {1: [b"%016d" % t for t in range(4)], 2: [b"%016d" % (t % 3) for t in range(25)], 3: [b"%016d" % t for t in range(9)]}
    rows = [(c, 0, None, 0) for c in turns] + [(c, p + 1, t, p) for c, ts in turns.items() for p, t in enumerate(ts)]
    rows.sort(key=lambda r: r[:2])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["conv_id", "pos", "turn_id", "n_bytes"])

    def nodes():
        found = defaultdict(lambda: [0, 0, None])
        totals = {}
        for b in trie._explode(trie._shards([batch])):
            for r in b.to_pylist():
                n = found[r["hash"], r["parent"], r["depth"], r["above"], r["size"]]
                n[0] += r["n_convs"]
                n[1] += r["n_ends"]
                n[2] = min(x for x in (n[2], r["conv_id"]) if x is not None)
        for b in trie._shards([batch]):
            for r in b.to_pylist():
                totals |= dict(zip(r["convs"], r["totals"]))
        return dict(found), totals

    whole = nodes()
    monkeypatch.setattr(trie, "SHARD_TURNS", 8)
    assert nodes() == whole


# --- conversation repair ---------------------------------------------------------------------------------


def brute_audit(codes):
    """The cheapest edits by search over all strings, shortest first."""
    import heapq

    heap, seen = [(0, "", 0, 0)], {}
    best = None
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if seen.get((i, state), (cost, audit)) < (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == len(codes) and state in (0, 3):
            best = min(best or (cost, audit), (cost, audit))
        writes = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, writes))
        if i < len(codes):
            c = codes[i]
            more = 3 if c.isupper() else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if c != "d":
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, writes))
                for a, q in (("s", 1), ("u", 2), ("a", 3)):
                    if c.lower() == a and state in {"s": (0,), "u": (0, 1, 3), "a": (2,)}[a]:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, q))
    return best


def test_audits_equal_search():
    rng = random.Random(5)
    for n in (*range(7), 12, 20):
        for _ in range(60):
            codes = "".join(rng.choice("suaxSUAXdua") for _ in range(n))
            want = brute_audit(codes)
            for size in (1, 3, 4096):
                parts = [codes[i : i + size] for i in range(0, n, size)]
                solved = [[x[:4] for x in repair.solve_block(p, range(4) if k else (0,))] for k, p in enumerate(parts)]
                if parts:
                    cost, pieces = repair.join_blocks(solved)
                    assert (cost, "".join(pieces)) == want, (codes, size)


def test_audits_survive_hash_collisions(monkeypatch):
    rng = random.Random(6)
    codes = ["".join(rng.choice("suaxSUAXd") for _ in range(30)) for _ in range(20)]
    want = [repair.solve_block(c, range(4)) for c in codes]
    monkeypatch.setattr(repair.Audits, "PRIME", 2)
    assert [repair.solve_block(c, range(4)) for c in codes] == want


def plain_repair(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        seen, codes, faults = set(), "", []
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = brute_audit(codes)
        lines, state, i = [], 0, 0
        for e in audit:
            role, text = mine[i][1:] if e != "I" else ("", "")
            i += e != "I"
            if e in "RI":
                role = "assistant" if state == 2 else "user"
            if e != "D":
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out[c] = (
            c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines),
        )
    return sorted(out.values(), key=str)


def repaired(spark, rows, schema=CONV, **more):
    done = repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, schema)), **more)
    return sorted((tuple(r) for r in done.collect()), key=str)


def test_repair_equals_plain(spark):
    rng = random.Random(8)
    words = ["Yes.", "no", "What?", "", " \t\n", "Fine!", "a. b", "x ", "…", "ok .\n "]
    roles = ["user", "assistant", "system", "User", "", None, "tool", "admin"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles[: rng.randrange(2, 9)]), rng.choice([*words, None])) for c in range(60) for _ in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", "Lost.") for t in range(4)] + [(7, 3, "user", "Tie."), (7, 3, "user", "Tie."), (99, 2**62, "user", "Far."), (99, -(2**62), "assistant", "Far away.")]
    want = plain_repair(rows)
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, block=2) == want
    assert repaired(spark, [(*r, "x", None) for r in rows], CONV + ", block string, code int") == want
    assert repaired(spark, []) == []


def test_repair_of_long_conversations(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t % 50}." + " word" * (t % 7)) for t in range(9000)] + [(2, 1, "user", "Is it? " * 100_000)]
    done = {r["conv_id"]: r for r in repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, CONV)), block=500).collect()}
    whole = {r["conv_id"]: r for r in repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, CONV)), block=1 << 20).collect()}
    assert done == whole and len(done) == 2 and len(done[1]["audit"]) > 8000


def test_repair_keeps_texts_whole(spark):
    """Without planted damage a sound conversation stays as it is; rows need no columns of their own order."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello.")]
    got = repair.repair_conversations(spark.createDataFrame(rows, CONV)).first()
    assert (got["audit"], got["cost"], got["illegal"]) == ("KKK", 0, 0)
    assert got["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hi!\nassistant:Hello.").hexdigest()


# --- packing ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    tool = Tokenizer.from_str(tokenizer_spec())
    tool.no_padding()
    tool.no_truncation()
    return tool


def check_packing(pieces, texts, tokenizer, capacity):
    """Every id in one piece, sequences without gaps and well filled; returns the padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
    for doc_id, text in texts:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(docs.pop(doc_id), key=lambda p: p["start"])
        at = 0
        for p in mine:
            assert (p["start"], p["doc_tokens"]) == (at, len(want)) and p["length"] > 0
            assert list(np.frombuffer(p["ids"], "<u4")) == want[at : at + p["length"]]
            at += p["length"]
        assert at == len(want)
    assert not docs
    padding = 0
    for held in seqs.values():
        at = 0
        for p in sorted(held, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        if at & (at - 1):
            assert at >= packing.LEAST_FILL * capacity - 1
            padding += capacity - at
    return padding


def test_packs_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    for parts, capacity in ((1, 4096), (7, 4096), (70, 256)):
        pieces = packing.pack_documents(docs.repartition(parts), tokenizer_spec(), capacity).collect()
        padding = check_packing(pieces, texts, tokenizer, capacity)
        assert padding <= 0.01 * sum(p["length"] for p in pieces)


def test_packing_edges(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "a"), (None, "no id"), (5, "word " * 30_000), (6, "x" * 70_000 + " y." * 50_000), (7, "日本語 " * 40_000), (8, "<|endoftext|> and a\x1cb, İ. " * 4000), (9, "don't... we,. 3.14½")]
    pieces = packing.pack_documents(spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, length string, worker int"), tokenizer_spec()).collect()
    assert sorted(pieces[0].asDict()) == sorted(["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    check_packing(pieces, texts, tokenizer, 4096)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_spec()).collect() == []
    twice = packing.pack_documents(spark.createDataFrame([(1, "same words"), (1, "same words"), (None, "x"), (None, "x")], "doc_id long, text string"), tokenizer_spec()).collect()
    assert sorted((p["doc_id"] or 0) for p in twice) == [0, 0, 1, 1]


def test_cuts_fill_their_class():
    for n in range(1, 9000):
        cuts = packing.harmonic_cuts(n)
        assert sum(cuts) == n
        assert all((4096 // c) * c >= packing.LEAST_FILL * 4096 - 1 for c in cuts)


def test_words_equal_the_library(tokenizer):
    tool = WordCodec(tokenizer_spec())
    rng = random.Random(9)
    marks = ["", " ", ".", ",", "..", "'s", "é", "ß", "3", "½", " ", "\n", "\x1c", "_", "<|", "日", "İ", "!", "-", "a", "The", "'ll"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(2000)]
    for text, ids in zip(texts, tool.encode_all(texts)):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    long = " ".join(texts)
    assert list(itertools.chain(*tool.encode_all(list(packing.stretches(long, tool, 100))))) == tokenizer.encode(long, add_special_tokens=False).ids
