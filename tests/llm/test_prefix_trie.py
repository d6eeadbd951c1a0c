"""The trie of conversations against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wardflow.llm import op11_prefix_trie as op11

CONVERSATIONS = "conv_id long, turn long, role string, text string, place long, depth string, fp int"


def conversation_rows():
    draw = random.Random(3)
    rows = []
    for conv_id in [*range(0, 12), *range(100, 140), 205, 300, 399, -7, -100, -203]:
        for turn in range(draw.randint(1, 7)):
            rows.append((conv_id, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "é😀"])))
    rows += [(None, 0, "user", "no conversation"), (500, None, None, None), (500, 0, "user", "late"), (500, None, "user", "x")]
    rows += [(501, 3, "user", "twice"), (501, 3, "user", "twice"), (502, 1, "", ""), (600, 0, "user", "y" * 50_000)]
    rows += [(1000 + i, turn, "user", f"copy {turn}") for i in range(70) for turn in range(9)]
    return [(*r, 5, "clash", 1) for r in rows]


def plain_sequences(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        taken = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(first, [])[:taken] + own[c][taken:]
    return out


def plain_nodes(sequences):
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, held in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(held) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(sequences[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(held), len(key), parent, len(held), children[key], leaves[key], saved[key], digest))
    return sorted(map(str, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_nodes(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_rebuilt_trie(spark, monkeypatch, small):
    """Also with a few conversations a batch, short pieces and short id strings."""
    if small:
        for name, value in {"BATCH": 5, "PIECE_TURNS": 2, "TRIE_CELLS": 20, "_ID_BYTES": 9}.items():
            monkeypatch.setattr(op11, name, value)
    rows = conversation_rows()
    conversations = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    assert got_nodes(op11.rebuilt_trie(conversations)) == plain_nodes(plain_sequences(rows))


def test_empty_table(spark):
    assert op11.rebuilt_trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_long_conversations_cross_ranges(spark, monkeypatch):
    """A conversation with most of all turns lies in many ranges; its prefixes are those of its copy."""
    monkeypatch.setattr(op11, "PIECE_TURNS", 100)
    rows = [(c, t, "u", str(t % 7), 0, "", 0) for c in (0, 1, 100) for t in range(3000)]
    rows += [(c, t, "u", "other", 0, "", 0) for c in (2, 3) for t in range(4)]
    conversations = spark.createDataFrame(rows, CONVERSATIONS)
    sequences = op11.turns(conversations)
    marks = sequences.select("conv_id").distinct().selectExpr("conv_id", "-1L place", "0L s1", "0L s2", "0L chars")
    nodes = op11.prefix_trie(sequences.unionAll(marks))
    assert nodes.count() == 3005
    got = {(r["depth"], r["conv_id"]): r for r in nodes.collect()}
    assert got[0, 0]["n_convs"] == 5 and got[0, 0]["n_leaves"] == 2 and got[0, 0]["n_children"] == 2
    assert got[3000, 0]["n_convs"] == 3 and got[3000, 0]["ends_sha256"] == hashlib.sha256(b"0,1,100").hexdigest()
    assert got[1500, 0]["saved_tokens"] == 2 * 1501 and got[4, 2]["parent_conv_id"] == 2
    texts = op11.with_texts(nodes, sequences.selectExpr("conv_id", "place + 1 depth", "'u' role", "string(place % 7) text"))
    assert texts.where("depth = 1500 AND text = '1'").count() == 1


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert op11.two_fattest(low, high) == best


@pytest.mark.parametrize("seed", range(6))
def test_z_fast_trie(seed):
    """Counts of every prefix, and exit nodes found by the handles alone."""
    draw = random.Random(seed)
    letters = "ab" if seed % 2 else "a" * 9 + "b"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    trie = op11.ZFastTrie()
    want, least = defaultdict(int), {}
    pieces = []
    for i, word in enumerate(words):
        prints = [("/" + word[:d]).encode() for d in range(len(word) + 1)]
        pieces.append(op11.Piece(0, prints, [0, *[1] * len(word)], i, True))
        for p in prints:
            want[p] += 1
            least.setdefault(p, i)
    at = 0
    while at < len(pieces):
        size = draw.randint(1, 50)
        trie.insert(pieces[at : at + size])
        at += size
    for word in words:
        piece = op11.Piece(0, [("/" + word[:d]).encode() for d in range(len(word) + 1)], [], 0, True)
        node = trie.locate(piece)
        assert node.extent == len(word) and node.piece.at(node.extent) == piece.prints[-1]
    got = {fp: (n, first) for fp, _, _, n, first, _ in trie.rows()}
    assert got == {p: (n, least[p]) for p, n in want.items()}
