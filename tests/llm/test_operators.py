"""The ten operators against plain loops, on rows with every odd case and on the smallest table."""

import base64
import hashlib
import itertools
import os
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import FOLDER, PASSAGE, edge_rows, prose
from wardflow.llm import (
    op1_resharding,
    op2_quality_rules,
    op3_sentence_spans,
    op4_license_scan,
    op5_best_fit_packing,
    op6_byte_bpe,
    op7_html_labeller,
    op8_fingerprints,
    op9_token_files,
    op10_ngram_join,
)
from wardflow.llm.components import components
from wardflow.llm.tables import rank_in_blocks
from wardflow.llm.tokens import BLANKS_PATTERN, Encoder
from wardflow.session import materialize

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [" ", "  ", "\n", "\t", "\r\n", " ", "'s", "'", "Don't", "<|endoftext|>", "ΣΑΣ", "é", "é", "İ", "漢字", "12", "½", "😀", "\x1c", "A", "b", "!?", "ing"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def tokenizer(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return whole


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 9))) for _ in range(n)]


# Shared helpers


@pytest.mark.parametrize("path, cut, width", [(BYTE_BPE, "blanks", 4), (WORD_BPE, "words", 2)])
def test_encoder_is_the_tokenizer(path, cut, width):
    whole, own = tokenizer(path), Encoder(path, cut, width, most_kept=50)
    for text in [*odd_texts(3000), *(x[1] or "" for x in edge_rows())]:
        assert array("HHHI"[width - 1], own.encode(text)).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ranks_in_blocks(spark):
    df = spark.createDataFrame([(k, b, i, i + 1) for i, (k, b) in enumerate(itertools.product("aab", range(4)))], "k string, b int, i int, v int")
    got = rank_in_blocks(df, ["k"], ["b"], ["i"], "before", F.col("v")).orderBy("k", "b", "i").collect()
    total = defaultdict(int)
    for r in got:
        assert r["before"] == total[r["k"]]
        total[r["k"]] += r["v"]


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    label = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if x in got} and set(label) - set(got) <= {5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: resharding


def test_flow_moves_the_fewest_bytes():
    draw = random.Random(2)
    for _ in range(200):
        supply = {s: draw.randint(0, 1000) for s in draw.sample(range(8), draw.randint(1, 6))}
        capacity = op1_resharding.equal_capacities(sum(supply.values()), draw.randint(1, 8))
        flow = op1_resharding.min_cost_flow(supply, capacity)
        assert all(sum(n for (s, _), n in flow.items() if s == old) == supply[old] for old in supply)
        assert all(sum(n for (_, t), n in flow.items() if t == new) <= capacity[new] for new in capacity)
        assert op1_resharding.moved_bytes(flow) == sum(max(0, supply[s] - capacity.get(s, 0)) for s in supply)
    with pytest.raises(ValueError):
        op1_resharding.min_cost_flow({0: 5}, {0: 4})


@pytest.mark.parametrize("name, n_shards", [("docs", 3), ("corpus", 24), ("no_docs", 2)])
def test_resharding(spark, request, name, n_shards):
    df = request.getfixturevalue(name)
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(n_shards))
    got = op1_resharding.shard_documents(spark, df, old, n_shards).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if got:
        largest = max(r["size"] for r in got)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n_shards)) <= 2 * largest


def test_resharding_writes_rows_that_stay_too(spark, docs, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    monkeypatch.setattr(op1_resharding, "scratch_path", lambda *_: path)
    got = op1_resharding.shard_documents(spark, docs, F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(3)), 3).collect()
    files = spark.read.parquet(path).select("doc_id", "shard", "slot").collect()
    assert any(r["shard"] == r["old_shard"] for r in got)
    assert Counter(tuple(r) for r in files) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got)


# 2: quality rules


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(x in "#*$%&|<>" for x in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), len(lines)


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_quality_rules(request, name):
    df = request.getfixturevalue(name)
    got = op2_quality_rules.judge(df).collect()
    want = Counter()
    for doc_id, text in pairs_of(df):
        n, chars, symbols, dup, repeated, lines = measures(text)
        failed = n < 50 or 100 * repeated > 50 * n
        kept = not failed and 5 * symbols <= n and 2 * dup <= lines and 2 * n <= chars <= 12 * n
        want[doc_id, n, chars, symbols, dup, repeated, failed, kept] += 1
    assert Counter(tuple(r)[:8] for r in got) == want
    kept = op2_quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(n for x, n in want.items() if x[-1])


def test_rules_are_ordered_by_rejections_per_second():
    a, b, c = (op2_quality_rules.Rule(x, lambda facts: False) for x in "abc")
    measured = [("a", 100, 10, 1.0), ("b", 100, 50, 10.0), ("c", 100, 9, 0.1)]
    assert [r.name for r in op2_quality_rules.order_rules([a, b, c], measured)] == ["c", "a", "b"]


def test_cascade_stops_at_the_first_rejection():
    asked = []
    rule = lambda name, answer: op2_quality_rules.Rule(name, lambda facts: asked.append(name) or answer)
    assert op2_quality_rules.first_rejection(op2_quality_rules.Facts("x"), [rule("a", False), rule("b", True), rule("c", True)]) == "b"
    assert asked == ["a", "b"]


# 3: repeated passages


def plain_dedup(pairs):
    """Texts by (doc_id, text), every span compared with every other."""
    firsts, every = {}, []
    for doc_id, text in sorted({(i if i is not None else -1, t) for i, t in pairs}):
        parts = op3_sentence_spans.sentences(text)
        assert "".join(parts) == text
        lengths = [len(p.strip()) for p in parts]
        found = set()
        enough = lambda a, b: b - a + 1 >= 2 and sum(lengths[a : b + 1]) >= 100
        for a in range(len(parts)):
            b = next((b for b in range(a, len(parts)) if enough(a, b)), None)
            found |= {(a, b)} if b is not None else set()
            c = next((c for c in range(a, -1, -1) if enough(c, a)), None)
            found |= {(c, a)} if c is not None else set()
        for a, b in sorted(found):
            key = tuple(p.strip() for p in parts[a : b + 1])
            every.append((doc_id, text, a, b, key))
            firsts[key] = min(firsts.get(key, (doc_id, text, a)), (doc_id, text, a), key=lambda x: (x[0], x[2]))
    out = {}
    for doc_id, text, a, b, key in every:
        gone = out.setdefault((doc_id, text), set())
        if firsts[key] != (doc_id, text, a):
            gone |= set(range(a, b + 1))
    return {k: "".join(p for i, p in enumerate(op3_sentence_spans.sentences(k[1])) if i not in gone) for k, gone in out.items()}


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_repeated_passages(request, name):
    df = request.getfixturevalue(name)
    got = op3_sentence_spans.remove_repeated(df.withColumn("was", F.col("text")))
    assert got.columns == [*df.columns, "was"] and got.count() == df.count()
    left = plain_dedup([p for p in pairs_of(df) if p[0] is not None])
    for r in got.collect():
        if r["doc_id"] is not None and r["was"] is not None:
            assert r["text"] == left.get((r["doc_id"], r["was"]), r["was"])
            assert r["n_chars"] == len(r["text"])
        if r["was"] is None:
            assert r["text"] is None


def test_passage_stays_once(docs):
    got = {r["doc_id"]: r for r in op3_sentence_spans.deduplicated(docs).collect()}
    assert PASSAGE.split(".")[3] in got[11]["text"] and got[11]["n_removed"] == 0
    assert PASSAGE.split(".")[3] not in got[12]["text"] and got[12]["n_removed"] >= 5
    assert got[16]["n_removed"] == 0


def plain_words(seed, n):
    return re.sub(r"[.!?\n ]+", " ", prose(seed, n)).lower().split()


def test_borders_are_the_lowest_hash_of_every_window():
    draw, width = random.Random(5), op3_sentence_spans.WINDOW
    for _ in range(500):
        hashes = [draw.randrange(draw.choice([1, 3, 1000])) for _ in range(draw.randint(0, 60))]
        windows = (range(s, s + width) for s in range(len(hashes) - width + 1))
        assert op3_sentence_spans.borders(hashes) == sorted({max(w, key=lambda i: (-hashes[i], i)) for w in windows})


@pytest.mark.parametrize("around", ["sentence", "unpunctuated", "inside", "commas", "unspaced"])
def test_long_passages_without_two_sentences(spark, around):
    """Of a repeat of 50 to 60 words at most WINDOW - 1 at either end stay, wherever its sentences end."""
    made, passages = [], {}
    for i in range(20):
        words = plain_words(500 + i, 50 + i % 11)
        before, after = plain_words(600 + i, 7 + i), plain_words(700 + i, 30 - i)
        other_before, other_after = plain_words(800 + i, 31 - i), plain_words(900 + i, 5 + i)
        whole = " ".join(words)
        if around == "commas":
            whole = ", ".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6))
        if around == "unspaced":
            draw = random.Random(i)
            words = [chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(150)]
            whole = "".join(words[:70]) + "\u3002" + "".join(words[70:])
        if around == "inside":  # its sentence ends once, the fragments are merged with other text
            words[25 + i % 5] += "."
            whole = " ".join(words)
        start, end = (". ", ".") if around == "sentence" else (" ", " ")
        made.append((2 * i, " ".join(before) + start + whole + end + " ".join(after)))
        made.append((2 * i + 1, " ".join(other_before) + start + whole + end + " ".join(other_after)))
        passages[2 * i], passages[2 * i + 1] = whole, whole
    got = dict(op3_sentence_spans.deduplicated(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "text").collect())
    least = op3_sentence_spans.WINDOW
    for i, (doc_id, text) in enumerate(made):
        if doc_id % 2 == 0:
            assert got[doc_id] == text
            continue
        units = list(passages[doc_id]) if around == "unspaced" else passages[doc_id].split(" ")
        glue = "" if around == "unspaced" else " "
        middle = [glue.join(units[k : k + 3]) for k in range(least, len(units) - least - 2)]
        assert not [x for x in middle if x in got[doc_id]], doc_id
        if around == "sentence":
            assert units[0] + glue + units[1] not in got[doc_id]
        outside_before, outside_after = text.split(passages[doc_id])
        assert got[doc_id].startswith(outside_before.strip()) and got[doc_id].endswith(outside_after.lstrip(". "))


# 4: licenses


def test_license_scan_finds_every_planted_template():
    prepared = op4_license_scan.prepare(op4_license_scan.TEMPLATES)
    draw = random.Random(3)
    for name, text in op4_license_scan.TEMPLATES.items():
        for _ in range(5):
            words = prose(draw.random(), draw.randint(0, 400)).split(" ")
            at = draw.randint(0, len(words))
            planted = " ".join([*words[:at], text, *words[at:]])
            found = [x for x in op4_license_scan.find(planted, prepared) if x[0] == name]
            before = len(re.findall(r"\w+", " ".join(words[:at])))
            assert [(x[1], x[3]) for x in found] == [(before, 1.0)], name


def test_license_scan_containment(docs, no_docs):
    prepared = op4_license_scan.prepare({"t": prose(9, 60)})
    words = prose(9, 60).split(" ")
    for changed, expected in ((3, True), (30, False)):
        text = " ".join(words[:20] + ["x"] * changed + words[20 + changed :])
        own = set(zip(*[re.findall(r"\w+", text.lower())[i:] for i in range(5)]))
        template = set(zip(*[re.findall(r"\w+", prose(9, 60).lower())[i:] for i in range(5)]))
        share = len(own & template) / len(template)
        assert (share >= 0.8) == expected
        assert [x[3] for x in op4_license_scan.find(text, prepared)] == ([share] if expected else [])
    assert [r["doc_id"] for r in op4_license_scan.scan(docs).collect()] == [16]
    assert op4_license_scan.scan(no_docs).count() == 0


def test_the_version_of_a_license_counts():
    prepared = op4_license_scan.prepare(op4_license_scan.TEMPLATES)
    names = lambda text: {x[0] for x in op4_license_scan.find(text, prepared)}
    templates = op4_license_scan.TEMPLATES
    for name in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"):
        assert names(f"One. {templates[name]} Two.") == {name}
    assert names("licensed under the GNU General Public License, version 2.") == {"gpl-2.0-short"}
    assert names("licensed under the GNU General Public License, version 1.") == set()
    assert names("x // SPDX-License-Identifier: GPL-3.0-or-later") == {"spdx-gpl-3.0"}
    assert names("# SPDX-License-Identifier: MIT") == {"spdx-mit"}
    assert names(templates["apache-2.0"].replace("http:", "https:")) == {"apache-2.0", "apache-2.0-short"}
    assert names(templates["apache-2.0"].replace("2.0", "1.1")) == set()


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_license_scan_against_a_loop(request, name):
    """Every window of every template, compared word by word."""
    df, want = request.getfixturevalue(name), Counter()
    templates = {x: re.findall(r"\w+", text.lower()) for x, text in op4_license_scan.TEMPLATES.items()}
    for doc_id, text in pairs_of(df):
        words = re.findall(r"\w+", text.lower())
        matches = []
        for license, own in templates.items():
            k = min(5, len(own))
            grams = [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]
            there = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            if not set(grams) & set(there):
                continue
            half = next(2**i for i in range(20) if 2**i >= len(grams))
            versions = [set(grams[max(0, i - k + 1) : i + 1]) for i, w in enumerate(own) if any(c.isdigit() for c in w)]
            stretches = []
            for begin in range(0, len(there), half):
                at = [i for i in range(begin, min(begin + 2 * half, len(there))) if there[i] in grams]
                inside = {there[i] for i in at}
                share = len(inside) / len(set(grams))
                if share >= (0.8 if len(set(grams)) >= 10 else 1) and all(v & inside for v in versions):
                    if stretches and at[0] <= stretches[-1][1]:
                        a, b, before = stretches[-1]
                        stretches[-1] = (a, max(b, at[-1] + k - 1), max(before, share))
                    else:
                        stretches.append((at[0], at[-1] + k - 1, share))
            matches.extend((license, *stretch) for stretch in stretches)
        for match in matches:
            if not any(x[1] <= match[1] and x[2] >= match[2] and x[3] > match[3] for x in matches):
                want[doc_id, *match] += 1
    assert Counter(rows(op4_license_scan.scan(df))) == want
    assert want or name != "corpus"


def test_long_texts_are_scanned_whole(monkeypatch):
    prepared = op4_license_scan.prepare(op4_license_scan.TEMPLATES)
    monkeypatch.setattr(op4_license_scan, "_PIECE", 256)
    text = " ".join([prose(1, 900), op4_license_scan.TEMPLATES["mit"], prose(2, 700), op4_license_scan.TEMPLATES["bsd"]])
    assert {x[0] for x in op4_license_scan.find(text, prepared)} == {"mit", "bsd"}


# 5: packing


def fewest(sizes, capacity):
    """Exact minimum by trying all assignments."""
    sizes = sorted(sizes, reverse=True)
    for n in range(1, len(sizes) + 1):
        def place(i, bins):
            if i == len(sizes):
                return True
            return any(
                place(i + 1, (*bins[:b], left - sizes[i], *bins[b + 1 :]))
                for b, left in enumerate(bins) if left >= sizes[i] and left not in bins[:b]
            )
        if place(0, (capacity,) * n):
            return n
    return 0


def test_bin_completion_finds_the_fewest():
    draw = random.Random(6)
    for _ in range(60):
        capacity = draw.choice([10, 30, 100])
        sizes = [draw.randint(1, capacity) for _ in range(draw.randint(0, 9))]
        plan = op5_best_fit_packing.bin_completion(Counter(sizes), capacity)
        used = Counter()
        for times, pattern in plan:
            assert sum(size * n for size, n in pattern) <= capacity
            for size, n in pattern:
                used[size] += times * n
        assert used == Counter(sizes)
        assert op5_best_fit_packing.plan_size(plan) == fewest(sizes, capacity) >= op5_best_fit_packing.lower_bound(Counter(sizes), capacity)


def test_bin_completion_beats_best_fit():
    # Best-fit decreasing needs five sequences here, four are enough.
    counts = Counter([6, 5, 4, 4, 3, 3, 3, 2, 2, 2, 2, 2, 2])
    best_fit = op5_best_fit_packing.best_fit_decreasing(Counter([5, 4, 4, 3, 2, 2]), 10)
    assert op5_best_fit_packing.plan_size(best_fit) >= op5_best_fit_packing.plan_size(op5_best_fit_packing.bin_completion(Counter([5, 4, 4, 3, 2, 2]), 10)) == 2
    assert op5_best_fit_packing.plan_size(op5_best_fit_packing.bin_completion(counts, 10)) == 4


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    got = op5_best_fit_packing.pack(df, BYTE_BPE, keep_ids=True).collect()
    whole = tokenizer(BYTE_BPE)
    want, pieces = Counter(), defaultdict(list)
    for doc_id, text in pairs_of(df):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        at = piece = 0
        while at < len(ids):
            n = 1024 if at or len(ids) % 1024 == 0 else len(ids) % 1024
            want[doc_id, piece, at, n, zlib.crc32(array("I", ids[at : at + n]).tobytes())] += 1
            at, piece = at + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(pieces) <= -(-sum(r["length"] for r in got) // 1024) * 1.02 + 1


def test_sequences_hold_their_pieces(docs):
    placed = op5_best_fit_packing.pack(docs, BYTE_BPE, keep_ids=True)
    by_sequence = defaultdict(list)
    for r in placed.collect():
        by_sequence[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    for r in op5_best_fit_packing.sequences(placed).collect():
        assert bytes(r["ids"]) == b"".join(x for _, x in sorted(by_sequence[r["sequence_id"]]))


# 6: byte-level BPE


def reference_bpe():
    import base64

    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_exact():
    own, reference = op6_byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN, most_cached=100), reference_bpe()
    draw = random.Random(5)
    made = ["".join(draw.choice("abcdeinort") for _ in range(draw.randint(1, 80))) for _ in range(1500)]
    for text in [*odd_texts(3000), *made, "a" * 3000, *(x[1] or "" for x in edge_rows() if len(x[1] or "") < 6000)]:
        ids = own.encode(text)
        assert array("I", ids).tolist() == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize(
    "pattern",
    [r"\p{N}{1,3}|[^\s\p{N}]+|\s+", r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s+(?!\S)|\s+"],
)
def test_byte_bpe_takes_any_pattern(pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = op6_byte_bpe.ByteBPE(RANKS, pattern)
    for text in ["year 123456 DON'T", "It's 2024, isn't it?\n\n  über 1234567", *odd_texts(300)]:
        assert array("I", own.encode(text)).tolist() == reference.encode_ordinary(text)


def test_the_shortcut_of_the_encoder_is_for_the_registered_pattern():
    assert public_tokenizers.PATTERN == BLANKS_PATTERN


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_byte_bpe_digests(request, name):
    df, reference = request.getfixturevalue(name), reference_bpe()
    want = Counter()
    for doc_id, text in pairs_of(df):
        ids = reference.encode_ordinary(text)
        want[doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(rows(op6_byte_bpe.byte_bpe_digests(df, RANKS, public_tokenizers.PATTERN))) == want
    encoded = op6_byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    decoded = op6_byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)
    assert Counter((i, bytes(x).decode()) for i, x in rows(decoded)) == Counter(pairs_of(df))


# 7: web pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x = "</p>"; }</script><style>p{}</style></head>
<body><header><div class="logo">Site</div></header><nav><ul><li><a href=/a>Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies. <button>Accept</button></div>
<article><h1>Über &amp; unter</h1><p>First   paragraph of <b>bold</b> text<br>goes on.<p>Second one &lt;here&gt; &#8364;5.
<div class="ad">Buy now!</div><p>Third.</p></article>
<section class="comments"><div class="comment">I disagree with all of this.</div></section>
<footer>&copy; Nobody</footer></body>"""


@pytest.fixture(scope="module")
def labeller(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables not available")
    return op7_html_labeller.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_blocks():
    found = [b.text for b in op7_html_labeller.blocks(PAGE)]
    assert found[:4] == ["Site", "Home", "News", "We use cookies."] and "First paragraph of bold text goes on." in found
    assert "Second one <here> €5." in found and "Über & unter" in found and "T" not in found
    for odd in (None, "", "<", "<p", "plain", "</p></div>", "<p><b>x</p>y", "<!-- never closed", "<script>open"):
        op7_html_labeller.blocks(odd)
    assert [b.text for b in op7_html_labeller.blocks("a<p>b<p>c")] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT type='a'>if (a<b && c>d) s = \"<p>no\";</Script >",
        "<script><!-- hidden\nf(1)</script>",
        "<style>a:after{content:'<!--'}</style>",
        "<select><option>one<option selected>two</select>",
        "<form><select><option>one<option>two</form>",
        "<datalist><option>one<option>two</datalist>",
        "<svg><path d='M0 0'>",
    ],
)
def test_what_stands_before_an_article_does_not_eat_it(before):
    page = f"<body>{before}<article><p>First text.</p><p>Second text.</p></article><script>g()</script></body>"
    assert [b.text for b in op7_html_labeller.blocks(page)] == ["First text.", "Second text."]


@pytest.mark.parametrize(
    "unit, n_blocks",
    [
        ("<p title=\"x '", 1), ('<b "', 1), ("<b", 1), ("b", 1), ("<b><p>x</p>", None), ("<b><div></b>", 0),
        ("<noscript>", 0), ("<!-", 0), ("<p><i>", 0), ("x<script>", 1),
    ],
)
def test_hard_pages_take_linear_time(unit, n_blocks):
    times = 2_500_000 // len(unit)
    begin = time.monotonic()
    found = op7_html_labeller.blocks("<" + unit * times if unit == "b" else unit * times)
    assert time.monotonic() - begin < 20
    assert len(found) == (times if n_blocks is None else n_blocks)


def test_tag_ends_against_a_loop():
    draw = random.Random(4)
    for _ in range(2000):
        page = "".join(draw.choices("<>\"'a ", k=draw.randint(1, 30)))
        ends = op7_html_labeller._TagEnds(page)
        for place in sorted(draw.sample(range(len(page)), draw.randint(1, len(page)))):
            quote, want = "", -1
            for at in range(place, len(page)):
                if quote:
                    quote = "" if page[at] == quote else quote
                elif page[at] in "\"'":
                    quote = page[at]
                elif page[at] == ">":
                    want = at + 1
                    break
            assert ends.find(place) == want


def test_formulas_are_text():
    page = (
        "<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup>"
        "<annotation encoding='x'>E=mc^2</annotation></math> holds.</p>"
    )
    assert [b.text for b in op7_html_labeller.blocks(page)] == ["So E=mc2 holds."]


def test_main_text(labeller):
    assert op7_html_labeller.main_texts([PAGE, None, "", "<p></p>"], labeller) == [
        "Über & unter\nFirst paragraph of bold text goes on.\nSecond one <here> €5.\nThird.", "", "", "",
    ]


def test_labeller_on_held_out_layouts(spark, labeller):
    pages = [r["html"] for r in spark.read.parquet(f"{os.path.dirname(FOLDER)}/sf0.01/pages.parquet").collect()]
    sequences, labels = op7_html_labeller.training_set(pages, seed=77)
    scores = labeller.scores(op7_html_labeller.Features(sequences)) > 0.5
    assert (scores == np.concatenate(labels)).mean() > 0.99


def test_links_in_the_text_stay_and_boundaries_go_whatever_their_name(labeller):
    text = ["Rivers of the north", "There are many rivers in the north, and these are the longest ones of them."]
    links, last = ["The Great River", "The Long River", "Another river of note"], "They all flow to the sea in the end."
    page = f"""<body><nav><a href=/>Home</a></nav><article><h1>{text[0]}</h1><p>{text[1]}</p><ul>
        {"".join(f"<li><a href=/x>{link}</a></li>" for link in links)}</ul><p>{last}</p></article><div class="bottom">Copyright 2020</div></body>"""
    unknown = f"""<body><div class="top"><a href=/>Home</a><a href=/n>News</a></div><div class="content"><h1>{text[0]}</h1>
        <p>{text[1]}</p><p>{last}</p></div><div class="zz"><p>Copyright 2020</p></div></body>"""
    assert op7_html_labeller.main_texts([page, unknown], labeller) == [
        "\n".join([*text, *links, last]), "\n".join([*text, last]),
    ]


def test_gradients():
    sequences, labels = op7_html_labeller.training_set([PAGE] * 2, seed=3)
    features, labels = op7_html_labeller.Features(sequences), np.concatenate(labels)
    model = op7_html_labeller.Labeller(3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    _, grads = model.gradients(features, labels)
    for name, grad in grads.items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        weight, around = model.weights[name], []
        for step in (1e-3, -1e-3):
            weight[at] += step
            around.append(model.gradients(features, labels)[0])
            weight[at] -= step
        assert abs((around[0] - around[1]) / 2e-3 - grad[at]) < 1e-3 * max(0.02, abs(grad[at])), name


def test_extract(spark, labeller):
    schema = "page_id long, url string, html string, text string, n_chars int"
    made = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (2, None, None, None, None), (None, "v", "", "y", 2)]
    got = op7_html_labeller.extract(spark.createDataFrame(made, schema), labeller)
    text = "Über & unter\nFirst paragraph of bold text goes on.\nSecond one <here> €5.\nThird."
    assert Counter(rows(got)) == Counter(
        {(1, "u", text, len(text)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1}
    )
    empty = spark.createDataFrame([], schema)
    assert op7_html_labeller.extract(empty, op7_html_labeller.fit(empty)).count() == 0


# 8: fingerprints


def plain_tokens(text):
    runs = re.findall(r"[^ \t-\r]+", text)
    return [token for run in runs for token in ([run] if len(run) <= 16 else run)]


def plain_fingerprint(text):
    """(hash, place) of the rightmost least hash of every window, by a plain loop."""
    hashed = [xxhash.xxh64_intdigest(token.encode(), 42) for token in plain_tokens(text)]
    if len(hashed) < op8_fingerprints.K:
        whole = 42
        for value in hashed:
            whole = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), whole)
        return [(whole >> 33, 0)] if hashed else []
    grams = []
    for at in range(len(hashed) - op8_fingerprints.K + 1):
        gram = 0
        for value in hashed[at : at + op8_fingerprints.K]:
            gram = ((gram << 1 | gram >> 63) & (1 << 64) - 1) ^ value
        grams.append((gram >> 33, at))
    windows = [grams[i : i + op8_fingerprints.W] for i in range(max(1, len(grams) - op8_fingerprints.W + 1))]
    return sorted({min(window, key=lambda x: (x[0], -x[1])) for window in windows}, key=lambda x: x[1])


def plain_likeness(one, other):
    one, other = {x for x, _ in plain_fingerprint(one)}, {x for x, _ in plain_fingerprint(other)}
    return len(one & other) / len(one | other) if one | other else 1.0


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_fingerprints(request, name):
    df = request.getfixturevalue(name)
    got = op8_fingerprints.compare_edited(df).collect()
    assert len(got) == df.count()
    whole = sorted(pairs_of(df), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    want = defaultdict(list)
    for at, (doc_id, text) in enumerate(whole):
        cut = len(text) // 3
        following = whole[(at + 1) % len(whole)][1]
        want[doc_id].append((len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    counts = Counter(doc_id for doc_id, _ in whole)
    prints = {}
    texts = dict(whole)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if counts[r["doc_id"]] == 1:
            assert want[r["doc_id"]] == [(r["n_chars"], r["edited_sha256"])]
            assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
            assert bool(r["fingerprint"]) == bool(plain_tokens(texts[r["doc_id"]]))


@pytest.mark.parametrize("name", ["docs", "corpus"])
def test_fingerprints_against_a_loop(request, name):
    """Minima, places and likeness of every text, its edited text and the next one, by plain loops."""
    df = request.getfixturevalue(name)
    got = op8_fingerprints.compare_edited(df).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # Rows of equal doc_id go by the hash of their text.
    key = lambda x: (x[0] is not None, x[0] or 0, signed(xxhash.xxh64_intdigest(x[1].encode(), 42)))
    whole = sorted(pairs_of(df), key=key, reverse=True)
    written = lambda text: " ".join(f"{x:X}@{place}" for x, place in plain_fingerprint(text))
    want = []
    for at, (doc_id, text) in enumerate(whole):
        cut, following = len(text) // 3, whole[(at + 1) % len(whole)][1]
        edited = text[: len(text) - cut] + following[:cut]
        want.append((doc_id, written(text), written(edited), plain_likeness(text, edited), plain_likeness(text, following)))
    names = ("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert Counter(tuple(r[x] for x in names) for r in got) == Counter(want)


@pytest.mark.parametrize("offset", [0, 1, 7])
def test_unspaced_passages_match_at_any_offset(spark, offset):
    draw = random.Random(offset)
    signs = lambda n: "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(n))
    shared = signs(60)
    pair = [(1, signs(40) + shared + signs(30)), (2, signs(40 + offset) + shared + signs(50))]
    made = spark.createDataFrame(pair, "doc_id long, text string")
    found = op8_fingerprints.fingerprints(made).select(op8_fingerprints.hashes(F.col("fingerprint")).alias("h")).collect()
    assert len(set(found[0]["h"]) & set(found[1]["h"])) >= (60 - 2) // op8_fingerprints.W - 1


def test_winnowing_keeps_the_rightmost_minimum_of_every_window(spark, docs):
    got = docs.select("text", op8_fingerprints.winnow(F.col("text")).alias("f")).collect()
    mask = (1 << 32) - 1
    for r in got:
        tokens = plain_tokens(r["text"] or "")
        places = [mask - (x & mask) for x in r["f"]]
        hashes = {p: x >> 32 for p, x in zip(places, r["f"])}
        n = len(tokens) - op8_fingerprints.K + 1
        assert places == sorted(places)
        if n > 0:  # every window has a kept place: the match guarantee
            assert all(any(a <= p < a + op8_fingerprints.W for p in places) for a in range(max(1, n - op8_fingerprints.W + 1)))
            grams = defaultdict(set)
            for p in places:
                grams[tuple(tokens[p : p + op8_fingerprints.K])].add(hashes[p])
            assert all(len(x) == 1 for x in grams.values())
    repeated = next(r for r in got if r["text"] and r["text"].startswith("word word"))
    assert [mask - (x & mask) for x in repeated["f"]] == list(range(5, 2998))


# 9: token files


@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_token_files(spark, request, name):
    df, whole = request.getfixturevalue(name), tokenizer(WORD_BPE)
    got = op9_token_files.token_files(spark, df, WORD_BPE).collect()
    want, start = [], 0
    for doc_id, text in sorted(pairs_of(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    key = lambda x: x[1]
    assert sorted(map(tuple, got), key=key) == want


def test_token_files_on_disk(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = op9_token_files.write_token_files(docs, folder, WORD_BPE, "words", 49_408, 2)
    for r in manifest.collect():
        ids = op9_token_files.mapped(f"{folder}/{r['name']}.ids", "<u2")
        offsets = op9_token_files.mapped(f"{folder}/{r['name']}.off", "<u8")
        assert len(ids) == r["n_tokens"] and len(offsets) == r["n_docs"] + 1
        assert offsets[0] == r["base"] and offsets[-1] == r["base"] + r["n_tokens"]
        assert all(ids[int(x - r["base"]) - 1] == 2 for x in offsets[1:])


def test_token_files_of_many_batches(spark, docs, tmp_path):
    """A part of several batches keeps the number of its partition in the manifest."""
    folder, kept = f"file://{tmp_path}/tokens", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        manifest = op9_token_files.write_token_files(docs, folder, WORD_BPE, "words", 49_408, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len({r["part"] for r in manifest}) == len(manifest) and sum(r["n_docs"] for r in manifest) == docs.count()
    assert all(r["name"].startswith(f"{r['part']:06d}-") for r in manifest)


# 10: n-gram join


def plain_components(pairs, n, num, den):
    sets = {}
    for doc_id, text in pairs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        k = min(n, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    label = {x: x for x in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {x: (len(sets[x]), root(x)) for x in sets}


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
@pytest.mark.parametrize("name", ["docs", "corpus", "no_docs"])
def test_ngram_join(request, name, n, num, den):
    df = request.getfixturevalue(name)
    similarity = op10_ngram_join.Similarity(n, num, den)
    got = op10_ngram_join.jaccard_components(df, similarity).collect()
    assert len(got) == df.count()
    want = plain_components([p for p in pairs_of(df) if p[0] is not None], n, num, den)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] < 0
    kept = op10_ngram_join.keep_one(df, similarity)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(x for x in ids if x is not None) == Counter({x: 1 for x, (_, first) in want.items() if x == first})
    assert sum(x is None for x in ids) == len({r["text"] for r in df.collect() if r["doc_id"] is None})


def test_group_of_near_copies(spark):
    """Copies with a change each, a common passage and a chain: links are neither lost nor invented."""
    draw = random.Random(8)
    base, made = prose(50, 120).split(" "), []
    for i in range(150):
        words = list(base)
        for _ in range(draw.choice([1, 1, 2, 4, 9])):
            words[draw.randrange(len(words))] = f"w{draw.random()}"
        made.append((1000 + i, " ".join(words)))
    for i in range(40):
        made.append((2000 + i, PASSAGE + " " + prose(100 + i, draw.choice([3, 10, 60]))))
    chain = prose(60, 130).split(" ")
    for i in range(20):
        made.append((3000 - i, " ".join(chain[i * 2 : 90 + i * 2])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    for n, num in ((3, 90), (5, 80)):
        got = op10_ngram_join.jaccard_components(df, op10_ngram_join.Similarity(n, num, 100)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(made, n, num, 100)

def near_group(seed, n_rows, n_words):
    draw = random.Random(seed)
    base, made = prose(seed, n_words).split(" "), []
    for i in range(n_rows):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3, 4])):
            words[draw.randrange(len(base))] = f"w{draw.random()}"
        made.append((i, " ".join(words)))
    return made


def test_many_texts_of_one_id(spark, monkeypatch):
    """Texts of one id are rows of their own in the product, whose columns are not multiplied with each other."""
    texts = [text for _, text in near_group(70, 60, 120)]
    made = [(i % 3 if i < 45 else 100 + i, text) for i, text in enumerate(texts)]
    made += made[:20] + [(7, prose(71, 90)), (7, prose(72, 90)), (8, prose(72, 90))]
    written = Counter()

    def counted(df, label, *folders):
        out = materialize(df, label, *folders)
        written[label] = max(written[label], out.count())
        return out

    monkeypatch.setattr(op10_ngram_join, "materialize", counted)
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = op10_ngram_join.jaccard_components(df, op10_ngram_join.Similarity(3, 90, 100)).collect()
    alone = plain_components(list(enumerate(text for _, text in made)), 3, 90, 100)
    label = {doc_id: doc_id for doc_id, _ in made}
    for _ in label:
        for row, (_, first) in alone.items():
            a, b = made[row][0], made[first][0]
            label[a] = label[b] = min(label[a], label[b])
    want = Counter((doc_id, alone[row][0], label[doc_id]) for row, (doc_id, _) in enumerate(made))
    assert Counter(map(tuple, got)) == want
    assert 0 < written["cells"] <= written["prefix-columns"]


def test_all_rows_are_counted(spark):
    """How common an n-gram is comes from all rows, however many there are."""
    made = [(i, f"alpha beta w{i // 2}") for i in range(24_000)]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("_key", F.col("doc_id"))
    classes = op10_ngram_join._common_buckets(df, op10_ngram_join.Similarity(3, 90, 100))
    grams = np.concatenate([op10_ngram_join.gram_hashes(text, 3) for _, text in made[::2]])
    counted = classes[op10_ngram_join._buckets(grams)]
    assert counted.min() > 0
    assert np.count_nonzero(classes) == len(np.unique(op10_ngram_join._buckets(grams)))


def test_any_order_of_columns(spark, monkeypatch):
    made = near_group(90, 50, 120)
    drawn = np.random.default_rng(5).integers(0, 30, 1 << op10_ngram_join._SKETCH_BITS).astype(np.uint8)
    monkeypatch.setattr(op10_ngram_join, "_common_buckets", lambda docs, similarity: drawn)
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = op10_ngram_join.jaccard_components(df, op10_ngram_join.Similarity(3, 90, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(made, 3, 90, 100)


@pytest.mark.parametrize("turns, pairs_a_cell, first", [(1, 0, (1,)), (3, 0, (1, 2)), (1, 0, ())])
def test_small_portions_of_the_product(spark, monkeypatch, turns, pairs_a_cell, first):
    """Groups cut into parts, pairs left for later and further turns give the same links."""
    made = near_group(80, 60, 110) + [(200 + i, text) for i, text in near_group(81, 30, 140)]
    for name, value in (("_TURNS", turns), ("_PAIRS_A_CELL", pairs_a_cell), ("_PAIRS_FIRST", first), ("_GROUP_ROWS", 3)):
        monkeypatch.setattr(op10_ngram_join, name, value)
    monkeypatch.setattr(op10_ngram_join, "_ENTRIES_AT_ONCE", 700)
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = op10_ngram_join.jaccard_components(df, op10_ngram_join.Similarity(3, 90, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(made, 3, 90, 100)
