"""Filter audit, packing and conversation repair, against brute force and odd tables."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrafold.llm import chat_repair, filter_audit, packing, queries
from terrafold.llm.chat_repair import Turn
from tests.conftest import SF

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, source string, mask int, digest string"


# filter audit


def brute_audit(rows, labels):
    """(part, order, step) to counts; rows are (doc_id, text, source)."""
    out = {}
    failed = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        f["E"] = doc_id is not None and any((t or "") == text and d is not None and d < doc_id for d, t, _ in rows)
        own = [x for x in labels if x[0] is not None and x[0] == doc_id]
        failed.append((source or "", {k for k in f if f[k]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {x[0] for x in failed}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                earlier, counts = set(order[:k]), [0] * 6
                for p, f, good, toxic in failed:
                    if p == part:
                        here = c in f and not f & earlier
                        counts = [n + int(x) for n, x in zip(counts, (not f & {*earlier, c}, here, c in f and bool(f & earlier), f == {c}, here and good, here and toxic))]
                shapley[c] += counts[1]
                out[part, "".join(order), k + 1] = counts
        out |= {key: [*v, shapley[key[1][key[2] - 1]]] for key, v in out.items() if key[0] == part}
    return out


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], DOCS)
    made = filter_audit.audited(filter_audit.histograms(filter_audit.masks(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, n long")))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in made.collect()}


def test_audit_of_odd_documents_is_brute_force(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [(1, clean, "a"), (2, clean, "b"), (3, clean, "a"), (3, clean, "a"), (None, clean, "a"), (4, None, None), (5, "", ""), (6, "A B C", "a"), (7, "same " * 70, "b"), (8, clean + " #", "b"), (9, clean + "é" * 3, None)]
    rows += [(10, ("WORD " + clean + " ") * 300, "a"), (10, "other", "a"), (None, None, "b")]
    labels = [(1, 1, 0, 5), (3, 0, 1, 5), (3, 1, None, 5), (None, 1, 1, 5), (99, 1, 1, 5), (6, None, 1, 5), (10, 1, 0, 5)]
    got = audit(spark, rows, labels)
    assert len(got) == 3 * 600
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audit(spark, [], []) == {}


def test_audit_with_a_hot_text_and_other_filters(spark):
    rows = [(k, "same text", "a") for k in range(3000)] + [(k, "same text", "b") for k in range(1500)]
    got = audit(spark, rows, [])
    assert got["a", "EABCD", 1][:2] == [1, 2999] and got["b", "EABCD", 1][:2] == [1, 1499]
    few = filter_audit.audited(spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 0, 0)], "part string, mask int, n long, good long, toxic long"), "XY").collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in few) == [("XY", 1, 2, 5, 0, 5), ("XY", 2, 2, 0, 5, 5), ("YX", 1, 2, 5, 0, 5), ("YX", 2, 2, 0, 5, 5)]
    with pytest.raises(ValueError):
        filter_audit.audited(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "")


def test_outcomes_of_five_filters_are_32_by_600():
    orders, by = filter_audit.outcomes(5)
    assert len(orders) == 120 and all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    assert ((by["kept"] + by["removed"] + by["redundant"]) <= 1).all()


# packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check_pieces(rows, texts, tokenizer, longest):
    """texts: by the number of the row."""
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.length <= longest and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            if "ids" in rows[0]:
                assert r.ids == ids[at : at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)


def test_packing_query_is_the_tokenizers_library_cut_up(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pieces(queries.op12_packing(spark, SF).collect(), texts, tokenizer, 2048)


def test_each_token_is_encoded_as_itself(tokenizer):
    # then the merge of two tokens never depends on which two they are, and both libraries merge alike
    encoder = packing.Tokens(open(PATH, encoding="utf-8").read(), PATTERN)
    kept = [(t, k) for t, k in encoder.fast._mergeable_ranks.items()]
    texts = {k: t.decode("utf-8", "ignore") for t, k in kept if t.decode("utf-8", "ignore").encode() == t}
    whole = [k for k, t in texts.items() if len(re.findall(r".+", t, re.S)) and tokenizer.encode(t, add_special_tokens=False).ids == [k]]
    assert len(whole) == len(texts)
    assert all(encoder.ids(t).tolist() == [k] for k, t in texts.items())


def test_packing_odd_documents(spark, tokenizer, tmp_path):
    odd = [None, "", " ", "a", "x" * 5000, "word " * 9000, "a  <|endoftext|> b", " " * 1_000_000, "é\U0001f600中" * 100, "tab\tnew\nline"]
    rows = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(odd)], "doc_id long, text string, ids string, length int")
    got = packing.packed(rows, PATH, PATTERN, 64, carry_ids=True)
    check_pieces(got.collect(), dict(enumerate(odd)), tokenizer, 64)
    assert [(r.length, r.doc_tokens) for r in got.where("doc_id < 2").collect()] == [(1, 1), (1, 1)]
    packing.write_buckets(got, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert sorted((r.sequence_id, tuple(r.ids)) for r in back.collect()) == sorted((r.sequence_id, tuple(r.ids)) for r in got.collect())


def test_packing_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, "d")], "doc_id long, text string")
    got = packing.packed(rows, PATH, PATTERN).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and len(got) == 2 * 2 + 3
    assert packing.packed(rows.limit(0), PATH, PATTERN).collect() == []
    with pytest.raises(ValueError):
        packing.packed(rows, PATH, PATTERN, 100)


def test_lengths_are_the_binary_form():
    for n in range(1, 300):
        assert sum(packing.lengths(n, 64)) == n
        assert packing.lengths(n, 64)[n // 64 :] == [1 << k for k in range(5, -1, -1) if n % 64 >> k & 1]


# conversation repair


def brute_repair(turns):
    """The least (cost, audit) of all edits of a few turns, outcomes judged by the pattern alone."""
    best = None

    def go(at, out, cost, audit, row):
        nonlocal best
        if best is not None and cost > best[0] or row > 2:
            return
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        for c in "ua":
            go(at, out + c, cost + 3, audit + "I", row + 1)
        if at < len(turns):
            t = turns[at]
            go(at + 1, out, cost + 4, audit + "D", 0)
            if not t.must_go:
                more = 3 * t.truncated
                go(at + 1, out + t.initial, cost + more, audit + "K", 0)
                for c in "ua":
                    go(at + 1, out + c, cost + 3 + more, audit + "R", 0)

    best = (sum(4 for _ in turns), "D" * len(turns))
    go(0, "", 0, "", 0)
    return best


def some_turns(rng, n):
    return [Turn(rng.choice("suaat "), gone := rng.random() < 0.3, not gone and rng.random() < 0.4, 1) for _ in range(n)]


def test_search_is_brute_force():
    rng = random.Random(1)
    for _ in range(250):
        turns = some_turns(rng, rng.randint(1, 4))
        assert next(iter(chat_repair.search(turns, chat_repair.NONE, finish=True).values())) == brute_repair(turns)


def test_blocks_and_ranges_give_what_one_search_gives():
    rng = random.Random(2)
    for _ in range(300):
        turns = some_turns(rng, rng.randint(1, 24))
        (_, want), *_ = chat_repair.search(turns, chat_repair.NONE, finish=True).values()
        k, h = rng.randint(1, 6), rng.randint(1, 4)
        blocks = [turns[i : i + k] for i in range(0, len(turns), k)]
        assert "".join(chat_repair.solve(lambda: iter(blocks))) == want
        ranges, sides = [blocks[i : i + h] for i in range(0, len(blocks), h)], []
        for own in ranges:
            costs = [chat_repair.Costs.of(b) for b in own]
            for c in costs[1:]:
                costs[0] = costs[0].then(c)
            sides.append(costs[0])
        kinds = chat_repair.borders(sides, chat_repair.NONE, [0, 6, 3, 0])
        ends = [*kinds[1:-1], None]
        assert "".join("".join(chat_repair.solve(lambda: iter(own), a, b)) for own, a, b in zip(ranges, kinds, ends)) == want


def repair_of(rows):
    """What the contract asks of one conversation's rows (turn, role, text), by a search of all of them at once."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, turns = set(), []
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        again, broken = (role, text) in seen, kept[-1:] not in (".", "!", "?")
        seen.add((role, text))
        blank, duplicate, truncated = blank + (not kept), duplicate + bool(kept and again), truncated + bool(kept and not again and broken)
        turns.append(Turn(role[:1], not kept or again, bool(kept and not again and broken), 1))
    (cost, audit), *_ = chat_repair.search(turns, chat_repair.NONE, finish=True).values()
    initials = [r[1][:1] for r in rows]
    at, lines = 0, []
    for e in audit:
        if e in "KRI":
            first_system = bool(lines) and lines[0][0][:1] == "s"
            role = rows[at][1] if e == "K" else ("user", "assistant")[(len(lines) - first_system) % 2]
            lines.append((role, "" if e == "I" else rows[at][2]))
        at += e != "I"
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()


def repair(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, n int")
    turns, found = chat_repair.repaired(frame)
    lines = {r.conv_id: r for r in chat_repair.digests(turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, lines[r.conv_id].cost, lines[r.conv_id].audit, lines[r.conv_id].repaired_sha256) for r in found.collect()}


@pytest.mark.parametrize("block", [4, 256])
def test_repair_of_odd_and_long_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    rng = random.Random(3)
    texts = ["Yes.", "No!", "and then", "Why? ", "", " \t", None, " ", "été."]
    roles = ["user", "assistant", "system", "tool", None, "", "Usher"]
    rows = [(None, k, "user", "Yes.") for k in (None, 5, 5, -3)] + [(0, 1, "assistant", "")] + [(1, 2, "user", "ok.")] * 7 + [(2, None, None, None)]
    rows += [(9, 4, "user", "same."), (9, 4, "user", "same."), (9, 4, "assistant", "b."), (9, 2**62, "user", "far."), (9, -(2**61), "user", "near.")]
    rows += [(10, k, ("user", "assistant")[k % 2], f"turn {k}" + rng.choice([".", "", " ", "?"])) for k in range(500) if rng.random() < 0.95]
    rows += [(10, k, rng.choice(roles), rng.choice(texts)) for k in range(0, 900, 7)]
    rows += [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(11, 40) for _ in range(rng.randint(1, 9))]
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    want = {c: repair_of(r) for c, r in by.items()}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == want


def test_repair_of_nothing(spark):
    assert repair(spark, []) == {}


def test_heuristic_never_overstates_and_never_falls_by_more_than_a_step():
    turns = some_turns(random.Random(4), 50)
    left = chat_repair.least_costs(turns)
    for k, t in enumerate(turns):
        cheapest = 4 if t.must_go else 3 * t.truncated
        assert 0 <= left[k] - left[k + 1] <= cheapest
