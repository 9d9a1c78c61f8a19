"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex as re_any
import tiktoken
from pyspark.sql import functions as F

from terrafold.llm import bpe, chat_format, decontaminate, lean, license_scan, ngram_join, quality_rules, sharding, storage, substring_dedup, url_filter, warc
from terrafold.llm.storage import new_dir

SPACE = " \t\n\x0b\x0c\r"


def words(text, lower=False):
    text = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def corpus(seed=1, n=60):
    """Prose with copies, near copies, shared passages, and every odd case."""
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "the", "of", "and", "x,", "y."]
    prose = lambda k: " ".join(rnd.choice(vocabulary) + (str(rnd.randrange(40)) if rnd.random() < 0.7 else "") for _ in range(k))
    passage = prose(20)
    texts = [None, "", " \n\t ", "one", "one two three", prose(3000), "same same same " * 40]
    while len(texts) < n:
        kind = rnd.randrange(5)
        if kind == 0 and len(texts) > 8:
            texts.append(rnd.choice(texts[7:]))
        elif kind == 1 and len(texts) > 8:
            one = words(rnd.choice(texts[7:]))
            one[rnd.randrange(len(one))] = "CHANGED"
            texts.append("  ".join(one))
        elif kind == 2:
            texts.append(prose(rnd.randrange(5, 40)) + "\n" + passage + "\n" + prose(rnd.randrange(0, 30)))
        else:
            texts.append(prose(rnd.randrange(1, 120)))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


EXTRA = "key long, row long, bucket int, words string, text2 string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that have the names operators use inside."""
    rows = [(i, t, 1, 2, 3, "w", "t") for i, t in corpus()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


def test_stored_tables_go_when_told(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"{tmp_path}/apart")
    assert storage.stored(spark.range(3), "numbers").count() == 3 and Path(f"{tmp_path}/apart").exists()
    storage.clear(spark)
    assert not Path(f"{tmp_path}/apart").exists()


def test_bytes_of_settings():
    assert [lean.as_bytes(x) for x in ("67108864b", "64m", "64MB", " 2 g", "17", "-1", "4k")] == [1 << 26, 1 << 26, 1 << 26, 2 << 30, 17, -1, 4096]


def test_quality_rules(docs, empty):
    texts = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = quality_rules.judged(docs, carry=docs.columns).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t, w = texts[r.carried.doc_id] or "", words(texts[r.carried.doc_id])
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)} if len(w) < 500 else None
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if repeated is not None:
            assert r.n_repeat_words == len(repeated)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judged(empty).where("kept").count() == 0
    assert quality_rules.judged(docs).where("kept").count() == sum(r.kept for r in rows)


def brute_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("limits", [{}, {"SMALL": 2, "BLOCK": 3, "MOST_BROADCAST": 0}])
def test_ngram_join(docs, empty, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    texts = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == brute_groups(texts)
    if not limits:
        assert ngram_join.similar_groups(empty).count() == 0


def test_ngram_join_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " more"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(rows).collect()), key=str)
    assert got == sorted([(5, 26, 5), (5, 26, 5), (None, 26, 5), (7, 27, 5), (None, 0, None)], key=str)


def brute_cut(texts, n=13):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in texts.items():
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("bucket_bytes, part_bytes", [(48 << 20, 1 << 40), (200, 1 << 40), (3000, 2000)])
def test_substring_dedup(docs, empty, bucket_bytes, part_bytes):
    texts = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = substring_dedup.deduplicated(docs, carry=docs.columns, bucket_bytes=bucket_bytes, part_bytes=part_bytes).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text or "") for r in rows}
    assert got == brute_cut(texts)
    assert all(r.carried.key == 1 for r in rows)
    assert all((r.kept_text is None) == (texts[r.doc_id] is None) for r in rows)
    assert substring_dedup.deduplicated(empty).count() == 0


def test_substring_dedup_every_alignment(spark):
    """A shared window is found wherever it starts in either text."""
    passage = " ".join(f"p{k}" for k in range(13))
    filler = lambda i, k: " ".join(f"f{i}x{j}" for j in range(k))
    rows = [(i, f"{filler(i, i % 9)} {passage} {filler(i + 100, 5)}") for i in range(30)]
    rows += [(40, rows[3][1]), (40, "another text of the same id"), (None, rows[4][1])]
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        expected = 0 if r.doc_id == 0 or (r.doc_id == 40 and r.n_words == 6) else r.n_words if r.doc_id in (None, 40) else 13
        assert r.n_removed == expected, r


@pytest.mark.parametrize("part_bytes", [1 << 40, 500])
def test_substring_dedup_null_and_repeated_ids(spark, part_bytes):
    """Null ids come last and don't remove from each other; repeated rows get equal results."""
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(None, f"a{k % 40} {passage} b{k % 40}") for k in range(400)] + [(7, f"{passage} tail")] * 30 + [(9, f"head {passage}")] * 30 + [(3, f"one {k}") for k in range(20)]
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), part_bytes=part_bytes).collect()
    told = sorted({(str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got})
    expected = {("None", 17, 15, f"a{k} b{k}") for k in range(40)} | {("7", 16, 0, f"{passage} tail"), ("9", 16, 15, "head")} | {("3", 2, 0, f"one {k}") for k in range(20)}
    assert len(got) == len(rows) and told == sorted(expected)


def brute_contamination(texts, items, n=10):
    windows = {}
    for item, t in items:
        w = alnum_words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item) if item is not None else "null")
    out = {}
    for i, t in texts.items():
        w, hit, found = alnum_words(t), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                if (g := tuple(w[k : k + size])) in windows and len(g) == size:
                    hit.update(range(k, k + size))
                    found |= windows[g]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("most_broadcast", [10**6, 0])
def test_decontamination(spark, docs, empty, most_broadcast):
    texts = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    long = next(w for w in map(alnum_words, texts.values()) if len(w) > 60)
    items = [(1, " ".join(long[5:30])), (2, " ".join(long[5:30])), (10, "THE of"), (3, None), (4, ""), (None, "one two three"), (5, " ".join(long[40:50]) + " unheard of words here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs, benchmark, carry=docs.columns, most_broadcast=most_broadcast).collect()
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in rows}
    assert got == brute_contamination(texts, items)
    assert any(x[1] for x in got.values())
    assert decontaminate.contamination(empty, benchmark).count() == 0
    none = decontaminate.contamination(docs, benchmark.limit(0)).where(F.size("spans") > 0)
    assert none.count() == 0


def test_bpe(spark, docs, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "　", "  ", "\xa0", "\x1c", "\x85", " a", "the", "'s", " 'll", "é", " é", "ß", " 漢", "😀", " 😀", "1", "-", "\t", "<|endoftext|>"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(500)] + [(900, None), (901, "a" * 30000), (902, " " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in bpe.decoded(bpe.encoded(frame, path, pattern), path, pattern).collect():
        assert r.ids == known.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert bpe.encoded(docs, path, pattern).count() == docs.count()
    assert bpe.decoded(bpe.encoded(empty, path, pattern), path, pattern).count() == 0


def test_bpe_pieces_of_any_bytes():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)

    def merged(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rnd = random.Random(4)
    tokens = list(ranks)
    for _ in range(2000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 4)))
        assert encoder._encode(piece) == merged(piece)


def test_warc(spark):
    big, small = "x" * 150, "short"
    rows = [(3, "http://a/ b\n", big), (1, None, big), (2, "http://c", small), (5, "http://d", small), (7, "http://e", None), (7, "http://e", None), (8, "u", "é" * 60), (8, "u", "é" * 60), (9, "v", "é" * 60), (None, "n", big), (10, "w", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")
    folder = new_dir(spark, "warc-test")
    manifest = warc.write_warc(pages, folder, roll_bytes=600)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    told = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert told == sorted([(3, "revisit", 1, 150), (1, "response", None, 150), (2, "response", None, 5), (5, "response", None, 5), (7, "response", None, 0), (7, "response", None, 0), (8, "response", None, 120), (8, "revisit", 8, 120), (9, "revisit", 8, 120), (None, "revisit", 1, 150), (10, "response", None, 5000)], key=str)
    for r in got:
        assert r.payload_digest in {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
    again = new_dir(spark, "warc-test")
    other = warc.write_warc(pages.repartition(3), again, roll_bytes=600)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, manifest.collect()))
    none = new_dir(spark, "warc-test")
    assert warc.write_warc(pages.limit(0), none).count() == 0 and warc.read_warc(spark, none).count() == 0


def test_warc_ids_of_any_width(spark):
    """Outlying and extreme ids, and half of all rows without an id, still make shards of a few records."""
    ids = [-(2**63), -6 * 10**18, -1, *range(3000), 6 * 10**18, 2**63 - 1]
    rows = [(i, f"http://h/{i}", f"{i} " * 40) for i in ids] + [(None, None, f"none {k} " * 30) for k in range(len(ids))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_dir(spark, "warc-test")
    manifest = warc.write_warc(pages, folder).collect()
    assert sum(r.records for r in manifest) == len(rows) and max(r.records for r in manifest) < len(rows) / 30
    got = warc.read_warc(spark, folder).collect()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(i), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    order = [r.file for r in sorted(got, key=lambda r: (r.page_id is not None, r.page_id or 0, r.payload_digest))]
    assert order == sorted(order)


def test_sharding(spark, docs, empty):
    rows = sharding.sharded(docs, 7).collect()
    texts = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    slots = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.sharded(docs.repartition(5), 7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.sharded(empty, 7).count() == 0
    hot = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(9000)))).union(spark.createDataFrame([(None, None, 0)], "doc_id long, text string, x int"))
    assert sorted(r.number for r in sharding.sharded(hot, 3).collect()) == list(range(9001))


def test_shards_hold_the_rows(spark):
    told = [(k % 40 if k % 9 else None, None if k % 11 == 0 else f"text {k % 40}", f"lang {k % 3}") for k in range(300)]
    rows = spark.createDataFrame(told, "doc_id long, text string, lang string")
    placed = sharding.sharded(rows, 7, carry=["doc_id", "text", "lang"])
    plain = lambda d: sorted(((r.doc_id, r.size, r.text_crc32, r.number, r.shard, r.slot) for r in d.collect()), key=str)
    assert plain(placed) == plain(sharding.sharded(rows, 7))
    assert sorted(map(tuple, (r.carried for r in placed.collect())), key=str) == sorted(told, key=str)
    again = sharding.sharded(rows.repartition(5), 7, carry=["doc_id", "text", "lang"])
    assert sorted(map(str, again.collect())) == sorted(map(str, placed.collect()))
    folder = new_dir(spark, "shards-test")
    sharding.write_shards(placed, folder, 7)
    assert sorted(map(tuple, spark.read.parquet(folder).select("doc_id", "text", "lang").collect()), key=str) == sorted(told, key=str)
    for shard in range(7):
        (file,) = Path(folder, f"shard={shard}").glob("*.parquet")
        slots = pq.read_table(file, partitioning=None).column("slot").to_pylist()
        assert slots == list(range(len(slots))) and len(slots) in (300 // 7, 300 // 7 + 1)


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_permutation(spark, count):
    got = [r[0] for r in spark.range(count).select(sharding.permuted(F.col("id"), count, 5)).collect()]
    assert sorted(got) == list(range(count))


def test_license_scan(spark, empty):
    texts = ["CC-BY, cc by cc by-sa 4.0 MIT License mit license", "Licensed under the GNU General Public License, version 3. Apache License 2.0; SPDX-License-Identifier: MIT License", None, "", "GNU\nGeneral_Public\tLicense gnu general public licenses", "all rights reserved. released into the public domain", "nothing here", "the mit" + " word" * 20000 + " Apache-License"]
    rows = {r.carried.doc_id: r for r in license_scan.scanned(spark.createDataFrame([(i, t, "w", "f") for i, t in enumerate(texts)], "doc_id long, text string, words string, found string"), carry=["doc_id", "words"]).collect()}
    for i, t in enumerate(texts):
        w = alnum_words(t)
        places = sorted(k for p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = sorted({x for p, x in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()})
        r = rows[i]
        assert (r.n_words, sorted(r.places), r.base_labels) == (len(w), places, labels)
        assert set(labels) <= set(r.labels) and 0 <= r.score <= 1
        spans = [(h.start, h.end) for h in r.hits or []]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)
    assert rows[1].labels == ["apache", "apache-2.0", "gpl", "gpl-3.0", "mit"] and rows[1].score == 1.0
    assert rows[5].labels == ["all-rights-reserved", "public-domain"]
    assert license_scan.scanned(empty).count() == 0


def brute_licenses(text, rules):
    """All rules whose keyword occurs, without the gate: base places, base labels, labels, score and words."""
    w = alnum_words(text)
    spans = []
    told = " " + " ".join(w) + " "
    for keyword, pattern, label, priority, score in rules:
        for m in () if keyword not in told else re_any.finditer(rf"(?<= )(?:{pattern})(?= )", told):
            start = told[: m.start()].count(" ") - 1
            spans.append((start, -(start + len(m[0].split(" "))), -priority, label, score))
    kept, end = [], -1
    for x in sorted(spans):
        if -x[1] > end:
            kept.append(x)
            end = -x[1]
    left = []
    for x in sorted(kept, key=lambda x: (x[2], x)):
        if not any(y[2] < x[2] and y[0] < -x[1] and x[0] < -y[1] for y in left):
            left.append(x)
    places = sorted(k for p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    base = {x for p, x in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
    return places, sorted(base), sorted(base | {x[3] for x in left}), max((x[4] for x in left), default=0.0), len(w)


def test_license_scan_against_all_rules_everywhere(spark):
    rnd = random.Random(2)
    rules = license_scan.signatures()
    bits = [*LICENSED, "CC BY-SA 4.0", "GNU General Public License v2", "Apache License", "mit license", "under the terms of the", "licensed under", "or later", "Version 2.0", "BSD", "spdx-license-identifier: GPL-2.0-only", "all rights reserved", "word"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 4))) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "x " * 20_000 + "Apache License 2.0"]
    frame = spark.createDataFrame([(k % 30, t, "w", "f", 1) for k, t in enumerate(texts)], "doc_id long, text string, words string, found string, base int")
    got = license_scan.scanned(frame, carry=["doc_id", "text"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (sorted(r.places), r.base_labels, r.labels, r.score, r.n_words) == brute_licenses(r.carried.text, rules), r.carried.text[:300]


def test_license_scan_resolves_partial_overlaps_by_priority(spark):
    rules = [("a", "a b c", "low", 10, 0.5), ("c", "c d e", "high", 20, 0.9), ("e", "e f", "tie-one", 20, 0.7), ("f", "f g h", "tie-two", 20, 0.6), ("g", "g", "inside", 90, 1.0), ("p", "p q r", "chain-low", 1, 0.1), ("r", "r s t", "chain-mid", 2, 0.2), ("t", "t u v", "chain-high", 3, 0.3)]
    rows = license_scan.scanned(spark.createDataFrame([(1, "a b c d e f g h licensed"), (2, "a b c x e f licensed"), (3, "p q r s t u v licensed")], "doc_id long, text string"), rules=rules).collect()
    assert {r.carried.doc_id: (r.labels, r.score) for r in rows} == {1: (["high", "tie-one", "tie-two"], 0.9), 2: (["low", "tie-one"], 0.7), 3: (["chain-high", "chain-low"], 0.3)}


LICENSED = {
    **{f"// SPDX-License-Identifier: {tag}": want for tag, want in {"MIT": "mit", "Apache-2.0": "apache-2.0", "ISC": "isc", "MPL-2.0": "mpl-2.0", "LGPL-2.1-or-later": "lgpl-2.1", "AGPL-3.0-only": "agpl-3.0", "EPL-2.0": "epl-2.0", "Zlib": "zlib", "BSL-1.0": "boost-1.0", "BSD-3-Clause": "bsd-3-clause", "CC-BY-SA-4.0": "cc-by,cc-by-sa", "(MIT OR Apache-2.0) AND Zlib": "apache-2.0,mit,zlib", "GPL-2.0-only WITH Linux-syscall-note OR BSD-2-Clause": "bsd-2-clause,gpl-2.0"}.items()},
    "Licensed under LGPL v2.1": "lgpl-2.1",
    "Affero GPL version 3": "agpl-3.0",
    "the Lesser GPL, version 2.1": "lgpl-2.1",
    "Creative Commons BY 4.0": "cc-by",
    "Creative Commons BY-NC-SA 3.0 Unported": "cc-by-nc-sa",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "https://opensource.org/licenses/MIT": "mit",
    "https://spdx.org/licenses/BSD-3-Clause.html": "bsd-3-clause",
    "see https://www.gnu.org/licenses/old-licenses/gpl-2.0.html": "gpl-2.0",
    "http://mozilla.org/MPL/2.0/": "mpl-2.0",
    "https://scripts.sil.org/OFL": "ofl-1.1",
    "subject to the terms under the MPL 2.0": "mpl-2.0",
    "Apache 2.0 license": "apache-2.0",
    "released under the Apache 2.0": "apache-2.0",
    "License: MPL-2.0": "mpl-2.0",
    'license = "ISC"': "isc",
    "available under the terms of the MIT.": "mit",
    "Apache License, v. 2.0": "apache,apache-2.0",
    "code is EPLv2": "epl-2.0",
    "Redistribution and use in source and\n * binary forms, with or without modification, are permitted": "bsd",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "Permission is hereby\n# granted, free of charge, to any person or organization obtaining a copy": "boost-1.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"": "0bsd",
    "The origin of this software must not be misrepresented; you must not claim": "zlib",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl-2.1",
    "a simple example of MPLx, an MIT professor, replied in Apache 2.0 and under ISC 9001; permission granted for a fee": "",
    "SPDX-License-Identifier: none; see zlib or mit there": "",
}


def test_license_scan_knows_tags_short_names_and_texts(spark):
    texts = list(LICENSED)
    rows = license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {texts[r.carried.doc_id]: ",".join(r.labels) for r in rows} == LICENSED
    assert all((r.score >= 0.8) == bool(r.labels) for r in rows)


def test_url_filter(spark):
    rules = [url_filter.Rule("com/en/", "block"), url_filter.Rule("example.com/en/7", "allow")]
    told = [("http://a.example.com/en/71?x#y", "a.example.com", "/en/71", "example.com/en/7", "allow"), ("https://EXAMPLE.com/en/8", "example.com", "/en/8", "com/en/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://x.com?/en/", "x.com", "", None, None), ("x.com/en/", "", "", None, None), (None, "", "", None, None), ("http://", "", "", None, None), ("http://x.com/EN/", "x.com", "/EN/", None, None)]
    labelled = spark.createDataFrame([(f"http://{'casino-' if k % 4 == 0 else ''}site{k % 9}.org/{'win/' * (k % 4 == 0)}{k}", int(k % 4 == 0)) for k in range(600)], "url string, label int")
    model = url_filter.fit(labelled)
    assert model.trees is not None
    pages = spark.createDataFrame([(k, t[0], "h") for k, t in enumerate(told)], "page_id long, url string, host string")
    got = {r.carried.page_id: r for r in url_filter.judged(pages, rules, model).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(told):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    # hosts, words and endings that the trees have not met
    held_out = spark.createDataFrame([(k, f"http://{'roulette-' if k % 4 == 0 else ''}place{k % 31}.net/{'now/' * (k % 4 == 0)}{k}") for k in range(1000, 1200)], "page_id long, url string")
    right = sum((r.verdict == "block") == (r.carried.page_id % 4 == 0) for r in url_filter.judged(held_out, [], model).collect())
    assert right >= 190
    odd = [("http://x.org/1", 2), ("HTTP://X.ORG/1", 1), ("http://x.org/" + "y/" * 50_000, 2), ("://", 3), ("", 1), (None, 2)]
    repeated = spark.createDataFrame([(k, u) for k, (u, n) in enumerate(odd) for _ in range(n)], "page_id long, url string")
    got = url_filter.judged(repeated, [url_filter.Rule("org/y/", "block"), url_filter.Rule("org/y/", "allow")], model).collect()
    assert len(got) == sum(n for _, n in odd) and len({(r.carried.page_id, r.host, r.path, r.rule, r.verdict) for r in got}) == len(odd)
    nothing = url_filter.fit(labelled.where("label = 0"))
    assert {r.verdict for r in url_filter.judged(held_out, [], nothing).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), rules, model).count() == 0


def test_url_suffix_statistics_leave_out_the_own_host(spark, monkeypatch):
    """With labels that only the host tells, the statistics a row is fitted with hold nothing of its host."""
    labelled = spark.createDataFrame([(f"http://h{h}.example.org/{k}", h % 2) for h in range(40) for k in range(5)], "url string, label int")
    made = {}
    monkeypatch.setattr(url_filter, "_with_suffixes", lambda rows, suffixes, own=url_filter._with_suffixes: made.setdefault("rows", own(rows, suffixes)))
    url_filter.fit(labelled)
    rows = made["rows"].select("host", "fold", "label", "suffix_rate", "suffix_count", "top_rate").distinct().collect()
    for r in rows:
        rest = {x.host: x.label for x in rows if x.fold != r.fold}
        n, blocked = 5 * len(rest), 5 * sum(rest.values())
        assert r.host not in rest and abs(r.suffix_rate - (blocked + 1) / (n + 2)) < 1e-9 and abs(r.suffix_count - math.log1p(n)) < 1e-9 and r.top_rate == r.suffix_rate


def test_chat_format(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 2)
    say = lambda c, *turns: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    rows = [*say(1, "a", "b"), *say(2, "a", "b", "c", "d", "e"), *say(3, "a", "b", "c", "d", "e"), *say(4, "a", "x"), *say(5, "a"), *say(6, None, "b"), *say(7, "", "b"), (None, 0, "user", "n"), (8, None, None, "t"), (8, 5, "user", "u"), (8, 5, "user", "u")]
    talk = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h1 int")
    got = chat_format.rendered(talk).collect()
    assert {r.conv_id for r in got} == {2, 4, 6, 7, 8, None}
    two = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.turn_no))
    assert two.startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n") and [r.turn_no for r in sorted(got, key=lambda r: r.turn_no) if r.conv_id == 2] == [1, 2, 3, 4, 5]
    assert [r.rendered for r in sorted((r for r in got if r.conv_id == 8), key=lambda r: r.turn_no)][0] == "<|im_start|>unknown\nt<|im_end|>\n"
    assert chat_format.rendered(talk.limit(0)).count() == 0
