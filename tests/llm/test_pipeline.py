"""Each stage of the pipeline against brute force, row by row, on a table with every odd case."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from terrafold.llm import quality_rules
from terrafold.llm.bpe import read_ranks
from tests.llm.test_operators import alnum_words, brute_contamination, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, stays boolean, _id long, carried string"


def _docs():
    rnd = random.Random(9)
    prose = lambda k: " ".join(rnd.choice(["the", "of", "und", "la"]) if rnd.random() < 0.3 else f"w{rnd.randrange(4000)}" for _ in range(k))
    passage, test = prose(20), prose(15)
    long, near = prose(4000), prose(80)
    edited = words(near)
    edited[40] = "EDITED"
    texts = [prose(rnd.randrange(55, 120)) for _ in range(25)]
    texts += [None, "", " \n\t ", "too short", "# $ % & " * 60, ("stop " * 80).strip(), "!? " * 40 + prose(30), "\n".join(["the same line of words"] * 40)]
    texts += [long, near, " ".join(edited), near.upper(), near, passage + " " + prose(60), prose(60) + " " + passage, prose(50) + "\n" + passage + "\n" + prose(10), prose(60) + " " + test + " " + prose(20), prose(40) + " " + passage + " " + passage]
    rows = list(enumerate(texts, 10))
    rnd.shuffle(rows)
    rows += [rows[0], rows[0], (rows[1][0], prose(70)), (None, prose(70)), (None, near + " more"), (None, passage + " " + prose(70)), (None, None)]
    rows += [(None, rows[-3][1])]
    return rows, [(1, test), (2, "a b"), (None, prose(12)), (4, None)]


def _kept_by_rules(text):
    t, w = text or "", words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    count = lambda cs: sum(c in cs for c in t)
    return (
        200 * len(w) <= 100 * sum(map(len, w)) <= 1500 * len(w)
        and 100 * count("#*$%&|<>") <= 10 * len(w)
        and 100 * count("!?") <= 50 * len(w)
        and 100 * (len(lines) - len(set(lines))) <= 50 * len(lines)
        and 100 * sum(x.lower() in quality_rules.STOP_WORDS for x in w) >= len(w)
    )


def _first(i):
    return (i is None, i or 0)


def _one_of_each_group(rows):
    rows = sorted(set(rows), key=lambda r: (_first(r[0]), r[1] or ""))
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return [r for k, r in enumerate(rows) if group[k] == k]


def _without_passages(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, (True, 1)), _first(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < _first(i) for j in range(13)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows, items = _docs()
    full = [(i, t, "en", "s", None if t is None else len(t), 7, True, 8, "c") for i, t in rows]
    spark.createDataFrame(full, COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _rows(frame):
    return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=lambda r: (_first(r[0]), r[1] or ""))


def test_every_stage_row_by_row(spark, folder):
    rows, items = _docs()
    own = lambda x: sorted(x, key=lambda r: (_first(r[0]), r[1] or ""))
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    contaminated = lambda x: {i for i, (_, n, _) in brute_contamination(dict(enumerate(t for _, t in x)), items).items() if n}
    want = [own(r for r in rows if _kept_by_rules(r[1]))]
    want.append(own(_one_of_each_group(want[-1])))
    want.append(own(_without_passages(want[-1])))
    want.append(own(r for k, r in enumerate(want[-1]) if k not in contaminated(want[-1])))
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[3]) and want[2] != want[1]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        frame = corpus_pipeline.stored(stage(spark, frame, folder), "test")
        assert frame.columns == columns, name
        assert _rows(frame) == expected, name
        assert all(r.n_chars == len(r.text) and (r.row, r._id, r.carried) == (7, 8, "c") for r in frame.collect()), name
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    told = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    ids = [(i, known.encode_ordinary(t), t) for i, t in want[-1]]
    assert told == sorted(((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids), key=str)


@pytest.mark.parametrize("k", range(4))
def test_stages_on_rows_that_no_stage_before_has_cleaned(spark, folder, monkeypatch, k):
    """Null, empty, repeated and very long texts reach each stage; so do empty tables and tables without further columns."""
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", 0)
    rows, items = _docs()
    frame = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    name, stage = corpus_pipeline.STAGES[k]
    got = _rows(stage(spark, frame, folder))
    if k == 1:
        empty = [r for r in set(rows) if not words(r[1])]
        want = [*_one_of_each_group([r for r in rows if words(r[1])]), *empty]
    else:
        hit = {i for i, (_, n, _) in brute_contamination(dict(enumerate(t for _, t in rows)), items).items() if n}
        want = {0: [r for r in rows if _kept_by_rules(r[1])], 2: _without_passages(rows), 3: [r for i, r in enumerate(rows) if i not in hit]}[k]
    assert got == sorted(want, key=lambda r: (_first(r[0]), r[1] or "")), name
    assert stage(spark, frame.limit(0), folder).count() == 0
    assert any(alnum_words(t) for _, t in got)
