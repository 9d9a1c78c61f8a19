"""Queries against their SQL at the smallest size, and the pipeline end to end."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import license_scan, queries, sharding
from terrafold.llm.bpe import read_ranks
from tests.conftest import SF
from tests.llm.test_operators import brute_licenses

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(agree, name):
    agree(queries.queries()[name], SQL[name])


def test_bpe_query_agrees_with_tiktoken(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_byte_level_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_license_query_agrees_with_all_rules(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rules = license_scan.signatures()
    rows = queries.op8_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        places, base, labels, score, n_words = brute_licenses(texts[r.doc_id], rules)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n_words, len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels, r.score) == (",".join(base), ",".join(labels), score)


def test_sharding_query_is_a_plain_feistel_network(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keys = docs.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("crc"))
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "crc"), F.lit(sharding.BUCKETS))).collect()
    count = len(keys)
    width = max(1, ((count - 1).bit_length() + 1) // 2)

    def network(x):
        left, right = x >> width, x & ((1 << width) - 1)
        for k, (m, a) in enumerate(sharding.ROUNDS):
            y = (right * m + (a + k) % 2**31) % 2**31
            y = ((y ^ (y >> 15)) * 1274126177) % 2**31
            left, right = right, left ^ ((y ^ (y >> 13)) & ((1 << width) - 1))
        return left << width | right

    want = {}
    for number, r in enumerate(sorted(keys, key=lambda r: (r.bucket, r.doc_id, r.size, r.crc))):
        place = network(number)
        while place >= count:
            place = network(place)
        want[r.doc_id] = (r.size, r.crc, place % 24, place // 24)
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in queries.op10_sharding(spark, SF).collect()} == want


def test_url_query_by_rules_and_one_verdict_for_equal_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op6_url_filter(spark, SF).collect()
    assert len(rows) == len(pages)
    verdicts = {}
    for r in rows:
        rest = (pages[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in queries.URL_RULES if (host == (h := x.pattern.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + x.pattern.partition("/")[2])]
        best = max(fits, key=lambda x: len(x.pattern), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.pattern)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")
        verdicts.setdefault(pages[r.page_id], set()).add(r.verdict)
    assert all(len(v) == 1 for v in verdicts.values())


def test_url_query_has_the_rules_of_its_contract(spark, tmp_path):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/8", "http://www.EXAMPLE.net/de/81?q", "http://b.net/de/", "http://a.org/es/x", "http://a.org/de/x", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    rules = ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "net/de/", "org/es/"]
    assert got == dict(enumerate((r, words[r]) for r in rules)) | {6: (None, "allow"), 7: (None, "allow")}


def test_pipeline_keeps_clean_documents_and_whole_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before, name
        before = docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == before
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    long = spark.read.parquet(f"{SF}/documents.parquet").where("size(split(text, ' ')) > 60").join(good, "doc_id")
    assert long.join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0
