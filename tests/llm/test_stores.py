"""URL rules, WARC and the token store."""

import collections
import gzip
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketscope.llm import token_store, url_filter, warc
from ticketscope.llm.queries import END_ID, TOKENIZER
from ticketscope.session import scratch_dir

PATH = public_tokenizers.path(TOKENIZER)


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), action == "block", rule, action))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    rules = (*url_filter.RULES, ("block", "example.org/a/b/c"), ("allow", "example.org/a/b/"), ("block", "bad.example"),
             ("block", "10.0.0.1/"), ("allow", "x.net/é/"))
    urls = [None, "", "no scheme", "http://", "http:///p", "HTTP://A.NET", "http://a.net/", "http://a.net?x=/", "https://www.Example.NET/en/1",
            "https://example.net/en", "https://notexample.net/en/1", "http://example.com/de/x?y#z", "http://example.com/dex",
            "http://example.org/a/b/cd/e", "http://example.org/a/b/d", "http://example.org/a//b/c", "http://sub.bad.example", "http://bad.example#f",
            "http://bad.example.com/", "http://10.0.0.1/", "http://u@10.0.0.1:80/", "ftp://x.net/é/1", "a://b://c.net/d/", "http://a..net/", "http://net./",
            "http://" + "l." * 500 + "net/" + "d/" * 5000, "http://b.org/fr/" + "é" * 1000, "http://b.org/\nfr/", "http://a.net/", None]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, digest string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: plain_judge(u, rules) for i, u in enumerate(urls)}
    no_rules = url_filter.rule_table(spark).limit(0)
    assert {r.verdict for r in url_filter.judge(pages, no_rules).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_urls_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {r.page_id: plain_judge(r.url, url_filter.RULES) for r in pages.collect()}
    assert len({g[2] for g in got.values()}) == 5


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/1", "<p>one</p>"), (1, "http://a/2", "<p>one</p>"), (2, None, "<p>one</p>"), (4, "http://a/\r\nX: y", ""), (5, "é", None),
            (None, "http://n", "<p>one</p>"), (None, "http://n", "lonely"), (6, "u", "ünïcode\r\n\r\nWARC/1.1\r\n" * 3000), (7, "u", "twice"), (7, "v", "twice")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_warc_round_trip(spark, pages):
    path = scratch_dir(spark, "warc-test")
    warc.write_pages(pages, path)
    got = collections.Counter(tuple(r) for r in warc.read_pages(spark, path).collect())
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = collections.defaultdict(list)
    for i, p in rows:
        if i is not None:
            first[p].append(i)
    want = collections.Counter()
    for i, p in rows:
        low = min(first[p], default=None)
        want[(i, len(p), warc.base32_sha1(p), "response" if i == low else "revisit", None if i == low else low)] += 1
    assert got == want
    whole = spark.read.format("warc").load(path).filter("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in whole} == {p for _, p in rows}


def test_warc_pushdown_and_plans(spark, pages):
    path = scratch_dir(spark, "warc-test")
    warc.write_pages(pages.coalesce(1), path)
    reader = warc.WarcReader(spark.read.format("warc").load(path).schema, {"path": path, "partition_bytes": "1"})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    kept = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert [type(f) for f in kept] == [GreaterThan]
    assert reader.tests == [("record_type", "in", ("revisit",))]
    assert all(len(p.names) <= 1 for p in reader.partitions())
    n = spark.read.format("warc").load(path).filter("record_type = 'revisit' and target_uri = 'http://a/1'").count()
    assert n == 1


def test_warc_reads_other_writers(spark, tmp_dir):
    rec = warc.record({"record_id": "urn:x", "record_type": "response", "target_uri": "http://x", "refers_to": None, "payload_digest": None,
                       "payload_length": 3, "payload": b"abc"})
    with open(f"{tmp_dir}/a.warc.gz", "wb") as f:  # members without lengths
        f.write(gzip.compress(rec) + gzip.compress(rec.replace(b"urn:x", b"urn:y")))
    with open(f"{tmp_dir}/b.warc", "wb") as f:
        f.write(rec.replace(b"urn:x", b"urn:z") * 2)
    warc.register(spark)
    got = sorted((r.record_id, bytes(r.payload)) for r in spark.read.format("warc").load(tmp_dir).collect())
    assert got == [("urn:x", b"abc"), ("urn:y", b"abc"), ("urn:z", b"abc"), ("urn:z", b"abc")]
    light = spark.read.format("warc").schema("record_id string").load(tmp_dir)
    assert sorted(r.record_id for r in light.collect()) == ["urn:x", "urn:y", "urn:z", "urn:z"]


def test_warc_empty(spark, pages):
    path = scratch_dir(spark, "warc-test")
    warc.write_pages(pages.limit(0), path)
    assert warc.read_pages(spark, path).count() == 0


RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def warc_rows(n, first=0):
    return [(f"urn:x:{first + i}", "response", f"http://h/{i}", None, None, None, f"payload {first + i} ".encode() * (i + 1)) for i in range(n)]


def written(spark, rows, path, mode="append"):
    warc.register(spark)
    spark.createDataFrame(rows, RECORD).coalesce(1).write.format("warc").mode(mode).save(path)


def read_back(spark, path, columns=RECORD, **options):
    return {r.record_id: r for r in spark.read.format("warc").schema(columns).options(**options).load(path).collect()}


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "w")
    written(spark, warc_rows(10), path)
    written(spark, warc_rows(5, 10), path)
    got = read_back(spark, path)
    assert {k: bytes(r.payload) for k, r in got.items()} == {r[0]: r[6] for r in warc_rows(10) + warc_rows(5, 10)}
    written(spark, warc_rows(3, 100), path, "overwrite")
    assert set(read_back(spark, path)) == {"urn:x:100", "urn:x:101", "urn:x:102"}
    written(spark, warc_rows(1, 200), path)
    assert len(read_back(spark, path)) == 4
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 2


def as_dict(row):
    return dict(zip(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "payload"), row))


def fails(spark, path, *words, columns=RECORD, **options):
    with pytest.raises(Exception) as e:
        read_back(spark, path, columns, **options)
    assert all(w in str(e.value) for w in words), str(e.value)[-1500:]


def test_warc_damage_is_found(spark, tmp_path):
    """Files cut off or changed in the middle raise an error that names file and offset."""
    warc.register(spark)
    data = [warc.record(as_dict(r)) for r in warc_rows(3)]
    members = [warc.member(d) for d in data]
    plain_members = [gzip.compress(d) for d in data]
    light = "record_id string"
    for name, whole, cuts in (("a.warc.gz", members, len(members[0]) + len(members[1]) // 2), ("b.warc.gz", plain_members, len(plain_members[0]) + 60),
                              ("c.warc", data, len(data[0]) + len(data[1]) - 30), ("d.warc.gz", members, len(members[0]) + 5),
                              ("e.warc", data, len(data[0]) + 20)):
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_bytes(b"".join(whole))
        assert len(read_back(spark, str(folder))) == 3 and len(read_back(spark, str(folder), light)) == 3
        (folder / name).write_bytes(b"".join(whole)[:cuts])
        for columns in (RECORD, light):
            fails(spark, str(folder), name, "offset", columns=columns)
    folder = tmp_path / "changed"
    folder.mkdir()
    changed = warc.record(as_dict(warc_rows(1, 7)[0]) | {"payload_digest": "A" * 32})
    (folder / "f.warc.gz").write_bytes(members[0] + warc.member(changed))
    fails(spark, str(folder), "f.warc.gz", f"offset {len(members[0])}", "digest")
    assert len(read_back(spark, str(folder), verify="false")) == 2
    (folder / "f.warc.gz").write_bytes(members[0] + b"garbage that is no member")
    fails(spark, str(folder), "f.warc.gz", f"offset {len(members[0])}")
    (folder / "f.warc.gz").unlink()
    (folder / "g.warc").write_bytes(data[0] + b"NOT A RECORD\r\n\r\n" + data[1])
    fails(spark, str(folder), "g.warc", f"offset {len(data[0])}")


def test_warc_foreign_members(spark, tmp_path):
    """Several records in a member, and records over several members."""
    warc.register(spark)
    rows = warc_rows(4)
    data = b"".join(warc.record(as_dict(r)) for r in rows)
    for name, content in (("one", gzip.compress(data)), ("two", gzip.compress(data[:700]) + gzip.compress(data[700:])),
                          ("ends", gzip.compress(data + b"\r\n\r\n")), ("mixed", warc.member(warc.record(as_dict(rows[0]))) + gzip.compress(data[len(warc.record(as_dict(rows[0]))):]))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc.gz").write_bytes(content)
        assert {k: bytes(r.payload) for k, r in read_back(spark, str(folder)).items()} == {r[0]: r[6] for r in rows}, name
        assert len(read_back(spark, str(folder), "record_id string")) == 4


@pytest.fixture(scope="module")
def enc():
    return token_store.WordEncoder(PATH)


ODD = ["don't I'll 'sup''s", "Über ÉCOLE straße", "a\u0301b e\u0301", "x\u00a0y\u2003z\u0085w\x1cq", "<|endoftext|>a <|startoftext|>", "½²³ ١٢ 12ab34", "İıǅ ΣΑΣ",
       "日本語 テキスト", "😀👍🏽", "a_b__c--d", "\u0301start \u0301", "ﬁ Å", "<b>x</b>", "`~!@#$%^&*()", "\ufeffbom", "ªº"]


@pytest.mark.parametrize("text", ODD)
def test_pieces_encode_as_whole(enc, text):
    assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="aAbß éÉ'\"<|>.,!12 \n\tsn", max_size=60))
def test_any_text_encodes_as_whole(text):
    enc = token_store.encoder(PATH)
    assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded():
    enc = token_store.WordEncoder(PATH, limit=50)
    text = " ".join(f"Word{i}" for i in range(500))
    assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc.young) <= 25 and len(enc.old) <= 25
    assert enc.piece(b"word499") and b"word499" in enc.young


def whole(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def each(enc, texts):
    return [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_all(pa.array(texts, pa.string()), END_ID).to_pylist()]


def test_batches_encode_as_whole(enc):
    texts = [*ODD, None, "", " \t\n", "à la.Carte, Être à\xa0b. c,d e.. f.,g it's. <|ENDOFTEXT|> A.B", "<|ENDOFTEXT|> Word. <|endoftext|>Word.\nX", "a.\x1cb A.\x0bB", *ODD]
    expected = [whole(enc, t) + [END_ID] for t in texts]
    assert each(enc, texts) == expected
    assert enc.encode_all(pa.array(["x"] * 3 + texts).slice(3), END_ID).to_pylist() == enc.encode_all(pa.array(texts), END_ID).to_pylist()
    assert each(enc, []) == [] and each(enc, [None]) == [[END_ID]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbZßéÉàİ'\"<|>.,!12 \n\t\x1c\xa0sn", max_size=40), max_size=4))
def test_any_batch_encodes_as_whole(texts):
    enc = token_store.encoder(PATH)
    assert each(enc, texts) == [whole(enc, t) + [END_ID] for t in texts]


def test_another_tokenizer_file(tmp_path):
    """A file of other rules is not encoded by the short cuts."""
    import json
    said = json.load(open(PATH, encoding="utf-8"))
    said["normalizer"] = None
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(said))
    assert token_store.known_rules(PATH) and not token_store.known_rules(str(other))
    enc = token_store.WordEncoder(str(other))
    texts = ["Some Words, here.", "SHOUTING", None]
    assert each(enc, texts) == [whole(enc, t) + [END_ID] for t in texts]
    assert each(enc, texts[:2]) != each(token_store.encoder(PATH), texts[:2])


def huffman_cost(counts):
    import heapq
    h = [int(c) for c in counts]
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        a = heapq.heappop(h) + heapq.heappop(h)
        cost += a
        heapq.heappush(h, a)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=60), st.integers(6, 40))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = token_store.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
    if limit >= len(counts):
        assert (lengths * counts).sum() == huffman_cost(counts)


def test_length_limit_binds():
    counts = np.array([2**i for i in range(30)])
    assert token_store.code_lengths(counts, 40).max() == 29
    short = token_store.code_lengths(counts, 6)
    assert short.max() == 6 and sum(2.0 ** -int(x) for x in short) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=1500), st.integers(9, 20))
def test_codec_round_trip(ids, limit):
    ids = np.array(ids)
    used, counts = np.unique(ids, return_counts=True)
    book = token_store.Codebook(used, token_store.code_lengths(counts, limit))
    payload, points = book.encode(ids)
    assert token_store.decode(payload, points, len(ids), book.table(), book.longest).tolist() == ids.tolist()
    # a block by itself, from its checkpoint
    k = len(points) - 1
    tail = token_store.decode(payload, points[k:], len(ids) - k * token_store.BLOCK, book.table(), book.longest)
    assert tail.tolist() == ids[k * token_store.BLOCK:].tolist()


@pytest.mark.parametrize("segment_ids", [1 << 20, 300])
def test_token_store(spark, docs, odd, segment_ids):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    for df in (docs, odd):
        path = scratch_dir(spark, "tokens-test")
        token_store.write_tokens(df, path, PATH, END_ID, segment_ids=segment_ids)
        got = sorted((tuple(r) for r in token_store.read_tokens(spark, path, with_ids=True).collect()), key=lambda r: r[1])
        ids = {}
        for r in df.select("doc_id", "text").collect():
            ids.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [END_ID])
        start = 0
        order = [r[0] for r in got]
        assert order == sorted(order, key=lambda d: (d is not None, d))
        for doc, at, n, crc, own in got:
            assert at == start and n == len(own) and own in ids[doc]
            ids[doc].remove(own)
            assert crc == zlib.crc32(np.array(own, "<u4").tobytes())
            start += n
        assert not any(ids.values())


def test_token_store_empty(spark, none):
    assert token_store.token_table(none, PATH, END_ID).count() == 0
