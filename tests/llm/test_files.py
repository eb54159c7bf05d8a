"""Files written and read back: WARC archives, token shards, shard stores."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import spark_partition_id
from tokenizers import Tokenizer

from tidewire.llm import queries, sharding, token_shards, warc
from tidewire.llm.common import new_folder

FILE = public_tokenizers.path("byte_bpe_50k.json")
PAGES = "page_id long, url string, html string, digest string, first_id long"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    r = random.Random(5)
    body = "<html>" + "shared words " * 30 + "</html>"
    rows = [(i, f"http://h/{i} ü?x=1", r.choice([body, "short", f"<p>{i} {'text ' * r.randint(0, 400)}</p>", None, ""]), "d", 1) for i in range(300)]
    rows += [(5, rows[5][1], rows[5][2], "d", 1), (None, None, body, None, None), (901, None, "é\r\n\r\nWARC/1.1\r\n" * 20, None, None)]
    found = warc.archive_roundtrip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, url, html, *_ in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and i != first[html or ""]
        want.append((i, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(), first[html or ""] if again else None, url, None if again else raw))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.url, None if r.payload is None else bytes(r.payload))) for r in found)


def test_warc_odd_rows(spark, monkeypatch):
    """Clashing columns, URLs with percent signs, spaces and controls, payloads beyond a file, pages without an id."""
    monkeypatch.setattr(warc, "FILE_BYTES", 5_000)
    big, body = "<p>" + "x" * 20_000, "copy " * 40
    urls = ["http://a/%20x?q=a%26b", "http://a/ x\t?y", "http://a/\r\nWARC-Type: x", "http://é/日本", "", "http://a/%", '"quoted\\"', "\x00\x1f\x7f", None, "http://a/b[1]{2}|^`<>"]
    rows = [(i, u, big if i == 3 else body if i % 2 else f"p{i}", "d", i, "resp", 5, 6) for i, u in enumerate(urls)]
    rows += [(None, "u1", body, "d", 1, "r", 5, 6), (None, "u2", big + "only", "d", 1, "r", 5, 6), (None, "u3", big + "only", "d", 1, "r", 5, 6)]
    df = spark.createDataFrame(rows, PAGES.replace("first_id", "refers_to") + ", record_type string, part int, n int").repartition(2)
    found = warc.archive_roundtrip(df).collect()
    assert sorted((repr(r.page_id), repr(r.url)) for r in found) == sorted((repr(r[0]), repr(r[1])) for r in rows)
    said = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in found}
    assert said[1, urls[1]] == ("response", None) and said[5, urls[5]] == ("revisit", 1) and said[3, urls[3]] == ("response", None)
    assert said[None, "u1"] == ("revisit", 1) and said[None, "u2"] == said[None, "u3"] == ("response", None)


def test_warc_reading_tasks(spark, monkeypatch):
    """As many tasks read as there are files or partitions, and the join of copies carries no html."""
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 300) for i in range(100)], "page_id long, url string, html string").repartition(2)
    files = warc.write_archives(df, new_folder(spark, "warc"))
    assert files.count() >= 8
    records = warc.read_archives(files)
    assert {r.task for r in records.select(spark_partition_id().alias("task")).distinct().collect()} == set(range(4))


def test_warc_dictionary_of_few_records():
    for records in ([b"one record of a few words"], [bytes(range(256)) * 900] * 3, [b"long " * 60_000 + bytes([i]) for i in range(20)]):
        raw = warc.encode_file(records)
        assert int.from_bytes(raw[4:8], "little") > 0 and list(warc.decode_file(raw)) == records


def test_warc_dictionary_leads_the_file():
    records = [warc.record(i, "http://x", f"page number {i} of the same site, with common words".encode() * 3, "d", None) for i in range(400)]
    raw = warc.encode_file(records)
    assert raw[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(raw[4:8], "little") > 0
    assert list(warc.decode_file(raw)) == records
    assert len(raw) - int.from_bytes(raw[4:8], "little") < len(warc.encode_file(records[:3])) * 400 / 3
    assert list(warc.decode_file(warc.encode_file([b""]))) == [b""]


def test_warc_empty(spark):
    assert warc.archive_roundtrip(spark.createDataFrame([], PAGES)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=700))
def test_wavelet_matrix(values):
    v = np.array(values)
    built = token_shards.WaveletMatrix.build(v)
    ids, ends, matrix = token_shards.from_bytes(token_shards.to_bytes([3, None], np.array([1, len(v)]), built))
    assert ids == [3, None] and ends.tolist() == [1, len(v)]
    assert (matrix.tokens() == v).all()
    for i in {0, len(v) // 2, len(v) - 1}:
        token, before = int(v[i]), int((v[:i] == v[i]).sum())
        assert matrix.access(i) == token and matrix.count(token) == (v == token).sum()
        assert matrix.rank(token, i) == before and matrix.select(token, before) == i
        with pytest.raises(IndexError):
            matrix.select(token, matrix.count(token))
    assert matrix.count(70_001) == 0 and matrix.count(1 << 20) == 0
    with pytest.raises(IndexError):
        matrix.access(len(v))


def test_kept_stretches_are_bounded_by_size(monkeypatch):
    """Texts of one long stretch each don't pile up, and ids stay the same when a worker starts anew."""
    monkeypatch.setattr(token_shards, "CACHE_SIZE", 50_000)
    own, library = token_shards.Encoder(FILE), Tokenizer.from_file(FILE)
    for i in range(40):
        text = f"{i}x" * 2000
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert sum(len(k) + len(v) for k, v in own.cache.items()) == own.cached < 50_000 + 30_000


class Counting:
    """A tokenizer that counts the signs given to its batch calls."""

    def __init__(self, own):
        self.__dict__.update(own=own, signs=0)

    def __getattr__(self, name):
        found = getattr(self.own, name)
        if not name.startswith("encode_batch"):
            return found

        def counted(texts, **kw):
            self.__dict__["signs"] += sum(map(len, texts))
            return found(texts, **kw)

        return counted

    def __setattr__(self, name, value):
        setattr(self.own, name, value)


def test_words_with_marks_share_their_ids():
    own, library = token_shards.Encoder(FILE), Tokenizer.from_file(FILE)
    own.tokenizer = Counting(own.tokenizer)
    words = [f"w{''.join(chr(97 + i // 26**k % 26) for k in range(8))}é" for i in range(0, 2000, 7)]
    text = "".join(f"{lead}{w}{marks}" for marks in ("", ".", ",", "!!", "%%%", "),") for lead in " \n" for w in words)
    assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.tokenizer.signs < len(text) / 3


def test_odd_words_with_marks():
    own, library = token_shards.Encoder(FILE), Tokenizer.from_file(FILE)
    texts = [" don't. l'eau, 'tis' it's", " ×÷, a×b. ÿĀ!ɏ? ŉ, ǅ; ɐ. ª, º.", "\nWord!! \nword, \n, \n", " a_b_, _a a1. 1a, a\u0301, \u0301a.", " ,a .a a.b. a,b,c", " é é é. É, é\n\né.", " 漢字, Ж. жж! ß, ẞ.", " a\x1cb, a\x85. \xa0a,", " a\x01, a\x7f. \x00a, a", "~a~ `a` [a], {a} <a>"]
    assert [i.tolist() for i in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_shards(odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_TOKENS", 1000)
    found = token_shards.shard_roundtrip(odd, FILE).collect()
    tokenizer, at, want = Tokenizer.from_file(FILE), 0, []
    for i, text in sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert token_shards.shard_roundtrip(empty, FILE).count() == 0


def test_shards_are_compressed(spark):
    """All of a table in one shard: bytes for each token, and what select and rank say of it."""
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    encoded = [np.append(ids, ids.dtype.type(0)) for ids in token_shards.encoder(FILE).encode([t for _, t in rows])]
    tokens = np.concatenate(encoded)
    raw = token_shards.to_bytes([i for i, _ in rows], np.cumsum([len(e) for e in encoded]), token_shards.WaveletMatrix.build(tokens))
    assert len(raw) < 1.5 * len(tokens)
    matrix = token_shards.from_bytes(raw)[2]
    assert (matrix.tokens() == tokens).all()
    for token in {0, int(tokens[5]), int(tokens[-2]), int(tokens.max())}:
        places = np.flatnonzero(tokens == token)
        assert matrix.count(token) == len(places)
        for k in {0, len(places) // 2, len(places) - 1}:
            assert matrix.select(token, k) == places[k] and matrix.rank(token, int(places[k])) == k and matrix.access(int(places[k])) == token


def test_added_tokens_in_a_text():
    texts = ["a <|endoftext|> b", "<|", "plain  text\n\n x", "", "nul \0 here", " led", "tail \n", "a\u2003 b\u00a0\n c", "it's 'st"]
    tokenizer = Tokenizer.from_file(FILE)
    assert [i.tolist() for i in token_shards.encoder(FILE).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def store(spark, **kw):
    return sharding.ShardStore(spark, new_folder(spark, "store"), **{"target_bytes": 40_000, "rows_per_shard": 20, "codec": "uncompressed"} | kw)


def test_compaction_keeps_rows_and_versions(spark, odd):
    s = store(spark)
    r = random.Random(3)
    every = []
    for batch in range(3):
        rows = [(batch * 1000 + i, "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 300)))) for i in range(200)]
        every += rows
        s.append(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    before = s.manifest().collect()
    assert s.versions() == [1, 2, 3] and len(before) >= 30 and sum(m.rows for m in before) == 600
    assert len({m.seq for m in before}) == len(before)
    plan = s.plan(s.manifest()).collect()
    # Brute force: bins of consecutive shards of a tier by the bytes before them.
    bins, total = {}, {}
    for m in sorted(before, key=lambda m: m.seq):
        tier = int(np.floor(np.log(m.bytes) / np.log(s.fanout)))
        key = (tier, m.seq // (sharding.PLAN_BLOCK * sharding.PER_TASK))
        bins.setdefault((key, total.get(key, 0) // s.target_bytes), []).append(m)
        total[key] = total.get(key, 0) + m.bytes
    want = {m.path: min(x.seq for x in run) for run in bins.values() for m in run if len(run) >= 2}
    assert {p.path: p.run for p in plan} == want
    last = s.compact_fully()
    after = s.manifest().collect()
    assert len(after) < len(before) / 4 and max(m.bytes for m in after) < 2.2 * s.target_bytes
    assert sorted(map(tuple, s.read().collect())) == sorted(every)
    assert {m.rows for m in after} == {n for _, n in s.read(with_shard=True).groupBy(sharding.SHARD).count().collect()} and last == s.versions()[-1]
    assert s.compact() is None


def test_commit_conflict(spark):
    s = store(spark)
    s.append(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(sharding.Conflict):
        s.commit(s.manifest(), 0)
    assert s.versions() == [1] and s.read().count() == 1


def test_lost_writer_leaves_no_version(spark, monkeypatch):
    """A writer that ends before its rename; an empty version file of another tool."""
    s = store(spark)
    rows = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    s.append(rows)

    def lost(*_):
        raise OSError("gone")

    monkeypatch.setattr(s, "_rename", lost)
    with pytest.raises(OSError):
        s.append(rows)
    monkeypatch.undo()
    assert s.versions() == [1] and s.read().count() == 5
    s.append(rows)
    s.compact_fully()
    assert s.read().count() == 10
    fs, p = s._fs(f"{s.path}/_versions/00000099")
    fs.create(p, False).close()
    assert 99 not in s.versions() and s.read().count() == 10


def test_two_writers(spark):
    """One writer's arrival is written while the other compacts; it stays and can be committed."""
    a = store(spark)
    b = sharding.ShardStore(spark, a.path, **{"target_bytes": 40_000, "rows_per_shard": 20, "codec": "uncompressed"})
    rows = lambda low: spark.createDataFrame([(low + i,) for i in range(50)], "doc_id long").repartition(2)
    for i in range(3):
        a.append(rows(100 * i))
    folder = f"{b.path}/arrival-99999999-other"
    rows(1000).write.parquet(folder)
    old = {f"{a.path}/{n}" for n in a._folders(1)}
    a.compact_fully()
    a.append(rows(2000))
    a.compact_fully()
    fs, p = b._fs(folder)
    assert fs.exists(p) and not any(fs.exists(b._fs(f)[1]) for f in old)
    base = b.versions()[-1]
    b.commit(b.manifest().unionByName(b._listed(folder, 0)), base)
    with pytest.raises(sharding.Conflict):
        a.commit(a.manifest(base), base)
    assert b.read().count() == 250 and len(a.versions()) <= 3


def test_runs_have_tasks_of_their_own(spark):
    s = store(spark, target_bytes=12_000, rows_per_shard=10)
    s.append(spark.createDataFrame([(i, f"{i:>200}") for i in range(400)], "doc_id long, text string").repartition(3))
    runs = s.plan(s.manifest()).select("run").distinct().count()
    s.compact()
    parts = s.manifest().where("level = 1").selectExpr("regexp_extract(path, 'part-([0-9]+)-', 1) as task").distinct().count()
    assert parts == runs > 4


def test_registered_shards_are_merged(spark, small):
    found = queries.op5_sharding(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(found.selectExpr("doc_id", "text_sha256").collect()) == sorted(docs.selectExpr("doc_id", "sha2(encode(coalesce(text, ''), 'utf-8'), 256)").collect())
    rows = found.groupBy("shard", "shard_rows", "shard_level").count().collect()
    assert all(r["count"] == r.shard_rows for r in rows) and max(r.shard_level for r in rows) >= 1


def test_shards_of_odd_rows(spark, odd, empty):
    s = store(spark)
    s.append(odd)
    s.append(empty)
    s.append(odd)
    s.compact_fully()
    assert s.read().columns == odd.columns
    assert sorted(map(repr, s.read().collect())) == sorted(map(repr, odd.collect() * 2))
    with pytest.raises(ValueError):
        s.append(odd.withColumn(sharding.RUN, odd["doc_id"]))


def test_warc_reading_is_linear(monkeypatch):
    """Each byte of a file is copied a bounded number of times, however many records follow."""
    fed, original = [], warc.zstandard.ZstdDecompressor

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def decompress(self, piece):
            fed.append(len(piece))
            return self.inner.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    class Unpacker:
        def __init__(self, **kinds):
            self.inner = original(**kinds)

        def decompressobj(self):
            return Counting(self.inner.decompressobj())

    monkeypatch.setattr(warc.zstandard, "ZstdDecompressor", Unpacker)
    sizes = {}
    for n in (200, 400):
        records = [f"record {i} ".encode() * (i % 50 + 1) for i in range(n)] + [random.Random(1).randbytes(20_000), b""]
        raw = warc.encode_file(records)
        fed.clear()
        assert list(warc.decode_file(raw)) == records
        sizes[n] = sum(fed)
    assert sizes[400] <= 3 * sizes[200] and max(fed) <= warc.PIECE
    with pytest.raises(ValueError, match="whole"):
        list(warc.decode_file(raw[:-3]))


def test_shards_of_empty_arrivals_only(spark, empty):
    store = sharding.ShardStore(spark, new_folder(spark, "none"))
    store.append(empty)
    store.append(empty)
    assert store.compact_fully() == 2
    assert store.read().columns == empty.columns and store.read().count() == 0
    assert sharding.SHARD in store.read(with_shard=True).columns
