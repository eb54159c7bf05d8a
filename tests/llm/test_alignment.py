"""Alignment of tokenizers against a plain version with the libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewire.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    t, sp, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of_sign()
    t.encode_special_tokens = True

    def tokens(text):
        if not text:
            return None
        a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode() else None

    def spans(found):
        out, at = [], 0
        for i, x in found:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def run(rows):
        links, docs, out = {}, Counter(), []
        for n, (_, text) in enumerate(rows):
            if (found := tokens(text)) is None:
                continue
            a, b = map(spans, found)
            links[n] = [(i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v)]
            docs.update(set(links[n]))
        best = defaultdict(int)
        for (i, _), c in docs.items():
            best[i] = max(best[i], c)
        for n, (doc_id, text) in enumerate(rows):
            if n not in links:
                out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
                continue
            a, b = map(spans, tokens(text))
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            groups, start = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)))
                start = cut
            n_best, count = sum(docs[p] == best[p[0]] for p in links[n]), sum(docs[p] for p in links[n])
            out.append((doc_id, len(a), len(b), len(groups), len(links[n]), n_best, count, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        return sorted(out, key=repr)

    return run


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", " leading and  double  spaces ", "été déjà vu à Zürich, straße",
    "日本語のテキスト 😀😀 mixed", "<|endoftext|> is plain <s> text </s> <unk>", "a▁b", None, "", " ", "\n\n\t", "x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "one two\x00three", "1234567890 12 3 45",
]


def test_against_brute_force(spark, brute, monkeypatch):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(alignment.align(df.repartition(4), A, B)) == brute(rows)
    assert got(alignment.align(df.coalesce(1), A, B)) == brute(rows)


def test_given_documents(spark, small, brute):
    rows = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()[:40]]
    assert got(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B)) == brute(rows)


def test_blocks_don_t_matter():
    both = alignment.pair(A, B)
    texts = [t or "" for t in TEXTS]
    whole, ids, others = alignment.align_block(both, texts)
    parts = [alignment.align_block(both, [t]) for t in texts]
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "id_n", "pair_n"):
        assert whole[c].to_pylist() == [p[0][c].to_pylist()[0] for p in parts]
    assert sum(len(p[1]) for p in parts) == len(ids)
    counted = Counter()
    for _, _, o in parts:
        counted.update(zip(o["a"].tolist(), o["b"].tolist(), strict=True))
    assert counted == dict(zip(zip(others["a"].tolist(), others["b"].tolist(), strict=True), others["docs"].tolist(), strict=True))


def test_identity_map():
    both = alignment.pair(A, B)
    named = both.identity >= 0
    assert named.sum() > 5000
    assert all(both.bytes_a[i] == both.bytes_b[j] for i, j in enumerate(both.identity.tolist()) if j >= 0)
    assert not both.b.is_byte(int(both.identity[both.bytes_a.index(b"a")]))


def test_odd_rows(spark, odd, odd_rows, empty, brute):
    found = {r[0]: r for r in got(alignment.align(odd, A, B))}
    assert odd.count() == alignment.align(odd, A, B).count()
    long = next(t for i, t, *_ in odd_rows if i == 8)
    both = alignment.pair(A, B)
    assert found[8][1:3] == (len(both.a.tokenizer.encode(" " + long, add_special_tokens=False).ids), len(both.b.encode(long)))
    short = [(i, t and t[:900]) for i, t, *_ in odd_rows]
    assert got(alignment.align(spark.createDataFrame(short, "doc_id long, text string").repartition(3), A, B)) == brute(short)
    assert alignment.align(empty, A, B).collect() == []
    assert alignment.align(empty, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
