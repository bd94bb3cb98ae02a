import base64
import random

import numpy as np
import pytest

from glasra.llm.bpe import TOKENIZER_DIR, Encoder, MergeTree, token_counts, token_ids
from glasra.llm.budget import document_tokens, token_cube

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    from glasra.llm.bpe import PATTERN

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(piece: bytes, ranks: dict) -> list[int]:
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tree_merges_like_the_plain_loop():
    e, rnd = Encoder(PATH), random.Random(5)
    for _ in range(500):
        piece = bytes(rnd.choice(b"aeinrst \xc3\xa9\xadAB1") for _ in range(rnd.randint(1, 40)))
        assert MergeTree(piece, e.ranks).ids() == naive(piece, e.ranks)


def test_batches_equal_a_public_library(reference):
    e, rnd = Encoder(PATH), random.Random(1)
    texts = ["".join(rnd.choice(" \n\t ab'st 12<|endoftext|>éÉ🎻.,! ​\r") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    counts, ids = e.batch([None, "", *texts])
    at = np.concatenate(([0], np.cumsum(counts)))
    assert counts[0] == counts[1] == 0
    for k, t in enumerate(texts):
        assert ids[at[k + 2] : at[k + 3]].tolist() == reference.encode_ordinary(t)


def test_long_text_and_forgetting(reference, monkeypatch):
    e, long = Encoder(PATH), "a" * 30000 + "éab" * 3000
    assert e.whole(long) == reference.encode_ordinary(long)
    monkeypatch.setattr("glasra.llm.bpe.REMEMBERED", 3)
    for t in ("an rud seo", "rud eile ar fad", "an rud seo"):
        _, ids = e.batch([t])
        assert ids.tolist() == reference.encode_ordinary(t)


def test_ids_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "Tá sé", 9), (1, "Tá sé", 9), (2, None, 9), (3, "", 9), (None, "<|endoftext|>", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = token_ids(df).collect()
    assert len(got) == 5 and got[0].ids == got[1].ids and got[2].ids == got[3].ids == []
    assert 50256 not in got[4].ids and len(got[4].ids) > 1
    assert token_ids(df.limit(0)).collect() == []
    assert [r.n_tokens for r in token_counts(df, carry=("doc_id",)).collect()] == [len(r.ids) for r in got]


def test_cube_sums(spark):
    rows = [(1, "a b", "ga", "NCE.parquet", "web"), (2, "c d e", "gle", "nce", None), (3, None, None, None, "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    t = document_tokens(df)
    assert {(r.doc_id, r.source, r.lang, r.n_words) for r in t.collect()} == {(1, "nce", "ga", 2), (2, "nce", "ga", 3), (3, None, None, 0)}
    cube = {(r.level, r.source, r.lang, r.domain): (r.n_docs, r.n_words) for r in token_cube(t).collect()}
    assert cube[7, None, None, None] == (3, 5) and cube[3, "nce", None, None] == (2, 5) and cube[0, "nce", "ga", "(none)"] == (1, 3)
    assert cube[3, "(none)", None, None] == (1, 0)


def test_counts_are_stored_and_only_new_texts_encoded(spark, tmp_path, monkeypatch):
    from glasra.llm import budget

    rows = [(1, "Tá sé go maith", "a", "ga", "x"), (2, "", "a", None, None), (3, None, None, "en", "y"), (4, "rud eile", "b", "ga", "x"), (4, "rud eile", "b", "ga", "x")]
    schema = "doc_id long, text string, source string, lang string, domain string"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "counts")
    first = sorted(map(str, budget.stored_tokens(df, path).collect()))
    assert first == sorted(map(str, budget.document_tokens(df).collect()))
    more = df.where("doc_id <> 1").unionByName(spark.createDataFrame([(1, "Tá sé go dona", "a", "ga", "x"), (5, "nua", "c", "ga", "x")], schema))
    encoded = []
    plain = budget.document_tokens
    monkeypatch.setattr(budget, "document_tokens", lambda d, *a, **k: encoded.extend(r.doc_id for r in d.collect()) or plain(d, *a, **k))
    again = sorted(map(str, budget.stored_tokens(more, path).collect()))
    assert sorted(encoded) == [1, 5] and again == sorted(map(str, plain(more).collect()))
