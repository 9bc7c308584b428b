import random

import numpy as np
import public_tokenizers
import sentencepiece

from kinset.llm import tokencount

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL))


def texts():
    rng = random.Random(6)
    bits = ["the", " ", "  ", "\n", "ständig", "naïve ", "<s>", " </s> ", "日本語", "𝔘", "▁", " word", "token = \"ab12\"", "\t", "aaaa", ". ", "ﬁ", "\x00"]
    out = ["", " ", "a", "▁x", "x" * 5000, "é" * 3000, " " * 4000, "ab " * 3000, "ab  " * 3000 + "日本" * 900]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 900))) for _ in range(120)]


def test_spliced_counts_are_the_library_s():
    data = texts()
    want = [len(MODEL.encode(t)) for t in data]
    for chunk, overlap in ((64, 16), (200, 8), (1000, 40)):
        c = tokencount.PieceCounter(public_tokenizers.path(tokencount.MODEL), chunk, overlap)
        assert c.separable
        assert c.counts(data) == want
        assert c.widened


def test_texts_without_spaces_take_time_in_proportion():
    import base64
    import time

    rng = random.Random(3)
    c = tokencount.PieceCounter(public_tokenizers.path(tokencount.MODEL))
    for text in ("\n".join(str(rng.randrange(10**9)) for _ in range(200_000)), base64.b64encode(rng.randbytes(1_500_000)).decode(), "".join(rng.choice("日本語中文字符測試的一是不了人我在有他這為之大來以個") for _ in range(600_000)), "a" * 500_000, "ab" * 300_000):
        began = time.perf_counter()
        want = len(MODEL.encode(text))
        whole = time.perf_counter() - began
        began = time.perf_counter()
        assert c.counts([text]) == [want]
        assert time.perf_counter() - began < 4 * whole + 1


def test_boundaries_are_where_no_piece_reaches():
    c = tokencount.PieceCounter(public_tokenizers.path(tokencount.MODEL))
    raw = "the cat 12é日本\n(x".encode()
    ends = set((np.cumsum([c.size[i] for i in MODEL.encode(raw.decode())]) - 1).tolist())
    assert 0 < len(c._stable(raw, 0, len(raw))) and set(c._stable(raw, 0, len(raw)).tolist()) <= ends


def test_query(spark):
    rows = [(k, t.replace("\x00", ""), "x") for k, t in enumerate(texts())] + [(None, None, "x"), (7, "long text " * 12000, "x"), (7, "long text " * 12000, "x")]
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    want = [(i, len((t or "").encode()), n := len(MODEL.encode(t or "")), n > 4096) for i, t, _ in rows]
    assert [tuple(r) for r in got] == want


def test_empty_table(spark):
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
