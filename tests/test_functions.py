import hashlib
import random
import string
import sys
import unicodedata

from pyspark.sql import functions as F

from kinset.functions import folding
from kinset.functions import hashing as H
from kinset.functions import text as T


def be(n, k):
    return (n % (1 << 8 * k)).to_bytes(k, "big")


def rank(*parts):
    return hashlib.sha256(b"".join(parts)).hexdigest()[:16]


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_minhash_rank_bytes(spark):
    rows = [(0, 0), (-1, 7), (2**61 - 1, 127), (-(2**63), 3)]
    got = spark.createDataFrame(rows, "e long, c long").select(H.minhash_rank(F.col("e"), F.col("c")).alias("r"), H.minhash_rank(F.col("e"), F.col("c"), hash_range=1000).alias("m")).collect()
    for (e, c), r in zip(rows, got):
        want = rank(H.MINHASH.encode(), be(42, 8), be(c, 4), be(e, 8))
        assert r.r == want and int(r.m, 16) == int(want, 16) % 1000


def test_ranks_keep_unsigned_order(spark):
    rng = random.Random(1)
    ranks = [f"{rng.getrandbits(64):016x}" for _ in range(200)] + ["0" * 16, "f" * 16, "7" + "f" * 15, "8" + "0" * 15]
    df = spark.createDataFrame([(r,) for r in ranks], "r string").withColumn("n", H.hex_to_ordered(F.col("r")))
    rows = df.select("r", "n", H.ordered_to_hex(F.col("n")).alias("back"), H.hex_mod(F.col("r"), 64).alias("m64"), H.hex_mod(F.col("r"), 1000).alias("m1000"), H.ordered_mod(F.col("n"), 64).alias("o64"), H.ordered_mod(F.col("n"), 1000).alias("o1000")).collect()
    assert [r.r for r in sorted(rows, key=lambda r: r.n)] == sorted(ranks)
    for r in rows:
        assert r.back == r.r
        assert r.m64 == r.o64 == int(r.r, 16) % 64 and r.m1000 == r.o1000 == int(r.r, 16) % 1000


def test_ids_and_seeds(spark):
    df = one(spark, a="b1", b="ä2", n=5)
    a, b = F.col("a"), F.col("b")
    field = lambda s: be(len(s.encode()), 4) + s.encode()
    r = df.select(H.negative_rank(a, b).alias("neg"), H.pair_rank(a, b).alias("pair"), H.pair_id("k", b, a).alias("id"), H.hex_record_id(b, "x:").alias("hex"), H.trial_seed(b, F.col("n")).alias("seed"), H.feature_hash(b).alias("f"), H.copy_fingerprint(a, b).alias("copy")).first()
    sha = lambda *p: hashlib.sha256(b"".join(p)).hexdigest()
    assert r.neg == sha(H.NEGATIVE_PAIR.encode(), be(7, 8), field("b1"), field("ä2"))
    assert r.pair == sha(H.PAIR.encode(), b"\0", be(7, 8), field("b1"), field("ä2"))
    assert r.id == "pair:" + sha(b"k\0b1\0", "ä2".encode())
    assert r.hex == "x:" + "ä2".encode().hex()
    assert r.seed == sha(H.TRIAL.encode(), b"\0", be(20260729, 8), field("ä2"), be(5, 8))[:16]
    assert r.f == sha(H.FEATURE.encode(), b"\0", "ä2".encode())[:16]
    assert r.copy == sha(H.COPY.encode(), b"\0", field("b1"), field("ä2"))


def test_mixed_seed_is_splitmix(spark):
    def want(i):
        m = (1 << 64) - 1
        z = (42 + (i + 1) * 0x9E3779B97F4A7C15) & m
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
        return f"{z ^ z >> 31:016x}"

    got = spark.range(50).select(H.mixed_seed(42, F.col("id")).alias("s")).collect()
    assert [r.s for r in got] == [want(i) for i in range(50)]


def test_normal_forms(spark):
    rows = ["  Hello,   WORLD!! ", "Café", "", None, "ﬁne Ｗide", "ABC-12"]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(T.normalize_ascii(F.col("t")).alias("a"), T.normalize_unicode("t").alias("u")).collect()
    assert [r.a for r in df] == ["hello world", "caf", "", None, "ne ide", "abc 12"]
    assert [r.u for r in df] == ["hello world", "caf", "", None, "fine wide", "abc 12"]


def test_grams_and_shingles(spark):
    for text in ("", "a", "ab", "abc", "abcd"):
        assert one(spark, t=text).select(T.grams(F.col("t"))).first()[0] == [text[i : i + 3] for i in range(len(text) - 2)]
    for n in (0, 4, 5, 6):
        words = [f"w{i}" for i in range(n)]
        got = spark.createDataFrame([(words,)], "w array<string>").select(T.shingles(F.col("w"))).first()[0]
        assert got == ["\x1f".join(words[i : i + 5]) for i in range(n - 4)]


def test_subjects_and_quotes(spark):
    subjects = {"Re: Fwd: RE[2]: x Y": "x y", "re:re: ": "", "Regarding: z": "regarding z", "FW:\ta-b": "a b", "\u00a0Re: Straße ﬁx ２０": "strasse fix 20", "re:" * 20000 + "x": "x"}
    assert one(spark, s="Straße ﬁx ２０").select(T.tokens(T.folded(F.col("s")))).first()[0] == ["strasse", "fix", "20"]
    for s, want in subjects.items():
        assert one(spark, s=s).select(T.canonical_subject(F.col("s"))).first()[0] == want
    bodies = {"a\n> q\nb": "a\nb", "a\n-----Original Message-----\nb": "a", "On Monday, Ann wrote:\nb": "", "a\nOn we go": "a\nOn we go", "  > q\nc": "c", "please see my original message below\nb": "please see my original message below\nb", "> -----Original Message-----\nb": "b", "a\r\nb\r\n\r\n": "a\nb\n", "a\n\n": "a\n", " __ ORIGINAL\tmessage --\nx": "", "on it wrote: x\ny": "on it wrote: x\ny"}
    for b, want in bodies.items():
        assert one(spark, b=b).select(T.without_quotes(F.col("b"))).first()[0] == want


def test_strict_fields(spark):
    ids = {"<a@b>": "a@b", " <a> ": "a", "<a b>": None, "a": None, "<a><b>": None}
    for h, want in ids.items():
        assert one(spark, h=h).select(T.message_id(F.col("h"))).first()[0] == want
    numbers = {"0": 0, "18446744073709551615": 2**64 - 1, "18446744073709551616": None, "01": None, "-1": None, "": None, "1.0": None}
    for t, want in numbers.items():
        assert one(spark, t=t).select(T.strict_unsigned(F.col("t"))).first()[0] == want
    assert one(spark, t="1,5,9").select(T.split_numbers(F.col("t"))).first()[0] == [1, 5, 9]
    assert one(spark, t="").select(T.split_numbers(F.col("t"))).first()[0] == []


def test_subject_query_takes_whole_texts(spark, tmp_path):
    from kinset.plans import catalogue

    text = "re: " + "word " * 30 + "\nlast"
    spark.createDataFrame([(1, 0, text), (1, 1, None)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.subject for r in catalogue.QUERIES["str6_subject"](spark, str(tmp_path)).collect()}
    assert got == {0: "word " * 30 + "last", 1: ""}


def test_strict_numbers(spark):
    whole = {"0": 0, "-7": -7, "007": 7, "+1": None, "": None, "1 ": None, "9223372036854775808": None, "1e3": None}
    real = {"0.5": 0.5, "-1e-3": -0.001, ".5": 0.5, "5.": 5.0, "nan": None, "inf": None, "1e999": None, " 1": None, "1_0": None, "": None, "0x1": None, "1d": None}
    for strict, cases in ((T.strict_integer, whole), (T.strict_double, real)):
        for text, want in cases.items():
            assert one(spark, t=text).select(strict(F.col("t"))).first()[0] == want


def test_seed_layouts(spark):
    import hashlib

    def first8(*parts):
        return hashlib.sha256(b"".join(parts)).hexdigest()[:16]

    root, sha = (5).to_bytes(8, "big"), "ab" * 32
    index = F.lit(9)
    got = one(spark, t="x").select(
        H.kind_seed(5, 2, index, "d"), H.hash_seed(5, None, "d"), H.hash_seed(5, index, "d"), H.run_seed(5, F.lit(sha), F.lit(128), F.lit(64), F.lit("pé"), domain="d"), H.run_seed(5, F.lit(sha), F.lit(128), F.lit(64), F.lit("pé"), F.lit("m"), "d")
    ).first()
    run = (b"d\0", root, bytes.fromhex(sha), (128).to_bytes(4, "big"), (64).to_bytes(4, "big"), (3).to_bytes(4, "big"), "pé".encode())
    nine = (9).to_bytes(4, "big")
    assert list(got) == [first8(b"d\0", root, b"\2", nine), first8(b"d\0", root), first8(b"d\0", root, nine), first8(*run), first8(*run, (1).to_bytes(4, "big"), b"m")]
    assert H.json_digest({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()


def test_folding_of_all_code_points_and_marks(spark):
    """Runs of a-z and 0-9 are those of the text folded in full by Python."""
    rng = random.Random(8)
    points = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = [" ".join(f"{a}{c}{a}" for c in points[k : k + 500]) for a in ("", "b", "H7") for k in range(0, len(points), 500)]
    texts += [" ".join(f"{a}{m}c" for m in marks) for a in string.ascii_letters + "09"]
    latin = [m for m in marks if any(len(unicodedata.normalize("NFC", a + m)) == 1 for a in string.ascii_letters)]
    odd = [c for c in points[:0xFFFF] if any(x in string.ascii_letters for x in unicodedata.normalize("NFKD", c).casefold())]
    pool = [*latin, *latin, *rng.sample(marks, 40), *rng.sample(odd, 300), *"hHtTjwyIaeis7", "ß", "ẖ", "ḣ", "İ", "ǰ", "ẗ", "\u0344", "\u034f", "\u200d", "ſ", "ŉ"]
    texts += [" ".join("".join(rng.choices(pool, k=rng.randrange(1, 7))) for _ in range(60)) for _ in range(600)]
    texts += ["PLAIN Ascii 9", "", "Straße ﬁne ½ ㎏ Ⅷ Ａ１ 𝐀𝟗 é e\u0301"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(8)
    got = {r.k: r.w for r in rows.select("k", T.tokens(folding.folded_ascii(F.col("t"))).alias("w")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == folding.plain_runs(t), ascii(t[:80])
    assert rows.select(folding.folded_ascii(F.lit(None).cast("string"))).first()[0] is None
    assert "Python" not in rows.select(T.tokens(folding.folded_ascii(F.col("t"))))._jdf.queryExecution().toString()
