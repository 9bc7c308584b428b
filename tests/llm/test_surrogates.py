import random

import regex

from kinset.llm import surrogates

PATTERN = regex.compile(surrogates.PATTERN)
KEY = b"a key that only tests use"


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def iban_ok(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def number(text):
    """Digits like a card's, but with another check digit."""
    return bool(regex.fullmatch(r"(?:[0-9]{4}[ \-]?){3}[0-9]{1,7}", text)) and not luhn(regex.sub(r"\D", "", text))


def shape(text):
    return regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", regex.sub(r"\d", "0", text)))


def rows():
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pool = [f"+1 ({digits(3)}) 555-{digits(4)}" for _ in range(30)] + [f"{rng.randrange(256)}.{rng.randrange(256)}.9.{rng.randrange(256)}" for _ in range(30)]
    pool += [digits(16) for _ in range(20)] + ["4111 1111 1111 1111", "4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00", "078-05-1120"]
    pool += [f"ñandú.{digits(2)}@mail{k}.example.com" for k in range(20)] + [f"".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    pool += ["Mrs. Anna Weber", "Mr Weber", "Dr. Иван Петров", "Frau Müller", "Μαρία Βλάχου", "John O'Neill"]
    plain = ["words here,", "Version 3.0", "in 2024.", "der Straße", "a@b", "\n", "###"]
    out = []
    for k in range(150):
        text = " ; ".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice(plain) for _ in range(rng.randrange(12)))
        out.append((k, text, "x", len(text)))
    out.append((299, " ; ".join(pool), "x", 0))
    return out + [(300, None, "x", None), (301, "", "x", 0), (1, out[1][1], "x", 3), (None, "mail me: q.1@a.org", "x", 3), (302, "long " * 40000 + pool[0], "x", 3)]


def test_entities_surrogates_and_rest(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, kind string, n_chars long")
    got = surrogates.with_surrogates(docs, KEY).collect()
    assert len(got) == len(data)
    new = {}
    for r in got:
        new.setdefault(r.doc_id, []).append(r)
    mapping = {}
    for i, text, _, _ in data:
        r = new[i].pop() if i != 1 else new[i][0]
        if text is None:
            assert r.text is None and r["__entities"] == 0
            continue
        old = PATTERN.findall(text)
        assert r["__entities"] == sum(not number(x) for x in old)
        gaps = PATTERN.split(text)
        if not old:
            assert r.text == text
            continue
        assert PATTERN.split(r.text) == gaps, (text, r.text)
        for a, b in zip(old, PATTERN.findall(r.text), strict=True):
            if number(a):
                assert a == b
                continue
            assert mapping.setdefault(a, b) == b and a != b
    assert len(set(mapping.values())) == len(mapping) > 90
    for a, b in mapping.items():
        assert b not in mapping
        if not regex.search(r"@|^\p{L}", a) and a.count(".") != 3 and len(a) != 40:
            assert shape(a) == shape(b), (a, b)
    digits = {a: b for a, b in mapping.items() if regex.fullmatch(r"[\d -]+", a)}
    assert all(luhn(regex.sub(r"\D", "", b)) for a, b in digits.items() if len(a) > 15 and luhn(regex.sub(r"\D", "", a)))
    assert mapping["4111 1111 1111 1111"].replace(" ", "") == mapping["4111-1111-1111-1111"].replace("-", "")
    assert iban_ok(mapping["DE89 3704 0044 0532 0130 00"])
    women = surrogates.GIVEN["latin", "f"]
    assert mapping["Mrs. Anna Weber"].split()[1] in women
    assert mapping["Mrs. Anna Weber"].split()[2] == mapping["Mr Weber"].split()[1]
    assert mapping["Dr. Иван Петров"].split()[1] in surrogates.GIVEN["cyrillic", "m"]
    assert regex.fullmatch(r"\p{IsGreek}+ \p{IsGreek}+", mapping["Μαρία Βλάχου"])


def test_names_that_collide_are_told_apart(spark):
    names = [("given:greek:f", f"όνομα{k}") for k in range(60)] + [("family:greek", f"επίθετο{k}") for k in range(300)]
    table = surrogates.surrogate_table(spark.createDataFrame(names, "kind string, canon string"), KEY).collect()
    assert len(table) == 360
    assert len({(r.kind, r.surrogate) for r in table}) == 360


def test_replaced_keeps_columns(spark):
    # columns of the names that the plan would use
    names = ["__new", "__key", "__row", "__entities", "row", "__Gaps", "a.b"]
    d = spark.createDataFrame([(1, "ip 10.20.30.40!", *"mine it".split(), 5, *"wxyz", 3), (2, None, *"mine it".split(), 5, *"wxyz", 3)], "doc_id long, text string, " + ", ".join(f"`{n}` {'int' if n == '__row' else 'string'}" for n in names) + ", n_chars long")
    out = surrogates.replaced(d, KEY)
    assert out.columns == d.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(r["__new"] == "mine" and r["__key"] == "it" and r["__row"] == 5 and r["a.b"] == "z" for r in got.values())
    assert got[1].n_chars == len(got[1].text) and "10.20.30.40" not in got[1].text and got[2].n_chars == 3
    assert surrogates.replaced(d.limit(0), KEY).collect() == []


def test_whole_names_and_later_mentions(spark):
    whole = ["John F. Kennedy", "John Fitzgerald Kennedy", "Dr. John F. Kennedy", "JOHN SMITH", "DR. SMITH", "Mr. van der Berg", "Anna de la Cruz", "Anna-Lena Meyer", "Charles O'Neill", "PETER O'NEILL", "José María Álvarez del Manzano"]
    for name in whole:
        assert [m.group() for m in PATTERN.finditer(f"so {name} went")] == [name]
    assert PATTERN.search("Emily Carter's house").group() == "Emily Carter"
    texts = [f"so {name}'s dog; it" for name in whole]
    texts.append("We met Emily Carter. The Carter-led team, Carter's own; CARTER, and Emily left. carter Carterson The end")
    texts.append("No one here is Carter.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.query(docs).collect()}
    for k, name in enumerate(whole):
        left = set(regex.findall(r"\p{L}{4,}", got[k].text)) & set(regex.findall(r"\p{L}{4,}", name))
        assert not left, (name, got[k].text)
        assert regex.fullmatch(r"so .*'s dog; it", got[k].text) and got[k].n_entities == 1
    given, family = regex.match(r"We met (\S+) (\S+)\. ", got[len(whole)].text).groups()
    assert "Carter" not in family and got[len(whole)].n_entities == 5
    assert got[len(whole)].text == f"We met {given} {family}. The {family}-led team, {family}'s own; {family.upper()}, and {given} left. carter Carterson The end"
    assert got[len(whole) + 1].text == texts[-1] and got[len(whole) + 1].n_entities == 0


def test_secrets_without_digits(spark):
    secrets = ["AKIA" + "QWERTYUIASDFGHJK", "xoxb-" + "abcdefghij-klmno", "sk-" + "abcdefghijklmnopqrstuv", "ghp_" + "abcdefghijklmnopqrstuvwxyzabcdefghij", "AB:CD:EF:AB:CD:EF", "a" * 40]
    values = {"password: correcthorsebattery": "correcthorsebattery", "pwd=abc123": "abc123", "Password='p!ss~word'": "p!ss~word", "passwd = letmein.": "letmein"}
    texts = [f"it is {s} here" for s in secrets] + [f"its {s}" for s in values]
    texts += ["password: ***", "a key: correcthorsebattery", "password\n\nand more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.query(docs).collect()}
    for k, (text, found) in enumerate(zip(texts, [*secrets, *values.values()], strict=False)):
        assert got[k].n_entities == 1 and found not in got[k].text, text
        before, after = text.split(found)
        assert got[k].text.startswith(before) and got[k].text.endswith(after) and len(got[k].text) == len(text)
    assert [got[k].text for k in range(len(texts) - 3, len(texts))] == texts[-3:]


def test_long_and_dense_inputs(spark):
    """Runs that recursion or backtracking would not survive, and a shape with all its values taken."""
    runs = ["mail x@" + "a." * 3000 + "1 end", "x@" + "a." * 500_000, "a.b" * 300_000 + "@", "k@" + "a" * 500_000 + ".com", "a-" * 300_000, "pwd=" + "-" * 300_000, "12:" * 200_000, "1234 " * 100_000, "A." * 300_000, "Anna " + "van der " * 50_000, "token=" + "ab1" * 20_000 + " so", "Anna Berg met " + "Berg-" * 60_000]
    dense = " ".join(f"{c}@corp.com" for c in "abcdefghijklmnopqrstuvwxyz")
    docs = spark.createDataFrame(list(enumerate([*runs, dense, "Ann.Lee@Big.org, ann.lee@big.org, ANN.LEE@BIG.ORG; 2001:db8::8a2e:370:7334 4111 1111 1111 1112"])), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.with_surrogates(docs, KEY).collect()}
    for k, text in enumerate(runs[:10]):
        if not PATTERN.search(text):
            assert got[k].text == text and got[k]["__entities"] == 0
    assert "ab1ab1" not in got[10].text and got[10].text.endswith(" so") and len(got[10].text) == len(runs[10])
    assert "Berg" not in got[11].text and got[11]["__entities"] > 1000
    new = regex.findall(r"(\S+)@(\S+)", got[len(runs)].text)
    assert len({a for a, _ in new}) == 26 and len({b for _, b in new}) == 1 and "corp.com" not in got[len(runs)].text
    assert not {a for a, _ in new} & set("abcdefghijklmnopqrstuvwxyz")
    a, b, c, ip = regex.match(r"(\S+), (\S+), (\S+); (\S+) 4111 1111 1111 1112", got[len(runs) + 1].text).groups()
    assert a.lower() == b == c.lower() and c == c.upper() and regex.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[a-z.]+", a)
    assert ip != "2001:db8::8a2e:370:7334" and shape(regex.sub("[a-f]", "0", ip)) == "0000:000::0000:000:0000"


def test_other_keys_give_other_surrogates(spark):
    docs = spark.createDataFrame([(1, "from a.b.c@x.org")], "doc_id long, text string")
    one, two, again = (surrogates.with_surrogates(docs, k).first().text for k in (KEY, KEY + b"2", KEY))
    assert one == again != two
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    for key in (KEY, b"k" * 100):
        assert docs.select(surrogates._hmac(key, F.col("text"))).first()[0] == hmac.new(key, b"from a.b.c@x.org", hashlib.sha256).hexdigest()


def test_detection_against_a_plain_scan(spark):
    """Planted entities, found by rules that share nothing with the operator's pattern."""
    rng = random.Random(20)
    data, planted = [], []
    for k in range(200):
        words = ["lorem", "ipsum", "dolor", "1.5", "12", "sit,"] * 3
        here = []
        for _ in range(rng.randrange(3)):
            number = "".join(rng.choice("0123456789") for _ in range(15))
            entity = rng.choice([f"u{k}.{rng.randrange(99)}@host{rng.randrange(9)}.org", f"{rng.randrange(1, 224)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", next(number + c for c in "0123456789" if luhn(number + c)), f"+44 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"])
            words.insert(rng.randrange(len(words)), entity + ";")
            here.append(entity)
        data.append((k, " ".join(words)))
        planted.append(here)
    got = {r.doc_id: r for r in surrogates.with_surrogates(spark.createDataFrame(data, "doc_id long, text string"), KEY).collect()}
    for (k, text), here in zip(data, planted):
        assert got[k]["__entities"] == len(here)
        old, new = text.split(" "), got[k].text.split(" ")
        assert len(old) == len(new)
        parts = {w for e in here for w in f"{e};".split(" ")}
        assert all(a == b for a, b in zip(old, new) if a not in parts)
        assert not any(e in got[k].text for e in here)


def test_nothing_is_left_in_any_script(spark):
    """Mail addresses in scripts with and without an alphabet of their own, marks and digits included."""
    mails = ["张三丰@例子.公司", "מרים@דואר.קום", "محمد@مثال.com", "प्रिया.शर्मा@उदाहरण.भारत", "たなか@例え.jp", "タナカ@例え.jp", "김철수@회사.한국", "สมชาย@ตัวอย่าง.ไทย", "Գոհար@օրինակ.am", "გიორგი@მაგალითი.ge", "ᏣᎳᎩ@ᏓᎪᎯ.com", "አበበ@ምሳሌ.et", "முருகன்@எடுத்து.in", "৪৫রহিম@উদা.bd", "ñandú@peña.es", "Ωμέγα@λόγος.gr", "Ёлка@пример.рф"]
    docs = spark.createDataFrame([(k, f"write to {m} now") for k, m in enumerate(mails)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.query(docs).collect()}
    for k, mail in enumerate(mails):
        new = regex.fullmatch(r"write to (\S+) now", got[k].text).group(1)
        assert got[k].n_entities == 1, mail
        local, old = new.split("@")[0], mail.split("@")[0]
        # single letters may be drawn again; no two neighbours, no word and no domain stay
        assert not any(old[i : i + 2] in local for i in range(len(old) - 1)), (mail, new)
        assert mail.split("@")[1] not in new
        assert len({regex.sub(r"\P{L}", "", local) == "" for _ in new}) == 1
    for k, script in {0: "Han", 1: "Hebrew", 2: "Arabic", 3: "Devanagari", 6: "Hangul", 7: "Thai", 12: "Tamil"}.items():
        assert regex.fullmatch(rf"[\p{{{script}}}.]+@.*", got[k].text.split()[2]), got[k].text


def test_names_beyond_the_list_keep_their_format(spark):
    """More people than listed names: single words, distinct, of the right script and gender."""
    listed = [("given:latin:f", n.lower()) for n in surrogates.GIVEN["latin", "f"]] + [("given:cyrillic:m", f"имя{k}") for k in range(50)]
    table = {(r.kind, r.canon): r.surrogate for r in surrogates.surrogate_table(spark.createDataFrame(listed, "kind string, canon string"), KEY).collect()}
    assert len({(k[0], s) for k, s in table.items()}) == len(listed)
    for (kind, canon), name in table.items():
        assert regex.fullmatch(r"\p{L}+", name) and canon not in name
        begin, inner, last = surrogates.MADE[tuple(kind.split(":")[1:])]
        made = any(name.startswith(b.lower()) for b in begin) and any(name.endswith(e) for e in last)
        assert made or name in [n.lower() for n in surrogates.GIVEN[tuple(kind.split(":")[1:])]]
