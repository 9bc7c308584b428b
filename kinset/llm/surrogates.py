"""PII: surrogate generation with DataFrame functions only.

Detection. One pattern of named kinds, tried in the order of ``KINDS`` at each place:
e-mail addresses, secrets (a value after a word such as token, key, password; known key
prefixes), IBANs, social security numbers, card numbers, phone numbers, IPv4 and IPv6
addresses, MAC addresses, and personal names that follow a form of address or begin with a
known given name, with initials, particles and up to seven words, in upper case too. Words
of a name that stand alone elsewhere in the same document are replaced as in the name. Every
repeated group of the pattern is bounded (an address has at most 126 labels of 63 signs and 64
signs before the @), so the regular expression engine's stack does not grow with the text.

Surrogates. An entity is its kind and its canonical form (names and addresses without case,
numbers without separators; a card number has a valid check digit), so one person or number is one entity wherever it stands; an
e-mail address is two entities, the domain and the part before it. A surrogate is drawn from
HMAC-SHA-256 under the caller's key of the kind and the canonical form, and an attempt number:
digits for digits, letters for letters of the same script and case, the same separators; a
valid check digit where the original has one; domains below reserved ones; names of the same
gender and script; octets of an address stay octets.

Collisions. All entities of the documents are held in a table. Two entities must not share
a surrogate, and a surrogate must not be an entity that occurs (before the @ of an address:
in the same domain). Where they do, all but the first (by canonical form) take the next
attempt, until none collides. From attempt ``SAME_LENGTH`` on surrogates get longer by a sign
each time, so shapes that are too crowded to have a free value resolve too: there is no last
attempt. Equal entities get equal surrogates, different ones different surrogates.

Only documents with an entity are written and joined with the table of surrogates; all
others pass as they are.
"""

from __future__ import annotations

import hashlib
import secrets
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.llm.common import fresh, partitions_for, release, stored

#: Attempts that keep a surrogate's length.
SAME_LENGTH = 4
#: Bytes of text with entities that a task rewrites, on average.
TASK_BYTES = 4 << 20
#: Session setting with the key in hexadecimal, for queries that take none.
KEY_SETTING = "spark.kinset.surrogates.key"

#: Forms of address by gender, in the same languages as the given names (fixed values).
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Mme Madame Mlle Mademoiselle Sra Señora Srta Señorita Doña Signora Г-жа Госпожа Κα Κυρία".split(),
    "m": "Mr Sir Mister Lord Herr Herrn Monsieur Sr Señor Don Signor Signore Г-н Господин Κος Κύριος".split(),
    "n": "Dr Prof Professor Doctor Doktor".split(),
}

#: Given names by script and gender (fixed values); they find names and replace them.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Emma Olivia Sophia Isabella Charlotte Amelia Anna Laura Julia Sabine Claudia Ursula Monika Petra Katharina Céline Amélie Chloé Élodie Margaux Carmen Lucía Sofía Inés Pilar Rocío".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Peter Paul George Kevin Hans Jürgen Klaus Wolfgang Stefan Andreas Jean Pierre Michel François Étienne Carlos José Javier Miguel Antonio Manuel Diego".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия Людмила Вера".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Пётр Виктор Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ιωάννα Ειρήνη".split(),
    ("greek", "m"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Βασίλειος Χρήστος Αθανάσιος Ευάγγελος".split(),
}

#: Parts that make given names by script and gender: beginnings, middles, endings (fixed values);
#: they find no names and only replace them.
MADE = {
    ("latin", "f"): ("Ad Am Ar Bel Bri Cas Cor Dar El Fel Gis Hel Il Jen Kar Lor Mel Nad Or Ros Sel Tal Val Wen Zel".split(), "a e i o an el is or".split(), "abelle alia anda ara elia ena essa etta iana ida ina isa ita ora una".split()),
    ("latin", "m"): ("Ad Al Ar Bar Ber Car Con Dar Ed Fer Gar Hal Ir Jor Ken Lor Mar Ned Or Per Rod Sim Tor Val Wil".split(), "a e i o an el is or".split(), "ald ander ard aro bert do ek er ian im mund o rick ton vin".split()),
    ("cyrillic", "f"): ("Ал Бел Вел Дар Зар Кар Лор Мел Нор Рад Сел Тал".split(), "а е и ан ел".split(), "ана ара елла ина ислава иса ора".split()),
    ("cyrillic", "m"): ("Ал Бор Вел Дар Гор Кар Лор Мир Нор Рад Сел Тим".split(), "а е и ан ел".split(), "ан ей ий ил имир ислав ор".split()),
    ("greek", "f"): ("Αλ Βερ Δαν Ερ Καλ Λυ Μελ Νικ Ρο Σελ Φιλ".split(), "α ε ι ο".split(), "άνα ίνα ένια ίκη όπη ούλα".split()),
    ("greek", "m"): ("Αλ Βερ Δαν Ερ Καλ Λυ Μελ Νικ Ρο Σελ Φιλ".split(), "α ε ι ο".split(), "ανδρος ένης ίας ιος ίωνας όδωρος".split()),
}

#: Parts that make family names, by script: beginnings, middles, endings (fixed values).
FAMILY = {
    "latin": ("Al Bar Bren Cal Dal El Fen Gar Hal Hart Kel Lan Mar Nor Or Pel Ral Sel Tor Ul Ver Wal Wes Zel".split(), "a de en er i li man o ri sen ta va".split(), "berg brook by dale ford gate ham land ley mann mont quist ridge sten stone ton vale ward well wick wood worth".split()),
    "cyrillic": ("Бел Вол Гор Дол Зор Кал Лес Мар Ноз Ор Пол Рад Сол Тур".split(), "а ен ер и ол ор".split(), "анов енко ецкий ин ников овский орин ский ухин ышев".split()),
    "greek": ("Αλ Βελ Γερ Δαλ Ελ Καλ Λαμ Μαρ Νικ Παλ Σαλ Τερ".split(), "α ε ι ο αν ερ".split(), "άκης ίδης όπουλος ούδης ιάδης έας ακος".split()),
}

#: Words inside family names, and words behind a name that are not of it (fixed values).
PARTICLES = "van von der den ter ten zu zur de del della di da do dos das du la le bin ibn al el y".split()
SUFFIXES = "Jr Jnr Snr II III IV".split()
FUNCTION = "The This That These Those There And But For From With When While Where What Who How Why He She They We You It Its His Her In On At Of To By As If Is Was Are Were Has Had Der Die Das Und Ein Eine Ist Er Sie Le La Les Des Une Un Est Et Il Elle El Los Las Una Es".split()


def _words(words: list[str]) -> str:
    """Any of the words, as given or in upper case, with those of one first letter together."""
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.upper()) if not unicodedata.combining(c))
    forms, by = {f for w in words for f in (w, w.upper(), *([bare(w)] if "Ͱ" <= w[0] <= "Ͽ" else []))}, {}
    for w in sorted(forms, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + ")"


_LETTER = r"[\p{L}\p{M}]"
# an 's at the end is not of the word
_JOINED = rf"(?:['’\-](?![sS](?!{_LETTER})){_LETTER}+)"
_WORD = rf"\p{{Lu}}(?:{_LETTER}+|(?=['’])){_JOINED}{{0,4}}"
_ALL_TITLES = _words([t for kind in TITLES.values() for t in kind])
_ALL_GIVEN = _words([n for names in GIVEN.values() for n in names])

_GAP = "[ \u00A0]{1,2}"
#: What no entity has right before it; stated once, before all kinds.
_EDGE = r"(?<![\p{L}\p{N}])"
_STOP = r"(?![\p{L}\p{N}])"

_PARTICLE = f"(?:{'|'.join(w for p in PARTICLES for w in (p, p.capitalize(), p.upper()))})"
# initials and particles before a word of a name
_LINK = rf"(?:{_GAP}(?:(?:\p{{Lu}}\.){{1,4}}|\p{{Lu}}|{_PARTICLE})(?={_GAP})){{0,4}}"
_NAME = rf"(?=\p{{Lu}})(?:{_ALL_TITLES}\.?(?:{_GAP}{_ALL_TITLES}\.?){{0,2}}|{_ALL_GIVEN}(?:-{_LETTER}+){{0,3}}){_LINK}{_GAP}{_WORD}(?:{_LINK}{_GAP}(?!(?:{_ALL_TITLES}|{_words(FUNCTION)})(?!{_LETTER})){_WORD}){{0,6}}{_STOP}"

# cheap and true wherever the long look behind is: most places fail here
_BEHIND = r"(?<=[=:\s\"'])(?<=[=:]\s{0,3}[\"']{0,1})"
_SIGN = r"[!#-%*+\-./0-9:=?@A-Z^_`a-z~]"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HEX = "[0-9A-Fa-f]"

#: (kind, pattern) in order of precedence.
KINDS = (
    ("email", r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+\-]{0,63}+@(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}\-]{0,61}[\p{L}\p{M}\p{N}])?\.){1,126}(?:xn--[a-z0-9\-]{1,58}[a-z0-9]|\p{L}[\p{L}\p{M}]{1,62})"),
    ("secret", r"(?=[Agsx0-9a-fA-F])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|[0-9a-f]{64}|[0-9A-F]{64}|[0-9a-f]{40}|[0-9A-F]{40})" + _STOP),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _STOP),
    ("ssn", r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"),
    ("card", r"(?:[0-9]{4}[ \-]?){3}[0-9]{1,7}" + _STOP),
    ("phone", r"(?=[+(0-9])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|(?<!\+)[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})" + _STOP),
    ("ip", rf"(?=[0-9])(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"),
    ("ip6", rf"(?={_HEX}{{1,4}}:)(?<!:)(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{_HEX}{{1,4}}:){{2,6}}(?::{_HEX}{{1,4}}){{1,6}})(?![\p{{L}}\p{{N}}:])"),
    ("mac", rf"(?={_HEX}{{2}}[:\-])(?<!:)(?:{_HEX}{{2}}[:\-]){{5}}{_HEX}{{2}}(?![\p{{L}}\p{{N}}:])"),
    ("name", _NAME),
    # what stands behind a word such as password; the rest tells the value's place only
    ("secret", _BEHIND + r"(?<=(?i:key|secret|token|password|passwd|pwd|auth)[\"']{0,1}\s{0,3}[=:]\s{0,3}[\"']{0,1})(?=[A-Za-z0-9_\-+/.=]*[0-9])[A-Za-z0-9_\-+/.=]{7,}[A-Za-z0-9_\-+/=]"),
    # behind a word for passwords any value with four letters or digits is one
    ("secret", _BEHIND + rf"(?<=(?i:password|passwd|pwd)[\"']{{0,1}}\s{{0,3}}[=:]\s{{0,3}}[\"']{{0,1}})(?=(?:{_SIGN}*[A-Za-z0-9]){{4}}){_SIGN}+(?<![.:!?])"),
)
PATTERN = _EDGE + "(?:" + "|".join(f"(?:{p})" for _, p in KINDS) + ")"


def entities_of(text: Column) -> Column:
    """The texts of all entities, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _kind(raw: Column) -> Column:
    """The kind of what PATTERN found; null for a number that is no card's, by its check digit."""
    out = F.when(raw.rlike(f"^(?:{KINDS[0][1]})$"), "email")
    for kind, pattern in KINDS[1:-2]:
        of = F.when(_luhn_sum(F.regexp_replace(raw, "[^0-9]", "")) == 0, kind) if kind == "card" else kind
        out = out.when(raw.rlike(f"^(?:{pattern})$"), of)
    return out.otherwise("secret")


def _mail_parts(raw: Column) -> Column:
    """An e-mail address as parts (kind, raw, fixed, canon): what stands before the @, and the domain."""
    none, domain = F.lit(None).cast("string"), F.substring_index(raw, "@", -1)
    part = lambda kind, raw, fixed, canon: F.struct(kind.alias("kind"), raw.alias("raw"), fixed.alias("fixed"), canon.alias("canon"))
    return F.array(
        part(F.lit("mail"), F.substring_index(raw, "@", 1), none, F.lower(raw)),
        part(none, F.lit("@"), F.lit("@"), none),
        part(F.lit("domain"), domain, none, F.lower(domain)),
    )


def _name_parts(raw: Column, key: bytes) -> Column:
    """A name as parts (kind, raw, fixed, canon): forms of address, particles and spaces have no kind.

    Initials have none either, as there are too few to tell all apart: their letters, in
    fixed, are drawn by family name.
    """
    words = F.regexp_extract_all(raw, F.lit("[^ \u00A0]+|[ \u00A0]+"), F.lit(0))
    titles = _words([t for kind in TITLES.values() for t in kind])
    rest = "|".join((*PARTICLES, *SUFFIXES))
    initial = lambda w: w.rlike(r"^(?:(?:\p{Lu}\.)+|\p{Lu})$")
    plain = lambda w: w.rlike(f"^[ \u00A0]+$|^{titles}\\.?$|^(?i:{rest})$") | initial(w)
    # a name of particles only, as Mr Le, is a name all the same
    own = F.filter(words, lambda w: ~plain(w))
    last = F.when(F.size(own) > 0, F.size(words) - F.array_position(F.reverse(words), F.try_element_at(own, F.lit(-1)))).otherwise(F.size(words) - 1)
    family = F.lower(F.element_at(words, (last + 1).cast("int")))
    title = lambda g: F.exists(words, lambda w: w.rlike(f"^{_words(TITLES[g])}\\.?$"))
    of_title = F.when(title("f"), "f").when(title("m"), "m").otherwise("n")

    def part(w: Column, i: Column) -> Column:
        script = F.when(w.rlike("\\p{IsCyrillic}"), "cyrillic").when(w.rlike("\\p{IsGreek}"), "greek").otherwise("latin")
        women, men = (_words([n for (_, g), names in GIVEN.items() if g == x for n in names]) for x in "fm")
        gender = F.when(w.rlike(f"^{women}$"), "f").when(w.rlike(f"^{men}$"), "m").otherwise(of_title)
        kind = F.when(i == last, F.concat_ws(":", F.lit("family"), script)).when(plain(w), F.lit(None)).otherwise(F.concat_ws(":", F.lit("given"), script, gender))
        fixed = F.when(initial(w) & (i != last), F.upper(_same_shape(F.lower(w), _hmac(key, F.concat_ws("\u0001", F.lit("initial"), family)))))
        return F.struct(kind.alias("kind"), w.alias("raw"), fixed.alias("fixed"), F.lower(w).alias("canon"))

    return F.transform(words, part)


#: Kinds whose canonical form is their letters and digits only.
NUMBERS = ("iban", "ssn", "card", "phone", "mac")


def _canonical(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin(*NUMBERS), F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))).when(kind == "secret", raw).otherwise(F.lower(raw))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once, also where `of` uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _byte(i: Column, seed: Column) -> Column:
    """The i-th (from 0) of endless pseudo-random numbers in 0..65535 of a seed, itself secret."""
    block = F.sha2(F.concat_ws("\u0001", seed, F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substr(block, (4 * (i % 16) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


#: Code points from which letters of these scripts are drawn: from, to, step (fixed values).
SCRIPTS = {
    "Han": (0x4E00, 0x9F00, 97),
    "Hebrew": (0x5D0, 0x5EB),
    "Arabic": (0x628, 0x63B),
    "Devanagari": (0x915, 0x93A),
    "Bengali": (0x995, 0x9A9),
    "Tamil": (0xBAE, 0xBB6),
    "Thai": (0xE01, 0xE2F),
    "Hangul": (0xAC00, 0xD7A4, 588),
    "Hiragana": (0x304B, 0x3063),
    "Katakana": (0x30AB, 0x30C3),
    "Armenian": (0x561, 0x587),
    "Georgian": (0x10D0, 0x10F1),
}

_ALPHABETS = (
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("\\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    ("\\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("\\p{IsLatin}", "àáâäåçèéêëìíîïñòóôöùúûü"),
    *[(f"\\p{{Is{script}}}", "".join(map(chr, range(*span)))) for script, span in SCRIPTS.items()],
    # letters and digits of all other scripts; marks go with the letters that they stood on
    ("\\p{N}", "0123456789"),
    ("\\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    ("\\p{M}", ""),
)


def _pick(words, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))


def _same_shape(text: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """text with every letter and digit drawn anew from its own alphabet."""
    return _let(seed, lambda s: _drawn(text, s, hexadecimal))


def _drawn(text: Column, seed: Column, hexadecimal: Column | None) -> Column:
    def draw(c: Column, i: Column) -> Column:
        return _let(_byte(i, seed), lambda n: letter(c, n))

    def letter(c: Column, n: Column) -> Column:
        out = F.when(c.rlike(_ALPHABETS[0][0]), F.substr(F.lit(_ALPHABETS[0][1]), n % 10 + 1, F.lit(1)))
        if hexadecimal is not None:
            out = out.when(hexadecimal & c.rlike("[a-f]"), F.substr(F.lit("abcdef"), n % 6 + 1, F.lit(1))).when(hexadecimal & c.rlike("[A-F]"), F.substr(F.lit("ABCDEF"), n % 6 + 1, F.lit(1)))
        for pattern, letters in _ALPHABETS[1:]:
            out = out.when(c.rlike(pattern), F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1)) if letters else F.lit(""))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn_sum(digits: Column) -> Column:
    """The weighted sum of all digits, the last one undoubled, modulo 10."""
    d = F.reverse(F.split(digits, ""))
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(2 * c.cast("int") / 10).cast("int") + (2 * c.cast("int")) % 10)
    return F.aggregate(F.transform(d, doubled), F.lit(0), lambda a, x: a + x) % 10


def _iban_rest(text: Column) -> Column:
    number = lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(F.upper(c)) - 55).cast("string"))
    return F.aggregate(F.transform(F.split(text, ""), number), F.lit(0).cast("long"), lambda a, x: (F.when(F.length(x) == 1, a * 10).otherwise(a * 100) + x.cast("long")) % 97)


def _space(kind: Column, canon: Column) -> Column:
    """Surrogates differ within a space: a kind, and for what stands before an @ its domain."""
    return F.when(kind == "mail", F.concat(F.lit("mail:"), F.substring_index(canon, "@", -1))).otherwise(F.substring_index(kind, ":", 1))


def _surrogate(kind: Column, canon: Column, seed: Column, attempt: int) -> Column:
    """The surrogate of a canonical form, canonical itself; seed: the entity's HMAC."""
    seed = F.concat_ws("\u0001", seed, F.lit(str(attempt)))
    at = lambda i: _byte(F.lit(i), seed)
    wider = max(0, attempt + 1 - SAME_LENGTH)
    longer = lambda text, sign: F.concat(text, F.lit(sign * wider))
    shape = lambda text, sign: _same_shape(longer(text, sign), seed)
    hexadecimal = canon.rlike("^(?:[0-9a-f:]+|[0-9A-F:]+)$")
    secret = _same_shape(longer(canon, "0"), seed, hexadecimal)
    mail = shape(F.substring_index(canon, "@", 1), "a")
    domain = F.concat(_same_shape(F.lit("a" * (8 + wider)), seed), F.lit(".example."), _pick(("com", "org", "net"), at(1000)))
    digits = shape(canon, "0")
    card = _let(digits, lambda d: F.when(_luhn_sum(canon) == 0, _let(F.substr(d, F.lit(1), F.length(d) - 1), lambda body: F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string")))).otherwise(d))
    country = F.substr(canon, F.lit(1), F.lit(2))
    iban = _let(F.substr(digits, F.lit(5)), lambda account: F.concat(country, F.lpad((98 - _iban_rest(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account))
    # a fifth octet, only where no address is free
    ip = F.concat_ws(".", (at(0) % 223 + 1).cast("string"), *[(at(i) % 256).cast("string") for i in range(1, 4 + wider)])
    mac = F.substr(F.sha2(seed, 256), F.lit(1), F.lit(12 + wider))
    out = F.when(kind == "mail", mail).when(kind == "domain", domain).when(kind.isin("secret", "ip6"), secret).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "mac", mac)
    out = out.when(kind == "phone", F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2))))
    # names: one word, and more parts with later attempts, so that there are always enough
    more = attempt // 3
    for script, (first, middle, end) in FAMILY.items():
        name = F.concat(_pick(first, at(0)), *[_pick(middle, at(2 + i)) for i in range(more)], _pick(end, at(1)))
        out = out.when(kind == f"family:{script}", F.lower(name))
        for gender in "fmn":
            if more:
                # where listed names are taken, made ones; there are always longer ones
                ways = [parts for (sc, g), parts in MADE.items() if sc == script and gender in (g, "n")]
                made = [F.concat(_pick(begin, at(0)), *[_pick(inner, at(2 + i)) for i in range(more - 1)], _pick(last, at(1))) for begin, inner, last in ways]
                name = made[0] if len(made) == 1 else F.when(at(99) % 2 == 0, made[0]).otherwise(made[1])
            else:
                name = _pick([n for (sc, g), names in GIVEN.items() if sc == script and gender in (g, "n") for n in names], at(0))
            out = out.when(kind == f"given:{script}:{gender}", F.lower(name))
    return out.otherwise(digits)


def _as_name(raw: Column, surrogate: Column) -> Column:
    upper = (F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(raw) > 1)
    return F.when(upper, F.upper(surrogate)).otherwise(F.replace(F.initcap(F.replace(surrogate, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-")))


def _mentions(gap: Column, names: Column) -> Column:
    """The pieces (old, new) of a text between entities: words that names (canon to surrogate) holds are new."""
    # a bounded number of joints: the engine's stack grows with it
    pieces = lambda t, joint: F.regexp_extract_all(t, F.lit(rf"[\p{{L}}\p{{M}}\p{{N}}]+{joint}|[^\p{{L}}\p{{M}}\p{{N}}]+"), F.lit(0))
    of = lambda w: F.when(w.rlike(r"^\p{Lu}"), _as_name(w, F.try_element_at(names, F.lower(w))))
    # of a joined word that is no name, each part may be one
    within = lambda w: F.when(w.rlike("['’\\-]"), F.array_join(F.transform(pieces(w, ""), lambda x: F.coalesce(of(x), x)), "")).otherwise(w)
    words = pieces(gap, rf"{_JOINED}{{0,15}}")
    return F.transform(words, lambda w: F.struct(w.alias("old"), F.coalesce(of(w), within(w)).alias("new")))


def _formatted(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of an occurrence: its separators, its case."""
    upper = (F.upper(raw) == raw) & (F.lower(raw) != raw)
    chars = F.split(raw, "")
    kept = lambda i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda c: c.rlike("[A-Za-z0-9]")))
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(surrogate, kept(i), F.lit(1))).otherwise(c)), "")
    # what a longer surrogate has more stands at the end
    filled = F.concat(filled, F.substr(surrogate, F.length(F.regexp_replace(raw, "[^A-Za-z0-9]", "")) + 1))
    filled = F.when(upper, F.upper(filled)).otherwise(filled)
    cased = _let(chars, lambda r: F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: _let(F.get(r, i), lambda x: F.when((F.upper(x) == x) & (F.lower(x) != x), F.upper(c)).otherwise(c))), ""))
    out = F.when(kind.isin(*NUMBERS), filled).when(kind.startswith("given") | kind.startswith("family"), _as_name(raw, surrogate))
    return out.when(kind.isin("mail", "domain", "ip6") & upper, F.upper(surrogate)).when(kind == "mail", cased).otherwise(surrogate)


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon), without collisions."""
    own = F.when(F.col("kind") == "mail", F.substring_index("canon", "@", 1)).otherwise(F.col("canon"))
    space, seed = _space(F.col("kind"), F.col("canon")), _hmac(key, F.concat_ws("\u0001", "kind", "canon"))
    pending = stored(entities.select("kind", "canon", space.alias("space"), own.alias("own"), seed.alias("seed")), "entities")
    known = pending.select("space", F.col("own").alias("s")).distinct()
    waiting, attempt, done = pending, 0, None
    while True:
        tried = stored(waiting.select("kind", "canon", "space", "own", "seed", _surrogate(F.col("kind"), F.col("canon"), F.col("seed"), attempt).alias("s")), "tried")
        # what still reads as the original is no surrogate
        reads = (F.length("own") > 2) & F.col("own").rlike(r"[\p{L}\p{N}]") & F.contains(F.lower("s"), F.lower("own"))
        first = tried.where(~reads).groupBy("space", "s").agg(F.min(F.struct("canon", "kind")).alias("first")).join(known, ["space", "s"], "left_anti")
        if done is not None:
            first = first.join(done.select("space", "s"), ["space", "s"], "left_anti")
        won = stored(tried.join(first, ["space", "s"]).where(F.struct("canon", "kind") == F.col("first")).select("kind", "canon", "space", "s"), "won")
        done = won if done is None else done.unionByName(won)
        left = stored(tried.join(won, ["kind", "canon"], "left_anti").drop("s"), "pending")
        release(tried, *([waiting] if attempt else []))
        if left.isEmpty():
            return done.select("kind", "canon", F.col("s").alias("surrogate"))
        waiting, attempt = left, attempt + 1


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", count: str = "__entities") -> DataFrame:
    """docs with surrogates in text_col; one column more, count: how many were replaced.

    key: who knows it can tell which surrogate an entity has; the same key gives the same
    draws. Null texts stay null and have 0; texts without an entity stay as they are, to the
    byte. Rows repeat as given; all other columns, whatever they are called, stay.
    """
    if len(key) < 16:
        raise ValueError("the key must have at least 16 bytes")
    spark = docs.sparkSession
    row, key_, found_, new, names, map_, gaps, real = fresh(docs, "row", "key", "found", "new", "names", "map", "gaps", "real")
    text = docs[text_col]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    has = F.coalesce(text.rlike(PATTERN), F.lit(False))
    # documents with an entity are written, with a number for each row
    hit = stored(docs.where(has).select(*columns, F.monotonically_increasing_id().alias(row), entities_of(text).alias(found_)), "with-entities")
    size = hit.agg(F.sum(F.octet_length(hit[text_col]))).first()[0] or 0
    parts = partitions_for(spark, size, TASK_BYTES)
    found = hit.select(F.col(row).alias("row"), F.posexplode(found_).alias("at", "raw")).withColumn("kind", _kind(F.col("raw")))
    whole = F.array(F.struct("kind", "raw", F.lit(None).cast("string").alias("fixed"), _canonical(F.col("kind"), F.col("raw")).alias("canon")))
    pieces = F.when(F.col("kind") == "name", _name_parts(F.col("raw"), key)).when(F.col("kind") == "email", _mail_parts(F.col("raw"))).otherwise(whole)
    found = stored(found.select("row", "at", F.posexplode(pieces).alias("part", "p")).select("row", "at", "part", "p.*"), "found")
    table = surrogate_table(found.where("kind IS NOT NULL").select("kind", "canon").distinct(), key)
    named = found.join(table, ["kind", "canon"], "left").withColumn("new", F.coalesce(_formatted(F.col("kind"), F.col("raw"), F.col("surrogate")), "fixed", "raw"))
    # all parts of an entity, then all entities of a row, put together in order
    part = F.col("kind").startswith("given") | F.col("kind").startswith("family")
    word = part & ~F.col("canon").isin([w.lower() for w in (*FUNCTION, *PARTICLES)])
    whole = named.repartition(parts, "row").groupBy("row", "at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda p: p["new"]), "").alias("new"),
        F.collect_list(F.when(word, F.struct("canon", "kind", "surrogate"))).alias("words"),
        F.max(F.col("kind").isNotNull().cast("int")).alias("real"),
    )
    lists = whole.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda p: p["new"]).alias(new),
        # a word that is a given and a family name stands alone as a family name
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias(names),
        F.sum("real").cast("int").alias("real"),
    )
    only = F.filter(names, lambda x, i: (i == 0) | (F.try_element_at(F.col(names), i)["canon"] != x["canon"]))
    lists = lists.withColumn(map_, F.map_from_entries(F.transform(only, lambda x: F.struct(x["canon"], x["surrogate"]))))
    changed = hit.repartition(parts, row).join(lists.withColumnRenamed("row", key_).withColumnRenamed("real", real), F.col(row) == F.col(key_))
    split = F.transform(F.split(hit[text_col], PATTERN), lambda g: F.when(F.size(names) > 0, _mentions(g, F.col(map_))).otherwise(F.array(F.struct(g.alias("old"), g.alias("new")))))
    changed = changed.withColumn(gaps, split)
    text_of = F.array_join(F.transform(gaps, lambda g, i: F.concat(F.array_join(F.transform(g, lambda x: x["new"]), ""), F.coalesce(F.get(F.col(new), i), F.lit("")))), "")
    alone = F.aggregate(gaps, F.lit(0), lambda n, g: n + F.size(F.filter(g, lambda x: x["old"] != x["new"])))
    plain = docs.where(~has).select(*columns, F.lit(0).alias(count))
    # the text is made last, in place of the old one
    changed = changed.select(*[text_of.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], (F.col(real) + alone).alias(count))
    return plain.unionByName(changed)


def replaced(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with surrogates for the entities in their texts; columns are those of docs.

    A column length_col, where there is one, is set anew for texts that change.
    """
    (count,) = fresh(docs, "entities")
    out = with_surrogates(docs, key, id_col, text_col, count)
    if docs.columns.count(length_col) == 1 and length_col != text_col:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(count) > 0, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's settings name, or one drawn at random for this session."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return bytes.fromhex(named)
    sc = spark.sparkContext
    if not hasattr(sc, "_kinset_surrogates_key"):
        sc._kinset_surrogates_key = secrets.token_bytes(32)
    return sc._kinset_surrogates_key


def query(docs: DataFrame) -> DataFrame:
    """The result of op2: doc_id, text with surrogates, n_entities, under the session's key."""
    out = with_surrogates(docs.select("doc_id", "text"), session_key(docs.sparkSession))
    return out.select("doc_id", "text", F.col("__entities").cast("long").alias("n_entities"))
