"""Dense document statistics, computed over whole texts in slabs of bytes.

``statistics`` serves both classifiers; ``lexicon_features`` adds what the toxicity model
reads. No label, language, source or id enters. Every value of an empty text is 0.
"""

from __future__ import annotations

import numpy as np

from kinset.llm import bytetext as bt

#: Frequent function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that it for was with on as at by this be are from or an have not which you a "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et en un une du dans est que qui pour par sur pas au plus avec ne se ce il sont "
    "el los las de y en que un una por con no se su para es al lo como más o pero sus"
).split()

#: Pronouns that address the reader, in the same languages (fixed values).
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus os".split()

#: Insults and abuse in the same languages (fixed values).
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass loser losers clown clowns scum scumbag trash garbage worthless pathetic disgusting "
    "filth filthy vermin imbecile cretin retard retarded fool fools foolish jerk creep creepy freak pig swine rat bastard bitch bitches whore slut asshole arsehole "
    "ass fuck fucking fucked fucker motherfucker shit shitty bullshit crap crappy dick dickhead prick cunt twat wanker douche douchebag piss hate despise kill die "
    "ugly lame losers nazi subhuman degenerate parasite coward cowardly liar liars thug dimwit halfwit nitwit numbskull airhead bonehead twit lowlife "
    "arschloch arsch scheiße scheisse scheiß wichser hurensohn hure schlampe fotze idioten dumm dummkopf blödmann blöd trottel depp penner spast schwein drecksau miststück missgeburt abschaum "
    "connard connasse salope salaud putain pute merde enculé enfoiré abruti abrutie crétin débile imbécile bâtard ordure pourriture raclure bouffon minable "
    "idiota imbécil estúpido estúpida tonto tonta gilipollas cabrón puta puto mierda pendejo maricón zorra perra basura asqueroso escoria payaso inútil subnormal capullo"
).split()

#: Digits and signs that stand for letters in disguised words (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

STATISTICS = (
    "log_words word_length long_words one_letter capitals all_caps titles digits exclaim question comma_stop symbols pipes other_punctuation accents "
    "log_lines line_words short_lines dup_lines same_as_before distinct_words top_word function_words pairs_again symbol_words numbers spaces"
).split()

_FUNCTION = np.unique(np.array([bt.text_hash(w) for w in FUNCTION_WORDS], np.uint64))
_SECOND = np.unique(np.array([bt.text_hash(w) for w in SECOND_PERSON], np.uint64))
_INSULTS = np.unique(np.array([bt.text_hash(w) for w in INSULTS], np.uint64))

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _marks("#*$%&<>")
_OTHER = _marks("\"'()[]{}/\\_^~`+=;:-@")
_LEET_MAP = bt.LOWER.copy()
for _a, _b in LEET.items():
    _LEET_MAP[ord(_a)] = ord(_b)
_MASK = _marks("*#@$%")
_TRAIL = _marks(".,;:!?\"')")


def _shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, count / np.maximum(whole, 1), 0.0)


def _per_word(marked: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = bt.running(marked)
    return (sums[end] - sums[start]).astype(np.int64)


def _earlier(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of the columns: whether an equal row came before, and how many are equal.

    Rows are grouped by a hash of their values and then compared with the first of the group.
    """
    columns = [c.astype(np.uint64) for c in columns]
    _, first, at, size = np.unique(bt.chain(*columns), return_index=True, return_inverse=True, return_counts=True)
    of = first[at]
    if not all(np.array_equal(c[of], c) for c in columns):
        _, first, at, size = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
        at = at.ravel()
        of = first[at]
    return of != np.arange(len(of)), size[at]


def statistics(slab: bt.Slab) -> np.ndarray:
    """One row of STATISTICS for each text of the slab."""
    buf, per = slab.buf, slab.per_text
    lower = bt.LOWER[buf]
    hasher = bt.Hasher(lower)
    start, end, first = slab.words(bt.NOT_SPACE)
    text = np.repeat(np.arange(slab.n), np.diff(first))
    sums = lambda x: bt.segment_sums(x.astype(np.int64), first)
    words = np.diff(first)
    size = np.diff(slab.off)
    letters = _per_word(_LETTER[buf] | (buf >= 0x80), start, end)
    upper = _per_word(_UPPER[buf], start, end)
    length = end - start
    plain_start, plain_end, plain_first = slab.words(bt.ALNUM, lower)
    h = hasher(plain_start, plain_end)
    plain_text = np.repeat(np.arange(slab.n), np.diff(plain_first))
    again, count = _earlier(h, plain_text)
    plain = np.diff(plain_first)
    top = np.zeros(slab.n)
    if len(count):
        some = plain > 0
        top[some] = np.maximum.reduceat(count, plain_first[:-1][some])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (plain_text[1:] == plain_text[:-1])
    pair = np.zeros(len(h), bool)
    if len(h) > 1:
        pair_again, _ = _earlier(bt.chain(h[:-1], h[1:]), plain_text[:-1])
        pair[1:] = pair_again & (plain_text[1:] == plain_text[:-1])
    lo, hi, line_first = slab.lines()
    begins = np.zeros(len(buf), bool)
    begins[start] = True
    in_line = _per_word(begins, lo, hi)
    has = in_line > 0
    line_text = np.repeat(np.arange(slab.n), np.diff(line_first))
    line_again = np.zeros(len(lo), bool)
    line_again[has] = _earlier(bt.Hasher(buf)(lo[has], hi[has]), line_text[has])[0]
    lsum = lambda x: bt.segment_sums(x.astype(np.int64), line_first)
    lines = lsum(has)
    psum = lambda x: bt.segment_sums(x.astype(np.int64), plain_first)
    all_letters = per(_LETTER[buf]) + per(buf >= 0xC0)
    cols = [
        np.log1p(words),
        _shares(sums(length), words) / 10,
        _shares(sums(letters > 14), words),
        _shares(sums(letters == 1), words),
        _shares(per(_UPPER[buf]), all_letters),
        _shares(sums((upper > 1) & (2 * upper > letters)), words),
        _shares(sums(upper == 1), words),
        _shares(per(_DIGIT[buf]), size),
        _shares(per(buf == 33), words),
        _shares(per(buf == 63), words),
        _shares(per((buf == 44) | (buf == 46)), words),
        _shares(per(_SYMBOL[buf]), words),
        _shares(per(buf == 124), words),
        _shares(per(_OTHER[buf]), words),
        _shares(per(buf >= 0xC0), all_letters),
        np.log1p(lines),
        np.log1p(_shares(words, lines)),
        _shares(lsum(has & (in_line < 4)), lines),
        _shares(lsum(line_again), lines),
        _shares(psum(same), plain),
        1 - _shares(psum(again), plain),
        _shares(top, plain),
        _shares(psum(bt.found_in(h, _FUNCTION) >= 0), plain),
        _shares(psum(pair), plain),
        _shares(sums(letters == 0), words),
        _shares(sums((_per_word(_DIGIT[buf], start, end) > 0)), words),
        _shares(size - sums(length), size),
    ]
    return np.stack(cols, axis=1).astype(np.float32)


#: Code points of the word beginnings that the learned lexicon holds, beside whole words.
STEMS = (4, 5, 6, 7)


def stem_hashes(slab: bt.Slab) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(first, hashes, word hash): each word's beginnings of STEMS code points; 0 if shorter."""
    lower = bt.LOWER[slab.buf]
    start, end, first = slab.words(bt.ALNUM, lower)
    hasher = bt.Hasher(lower)
    leads = np.flatnonzero(bt.LEADS[lower])
    rank = bt.running(bt.LEADS[lower])
    leads = np.concatenate([leads, np.full(max(STEMS) + 1, len(lower), np.int64)])
    out = []
    for k in STEMS:
        stop = leads[rank[start] + k]
        long = rank[end] - rank[start] > k
        h = np.zeros(len(start), np.uint64)
        h[long] = bt.mix(hasher(start[long], stop[long]) + np.uint64(k))
        out.append(h)
    return first, out, hasher(start, end)


LEXICON = "insults log_insults distinct_insults near_reader addressed disguised masked stretched learned learned_strong log_learned learned_weight learned_top".split()


def lexicon_features(slab: bt.Slab, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of LEXICON for each text; table (sorted hashes) and weight: the learned lexicon."""
    lower = bt.LOWER[slab.buf]
    hasher = bt.Hasher(lower)
    start, end, first = slab.words(bt.ALNUM, lower)
    h = hasher(start, end)
    n = np.diff(first)
    text = np.repeat(np.arange(slab.n), n)
    sums = lambda x: bt.segment_sums(x, first)
    bad = bt.found_in(h, _INSULTS) >= 0
    reader = bt.found_in(h, _SECOND) >= 0
    again, _ = _earlier(h, text)
    # insults within five words of a word that addresses the reader
    near = np.zeros(len(h), bool)
    for d in range(1, 6):
        near[d:] |= reader[:-d] & (text[d:] == text[:-d])
        near[:-d] |= reader[d:] & (text[d:] == text[:-d])
    # disguised words: a plain insult once signs are read as letters, though not before
    whole_start, whole_end, whole_first = slab.words(bt.NOT_SPACE)
    for _ in range(3):  # what closes a clause is no part of a word
        whole_end = whole_end - ((whole_end - whole_start > 1) & _TRAIL[slab.buf[whole_end - 1]])
    leet = _LEET_MAP[slab.buf]
    fold = bt.Hasher(leet)(whole_start, whole_end)
    as_is = hasher(whole_start, whole_end)
    hidden = (bt.found_in(fold, _INSULTS) >= 0) & (fold != as_is)
    inner = np.zeros(len(slab.buf), bool)
    if len(inner) > 2:
        letter = _LETTER[slab.buf]
        inner[1:-1] = _MASK[slab.buf[1:-1]] & letter[:-2] & letter[2:]
    triple = np.zeros(len(slab.buf), bool)
    if len(triple) > 2:
        triple[2:] = (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & _LETTER[lower[2:]]
    stem_first, stems, words = stem_hashes(slab)
    best = np.zeros(len(words))
    for s in [words, *stems]:
        at = bt.found_in(s, table)
        best = np.maximum(best, np.where(at >= 0, weight[at] if len(weight) else 0, 0))
    learned, strong = best > 0, best > 2.5
    bsum = lambda x: bt.segment_sums(x, stem_first)
    ints = lambda x: x.astype(np.int64)
    top = np.zeros(slab.n)
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(best, first[:-1][some])
    insults, found = sums(ints(bad)), bsum(ints(learned))
    cols = [
        100 * _shares(insults, n),
        np.log1p(insults),
        np.log1p(sums(ints(bad & ~again))),
        np.log1p(sums(ints(bad & near))),
        _shares(sums(ints(reader)), n),
        np.log1p(bt.segment_sums(ints(hidden), whole_first)),
        np.log1p(slab.per_text(inner)),
        np.log1p(slab.per_text(triple)),
        100 * _shares(found, n),
        100 * _shares(bsum(ints(strong)), n),
        np.log1p(found),
        100 * _shares(bsum(best), n),
        top,
    ]
    return np.stack(cols, axis=1).astype(np.float32)
