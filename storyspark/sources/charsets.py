"""Telling character sets apart by the likelihood of what their bytes stand for.

A text is decoded in each character set in which its bytes are valid. Every reading is scored as a chain of
kinds of characters: how likely a kind follows the one before (a Chinese sign hardly ever stands
inside a Latin word), and how likely this character is among its kind in such texts. The
standards put the signs in common use in a level of their own, and what is read in the wrong character set
falls among the rare ones. The best reading wins; how far it leads tells how sure that is.

A chain tells nothing of the text as a whole. So a reading of a rare sort (East Asian signs here and there in a Latin text,
Greek or Cyrillic in a set for Chinese, Japanese or Korean) that would win has to win again by its distinct words alone, and by
as much as such texts are rarer: a word that stands there twice tells no more than once.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Character sets that are tried, in the order in which they win ties.
CHARSETS = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr", "latin-1", "utf-16-le", "utf-16-be", "utf-8")
#: Lead of the best reading over the next, in natural logarithms, from which on it counts as sure.
SURE = 7.0
#: Likelihood of a byte among random ones, and how much less likely a reading may be: below that it is no text.
RANDOM, SLACK = -math.log(256), 8.0

#: Share of texts with East Asian signs, in a character set for them, in which Latin letters outnumber these signs; there, how much rarer a word that begins with a sign is.
MIXED, BEGUN = 1 / 200, 1 / 8
#: Share of texts in a character set for East Asian signs in which letters of other alphabets outnumber these signs, and of UTF-16 texts without one character up to U+00FF or a multiple of 256.
FOREIGN, ZEROLESS = 1 / 5000, 1 / 10

# Kinds of characters.
CONTROL, BLANK, ASCII, ACCENTED, ALPHABET, KANA, TOP, COMMON, RARE, HANGUL, MARK, SYMBOL, HALF, NONE, ODD = range(15)
#: The signs used most in Chinese (both scripts) and Japanese texts.
MOST_USED = "的一是不了在人有我他这這个個们們中来來上大为為和国國地到以说說时時要就出会會可也你对對生能而子那得于於着著下自之年过過发發后後作里裡用道行所然家种種事成方多经經么麼去法学學如都同现現当當没沒动動面起看定天分还還进進好小部其些主样樣理心她本前开開但因只从從想实實日者意无無力它与與长長把机機十民第公此已工使情明性知全三又关關点點正业業外将將两兩高间間由问問很最重并並物手应應战戰向头頭文体體政美相见見被利什二等产產"
#: The syllables used most in Korean, the share of texts that they make, and hiragana that hardly ever stand there and how rare they are among kana.
MOST_HANGUL, HANGUL_SHARE = "이다는에의을가고하은지한로서를리도기사어나시자대일인해보아스라부수정장으전그들주있것원제상구여성화동유공게만적면과년문니신국경조비오치연우관방생계소학되모안회무용내민선요세영물체실법개단행위마까심말금발업진재각결교현트했통미러터건르간입산차없거명점당습할중더호초배종번속였강직분음야려본처알었", 0.5
SMALL_KANA, SMALL_SHARE = "ぁぃぅぇぉゎ", 1 / 2000
#: Which of the kinds may follow which: probabilities by groups (Latin words; blanks, digits and ASCII signs; East Asian; other alphabets; the rest).
_GROUPS = {CONTROL: 4, BLANK: 1, ASCII: 0, ACCENTED: 0, ALPHABET: 3, KANA: 2, TOP: 2, COMMON: 2, RARE: 2, HANGUL: 2, MARK: 2, SYMBOL: 4, HALF: 2, NONE: 4, ODD: 4}
_FOLLOWS = np.array([
    [0.80, 0.196, 0.001, 0.0005, 0.0025],
    [0.50, 0.34, 0.10, 0.05, 0.01],
    [0.01, 0.088, 0.90, 0.0005, 0.0015],
    [0.002, 0.19, 0.0005, 0.80, 0.0075],
    [0.15, 0.35, 0.20, 0.10, 0.20],
])
#: Kinds of letters and signs that are not Latin.
_SIGNS = [ALPHABET, KANA, TOP, COMMON, RARE, HANGUL, HALF]
#: Share of each kind in its group, by the script that a character set is for; the rest of a group's share is split evenly.
_SHARES = {
    "chinese": {ASCII: 0.95, ACCENTED: 0.05, KANA: 0.002, TOP: 0.30, COMMON: 0.56, RARE: 0.015, HANGUL: 0.0001, MARK: 0.12, HALF: 0.0001},
    "japanese": {ASCII: 0.95, ACCENTED: 0.02, KANA: 0.55, TOP: 0.05, COMMON: 0.27, RARE: 0.01, HANGUL: 0.0001, MARK: 0.11, HALF: 0.003},
    "korean": {ASCII: 0.95, ACCENTED: 0.02, KANA: 0.001, TOP: 0.003, COMMON: 0.01, RARE: 0.01, HANGUL: 0.93, MARK: 0.04, HALF: 0.0001},
    "western": {ASCII: 0.95, ACCENTED: 0.05, KANA: 0.1, TOP: 0.1, COMMON: 0.1, RARE: 0.1, HANGUL: 0.1, MARK: 0.1, HALF: 0.1},
    "any": {ASCII: 0.95, ACCENTED: 0.05, KANA: 0.2, TOP: 0.2, COMMON: 0.35, RARE: 0.01, HANGUL: 0.14, MARK: 0.1, HALF: 0.001},
}
_SCRIPT = {"gb18030": "chinese", "big5": "chinese", "shift_jis": "japanese", "euc_jp": "japanese", "euc_kr": "korean", "latin-1": "western", "utf-16-le": "any", "utf-16-be": "any", "utf-8": "any"}
#: Lead bytes of the level in common use, in the encoding that orders its signs by level.
_LEVEL = {"gb18030": ("gb2312", 0xB0, 0xD7), "big5": ("big5", 0xA4, 0xC6), "shift_jis": ("euc_jp", 0xB0, 0xCF), "euc_jp": ("euc_jp", 0xB0, 0xCF), "euc_kr": ("euc_kr", 0xCA, 0xCA)}


@lru_cache(maxsize=None)
def _signs(encoding: str, low: int, high: int) -> frozenset[str]:
    """Characters of two bytes, by the first of them."""
    pairs = (bytes([a, b]).decode(encoding, "ignore") for a in range(low, high + 1) for b in range(0x40, 0xFF))
    return frozenset(c for c in pairs if len(c) == 1 and not c.isascii())


def _level(name: str) -> set[str]:
    return {c for c in _signs(*_LEVEL[name]) if ord(c) > 0x2FFF}


def _usual() -> set[str]:
    """Symbols that stand in an East Asian standard, and those of general punctuation."""
    found = set().union(_signs("gb2312", 0xA1, 0xA9), _signs("euc_jp", 0xA1, 0xA8), _signs("euc_kr", 0xA1, 0xAC), _signs("big5", 0xA1, 0xA3))
    return found | set(map(chr, range(0x2010, 0x2028))) | set(map(chr, range(0x2030, 0x203F))) | {"\u20ac"}


@lru_cache(maxsize=None)
def _kinds(name: str) -> np.ndarray:
    """The kind of each character up to U+FFFF in a character set; all above are rare."""
    kind = np.full(1 << 16, ODD, np.uint8)
    kind[0xA0:0xC0] = kind[0x250:0x370] = kind[[ord(c) for c in _usual()]] = SYMBOL
    kind[:0x20] = kind[0x7F:0xA0] = CONTROL
    kind[[9, 10, 13]] = BLANK
    kind[0x20:0x7F] = BLANK
    for a, b in ((0x41, 0x5B), (0x61, 0x7B)):
        kind[a:b] = ASCII
    kind[0xC0:0x250] = ACCENTED
    kind[[0xD7, 0xF7]] = SYMBOL
    kind[0x370:0x460] = ALPHABET
    kind[[0x3AA, 0x3AB, 0x3B0]] = kind[0x460:0x530] = SYMBOL  # these hardly ever stand alone
    kind[0x2010:0x2027] = MARK if _SCRIPT[name] != "western" else SYMBOL
    kind[0x3000:0x3040] = kind[0xFF01:0xFF61] = MARK
    kind[0x3040:0x3100] = KANA
    kind[0xFF61:0xFFA0] = HALF
    kind[0xAC00:0xD7A4] = RARE
    kind[[ord(c) for c in _signs("euc_kr", 0xB0, 0xC8)]] = HANGUL
    kind[0x3400:0xA000] = kind[0xF900:0xFB00] = RARE
    kind[0xE000:0xF900] = kind[0xFFF0:] = kind[0x0530:0x1100] = NONE
    level = set().union(*map(_level, _LEVEL)) if name.startswith("utf") else _level(name) if name in _LEVEL else set()
    kind[[ord(c) for c in level if 0x3400 <= ord(c) < 0xA000]] = COMMON
    kind[[ord(c) for c in MOST_USED if _SCRIPT[name] != "japanese" or c in level]] = TOP
    return kind


@lru_cache(maxsize=None)
def _weights() -> np.ndarray:
    """Logarithms of how much more or less often a character stands than the others of its kind."""
    out = np.zeros(1 << 16)
    top = list(dict.fromkeys(MOST_USED))  # the most frequent first
    share = 1 / (np.arange(len(top)) + 4)
    out[[ord(c) for c in top]] = np.log(_SIZES[TOP] * share / share.sum())
    out[0xAC00:0xD7A4] = math.log(_SIZES[HANGUL] * (1 - HANGUL_SHARE) / (2350 - len(set(MOST_HANGUL))))
    out[[ord(c) for c in MOST_HANGUL]] = math.log(_SIZES[HANGUL] * HANGUL_SHARE / len(set(MOST_HANGUL)))
    out[[ord(c) for c in SMALL_KANA]] = math.log(_SIZES[KANA] * SMALL_SHARE)
    return out


#: Characters among which a kind's share is split.
_SIZES = {CONTROL: 60, BLANK: 25, ASCII: 30, ACCENTED: 40, ALPHABET: 60, KANA: 90, TOP: 150, COMMON: 1500, RARE: 20000, HANGUL: 900, MARK: 12, SYMBOL: 200, HALF: 60, NONE: 60000, ODD: 10000}


@lru_cache(maxsize=None)
def _chain(name: str) -> np.ndarray:
    """Logarithms of the likelihood of a character of one kind after one of another."""
    share = _SHARES[_SCRIPT[name]] | {BLANK: 1.0, ALPHABET: 1.0 if _SCRIPT[name] in ("western", "any") else 0.1, CONTROL: 1e-5, SYMBOL: 0.9, NONE: 1e-6, ODD: 0.02}
    out = np.zeros((15, 15))
    for a, ga in _GROUPS.items():
        for b, gb in _GROUPS.items():
            out[a, b] = math.log(_FOLLOWS[ga, gb] * share[b] / _SIZES[b])
    out[ACCENTED, ACCENTED] -= 1.5  # letters with accents seldom stand side by side
    return out


def likelihood(text: str, name: str) -> tuple[float, float, bool]:
    """Logarithm of the likelihood of a reading in a character set as a chain; of how rare texts of its sort are; and whether all its characters stand in texts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(points, (1 << 16) - 1)
    kind = np.where(points < 1 << 16, _kinds(name)[low], RARE)
    pairs = np.bincount(np.concatenate([[BLANK], kind[:-1]]) * 15 + kind, minlength=225) if len(kind) else np.zeros(225)
    many = np.bincount(kind, minlength=15)
    rare = 0.0
    if _SCRIPT[name] not in ("western", "any"):
        signs, shown = many[_SIGNS].sum(), [*_SIGNS, SYMBOL]
        if 0 < many[shown].sum() < many[ASCII] + many[ACCENTED]:
            rare += math.log(MIXED) + math.log(BEGUN) * float(pairs.reshape(15, 15)[BLANK, shown].sum())
        if 2 * many[ALPHABET] > signs:
            rare += math.log(FOREIGN)
    elif name.startswith("utf-16") and (points & 0xFF).all() and (points >> 8).all():
        rare += math.log(ZEROLESS)
    return float(pairs @ _chain(name).ravel() + _weights()[low].sum()), rare, not many[[CONTROL, NONE]].any()


def _once(data: bytes) -> bytes:
    """The distinct words, between white space as all character sets but UTF-16 have it."""
    return b" ".join(dict.fromkeys(data.split()))


def detect(data: bytes) -> tuple[str, str, bool] | None:
    """``(text, character set, sure)`` of bytes; null if every character set that reads them finds control characters, and nothing likelier than random bytes.

    A byte order mark decides. Whole texts are read, not their beginnings.
    """
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") and len(data) % 2 == 0:
        name = "utf-16-le" if data[:1] == b"\xff" else "utf-16-be"
        try:
            return data[2:].decode(name), name, True
        except UnicodeDecodeError:
            pass
    found = []
    for place, name in enumerate(CHARSETS):
        if name.startswith("utf-16") and len(data) % 2:
            continue
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        chain, rare, plain = likelihood(text, name)
        found.append((chain + rare, -place, name, text, rare < 0, plain or chain >= len(data) * RANDOM - SLACK))
    if not found:
        return None
    found.sort(reverse=True)
    words = _once(data)
    if found[0][4] or len(words) < len(data) and likelihood(words.decode(name := found[0][2], "replace"), name)[1]:  # of a rare sort: once more by distinct words
        again = [f if f[2].startswith("utf-16") else (sum(likelihood(words.decode(f[2]), f[2])[:2]), *f[1:]) for f in found]
        found = sorted(again, reverse=True)
    best = found[0]
    if not best[5]:
        return None
    others = [f[0] for f in found[1:] if f[3] != best[3]]
    return best[3], best[2], not others or best[0] - others[0] >= SURE
